"""The registered queries of these operators, and the SQL that checks them."""

from __future__ import annotations

import functools
import os
import string
import tempfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline
from plumbline.operators.staging import join_side, stage

from . import (
    byte_bpe,
    exact_dedup,
    fingerprints,
    language_id,
    line_dedup,
    mixing,
    periodic_runs,
    prefix_trie,
    sharding,
    simhash_dedup,
    token_counts,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

COUNTED = "byte_bpe_50k.json"
ENCODED = "byte_bpe_multi_50k.tiktoken"
BLOCK = 64

_queries: dict[str, Query] = {}


def prepare(spark: SparkSession) -> None:
    """What a session of a test lacks and a cluster has: a folder for intermediate tables, and
    this package on the workers' path. Batches stay small, since texts may be long."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    home = os.path.dirname(os.path.dirname(os.path.abspath(plumbline.__file__)))
    known = context.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    _queries[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def statements() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_fingerprints(spark, sf_dir):
    """Beside the contract's columns: for every id divisible by 100, how many documents lie
    within three bits, itself included; null for the others."""
    marks = fingerprints.with_next(documents(spark, sf_dir))
    asked = F.col("doc_id") % 100 == 0
    found = fingerprints.within_radius(marks, marks.where(asked), radius=3)
    sizes = marks.groupBy(F.col("fingerprint").alias("match")).agg(F.count(F.lit(1)).alias("n"))
    near = found.join(sizes, "match").groupBy("fingerprint").agg(F.sum("n").alias("n_near"))
    return marks.join(near, "fingerprint", "left").withColumn("n_near", F.when(asked, F.col("n_near")))


@query
def op2_token_counts(spark, sf_dir):
    path = public_tokenizers.path(COUNTED)
    return token_counts.token_counts(documents(spark, sf_dir), path)


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


@query
def op4_warc(spark, sf_dir):
    """Size and digest of a response are those of the payload read back."""
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("bigint"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query
def op5_byte_bpe(spark, sf_dir):
    coded = byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(ENCODED))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids_sha256", "decoded_sha256"
    )


@query
def op7_line_dedup(spark, sf_dir):
    cleaned = line_dedup.dedup_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# Verdict, host and path of the rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op6_url_filters(spark, sf_dir):
    """The URLs that a rule decides are the labelled ones."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def held_out():
    """Whether a document is kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_model(docs):
    return language_id.learn(docs.where(~held_out()))


@query
def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    told = language_id.predict(docs.select("doc_id", "text"), language_model(docs))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


@query
def op9_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(documents(spark, sf_dir), shingle=3, radius=3)


@query
def op10_mixing(spark, sf_dir):
    return mixing.mix_documents(documents(spark, sf_dir), block=BLOCK)


@query
def op11_sharding(spark, sf_dir):
    """Sizes and checksums are those of the texts read back from the shards."""
    found = sharding.shard_documents(documents(spark, sf_dir), shards=24)
    text = F.col("doc.text")
    return found.select(
        "doc.doc_id",
        sharding.text_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def rebuilt(conversations):
    """Turns and conversations as the contract has them: of conversation c the first h = crc32(c) mod 6
    turns give way to as many of conversation c - c mod 100, or to all if it has fewer."""
    own = prefix_trie.in_order(conversations)
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h")
    base = F.expr("conv_id - pmod(conv_id, 100)").alias("base")
    heads = own.where((F.col("pos") <= 5) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    lengths = join_side(stage(heads.groupBy("base").agg(F.max("pos").alias("n")), "bases"))
    given = F.least("h", F.coalesce("n", F.lit(0).cast("bigint"))).alias("given")
    convs = own.select("conv_id").distinct().select("conv_id", base, h).join(lengths, "base", "left")
    convs = stage(convs.select("conv_id", "base", given), "conversations")
    first = convs.join(heads, "base").where(F.col("pos") <= F.col("given")).select(*own.columns)
    rest = own.select("*", base, h).where(F.col("pos") > F.col("h")).join(lengths, "base", "left")
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + given).select(*own.columns)
    return stage(first.unionByName(rest), "rebuilt"), convs


@query
def op12_prefix_trie(spark, sf_dir):
    turns, convs = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(turns, convs).drop("k1", "k2")


def repeating(docs):
    """``docs`` as the contract has them: with h the crc32 of the id and g = h div 10, where 10 divides
    h the words from a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words found there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    marked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), F.expr("crc32(cast(doc_id as string)) div 10").alias("_g"))
    marked = marked.withColumn("_a", F.when(F.size("_w") > 0, F.col("_g") % F.size("_w")))
    marked = marked.withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    edited = F.transform("_w", lambda w, i: F.get("_w", source(i).cast("int")))
    return marked.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(repeating(documents(spark, sf_dir)))
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    told = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: ``mixing._hashed`` in SQL, and what a round of the permutation is numbered by.
_MIXED = f"((({{0}}) % {mixing.P} * 48271 + 11) % {mixing.P})"
_HASHED = f"(({_MIXED} * {_MIXED} + 2718281) % {mixing.P} % {mixing.R})"
_ROUND = f"rank * {mixing.Q} + turn * 10007 + r * 101"

SQL = {
    "op3_exact_dedup": f"""
with digests as (
    select doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}',
        '{string.ascii_lowercase}')) as text_sha256
    from documents
), grouped as (
    select doc_id, text_sha256, max(doc_id) over (partition by text_sha256) as keep_id,
        count(*) over (partition by text_sha256) as group_size
    from digests
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from grouped
""",
    "op4_warc": f"""
with payloads as (
    select page_id, coalesce(html, '') as payload, sha256(coalesce(html, '')) as payload_digest from pages
), grouped as (
    select page_id, payload_digest, strlen(payload) as payload_bytes,
        min(page_id) over (partition by payload_digest) as first
    from payloads
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= {warc.WORTH_IT} and first <> page_id then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {warc.WORTH_IT} and first <> page_id then first end as refers_to
from grouped
""",
    "op10_mixing": f"""
with sizes as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size
    from documents
), sources as (
    select source, cast(sum(size) as bigint) as source_size, count(*) as n_rows,
        row_number() over (order by source nulls last) - 1 as rank
    from sizes group by source
), capped as (
    select *, case rank % 3 when 0 then 3 when 1 then 1 else 2 end as weight,
        source_size * 2.0::double as cap
    from sources
), levels as (
    select *, (1.5::double * sum(source_size) over () - (sum(cap) over filling - cap))
        / (sum(weight) over () - (sum(weight) over filling - weight)) as level
    from capped
    window filling as (order by cap / weight, rank rows unbounded preceding)
), targets as (
    select *, least(cap, max(level) over () * weight) as target from levels
), counted as (
    select *, cast(ceil(source_size / {BLOCK}.0) as bigint) as n_blocks,
        case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes
    from targets
), quotas as (
    select *, cast(least(round((target - passes * source_size) / {BLOCK}), n_blocks) as bigint) as rest
    from counted
), placed as (
    select doc_id, size, q.rank, q.source_size, q.target, q.n_blocks, q.passes, q.rest,
        sum(size) over (partition by q.rank order by
            {_HASHED.format(f"(coalesce(doc_id, 0) % {mixing.P} + {mixing.P}) % {mixing.P} * 48271 % {mixing.P} + size * 40503")}
                % greatest(1, n_rows // {mixing.BUCKET}),
            doc_id, size rows unbounded preceding) - size as first
    from sizes s join quotas q on s.source is not distinct from q.source
), rounds as (
    select rank, turn, n_blocks, list_transform(range({mixing.ROUNDS}), lambda r: {_HASHED.format(_ROUND + " + 17")}) as seeds,
        list_transform(range({mixing.ROUNDS}), lambda r:
            ({_HASHED.format(_ROUND + " + 17")} * {mixing.R} + {_HASHED.format(_ROUND + " + 59")}) % n_blocks) as keys
    from quotas, (select unnest([0, 1, 2]) as turn) where n_blocks > 0
), slots as (
    select f.rank, list_reduce(list_prepend(j, range({mixing.ROUNDS})), lambda x, r:
        case when ({_HASHED.format("greatest(x, (keys[r + 1] - x + f.n_blocks) % f.n_blocks) + seeds[r + 1]")} >> 10) % 2 = 1
        then (keys[r + 1] - x + f.n_blocks) % f.n_blocks else x end) as block
    from rounds f join quotas q on f.rank = q.rank,
        unnest(range(case when turn < passes then q.n_blocks when turn = passes then q.rest else 0 end)) t(j)
), times as (
    select rank, block, count(*) as times from slots group by all
), pieces as (
    select rank, doc_id, first, unnest(range(cast(first // {BLOCK} as bigint), cast((first + size - 1) // {BLOCK} as bigint) + 1)) as block, size
    from placed where size > 0
), taken as (
    select p.rank, p.doc_id, p.first,
        cast(sum((least(p.first + size, (p.block + 1) * {BLOCK}) - greatest(p.first, p.block * {BLOCK})) * times) as bigint) as taken
    from pieces p join times t on p.rank = t.rank and p.block = t.block group by all
)
select p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) as taken
from placed p left join taken t on p.size > 0 and p.rank = t.rank and p.first = t.first
""",
    "op12_prefix_trie": """
with own as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
        coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
), lengths as (
    select conv_id, count(*) as n from own group by conv_id
), convs as (
    select c.conv_id, c.conv_id - c.conv_id % 100 as base, xor(list_reduce(
        list_concat([4294967295::bigint], list_transform(string_split(c.conv_id::varchar, ''), lambda x: ord(x)::bigint)),
        lambda crc, byte: list_reduce(
            [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))
        )), 4294967295::bigint) % 6 as h
    from lengths c
), given as (
    select convs.*, least(h, coalesce(n, 0)) as given from convs left join lengths on base = lengths.conv_id
), turns as (
    select g.conv_id, o.pos, role, text from given g join own o on o.conv_id = g.base and o.pos <= g.given
    union all
    select g.conv_id, o.pos - h + given, role, text from given g join own o on o.conv_id = g.conv_id and o.pos > h
), paths as (
    select conv_id, pos as depth, length(text) as chars,
        sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by pos)) as node
    from turns
    union all
    select conv_id, 0, 0, '' from convs
), members as (
    select *, lag(node) over (partition by conv_id order by depth) as parent,
        lead(node) over (partition by conv_id order by depth) is null as ends
    from paths
), nodes as (
    select node, min(depth) as depth, min(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
        (count(*) - 1) * min(chars) as gain,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from members group by node
), children as (
    select parent as node, count(*) as n_children from nodes where parent is not null group by parent
), trie as (
    select n.*, coalesce(n_children, 0) as n_children from nodes n left join children c on n.node = c.node
), below as (
    select distinct a.node, b.node as low from members a join members b on a.conv_id = b.conv_id and a.depth <= b.depth
), sums as (
    select b.node, count(*) filter (where t.n_children = 0) as n_leaves, cast(sum(t.gain) as bigint) as saved_tokens
    from below b join trie t on b.low = t.node group by b.node
)
select t.conv_id, t.depth, p.conv_id as parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, t.ends_sha256
from trie t join sums s on t.node = s.node left join trie p on t.parent = p.node
""",
}
