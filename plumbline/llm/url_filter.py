"""URL filters: rules for hosts and paths, and boosted trees on lexical features for the rest.

Everything is built-in functions and Spark's own tree ensemble; nothing runs Python on executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.staging import join_side, stage

ALLOW, BLOCK = "allow", "block"
#: ``(verdict, host, path)``
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "size", "depth", "digits", "entropy", "params", "labels", "hyphens",
    "suffix_rows", "suffix_rate", "domain_rows", "domain_rate",
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path. Both empty for null and for what has no ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(after, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all below
    it, when the path begins with the rule's. Of rules of one length the first listed wins.
    The list is configuration and becomes one expression."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(rule: Rule) -> Column:
        below = (host == rule[1]) | F.endswith(host, F.lit(f".{rule[1]}"))
        return below & F.startswith(path, F.lit(rule[2]))

    named = [F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ranked]
    if not named:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    found = F.coalesce(*named)
    return found["rule"], found["verdict"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the features that need nothing but the URL, and its suffix and domain (the last
    and the last two labels of the host). The entropy is that of the characters, in bits."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    size = F.length(text)
    characters = F.array_distinct(F.split(text, ""))
    share = F.transform(characters, lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    bits = F.aggregate(share, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.coalesce(F.regexp_extract(text, r"(?s)\?([^#]*)", 1), F.lit(""))
    return df.withColumns(
        {
            "size": size.cast("double"),
            "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
            "digits": _share(F.regexp_count(text, F.lit("[0-9]")).cast("double"), size),
            "entropy": F.when(size > 0, bits).otherwise(0.0),
            "params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "labels": F.regexp_count(host, F.lit(r"[^.]+")).cast("double"),
            "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
            "_suffix": F.substring_index(host, ".", -1),
            "_domain": F.substring_index(host, ".", -2),
        }
    )


def _statistics(pages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``pages`` and smoothed share of blocked ones in ``known`` (``url``, ``label``) for
    each suffix and each domain of either. Every row counts. Rows are folded by domain
    map-side, and suffixes are counted from domains."""
    seen = pages.select("url", F.lit(1).alias("rows"), F.lit(0).alias("known"), F.lit(0.0).alias("blocked"))
    told = known.select("url", F.lit(0).alias("rows"), F.lit(1).alias("known"), F.col("label").alias("blocked"))
    host, _ = host_and_path(F.col("url"))
    counts = [F.sum(c).alias(c) for c in ("rows", "known", "blocked")]
    both = seen.unionByName(told).withColumn("_domain", F.substring_index(host, ".", -2))
    by_domain = stage(both.groupBy("_domain").agg(*counts), "url-counts")

    def features(counted: DataFrame, key: str, name: str) -> DataFrame:
        rate = (F.col("blocked") + 1.0) / (F.col("known") + 2.0)
        return counted.select(key, F.log1p("rows").alias(f"{name}_rows"), rate.alias(f"{name}_rate"))

    by_suffix = by_domain.groupBy(F.substring_index("_domain", ".", -1).alias("_suffix")).agg(*counts)
    suffixes = stage(features(by_suffix, "_suffix", "suffix"), "url-suffixes")
    return suffixes, stage(features(by_domain, "_domain", "domain"), "url-domains")


class UrlFilter:
    """Trees, and the statistics of all suffixes and domains."""

    def __init__(self, model: GBTClassificationModel | None, fallback: str, suffixes: DataFrame, domains: DataFrame):
        self.model, self.fallback = model, fallback
        self.suffixes, self.domains = join_side(suffixes), join_side(domains)

    def features(self, df: DataFrame) -> DataFrame:
        """Both tables have a row for each key met: broadcast up to a measured bound only."""
        joined = df.join(self.suffixes, "_suffix", "left").join(self.domains, "_domain", "left")
        unseen = {"suffix_rows": 0.0, "suffix_rate": 0.5, "domain_rows": 0.0, "domain_rate": 0.5}
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined.fillna(unseen))

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Adds ``judged``. Without trees (one class in training, or no rows) that class."""
        if self.model is None:
            return df.withColumn("judged", F.lit(self.fallback))
        scored = self.model.transform(self.features(df))
        return scored.withColumn("judged", F.when(F.col("prediction") > 0.5, BLOCK).otherwise(ALLOW))


def _drawn(known: DataFrame, most: int) -> DataFrame:
    """``(url, label, weight)`` for the trees, ``most`` rows on average at most. Equal rows are
    folded first, map-side, so a hot URL is one row and weighs what it counts. A row is drawn with
    a chance in proportion to its count, by a hash of the URL, and weighs what rows not drawn
    leave to it; one that holds more than its share of the rows is always drawn."""
    folded = stage(known.groupBy("url", "label").agg(F.count(F.lit(1)).alias("count")), "url-labels")
    rows = folded.agg(F.sum("count")).first()[0] or 0
    share = F.least(F.lit(1.0), F.col("count") * (most / max(rows, 1)))
    draw = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) / 1_000_000
    taken = folded.where(draw < share).select("url", "label", (F.col("count") / share).alias("weight"))
    return taken.repartition(1).sortWithinPartitions("url", "label")


def train(
    labelled: DataFrame,
    url: str = "url",
    verdict: str = "verdict",
    most: int = 20_000,
    rounds: int = 12,
    depth: int = 4,
    pages: DataFrame | None = None,
) -> UrlFilter:
    """Boosted trees from URLs with a verdict (others are passed over).

    About ``most`` URLs at most are taken for the trees, by a hash, all when there are fewer rows;
    see ``_drawn``. The sample is written down in order, so that reruns agree.
    Suffixes and domains are not sampled: their rows are counted over all of ``pages`` (column
    ``url``; the labelled rows when not given), their rates over all labelled rows.
    """
    known = labelled.where(F.col(verdict).isin(ALLOW, BLOCK)).select(
        F.col(url).alias("url"), (F.col(verdict) == BLOCK).cast("double").alias("label")
    )
    sample = stage(lexical(stage(_drawn(known, most), "labelled-urls")), "url-features")
    suffixes, domains = _statistics(known if pages is None else pages, known)
    classes = {r["label"] for r in sample.select("label").distinct().collect()}  # two at most
    if len(classes) < 2:
        return UrlFilter(None, BLOCK if classes == {1.0} else ALLOW, suffixes, domains)
    untrained = UrlFilter(None, ALLOW, suffixes, domains)
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7
    )
    return UrlFilter(trees.fit(untrained.features(sample)), ALLOW, suffixes, domains)


def judge_urls(
    pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url", most: int = 20_000
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per input row.

    A rule's verdict stands; URLs without one are judged by trees that were trained on
    ``labelled`` (``url``, ``verdict``), or on the URLs that the rules decide. Suffixes and
    domains are counted over all rows. Null and empty URLs are judged by their features: those
    of the empty host, all others zero. Equal URLs get equal verdicts.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    ruled = rows.withColumn("host", host).withColumn("path", path)
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumn("rule", rule).withColumn("told", told)
    examples = ruled.select("url", F.col("told").alias("verdict")) if labelled is None else labelled
    judged = train(examples, most=most, pages=rows).verdicts(lexical(ruled))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", "judged").alias("verdict"))
