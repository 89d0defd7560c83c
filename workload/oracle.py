"""The same results in DuckDB SQL, over the same tables.

Statements are chains of common table expressions. They follow the definition of each
operator literally (theta joins, row numbers), not the way the Spark plans compute it.
"""

from __future__ import annotations

AS_OF = "date '2024-01-30'"

PRODUCT = "case n_nationkey when 24 then 'Linux' when 23 then 'Android' else n_name end"
CHANNEL = "case o_orderstatus when 'P' then 'patch' when 'F' then 'production' else 'beta' end"
NUMBER = "concat(o_orderkey % 9, '.', o_orderkey % 7, '.', o_orderkey % 5)"
DATE_TEXT = "concat(month(ts), '-', 1 + event_id % 28, '-', 1995 + event_id % 7)"
VENDOR = "concat('NATION_', user_id % 30)"
# Question patterns and the answer of an abstention.
PATCH_VENDOR = r"patch\s+for\s+([^,.?]+?)(?:\s+on\s+|\s*[.?]|\s*$)"
DATE = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
INTENT = (
    r"version|release|build|firmware|update|license|note|operating system|\bos\b"
    r"|android|ios|windows|linux|ubuntu|macos"
)
DONT_KNOW = "I don''t know about the question you asked."

# -- the derived tables -------------------------------------------------------------------

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """``body`` after the tables it needs, in order of dependence."""
    order: list[str] = []

    def visit(name):
        if name not in order:
            for need in CTE[name][0]:
                visit(need)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as materialized ({CTE[n][1]})" for n in order) + "\n" + body


cte(
    "releases",
    f"""select o_orderkey as pos, concat('r', o_orderkey) as id,
      case when o_orderkey % 29 = 0 then null else {NUMBER} end as version_number,
      c_mktsegment as brand, product as name, {CHANNEL} as channel,
      case when o_orderkey % 31 = 0 then ''
           when o_orderkey % 17 = 0
             then concat(strftime(o_orderdate, '%Y'), '[29]', strftime(o_orderdate, '%m%d'))
           else strftime(o_orderdate, '%Y%m%d') end as release_date,
      epoch_ms(o_orderdate) as ts_ms,
      case when o_orderkey % 23 = 0 then null
           else [lower(product), {CHANNEL}, strftime(o_orderdate, '%Y%m%d'), {NUMBER}]
      end as tags,
      repeat(concat(o_orderpriority, ' '), 1 + o_orderkey % 40) as notes,
      concat('https://example.com/r/', o_orderkey) as url,
      case when o_orderkey % 3 = 0 then '' else 'Apache 2.0' end as license,
      o_orderpriority = '1-URGENT' as is_cve
    from orders join customer on o_custkey = c_custkey
    join (select n_nationkey, {PRODUCT} as product from nation) on c_nationkey = n_nationkey""",
)
cte(
    "docs",
    """select *, substr(regexp_replace(release_date, '[^0-9]', '', 'g'), 1, 8) as date_norm,
      lower(name) as name_lower, lower(brand) as brand_lower,
      coalesce(list_transform(tags, lambda t: lower(t)), []::varchar[]) as tags_lower
    from releases""",
    "releases",
)
cte(
    "vendor_names",
    f"""select n_nationkey::bigint as pos, {PRODUCT} as name from nation
    union all select n_nationkey + 1, 'Ubuntu' from nation where n_nationkey = 24""",
)
cte(
    "questions",
    f"""select event_id as question_id, ts as asked_at, user_id, case event_id % 10
      when 0 then concat('What is the patch for ', {VENDOR}, ' on ', {DATE_TEXT}, '?')
      when 1 then concat('Patch for ', {VENDOR})
      when 2 then concat('What is the version of ', {VENDOR}, ' on ', {DATE_TEXT})
      when 3 then concat('Latest ', {VENDOR}, ' release')
      when 4 then concat('Linux patch released on ', {DATE_TEXT})
      when 5 then 'hello there'
      when 6 then concat('Patch for Roblox on ', {DATE_TEXT})
      when 7 then concat('What license does Android use on ', {DATE_TEXT}, '?')
      when 8 then 'Get me the patch for Ubuntu.'
      else concat('patch for Linux on ', {DATE_TEXT}) end as question
    from events""",
)
cte(
    "log",
    """select event_id as pos, ts,
      case when event_type = 'error' then 'error' when event_type = 'signup' then 'abstain'
           else 'answer' end as status,
      case event_id % 3 when 0 then 'patch' when 1 then 'os' else 'unknown' end as flow,
      case when user_id % 11 = 0 then '  ' else concat('Vendor_', user_id % 12) end as vendor,
      case when event_id % 13 = 0 then null else floor(value)::bigint end as latency_ms,
      case when event_type = 'signup' then case event_id % 4
             when 0 then 'patch_vendor_not_in_names' when 1 then 'os_no_match'
             when 2 then 'no_results' else null end
           when event_type = 'error' then case when event_id % 2 = 0 then 'server_error' end
           else 'answered' end as reason,
      case event_id % 5 when 0 then 0 when 1 then null else 1 end as is_vendor_found
    from events""",
)
cte(
    "requests",
    """select distinct
      case user_id % 37 when 30 then 'linux' when 31 then 'android' when 32 then 'beta'
        when 33 then 'n' when 34 then 'linux kernel' when 35 then 'ation'
        when 36 then 'roblox' else concat('nation_', user_id % 37) end as key,
      case when event_id % 4 = 0 then ''
        else concat(1991 + event_id % 9, lpad((1 + event_id % 14)::varchar, 2, '0'),
                    lpad((1 + event_id % 31)::varchar, 2, '0')) end as date
    from events""",
)

# -- parsing and routing ------------------------------------------------------------------


def parsed(text: str, first: int = 1, second: int = 2) -> str:
    def part(n):
        return f"lpad(regexp_extract({text}, '{DATE}', {n}), 2, '0')"

    return f"""nullif(trim(regexp_extract({text}, '{PATCH_VENDOR}', 1)), '') as parsed_vendor,
      case when regexp_matches({text}, '{DATE}')
        then concat(regexp_extract({text}, '{DATE}', 3), {part(first)}, {part(second)})
      end as parsed_date"""


def routing(suffix: str, vendor_match: str, strict: bool, first: int = 1, second: int = 2) -> None:
    cte(
        f"texts{suffix}",
        f"""select text, normalized, {parsed("normalized", first, second)} from
          (select distinct trim(question) as text, lower(trim(question)) as normalized
           from questions)""",
        "questions",
    )
    cte(
        f"named{suffix}",
        f"""select text, name as vendor_name from (
          select t.text, n.name, row_number() over (
            partition by t.text order by length(n.name) desc, n.pos) as rn
          from texts{suffix} t join vendor_names n
            on length(n.name) >= 2 and {vendor_match}) where rn = 1""",
        f"texts{suffix}",
        "vendor_names",
    )
    cte(
        f"listed{suffix}",
        f"""select parsed_vendor from (
          select distinct parsed_vendor from texts{suffix} where parsed_vendor is not null) v
        where exists (select 1 from vendor_names n where contains(lower(n.name), v.parsed_vendor)
                                                  or contains(v.parsed_vendor, lower(n.name)))""",
        f"texts{suffix}",
        "vendor_names",
    )
    repeated = "or normalized = repeat(left(normalized, 1), length(normalized))" if strict else ""
    cte(
        f"routed{suffix}",
        f"""select *, case when branch in ('patch_for', 'linux_text') then 'patch' else branch end as flow,
          case branch when 'patch_for' then parsed_vendor when 'linux_text' then 'linux'
            when 'os' then lower(coalesce(vendor_name, 'android')) end as key,
          coalesce(parsed_date, '') as date
        from (select t.*, n.vendor_name, l.parsed_vendor is not null as in_names,
            case when n.vendor_name is not null or l.parsed_vendor is not null then 1 else 0 end
              as is_vendor_found,
            case when t.parsed_vendor is not null then 'patch_for'
              when contains(normalized, 'linux') and not contains(normalized, 'android')
                then 'linux_text'
              when not (n.vendor_name is not null or parsed_date is not null
                        or regexp_matches(normalized, '{INTENT}')) {repeated} then 'unknown'
              else 'os' end as branch
          from texts{suffix} t left join named{suffix} n using (text)
          left join listed{suffix} l on t.parsed_vendor = l.parsed_vendor)""",
        f"texts{suffix}",
        f"named{suffix}",
        f"listed{suffix}",
    )


routing("", "contains(t.normalized, lower(n.name))", strict=False)
routing(
    "_strict",
    r"regexp_matches(t.normalized, concat('\b', lower(n.name), '\b'))",
    strict=True,
    first=2,
    second=1,
)

# -- lookups ------------------------------------------------------------------------------


def by_product(
    name: str, requests: str, fallback: bool = True, *needs: str, corpus: str = "docs", in_days: bool = False
) -> None:
    far = "length(d.date_norm) >= 6"
    gap = "abs(d.date_norm::int - r.date::int)"
    if in_days:
        day = "case when length({0}) = 8 then try_strptime({0}, '%Y%m%d') end"
        theirs, asked = day.format("d.date_norm"), day.format("r.date")
        far = f"({theirs}) is not null and ({asked}) is not null"
        gap = f"abs(date_diff('day', {theirs}, {asked}))"
    cte(
        f"{name}_keyed",
        f"""select unnest(list_distinct(list_append(tags_lower, name_lower))) as key,
             pos, ts_ms, date_norm from {corpus}""",
        corpus,
    )
    first = f"(select min(pos) from {corpus})" if fallback else "null"
    cte(
        name,
        f"""select r.key, r.date, coalesce(b.pos, {first}) as pos from {requests} r left join (
          select key, date, pos, row_number() over (
            partition by key, date order by rule, gap, ts_ms desc, pos) as rn
          from (select r.key, r.date, d.pos, d.ts_ms,
              case when r.date = '' then 2 when d.date_norm = r.date then -1
                   when {far} then 0 else 1 end as rule,
              case when r.date <> '' and {far} then {gap} else 0 end as gap
            from {requests} r join {name}_keyed d on d.key = r.key)) b
          on b.key = r.key and b.date = r.date and b.rn = 1""",
        f"{name}_keyed",
        *needs,
    )


def by_vendor(name: str, requests: str, feed: str, any_field: bool, *needs: str) -> None:
    if any_field:
        hit = """(list_contains(d.tags_lower, 'patch') and (
            len(list_filter(d.tags_lower, lambda t: contains(t, v.key))) > 0
            or contains(d.name_lower, v.key) or contains(d.brand_lower, v.key)))"""
        rule = "case when r.date = '' then 2 when d.date_norm = r.date then 1 else 2 end"
    else:
        hit = """(list_contains(d.tags_lower, 'patch') and (
            contains(d.tags_lower[1], v.key) or contains(v.key, d.tags_lower[1])))"""
        rule = """case when r.date = '' then 2 when list_contains(d.tags, r.date) then 0
            when d.date_norm = r.date then 1 else 2 end"""
    cte(
        f"{name}_cand",
        f"""select v.key, d.* exclude (notes, url) from (select distinct key from {requests}) v
            join {feed} d on {hit}""",
        *needs,
        feed,
    )
    cte(
        name,
        f"""select r.key, r.date, b.pos from {requests} r left join (
          select key, date, pos, row_number() over (
            partition by key, date
            order by rule, case when rule < 2 then 0 else -ts_ms end, pos) as rn
          from (select r.key, r.date, d.pos, d.ts_ms, {rule} as rule
            from {requests} r join {name}_cand d on d.key = r.key)) b
          on b.key = r.key and b.date = r.date and b.rn = 1""",
        f"{name}_cand",
    )


def by_date(name: str, requests: str, feed: str, *needs: str) -> None:
    cte(
        f"{name}_dates",
        f"""select date, coalesce(
          case when date = '' then (select arg_min(pos, (-ts_ms, pos)) from {feed}) end,
          (select min(pos) from {feed} f where date <> '' and
             (starts_with(replace(f.release_date, '-', ''), date)
              or starts_with(date, left(replace(f.release_date, '-', ''), 8)))),
          (select min(pos) from {feed})) as pos
        from (select distinct date from {requests})""",
        *needs,
        feed,
    )
    cte(
        name,
        f"select r.key, r.date, d.pos from {requests} r join {name}_dates d using (date)",
        f"{name}_dates",
        *needs,
    )


def vendor_hit(v: str) -> str:
    return f"""(len(list_filter(tags_lower, lambda t: contains(t, '{v}'))) > 0
      or contains(name_lower, '{v}') or contains(brand_lower, '{v}'))"""


cte("feed", "select * from docs where channel = 'patch'", "docs")
cte("linux_feed", f"select * from docs where channel = 'patch' and {vendor_hit('linux')}", "docs")
for _feed in ("feed", "linux_feed"):
    cte(f"{_feed}_25", f"select * from {_feed} order by ts_ms desc, pos limit 25", _feed)

by_product("product_pick", "requests", True, "requests")
cte(
    "repaired_docs",
    r"""select * replace (substr(regexp_replace(regexp_replace(release_date, '\[[^\]]*\]', '', 'g'), '[^0-9]', '', 'g'), 1, 8)
      as date_norm) from docs""",
    "docs",
)
by_product("calendar_pick", "requests", True, "requests", corpus="repaired_docs", in_days=True)
by_product("known_pick", "requests", False, "requests")
by_vendor("vendor_pick", "requests", "feed", False, "requests")
cte(
    "free_requests",
    """select distinct concat('linux k', event_id % 997) as key,
         concat(1991 + event_id % 9, lpad((1 + event_id % 12)::varchar, 2, '0'),
           lpad((1 + event_id % 28)::varchar, 2, '0')) as date
       from events""",
)
cte("cve_feed", "select * from feed where is_cve", "feed")
by_vendor("cve_pick", "requests", "cve_feed", False, "requests")
by_vendor("free_pick", "free_requests", "feed", False, "free_requests")
by_vendor("field_pick", "requests", "docs", True, "requests")
by_date("date_pick", "requests", "linux_feed", "requests")

# -- answers ------------------------------------------------------------------------------


def clip(text: str, n: int) -> str:
    return f"concat(left({text}, {n}), case when length({text}) > {n} then '…' else '' end)"


def patch_text(version: str) -> str:
    notes = "coalesce(nullif(notes, ''), 'N/A')"
    return f"""concat('Patch version: ', {version}, chr(10),
      case when coalesce(url, '') <> '' then concat('URL: ', url, chr(10)) else '' end,
      'Release notes: ', {clip(notes, 200)})"""


OS_TEXT = """concat('Version: ', coalesce(version_number, ''), '. Release notes: ',
  coalesce(nullif(notes, ''), 'N/A'), '. License: ', coalesce(nullif(license, ''), 'N/A'), '.')"""
ASKED_VERSION = "coalesce(version_number, tags[-1], 'N/A')"
FEED_VERSION = "coalesce(tags[-1], version_number, '')"


def answering(
    name: str, routed: str, feed: str, linux_feed: str,
    any_field=False, fallback=True, corpus="docs",
):
    for lookup, branch in (("os", "os"), ("asked", "patch_for"), ("linux", "linux_text")):
        listed = "and in_names" if lookup == "asked" else ""
        cte(
            f"{name}_{lookup}_req",
            f"select distinct key, date from {routed} where branch = '{branch}' {listed}",
            routed,
        )
    by_product(f"{name}_os", f"{name}_os_req", fallback, f"{name}_os_req", corpus=corpus)
    by_vendor(f"{name}_asked", f"{name}_asked_req", feed, any_field, f"{name}_asked_req")
    by_date(f"{name}_linux", f"{name}_linux_req", linux_feed, f"{name}_linux_req")
    cte(
        f"{name}_found",
        f"""select 'os' as branch, * from {name}_os union all
            select 'patch_for', * from {name}_asked union all
            select 'linux_text', * from {name}_linux""",
        f"{name}_os", f"{name}_asked", f"{name}_linux",
    )
    cte(
        name,
        f"""select q.question_id, q.asked_at, q.user_id, r.*, d.* exclude (pos),
          d.pos as doc, r.branch <> 'linux_text' or coalesce({vendor_hit("linux")}, false) as verified,
          case r.branch when 'os' then (select count(*) from {corpus})
            when 'patch_for' then case when in_names then (select count(*) from {feed}) end
            when 'linux_text' then (select count(*) from {linux_feed}) end as items_count
        from questions q join {routed} r on trim(q.question) = r.text
        left join {name}_found f on f.branch = r.branch and f.key = r.key and f.date = r.date
          and (r.branch <> 'patch_for' or r.in_names)
        left join docs d on d.pos = f.pos""",
        "questions", routed, f"{name}_found", "docs", feed, linux_feed, corpus,
    )
    cte(
        f"{name}_final",
        f"""select *, case when reason = 'answered' then 'answer' else 'abstain' end as status,
          case when reason = 'answered' then case branch when 'patch_for' then {ASKED_VERSION}
              when 'linux_text' then {FEED_VERSION} else coalesce(version_number, '') end
            when reason = 'os_no_match' then 'N/A' end as version,
          case when reason = 'answered' then case branch
              when 'patch_for' then {patch_text(ASKED_VERSION)}
              when 'linux_text' then {patch_text(FEED_VERSION)} else {OS_TEXT} end
            when reason = 'os_no_match' then 'No matching release found for that product or date.'
            else '{DONT_KNOW}' end as answer,
          case branch when 'os' then coalesce(vendor_name, 'android') when 'unknown' then 'unknown'
            else key end as logged_vendor
        from (select *, case when branch = 'patch_for' and not in_names
                  then 'patch_vendor_not_in_names'
                when branch = 'patch_for' and doc is null then 'patch_not_found_in_search_tags'
                when branch = 'linux_text' and items_count = 0 then 'no_results'
                when branch = 'linux_text' and not verified
                  then 'versionSearchTags_does_not_have_provided_vendor'
                when branch = 'unknown' then 'unknown_intent_not_patch_or_os_version'
                when branch = 'os' and doc is null then 'os_no_match'
                else 'answered' end as reason
              from {name})""",
        name,
    )


answering("answers", "routed", "feed", "linux_feed")
cte("os_docs", "select * from docs where channel <> 'patch'", "docs")
answering("answers_typed", "routed", "feed", "linux_feed", corpus="os_docs")
answering("answers_page", "routed", "feed_25", "linux_feed_25")
answering("answers_strict", "routed_strict", "feed", "linux_feed", any_field=True, fallback=False)

ANSWER_ROW = f"""
  question_id, text, branch, flow, status, reason, answer, version,
  case when status = 'answer' then notes end as notes,
  case when status = 'answer' and branch = 'os' then license end as license,
  case when status = 'answer' and branch <> 'os' then url end as url,
  case when status = 'answer' then name when flow = 'patch' then key else 'Unknown' end as vendor,
  'release table' as source,
  case when reason = 'patch_vendor_not_in_names' then 'vendor_names'
    when branch = 'patch_for' then 'releases?channel=patch'
    when branch = 'linux_text' then 'releases?q=linux&channel=patch' end as source_url,
  case when status = 'answer' then array_to_string(
    case when branch = 'patch_for' then coalesce(tags, []) else tags end, '|') end as search_tags,
  is_vendor_found,
  case when flow = 'patch' then key end as asked_vendor,
  parsed_date,
  case when branch = 'os' then key end as product,
  items_count, id as matched_id, null::varchar as matched_version_id,
  release_date as matched_release_date, array_to_string(tags, '|') as matched_tags,
  {clip("answer", 80)} as answer_preview, logged_vendor"""

EXPLAIN = r"""select question_id, nullif(text, '') as raw_question,
    nullif(normalized, '') as normalized_question, parsed_vendor, parsed_date, branch,
    case when branch = 'os' then case when contains(normalized, 'android') then 'android'
      when contains(normalized, 'ios') then 'ios'
      when contains(normalized, 'windows') then 'windows' else 'android' end end as product
  from (select q.question_id, t.*, case
      when parsed_vendor is not null and parsed_vendor <> 'linux' then 'patch_non_linux → idk'
      when parsed_vendor is not null
        or (contains(normalized, 'linux') and not contains(normalized, 'android'))
        then 'patch_linux' else 'os' end as branch
    from questions q join texts t on trim(q.question) = t.text)"""
cte("explained", EXPLAIN, "questions", "texts")
for _lookup, _branch, _key in (("os", "os", "product"), ("linux", "patch_linux", "'linux'")):
    cte(
        f"explain_{_lookup}_req",
        f"""select distinct {_key} as key, coalesce(parsed_date, '') as date
            from explained where branch = '{_branch}'""",
        "explained",
    )
by_product("explain_os", "explain_os_req", True, "explain_os_req")
by_date("explain_linux", "explain_linux_req", "linux_feed", "explain_linux_req")

# -- the ask log --------------------------------------------------------------------------


def percent(part: str, whole: str) -> str:
    return f"coalesce(((20000 * {part} + {whole}) // (2 * nullif({whole}, 0))) / 100.0::double, 0.0::double)"


MEAN = """((200 * sum(latency_ms) + count(latency_ms)) // (2 * nullif(count(latency_ms), 0)))
  / 100.0::double"""


def filtered(name: str, days: int, extra: str = "true") -> None:
    cte(
        name,
        f"""select *, coalesce(nullif(trim(vendor), ''), 'unknown') as vendor_label,
          case when status in ('abstain', 'error') then coalesce(nullif(reason, ''),
            case when status = 'error' then 'error' else 'unknown' end) end as reason_label,
          strftime(ts, '%Y-%m-%d') as day
        from log where ts::date between {AS_OF} - {days - 1} and {AS_OF} and {extra}""",
        "log",
    )


filtered("month", 30)
filtered("wide", 60)
filtered(
    "narrow", 7, "flow = 'os' and status = 'abstain' and contains(lower(vendor), 'vendor_1')"
)


def counted(label: str, name: str, rows: str, k: int) -> str:
    return f"""select {label} as {name}, count(*) as count, min(pos) as first_pos from {rows}
      where {label} is not null group by 1 order by 2 desc, 3 limit {k}"""


def days_of(rows: str, days: int) -> str:
    return f"""select d.day, coalesce(c.count, 0) as count from (
        select strftime(unnest(generate_series({AS_OF} - {days - 1}, {AS_OF}, interval 1 day)),
                        '%Y-%m-%d') as day) d
      left join (select day, count(*) as count from {rows} group by 1) c using (day)"""


def nearest_rank(p: int) -> str:
    at = f"greatest(1, ceil({p / 100}::double * count(latency_ms)))::bigint"
    return f"list_sort(list(latency_ms) filter (where latency_ms is not null))[{at}]"


def summary(rows: str, days: int, flow: str, status: str, vendor: str) -> str:
    def listed(label, k):
        return f"""(select string_agg(concat(label, '=', count), '|' order by count desc, first_pos)
          from ({counted(label, "label", rows, k)}))"""

    def top(inner):
        return f"greatest(coalesce((select max(count) from ({inner})), 1), 1)"

    recent = f"select * from {rows} order by ts desc, pos limit 12"
    return f"""select {days} as range_days, strftime({AS_OF} - {days - 1}, '%Y-%m-%d') as day_from,
      strftime({AS_OF}, '%Y-%m-%d') as day_to, '{flow}' as flow, '{status}' as status,
      {vendor} as vendor, count(*) as total_questions,
      count(*) filter (where status = 'answer') as answered_count,
      count(*) filter (where status = 'abstain') as abstain_count,
      count(*) filter (where status = 'error') as error_count,
      {percent("count(*) filter (where status = 'abstain')", "count(*)")} as abstain_rate,
      {percent("count(*) filter (where status = 'answer')", "count(*)")} as answer_rate,
      {nearest_rank(50)} as p50, {nearest_rank(95)} as p95, {MEAN} as average,
      coalesce({listed("vendor_label", 8)}, '') as top_vendors,
      coalesce({listed("reason_label", 6)}, '') as top_reasons,
      (select string_agg(concat(day, '=', count), '|' order by day) from ({days_of(rows, days)}))
        as time_buckets,
      {top(counted("vendor_label", "label", rows, 8))} as max_vendor_count,
      {top(days_of(rows, days))} as max_day_count,
      count(*) filter (where is_vendor_found = 0) as vendor_not_found_count,
      count(*) filter (where flow = 'os') as os_version_query_count,
      count(*) filter (where flow = 'patch') as patch_query_count,
      (select string_agg(concat_ws(':', epoch_us(ts) // 1000, status, vendor), '|' order by ts desc, pos)
         from ({recent})) as recent
    from {rows}"""


TODAY = """select coalesce(nullif(trim(vendor), ''), 'Unknown') as vendor, count(*) as count
  from ({rows}) where ts::date = {as_of} group by 1
  order by 2 desc, min((-epoch_us(ts), pos)) limit 3"""

LANDED = """select page * 4294967296 + idx as pos, id, name, version_number, ts_ms, is_cve,
    array_to_string(tags, '|') as tags
  from (select *, pos // 32 as page,
          row_number() over (partition by pos // 32 order by pos) - 1 as idx from releases)
  where page % 7 in ({kinds})"""

CLEAN = r"""array_to_string(list_filter(
    list_transform(string_split(answer, chr(10)), lambda l: trim(l)), lambda l: l <> ''
    and not (coalesce(version, '') <> '' and regexp_matches(lower(l), '^(patch\s*)?version\s*:'))
    and not (coalesce(shown_url, '') <> '' and regexp_matches(lower(l), '^url\s*:'))
    and not (coalesce(shown_notes, '') <> '' and regexp_matches(lower(l), '^release\s*notes?\s*:'))
  ), chr(10))"""


def days(kept: str) -> str:
    """Totals, rates and mean latency of the log's days."""
    return f"""select *, {percent("abstained", "total")} as abstain_rate,
          {percent("answered", "total")} as answer_rate
        from (select strftime(ts, '%Y-%m-%d') as day, count(*) as total,
            count(*) filter (where status = 'answer') as answered,
            count(*) filter (where status = 'abstain') as abstained,
            count(*) filter (where status = 'error') as errors,
            count(*) filter (where is_vendor_found = 0) as vendor_not_found,
            {MEAN} as latency_mean
          from log {kept}
          group by 1)"""


def statements() -> dict[str, str]:
    answered = "case when status = 'answer' then {} end"
    known = {
        "parse_questions": sql(
            f"""select question_id, normalized, {parsed("normalized")}
            from (select question_id, lower(trim(question)) as normalized from questions)""",
            "questions",
        ),
        "parse_questions_day_first": sql(
            f"""select question_id, parsed_date from (select question_id,
              {parsed("lower(question)", 2, 1)} from questions)""",
            "questions",
        ),
        "route_questions": sql("select text, branch, flow, is_vendor_found from routed", "routed"),
        "route_questions_strict": sql(
            "select text, branch, vendor_name from routed_strict", "routed_strict"
        ),
        "resolve_vendor": sql(
            """select question_id, vendor_name from questions q
            left join named n on trim(q.question) = n.text""",
            "questions",
            "named",
        ),
        "resolve_vendor_in_documents": """
            with names as (select distinct unnest([source, lang]) as name from documents)
            select doc_id, name as vendor_name from (
              select doc_id, name, row_number() over (
                partition by doc_id order by length(name) desc, length(name), name) as rn
              from documents join names
                on length(name) >= 2 and contains(lower(text), lower(name)))
            where rn = 1""",
        "vendor_in_names": sql("select parsed_vendor from listed", "listed"),
        "vendor_found_flag": sql(
            """select question_id, is_vendor_found from questions q
            join routed r on trim(q.question) = r.text""",
            "questions",
            "routed",
        ),
        "list_vendors": sql(
            "select pos, name from vendor_names order by pos limit 100", "vendor_names"
        ),
        "vendor_list_fallback": sql("select pos, name from vendor_names", "vendor_names"),
        "vendor_snapshot": sql(
            "select pos, name from releases where ts_ms = (select max(ts_ms) from releases)",
            "releases",
        ),
        "release_by_product_date": sql("select key, date, pos from product_pick", "product_pick"),
        "release_by_calendar_date": sql("select key, date, pos from calendar_pick", "calendar_pick"),
        "release_by_known_product": sql("select key, date, pos from known_pick", "known_pick"),
        "latest_release": sql(
            """select key, pos, version_number, release_date from (
              select lower(name) as key, *, row_number() over (
                partition by lower(name) order by ts_ms desc, pos) as rn from releases)
            where rn = 1""",
            "releases",
        ),
        "patch_by_vendor_date": sql("select key, date, pos from vendor_pick", "vendor_pick"),
        "cve_by_vendor": sql("select key, date, pos from cve_pick", "cve_pick"),
        "vendor_patch_cve_counts": sql(
            """select name as vendor, count(*) as n_releases,
              count(*) filter (where channel = 'patch') as n_patches,
              count(*) filter (where is_cve) as n_cves from releases group by 1""",
            "releases",
        ),
        "patch_by_free_text_vendor": sql("select key, date, pos from free_pick", "free_pick"),
        "patch_by_vendor_date_any_field": sql("select key, date, pos from field_pick", "field_pick"),
        "linux_style_patch_by_date": sql(
            "select p.key, p.date, p.pos, d.release_date from date_pick p join docs d using (pos)",
            "date_pick",
            "docs",
        ),
        "normalize_release_dates": sql("select pos, release_date, date_norm from docs", "docs"),
        "search_releases": sql(
            f"""select pos, name, release_date, array_to_string(tags, '|') as tags
            from feed where {vendor_hit("nation_1")}""",
            "feed",
        ),
        "search_releases_page": sql(
            """select pos, name, ts_ms from feed order by ts_ms desc, pos limit 25 offset 25""",
            "feed",
        ),
        "component_snapshot": sql(
            """select pos, coalesce(version_number, '') as main,
              string_split(coalesce(version_number, ''), '.')[-1] as last_value,
              coalesce(notes, '') as notes, coalesce(license, '') as license,
              name as product_name, release_date, array_to_string(tags, '|') as tags,
              (select count(*) from docs) as components_count
            from docs where list_contains(tags_lower, 'android') or name_lower = 'android'
            order by ts_ms desc, pos limit 1""",
            "docs",
        ),
        "format_patch": sql(
            f"""select pos, {ASKED_VERSION} as version, {FEED_VERSION} as feed_version,
              {patch_text(ASKED_VERSION)} as answer, {patch_text(FEED_VERSION)} as feed_answer
            from feed""",
            "feed",
        ),
        "format_os": sql(
            f"""select pos, coalesce(version_number, '') as main,
              string_split(coalesce(version_number, ''), '.')[-1] as last_value,
              {OS_TEXT} as answer, {clip(OS_TEXT, 80)} as preview from docs""",
            "docs",
        ),
        "answer_questions_by_type": sql(
            """select question_id, branch, status, reason, version, items_count, id as matched_id
            from answers_typed_final""",
            "answers_typed_final",
        ),
        "answer_questions": sql(f"select {ANSWER_ROW} from answers_final", "answers_final"),
        "answer_questions_strict": sql(
            """select question_id, branch, status, reason, version, id as matched_id
            from answers_strict_final""",
            "answers_strict_final",
        ),
        "answer_questions_first_page": sql(
            """select question_id, status, reason, items_count, id as matched_id
            from answers_page_final""",
            "answers_page_final",
        ),
        "answer_without_sources": sql(
            f"""select question_id, flow,
              case when branch = 'os' then 'error' else 'abstain' end as status,
              case when branch = 'patch_for' and not in_names then 'patch_vendor_not_in_names'
                when branch in ('patch_for', 'linux_text') then 'patch_api_error'
                when branch = 'os' then 'server_error'
                else 'unknown_intent_not_patch_or_os_version' end as reason,
              case when branch = 'os' then '' else '{DONT_KNOW}' end as answer,
              null::varchar as version,
              case branch when 'os' then null when 'unknown' then 'Unknown' else key end as vendor,
              case when branch in ('os', 'unknown') then 'unknown' else key end as logged_vendor
            from questions q join routed r on trim(q.question) = r.text""",
            "questions",
            "routed",
        ),
        "explain_questions": sql("select * from explained", "explained"),
        "explain_with_matches": sql(
            f"""select question_id, e.branch, product,
              case e.branch when 'os' then (select count(*) from docs)
                when 'patch_linux' then (select count(*) from linux_feed) end as items_count,
              case when e.branch = 'patch_linux'
                then (select arg_min(name, pos) from linux_feed) end as first_item_name,
              case when e.branch = 'patch_linux' then (select array_to_string(tags, '|')
                from linux_feed order by pos limit 1) end as first_item_tags,
              case when e.branch = 'patch_linux' and d.pos is not null
                then coalesce({vendor_hit("linux")}, false) end as matched_has_vendor,
              d.name as matched_name, d.release_date as matched_release_date,
              array_to_string(d.tags, '|') as matched_tags
            from explained e left join (select 'os' as branch, * from explain_os
                union all select 'patch_linux', * from explain_linux) f
              on f.branch = e.branch and f.date = coalesce(e.parsed_date, '')
              and f.key = case when e.branch = 'os' then e.product else 'linux' end
            left join docs d on d.pos = f.pos""",
            "explained",
            "explain_os",
            "explain_linux",
            "docs",
            "linux_feed",
        ),
        "clean_answer_text": sql(
            f"""select question_id, {CLEAN} as clean_answer,
              coalesce(nullif(version, ''), {CLEAN}) as shown_answer,
              coalesce(starts_with(shown_notes, 'http'), false) as notes_is_link
            from (select *, {answered.format("notes")} as shown_notes,
                {answered.format("case when branch <> 'os' then url end")} as shown_url
              from answers_final)""",
            "answers_final",
        ),
        "stream_answers_logged": sql(
            """select question_id as pos, status, flow, logged_vendor as vendor, reason,
              true as waited from answers_final""",
            "answers_final",
        ),
        "answers_to_events": sql(
            """select question_id as pos, epoch_us(asked_at) // 1000 as ts, status, flow,
              logged_vendor as vendor, user_id as latency_ms, reason, is_vendor_found
            from answers_final""",
            "answers_final",
        ),
        "summary_counts": sql(
            f"""select *, {percent("abstained", "total")} as abstain_rate,
              {percent("answered", "total")} as answer_rate
            from (select count(*) as total, count(*) filter (where status = 'answer') as answered,
              count(*) filter (where status = 'abstain') as abstained,
              count(*) filter (where status = 'error') as errors from month)""",
            "month",
        ),
        "summary_latency": sql(
            f"""select flow, quantile_disc(latency_ms, 0.5) as p50,
              quantile_disc(latency_ms, 0.95) as p95, {MEAN} as latency_mean
            from month group by flow""",
            "month",
        ),
        "top_vendors": sql(counted("vendor_label", "vendor", "month", 8), "month"),
        "top_reasons": sql(counted("reason_label", "reason", "month", 6), "month"),
        "daily_counts": sql(days_of("wide", 60), "wide"),
        "bar_scale": sql(
            f"""select vendor, count, greatest(max(count) over (), 1) as max_count,
              count / greatest(max(count) over (), 1) * 100.0::double as width
            from ({counted("vendor_label", "vendor", "month", 8)})""",
            "month",
        ),
        "kpi_breakdown": sql(
            """select *, queries_answered as responded_count, queries_abstain as abstain_count_kpi,
              os_version_query_count as os_query_count
            from (select count(*) filter (where status = 'answer') as queries_answered,
              count(*) filter (where status = 'abstain') as queries_abstain,
              count(*) filter (where is_vendor_found = 0) as vendor_not_found_count,
              count(*) filter (where flow = 'os') as os_version_query_count,
              count(*) filter (where flow = 'patch') as patch_query_count from month)""",
            "month",
        ),
        "recent_events": sql(
            """select pos, epoch_us(ts) // 1000 as ts, status, flow, vendor, latency_ms, reason,
              is_vendor_found from month order by month.ts desc, pos limit 12""",
            "month",
        ),
        "last_prompts": sql(
            """select question_id, epoch_us(asked_at) // 1000 as asked_at, trim(question) as prompt
            from questions where trim(question) <> ''
            order by questions.asked_at desc, question_id desc limit 3""",
            "questions",
        ),
        "last_chat_entries": sql(
            """select * from (select user_id, row_number() over (partition by user_id
                order by asked_at desc, question_id desc)::int as recency, question_id, question
              from questions) where recency <= 3""",
            "questions",
        ),
        "retain_last": sql("select pos, status, vendor from log order by pos desc limit 5000", "log"),
        "today_top_vendors": sql(
            TODAY.format(rows="select * from log order by ts desc, pos limit 12", as_of=AS_OF),
            "log",
        ),
        "day_top_vendors": sql(TODAY.format(rows="select * from log", as_of=AS_OF), "log"),
        "month_summary": sql(summary("month", 30, "all", "all", "null::varchar"), "month"),
        "filtered_summary": sql(summary("narrow", 7, "os", "abstain", "'vendor_1'"), "narrow"),
        "unwrap_envelopes": sql(LANDED.format(kinds="0, 1, 2, 3"), "releases"),
        "unwrap_patch_feed": sql(LANDED.format(kinds="0, 1, 2, 3, 6"), "releases"),
        "unwrap_vendor_names": """select (c_custkey // 32) * 4294967296
              + row_number() over (partition by c_custkey // 32 order by c_custkey) - 1 as pos,
              c_name as name from customer where (c_custkey // 32) % 4 < 3""",
        "decode_events": sql(
            """select pos - (select max(pos) from log) as pos, epoch_us(ts) // 1000 as ts, status, flow,
              vendor, latency_ms, reason, is_vendor_found from log where pos % 50 > 3""",
            "log",
        ),
        "event_log_by_day": sql(
            f"""select pos, epoch_us(ts) // 1000 as ts, status, latency_ms from log
            where ts::date between {AS_OF} - 6 and {AS_OF}""",
            "log",
        ),
        "stream_daily_rollup": sql(
            days("where ts::date + 1 <= (select max(ts) - interval 1 hour from log)"), "log"
        ),
        "stream_daily_live": sql(days(""), "log"),
        "stream_event_log": sql(
            "select pos, epoch_us(ts) // 1000 as ts, status, flow, vendor from log", "log"
        ),
        "stream_last_prompts": sql(
            """select question_id, epoch_us(asked_at) // 1000 as asked_at, trim(question) as prompt
            from questions where trim(question) <> ''
            order by questions.asked_at desc, question_id desc limit 3""",
            "questions",
        ),
        "stream_answers": sql(
            """select question_id, status, reason, version,
              case when status = 'answer' then name when flow = 'patch' then key
                else 'Unknown' end as vendor,
              id as matched_id, is_vendor_found from answers_final""",
            "answers_final",
        ),
    }
    # The same rows, found by other ways.
    return known | {
        "release_by_product_date_kept_up": known["release_by_product_date"],
        "answer_questions_kept_up": known["answer_questions"],
        "stream_answers_kept_up": known["stream_answers"],
        "month_summary_from_days": known["month_summary"],
        "filtered_summary_from_days": known["filtered_summary"],
        "stream_month_summary": known["month_summary"],
        "stream_event_log_once": known["stream_event_log"],
        "approximate_latency": sql(
            """select flow, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95
            from month group by flow""",
            "month",
        ),
        "month_latency_from_rollup": sql(
            """select percent, count(latency_ms) as n, true as within_bound
            from month, (select unnest([50, 95]) as percent) group by percent""",
            "month",
        ),
    }
