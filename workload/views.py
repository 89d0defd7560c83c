"""Release, vendor, question and event tables derived from the generated tables.

The same derivation is written for DuckDB in ``oracle.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2024, 1, 30)  # the last day with events

PRODUCT = "case n_nationkey when 24 then 'Linux' when 23 then 'Android' else n_name end"
CHANNEL = "case o_orderstatus when 'P' then 'patch' when 'F' then 'production' else 'beta' end"
NUMBER = "concat(o_orderkey % 9, '.', o_orderkey % 7, '.', o_orderkey % 5)"
DATE_TEXT = "concat(month(ts), '-', 1 + event_id % 28, '-', 1995 + event_id % 7)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{PRODUCT} as product")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release per order, named after the customer's nation."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        products(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.selectExpr(
        "cast(o_orderkey as bigint) as pos",
        "concat('r', o_orderkey) as id",
        f"case when o_orderkey % 29 = 0 then null else {NUMBER} end as version_number",
        "c_mktsegment as brand",
        "product as name",
        f"{CHANNEL} as channel",
        """case when o_orderkey % 31 = 0 then ''
                when o_orderkey % 17 = 0 then concat(date_format(o_orderdate, 'yyyy'), '[29]',
                                                     date_format(o_orderdate, 'MMdd'))
                else date_format(o_orderdate, 'yyyyMMdd') end as release_date""",
        "unix_millis(cast(o_orderdate as timestamp)) as ts_ms",
        f"""case when o_orderkey % 23 = 0 then null
                 else array(lower(product), {CHANNEL}, date_format(o_orderdate, 'yyyyMMdd'),
                            {NUMBER}) end as tags""",
        "repeat(concat(o_orderpriority, ' '), cast(1 + o_orderkey % 40 as int)) as notes",
        "concat('https://example.com/r/', o_orderkey) as url",
        "case when o_orderkey % 3 = 0 then '' else 'Apache 2.0' end as license",
        "o_orderpriority = '1-URGENT' as is_cve",
    )


def vendor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products, and one vendor without a release."""
    listed = products(spark, sf_dir).selectExpr(
        "cast(n_nationkey as bigint) as pos", "product as name"
    )
    extra = listed.where("pos = 24").selectExpr("pos + 1", "'Ubuntu'")
    return listed.union(extra)


def questions_from(events: DataFrame) -> DataFrame:
    """One question per event, in ten wordings; works on streams too."""
    vendor = "concat('NATION_', user_id % 30)"
    return events.selectExpr(
        "cast(event_id as bigint) as question_id",
        "cast(ts as timestamp) as asked_at",
        "cast(user_id as bigint) as user_id",
        f"""case event_id % 10
              when 0 then concat('What is the patch for ', {vendor}, ' on ', {DATE_TEXT}, '?')
              when 1 then concat('Patch for ', {vendor})
              when 2 then concat('What is the version of ', {vendor}, ' on ', {DATE_TEXT})
              when 3 then concat('Latest ', {vendor}, ' release')
              when 4 then concat('Linux patch released on ', {DATE_TEXT})
              when 5 then 'hello there'
              when 6 then concat('Patch for Roblox on ', {DATE_TEXT})
              when 7 then concat('What license does Android use on ', {DATE_TEXT}, '?')
              when 8 then 'Get me the patch for Ubuntu.'
              else concat('patch for Linux on ', {DATE_TEXT}) end as question""",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions_from(table(spark, sf_dir, "events"))


def answer_events_from(events: DataFrame) -> DataFrame:
    """One logged answer per event, with gaps in latency, vendor and reason."""
    return events.selectExpr(
        "cast(event_id as bigint) as pos",
        "cast(ts as timestamp) as ts",
        """case when event_type = 'error' then 'error' when event_type = 'signup' then 'abstain'
                else 'answer' end as status""",
        "case event_id % 3 when 0 then 'patch' when 1 then 'os' else 'unknown' end as flow",
        "case when user_id % 11 = 0 then '  ' else concat('Vendor_', user_id % 12) end as vendor",
        "case when event_id % 13 = 0 then null else cast(floor(value) as bigint) end as latency_ms",
        """case when event_type = 'signup' then case event_id % 4
                     when 0 then 'patch_vendor_not_in_names' when 1 then 'os_no_match'
                     when 2 then 'no_results' else null end
                when event_type = 'error' then case when event_id % 2 = 0 then 'server_error' end
                else 'answered' end as reason""",
        "cast(case event_id % 5 when 0 then 0 when 1 then null else 1 end as int) as is_vendor_found",
    )


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_events_from(table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup requests: products, parts of names, a channel tag and unknown keys, with dates
    that need not exist on the calendar and none on every fourth event."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            """case user_id % 37 when 30 then 'linux' when 31 then 'android' when 32 then 'beta'
                 when 33 then 'n' when 34 then 'linux kernel' when 35 then 'ation'
                 when 36 then 'roblox' else concat('nation_', user_id % 37) end as key""",
            """case when event_id % 4 = 0 then ''
                 else concat(1991 + event_id % 9, lpad(1 + event_id % 14, 2, '0'),
                             lpad(1 + event_id % 31, 2, '0')) end as date""",
        )
        .distinct()
    )


# Documents that stand in for landed response bodies: 32 releases to a page, and seven kinds
# of wrapping, three of which hide the list from one reader or the other.
PAGE = 32
DOCUMENT = """to_json(array_sort(collect_list(struct(
    pos, id as _id, version_number as versionNumber, brand as versionProductBrand,
    name as versionProductName, channel as versionReleaseChannel,
    release_date as versionReleaseDate, ts_ms as versionTimestamp,
    tags as {tags}, is_cve as isCve))))"""


FREE_KEY = "concat('linux k', event_id % 997)"
FREE_DATE = """concat(1991 + event_id % 9, lpad(1 + event_id % 12, 2, '0'), lpad(1 + event_id % 28, 2, '0'))"""


def free_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of vendors as users write them: a known tag and something else."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr(f"{FREE_KEY} as key", f"{FREE_DATE} as date").distinct()


def landed_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = (
        releases(spark, sf_dir)
        .groupBy(F.expr(f"pos div {PAGE}").alias("page"))
        .agg(
            F.expr(DOCUMENT.format(tags="versionSearchTags")).alias("docs"),
            F.expr(DOCUMENT.format(tags="version_search_tags")).alias("other"),
        )
    )
    return pages.selectExpr(
        "page",
        """case page % 7
             when 0 then docs
             when 1 then concat(' {"components":', docs, '}')
             when 2 then concat('{"data":', other, '}')
             when 3 then concat('{"data":null,"components":', docs, '}')
             when 4 then '{"data":{"x":1}}'
             when 5 then concat('{"total":', page, '}')
             else concat('{"components":{"x":1},"data":', docs, '}') end as body""",
    )


def landed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as landed lists, in four wrappings."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.expr("cast(c_custkey div 32 as bigint)").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("listed"))
        .select("page", F.to_json(F.transform("listed", lambda c: c["c_name"])).alias("names"))
        .selectExpr(
            "page",
            """case page % 4 when 0 then names
                 when 1 then concat('{"names":', names, '}')
                 when 2 then concat('{"names":null,"data":', names, '}')
                 else 'not json' end as body""",
        )
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as stored lines, newest first, with damaged ones among them."""
    events = answer_events(spark, sf_dir)
    newest = events.agg(F.max("pos")).scalar()
    return events.withColumn("stored_index", newest - F.col("pos")).selectExpr(
        "stored_index",
        """case pos % 50 when 0 then '{oops' when 1 then 'null' when 2 then '[1]'
             when 3 then '"text"'
             else to_json(struct(unix_millis(ts) as ts, status, flow, vendor,
                    latency_ms as latencyMs, reason, is_vendor_found as isVendorFound))
           end as line""",
    )
