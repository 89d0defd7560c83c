"""Column layouts. Every field is nullable: the landed JSON promises nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

CLASSIFICATION = T.StructType(
    [
        T.StructField("securityType", _TEXTS),
        T.StructField("breakingType", _TEXTS),
        T.StructField("componentType", _TEXTS),
    ]
)

# Curated column, type, and the field it comes from in a landed document.
RELEASE_FIELDS = [
    ("id", T.StringType(), "_id"),
    ("version_id", T.StringType(), "versionId"),
    ("version_number", T.StringType(), "versionNumber"),
    ("brand", T.StringType(), "versionProductBrand"),
    ("name", T.StringType(), "versionProductName"),
    ("product_type", T.StringType(), "versionProductType"),
    ("license", T.StringType(), "versionProductLicense"),
    ("channel", T.StringType(), "versionReleaseChannel"),
    ("notes", T.StringType(), "versionReleaseNotes"),
    ("release_date", T.StringType(), "versionReleaseDate"),
    ("ts_ms", T.LongType(), "versionTimestamp"),
    ("comments", T.StringType(), "versionReleaseComments"),
    ("verified", T.StringType(), "versionVerfied"),
    ("release_tags", _TEXTS, "versionReleaseTags"),
    ("tags", _TEXTS, "versionSearchTags"),
    ("last_update", T.StringType(), "versionTimestampLastUpdate"),
    ("predicted_type", T.StringType(), "versionPredictedComponentType"),
    ("status", T.StringType(), "versionStatus"),
    ("url", T.StringType(), "versionUrl"),
    ("is_cve", T.BooleanType(), "isCve"),
    ("classification", CLASSIFICATION, "classification"),
]

# Landed document: the fields above plus the second spelling of the search tags. The timestamp
# is read as text, since it comes as a number or as a text.
RAW_RELEASE = T.StructType(
    [
        T.StructField(raw, T.StringType() if name == "ts_ms" else kind)
        for name, kind, raw in RELEASE_FIELDS
    ]
    + [T.StructField("version_search_tags", _TEXTS)]
)

# One line of the event log. Values are read as text and cast one by one, so that an odd
# latency does not void the whole line.
EVENT_LINE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("ts", "status", "flow", "vendor", "latencyMs", "reason", "isVendorFound")
    ]
)

EVENT_COLUMNS = ["pos", "ts", "status", "flow", "vendor", "latency_ms", "reason", "is_vendor_found"]


def release_column(df: DataFrame, name: str) -> Column:
    """A curated release column, or a typed null where the table lacks it."""
    if name in df.columns:
        return F.col(name)
    kind = next(kind for column, kind, _ in RELEASE_FIELDS if column == name)
    return F.lit(None).cast(kind).alias(name)
