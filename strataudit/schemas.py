"""Column names, schemas and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Results depend on them.
ORPHAN_STORE = "__ORPHANED__"
OVERFLOW_BYTES = 400_000
OVERFLOW_PREFIX = "cache/"
OUTLIER_OBJECTS = 100_000
LARGE_STORE_OBJECTS = 500_000
TRUE_WORDS = ("true", "1", "yes")
NULL_WORDS = ("", "null", "NULL", "None")

#: Leaves (stores, objects and fields) that one document row may hold before its record is written
#: as several rows, see ``operators.nesting``.
PART_LEAVES = 50_000

#: Child rows above which a record is dealt more finely than by its id, and how many records, the largest, are.
LARGE_ROWS = 50_000
LARGE_RECORDS = 10_000

LOGIN_COLUMNS = ["owner_login", "supervisor_login"] + [
    f"reports_to_level_{level}_login" for level in range(1, 7)
]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


APPLICATIONS = _strings(
    "record_id", "snapshot_date", "snapshot_hour", "app_description", "ownership",
    "processes_sensitive_data", "stores_sensitive_data", *LOGIN_COLUMNS,
)
DATA_STORES = _strings("application_name", "store_id", "store_name", "technology", "has_sensitive_data")
DATA_OBJECTS = _strings(
    "application_name", "data_store_id", "object_id", "object_name", "has_sensitive_data",
    "retention_days", "technology",
)
OBJECT_FIELDS = _strings("application_name", "object_id", "field_name", "field_description", "field_type")

STORE_KEYS = ["application_name", "store_id"]
OBJECT_KEYS = ["application_name", "data_store_id", "object_id"]
FIELD_KEYS = ["application_name", "object_id", "field_name"]

FIELD = _strings("field_name", "field_description", "field_type")
OBJECT = T.StructType([
    T.StructField("object_name", T.StringType()),
    T.StructField("object_id", T.StringType()),
    T.StructField("has_sensitive_data", T.BooleanType()),
    T.StructField("retention_days", T.StringType()),
    T.StructField("fields", T.ArrayType(FIELD)),
])
STORE = T.StructType([
    T.StructField("store_name", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("technology", T.StringType()),
    T.StructField("has_sensitive_data", T.BooleanType()),
    T.StructField("data_objects", T.ArrayType(OBJECT)),
])
DOCUMENT = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("processes_sensitive_data", T.BooleanType()),
    T.StructField("stores_sensitive_data", T.BooleanType()),
    T.StructField("data_stores", T.ArrayType(STORE)),
])

REQUEST = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("x_source", T.StringType()),
    T.StructField("x_tool_version", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("is_partial", T.BooleanType()),
])
