"""Data-quality report over the four tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from strataudit.functions.columns import is_empty, strip_spaces
from strataudit.functions.spread import distinct_keys, lacking
from strataudit.schemas import (
    APPLICATIONS, DATA_OBJECTS, DATA_STORES, FIELD_KEYS, OBJECT_FIELDS, OBJECT_KEYS, STORE_KEYS,
)

# The spellings of booleans that are expected.
_BOOLEAN_WORDS = ("", "true", "false", "1", "0", "yes", "no", "null", "none")


def _rows(df: DataFrame, table: str, check: str, keys: list[str]) -> DataFrame:
    """Offending keys with the number of their rows, combined on the map side."""
    key = F.concat_ws("/", *[F.coalesce(k, F.lit("")) for k in keys])
    counted = df.groupBy(*keys).agg(F.count("*").alias("row_count"))
    return counted.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), key.alias("key"), "row_count")


def missing_columns(df: DataFrame, table: str, schema: T.StructType) -> list[tuple[str, str, str, int]]:
    return [(table, "missing_column", c, 0) for c in schema.fieldNames() if c not in df.columns]


def integrity_report(apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows (table_name, check_name, key, row_count).

    Checks: null_key, duplicate_key, type_mismatch, missing_column, dangling_parent.
    """
    spark = apps.sparkSession
    tables = {
        "applications": (apps, APPLICATIONS, ["record_id", "snapshot_date", "snapshot_hour"], ["record_id"]),
        "data_stores": (stores, DATA_STORES, STORE_KEYS, STORE_KEYS),
        "data_objects": (objects, DATA_OBJECTS, OBJECT_KEYS, ["application_name", "object_id"]),
        "object_fields": (fields, OBJECT_FIELDS, FIELD_KEYS, FIELD_KEYS),
    }
    found = []
    gone = []
    for table, (df, schema, keys, required) in tables.items():
        no_key = reduce(lambda a, b: a | b, [is_empty(F.col(k)) for k in required])
        found.append(_rows(df.filter(no_key), table, "null_key", keys))
        found.append(_rows(df, table, "duplicate_key", keys).filter("row_count > 1"))
        gone += missing_columns(df, table, schema)

    flags = {"applications": ["processes_sensitive_data", "stores_sensitive_data"],
             "data_stores": ["has_sensitive_data"], "data_objects": ["has_sensitive_data"]}
    for table, columns in flags.items():
        df, _, keys, _ = tables[table]
        odd = reduce(lambda a, b: a | b, [
            ~F.coalesce(F.lower(strip_spaces(F.col(c))), F.lit("")).isin(*_BOOLEAN_WORDS) for c in columns])
        found.append(_rows(df.filter(odd), table, "type_mismatch", keys))
    odd_days = ~is_empty(F.col("retention_days")) & F.col("retention_days").try_cast("int").isNull()
    found.append(_rows(objects.filter(odd_days), "data_objects", "type_mismatch", OBJECT_KEYS))

    record = distinct_keys(apps, application_name="record_id")
    store = distinct_keys(stores, application_name="application_name", data_store_id="store_id")
    obj = distinct_keys(objects, application_name="application_name", object_id="object_id")
    held = objects.filter(~is_empty(F.col("data_store_id")))
    for table, orphans, keys in (
        ("data_stores", lacking(stores, record), STORE_KEYS),
        ("data_objects", lacking(held, store), OBJECT_KEYS),
        ("object_fields", lacking(fields, obj), FIELD_KEYS),
    ):
        found.append(_rows(orphans, table, "dangling_parent", keys))
    report = reduce(DataFrame.unionByName, found)
    if gone:
        names = "table_name string, check_name string, key string, row_count bigint"
        report = report.unionByName(spark.createDataFrame(gone, names))
    return report
