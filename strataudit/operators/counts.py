"""Object counts, skew reports and the summary of an extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataudit.schemas import LARGE_STORE_OBJECTS, ORPHAN_STORE, OUTLIER_OBJECTS


def object_counts(objects: DataFrame) -> DataFrame:
    """Objects per record name. Those that name no record are counted too, under the blank or null that they carry."""
    return objects.groupBy("application_name").agg(F.count("*").alias("object_count"))


def outlier_records(objects: DataFrame, limit: int = OUTLIER_OBJECTS) -> DataFrame:
    """Records with more objects than ``limit``."""
    return object_counts(objects).filter(F.col("object_count") > limit)


def large_stores(objects: DataFrame, limit: int = LARGE_STORE_OBJECTS) -> DataFrame:
    """Stores with more objects than ``limit``."""
    placed = objects.filter("data_store_id <> ''")
    counts = placed.groupBy("application_name", "data_store_id").agg(F.count("*").alias("object_count"))
    return counts.filter(F.col("object_count") > limit)


def extraction_summary(flat: DataFrame, objects: DataFrame) -> DataFrame:
    """One row of totals: flat rows, records, stores, objects, orphans, fields, join success rate.

    The rate is the share of the object keys in the source that reached a record. Distinct counts come
    from grouping level by level, each of which combines on the map side, not from an expansion of
    every row per count.
    """
    orphan = F.col("data_store_id") == ORPHAN_STORE
    per_object = flat.groupBy("record_id", "data_store_id", "object_id").agg(
        F.count("*").alias("rows"), F.count("field_name").alias("fields"))
    per_store = per_object.groupBy("record_id", "data_store_id").agg(
        F.sum("rows").alias("rows"), F.sum("fields").alias("fields"),
        F.count("object_id").alias("objects"),
        F.count_if(orphan & F.col("object_id").isNotNull()).alias("orphans"))
    per_record = per_store.groupBy("record_id").agg(
        F.sum("rows").alias("rows"), F.sum("fields").alias("fields"), F.sum("objects").alias("objects"),
        F.sum("orphans").alias("orphans"), F.count_if(F.col("data_store_id") != ORPHAN_STORE).alias("stores"))
    reached = per_record.agg(
        F.sum("rows").alias("flat_rows"), F.count("record_id").alias("records"), F.sum("stores").alias("stores"),
        F.sum("objects").alias("objects"), F.sum("orphans").alias("orphans"), F.sum("fields").alias("fields"),
        F.lit(None).cast("long").alias("source_objects"))
    keys = objects.filter("application_name <> '' AND object_id IS NOT NULL").select(
        "application_name", F.coalesce("data_store_id", F.lit("")), "object_id").distinct()
    source = keys.agg(F.count("*").alias("source_objects"))
    # Two one-row tables side by side, by a union and a sum.
    both = reached.unionByName(source, allowMissingColumns=True)
    names = ["flat_rows", "records", "stores", "objects", "orphans", "fields"]
    totals = both.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*names, "source_objects"]])
    rate = F.when(F.col("source_objects") > 0, F.col("objects") / F.col("source_objects"))
    return totals.select(*names, F.round(rate, 6).alias("join_success_rate"))
