"""Applications, stores, objects and fields as flat rows.

De-duplication happens before the joins: the newest application row and one row per child key give the
rows that de-duplicating the joined product would give, without the product.

One record may have most of a child table. Objects and fields are dealt by record and object and joined there. AQE splits a left
join on its left side only, so the levels above are inner joins with the child on the left, plus the parents that the child lacks:
one way for records of all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataudit.functions.columns import is_empty
from strataudit.functions.spread import distinct_keys, first_per_key, lacking, unique_rows
from strataudit.operators.filters import by_owner, by_records, children_by_key, children_of
from strataudit.schemas import FIELD_KEYS, LARGE_RECORDS, ORPHAN_STORE, STORE_KEYS

CHILD_COLUMNS = [
    "data_store_name", "data_store_id", "store_technology", "store_has_sensitive_data",
    "data_object_name", "object_id", "object_has_sensitive_data", "retention_days",
    "field_name", "field_description", "field_type",
]


def latest_snapshot(apps: DataFrame) -> DataFrame:
    """The newest row of each record."""
    stamps = ["snapshot_date", "snapshot_hour"]
    rest = [F.col(c) for c in apps.columns if c not in ["record_id", *stamps]]
    return first_per_key(apps, ["record_id"], [F.desc(c) for c in stamps] + rest)


def by_object(children: DataFrame) -> DataFrame:
    """Objects or fields dealt by record and object: one large record is many tasks, and one shuffle serves the choice of a row per
    key and the join of the two."""
    return children.repartition("application_name", "object_id")


def unique_stores(stores: DataFrame) -> DataFrame:
    return unique_rows(stores, STORE_KEYS)


def unique_fields(fields: DataFrame) -> DataFrame:
    return unique_rows(by_object(fields), FIELD_KEYS)


def is_orphan() -> Column:
    return is_empty(F.col("data_store_id"))


def with_orphan_store(objects: DataFrame) -> DataFrame:
    """Objects, where those without a store belong to the synthetic orphan store."""
    named = objects.filter("application_name <> ''")
    return named.withColumn("data_store_id", F.when(is_orphan(), ORPHAN_STORE).otherwise(F.col("data_store_id")))


def unique_objects(objects: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per key, dealt and sorted so that the join with the fields of the object needs no other shuffle or sort.

    Of copies the first by ``columns`` counts; where none are named, by all of them.
    """
    keys = ["application_name", "object_id", "data_store_id"]
    if columns is None:
        return unique_rows(by_object(objects), keys)
    return first_per_key(by_object(objects), keys, [F.col(c) for c in columns if c not in keys])


def record_parts(stores: DataFrame, objects: DataFrame, fields: DataFrame, part_leaves: int) -> DataFrame:
    """Rows (record_id, n_parts, spread): how many parts of about ``part_leaves`` leaves each record with children has.

    ``spread`` is above 1 where an object alone is too large. Counts include copies; an object counts once per
    store that holds it, with its fields. All counts are combined on the map side.
    """
    on = ["application_name", "object_id"]
    name = F.col("application_name")
    nothing = F.lit(0).cast("long")
    copies = objects.groupBy(*on).agg(F.count("*").alias("n"))
    per_object = fields.groupBy(*on).agg(F.count("*").alias("fields"))
    leaves = copies.join(per_object, on, "left").select(name, "n", F.coalesce("fields", nothing).alias("widest"))
    counted = leaves.select(name, (F.col("n") * (F.col("widest") + 1)).alias("leaves"), "widest").union(
        stores.select(name, F.lit(1).cast("long"), nothing))
    parts_for = lambda n: F.greatest(F.ceil(n / F.lit(part_leaves)), F.lit(1)).cast("int")
    return counted.groupBy(name.alias("record_id")).agg(
        parts_for(F.sum("leaves")).alias("n_parts"), parts_for(F.max("widest")).alias("spread"))


def large_records(stores: DataFrame, objects: DataFrame, fields: DataFrame, rows: int) -> DataFrame:
    """The records (``large_id``) with more than ``rows`` child rows, the ``LARGE_RECORDS`` largest of them, so that the table can be
    sent to every task. A record that is not in it has at most ``rows`` child rows, or the ``LARGE_RECORDS``-th part of all."""
    name = F.col("application_name").alias("large_id")
    children = stores.select(name, F.col("store_id").alias("key"))
    for table in (objects, fields):
        children = children.union(table.select(name, "object_id"))
    counted = children.groupBy("large_id").agg(F.count("key").alias("n")).filter(F.col("n") > rows)
    return counted.orderBy(F.desc("n"), "large_id").limit(LARGE_RECORDS).select("large_id")


def _stores_by_record(stores: DataFrame) -> DataFrame:
    return unique_stores(stores).select(
        F.col("application_name").alias("record_id"), F.col("store_name").alias("data_store_name"),
        F.col("store_id").alias("data_store_id"), F.col("technology").alias("store_technology"),
        F.col("has_sensitive_data").alias("store_has_sensitive_data"))


def _objects_by_record(objects: DataFrame) -> DataFrame:
    return unique_objects(objects).select(
        F.col("application_name").alias("record_id"), "data_store_id", "object_id",
        F.col("object_name").alias("data_object_name"),
        F.col("has_sensitive_data").alias("object_has_sensitive_data"), "retention_days",
        F.col("technology").alias("_technology"))


def _fields_by_record(fields: DataFrame) -> DataFrame:
    return unique_fields(fields).withColumnRenamed("application_name", "record_id")


def _in_orphan_store() -> Column:
    return F.col("data_store_id") == ORPHAN_STORE


def flat_join(
    apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame, orphans: bool = True,
) -> DataFrame:
    """One row per application, store, object and field, newest snapshot only.

    With ``orphans`` the objects that have no store follow under the synthetic store. Without it the
    result is the plain left join of the four tables, which loses them.
    """
    app = latest_snapshot(apps)
    if orphans:
        objects = with_orphan_store(objects)
        stores = stores.filter(~F.coalesce(F.col("store_id") == ORPHAN_STORE, F.lit(False)))
    # Objects meet their fields where both are dealt, so each child row moves once; applications and stores come last.
    held = _objects_by_record(objects).join(_fields_by_record(fields), ["record_id", "object_id"], "left")
    object_keys = distinct_keys(objects, record_id="application_name", data_store_id="data_store_id")
    app_store = _stores_by_record(stores).join(app, "record_id")
    parents = distinct_keys(stores, record_id="application_name")
    holders, technology = app_store, F.col("store_technology")
    if orphans:
        lost = object_keys.filter(_in_orphan_store())
        holders = app_store.unionByName(lost.join(app, "record_id").withColumn("data_store_name", F.lit(ORPHAN_STORE)), allowMissingColumns=True)
        parents = parents.union(lost.select("record_id")).distinct()
        technology = F.when(_in_orphan_store(), F.col("_technology")).otherwise(technology)
    rows = held.join(holders, ["record_id", "data_store_id"]).withColumn("store_technology", technology).drop("_technology")
    for level in (lacking(app_store, object_keys), lacking(app, parents)):
        rows = rows.unionByName(level, allowMissingColumns=True)
    return rows.select(*app.columns, *CHILD_COLUMNS)


def extract(
    apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame,
    ids: DataFrame | list[str] | None = None, logins: DataFrame | list[str] | None = None,
    orphans: bool = True,
) -> DataFrame:
    """Flat rows of the chosen applications. The choice reaches every child table before the joins."""
    if ids is not None:
        apps = by_records(apps, ids)
    if logins is not None:
        apps = by_owner(apps, logins)
    if ids is not None or logins is not None:
        stores, objects, fields = children_by_key(stores, apps), children_of(objects, apps), children_of(fields, apps)
    return flat_join(apps, stores, objects, fields, orphans)


def bare_records(apps: DataFrame, stores: DataFrame, objects: DataFrame) -> DataFrame:
    """Newest rows of the records that have neither stores nor orphan objects."""
    lost = objects.filter(is_orphan())
    parents = distinct_keys(stores, record_id="application_name").union(
        distinct_keys(lost, record_id="application_name")).distinct()
    return lacking(latest_snapshot(apps), parents)


def row_counts(flat: DataFrame) -> DataFrame:
    """Flat rows per record, and how many of them reach an object and a field."""
    return flat.groupBy("record_id").agg(
        F.count("*").alias("flat_rows"), F.count("object_id").alias("object_rows"),
        F.count("field_name").alias("field_rows"))
