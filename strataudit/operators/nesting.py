"""Record documents: stores, objects and fields nested under their application.

Every record is ``n_parts`` rows, ``part`` 0 to n-1, each a document of the same shape with about ``part_leaves`` of the
leaves; a record of fewer leaves has one part. Objects stay in one piece unless the record holds an object that is
itself too large. Together the parts hold the whole record, so no record, however large, has to fit in one task.

All is inside the plan, so no job runs before the result is asked for. Rows of most records move once: they are dealt by record, and
copies, fields of an object, sizes and parts are all found there. Records with very many rows (``large_records``, counted first, a
bounded table that every task gets) are dealt more finely. Their number of parts is a grouped count. Objects are joined to their stores
to learn how many parts their record has. Fields are put into arrays beside their object, where both are dealt by record and object,
brought to (record, part) in one shuffle and grouped there; every group is bounded because every part is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strataudit.functions.columns import to_bool
from strataudit.functions.spread import bucket_of
from strataudit.functions.struct_text import owner
from strataudit.operators.hierarchy import (
    large_records, latest_snapshot, record_parts, unique_fields, unique_objects, unique_stores, with_orphan_store,
)
from strataudit.schemas import DOCUMENT, FIELD_KEYS, LARGE_ROWS, OBJECT_KEYS, ORPHAN_STORE, PART_LEAVES, STORE_KEYS

_PART = ["record_id", "part"]


def _headers(apps: DataFrame) -> DataFrame:
    group = F.col("app_legal_reviewer_group") if "app_legal_reviewer_group" in apps.columns else F.lit("")
    head = F.struct(
        F.col("app_description").alias("description"), owner("ownership").alias("owner"),
        to_bool(F.col("processes_sensitive_data")).alias("processes_sensitive_data"),
        to_bool(F.col("stores_sensitive_data")).alias("stores_sensitive_data"),
        group.alias("reviewer_group"),
    )
    return latest_snapshot(apps.filter("record_id <> ''")).select("record_id", head.alias("head"))


def _store_struct(id_: Column, name: Column, technology: Column, flag: Column) -> Column:
    return F.struct(name.alias("store_name"), id_.alias("store_id"), technology.alias("technology"),
                    flag.alias("has_sensitive_data"))


def _store_rows(stores: DataFrame, objects: DataFrame) -> DataFrame:
    """Store headers. The orphan store takes the technology of its first object."""
    real = unique_stores(stores).filter(F.col("store_id") != ORPHAN_STORE).select(
        F.col("application_name").alias("record_id"), "store_id",
        _store_struct(F.col("store_id"), F.col("store_name"), F.col("technology"),
                      to_bool(F.col("has_sensitive_data"))).alias("store"))
    first = F.struct("object_id", "object_name", "has_sensitive_data", "retention_days", "technology")
    lost = objects.filter(F.col("data_store_id") == ORPHAN_STORE).groupBy("application_name").agg(F.min(first).alias("o"))
    return real.unionByName(lost.select(
        F.col("application_name").alias("record_id"), F.lit(ORPHAN_STORE).alias("store_id"),
        _store_struct(F.lit(ORPHAN_STORE), F.lit(ORPHAN_STORE), F.col("o.technology"), F.lit(False)).alias("store")))


def _in_order(key: Column, value: Column) -> Column:
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v"))))
    return F.sort_array(pairs)["v"]


def _document() -> Column:
    return F.struct("record_id", "head.description", "head.owner", "head.processes_sensitive_data",
                    "head.stores_sensitive_data", "data_stores").cast(DOCUMENT)


def _large_documents(apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame, part_leaves: int) -> DataFrame:
    """Documents of records of any size."""
    sizes = record_parts(stores, objects, fields, part_leaves)
    head = apps.join(sizes, "record_id", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    # Spread by the full key: the join below would else keep a record's objects in the one task of its size.
    store = _store_rows(stores, objects).join(sizes, "record_id").repartition("record_id", "store_id")

    # Fields of an object as arrays of at most ``part_leaves``; all but very wide objects have one.
    names = ["record_id", "object_id"]
    place = Window.partitionBy(*names).orderBy("field_name")
    pieces = unique_fields(fields).withColumnRenamed("application_name", "record_id").withColumn(
        "piece", F.floor((F.row_number().over(place) - 1) / F.lit(part_leaves)).cast("int")).groupBy(*names, "piece").agg(
        F.sort_array(F.collect_list(F.struct("field_name", "field_description", "field_type"))).alias("fields"))

    # Objects meet their store before their fields, so that fields move only to the object and to the part. Where a record has several
    # parts, each needs the store's header. Ids are never null here; a null-safe condition keeps Spark from putting what it knows of the
    # stores' ids below the objects, where their shuffle would then differ from that of the other records.
    of_store = store.select(F.col("record_id").alias("_record_id"), F.col("store_id").alias("_store_id"), "n_parts",
                            F.when(F.col("n_parts") > 1, F.col("store")).alias("store"))
    in_store = (F.col("application_name") == F.col("_record_id")) & F.col("data_store_id").eqNullSafe(F.col("_store_id"))
    placed = unique_objects(objects.join(of_store, in_store).select(*objects.columns, "store", "n_parts"), objects.columns).select(
        F.col("application_name").alias("record_id"), F.col("data_store_id").alias("store_id"), "object_id",
        "object_name", to_bool(F.col("has_sensitive_data")).alias("has_sensitive_data"), "retention_days", "store", "n_parts",
    ).join(pieces, names, "left")
    object_ = F.struct("object_name", "object_id", "has_sensitive_data", "retention_days",
                       F.coalesce("fields", F.array().cast(pieces.schema["fields"].dataType)).alias("fields"))
    home = bucket_of(F.col("n_parts"), F.col("store_id"), F.col("object_id"))
    rows = placed.select("record_id", "store_id", "store", object_.alias("object"),
                         F.pmod(home + F.coalesce("piece", F.lit(0)), F.col("n_parts")).alias("part"))
    for level in (
        store.select("record_id", "store_id", "store", bucket_of(F.col("n_parts"), F.col("store_id")).alias("part")),
        head.select("record_id", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"),
                    F.struct("head.*", "n_parts").alias("head")),
    ):
        rows = rows.unionByName(level, allowMissingColumns=True)
    return _grouped(_by_store(rows.repartition(*_PART)))


def _rest(rows: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in keys]


def _first_of_each(sorted_items: str, key: str) -> Column:
    """The first item of each key in a sorted array of structs."""
    items = F.col(sorted_items)
    return F.filter(items, lambda x, i: ~x[key].eqNullSafe(F.get(items, i - 1)[key]))


def _documents_by_record(apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame, part_leaves: int) -> DataFrame:
    """Documents of records whose rows one task can hold: all rows are dealt by record and move once."""
    rows = apps.select("record_id", "head")
    name = F.col("application_name").alias("record_id")
    for level in (
        stores.select(name, F.struct("store_id", *_rest(stores, STORE_KEYS)).alias("store")),
        objects.select(name, "object_id", F.struct(F.col("data_store_id").alias("store_id"), *_rest(objects, OBJECT_KEYS)).alias("object")),
        fields.select(name, "object_id", F.struct("field_name", *_rest(fields, FIELD_KEYS)).alias("field")),
    ):
        rows = rows.unionByName(level, allowMissingColumns=True)
    # A row for each object with its copies and fields, and one without object_id that has the header and the stores.
    listed = lambda c: F.sort_array(F.collect_list(c)).alias(f"{c}s")
    # Told how many, Spark merges no tasks: each sorts and gathers what it reads.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = rows.repartition(tasks, "record_id").groupBy("record_id", "object_id").agg(
        F.max("head").alias("head"), listed("store"), listed("object"), listed("field"))

    # Sizes count copies, as in ``record_parts``.
    record = Window.partitionBy("record_id")
    size = lambda c: F.size(c).cast("long")
    lost = F.array_min(F.transform(F.filter("objects", lambda o: o["store_id"] == ORPHAN_STORE), lambda o: F.struct(
        F.col("object_id"), o["object_name"], o["has_sensitive_data"], o["retention_days"], o["technology"].alias("technology"))))
    first = gathered.select(
        "record_id", "object_id", "head", (size("objects") * (size("fields") + 1) + size("stores")).alias("leaves"), lost.alias("lost"),
        _first_of_each("stores", "store_id").alias("stores"), _first_of_each("objects", "store_id").alias("objects"),
        F.transform(_first_of_each("fields", "field_name"), lambda f: F.struct(
            *[f[c].alias(c) for c in ("field_name", "field_description", "field_type")])).alias("fields"))
    n_pieces = F.greatest(F.ceil(F.size("fields") / F.lit(part_leaves)), F.lit(1)).cast("int")
    counted = first.withColumns({
        "n_parts": F.greatest(F.ceil(F.sum("leaves").over(record) / F.lit(part_leaves)), F.lit(1)).cast("int"),
        "lost": F.when(F.col("object_id").isNull(), F.min("lost").over(record)),
        "pieces": F.when(n_pieces == 1, F.array("fields")).otherwise(F.transform(
            F.sequence(F.lit(0), n_pieces - 1), lambda i: F.slice("fields", i * part_leaves + 1, part_leaves)))})

    def item(store_id: Column, store: Column, object_: Column, part: Column) -> Column:
        return F.struct(store_id.alias("store_id"), store.alias("store"), object_.alias("object"), part.cast("int").alias("part"))

    n_parts, none = F.col("n_parts"), F.lit(None)
    home = lambda o: bucket_of(n_parts, o["store_id"], F.col("object_id"))
    in_stores = F.flatten(F.transform("objects", lambda o: F.transform("pieces", lambda p, i: item(
        o["store_id"], none, F.struct(
            o["object_name"].alias("object_name"), F.col("object_id"), to_bool(o["has_sensitive_data"]).alias("has_sensitive_data"),
            o["retention_days"].alias("retention_days"), p.alias("fields")), F.pmod(home(o) + i, n_parts)))))
    headers = F.transform(F.filter("stores", lambda s: s["store_id"] != ORPHAN_STORE), lambda s: item(
        s["store_id"], _store_struct(s["store_id"], s["store_name"], s["technology"], to_bool(s["has_sensitive_data"])), none,
        bucket_of(n_parts, s["store_id"])))
    orphan = F.lit(ORPHAN_STORE)
    of_lost = F.when(F.col("lost").isNotNull(), F.array(item(
        orphan, _store_struct(orphan, orphan, F.col("lost.technology"), F.lit(False)), none, bucket_of(n_parts, orphan))))
    heads = F.when(F.col("head").isNotNull(), F.transform(
        F.sequence(F.lit(0), n_parts - 1), lambda k: item(none, none, none, k)))
    nothing = F.array().cast(T.ArrayType(counted.select(in_stores.alias("i")).schema["i"].dataType.elementType))
    placed = counted.select("record_id", F.when(F.col("head").isNotNull(), F.struct("head.*", "n_parts")).alias("head"), F.explode(
        F.concat(in_stores, headers, F.coalesce(of_lost, nothing), F.coalesce(heads, nothing))).alias("item"))
    by_store = _by_store(placed.select("record_id", "item.*", F.when(F.col("item.store_id").isNull(), F.col("head")).alias("head")))
    # Each part of a record has the headers of its stores.
    return _grouped(by_store.withColumn("store", F.max("store").over(Window.partitionBy("record_id", "store_id"))))


def _by_store(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_PART, "store_id").agg(
        F.max("head").alias("head"), F.max("store").alias("store"),
        _in_order(F.col("object.object_id"), F.col("object")).alias("data_objects"))


def _grouped(by_store: DataFrame) -> DataFrame:
    """Documents, from stores with their objects and from headers."""
    whole_store = F.when(F.col("store").isNotNull(), F.struct(
        "store.store_name", "store.store_id", "store.technology", "store.has_sensitive_data", "data_objects"))
    store_order = F.struct((F.col("store_id") == ORPHAN_STORE).alias("last"), F.col("store_id"))
    by_record = by_store.groupBy(*_PART).agg(
        F.max("head").alias("head"), _in_order(store_order, whole_store).alias("data_stores"))
    return by_record.filter("head IS NOT NULL").select(
        "record_id", "part", "head.n_parts", _document().alias("doc"), "head.reviewer_group")


def nest(
    apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame,
    part_leaves: int = PART_LEAVES, large_rows: int = LARGE_ROWS,
) -> DataFrame:
    """Rows (record_id, part, n_parts, doc, reviewer_group). Records of more than ``large_rows`` children are dealt more finely."""
    named = "application_name IS NOT NULL AND application_name <> ''"
    stores = stores.filter(f"{named} AND store_id <> ''")
    # Both ways ask for what their joins imply, so that Spark finds equal shuffles below them and makes each once.
    objects = with_orphan_store(objects.filter("object_id <> ''")).filter(f"{named} AND data_store_id <> ''")
    fields = fields.filter(f"{named} AND field_name <> '' AND object_id <> ''")
    large = F.broadcast(large_records(stores, objects, fields, large_rows))  # of bounded size
    tables = [t.join(large, F.col(key) == F.col("large_id"), "left") for t, key in (
        (_headers(apps), "record_id"), (stores, "application_name"), (objects, "application_name"), (fields, "application_name"))]
    chosen = lambda which: [t.filter(f"large_id IS {which}").drop("large_id") for t in tables]
    return _large_documents(*chosen("NOT NULL"), part_leaves).unionByName(_documents_by_record(*chosen("NULL"), part_leaves))


def flat_from_documents(docs: DataFrame) -> DataFrame:
    """Documents back to one row per store, object and field (parts need not be merged first)."""
    store = docs.select("record_id", F.explode_outer("doc.data_stores").alias("s"))
    obj = store.select("record_id", "s.store_id", F.explode_outer("s.data_objects").alias("o"))
    return obj.select("record_id", "store_id", "o.object_id", F.explode_outer("o.fields").alias("f")).select(
        "record_id", "store_id", "object_id", "f.*")
