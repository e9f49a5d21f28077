"""The snapshot of record documents: sizes, overflow split, upsert, lookups and statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from strataudit.functions.json_text import separators, sql_json_bytes
from strataudit.functions.spread import distinct_keys, having, lacking
from strataudit.operators.id_index import grams_of, records_with
from strataudit.schemas import DOCUMENT, FIELD, OBJECT, OVERFLOW_BYTES, OVERFLOW_PREFIX, STORE


def _gaps(n: str) -> str:
    """Blanks after the commas of an array of n items."""
    return f"greatest({n} - 1, 0)"


def _doc_bytes(doc: str) -> Column:
    """Length of the document as ``json.dumps`` text, from its compact text and its shape."""
    fields, objects, stores = "size(o.fields)", "size(s.data_objects)", f"size({doc}.data_stores)"
    in_object = f"{separators(len(OBJECT))} + {separators(len(FIELD))} * {fields} + {_gaps(fields)}"
    in_store = f"aggregate(s.data_objects, {separators(len(STORE))} + {_gaps(objects)}, (n, o) -> n + {in_object})"
    shape = f"aggregate({doc}.data_stores, {separators(len(DOCUMENT))} + {_gaps(stores)}, (m, s) -> m + {in_store})"
    return F.expr(f"{sql_json_bytes(doc)} + {shape}")


def record_bytes(docs: DataFrame) -> DataFrame:
    """Rows (record_id, bytes): the size of each whole record as ``json.dumps`` writes it.

    A record in one part is measured in its row. Of one in several parts, sizes of headers, objects and fields are summed as if the
    parts were one document: headers that several parts repeat count once. Both go through the same grouped sums over small rows,
    so the documents are read once.
    """
    def header(value: str, names: list[str], member: str) -> Column:
        # A header lacks its array member: the full text has ', "<member>": []' more.
        own = ", ".join(f"'{n}', {value}.{n}" for n in names)
        more = separators(len(names)) + len(f', "{member}": []')
        return F.expr(f"if({value} IS NULL, NULL, {sql_json_bytes(f'named_struct({own})')} + {more})")

    app = ["record_id", "description", "owner", "processes_sensitive_data", "stores_sensitive_data"]
    store = ["store_name", "store_id", "technology", "has_sensitive_data"]
    obj = ["object_name", "object_id", "has_sensitive_data", "retention_days"]
    in_parts = F.col("n_parts") > 1
    stores = docs.select("record_id", F.when(~in_parts, _doc_bytes("doc")).alias("whole"),
                         F.when(in_parts, header("doc", app, "data_stores")).alias("app_bytes"),
                         F.explode_outer(F.when(in_parts, F.col("doc.data_stores"))).alias("s"))
    objects = stores.select(
        "record_id", "whole", "app_bytes", "s.store_id",
        header("s", store, "data_objects").alias("store_bytes"),
        F.explode_outer("s.data_objects").alias("o"))
    field_bytes = F.expr(
        f"aggregate(o.fields, 0L, (n, f) -> n + {sql_json_bytes('f')} + {separators(len(FIELD))})")
    measured = objects.select(
        "record_id", "whole", "store_id", "o.object_id", "app_bytes", "store_bytes",
        header("o", obj, "fields").alias("object_bytes"),
        F.coalesce(F.size("o.fields"), F.lit(0)).alias("n"), F.coalesce(field_bytes, F.lit(0)).alias("field_bytes"))

    # Items of an array are set apart by ', ': two bytes less one pair per array that is not empty.
    apart = lambda n: 2 * F.greatest(n - 1, F.lit(0))
    heads = [F.max("whole").alias("whole"), F.max("app_bytes").alias("app_bytes")]
    per_object = measured.groupBy("record_id", "store_id", "object_id").agg(
        *heads, F.max("store_bytes").alias("store_bytes"),
        (F.coalesce(F.max("object_bytes"), F.lit(0)) + F.sum("field_bytes")
         + apart(F.sum(F.greatest("n", F.lit(0))))).alias("b"))
    per_store = per_object.groupBy("record_id", "store_id").agg(
        *heads, (F.coalesce(F.max("store_bytes"), F.lit(0)) + F.sum("b") + apart(F.count("object_id"))).alias("b"))
    return per_store.groupBy("record_id").agg(F.coalesce(
        F.max("whole"), F.max("app_bytes") + F.sum("b") + apart(F.count("store_id"))).alias("bytes"))


def with_size(docs: DataFrame) -> DataFrame:
    """Documents with ``bytes``, the size of their whole record. Rows of a record in one part are measured where they lie and are not
    moved. The others are read twice, so ``docs`` should be a written table."""
    named = docs.filter("record_id IS NOT NULL")
    alone, in_parts = named.filter("n_parts = 1"), named.filter("n_parts > 1")
    measured = in_parts.join(record_bytes(in_parts), "record_id")
    return alone.withColumn("bytes", _doc_bytes("doc")).unionByName(measured)


def split_overflow(sized: DataFrame, now: dt.datetime, limit: int = OVERFLOW_BYTES) -> DataFrame:
    """Cache rows: records strictly above the limit overflow and get an object key."""
    over = F.col("bytes") > limit
    return sized.withColumns({
        "is_overflow": over,
        "overflow_key": F.when(over, F.concat(F.lit(OVERFLOW_PREFIX), "record_id", F.lit(".json"))),
        "last_updated": F.lit(now),
    })


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows and the old rows of all records that the new load does not have."""
    return new.unionByName(lacking(old, distinct_keys(new, record_id="record_id")))


def size_report(sized: DataFrame, limit: int = OVERFLOW_BYTES) -> DataFrame:
    """What a load would write: bytes per record (``record_bytes``), and which records overflow, in order."""
    return sized.select(
        "record_id", "bytes", (F.col("bytes") > limit).alias("is_overflow")).orderBy("record_id")


def lookup(cache: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Cache rows of the given records, wherever their documents are kept."""
    if isinstance(ids, list):
        return cache.filter(F.col("record_id").isin(ids))
    return having(cache, distinct_keys(ids, record_id=ids.columns[0]))


def search(cache: DataFrame, term: str) -> DataFrame:
    """Cache rows whose record id contains the term, in any case; ``%`` and ``_`` mean themselves."""
    return cache.filter(F.contains(F.lower("record_id"), F.lit(term.strip().lower())))


def terms_found(terms: DataFrame, cache: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """The distinct search terms that some record id contains, in ``piece``; ``grams`` is the index of the ids if there is one."""
    index = grams_of(cache.select("record_id").distinct()) if grams is None else grams
    return records_with(terms, index).select(F.col("term").alias("piece")).distinct()


def statistics(kind: str, cache: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """The statistics a client can ask for, by name."""
    from strataudit.operators.usage import reviewer_groups

    records = cache.filter("part = 0")
    if kind == "count":
        return records.agg(F.count("*").alias("count"))
    if kind == "list":
        return records.select("record_id").orderBy("record_id")
    if kind == "cache-stats":
        return records.agg(
            F.count("*").alias("total_cached"), F.count_if("is_overflow").alias("overflow_items"),
            F.count_if(~F.col("is_overflow")).alias("inline_items"))
    if kind == "usage" and usage is not None:
        return usage.withColumn("legal_reviewer_group", F.coalesce("legal_reviewer_group", F.lit("")))
    if kind == "reviewer-groups" and usage is not None:
        return reviewer_groups(usage)
    raise ValueError(f"no such statistic, or its input is missing: {kind}")
