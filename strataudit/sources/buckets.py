"""The stored documents in fixed buckets of record ids, with a manifest that names the versions of each bucket.

A load writes whole new versions of the buckets that it touches, and no others: first its own documents, then those that the buckets
keep. Its last step adds one file to the manifest, which
names its buckets and the versions that it has taken over (``covers``). A version counts until a later one covers it. Two loads at
once that touch the same bucket cover the same older version but not each other, so both count, and a reader takes each record from
the newest of them: nothing is lost, without locks. A load that fails is named nowhere.

Three tables lie side by side, all by version and bucket: ``docs`` has the documents, sorted by id, with Bloom filters of the ids;
``keys`` has one narrow row a record, without document; ``grams`` is the inverted index of the ids for substring search, sorted by
gram. One id lies in one bucket, so a lookup opens that bucket's files alone.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from strataudit.functions.spread import bucket_of, distinct_keys, having, lacking
from strataudit.operators.id_index import grams_of, records_with
from strataudit.schemas import DOCUMENT

BUCKETS = 32
#: Parts of one record that one writing task takes, so that a record of any size is written by many.
PARTS_TOGETHER = 8

_MANIFEST = "version string, bucket int, buckets int, loaded_at timestamp, covers array<string>"
_FIXED = [T.StructField("record_id", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n_parts", T.IntegerType()),
          T.StructField("reviewer_group", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("overflow_key", T.StringType()),
          T.StructField("last_updated", T.TimestampType()), T.StructField("load", T.StringType())]
_PLACE = [T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())]
_SCHEMAS = {
    "docs": T.StructType([*_FIXED, T.StructField("doc", DOCUMENT), *_PLACE, T.StructField("is_overflow", T.BooleanType())]),
    "keys": T.StructType([*_FIXED, T.StructField("is_overflow", T.BooleanType()), *_PLACE]),
    "grams": T.StructType([T.StructField("gram", T.StringType()), T.StructField("record_id", T.StringType()), *_PLACE]),
}
_ROW = [f.name for f in _FIXED if f.name != "load"] + ["doc", "is_overflow"]


def bucket(record_id: Column, buckets: int) -> Column:
    return bucket_of(F.lit(buckets), record_id)


@dataclass
class Prepared:
    """A load whose files are written and whose manifest rows are not."""

    version: str
    loaded_at: dt.datetime
    covers: dict[int, list[str]]


class Store:
    """The documents under ``root``. The number of buckets is fixed by the first load."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    # Versions

    def manifest(self) -> DataFrame:
        """All rows that loads have added."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def versions(self) -> dict[int, list[str]]:
        """The versions of each bucket that count; one, but for loads that ran at once."""
        rows = self.manifest()
        gone = rows.select("bucket", F.explode("covers").alias("version")).distinct()
        left = rows.join(gone, ["bucket", "version"], "left_anti").groupBy("bucket").agg(
            F.sort_array(F.collect_set("version")).alias("versions"), F.max("buckets").alias("buckets")).collect()
        if left:
            self._buckets = left[0].buckets
        return {r.bucket: list(r.versions) for r in left}

    def _read(self, table: str, versions: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{table}/version={v}/bucket={b}" for b, vs in sorted(versions.items()) for v in vs]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def _newest(self, table: str, versions: dict[int, list[str]]) -> DataFrame:
        """Rows of ``docs`` or ``keys``. Only buckets with several versions need to look which has a record's newest."""
        alone = {b: vs for b, vs in versions.items() if len(vs) == 1}
        several = {b: vs for b, vs in versions.items() if len(vs) > 1}
        rows = self._read(table, alone)
        if several:
            order = Window.partitionBy("bucket", "record_id").orderBy(F.desc("last_updated"), F.desc("load"), F.desc("version"))
            newest = self._read("keys", several).select("bucket", "record_id", "last_updated", "load", "version").withColumn(
                "_at", F.row_number().over(order)).filter("_at = 1").select("bucket", "record_id", "version")
            rows = rows.unionByName(self._read(table, several).join(newest, ["bucket", "record_id", "version"], "left_semi"))
        return rows

    # Loads

    def prepare(self, rows: DataFrame, now: dt.datetime) -> Prepared:
        """Write the new versions of all buckets that ``rows`` (cache rows of whole records) touch."""
        version = f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
        known = self.versions()
        # The new documents are written in place, once, and asked there for what they touch. What their buckets keep is added after.
        new = rows.select(*_ROW, F.lit(version).alias("load"), bucket(F.col("record_id"), self._buckets).alias("bucket"))
        self._write_docs(new, version)
        added = self.spark.read.schema(_SCHEMAS["docs"]).option("basePath", f"{self.root}/docs").parquet(f"{self.root}/docs/version={version}")
        touched = [r.bucket for r in added.select("bucket").distinct().collect()]
        covers = {b: known.get(b, []) for b in touched}
        if any(covers.values()):
            old = self._newest("docs", {b: vs for b, vs in covers.items() if vs})
            self._write_docs(lacking(old, distinct_keys(added, bucket="bucket", record_id="record_id")).drop("version"), version)
        written = self._read("docs", {b: [version] for b in touched})
        narrow = written.filter("part = 0").select(*_SCHEMAS["keys"].names).drop("version")
        self._write("keys", narrow.repartition("bucket"), version, ["bucket", "record_id"], "record_id")
        keys = self._read("keys", {b: [version] for b in touched})
        grams = grams_of(keys.select("bucket", "record_id"))
        self._write("grams", grams.repartition("bucket", F.substring("gram", 1, 1)), version, ["bucket", "gram"], "gram")
        return Prepared(version, now, covers)

    def _write_docs(self, rows: DataFrame, version: str) -> None:
        # Rebalanced, not dealt: a bucket grows with the table, and one task would have to sort it all. Spark splits it by its size.
        dealt = rows.withColumn("_slice", F.floor(F.col("part") / PARTS_TOGETHER)).hint("rebalance", "bucket", "_slice").drop("_slice")
        self._write("docs", dealt, version, ["bucket", "record_id", "part"], "record_id", "is_overflow")

    def _write(self, table: str, rows: DataFrame, version: str, order: list[str], sought: str, *more: str) -> None:
        ordered = rows.sortWithinPartitions(*order[:1], *more, *order[1:])
        ordered.write.mode("append").option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{sought}", "true").partitionBy("bucket", *more).parquet(
            f"{self.root}/{table}/version={version}")

    def commit(self, load: Prepared) -> None:
        """Make a prepared load count: one new file."""
        rows = [(load.version, b, self._buckets, load.loaded_at, covers) for b, covers in sorted(load.covers.items())]
        if rows:
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def load(self, rows: DataFrame, now: dt.datetime) -> str:
        """Insert or replace the records of ``rows``; records that it does not have stay. The version's name."""
        prepared = self.prepare(rows, now)
        self.commit(prepared)
        return prepared.version

    # Reading

    def documents(self) -> DataFrame:
        """All cache rows."""
        return self._newest("docs", self.versions()).select(*_ROW, "bucket")

    def keys(self) -> DataFrame:
        """One narrow row a record: all columns but the document."""
        return self._newest("keys", self.versions()).select(*[c for c in _ROW if c != "doc"], "bucket")

    def lookup(self, ids: DataFrame | list[str]) -> DataFrame:
        """Cache rows of the given records. A list opens only the buckets that its ids lie in."""
        versions = self.versions()
        if isinstance(ids, list):
            asked = self.spark.createDataFrame([(i,) for i in ids if i is not None], "record_id string")
            places = {r[0] for r in asked.select(bucket(F.col("record_id"), self._buckets)).collect()}
            return self._newest("docs", {b: vs for b, vs in versions.items() if b in places}).filter(F.col("record_id").isin(ids)).select(*_ROW)
        wanted = distinct_keys(ids, record_id=ids.columns[0])
        placed = wanted.withColumn("bucket", bucket(F.col("record_id"), self._buckets))
        return having(self._newest("docs", versions), placed.select("bucket", "record_id")).select(*_ROW)

    def search(self, term: str) -> DataFrame:
        """Cache rows whose record id contains the term, in any case. Ids are looked for in ``keys`` alone, documents are opened
        for those that were found."""
        found = self.keys().filter(F.contains(F.lower("record_id"), F.lit(term.strip().lower())))
        return self.lookup(found.select("record_id"))

    def grams(self) -> DataFrame:
        """The index (gram, record_id). Versions of loads that ran at once may both have a record."""
        rows, versions = self._read("grams", self.versions()), self.versions()
        found = rows.select("gram", "record_id")
        return found.distinct() if any(len(vs) > 1 for vs in versions.values()) else found

    def search_many(self, terms: DataFrame) -> DataFrame:
        """Rows (term, record_id): for each distinct term of the first column the records whose id contains it, in any case."""
        return records_with(terms, self.grams())
