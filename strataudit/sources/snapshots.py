"""Versioned Parquet snapshots of whole tables: a load is written beside the old one and becomes current at the end."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strataudit.schemas import DOCUMENT

_LOG = "version int, written timestamp, folder string"


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LOG).parquet(f"{root}/_versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the current version, 0 before the first load."""
    log = _versions(spark, root)
    return (log.agg(F.max("version")).first()[0] or 0) if log is not None else 0


def write_version(df: DataFrame, root: str, now: dt.datetime) -> int:
    """Write ``df`` as the next version. Until the last step readers see the old version.

    Overflowing records go to a partition of their own.

    Each load has a folder of its own, which no later one touches, so the data may come from an older version. A load that fails
    leaves a folder that no log row names. Of two loads at once both are kept, and one of them, always the same, is current.
    """
    spark = df.sparkSession
    version = current_version(spark, root) + 1
    folder = f"version={version}-{uuid.uuid4().hex}"
    df.write.partitionBy("is_overflow").parquet(f"{root}/{folder}")
    spark.createDataFrame([(version, now, folder)], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/_versions")
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The current version; inline and overflow records come back as one table."""
    log = _versions(spark, root)
    last = log.agg(F.max_by("folder", F.struct("version", "written", "folder"))).first()[0] if log is not None else None
    if last is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    rows = spark.read.parquet(f"{root}/{last}")
    return rows.withColumn("is_overflow", F.col("is_overflow").cast("boolean"))


def read_json_documents(bodies: DataFrame) -> DataFrame:
    """``bodies`` (body, more) with ``doc`` and ``error`` for ``body``, the JSON text of one document.

    Text that is no such document keeps its row: its doc is null and the text stands in ``error``. A null body gives neither.
    """
    schema = T.StructType([*DOCUMENT.fields, T.StructField("_bad", T.StringType())])
    read = bodies.withColumn("_read", F.from_json("body", schema, {"columnNameOfCorruptRecord": "_bad"}))
    good = F.col("_read").isNotNull() & F.col("_read._bad").isNull()
    doc = F.struct(*[F.col(f"_read.{f.name}") for f in DOCUMENT.fields])
    return read.withColumns({"doc": F.when(good, doc), "error": F.when(~good, F.col("body"))}).drop("_read", "body")
