"""Usage counters kept up to date by Structured Streaming.

State holds one row per record, per (record, reviewer), or per (record, day). Spark combines each
batch on the map side before it touches the state, so one busy record costs one row per task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from strataudit.functions.spread import first_per_key

_BASES = "folder string, upto bigint"


def read_requests(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                  files_per_batch: int | None = None) -> DataFrame:
    """A folder of request files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_updates(changes: DataFrame, table: str, checkpoint: str, trigger: dict | None = None,
                  finish: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write the changed rows of each batch under ``table``; ``finish`` may still join them to other tables.

    A batch owns one folder and overwrites it when it is run again, so a lost executor or a restart
    leaves neither gaps nor copies.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")

    return (changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start())


def _last_base(spark: SparkSession, table: str):
    """(folder, last batch) of the newest compaction, or None."""
    try:
        log = spark.read.schema(_BASES).parquet(f"{table}/bases-log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return log.orderBy(F.desc("upto"), "folder").first()


def compact(spark: SparkSession, table: str, keys: list[str]) -> None:
    """Bring the batches written so far into one table of the newest rows, so that readers open it and the later batches only.

    It counts once its row of the log is written; until then, and if it fails, the batches do.
    """
    upto = spark.read.parquet(f"{table}/batches").agg(F.max("batch")).first()[0]
    if upto is None:
        return
    folder = f"base-{uuid.uuid4().hex}"
    latest_rows(spark, table, keys, upto).write.parquet(f"{table}/{folder}")
    spark.createDataFrame([(folder, upto)], _BASES).coalesce(1).write.mode("append").parquet(f"{table}/bases-log")


def latest_rows(spark: SparkSession, table: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key among all written batches (or those up to ``upto``)."""
    rows, base = spark.read.parquet(f"{table}/batches"), _last_base(spark, table)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    if base:
        rows = rows.filter(F.col("batch") > base.upto).unionByName(
            spark.read.parquet(f"{table}/{base.folder}").withColumn("batch", F.lit(base.upto).cast(rows.schema["batch"].dataType)))
    return first_per_key(rows, keys, [F.desc("batch")]).drop("batch")
