"""Session settings for runs outside a managed cluster (tests, bench, local trials)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataudit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, it is a folder in the warehouse, which executors share as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/strataudit-work"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the session removes it when it ends."""
    path = f"{shared_folder(spark).rstrip('/')}/strataudit-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def work_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, lost executors lose nothing."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
