"""Can the asked data sets be read?"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: the form of a data set name.
_NAME = r"\A[a-zA-Z][a-zA-Z0-9_.]+\n?\z"


def _probe(spark: SparkSession, location: str) -> str | None:
    """Read one row of a table name or Parquet path; the error text if that fails."""
    try:
        table = spark.read.parquet(location) if "/" in location else spark.table(location)
        table.limit(1).count()
        return None
    except PySparkException as e:
        return (e.getCondition() or type(e).__name__) if hasattr(e, "getCondition") else str(e)


def dataset_preflight(names: DataFrame, locations: dict[str, str]) -> DataFrame:
    """One row (dataset, accessible, error) per distinct asked name.

    ``locations`` maps each configured data set to a table name or path; only those are probed, one
    row each, however many names were asked for.
    """
    spark = names.sparkSession
    found = [(name, _probe(spark, where)) for name, where in locations.items()]
    probed = spark.createDataFrame(found, "dataset string, problem string").withColumn("known", F.lit(True))
    asked = names.select(F.col(names.columns[0]).alias("dataset")).distinct()
    bad_name: Column = ~F.coalesce(F.col("dataset").rlike(_NAME), F.lit(False))
    # The two error texts.
    error = (F.when(bad_name, F.concat(F.lit("Invalid dataset name format: "), F.coalesce("dataset", F.lit(""))))
             .when(F.col("known").isNull(), F.concat(F.lit("Cannot access dataset "), "dataset"))
             .when(F.col("problem").isNotNull(), F.concat(F.lit("Cannot access dataset "), "dataset", F.lit(": "), "problem")))
    checked = asked.join(probed, "dataset", "left").withColumn("error", error)
    return checked.select("dataset", F.col("error").isNull().alias("accessible"), "error")
