"""Joins, de-duplication and grouping that stay whole and even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.

    Spark limits each key to one row before the shuffle (``WindowGroupLimit``), so copies of one key
    do not pile up in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; the other columns in order break the tie, so the result repeats.

    It is a grouping and not a window: a query that reads the keys alone then moves and sorts nothing but them.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(*[F.col(c if c in keys else f"_least.{c}") for c in df.columns])


def distinct_keys(df: DataFrame, **names: str) -> DataFrame:
    """Distinct non-null keys, renamed to the left-hand side; combined on the map side."""
    keys = df.select(*[F.col(src).alias(dst) for dst, src in names.items()])
    return keys.dropna().distinct()


def having(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``. ``df`` is the side AQE may split when it is skewed."""
    return df.join(keys, keys.columns, "left_semi")


def lacking(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (null keys never match, so they stay)."""
    return df.join(keys, keys.columns, "left_anti")


def bucket_of(n: Column, *cols: Column) -> Column:
    """An even bucket in ``0 .. n-1`` that depends on the values only, so retries agree."""
    return F.pmod(F.xxhash64(*cols), n.cast("long")).cast("int")


def number_rows(df: DataFrame, group: list[str], buckets: list[Column], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group 1, 2, ... in the order (buckets, order).

    A window over the group would sort a hot group in one task. Rows are numbered per bucket, and the
    counts of the earlier buckets are added; only one count per bucket is ever brought together.
    """
    bs = [f"_b{i}" for i in range(len(buckets))]
    rows = df.withColumns(dict(zip(bs, buckets)))
    counts = rows.groupBy(*group, *bs).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(*bs).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, *bs, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, *bs).orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*group, *bs])
        .withColumn(name, F.col("_i") + F.col("_offset"))
        .drop("_i", "_offset", *bs)
    )


def collect_in_parts(df: DataFrame, keys: list[str], value: str, name: str, limit: int) -> DataFrame:
    """Sorted array of the distinct values of each key, in parts of about ``limit`` values.

    A key with more values than ``limit`` gives several rows (``part`` of ``n_parts``) that together
    hold all of them; no task or row ever holds an unbounded group.
    """
    pairs = df.select(*keys, value).distinct()
    sizes = pairs.groupBy(*keys).agg(F.ceil(F.count(value) / F.lit(limit)).cast("int").alias("n_parts"))
    spread = pairs.join(sizes, keys).withColumn("part", bucket_of(F.greatest("n_parts", F.lit(1)), F.col(value)))
    # without it the grouping would reuse the partitioning of the join, all parts of a key in one task
    spread = spread.repartition(*keys, "n_parts", "part")
    return spread.groupBy(*keys, "n_parts", "part").agg(F.sort_array(F.collect_list(value)).alias(name))
