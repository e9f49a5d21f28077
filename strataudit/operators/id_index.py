"""Substring search of many terms over record ids, by an inverted index of grams.

Grams are the substrings of 1, 2, 4, 8, ... characters, so an id of n characters has about n * log2(n) of them, not n * n / 2. A term
is looked up by its longest such gram, at its start or at its end, whichever fewer ids have; as that is at least half of the term,
few ids are left to verify. A term of 1, 2, 4, ... characters is a gram itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Sizes of grams; longer terms are looked up by a gram of the last size.
SIZES = (1, 2, 4, 8, 16, 32, 64)


def _size(text: Column) -> Column:
    """The largest size that is not above the length."""
    return F.array_max(F.filter(F.array(*map(F.lit, SIZES)), lambda s: s <= F.char_length(text)))


def grams_of(ids: DataFrame) -> DataFrame:
    """``ids`` (record_id, more), one row for each distinct gram of the lower-cased id, in ``gram``; empty ids have none."""
    sizes = F.filter(F.array(*map(F.lit, SIZES)), lambda s: s <= F.char_length("_id"))
    grams = F.array_distinct(F.flatten(F.transform(sizes, lambda s: F.transform(
        F.sequence(F.lit(1), F.char_length("_id") - s + 1), lambda at: F.substring(F.col("_id"), at, s)))))
    return ids.withColumn("_id", F.lower("record_id")).withColumn("gram", F.explode(grams)).drop("_id")


def _wanted(terms: DataFrame) -> DataFrame:
    """Distinct lower-cased terms with their two grams."""
    piece = terms.select(F.lower(terms.columns[0]).alias("term")).filter("term <> ''").distinct()
    sized = piece.withColumn("n", _size(F.col("term")))
    return sized.select("term", F.substring("term", F.lit(1), F.col("n")).alias("head"),
                        F.substring("term", F.char_length("term") - F.col("n") + 1, F.col("n")).alias("tail"))


def records_with(terms: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (term, record_id): the records whose id contains a term of the first column, in any case; terms come lower-cased.

    ``grams`` is (gram, record_id), a row once. How many ids have a gram is counted for the grams of terms only.
    """
    wanted = _wanted(terms)
    asked = wanted.select(F.explode(F.array("head", "tail")).alias("gram")).distinct()
    often = grams.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("ids"))
    head, tail = (often.select(F.col("gram").alias(c), F.col("ids").alias(f"{c}_ids")) for c in ("head", "tail"))
    # A term with a gram that no id has is gone with the inner joins.
    rarer = wanted.join(head, "head").join(tail, "tail").select(
        "term", F.when(F.col("tail_ids") < F.col("head_ids"), F.col("tail")).otherwise(F.col("head")).alias("gram"))
    # The index on the left: that side may be split where one gram has very many ids.
    return grams.join(rarer, "gram").filter(F.contains(F.lower("record_id"), F.col("term"))).select("term", "record_id")
