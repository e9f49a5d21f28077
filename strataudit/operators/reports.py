"""Names of review reports: ``<record>_review_<yyyymmdd>_<nnn>.md``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataudit.functions.columns import strip_spaces
from strataudit.functions.spread import number_rows

# Fixed value: the form of a report name.
_NAME = r"(?s)\A(.*)_review_(\d{8})_(\d+)\.md\z"


def last_numbers(existing: DataFrame) -> DataFrame:
    """Highest number used so far per record and date, from a column of report names."""
    name = F.col(existing.columns[0])
    part = lambda i: F.regexp_extract(name, _NAME, i)
    parsed = existing.filter(name.rlike(_NAME)).select(
        part(1).alias("record_id"), part(2).alias("day"), part(3).try_cast("bigint").alias("n"))
    return parsed.groupBy("record_id", "day").agg(F.max("n").alias("last"))


def report_names(reviews: DataFrame, existing: DataFrame) -> DataFrame:
    """Numbers and names for new reviews (review_id, record_id, created), after the existing ones.

    Within a record and date the numbers follow the time of creation, then the review id. They are counted by second
    first, so that no task numbers all reviews of a record. Numbers above 999 get more digits.
    """
    record = strip_spaces(F.col("record_id"))
    dated = reviews.select("review_id", record.alias("record_id"), "created",
                           F.date_format("created", "yyyyMMdd").alias("day"))
    minute = F.date_format("created", "HHmm")
    second = F.date_format("created", "ss")
    numbered = number_rows(dated, ["record_id", "day"], [minute, second], [F.col("created"), F.col("review_id")], "i")
    seq = (F.coalesce("last", F.lit(0)) + F.col("i")).alias("seq")
    named = numbered.join(last_numbers(existing), ["record_id", "day"], "left").select("review_id", "record_id", "day", seq)
    return named.withColumn("report_name", F.format_string("%s_review_%s_%03d.md", "record_id", "day", "seq"))
