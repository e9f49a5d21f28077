"""A corpus pipeline: good documents, one of each group of near duplicates, without secrets, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataudit.llm import jaccard, quality, secrets
from strataudit.llm.queries import ACCEPTED, packed
from strataudit.session import work_table

#: A column for the time of one stage.
PLACE = "place of the row"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Labels are read from ``labels``, without the held-out ones."""
    model = quality.train(docs, quality.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model).filter(F.col("score") >= ACCEPTED).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest doc_id, then text hash; nulls come last.

    Rows are told apart by doc_id and text, so a doc_id that is repeated with other texts does no harm. Of equal rows one
    stays. Texts without words are in no group and all stay.
    """
    judged = work_table(jaccard.judged(docs).filter("node is not null").select("node", "doc_id", "place"), "judged")
    first = judged.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"))
    other = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.place") == F.col("place")))
    copies = judged.join(first, "node").filter(other).select("doc_id", "place").distinct()
    repeated = judged.groupBy("doc_id", "place").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id", "place")

    def meets(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, (rows[PLACE] == some["place"]) & rows["doc_id"].eqNullSafe(some["doc_id"]), how)

    kept = meets(docs.withColumn(PLACE, jaccard.row_place()), copies, "left_anti")
    return meets(kept, repeated, "left_anti").unionByName(
        meets(kept, repeated, "left_semi").dropDuplicates(["doc_id", PLACE])).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by a mark; n_chars is counted anew where it was known."""
    return secrets.mask(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("best-fit packing", in_sequences),
]

#: No stage can be expressed in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
