"""The operators of this subpackage as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataudit.llm import (
    alignment, content, fingerprints, jaccard, licenses, negatives, neighbours, packing, quality, secrets, sequences, subwords, tokens, urls,
)
from strataudit.session import work_path, work_table

CAPACITY = 4096
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE, SHARD = 2048, 2048
ACCEPTED = 0.7
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.trusted(_table(spark, folder, "labels")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


def op3_training_order(spark: SparkSession, folder: str, to: str | None = None) -> DataFrame:
    """Writes the shards to ``to`` (a folder of the session if not given); the rows are their manifest, places and digests read back from the files."""
    stored = work_table(sequences.squeezed(sequences.cut(_table(spark, folder, "documents"), TOKENIZER, SEQUENCE)), "sequences")
    path = to or work_path(spark, "shards")
    ordered = sequences.in_training_order(stored.select("part", "number", "ids"), "training order", SHARD, SEQUENCE)
    sequences.write_shards(sequences.plain(ordered), path)
    stride = 2 * SEQUENCE + len(sequences.TERMINATOR)
    written = sequences.read_shards(spark, path, SEQUENCE).select((F.col("shard") * SHARD + F.col("place")).alias("slot"), "shard", (
        F.col("place").cast("bigint") * stride).alias("offset"), F.crc32("ids").alias("ids_crc32"))
    known = sequences.in_training_order(stored.select("part", "number", "n_ids", "doc_ids"), "training order", SHARD, SEQUENCE).drop("shard", "offset")
    return known.join(written, "slot", "left").select("slot", "shard", "offset", "n_ids", "doc_ids", "ids_crc32")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with the digest of their ids, in sequences."""
    cut = tokens.pieces(docs, TOKENIZER, CAPACITY).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(work_table(cut, "pieces"), CAPACITY)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_content(spark: SparkSession, folder: str) -> DataFrame:
    found = content.extract(_table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op7_subwords(spark: SparkSession, folder: str) -> DataFrame:
    encoded = subwords.encode(_table(spark, folder, "documents"), PIECES)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0").select("vec_id"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare(_table(spark, folder, "documents"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    found = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(found.select("vec_id", moved.alias("label"), negatives.scaled("embedding", 256).alias("vec")), F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = work_table(alignment.align(_table(spark, folder, "documents"), BYTES, PIECES), "aligned")
    counted = work_table(alignment.pair_counts(aligned), "pairs")
    return alignment.with_counts(aligned, counted).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, folder, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_quality, op2_urls, op3_training_order, op4_secrets, op5_content, op6_packing, op7_subwords, op8_jaccard, op9_neighbours,
                                   op10_fingerprints, op11_negatives, op12_alignment, op13_licenses)}


#: Sets, links and components of documents, as in ``op8_jaccard``.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.y, reached.c FROM reached JOIN links ON links.x = reached.doc_id)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least.c AS component_id
FROM sets JOIN (SELECT doc_id, min(c) AS c FROM reached GROUP BY doc_id) AS least ON sets.doc_id = least.doc_id
"""


#: All scores of all anchors, as in ``op11_negatives``.
NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors a JOIN vectors c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_jaccard": JACCARD_SQL, "op11_negatives": NEGATIVES_SQL}
