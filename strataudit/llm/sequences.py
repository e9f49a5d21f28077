"""Training order: token sequences of one length, each at a place that a keyed permutation gives, in fixed-stride shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataudit.llm.tokens import give_back, in_portions, word_encoder
from strataudit.session import work_table

TERMINATOR = "\n"


def feistel(numbers: np.ndarray, size: int, key: str, rounds: int = 6) -> np.ndarray:
    """A one-to-one map of 0 to ``size`` - 1 onto itself, set by ``key``.

    A Feistel network permutes the next even power of two; a result beyond ``size`` goes through it again (cycle-walking).
    """
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while (beyond := out >= np.uint64(size)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def two_bytes(ids: bytes) -> np.ndarray:
    """Ids of four bytes as ids of two; one that needs more is an error."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"token id {wide.max()} does not fit in two bytes")
    return wide.astype("<u2")


def cut(docs: DataFrame, path: str, length: int, end_id: int = 1) -> DataFrame:
    """Rows (part, number, n_ids, doc_ids, ids): the ids of a task's documents in a row, ``end_id`` after each, cut at ``length``.

    Ids take two bytes, little-endian; a tokenizer with larger ones is refused. The last sequence of a task is filled up with ``end_id``; ``n_ids`` counts the ids before
    that. ``doc_ids`` are those of the documents that the sequence has ids of, in order. Null texts count as empty.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width, part = word_encoder(path), np.array([end_id], "<u2"), length, TaskContext.get().partitionId()
        open_ids, open_docs, filled, number = [], [], 0, 0

        def rows(made):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()))],
                                              names=["part", "number", "n_ids", "doc_ids", "ids"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in in_portions(batch.column(1).to_pylist(), 1_000_000):
                made = []
                for doc_id, ids in zip(doc_ids[first:], encoder.encode(texts)):
                    ids = np.append(two_bytes(ids), end)
                    while len(ids):
                        part_ids, ids = ids[:width - filled], ids[width - filled:]
                        open_ids.append(part_ids)
                        open_docs.append(doc_id)
                        filled += len(part_ids)
                        if filled == width:
                            made.append((part, number, width, open_docs, b"".join(a.tobytes() for a in open_ids)))
                            open_ids, open_docs, filled, number = [], [], 0, number + 1
                if made:
                    yield rows(made)
        if filled:
            ids = b"".join(a.tobytes() for a in open_ids) + end.tobytes() * (width - filled)
            yield rows([(part, number, filled, open_docs, ids)])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(build, "part int, number bigint, n_ids int, doc_ids array<bigint>, ids binary")


def in_training_order(sequences: DataFrame, key: str, per_shard: int, length: int) -> DataFrame:
    """``sequences`` (part, number, more) with slot, shard and offset (bytes in the shard), in ranges of the slot, sorted.

    Sequences are numbered by (part, number) from one count a part; the number's image under ``feistel`` is the slot, so
    slots are 0 to n - 1 without gaps. ``sequences`` has to be a stored table, as a new run could number it otherwise.
    """
    counts = {r["part"]: r["n"] for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    first = dict(zip(parts, np.cumsum([0, *(counts[p] for p in parts)]).tolist()))
    total, names = sum(counts.values()), sequences.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([first[p] for p in batch.column(names.index("part")).to_pylist()], dtype=np.int64)
            at += np.array(batch.column(names.index("number")).to_pylist(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(feistel(at, total, key))], names=[*names, "slot"])

    placed = sequences.mapInArrow(place, ", ".join(f"`{c}` {t}" for c, t in sequences.dtypes) + ", slot bigint")
    stride = 2 * length + len(TERMINATOR)
    ordered = placed.drop("part", "number").withColumn("shard", F.floor(F.col("slot") / per_shard)).withColumn(
        "offset", F.col("slot") % per_shard * stride)
    return ordered.repartitionByRange(max(1, -(-total // per_shard)), "shard").sortWithinPartitions("shard", "slot")


def _recoded(rows: DataFrame, make) -> DataFrame:
    """``rows`` with the function that ``make`` gives done to each value of ``ids``."""
    at = rows.columns.index("ids")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([work(b) for b in columns[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(change, rows.schema)


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with ids that take less room in tables and shuffles."""
    return _recoded(rows, lambda: zstandard.ZstdCompressor(level=3).compress)


def plain(rows: DataFrame) -> DataFrame:
    """``rows`` of ``squeezed`` as they were."""
    return _recoded(rows, lambda: zstandard.ZstdDecompressor().decompress)


def write_shards(ordered: DataFrame, path: str) -> None:
    """One file a shard, records of one stride: the ids and a one-byte terminator. Written by Spark, so a lost task is
    done again, and a reader can go on at any record: shard ``slot // per_shard``, byte ``offset``."""
    (ordered.sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard")
     .option("lineSep", TERMINATOR).text(path))


def read_shards(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Rows (shard, place, ids) of written shards."""
    stride = 2 * length + len(TERMINATOR)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint").alias("shard"), "content", "length")
    places = F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1)
    return files.filter("length > 0").select("shard", "content", F.explode(places).alias("place")).select(
        "shard", "place", F.expr(f"substring(content, place * {stride} + 1, {2 * length})").alias("ids"))
