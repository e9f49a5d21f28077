"""Alignment of two tokenizers over the same texts, and how often their ids meet over a corpus.

Each text is tokenised whole by both. Where a token of either ends at the same byte and both go on with a token that is marked
with a space, the text is cut into windows; the bytes of the tokens are checked first, so the ends are truly shared. A window's
groups depend on its two tuples of ids alone, so each distinct window is aligned once and remembered, as long as that spares work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strataudit.session import work_table

SPACE = "▁"
#: Texts are handed to the tokenizers in portions of about so many characters.
PORTION = 500_000
#: Distinct windows that a Python worker learns until it forgets those that it has not met since the last time, so twice as many
#: are in memory at most. Longer windows than ``LONG`` ids are not remembered.
REMEMBERED, LONG = 100_000, 64
#: After so many texts in a row with a new window, which are written whole anyway, the windows of so many others are not looked up.
TRIED, SPARED = 32, 4096
#: Id pairs, the most frequent ones, that every task has at hand (24 bytes each); all other pairs are joined.
FREQUENT = 1 << 17


def byte_alphabet() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: itself if it is printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteTokens:
    """Ids and bytes of a byte-level BPE vocabulary (a ``tokenizers`` file whose ids follow its merges).

    Strings of special tokens in a text are plain text.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet, merges = byte_alphabet(), [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError(f"the ids of {path} do not follow its merges")
        names = {t: i for t, i in model["vocab"].items() if len(t) == 1} | {"".join(m): i for m, i in zip(merges, made)}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in names.items()}
        self.encoder = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens={"<|endoftext|>": max(ranks.values()) + 1})  # for ``arrays``; never allowed
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for text, i in ranks.items():
            self.bytes[i] = text

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode_ordinary(" " + t) for t in texts]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of ``encode``, without a Python number for each."""
        return [self.encoder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]


class PieceTokens:
    """Ids and bytes of a SentencePiece model. The model itself puts the space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(self.model.IdToPiece(i)[3:5], 16)]) if self.model.IsByte(i)
                      else self.model.IdToPiece(i).replace(SPACE, " ").encode() for i in range(self.model.GetPieceSize())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def _merged(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> np.ndarray:
    """``a`` and ``b`` as one array of runs: the first run of a, the first of b, the second of a, and so on; runs end before ``to``."""
    size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    out = np.empty(len(a) + len(b), a.dtype)
    out[np.arange(len(a)) + np.repeat(to_b - size_b, size_a)] = a
    out[np.arange(len(b)) + np.repeat(to_a, size_b)] = b
    return out


class Aligner:
    """Groups of two token sequences over the same bytes, with a bounded memory of windows."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], limit: int = REMEMBERED):
        self.bytes = a_bytes, b_bytes
        self.lengths = [np.array([len(t) for t in side], np.int64) for side in self.bytes]
        self.spaced = [np.array([t.startswith(b" ") for t in side]) for side in self.bytes]
        # How an id is written: inside and at the end of a group's side.
        n_a, n_b = len(a_bytes), len(b_bytes)
        self.shown = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        #: The text of a window's groups by its ids, both sides one after another.
        self.known: dict[bytes, str] = {}
        self.before: dict[bytes, str] = {}
        self.limit, self.missed, self.spared = limit, 0, 0

    def written(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[str]:
        """The ids of all groups in order as they are written, with what stands behind each."""
        n_a, n_b = len(self.bytes[0]), len(self.bytes[1])
        a, b = a.copy(), b + 2 * n_a
        a[to_a - 1] += n_a
        b[to_b - 1] += n_b
        return list(map(self.shown.__getitem__, _merged(a, b, to_a, to_b).tolist()))

    def by_windows(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[str]:
        """As ``written``, joined by window; remembered windows are looked up."""
        if len(self.known) > self.limit:
            self.before, self.known = self.known, {}
        cut = np.append(self.spaced[0][a[to_a[:-1]]] & self.spaced[1][b[to_b[:-1]]], True)
        last_a, last_b = to_a[cut], to_b[cut]  # the ends of windows
        ids, get = _merged(a, b | 1 << 30, last_a, last_b).tobytes(), self.known.get
        ends = (last_a + last_b).tolist()
        found = [get(ids[4 * p:4 * q]) for p, q in zip([0, *ends], ends)]
        shown = None
        if None in found:
            for n, known in enumerate(found):
                if known is None:
                    p, q = ends[n - 1] if n else 0, ends[n]
                    key = ids[4 * p:4 * q]
                    known = get(key) or self.before.get(key)
                    if known is None:
                        shown = shown or self.written(a, b, to_a, to_b)
                        known = "".join(shown[p:q])
                    if q - p <= LONG:
                        self.known[key] = known
                    found[n] = known
        self.missed = self.missed + 1 if shown else 0
        if self.missed >= TRIED:
            self.missed, self.spared = 0, SPARED
        return found

    def align(self, a: list[int] | np.ndarray, b: list[int], raw: bytes):
        """(groups, links, digest, keys, times) of one text; None if the tokens of either are not its bytes.

        ``keys`` are the distinct linked pairs, ``a`` id * 2^32 + ``b`` id, ``times`` how many links each has.
        """
        a_ids, b_ids = np.asarray(a, np.int32), np.array(b, np.int32)
        if b"".join(map(self.bytes[0].__getitem__, a_ids.tolist())) != raw or b"".join(map(self.bytes[1].__getitem__, b)) != raw:
            return None
        ends_a, ends_b = np.cumsum(self.lengths[0][a_ids]), np.cumsum(self.lengths[1][b_ids])
        at = np.searchsorted(ends_b, ends_a)
        i = np.flatnonzero(ends_b[at] == ends_a)
        to_a, to_b = i + 1, at[i] + 1  # the ends of groups
        if self.spared:
            self.spared -= 1
            found = self.written(a_ids, b_ids, to_a, to_b)
        else:
            found = self.by_windows(a_ids, b_ids, to_a, to_b)
        digest = sha256("".join(found)[:-1].encode()).hexdigest()
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        links = size_a * size_b
        inside = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        across = np.repeat(size_b, links)
        left = a_ids[np.repeat(to_a - size_a, links) + inside // across].astype(np.int64)
        right = b_ids[np.repeat(to_b - size_b, links) + inside % across]
        keys, times = np.unique(left << 32 | right, return_counts=True)
        return len(i), int(links.sum()), digest, keys, times


@lru_cache(maxsize=1)
def tools(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens, Aligner]:
    """One set for all tasks of a Python worker."""
    a, b = ByteTokens(a_path), PieceTokens(b_path)
    return a, b, Aligner(a.bytes, b.bytes)


_ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
ALIGNED = ("doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "pairs array<bigint>, times array<bigint>")


def portions(column: pa.Array, size: int = PORTION) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about ``size`` characters; a longer text is alone."""
    portion, total = [], 0
    for text in column:
        text = text.as_py() or ""
        if portion and total + len(text) > size:
            yield portion
            portion, total = [], 0
        portion.append(text)
        total += len(text)
    if portion:
        yield portion


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: counts of tokens, groups and links, a digest of the groups, and the linked pairs.

    ``pairs`` holds ``a`` id * 2^32 + ``b`` id, each once in order, ``times`` the links of each. Null and empty texts, and texts
    that one of the tokenizers does not give back byte for byte, have no tokens: zeros, an empty digest, no pairs. Repeated rows
    and null doc_ids stay rows; ``row`` tells them apart. Only doc_id and text are read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, aligner = tools(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for texts in portions(batch.column(1)):
                rows = []
                for text, a, b in zip(texts, left.arrays(texts), right.encode(texts)):
                    found = aligner.align(a, b, b" " + text.encode()) if text else None
                    if found:
                        n_groups, n_links, digest, keys, times = found
                        rows.append((row, len(a), len(b), n_groups, n_links, digest, keys, times))
                    else:
                        rows.append((row, 0, 0, 0, 0, "", [], []))
                    row += 1
                columns = [batch.column(0).slice(at, len(texts))] + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_ALIGNED)[1:])]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, schema=_ALIGNED)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, docs, best): how many documents hold each pair linked, and whether no pair of its ``a`` id has more."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    a = F.shiftright("pair", 32)
    # Written before it is read twice: the counts are the large step.
    counted = work_table(counted.withColumn("a", a), "pair-counts")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _against(aligned: DataFrame, known, schema: str, rest: bool) -> DataFrame:
    """Sums over the frequent pairs of each row, or with ``rest`` its other pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = known.value
        for batch in batches:
            rows, keys, times = (batch.column(k) for k in range(3))
            values, often = keys.flatten().to_numpy(), times.flatten().to_numpy()
            sizes = np.diff(keys.offsets.to_numpy())
            owner = np.repeat(np.arange(len(rows)), sizes)
            at = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            hit = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)
            if rest:
                out = [pa.array(rows.to_numpy()[owner[~hit]]), pa.array(values[~hit]), pa.array(often[~hit])]
            else:
                at = at[hit]
                sums = [np.bincount(owner[hit], often[hit] * value[at], len(rows)).astype(np.int64) for value in (best, docs)]
                out = [rows, pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return aligned.select("row", "pairs", "times").mapInArrow(each, schema)


def with_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` over the links of each row.

    The ``frequent`` most frequent pairs, a table of that size at most, go to every task: they make up most links and would be
    the hot keys of a join. All other pairs are joined, so every pair counts.
    """
    top = counts.orderBy(F.desc("docs"), "pair").limit(frequent).toArrow().sort_by("pair")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy().astype(np.int64) for c in ("pair", "docs", "best")))
    often = _against(aligned, known, "row bigint, n_best bigint, count_sum bigint", rest=False)
    rare = _against(aligned, known, "row bigint, pair bigint, times bigint", rest=True).join(counts, "pair").select(
        "row", (F.col("times") * F.col("best").cast("bigint")).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    sums = often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row")
