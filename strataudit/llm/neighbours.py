"""Nearest neighbours by cosine: several shifted Hilbert curves through projected vectors, whose windows merge and are ranked again.

Each curve puts all vectors in one order, range-partitioned by Spark. A query looks at a window of the order round its own
place, by vectors of one byte a component; what it finds on all curves is measured on the original vectors. The window
grows with the table (``window_of``). Equal vectors are one entry of the index, with the ids that can be asked for.
``exact`` adds a pass over the whole index that keeps what reaches the score that the curves have found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strataudit.session import work_table


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (whole numbers below 2**bits) on the Hilbert curve, as signed 64-bit numbers."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(upper, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """``count`` curves: each turns the main directions of the vectors, shifts them and takes a Hilbert order of the first."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, count: int, dims: int, bits: int, kept: int, seed: int = 7):
        values, directions = np.linalg.eigh(spread)
        main = directions[:, np.argsort(-values)][:, :kept]
        rng = np.random.default_rng(seed)
        self.mean, self.bits, self.turns, self.shifts = mean, bits, [], []
        for _ in range(count):
            turn = np.linalg.qr(rng.normal(size=(main.shape[1], main.shape[1])))[0][:, :dims]
            self.turns.append(main @ turn)
            self.shifts.append(rng.uniform(0, 1, self.turns[-1].shape[1]))
        self.widths = [np.maximum(np.sqrt(np.einsum("ij,ik,kj->j", t, spread, t)), 1e-9) for t in self.turns]

    def keys(self, units: np.ndarray, curve: int) -> np.ndarray:
        top = (1 << self.bits) - 1
        at = (units - self.mean) @ self.turns[curve] / self.widths[curve]  # in standard deviations
        return hilbert_keys(np.clip((at + 3.5 + self.shifts[curve]) / 8 * top, 0, top).astype(np.int64), self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def entries(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The index and the rows that it is made of. Index rows (rep, ids, v, embedding) are the distinct vectors that take part: a number, the ``keep`` smallest ids, eight-byte floats.

    Null and zero vectors and those with null or non-finite components take no part, nor do null ids and vectors of another
    length than most have.
    """
    fits = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    valid = vectors.filter("vec_id is not null and embedding is not null").filter(fits & F.exists("embedding", lambda x: x != 0))
    valid = valid.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    valid = valid.filter(F.size("embedding") == (sizes["n"] if sizes else 0))
    row = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    found = valid.withColumn("row", row).filter(F.col("row") <= keep).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array([np.array(v, dtype="<f8").tobytes() for v in vs], pa.binary()),
                                              batch.column(1)], names=["ids", "v", "embedding"])

    flats = found.select("ids", "embedding").mapInArrow(flat, "ids array<bigint>, v binary, embedding array<double>")
    return work_table(flats.withColumn("rep", F.monotonically_increasing_id()), "entries"), valid


def _moments(index: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all unit vectors, from one row of sums a task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()]), pa.array([square.tobytes()])], names=["n", "s", "q"])

    rows = index.select("v").mapInArrow(part, "n bigint, s binary, q binary").collect()
    n = sum(r.n for r in rows)
    mean = sum(np.frombuffer(r.s) for r in rows) / n
    return n, mean, sum(np.frombuffer(r.q) for r in rows).reshape(len(mean), -1) / n - np.outer(mean, mean)


def above(index: DataFrame, bounded: DataFrame, k: int, at_once: int) -> DataFrame:
    """Rows (me, other, score): entries of ``index`` (rep, ids, v) that can be among the ``k`` best of ``bounded`` (me, v, least).

    Every entry is measured against every query, ``at_once`` queries a pass, by products of matrices in four-byte floats; what
    comes near the bound is measured again in eight bytes. A query without a bound (null) takes all. Each task sends the
    ``k`` best of a query, ties by the smallest id, and raises the bound as it goes.
    """
    spark, slack = index.sparkSession, 1e-5
    n = bounded.count()
    passes = max(1, -(-n // at_once))
    dealt = bounded.withColumn("pass", F.pmod(F.xxhash64("me"), F.lit(passes))) if passes > 1 else bounded.withColumn("pass", F.lit(0))

    def scan(held):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            me, least, y = held.value
            least, best = least.copy(), [[] for _ in me]
            norm = np.sqrt(np.einsum("ij,ij->i", y, y))
            unit = (y / norm[:, None]).astype("<f4")
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, least_ids, x = *[np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in (0, 2)], _matrix(batch.column(1))
                size = np.sqrt(np.einsum("ij,ij->i", x, x))
                short = (x / size[:, None]).astype("<f4")
                for low in range(0, len(me), 512):
                    rows, cols = np.nonzero(unit[low:low + 512] @ short.T >= (least[low:low + 512] - slack)[:, None])
                    rows += low
                    score = np.empty(len(rows))
                    for j in range(0, len(rows), 8192):
                        r, c = rows[j:j + 8192], cols[j:j + 8192]
                        score[j:j + 8192] = np.einsum("ij,ij->i", y[r], x[c]) / (norm[r] * size[c])
                    order = np.lexsort((least_ids[cols], -score, rows))
                    rows, cols, score = rows[order], cols[order], score[order]
                    starts = np.flatnonzero(np.diff(rows, prepend=-1))
                    place = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
                    chosen = cols[place < k]
                    for q, i, first, s in zip(rows[place < k].tolist(), ids[chosen].tolist(), least_ids[chosen].tolist(), score[place < k].tolist()):
                        best[q].append((-s, first, i))
                    for q in rows[starts].tolist():
                        best[q] = sorted(best[q])[:k]
                        if len(best[q]) == k:
                            least[q] = max(least[q], -best[q][-1][0])
            out = [(int(me[q]), i, -s) for q, found in enumerate(best) for s, _, i in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["me", "other", "score"])

        return part

    found = None
    for number in range(passes):
        rows = dealt.filter(F.col("pass") == number).select("me", "least", "v").collect()
        if not rows and passes > 1:
            continue
        least = np.array([-np.inf if r.least is None else r.least for r in rows])
        width = len(rows[0].v) // 8 if rows else 1
        held = spark.sparkContext.broadcast((np.array([r.me for r in rows], dtype=np.int64), least,
                                             np.frombuffer(b"".join(r.v for r in rows), dtype="<f8").reshape(-1, width)))
        made = work_table(index.select("rep", "v", F.get("ids", F.lit(0))).mapInArrow(scan(held), "me bigint, other bigint, score double"), "above")
        held.unpersist()
        found = made if found is None else found.unionByName(made)
    return found


def window_of(n: int) -> int:
    """Places on each side that a query sees at least on a curve through ``n`` vectors. For directions that are nearly even the
    window that keeps the recall grows more slowly than the table (README)."""
    return max(64, int(0.1 * n ** 0.8))


def _one_byte(units: np.ndarray) -> np.ndarray:
    """Unit vectors with their largest component as 127: a cosine moves by sqrt(dimensions) / 127 at most."""
    return np.rint(units * (127 / np.abs(units).max(axis=1, keepdims=True))).astype(np.int8)


def on_curves(index: DataFrame, lines: Curves) -> DataFrame:
    """Rows (curve, key, rep, seeks, v): each entry of ``index`` (rep, seeks, v) on each curve, vectors of one byte a component."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _matrix(batch.column(2))
                units = units / np.linalg.norm(units, axis=1, keepdims=True)
                short = pa.array([row.tobytes() for row in _one_byte(units)], pa.binary())
                for c in range(len(lines.turns)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), c, dtype=np.int32)), pa.array(lines.keys(units, c)), *batch.columns[:2], short],
                                                     names=["curve", "key", "rep", "seeks", "v"])

    return index.select("rep", "seeks", "v").mapInArrow(place, "curve int, key bigint, rep bigint, seeks boolean, v binary")


def windows(ordered: DataFrame, block: int, best: int) -> DataFrame:
    """Rows (me, other, near) of sorted ``ordered`` (curve, rep, seeks, v): the ``best`` others of each that seeks, on each curve.

    A partition is read in blocks of ``block`` entries; those that seek see their block and the two next to it, so three blocks
    are in memory. The window of a seeker at the end of a partition ends there; on other curves it lies elsewhere.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(blocks, middle):
            ids, seeks, x = middle
            if not seeks.any():
                return
            others, all_x = np.concatenate([b[0] for b in blocks]), np.concatenate([b[2] for b in blocks])
            for low in range(0, int(seeks.sum()), 512):
                me, y = ids[seeks][low:low + 512], x[seeks][low:low + 512]
                score = y @ all_x.T
                score[me[:, None] == others[None, :]] = -np.inf
                top = np.argpartition(-score, best - 1, axis=1)[:, :best] if score.shape[1] > best else np.tile(np.arange(score.shape[1]), (len(me), 1))
                near = np.take_along_axis(score, top, axis=1)
                kept = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(me[:, None], top.shape)[kept]), pa.array(others[top][kept]),
                                                  pa.array(near[kept].astype(float))], names=["me", "other", "near"])

        def blocks_of():
            curve, ids, seeks, x = None, [], [], []
            for batch in batches:
                for c, rep, seek, v in zip(*[col.to_pylist() for col in batch.columns]):
                    if c != curve or len(ids) == block:
                        if ids:
                            yield curve, (np.array(ids), np.array(seeks), _unit(x))
                        curve, ids, seeks, x = c, [], [], []
                    ids.append(rep)
                    seeks.append(seek)
                    x.append(v)
            if ids:
                yield curve, (np.array(ids), np.array(seeks), _unit(x))

        def _unit(vs):
            x = np.frombuffer(b"".join(vs), np.int8).reshape(len(vs), -1).astype(np.float32)
            return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

        now, held = None, []  # the blocks before, and the one whose next is awaited
        for curve, block_ in blocks_of():
            if curve != now:
                if held:
                    yield from found(held, held[-1])
                now, held = curve, [block_]
                continue
            held.append(block_)
            yield from found(held, held[-2])
            held = held[-2:]
        if held:
            yield from found(held, held[-1])

    return ordered.select("curve", "rep", "seeks", "v").mapInArrow(look, "me bigint, other bigint, near double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, curves: int = 48, dims: int = 12, bits: int = 5, kept: int = 32,
           block: int | None = None, range_rows: int = 100_000, exact: bool = False, at_once: int = 8192) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each of ``queries`` (vec_id) the ``k`` nearest others found by cosine.

    All vectors that take part are indexed. On each curve a query sees its block of ``block`` entries (``window_of`` if not given) and
    the two next to it. With ``exact`` the true neighbours are found by a pass over all entries (``above``). Ties go to the smaller
    id; with fewer candidates all are returned. Queries that take no part give no rows. Rows that repeat a vec_id are rows like
    others: each is asked for, and a candidate of the others. Other columns are not read.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    index, valid = entries(vectors, k + 1)
    if index.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    n, mean, spread = _moments(index)
    block, width = block or window_of(n), len(mean)
    asked = valid.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    # the entry of each query: found through the vector itself
    asked = work_table(asked.join(index.select("embedding", "rep"), "embedding").groupBy(F.col("vec_id").alias("query_id"), "rep").agg(F.count("*").alias("copies")), "asked")
    seekers = asked.select("rep").distinct().withColumn("seeks", F.lit(True))
    flagged = index.join(seekers, "rep", "left").select("rep", F.coalesce("seeks", F.lit(False)).alias("seeks"), "v")
    placed = on_curves(flagged, Curves(mean, spread, curves, dims, bits, kept))
    n_ranges = max(1, curves * n // max(range_rows, 16 * block))
    ordered = placed.repartitionByRange(n_ranges, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    pairs = work_table(windows(ordered, block, 2 * k).groupBy("me", "other").agg(F.max("near").alias("near")), "pairs")
    # rounding moves two cosines: what is further below the last that is wanted cannot be among the nearest found
    last = pairs.withColumn("place", F.row_number().over(Window.partitionBy("me").orderBy(F.desc("near")))).filter(F.col("place") == k).select("me", F.col("near").alias("last"))
    close = pairs.join(last, "me", "left").filter(F.col("last").isNull() | (F.col("near") >= F.col("last") - 2 * width ** 0.5 / 127)).select("me", "other")
    itself = seekers.select(F.col("rep").alias("me"), F.col("rep").alias("other"))
    met = (close.unionByName(itself).join(index.select(F.col("rep").alias("me"), F.col("v").alias("a")), "me")
           .join(index.select(F.col("rep").alias("other"), "ids", F.col("v").alias("b")), "other").select("me", "other", "ids", "a", "b"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(3)), _matrix(batch.column(4))
                score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["me", "other", "ids", "score"])

    scored = met.mapInArrow(measure, "me bigint, other bigint, ids array<bigint>, score double")
    order = Window.partitionBy("me").orderBy(F.desc("score"), F.get("ids", F.lit(0)), "other")
    if exact:
        seen = F.sort_array(F.collect_list("score"), asc=False)
        least = scored.select("me", "other", "score").groupBy("me").agg(F.when(F.count("*") > k, F.get(seen, F.lit(k))).alias("least"))
        bounded = work_table(least.join(index.select(F.col("rep").alias("me"), "v"), "me"), "bounds")
        scored = above(index, bounded, k + 1, at_once).join(index.select(F.col("rep").alias("other"), "ids"), "other")
    short = scored.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= k + 1)
    lists = short.groupBy("me").agg(F.collect_list(F.struct("other", "score", "ids")).alias("near"))
    at = F.when(F.col("x.other") == F.col("rep"), F.array_position("x.ids", F.col("query_id"))).otherwise(0).cast("int")  # the query's own row
    others = F.concat(F.slice("x.ids", F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice("x.ids", at + 1, F.size("x.ids")))
    options = asked.join(lists, asked["rep"] == lists["me"]).select("query_id", "rep", "copies", F.explode("near").alias("x")).select(
        "query_id", "rep", "copies", "x.score", F.explode(others).alias("vec_id"))
    final = Window.partitionBy("query_id", "rep").orderBy(F.desc("score"), "vec_id")
    ranked = options.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")
