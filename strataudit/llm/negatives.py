"""Hard negatives by shared sorted lists: rows of another label that score just below an anchor's positives.

Anchors are clustered by direction. For each cluster all rows are sorted once by an upper bound of their inner product with any
member: its length times the cosine of its angle to the cluster's centre less the cluster's widest angle. Every member walks that
one list, and stops where the bound times its own length is below what it still needs; nothing behind that place can count. Lists
are cut into segments and members into slices, so a hot cluster or a long list is many pairs of bounded size, and a first walk over
the head of each list gives the members the limits with which they enter the other segments. All results are exact; how much of the
lists is skipped depends on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from strataudit.session import work_table

#: Clusters of anchors of one vector length. Each sorts all rows once, so the lists take this many times the vectors.
CLUSTERS = 4
#: Centres are fitted on at most so many anchors, those of the smallest hashes.
SAMPLE = 4096
#: Rows of a list that lie in one segment, members of a slice, and rows of a segment between two looks at the bound.
SEGMENT, SLICE, STRIP = 8192, 512, 1024
#: Whole numbers below this are exact as doubles, partial sums included.
EXACT = 2.0 ** 52

_SLICE = ["n", "cluster", "slice"]
_MEMBER = [*_SLICE, "member"]


def scaled(vector: str, factor: float) -> Column:
    """``floor(factor * x)`` of all components; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor)))))


def _matrix(packed: list[bytes], n: int) -> np.ndarray:
    """Vectors of length n as rows; whole numbers, as doubles where all products are exact."""
    if not n or not packed:
        return np.zeros((len(packed), n))
    width = {len(v) // n for v in packed}
    rows = np.frombuffer(b"".join(packed), "<i2").reshape(-1, n) if width == {2} else np.array(
        [np.frombuffer(v, f"<i{len(v) // n}") for v in packed], np.int64)
    return rows.astype(np.float64)


def _scores(a: list[bytes], b: list[bytes], n: int):
    """A function of a range of ``b`` and some rows of ``a`` that gives their exact inner products."""
    left, right = _matrix(a, n), _matrix(b, n)
    widest = lambda m: float(np.sqrt(np.max(np.sum(m * m, axis=1), initial=0.0)))
    if widest(left) * widest(right) < EXACT:
        return lambda rows, at, to: left[rows] @ right[at:to].T
    whole = [np.array([[int(x) for x in np.frombuffer(v, f"<i{len(v) // n}")] for v in side], object) for side in (a, b)]
    return lambda rows, at, to: whole[0][rows] @ whole[1][at:to].T


def packed_rows(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, n, v) of those that take part: ``v`` holds the n components, two bytes each where all fit, else eight."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(
                vectors.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            each = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
            v = [x.astype("<i2" if len(x) and -32768 <= x.min() and x.max() <= 32767 else "<i8").tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int32()), pa.array(v, pa.binary())],
                                             names=["vec_id", "label", "n", "v"])

    there = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("vec").cast("array<bigint>")).dropna()
    return there.mapInArrow(pack, "vec_id bigint, label bigint, n int, v binary")


def centres(anchors: DataFrame, clusters: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit centres by vector length, from a bounded sample: spherical k-means from the anchors that lie farthest apart."""
    chosen = anchors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(sample).select("n", "v").collect()
    found = {}
    for n in {r.n for r in chosen}:
        unit = _matrix([bytes(r.v) for r in chosen if r.n == n], n)
        lengths = np.linalg.norm(unit, axis=1)
        unit = unit[lengths > 0] / lengths[lengths > 0, None]
        if not len(unit):
            continue
        picked = unit[:1]
        for _ in range(min(clusters, len(unit)) - 1):
            picked = np.vstack([picked, unit[np.argmin((unit @ picked.T).max(axis=1))]])
        for _ in range(10):
            nearest = np.argmax(unit @ picked.T, axis=1)
            sums = np.array([unit[nearest == k].sum(axis=0) for k in range(len(picked))])
            size = np.linalg.norm(sums, axis=1)
            picked = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], picked)
        found[int(n)] = picked
    return found


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("n").to_numpy()
    for n in np.unique(lengths):
        yield int(n), batch.filter(pa.array(lengths == n))


def members_of(anchors: DataFrame, found: dict[int, np.ndarray]) -> DataFrame:
    """Anchors with their cluster and the cosine to its centre; equal rows are one with their number in ``copies``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows in _by_length(batch):
                vectors = _matrix(rows.column("v").to_pylist(), n)
                size = np.linalg.norm(vectors, axis=1)
                cluster, cosine = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
                if n in found:
                    near = vectors @ found[n].T
                    cluster = near.argmax(axis=1).astype(np.int32)
                    cosine = np.divide(near.max(axis=1), size, out=np.ones(len(size)), where=size > 0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(size), pa.array(cluster), pa.array(cosine)],
                                                 names=[*rows.schema.names, "size", "cluster", "cosine"])

    one = anchors.groupBy("vec_id", "label", "n", "v").agg(F.count("*").alias("copies"))
    return one.mapInArrow(assign, "vec_id bigint, label bigint, n int, v binary, copies bigint, size double, cluster int, cosine double")


def in_slices(members: DataFrame) -> DataFrame:
    """Rows (n, cluster, slice, items) of about ``SLICE`` members each, however large a cluster is."""
    sizes = members.groupBy("n", "cluster").agg(F.ceil(F.count("*") / F.lit(SLICE)).alias("slices"))
    dealt = members.join(sizes, ["n", "cluster"]).withColumn("slice", F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("slices")))
    return dealt.groupBy(*_SLICE).agg(F.collect_list(F.struct("vec_id", "label", "v", "copies", "size")).alias("items"))


def candidates(rows: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` rows of each label and vector, which are all that can be among the first of any anchor.

    Equal vectors score alike, so only those of the smallest ids come first. ``twin`` marks the first of equal rows: an anchor
    passes it over as itself.
    """
    same = Window.partitionBy("label", "n", "v").orderBy("vec_id")
    first = rows.withColumn("at", F.row_number().over(same)).filter(F.col("at") <= keep)
    return first.withColumn("twin", ~F.coalesce(F.lag("vec_id").over(same) == F.col("vec_id"), F.lit(False))).drop("at")


def lists(rows: DataFrame, found: dict[int, np.ndarray], widest: dict[tuple[int, int], float]) -> DataFrame:
    """Each cluster's list of all rows by falling bound, in rows (n, cluster, segment, top, size, bounds, ids, labels, twins, vs).

    ``bounds`` hold for members of length one. They are a little too large, by more than rounding can make them too small.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                vectors = _matrix(part.column("v").to_pylist(), n)
                size = np.linalg.norm(vectors, axis=1)
                centre = found.get(n, np.zeros((1, n)))
                along = vectors @ centre.T
                across = np.sqrt(np.maximum(size[:, None] ** 2 - along ** 2, 0))
                for k in range(len(centre)):
                    if (n, k) not in widest and n in found:
                        continue
                    cosine = min(widest.get((n, k), 0.0), 1.0)
                    tilted = along[:, k] * cosine + across[:, k] * np.sqrt(max(1 - cosine * cosine, 0.0))
                    bound = np.where(along[:, k] >= size * cosine, size, tilted) + 1e-6 * size
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(size), k, np.int32)), pa.array(bound)],
                                                     names=[*part.schema.names, "cluster", "bound"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        waiting, key = [], None

        def packed() -> pa.RecordBatch:
            nonlocal segment
            segment += 1
            part = pa.Table.from_batches(waiting)
            number = lambda c, t: part.column(c).to_numpy().astype(t).tobytes()
            row = {"n": key[0], "cluster": key[1], "segment": segment, "top": part.column("bound")[0].as_py(), "size": len(part),
                   "bounds": number("bound", "<f8"), "ids": number("vec_id", "<i8"), "labels": number("label", "<i8"),
                   "twins": number("twin", "u1"), "vs": part.column("v").to_pylist()}
            return pa.RecordBatch.from_pylist([row], schema=_LIST)

        for batch in batches:
            keys = np.stack([batch.column("n").to_numpy(), batch.column("cluster").to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, to in zip(edges[:-1], edges[1:]):
                while at < to:
                    if waiting and (key != (int(keys[0, at]), int(keys[1, at])) or sum(map(len, waiting)) >= SEGMENT):
                        yield packed()
                        waiting = []
                    key = int(keys[0, at]), int(keys[1, at])
                    n = min(to - at, SEGMENT - sum(map(len, waiting)))
                    waiting.append(batch.slice(at, n))
                    at += n
        if waiting:
            yield packed()

    listed = rows.mapInArrow(bounded, "vec_id bigint, label bigint, n int, v binary, twin boolean, cluster int, bound double")
    order = ["n", "cluster", F.desc("bound"), "vec_id"]
    return listed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _LIST_COLUMNS)


_LIST = pa.schema([("n", pa.int32()), ("cluster", pa.int32()), ("segment", pa.int64()), ("top", pa.float64()), ("size", pa.int32()),
                   ("bounds", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("twins", pa.binary()), ("vs", pa.list_(pa.binary()))])
_LIST_COLUMNS = "n int, cluster int, segment bigint, top double, size int, bounds binary, ids binary, labels binary, twins binary, vs array<binary>"
_FOUND = pa.schema([("n", pa.int32()), ("cluster", pa.int32()), ("slice", pa.int64()), ("member", pa.int32()), ("target", pa.int32()),
                    ("score", pa.int64()), ("vec_id", pa.int64())])
_FOUND_COLUMNS = "n int, cluster int, slice bigint, member int, target int, score bigint, vec_id bigint"


class Target:
    """What a member looks for: the first ``count`` scores between ``low`` and ``high`` (None: no end)."""

    __slots__ = ("low", "high", "least", "count", "best")

    def __init__(self, low, high, least, count: int):
        self.low, self.high, self.count, self.best = low, high, count, []
        #: Scores below this are not needed: below the window, or ``count`` better ones are known.
        self.least = max((x for x in (low, least) if x is not None), default=-np.inf)

    def add(self, scores: list, ids: list) -> None:
        self.best = sorted(self.best + [(-s, i) for s, i in zip(scores, ids)])[:self.count]
        if len(self.best) == self.count:
            self.least = max(self.least, -self.best[-1][0])


def walk(items: list[dict], targets: list[list[Target]], segment: dict, same: bool) -> None:
    """Every member's walk along one segment, until the bound shows that no target can gain.

    ``same``: rows of the member's own label are looked for, else those of other labels.
    """
    n = segment["n"]
    bounds, ids, labels = (np.frombuffer(segment[c], t) for c, t in (("bounds", "<f8"), ("ids", "<i8"), ("labels", "<i8")))
    twins, vectors = np.frombuffer(segment["twins"], "u1"), segment["vs"]
    lengths = np.array([i["size"] for i in items])
    product = _scores([i["v"] for i in items], vectors, n)
    walking = np.arange(len(items))
    for at in range(0, len(ids), STRIP):
        to = min(at + STRIP, len(ids))
        needed = np.array([min((t.least for t in targets[k] if t.high is None or t.least <= t.high), default=np.inf) for k in walking], float)
        walking = walking[lengths[walking] * bounds[at] >= needed - 1e-6 * np.abs(np.where(np.isfinite(needed), needed, 0))]
        if not len(walking):
            return
        scores = product(walking, at, to)
        own = labels[at:to]
        for k, row in zip(walking.tolist(), scores):
            mine, item = targets[k], items[k]
            fits = (own == item["label"]) == same
            least = min(t.least for t in mine)
            hits = np.flatnonzero(fits & (row >= least)) if least > -np.inf else np.flatnonzero(fits)
            if same:
                itself = [x for x in hits[ids[at + hits] == item["vec_id"]].tolist() if twins[at + x] and vectors[at + x] == item["v"]]
                hits = hits[~np.isin(hits, itself)] if itself else hits
            for t in mine:
                chosen = hits[(row[hits] >= t.least) & (row[hits] <= (np.inf if t.high is None else t.high))] if len(hits) else hits
                if len(chosen) > 4 * t.count:  # only the scores that reach the count-th largest
                    edge = np.partition(row[chosen], len(chosen) - t.count)[len(chosen) - t.count]
                    chosen = chosen[row[chosen] >= edge]
                    if len(chosen) > 4 * t.count:  # many ties: the smallest ids of the last score do
                        chosen = chosen[np.lexsort((ids[at + chosen], -row[chosen].astype(float)))[:t.count]]
                if len(chosen):
                    t.add([int(s) for s in row[chosen]], ids[at + chosen].tolist())


def _walked(pairs: DataFrame, members: DataFrame, wanted: DataFrame, listed: DataFrame, same: bool, count: int) -> DataFrame:
    """The first ``count`` of each target in each segment of ``pairs`` (n, cluster, slice, segment)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                targets = [[Target(t["low"], t["high"], t["least"], count) for t in ts] for ts in row["wanted"]]
                walk(row["items"], targets, row, same)
                found = [(row["n"], row["cluster"], row["slice"], m, j, -s, i) for m, ts in enumerate(targets) for j, t in enumerate(ts) for s, i in t.best]
                columns = zip(*found) if found else [[]] * len(_FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    full = pairs.join(members.join(wanted, _SLICE), _SLICE).join(listed.drop("n", "cluster", "top"), "segment")
    return full.mapInArrow(each, _FOUND_COLUMNS)


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy(*_MEMBER, "target").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _searched(members: DataFrame, wanted: DataFrame, listed: DataFrame, same: bool, count: int) -> DataFrame:
    """The first ``count`` rows of each target over the whole lists.

    ``wanted`` (n, cluster, slice, wanted) has the targets of each member. The head of each list is walked first; what it gives
    bounds the walk along the other segments, and a slice meets only segments whose bound one of its members can still use.
    """
    segments = listed.select("n", "cluster", "segment", "top")
    head = segments.groupBy("n", "cluster").agg(F.max_by("segment", F.struct("top", -F.col("segment"))).alias("segment"))
    at_head = members.select(*_SLICE).join(head, ["n", "cluster"])
    begun = work_table(_walked(at_head, members, wanted, listed, same, count), "head")
    known = begun.groupBy(*_MEMBER, "target").agg(F.when(F.count("*") >= count, F.min("score")).alias("known"))
    opened = wanted.select(*_SLICE, F.posexplode("wanted").alias("member", "ts")).select(*_MEMBER, F.posexplode("ts").alias("target", "t"))
    limits = opened.join(known, [*_MEMBER, "target"], "left").select(*_MEMBER, "target", F.struct(
        "t.low", "t.high", F.greatest("t.low", "known").alias("least")).alias("t"))
    per_member = limits.groupBy(*_MEMBER).agg(F.sort_array(F.collect_list(F.struct("target", "t")))["t"].alias("ts"))
    # Members without a target left keep their place in the slice.
    places = members.select(*_SLICE, F.posexplode("items").alias("member", "item"))
    filled = places.join(per_member, _MEMBER, "left").withColumn("ts", F.coalesce("ts", F.array().cast(per_member.schema["ts"].dataType)))
    size, end = F.col("item.size"), F.lit(float("inf"))
    open_targets = F.filter("ts", lambda t: t["high"].isNull() | t["least"].isNull() | (t["least"] <= t["high"]))
    reach = F.array_min(F.transform(open_targets, lambda t: F.when(t["least"].isNull(), -end).when(
        size == 0, F.when(t["least"] <= 0, -end).otherwise(end)).otherwise((t["least"] - F.abs(t["least"]) * 1e-6) / size)))
    again = work_table(filled.groupBy(*_SLICE).agg(
        F.sort_array(F.collect_list(F.struct("member", "ts")))["ts"].alias("wanted"), F.min(reach).alias("reach")), "limits")
    rest = again.filter("reach is not null").select(*_SLICE, "reach").join(segments, ["n", "cluster"]).join(
        head, ["n", "cluster", "segment"], "left_anti").filter("top >= reach").select(*_SLICE, "segment")
    return _first(begun.unionByName(_walked(rest, members, again.drop("reach"), listed, same, count)), count)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, clusters: int = CLUSTERS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` (vec_id, label, vec) hold vectors of whole numbers; those that meet ``anchors`` are anchors. A score is the inner
    product with the anchor; larger ones come first, ties by smaller vec_id. An anchor's positives are the first other rows of its
    label; each positive's negatives are the first rows of another label with at least ``low`` per cent of its score, and no more
    than it.

    Rows with a null id, label or vector take no part; vectors of different lengths do not meet. Repeated rows stay rows: each is an
    anchor of its own, and the others are among its candidates. An anchor with fewer rows gives fewer, one without positives or
    negatives gives none; an empty table gives an empty result. Only the three columns are read. Scores have to fit into a long.
    """
    chosen = packed_rows(rows.filter(anchors))
    found = centres(chosen, clusters)
    assigned = members_of(chosen, found)
    members = work_table(in_slices(assigned), "members")
    cosines = assigned.filter(F.col("n").isin(*found)).groupBy("n", "cluster").agg(F.min("cosine").alias("cosine")).collect()
    widest = {(r.n, r.cluster): r.cosine for r in cosines}
    listed = work_table(lists(candidates(packed_rows(rows), max(positives + 1, negatives)), found, widest), "lists")
    nothing = F.lit(None).cast("bigint")
    target = lambda low, high: F.struct(low.alias("low"), high.alias("high"), nothing.alias("least"))
    all_of_them = members.select(*_SLICE, F.transform("items", lambda _: F.array(target(nothing, nothing))).alias("wanted"))
    near = work_table(_searched(members, all_of_them, listed, True, positives), "positives")

    floor = F.ceil(F.col("score").cast("decimal(38,0)") * low / 100).cast("bigint")
    windows = near.groupBy(*_MEMBER).agg(F.sort_array(F.collect_list(F.struct("rank", target(floor, F.col("score")).alias("t"))))["t"].alias("ts"))
    places = members.select(*_SLICE, F.posexplode("items").alias("member", "item"))
    filled = places.join(windows, _MEMBER, "left").select(*_MEMBER, F.coalesce("ts", F.array().cast(windows.schema["ts"].dataType)).alias("ts"))
    wanted = filled.groupBy(*_SLICE).agg(F.sort_array(F.collect_list(F.struct("member", "ts")))["ts"].alias("wanted"))
    hard = _searched(members, work_table(wanted, "windows"), listed, False, negatives)

    pairs = near.select(*_MEMBER, (F.col("rank") - 1).alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    every = places.select(*_MEMBER, F.col("item.vec_id").alias("anchor_id"), F.col("item.copies").alias("copies"))
    joined = hard.select(*_MEMBER, "target", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        pairs, [*_MEMBER, "target"]).join(every, _MEMBER)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
