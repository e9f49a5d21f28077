"""Best-fit packing by minimum bin slack: each bin gets the fullest combination of lengths that are left."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def fullest(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, each at most as often as ``left`` has it, whose sum is the largest that fits ``room``.

    Subset sums are the bits of one integer: adding a length shifts it. ``lengths`` is in descending order, so
    that large ones are used while small ones stay for later gaps.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        count, times = min(left[length], room // length), 1
        while count > 0:
            times = min(times, count)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            count -= times
            times *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            chosen += [length] * times
    return chosen


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) for all items; ``counts`` has the number of items by length.

    The longest item left opens a bin, the fullest combination of the others closes it, and both go. While the
    items last, the next bin would be filled alike, so the combination is taken as often as they allow. The work
    depends on the number of distinct lengths, at most ``capacity``, and not on the number of items.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths, patterns = sorted(left, reverse=True), []
    while lengths:
        top = lengths[0]
        left[top] -= 1
        chosen = [top, *fullest(left, lengths, capacity - top)]
        left[top] += 1
        used = Counter(chosen)
        times = min(left[k] // v for k, v in used.items())
        patterns.append((chosen, times))
        for k, v in used.items():
            left[k] -= v * times
        if any(not left[k] for k in used):
            lengths = [k for k in lengths if left[k]]
    return patterns


def pack(items: DataFrame, capacity: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """``items`` (doc_id, piece, length, more) with sequence_id and offset: the bin and the place in it.

    Only the counts by length, at most ``capacity`` rows, come to the driver. Items of one length are
    interchangeable: each gets its rank among them, counted in two steps (hashed buckets, then rows in a bucket), so
    that a length which many items have is not ranked in one task. The rank points into the bins that take this length.
    An item is from 1 to ``capacity`` long, else ValueError. Empty input gives an empty result. Columns named
    sequence_id, offset or those starting with ``_pack`` are replaced.
    """
    by_length = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(k is None or not 0 < k <= capacity for k in by_length):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    keys, firsts, bins, places, taken, next_bin = [], [], [], [], Counter(), 0
    for chosen, times in bin_patterns(by_length, capacity):
        at = 0
        for length in chosen:
            keys.append((length << 44) + taken[length])
            firsts.append(taken[length])
            bins.append(next_bin)
            places.append(at)
            taken[length] += times
            at += length
        next_bin += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    key, first, bin0, place = (np.array(x, dtype=np.int64)[order] for x in (keys, firsts, bins, places))

    n_buckets = max(4, -(-sum(by_length.values()) // rows_per_bucket))
    dealt = items.drop("sequence_id", "offset").withColumn(
        "_pack_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    before = (dealt.groupBy("length", "_pack_bucket").agg(F.count("*").alias("_pack_n"))
              .withColumn("_pack_base", F.sum("_pack_n").over(Window.partitionBy("length").orderBy("_pack_bucket"))
                          - F.col("_pack_n")).drop("_pack_n"))
    order_by = [c for c in dealt.columns if not c.startswith("_pack")]
    ranked = dealt.withColumn("_pack_row", F.row_number().over(
        Window.partitionBy("length", "_pack_bucket").orderBy("doc_id", "piece", *order_by))).join(before, ["length", "_pack_bucket"])
    numbered = ranked.withColumn("_pack_rank", F.col("_pack_base") + F.col("_pack_row") - 1).drop(
        "_pack_bucket", "_pack_row", "_pack_base")

    names = [c for c in numbered.columns if c != "_pack_rank"]

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.names.index("_pack_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(c)) for c in names), pa.array(bin0[at] + rank - first[at]), pa.array(place[at])],
                names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in numbered.drop("_pack_rank").dtypes)
    return numbered.mapInArrow(place_all, f"{fields}, sequence_id bigint, offset bigint")
