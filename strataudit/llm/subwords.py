"""SentencePiece encoding as a relational lattice, and decoding.

Texts are cut into parts wherever two neighbouring characters stand together in no piece, so no token crosses a cut. Parts are
slices of the texts' bytes, numbered by Arrow. They are counted and made distinct; all their substrings of bounded length meet the
piece table in an equi-join; the matches of a part are the edges of its lattice, which a fold turns into ids. The ids of the most
frequent parts go to every task, those of the others to the buckets of documents that hold them.
The fold merges neighbours by score: the public model is of that kind, and the path of the largest sum of scores (Viterbi) is
not what it encodes to. It needs a linked list and a heap to stay near-linear in the length of a part (a higher-order aggregate
copies its state at each step), so it is Python within a batch of parts.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataudit.llm.tokens import give_back
from strataudit.session import work_table

SPACE = "▁"
#: Characters of a part that are cut into substrings together.
BLOCK = 1024
#: Bits of an id in the number of an edge; those above, up to the 31st, are its length's.
ID_BITS = 21
#: Longer parts are grouped by their digest and are never in the table of frequent parts.
SHORT = 64
#: Parts, the most frequent ones, that every task has at hand (their text and ids are short, see ``SHORT``).
FREQUENT = 1 << 18
#: Bytes of parts that a task gathers until it sends them on.
HELD = 8_000_000
#: Characters that are cut and looked up together.
TOGETHER = 1_000_000
#: Characters whose neighbours are looked up together, which bounds the numbers that are held for them.
NEAR = 1 << 18
#: Characters of the documents of a bucket, about.
BUCKET = 4_000_000


class Pieces:
    """The normal pieces of a model file (piece, id, score); control, unknown and byte pieces are left out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rows = [(model.IdToPiece(i), i, float(model.GetScore(i))) for i in range(model.GetPieceSize())
                     if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))]
        self.longest, self.byte0 = max(len(p) for p, *_ in self.rows), model.PieceToId("<0x00>")
        self.form = "H" if model.GetPieceSize() <= 1 << 16 else "I"  # of ids while they are moved
        self.cutter = Cutter({p[k:k + 2] for p, *_ in self.rows for k in range(len(p) - 1)})

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (piece, id), as many as the vocabulary has; a space stands for the mark, as in parts."""
        return spark.createDataFrame([(p.replace(SPACE, " "), i) for p, i, _ in self.rows], "piece string, id int")


class Cutter:
    """Cuts texts between two characters that are not in ``pairs``, those that stand together in a piece.

    A text is cut with a space in front. Spaces and marks (``SPACE``) are the same; parts have spaces, which are shorter.
    """

    def __init__(self, pairs: set[str]):
        inside = any(b == SPACE != a for a, b in pairs)  # a piece goes on after a space: words are not cut there
        self.word = re.compile("(?s:.+)" if inside else f"{SPACE}+[^{SPACE}]*")
        sides = [sorted({p[side] for p in pairs}) for side in (0, 1)]
        self.row, self.column = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)  # of a character in ``together``; 0: in no pair
        for table, chars, step in ((self.row, sides[0], len(sides[1]) + 1), (self.column, sides[1], 1)):
            table[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1) * step
            table[ord(" ")] = table[ord(SPACE)]
        self.together = np.zeros((len(sides[0]) + 1) * (len(sides[1]) + 1), bool)
        for a, b in pairs:
            self.together[self.row[ord(a)] + self.column[ord(b)]] = True

    def words(self, text: str | None) -> list[str]:
        """The words of a space and the text, without the mark in front; null and empty texts have none."""
        return [w[1:] for w in self.word.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def parts(self, word: str) -> Iterator[str]:
        """The parts of one word, of any length."""
        yield from self.parts_of([word])[0]

    def parts_of(self, words: list[str]) -> list[list[str]]:
        """The parts of each word, with marks."""
        parts, places = self._divided([" " + w for w in words])
        parts = [p.replace(" ", SPACE) for p in parts.to_pylist()]
        return [parts[a:b] for a, b in zip(places, places[1:])]

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of all texts, and where each text's begin among them and the last one's end; an empty text has none."""
        return self._divided([t and " " + t for t in texts])

    def _divided(self, marked: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        whole = "".join(marked).replace(SPACE, " ")
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked], dtype=np.int64)])
        data, cuts, places, size = [], [], [], 0
        for at in range(0, len(whole), NEAR):
            near = whole[at:at + NEAR]
            codes = np.frombuffer(whole[max(at - 1, 0):at + NEAR].encode("utf-32-le"), "<u4")  # with the one before
            apart = np.ones(len(near), bool)  # from the character before; the first one is
            apart[len(near) - len(codes) + 1:] = ~self.together[self.row[codes[:-1]] + self.column[codes[1:]]]
            first, last = np.searchsorted(bounds, (at, at + len(near)))
            apart[bounds[first:last] - at] = True
            found, raw = np.flatnonzero(apart), near.encode("utf-8")
            cuts.append(found + at)
            if len(raw) > len(near):
                found = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[found]  # the places of their first bytes
            places.append(found + size)
            data.append(raw)
            size += len(raw)
        cuts, places = (np.concatenate([*c, [end]]) for c, end in ((cuts, len(whole)), (places, size)))
        parts = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(b"".join(data)))
        return parts, np.searchsorted(cuts, bounds)


def merged(word: str, edges: dict[tuple[int, int], tuple[float, int]], byte0: int) -> list[int]:
    """Ids of a word: of the edges (start, end) that join two neighbouring tokens the one of the best score, then the leftmost, is
    taken, until none is left. A character without a piece gives the pieces of its bytes."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts here; an end of 0: no token does
    heap = [(-edges[k, k + 2][0], k, k + 1, k + 2) for k in range(n - 1) if (k, k + 2) in edges]
    heapq.heapify(heap)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or end[middle] != stop:  # one of the two has been merged since
            continue
        end[start], end[middle] = stop, 0
        if stop < n:
            before[stop] = start
            if (found := edges.get((start, end[stop]))):
                heapq.heappush(heap, (-found[0], start, stop, end[stop]))
        if start and (found := edges.get((before[start], stop))):
            heapq.heappush(heap, (-found[0], before[start], start, stop))
    ids, at = [], 0
    while at < n:
        found = edges.get((at, end[at]))
        ids += [found[1]] if found else [byte0 + b for b in word[at].encode("utf-8")]
        at = end[at]
    return ids


def _portions(texts: Iterable[str | None], size: int = TOGETHER) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of portions of about ``size`` characters; null is empty. Texts are taken one by one."""
    at, portion, total = 0, [], 0
    for text in texts:
        portion.append(text or "")
        total += len(portion[-1])
        if total > size:
            yield at, portion
            at, portion, total = at + len(portion), [], 0
    if portion:
        yield at, portion


def _values(column: pa.Array) -> Iterator[str | None]:
    """The values one by one, so that no second copy of all texts of a batch is made."""
    return (v.as_py() for v in column)


def _gathered(tables: Iterable[pa.Table], keys: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``tables``, grouped as far as they are held together (``HELD``); sorted, as neighbours with a common start take less room."""
    held, size = [], 0

    def grouped() -> pa.Table:
        found = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
        return found.select([*keys, *(f"{c}_sum" for c in sums)]).rename_columns([*keys, *sums])

    for table in tables:
        held.append(table)
        size += table.nbytes
        if size > HELD:
            held[:] = [grouped()]
            size = held[0].nbytes
            if size > HELD // 2:
                yield from held[0].sort_by("part").combine_chunks().to_batches()
                held.clear()
                size = 0
    if held:
        yield from grouped().sort_by("part").combine_chunks().to_batches()


def part_counts(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """Rows (part, n) of all whole texts; a part may come several times, with a share of its number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for _, texts in _portions(_values(batch.column(0))):
                parts = cutter.cut(texts)[0].dictionary_encode()
                n = np.bincount(parts.indices.to_numpy(), minlength=len(parts.dictionary))
                yield pa.table({"part": parts.dictionary.cast(pa.string()), "n": pa.array(n, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(counted(batches), ["part"], ["n"])
        give_back()

    return docs.select("text").mapInArrow(count, "part string, n bigint")


def encode_parts(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows (part, n, ids) of the distinct ones of ``counts`` (part, n); ids are little-endian numbers of the form ``pieces.form``.

    A long part goes by its digest and is cut in blocks, so that it is neither copied for each of its substrings nor read from
    its start for each. The edges of a part come together where the part lies, without another shuffle.
    """
    long = F.char_length("part") > SHORT
    known = counts.select(F.when(long, F.sha2("part", 512)).otherwise(F.col("part")).alias("key"), F.when(long, F.col("part")).alias("long"), "n")
    known = known.repartition("key").groupBy("key", "long").agg(F.sum("n").alias("n"))  # dealt by key alone, as the edges are grouped
    blocks = known.select("key", "n", F.explode(F.expr(f"sequence(0, CAST((length(coalesce(long, key)) - 1) div {BLOCK} AS int) * {BLOCK}, {BLOCK})")).alias("base"), "long")
    blocks = blocks.select("key", "n", "base", F.expr(f"substring(coalesce(long, key), base + 1, {BLOCK + pieces.longest})").alias("chars"), F.when(F.col("base") == 0, F.col("long")).alias("long"))
    starts = blocks.select("*", F.explode(F.expr(f"sequence(1, least({BLOCK}, length(chars)))")).alias("at")).select(
        "key", "n", (F.col("base") + F.col("at") - 1).alias("start"), F.expr(f"substring(chars, at, {pieces.longest})").alias("near"), F.when(F.col("at") == 1, F.col("long")).alias("long"))
    cut = starts.select("*", F.explode(F.expr("sequence(1, length(near))")).alias("m")).select(
        "key", "n", "start", (F.col("start") + F.col("m")).alias("end"), F.expr("substring(near, 1, m)").alias("piece"), F.when(F.col("m") == 1, F.col("long")).alias("long"))
    met = cut.join(F.broadcast(pieces.table(counts.sparkSession)), "piece", "left").filter("id is not null or (start = 0 and end = 1)")
    # an edge is one number, of its start, length and id; a part without any keeps the row of its first character
    edge = F.expr(f"shiftleft(CAST(start AS bigint), 31) + shiftleft(end - start, {ID_BITS}) + id")
    lattice = met.select("key", "long", "n", edge.alias("edge")).groupBy("key").agg(
        F.first("long", ignorenulls=True).alias("long"), F.first("n").alias("n"), F.collect_list("edge").alias("edges"))  # no nulls
    scores, byte0, form = {i: score for _, i, score in pieces.rows}, pieces.byte0, pieces.form

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, edges = batch.column(0).to_pylist(), batch.column(2).flatten().to_numpy()
            starts, lengths, ids = edges >> 31, edges >> ID_BITS & (1 << 31 - ID_BITS) - 1, edges & (1 << ID_BITS) - 1
            starts, ends, ids = starts.tolist(), (starts + lengths).tolist(), ids.tolist()
            places, found = batch.column(2).offsets.to_pylist(), []
            for part, a, b in zip(parts, places, places[1:]):
                a, b = a - places[0], b - places[0]
                own = {(s, e): (scores[i], i) for s, e, i in zip(starts[a:b], ends[a:b], ids[a:b])}
                found.append(array(form, merged(part.replace(" ", SPACE), own, byte0)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["part", "n", "ids"])
        give_back()

    return lattice.select(F.coalesce("long", "key").alias("part"), "n", "edges").mapInArrow(fold, "part string, n bigint, ids binary")


def frequent_parts(known: DataFrame, limit: int) -> pa.Table:
    """Rows (part, ids) of the most frequent short parts, at most ``limit``: those above a step of frequency."""
    step = F.floor(F.log2("n") * 8)
    short = known.filter(F.char_length("part") <= SHORT).withColumn("step", step)
    total, least = 0, None
    for row in sorted(short.groupBy("step").count().collect(), reverse=True):  # at most 64 * 8 steps
        total += row["count"]
        if total > limit:
            break
        least = row["step"]
    if least is None:
        return pa.table({"part": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})
    return short.filter(F.col("step") >= least).select("part", "ids").toArrow()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a string or binary column begins and the last one ends, and all bytes."""
    if not len(column):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1], np.frombuffer(data or b"", np.uint8)


class Known:
    """Ids of parts; ``tables`` (part, ids) are looked into one after another."""

    def __init__(self, form: str, *tables: pa.Table):
        self.parts, flat, lengths = [], [], []
        for table in tables:
            offsets, data = _bytes(table["ids"].combine_chunks())
            self.parts.append(table["part"].combine_chunks().cast(pa.large_string()))
            flat.append(data[offsets[0]:offsets[-1]].view(form))
            lengths.append(np.diff(offsets) // flat[-1].itemsize)
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def places(self, parts: pa.LargeStringArray) -> np.ndarray:
        """Of each part; -1: it is in no table."""
        found, base = np.full(len(parts), -1, np.int64), 0
        for table in self.parts:
            left = np.flatnonzero(found < 0)
            at = pc.index_in(parts.take(pa.array(left)), table).fill_null(-1).to_numpy().astype(np.int64)
            found[left] = np.where(at < 0, -1, at + base)
            base += len(table)
        return found

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at ``places``, one after another, and where those of each place begin and the last ones end."""
        lengths = self.lengths[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.starts[places] - ends[:-1], lengths) + np.arange(ends[-1])], ends


def rare_parts(dealt: DataFrame, pieces: Pieces, frequent) -> DataFrame:
    """Rows (bucket, part): the parts of ``dealt`` (bucket, text) that are not in the broadcast table ``frequent``."""
    cutter, form = pieces.cutter, pieces.form

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        common = Known(form, frequent.value)
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            for first, texts in _portions(_values(batch.column(1))):
                parts, places = cutter.cut(texts)
                parts = parts.dictionary_encode()
                rare = common.places(parts.dictionary) < 0
                codes = parts.indices.to_numpy()
                at = np.flatnonzero(rare[codes])
                owners = buckets[first + np.searchsorted(places, at, "right") - 1]
                yield pa.table({"bucket": owners, "part": parts.dictionary.take(pa.array(codes[at])).cast(pa.string())})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(found(batches), ["bucket", "part"], [])
        give_back()

    return dealt.select("bucket", "text").mapInArrow(look, "bucket bigint, part string")


def packed_texts(dealt: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, row, data) of ``dealt`` (bucket, doc_id, row, text): the texts are compressed, as they are shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            made = pa.array([compress(t.encode("utf-8")) if t else None for t in _values(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["bucket", "doc_id", "row", "data"])
        give_back()

    return dealt.select("bucket", "doc_id", "row", "text").mapInArrow(pack, "bucket bigint, doc_id bigint, row bigint, data binary")


def packed_parts(rare: DataFrame) -> DataFrame:
    """Rows (bucket, data) of ``rare`` (bucket, part, ids): what a task has for a bucket is one row, compressed (``unpacked_parts``)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            order = np.argsort(table["bucket"].to_numpy(), kind="stable")
            table = table.take(pa.array(order)).combine_chunks()
            buckets = table["bucket"].to_numpy()
            (ends, parts), (stops, ids) = (_bytes(table[c].combine_chunks()) for c in ("part", "ids"))
            starts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
            made = [compress(b"".join([(b - a).to_bytes(4, "little"), *(np.diff(o[a:b + 1]).astype("<u4").tobytes() for o in (ends, stops)),
                                       parts[ends[a]:ends[b]].tobytes(), ids[stops[a]:stops[b]].tobytes()]))
                    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)])]
            return pa.RecordBatch.from_arrays([pa.array(buckets[starts]), pa.array(made, pa.binary())], names=["bucket", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > HELD:
                yield rows()
                held.clear()
                size = 0
        if held:
            yield rows()
        give_back()

    return rare.select("bucket", "part", "ids").mapInArrow(pack, "bucket bigint, data binary")


def unpacked_parts(data: bytes) -> pa.Table:
    """Rows (part, ids) of one row of ``packed_parts``, whose data is no longer compressed."""
    n = int.from_bytes(data[:4], "little")
    offsets = np.zeros((2, n + 1), np.int32)
    offsets[:, 1:] = np.cumsum(np.frombuffer(data, "<u4", 2 * n, 4).reshape(2, n), axis=1)
    columns, at = [], 4 + 8 * n
    for own, kind in zip(offsets, (pa.string(), pa.binary())):
        columns.append(pa.Array.from_buffers(kind, n, [None, pa.py_buffer(own.copy()), pa.py_buffer(data[at:at + own[-1]])]))
        at += own[-1]
    return pa.Table.from_arrays(columns, names=["part", "ids"])


def put_together(gathered: DataFrame, pieces: Pieces, frequent) -> DataFrame:
    """Rows (doc_id, row, ids) of the documents of ``gathered`` (bucket, kind, doc_id, row, data).

    Rows lie by bucket, in it first the rare parts with their ids (kind 0), then the documents (kind 1), both packed.
    """
    cutter, form = pieces.cutter, pieces.form

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, rare, known = zstandard.ZstdDecompressor().decompress, None, [], None
        none = frequent.value.slice(0, 0)

        def encoded(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in _portions(t and unpack(t).decode("utf-8") for t in _values(docs.column("data"))):
                parts, bounds = cutter.cut(texts)
                parts = parts.dictionary_encode()
                places = known.places(parts.dictionary)
                if (places < 0).any():
                    raise KeyError(f"parts without ids: {parts.dictionary.filter(pa.array(places < 0))[:5].to_pylist()}")
                ids, ends = known.ids(places[parts.indices.to_numpy()])
                lists = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids.astype(np.int32)))
                own = docs.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("row"), lists], names=["doc_id", "row", "ids"])

        for batch in batches:
            buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(buckets)]):
                if a == b:
                    continue
                if buckets[a] != now:
                    now, rare, known = buckets[a], [none], None
                rows = batch.slice(a, b - a)
                if not kinds[a]:
                    rare += [unpacked_parts(unpack(data)) for data in _values(rows.column("data"))]
                    continue
                known = known or Known(form, frequent.value, pa.concat_tables(rare))
                yield from encoded(rows)
        give_back()

    return gathered.mapInArrow(join, "doc_id bigint, row bigint, ids array<int>")


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT, bucket: int = BUCKET) -> DataFrame:
    """Rows (doc_id, row, ids) of all documents, whole texts; null and empty texts have no ids.

    ``row`` tells rows with one doc_id apart (a hash of the text); equal rows come as often as they are there. Null doc_ids are
    rows like others, an empty table gives an empty result. Other columns are not read.
    The ``frequent`` most frequent parts would be the hot keys of a join, so they go to every task; a part that is left is a
    small share of all. Documents are dealt to buckets of about ``bucket`` characters.
    """
    pieces = Pieces(path)
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    known = work_table(encode_parts(part_counts(texts, pieces.cutter), pieces), "parts")
    size = known.agg(F.sum(F.col("n") * F.char_length("part"))).first()[0] or 0
    held = docs.sparkSession.sparkContext.broadcast(frequent_parts(known, frequent))
    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // bucket)))
    rare = packed_parts(rare_parts(dealt, pieces, held).join(known.select("part", "ids"), "part"))
    none = F.lit(None).cast("bigint")
    gathered = packed_texts(dealt).select("bucket", F.lit(1).alias("kind"), "doc_id", "row", "data").unionByName(
        rare.select("bucket", F.lit(0).alias("kind"), none.alias("doc_id"), none.alias("row"), "data"))
    return put_together(gathered.repartition("bucket").sortWithinPartitions("bucket", "kind"), pieces, held)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids, more) with ``text``: pieces and bytes one after another, the space in front taken off."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    shown = [f"{i - model.PieceToId('<0x00>'):02X}" if model.IsByte(i) else model.IdToPiece(i).replace(SPACE, " ").encode().hex().upper()
             for i in range(model.GetPieceSize())]
    table = encoded.sparkSession.createDataFrame([(shown,)], "shown array<string>")
    joined = encoded.join(F.broadcast(table))  # one row
    code = F.array_join(F.transform("ids", lambda i: F.element_at("shown", i + 1)), "")
    return joined.withColumn("text", F.regexp_replace(F.decode(F.unhex(code), "UTF-8"), "^ ", "")).drop("shown")
