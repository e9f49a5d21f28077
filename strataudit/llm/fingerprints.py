"""SimHash fingerprints of documents, with DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataudit.session import work_table

#: Bits of a fingerprint: two hashes of 64 bits vote.
BITS = 128
_LANES = 0x0000000100000001


def term_hashes(text: Column, width: int = 2) -> Column:
    """Hashes of all runs of ``width`` words of the lower-cased text; with fewer words, of the words at all."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = F.zip_with(hashed, F.slice(hashed, 2, F.greatest(F.size(hashed), F.lit(1))), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(0).cast("bigint"))))
    return F.when(F.size(hashed) > 1, F.slice(runs, 1, F.size(hashed) - 1)).otherwise(hashed)


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, fingerprint): ``BITS`` bits as hexadecimal text, for rows (keys, text); ``keys`` tell rows apart.

    Each term votes on every bit by its hash, with the number of its occurrences as weight. Votes are counted in
    pairs, two 32-bit lanes to a number, before rows leave their task. A text without words has no votes: all zero.
    Equal texts have equal fingerprints. A tie gives the bit 0.
    """
    exploded = texts.select(*keys, F.explode_outer(term_hashes(F.coalesce("text", F.lit("")))).alias("h"))
    hashes = exploded.select(*keys, F.col("h").alias("h0"), F.xxhash64("h", F.lit(1)).alias("h1"))
    votes = [F.sum(F.when(F.col("h0").isNotNull(), F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(_LANES)))).alias(f"v{k}_{i}")
             for k in (0, 1) for i in range(32)]
    counted = hashes.groupBy(*keys).agg(F.count("h0").alias("n"), *votes)

    def word(k: int, lane: int) -> Column:
        total = F.lit(0).cast("bigint")
        for i in range(32):
            ones = F.shiftrightunsigned(f"v{k}_{i}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            total = total + F.when(2 * ones > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0))
        return F.lpad(F.lower(F.hex(F.coalesce(total, F.lit(0).cast("bigint")))), 8, "0")

    return counted.select(*keys, F.concat(word(0, 1), word(0, 0), word(1, 1), word(1, 0)).alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    parts = [F.bit_count(F.conv(F.substring(a, at, 8), 16, 10).cast("bigint").bitwiseXOR(F.conv(F.substring(b, at, 8), 16, 10).cast("bigint")))
             for at in range(1, BITS // 4, 8)]
    return sum(parts[1:], parts[0])


def likeness(a: Column, b: Column) -> Column:
    """From 0 (all bits differ, or more than half) to 1 (equal): the cosine that the share of equal bits stands for."""
    return F.greatest(F.lit(0.0), 1 - 2 * distance(a, b) / F.lit(float(BITS)))


def within(fingerprinted: DataFrame, radius: int = 3, blocks: int = 8) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints, a < b, that differ in at most ``radius`` bits; none is missed.

    Fingerprints are cut into ``blocks``. Two within the radius agree in all but ``radius`` blocks, so for each choice of
    that many blocks a table is keyed by the others, moved to the front. Documents with one fingerprint are one row here.
    """
    width, distinct = BITS // 4 // blocks, fingerprinted.filter("fingerprint is not null").select("fingerprint").distinct()
    tables = [F.struct(F.lit(k).alias("table"), F.concat(*[F.substring("fingerprint", 1 + width * b, width) for b in kept]).alias("key"))
              for k, kept in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = distinct.select("fingerprint", F.explode(F.array(*tables)).alias("t")).select("t.table", "t.key", F.col("fingerprint"))
    pairs = keyed.withColumnRenamed("fingerprint", "a").join(keyed.withColumnRenamed("fingerprint", "b"), ["table", "key"]).filter("a < b")
    return pairs.select("a", "b", distance(F.col("a"), F.col("b")).alias("distance")).filter(F.col("distance") <= radius).distinct()


def with_next(docs: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_id`` and ``next_text`` of the next row by doc_id, after the last the first, and ``row``.

    ``row`` numbers the rows of a range; with doc_id it tells all rows apart, as a doc_id is in one range.
    Rows are dealt to ranges of doc_id at percentiles; inside a range ``lead`` gives the next row, and the last row of
    a range gets the first row of the next one, of which there is one a range.
    """
    n = docs.count()
    shares = [k / max(1, -(-n // rows_per_range)) for k in range(1, max(1, -(-n // rows_per_range)))]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    place = F.lit(0)
    if bounds:
        place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))), F.lit(0))
    ranged = docs.withColumn("range", place)
    order = Window.partitionBy("range").orderBy("doc_id", "text")  # equal rows stay rows: each has its own next
    led = ranged.withColumns({"row": F.row_number().over(order), "next_text": F.lead("text").over(order), "next_id": F.lead("doc_id").over(order),
                              "last": F.lead(F.lit(1)).over(order).isNull()})
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    every = Window.orderBy("range")
    after = firsts.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(
        every.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    return led.join(after, "range").select(
        "doc_id", "text", "row", F.when(F.col("last"), F.col("after.doc_id")).otherwise(F.col("next_id")).alias("next_id"),
        F.when(F.col("last"), F.col("after.text")).otherwise(F.col("next_text")).alias("next_text"))


def compare(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of all documents.

    The edited text has its last quarter of code points replaced by as many first ones of the next document by doc_id.
    A null text counts as empty. Rows with one doc_id follow each other by text; a null doc_id comes first; a lone
    row is its own next. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = with_next(texts).select(
        "doc_id", "row", F.xxhash64("text").alias("hash"), "next_id", F.xxhash64("next_text").alias("next_hash"), n.cast("bigint").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text")),
                                                                     F.struct(F.lit(1).alias("v"), edited.alias("text")))).alias("t"))
    keys = ["doc_id", "row", "hash", "next_id", "next_hash", "n_chars", "edited_sha256"]
    found = fingerprints(rows.select(*keys, "t.v", "t.text"), [*keys, "v"])
    both = found.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("fingerprint"))).alias("fingerprint"),
                                    F.max(F.when(F.col("v") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    both = work_table(both, "fingerprints")
    following = both.select(F.col("doc_id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("fingerprint").alias("next")).distinct()
    joined = both.join(following, both["next_id"].eqNullSafe(following["next_id"]) & (both["next_hash"] == following["next_hash"]))
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                         likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
