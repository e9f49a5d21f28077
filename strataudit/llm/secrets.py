"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in long unbroken strings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The patterns of the three base kinds and the shortest match of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

#: Unbroken strings in which windows are measured.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)
WINDOW = 20
#: Least entropy, in bits a character, of a window by the class of its characters.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.7}
#: What is never a secret: uuids, words joined by hyphens, underscores or slashes, plain words. Words are in one case, capitalised or
#: in camel case with parts of three letters and more, as keys of letters only are not.
ALLOW = tuple(re.compile(p, re.ASCII) for p in (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[-_/=+]*({0})([-_/=+]+({0}))*[-_/=+]*".format(r"[a-z]+|[A-Z]+|[a-z]*([A-Z][a-z]{2,})+|[A-Z][a-z]?"),
    r"(/?[a-z]+[-_/]|/?[a-z]*[0-9]{1,4}[-_/])+([a-z]+|[0-9]{1,4})?",
    r"[0-9+/_=-]*",
))
#: Samples and placeholders: the part between / and = that has such a word is no secret, the parts beside it are judged.
SAMPLE = re.compile(r"example|sample|placeholder|changeme|dummy|redacted", re.IGNORECASE | re.ASCII)
PART = re.compile(r"[^/=]+")
_STEP = [n * log2(n) if n else 0.0 for n in range(WINDOW + 2)]


def character_class(text: str) -> str:
    if all(c in "0123456789abcdef" for c in text) or all(c in "0123456789ABCDEF" for c in text):
        return "hex"
    return "alphanumeric" if text.isalnum() else "base64"


def entropy_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Joined windows of ``text`` whose entropy reaches the threshold of its character class.

    One character enters and one leaves at each step, so only two counts change: sum(n * log2 n) follows, and the
    entropy is log2(window) minus that sum over the window.
    """
    least, counts, total, spans = thresholds[character_class(text)], {}, 0.0, []
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _STEP[n + 1] - _STEP[n]
        if k >= window:
            old = text[k - window]
            n = counts[old]
            counts[old] = n - 1
            total += _STEP[n - 1] - _STEP[n]
        if k >= window - 1 and log2(window) - total / window >= least - 1e-9:
            start = k - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((start, k + 1))
    return spans


_LONG = re.compile(r"[0-9a-f]{16}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    folded = text.lower()
    if any(w in folded for w in ("passw", "secret", "token", "api_key", "apikey")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    if _LONG.search(text):
        found += [(*m.span(), "hex") for m in HEX.finditer(text) if len(m[0]) >= SHORTEST["hex"]]
    return found


def unbroken(text: str) -> Iterator[tuple[int, str]]:
    """(start, string) of what windows are measured in: unbroken strings, cut where samples and placeholders stand."""
    for m in CANDIDATE.finditer(text):
        at = 0
        if SAMPLE.search(m[0]):
            for part in PART.finditer(m[0]):
                if SAMPLE.search(part[0]):
                    yield m.start() + at, m[0][at:part.start()]
                    at = part.end()
        yield m.start() + at, m[0][at:]


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start, then kind in the order of ``KINDS``.

    Base matches are leftmost and do not overlap within a kind; too short ones are dropped after matching. Entropy
    spans are added unless an allow-listed form covers the string or a base span covers them.
    """
    found = base_spans(text)
    for first, string in unbroken(text):
        if not any(a.fullmatch(string) for a in ALLOW):
            for start, end in entropy_spans(string):
                start, end = start + first, end + first
                if not any(s <= start and end <= e for s, e, k in found if k != "entropy"):
                    found.append((start, end, "entropy"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "[secret]") -> str:
    """``text`` with each run of overlapping spans replaced once."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans) of all documents.

    A null text counts as empty and has no spans. Whole texts are scanned; the time grows with the length. Repeated
    rows and null doc_ids give a row each. Only doc_id and text are read. An empty table gives an empty result.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in secret_spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=_SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets in ``text`` masked and ``n_chars``, if there is one, counted anew; null texts stay null."""
    at = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, secret_spans(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = docs.mapInArrow(replace, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the joined spans, and a digest of the base ones."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
