"""Licences named in texts: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the licence expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further wordings of licence notices, in words, and their labels.
NOTICES = {
    "apache license 2 0": "apache-2",
    "apache software license": "apache-2",
    "boost software license": "bsl-1.0",
    "cc0 1 0 universal": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "the mit license": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

# Identifiers that an expression may hold, by what they oblige to: nothing but a notice (0), open changes of the
# covered files (1), open derived works (2), no commercial use or no changes (3).
LICENSES = {name: level for level, names in enumerate((
    "0bsd apache-1.1 apache-2 artistic-2.0 bsd bsd-2-clause bsd-3-clause bsl-1.0 cc-by cc-by-4.0 cc0-1.0 isc mit mit-0 ncsa postgresql "
    "python-2.0 unicode-3.0 unlicense wtfpl zlib",
    "cddl-1.0 epl epl-1.0 epl-2.0 lgpl lgpl-2.0 lgpl-2.1 lgpl-3.0 mpl mpl-1.1 mpl-2.0",
    "agpl agpl-3.0 cc-by-sa cc-by-sa-4.0 eupl-1.2 gpl gpl-1.0 gpl-2.0 gpl-3.0 osl-3.0",
    "cc-by-nc cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0",
)) for name in names.split()}
ALIASES = {"apache-2.0": "apache-2"}
#: Exceptions that let other works link or be built freely: they lower what is obliged by one.
EXCEPTIONS = ("autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "gcc-exception-3.1", "linux-syscall-note",
              "llvm-exception")
#: Words of the tags that an expression follows after a colon, an equals sign or quotes.
TAGS = ("spdx license identifier", "license expression", "license")
#: How sure a finding makes us that its licence is meant.
WEIGHTS = {"base": 0.8, "notice": 0.7, "tag": 0.95}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_TO_WORDS = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))
_AFTER_TAG = re.compile(r"""["']?[ \t]*[:=][ \t]*["'(]*?(?=[(a-z0-9])""", re.ASCII)
_TOKEN = re.compile(r"[ \t]*(?:([()/])|([a-z0-9][a-z0-9.+:-]*))", re.ASCII)
_RANK = {"or": 1, "/": 1, "and": 2, "with": 3}


def words(text: str) -> list[str]:
    """The words of a text: A-Z lower-cased, cut at whatever is neither a figure, a letter a-z, nor beyond ASCII."""
    return WORD.findall(text.translate(_LOWER))


@lru_cache(maxsize=1)
def automaton():
    """All phrases and tags as one automaton over words that are set apart by blanks."""
    import ahocorasick

    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            kinds.setdefault(phrase, []).append((kind, label))
    made = ahocorasick.Automaton()
    for phrase, found in kinds.items():
        made.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, found))
    made.make_automaton()
    return made


def phrases_in(line: str) -> Iterator[tuple[int, int, str, str]]:
    """(first word, words, kind, label) of all places in ``line``, words with one blank around each."""
    place, at = -1, 0
    for end, (size, n, found) in automaton().iter(line):
        start = end - size + 1
        if start >= at:
            place += line.count(" ", at, start + 1)
            first = place
        else:
            first = place - line.count(" ", start + 1, at)
        at = max(at, start + 1)
        for kind, label in found:
            yield first, n, kind, label


def licence(name: str) -> tuple[str, int] | None:
    """Label and obligation of one identifier; versions "or later" and "only" count as the version. None if it is not known."""
    plain = re.sub(r"(-only|-or-later|\+)\Z", "", name)
    plain = ALIASES.get(plain, plain)
    if plain in LICENSES:
        return plain, LICENSES[plain]
    return (plain, 3) if plain.startswith(("licenseref-", "documentref-")) else None


def tokens_of(text: str, at: int = 0) -> Iterator[str]:
    while m := _TOKEN.match(text, at):
        yield m[1] or m[2]
        at = m.end()


def evaluate(tokens: Iterator[str]) -> tuple[frozenset[str], int] | None:
    """Labels and obligation of a licence expression, by the shunting-yard method; None if it is not one.

    ``with`` binds closest, then ``and``, then ``or`` (also written ``/``). Of alternatives the least obligation counts, of joint
    licences the largest. The expression ends where a token cannot continue it, so words that follow on the line do no harm; an
    operator left without a licence behind it, an unclosed bracket or an unknown name make it none. Works without recursion.
    """
    values: list[tuple[frozenset[str], int]] = []
    waiting: list[str] = []

    def apply() -> None:
        operator, (right, b), (left, a) = waiting.pop(), values.pop(), values.pop()
        if operator == "with":
            values.append((left, max(a - 1, 0) if a < 3 else a))
        else:
            values.append((left | right, max(a, b) if operator == "and" else min(a, b)))

    operand = True
    for token in tokens:
        if operand:
            if token == "(":
                waiting.append(token)
                continue
            if waiting and waiting[-1] == "with":
                known = (frozenset(), 0) if token in EXCEPTIONS else None
            else:
                known = (frozenset([found[0]]), found[1]) if (found := licence(token)) else None
            if known is None:
                return None
            values.append(known)
            operand = False
        elif token in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                apply()
            waiting.append(token)
            operand = True
        elif token == ")" and "(" in waiting:
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        else:
            break
    if operand:
        return None
    while waiting:
        if waiting[-1] == "(":
            return None
        apply()
    return values[0]


def findings(text: str) -> tuple[int, list[tuple[str, int, int, str, int]]]:
    """Number of words, and (kind, first word, words, label, obligation) by first word.

    All places of base phrases count, also overlapping ones. A notice inside a longer phrase is left out. A tag gives a finding for
    each licence of its expression, with the obligation of the whole.
    """
    known = text.encode("utf-8", "replace").translate(_TO_WORDS).split()
    line = f" {b' '.join(known).decode('utf-8')} " if known else ""
    found = []
    places, reached = None, 0
    for first, n, kind, label in sorted(phrases_in(line), key=lambda x: (x[0], -x[1], x[2])):
        if kind == "tag":
            if places is None:
                folded = text.translate(_LOWER)
                places = [m.end() for m in WORD.finditer(folded)]
            opened = _AFTER_TAG.match(folded, places[first + n - 1])
            value = evaluate(tokens_of(folded, opened.end())) if opened else None
            if value:
                found += [("tag", first, n, x, value[1]) for x in sorted(value[0])]
        else:
            if kind == "base" or first + n > reached:
                found.append((kind, first, n, label, LICENSES[label]))
            reached = max(reached, first + n)
    return len(known), sorted(set(found), key=lambda x: (x[1], x[0], x[2:]))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string()),
                             ("obligation", pa.int32())]))
_NAMES = _FOUND.value_type.names


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, found) of all documents.

    A null text counts as empty: no words, nothing found. Whole texts are read, one at a time; time and memory grow with the
    length of one text. Repeated rows and null doc_ids give a row each. Only doc_id and text are read, so other columns may have
    any names. An empty table gives an empty result.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = [], []
            for text in batch.column(1):
                n, hits = findings(text.as_py() or "")
                numbers.append(n)
                found.append([dict(zip(_NAMES, h)) for h in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(found, _FOUND)],
                                             names=["doc_id", "n_words", "found"])

    item = "kind:string,first_word:bigint,words:bigint,label:string,obligation:int"
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id bigint, n_words bigint, found array<struct<{item}>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and places of base phrases, labels, ``score`` and the obligation of all licences together (null without any).

    The score is the chance that at least one finding means its licence, were findings independent: 0 without any.
    """
    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    base = F.filter("found", lambda x: x["kind"] == "base")
    starts = F.transform(base, lambda x: x["first_word"])
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    doubt = F.aggregate("found", F.lit(1.0), lambda left, x: left * (1 - weight[x["kind"]]))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        (1 - doubt).alias("score"), F.array_max(F.transform("found", lambda x: x["obligation"])).alias("obligation"))
