"""Token ids of whole texts, with a public tokenizer file that is given by its path."""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataudit.llm.alignment import byte_alphabet

#: Signs of which normalising leaves or lower-cases letters one by one: ASCII without controls, white space, letters of Latin-1.
_HARD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]+")
#: How a tokenizer has to cut and normalise, so that marks can stand for its cuts.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CONTRACTED = re.compile(rb"'(?:[stmd]|re|ve|ll)")
#: Controls that are not in texts without hard signs: the end of a text, and a place of ids that the library makes.
_END, _HOLE = "\x00", "\x01"
_SPACE, _LETTER, _FIGURE, _SIGN = range(4)
_LOWER = np.array([32 if 9 <= c <= 13 else ord(chr(c).lower()) for c in range(256)], np.uint8)
_KINDS = np.array([_SPACE if c == 32 else _FIGURE if 48 <= c <= 57 else _LETTER if chr(c).isalpha() else _SIGN for c in range(256)], np.uint8)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
_ROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def spaced(text: bytes) -> bytes:
    """A Latin-1 text in lower case with a space wherever the tokenizer cuts (see ``_CUTS``); all white space is a space."""
    codes = _LOWER[np.frombuffer(text, np.uint8)]
    kinds, out = _KINDS[codes], codes.tobytes()
    left, right = kinds[:-1], kinds[1:]
    cut = (left != right) & (left != _SPACE) & (right != _SPACE) | (left == _FIGURE) & (right == _FIGURE)
    for found in _CONTRACTED.finditer(out):
        start, end = found.span()
        if not start or kinds[start - 1] != _SIGN:  # else the quote goes with the signs before it
            cut[start] = False
            if end < len(out):
                cut[end - 1] = kinds[end] != _SPACE
    at = np.flatnonzero(cut)
    if not len(at):
        return out
    wide = np.full(len(codes) + len(at), 32, np.uint8)
    kept = np.ones(len(wide), bool)
    kept[at + np.arange(1, len(at) + 1)] = False
    wide[kept] = codes
    return wide.tobytes()


class WordEncoder:
    """Ids of texts for a tokenizer that cuts at white space, lower-cases and never joins words.

    For such a tokenizer the ids of a text are the ids of its words, one after another. Where all signs of a word are plain
    ones, its cuts are marked with spaces, which stand for the end of a word in the vocabulary, and the merges are done by
    ``tiktoken``. Other words are given to the library itself, each distinct one once; ``limit`` bounds those that are kept,
    beyond it the store starts anew. Ids are unsigned little-endian 32-bit numbers.
    """

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.merges = self._merges(json.load(f))

    @staticmethod
    def _merges(file: dict):
        """The vocabulary as ``tiktoken`` has it; None if the tokenizer is of another form, so that the library does it all."""
        import tiktoken

        model, normal, first = file["model"], file["normalizer"] or {}, (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        merges, suffix = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["end_of_word_suffix"]
        made = [model["vocab"]["".join(m)] for m in merges]
        if normal.get("normalizers") != _NORMAL or first.get("pattern") != {"Regex": _CUTS} or not suffix or made != sorted(made):
            return None
        ranks, alphabet = {}, byte_alphabet()
        for token, i in model["vocab"].items():
            ends = token.endswith(suffix) and token != suffix
            ranks[bytes(alphabet[c] for c in (token[:-len(suffix)] if ends else token)) + b" " * ends] = i
        # a special token makes the call that returns an array; no text that has one comes here
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"<|endoftext|>": max(ranks.values()) + 1})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        fresh = list(set(words) - self.known.keys())
        self.known.update(zip(fresh, self._ids([w.encode("utf-8", "replace").decode("utf-8") for w in fresh])))
        return [self.known[w] for w in words]

    def _written(self, text: str, hard: list[str]) -> str:
        """The text with a hole for each word that has hard signs; these words are added to ``hard``."""
        for c in "\t\n\v\f\r":
            text = text.replace(c, " ")
        out, at = [], 0
        for found in _HARD.finditer(text):
            if found.start() >= at:
                start, end = text.rfind(" ", at, found.start()) + 1 or at, text.find(" ", found.end())
                end = len(text) if end < 0 else end
                out += [text[at:start], _HOLE]
                hard.append(text[start:end])
                at = end
        return " ".join([*out, text[at:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        # a special token in a text counts as written, so such a text is not taken apart
        whole = {k for k, t in enumerate(texts) if "<|" in t or not self.merges}
        found = dict(zip(whole, self._ids([texts[k] for k in whole])))
        rest, hard = [k for k in range(len(texts)) if k not in whole], []
        if not rest:
            return [found[k] for k in range(len(texts))]
        written = [self._written(texts[k], hard) if _HARD.search(texts[k]) else texts[k] for k in rest]
        marked = spaced(f" {_END} ".join([*written, ""]).encode("latin-1")).decode("latin-1")
        ids = self.merges.encode_to_numpy(marked, disallowed_special=())
        (end,), (hole,) = (self.merges.encode_ordinary(c + " ") for c in (_END, _HOLE))
        marks = np.flatnonzero((ids == end) | (ids == hole))
        data, holes, of_rest, parts, at = ids.tobytes(), iter(self._words(hard)), iter(rest), [], 0
        for mark, ends in zip(marks.tolist(), (ids[marks] == end).tolist()):
            parts.append(data[4 * at:4 * mark])
            at = mark + 1
            if ends:
                found[next(of_rest)], parts = b"".join(parts), []
            else:
                parts.append(next(holes))
        return [found[k] for k in range(len(texts))]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker, so that words which it has learnt serve the next task too."""
    return WordEncoder(path)


def give_back() -> None:
    """Return what a Python worker has freed to the system. Workers are used again, and the next task would else start at the
    peak of the last one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def in_portions(texts: list[str | None], size: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of portions of about ``size`` characters; null is empty."""
    at, portion, total = 0, [], 0
    for k, text in enumerate(texts):
        portion.append(text or "")
        total += len(portion[-1])
        if total > size or k == len(texts) - 1:
            yield at, portion
            at, portion, total = k + 1, [], 0


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each text's ids, ``end_id`` last, cut at every ``capacity`` ids.

    A null or empty text is the end id alone. Other columns of ``docs`` are not read; repeated rows and null
    doc_ids give pieces of their own. No text is cut before it is encoded.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = word_encoder(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in in_portions(batch.column(1).to_pylist(), 1_000_000):
                rows = []
                for doc_id, ids in zip(doc_ids[first:], encoder.encode(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        rows.append((doc_id, k, at // 4, len(part) // 4, part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)
