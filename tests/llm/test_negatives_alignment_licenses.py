"""Hard negatives, cross-tokenizer alignment and licence scans against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from strataudit.llm import alignment, licenses, negatives, queries
from strataudit.session import work_table
from tests.check_sql import compare, tables_in

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, label int, vec array<bigint>"
ODD = [None, "", "  \n", "one", "É é ΣΑΣ. don't \"x\". a_b, 5. <|endoftext|> ﬁ", "▁a ▁▁b", "same words again", "same words again", "a  b   c\n\n d\t\te",
       "\x00a\x01 <0x0A> <s> </s>", "日本語 と 😀👍🏽\r\n a", "x" * 50_000, "word " * 3_000, "  lead and trail  "]


# Hard negatives

def brute_negatives(rows, is_anchor, low=80, count=5):
    there = [(v, l, w) for v, l, w in rows if v is not None and l is not None and w is not None]
    out = []
    for k, (anchor, label, vec) in enumerate(there):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(a * b for a, b in zip(vec, w)), v, l) for j, (v, l, w) in enumerate(there) if j != k and len(w) == len(vec))
        for p, positive, _ in [x for x in scored if x[2] == label][:count]:
            fits = [(-n, v) for n, v, l in scored if l != label and low * -p <= 100 * -n <= 100 * -p][:count]
            out += [(anchor, positive, r, v, -p, n) for r, (n, v) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    found = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


def test_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SEGMENT", 64)
    monkeypatch.setattr(negatives, "SLICE", 8)
    monkeypatch.setattr(negatives, "STRIP", 16)
    rng = random.Random(3)
    spots = [[rng.randint(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = [(k, rng.randint(0, 3), [x + rng.randint(-15, 15) for x in spots[k % 5]]) for k in range(600)]
    hot = [1, -2, 3, 60, 5, 6]
    rows += [(1000 + k, k % 2, hot) for k in range(200)]  # many equal vectors
    rows += [rows[10]] * 3 + [rows[11]] * 2 + [(10, 2, hot)]  # repeated rows, an id with other vectors
    rows += [(2000 + k, k % 3, [0] * 6) for k in range(20)]  # all scores tie
    rows += [(3000 + k, k % 2, [k, 1]) for k in range(15)] + [(3100, 1, []), (3110, 2, [])]  # other lengths
    rows += [(None, 1, hot), (20, None, hot), (30, 1, None)]
    rng.shuffle(rows)
    assert mined(spark, rows) == brute_negatives(rows, lambda v: v % 10 == 0)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, k % 2, [rng.randint(-2**30, 2**30) for _ in range(4)]) for k in range(80)]
    got = mined(spark, rows, low=10)
    assert got and got == brute_negatives(rows, lambda v: v % 10 == 0, low=10)


def test_negatives_of_empty_and_clashing_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(10, 1, [1, 2])]) == []
    rows = spark.createDataFrame([(10, 1, [3, 4], 1.0, 1, "x"), (11, 1, [3, 4], 1.0, 1, "x"), (12, 2, [3, 4], 1.0, 1, "x")],
                                 VECTORS + ", score double, rank int, cluster string")
    assert [tuple(r) for r in negatives.mine(rows, F.col("vec_id") == 10).collect()] == [(10, 11, 1, 12, 25, 25)]


def test_bound_holds_for_all_members():
    rng = np.random.default_rng(5)
    items, anchors = rng.normal(size=(500, 8)) * rng.uniform(0.1, 9, (500, 1)), rng.normal(size=(40, 8)) + 2
    centre = anchors.mean(axis=0) / np.linalg.norm(anchors.mean(axis=0))
    size, length = np.linalg.norm(items, axis=1), np.linalg.norm(anchors, axis=1)
    cosine = (anchors @ centre / length).min()
    along = items @ centre
    across = np.sqrt(np.maximum(size ** 2 - along ** 2, 0))
    bound = np.where(along >= size * cosine, size, along * cosine + across * math.sqrt(1 - cosine ** 2))
    assert (items @ anchors.T / length <= bound[:, None] + 1e-9).all()


def test_scaled_refuses_what_is_no_number(spark):
    rows = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([None],), ([float("inf")],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in rows.select(negatives.scaled("v", 256)).collect()] == [[128, -1], None, None, None, None, []]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_negatives_match_sql(spark, folder):
    assert compare(spark, tables_in(folder), folder, "op11_negatives") == ""


# Cross-tokenizer alignment

def byte_tokens(tokenizer, text):
    alphabet = alignment.byte_alphabet()
    ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
    return ids, [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in ids]


def piece_tokens(model, text):
    ids = model.encode(text)
    return ids, [bytes([int(model.IdToPiece(i)[3:5], 16)]) if model.IsByte(i) else model.IdToPiece(i).replace("▁", " ").encode() for i in ids]


def brute_alignment(texts):
    tokenizer, model = Tokenizer.from_file(queries.BYTES), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    tokenizer.encode_special_tokens = True
    rows, docs = [], Counter()
    for text in texts:
        (a, a_bytes), (b, b_bytes) = (byte_tokens(tokenizer, text), piece_tokens(model, text)) if text else (([], []), ([], []))
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            rows.append((0, 0, [], Counter()))
            continue
        ends = [list(itertools.accumulate(map(len, side))) for side in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = Counter(x for g in groups for x in itertools.product(*g))
        docs.update(set(links))
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for n_a, n_b, groups, links in rows:
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for x, n in links.items() if docs[x] == most[x[0]]),
                    sum(n * docs[x] for x, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(frame, frequent=alignment.FREQUENT):
    found = work_table(alignment.align(frame, queries.BYTES, queries.PIECES), "aligned")
    full = alignment.with_counts(found, work_table(alignment.pair_counts(found), "pairs"), frequent)
    return [(r.doc_id, *(r[c] for c in COLUMNS)) for r in full.orderBy("row").collect()]


@pytest.mark.parametrize("frequent", [1 << 17, 40, 0])
def test_alignment_matches_brute_force(docs, frequent):
    got = sorted(aligned(docs(*ODD).coalesce(1), frequent))
    assert got == sorted((k, *x) for k, x in enumerate(brute_alignment(ODD), 1))


def test_alignment_of_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in queries.op12_alignment(spark, FOLDER).collect())
    assert got == sorted((k, *x) for (k, _), x in zip(texts, brute_alignment([t for _, t in texts])))


def test_alignment_of_empty_clashing_and_repeated_rows(spark, docs, clashing):
    assert aligned(docs()) == []
    assert [x[0] for x in aligned(clashing("a b", None, "c"))] == [1, 2, 3]
    twice = aligned(docs((7, "a b"), (7, "a b"), (None, "a b"), (7, "c")))
    assert sorted(map(str, twice)) == sorted(map(str, [(k, *x) for k, x in zip((7, 7, None, 7), brute_alignment(["a b"] * 3 + ["c"]))]))


def test_windows_are_forgotten_at_the_limit():
    left, right, _ = alignment.tools(queries.BYTES, queries.PIECES)
    small, large = alignment.Aligner(left.bytes, right.bytes, limit=2), alignment.Aligner(left.bytes, right.bytes)
    for text in [x for x in ODD if x] * 2:
        found = [x.align(left.encode([text])[0], right.encode([text])[0], b" " + text.encode()) for x in (small, large)]
        assert (found[0] is None) == (found[1] is None) and (found[0] is None or found[0][:3] == found[1][:3])
    assert len(large.known) > len(small.known) and small.before


def test_windows_that_spare_no_work_are_not_looked_up():
    left, right, _ = alignment.tools(queries.BYTES, queries.PIECES)
    mine, known = alignment.Aligner(left.bytes, right.bytes), []
    for k in range(3 * alignment.TRIED):
        text = f"new{k * 7919} words w{k}x <|endoftext|>"
        sides = right.encode([text])[0], b" " + text.encode()
        assert left.arrays([text])[0].tolist() == left.encode([text])[0]
        got, want = mine.align(left.arrays([text])[0], *sides), alignment.Aligner(left.bytes, right.bytes).align(left.encode([text])[0], *sides)
        assert got[:3] == want[:3] and got[3].tolist() == want[3].tolist() and got[4].tolist() == want[4].tolist()
        known.append(len(mine.known))
    assert mine.spared and known[0] < known[alignment.TRIED - 1] == known[-1]


def test_byte_tokens_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(queries.BYTES)
    tokenizer.encode_special_tokens = True
    texts = [x for x in ODD if x] + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert isinstance(tokenizer.decoder, decoders.ByteLevel)
    mine = alignment.ByteTokens(queries.BYTES)
    assert mine.encode(texts) == [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


# Licence scans

def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = ["Released under the MIT License. Under the MIT LICENSE; under the mit-license", "Licensed under CC BY-NC 4.0.", "ccbync cc by ncx cc  by\nnc",
            "Apache License, Version 2.0; apache license version 2", "under the mit licence", "Éunder the mit license", "under the mit license" * 2,
            "cc by nc cc by nc " * 5_000]


def test_base_phrases_match_brute_force(docs):
    texts = ODD + LICENSED
    found = licenses.digest(licenses.scan(docs(*texts))).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found] == [brute_licenses(t) for t in texts]
    for r in found:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_base_phrases_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op13_licenses(spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])


@pytest.mark.parametrize("expression, labels, obligation", [
    ("mit", "mit", 0), ("apache-2.0+", "apache-2", 0), ("(mit or gpl-3.0-only)", "gpl-3.0,mit", 0), ("mit and gpl-3.0-or-later", "gpl-3.0,mit", 2),
    ("gpl-2.0 with classpath-exception-2.0", "gpl-2.0", 1), ("mit or gpl-3.0 and agpl-3.0", "agpl-3.0,gpl-3.0,mit", 0),
    ("(mit or gpl-3.0) and agpl-3.0", "agpl-3.0,gpl-3.0,mit", 2), ("mit/apache-2.0", "apache-2,mit", 0), ("mit see the file", "mit", 0),
    ("licenseref-own and mit", "licenseref-own,mit", 3),
])
def test_expressions(expression, labels, obligation):
    value = licenses.evaluate(licenses.tokens_of(expression))
    assert (",".join(sorted(value[0])), value[1]) == (labels, obligation)


@pytest.mark.parametrize("expression", ["", "mit and", "(mit", "and mit", "foo", "mit and foo", "mit with mit", "()", "mit or ( )"])
def test_no_expressions(expression):
    assert licenses.evaluate(licenses.tokens_of(expression)) is None


def brute_value(tree):
    if isinstance(tree, str):
        return licenses.LICENSES[tree]
    operator, left, right = tree
    return (min if operator == "or" else max)(brute_value(left), brute_value(right))


def test_random_expressions_match_their_trees():
    rng = random.Random(6)
    names = ["mit", "gpl-3.0", "lgpl-2.1", "cc-by-nc", "isc"]

    def tree(depth):
        return rng.choice(names) if not depth or rng.random() < 0.3 else (rng.choice(["and", "or"]), tree(depth - 1), tree(depth - 1))

    def text(t):
        return t if isinstance(t, str) else f"({text(t[1])}) {t[0]} ({text(t[2])})"

    for _ in range(300):
        one = tree(5)
        assert licenses.evaluate(licenses.tokens_of(text(one)))[1] == brute_value(one)
    deep = "(" * 20_000 + "mit" + ")" * 20_000
    assert licenses.evaluate(licenses.tokens_of(deep)) == (frozenset(["mit"]), 0)


def test_tags_and_notices_give_labels(docs):
    texts = ["// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later */", '{"license": "MIT/Apache-2.0"}', "License: see the file",
             "This work is licensed under the GNU General Public License, version 3.", "Creative Commons Attribution-NonCommercial", "SPDX-License-Identifier MIT",
             "the license\n: mit"]
    found = licenses.digest(licenses.scan(docs(*texts))).orderBy("doc_id").collect()
    assert [r.labels for r in found] == ["apache-2,gpl-2.0,mit", "apache-2,mit", "", "gpl-3.0", "cc-by-nc", "", ""]
    assert [r.obligation for r in found] == [2, 0, None, 2, 3, None, None] and all(r.n_base == 0 and r.base_labels == "" for r in found)


def test_phrase_places_are_linear_in_the_text():
    n, found = licenses.findings("the mit license " * 20_000 + "spdx-license-identifier: mit " * 5_000)
    assert n == 80_000 and len(found) == 25_000


def test_licenses_of_empty_and_clashing_tables(docs, clashing):
    assert licenses.digest(licenses.scan(docs())).collect() == []
    assert [r.n_words for r in licenses.digest(licenses.scan(clashing("a b", None))).collect()] == [2, 0]
    assert sorted((r.doc_id is None, r.n_words) for r in licenses.digest(licenses.scan(docs((1, "a"), (1, "a"), (None, "b c")))).collect()) == [
        (False, 1), (False, 1), (True, 2)]
