"""Nearest neighbours against brute force."""

import numpy as np

from strataudit.llm import neighbours, queries


def brute(rows, wanted, k=5):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in wanted:
        at = ids.index(q)
        order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-round(float(unit[at] @ unit[j]), 12), ids[j]))
        out[q] = [ids[j] for j in order[:k]]
    return out


def test_recall_on_all_vectors(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op9_neighbours(spark, folder).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(table, [i for i, _ in table if i % 50 == 0])
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_ties_repeats_and_vectors_that_take_no_part(spark):
    rows = [(k, [1.0, 0.0, float(k % 2)]) for k in range(20)]
    odd = [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 1.0]), (53, [float("nan"), 1.0, 1.0]), (54, [1.0]), (None, [1.0, 1.0, 1.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    found = neighbours.search(df, df.filter("vec_id in (0, 7, 50)"))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute([*rows, odd[-1]], [0, 7])  # the repeated row is a candidate of its own
    assert neighbours.search(df.filter("false"), df.select("vec_id")).count() == 0


def test_all_true_neighbours_when_a_query_sees_few_entries(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.filter("vec_id % 50 = 0"), curves=2, block=8, exact=True, at_once=16)  # at most 48 of the 2,000 places
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(table, [i for i, _ in table if i % 50 == 0])


def test_recall_of_windows_smaller_than_the_table(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    want = brute(table, [i for i, _ in table if i % 50 == 0])
    got = {}
    for r in neighbours.search(df, df.filter("vec_id % 50 = 0"), block=16).collect():  # 32 to 48 of 2,000 places on each curve
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_rows_that_repeat_an_id_are_candidates(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted((r.rank, r.vec_id, round(r.score, 3)) for r in neighbours.search(df, df.filter("vec_id = 50")).collect())
    first, other = [(1, 50, 1.0), (2, 7, 0.707), (3, 50, 0.0)], [(1, 7, 0.707), (2, 50, 0.0), (3, 50, 0.0)]
    assert found == sorted(first * 2 + other)


def test_hilbert_neighbours_touch():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    order = cells[np.argsort(neighbours.hilbert_keys(cells, 3))]
    assert len(set(neighbours.hilbert_keys(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
