"""Quality classifier by positive-unlabelled learning: trusted positives, all texts as unlabelled, an estimated prior.

The classifier is linear in features of the whole text. It minimises the non-negative unbiased risk
``prior * E_pos[l(f)] + max(0, E_all[l(-f)] - prior * E_pos[l(-f)])`` with the logistic loss, by Newton steps. Each step
is one pass over all feature rows, of which every task sends one row of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataudit.llm.shingles import word_hashes
from strataudit.llm.tokens import give_back, in_portions
from strataudit.session import work_table

_MARKS = b"!|#$%&*"
_CLASS = np.zeros(256, dtype=np.uint8)  # 0: other
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
for _b in b"\"'(),-./:;<=>?@[\\]^_`{}~+":
    _CLASS[_b] = 6
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 7 + _k
_N_CLASSES = 7 + len(_MARKS)
#: Characters that are measured together; measuring takes about 45 bytes each.
PORTION = 500_000
SIZE = 1 + 2 * (4 + len(_MARKS) + 4)


def features(texts: list[str]) -> np.ndarray:
    """One row of ``SIZE`` numbers for each text: shares of kinds of characters, repeats among words, lengths."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int64)
    counts = np.bincount(kinds + np.repeat(np.arange(len(raw)) * _N_CLASSES, sizes), minlength=len(raw) * _N_CLASSES)
    counts = counts.reshape(len(raw), _N_CLASSES).astype(float)
    words, per_text = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), per_text)
    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    twice = np.bincount(owner[1:][same], minlength=len(texts))
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    first = np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1]))[:len(w)]
    distinct = np.bincount(o[first], minlength=len(texts))
    n, chars = np.maximum(per_text, 1).astype(float), np.maximum(sizes, 1).astype(float)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 2], 1)
    shares = np.column_stack([counts[:, 1] / letters, counts[:, 3] / chars, counts[:, 5] / n, counts[:, 6] / n,
                              counts[:, 7:] / n[:, None], twice / n, np.maximum(0, np.sqrt(n) - distinct) / np.sqrt(n),
                              letters / n / 20, 1 / n])
    return np.column_stack([np.ones(len(texts)), np.log1p(50 * shares), shares / (shares + 0.03)]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        z = (features(texts) - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def feature_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x): the features as four-byte floats."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_portions(batch.column(1).to_pylist(), PORTION):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([r.tobytes() for r in features(texts)], pa.binary())],
                                                 names=["doc_id", "x"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id bigint, x binary")


def _sums(rows: DataFrame, work) -> list[np.ndarray]:
    """The sums over all tasks of the arrays that ``work`` makes of (positive, features)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, SIZE).astype(float)
                got = work(np.array(batch.column(0).to_pylist(), dtype=bool), x)
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in total]], pa.list_(pa.binary()))], names=["sums"])

    found = [[np.frombuffer(a) for a in r.sums] for r in rows.select("positive", "x").mapInArrow(part, "sums array<binary>").collect()]
    return [np.sum(a, axis=0) for a in zip(*found)]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _fit(rows: DataFrame, mean, scale, n_pos: float, n_all: float, prior: float | None, steps: int, ridge: float) -> np.ndarray:
    """Newton steps; each pass measures three step lengths and keeps the one of least risk. Without ``prior``:
    positives against all texts, both with half the weight."""

    def measure(candidates):
        def work(positive, x):
            x, out = (x - mean) / scale, []
            for w in candidates:
                z = np.clip(x @ w, -40, 40)
                s = 1 / (1 + np.exp(-z))
                p, v = x[positive], s * (1 - s)
                out += [np.array([_softplus(z).sum(), _softplus(-z[positive]).sum(), _softplus(z[positive]).sum()]),
                        x.T @ s, p.sum(axis=0), p.T @ (1 - s[positive]), ((x * v[:, None]).T @ x).ravel(), ((p * v[positive][:, None]).T @ p).ravel()]
            return out

        found, best = _sums(rows, work), None
        for k, w in enumerate(candidates):
            (all_neg, pos_pos, pos_neg), g_all, sum_pos, g_pos, h_all, h_pos = found[6 * k:6 * k + 6]
            h_all, h_pos, away = h_all.reshape(SIZE, SIZE) / n_all, h_pos.reshape(SIZE, SIZE) / n_pos, ridge * np.append(0, w[1:])
            if prior is None:
                risk = 0.5 * (pos_pos / n_pos + all_neg / n_all)
                slope, bend = 0.5 * (g_all / n_all - g_pos / n_pos), 0.5 * (h_all + h_pos)
            else:
                negative = all_neg / n_all - prior * pos_neg / n_pos
                risk = prior * pos_pos / n_pos + max(0.0, negative)
                if negative >= 0:
                    slope, bend = g_all / n_all - prior * sum_pos / n_pos, h_all
                else:
                    slope, bend = -prior * g_pos / n_pos, prior * h_pos
            risk += ridge / 2 * (w[1:] ** 2).sum()
            if best is None or risk < best[0]:
                best = (risk, w, np.linalg.solve(bend + (ridge + 1e-9) * np.eye(SIZE), slope + away))
        return best

    risk, w, step = measure([np.zeros(SIZE)])
    for _ in range(steps):
        new, w_new, step_new = measure([w - t * step for t in (1.0, 0.4, 0.1)])
        if new > risk - 1e-6:
            break
        risk, w, step = new, w_new, step_new
    return w


def estimate_prior(rows: DataFrame, mean, scale, w: np.ndarray, n_pos: float, n_all: float, least: float = 0.3) -> float:
    """The share of positives among all texts: the least ratio of all texts to positives among those that score high.

    Positives are a part of every set of texts, so no set gives a smaller ratio but by chance: both counts are taken a
    standard deviation to the safe side. Only sets that hold at least ``least`` of the positives are looked at.
    """
    edges = np.linspace(0, 1, 201)

    def work(positive, x):
        s = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w, -40, 40)))
        return [np.histogram(s, edges)[0].astype(float), np.histogram(s[positive], edges)[0].astype(float)]

    every, positive = (np.cumsum(h[::-1])[::-1] for h in _sums(rows, work))
    use = positive >= least * n_pos
    every, positive = every[use] + np.sqrt(every[use]), positive[use] - np.sqrt(positive[use])
    return float(np.clip((every / n_all / (np.maximum(positive, 1) / n_pos)).min(), 0.05, 0.98))


def train(docs: DataFrame, positives: DataFrame, steps: int = 12, ridge: float = 1e-3) -> Model:
    """Fits on all texts of ``docs`` as unlabelled and those whose doc_id is in ``positives`` as positive.

    Nothing is sampled. Labels of other values are not used. Without texts or positives the model scores 0.5 everywhere.
    """
    chosen = positives.select("doc_id").distinct().withColumn("positive", F.lit(True))
    rows = work_table(feature_rows(docs).join(chosen, "doc_id", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), "x"), "features")
    sums = _sums(rows, lambda p, x: [np.array([len(x), p.sum()], dtype=float), x.sum(axis=0), (x ** 2).sum(axis=0)])
    if not sums or not sums[0][1]:
        return Model(np.zeros(SIZE), np.zeros(SIZE), np.ones(SIZE), 0.5)
    (n_all, n_pos), mean = sums[0], sums[1] / sums[0][0]
    scale = np.sqrt(np.maximum(sums[2] / n_all - mean ** 2, 1e-6))
    mean[0], scale[0] = 0, 1
    prior = estimate_prior(rows, mean, scale, _fit(rows, mean, scale, n_pos, n_all, None, steps, ridge), n_pos, n_all)
    return Model(_fit(rows, mean, scale, n_pos, n_all, prior, steps, ridge), mean, scale, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score``, from 0 to 1; a null text counts as empty. A column of that name is replaced."""
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(texts) for _, texts in in_portions(batch.column(at).to_pylist(), PORTION)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.zeros(0)]))],
                                             names=[*batch.schema.names, "score"])
        give_back()

    return docs.mapInArrow(add, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", score double")


def held_out(doc_id="doc_id"):
    """Rows whose labels are kept back from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_ids that the training part of ``labels`` marks as good; conflicting or null marks do not count."""
    return (labels.filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
            .filter("low = 1 and high = 1").select("doc_id"))
