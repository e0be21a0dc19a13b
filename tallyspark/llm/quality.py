"""Operator 1: a quality classifier from positive and unlabelled texts.

A linear model on hashed character n-grams (square roots of their shares) and a few measures of
the text minimises the non-negative unbiased risk: with class prior ``p``, trusted positives P
and unlabelled texts U, ``p * R+(P) + max(0, R-(U) - p * R-(P))`` under the logistic loss; while
the second part is negative, the step undoes it instead. The prior is estimated from P and U alone:
no set of texts can hold a smaller share of U than ``p`` times its share of P, so ``p`` is the
least ratio of these shares over the texts above a threshold of a classifier of P against U, on halves of
the samples that the classifier did not see. A logistic curve fitted to labelled texts of both
classes, at the prior, then sets the scale of the scores; nothing else uses labels of class 0.

Positives, unlabelled and calibration texts are bounded samples (``positives``, ``unlabelled``,
``negatives``); every whole text is scored. Empty and null texts are scored as texts of length
0. Without positives the score is 0.5. Rows are scored by themselves: null ids and repeated rows
are kept, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import grams
from tallyspark.llm.common import arrow_map, fold, labelled_sample, text_sample, text_scores

ORDERS = (1, 2, 3)
BITS = 11
MEASURES = 12


def _measures(text: str, letters: int, upper: int, digits: int, spaces: int) -> list[float]:
    """Shares (as square roots) and ratios that describe form, whatever the language."""
    n = max(1, len(text))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(len(text)), math.sqrt(letters / n), math.sqrt(upper / n), math.sqrt(digits / n), math.sqrt(spaces / n),
        math.sqrt(max(0, n - letters - digits - spaces) / n), math.log1p(n / w), math.sqrt(again / w),
        math.log1p(distinct) / math.log1p(w), math.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
        math.log1p(w / max(1, len(lines))), math.sqrt((w - distinct) / w),
    ]


def _tally(points: np.ndarray) -> np.ndarray:
    """Letters, capitals A-Z, digits 0-9, blanks and line ends."""
    upper, digits = (points >= 65) & (points <= 90), (points >= 48) & (points <= 57)
    return np.array([np.count_nonzero(x) for x in (grams.letters()[points], upper, digits, (points == 32) | (points == 10))])


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """Of texts of together about PASS code points; a longer one is counted in slices."""
    if len(texts) == 1 and len(texts[0]) > grams.PASS:
        tally, total = np.zeros(4, np.int64), np.zeros(1 << BITS, np.int64)
        for part in grams.slices(texts[0]):
            points, starts = grams.code_points([part])
            tally += _tally(points[:-1])
            total += grams.counts(next(grams.buckets(points, starts, ORDERS, BITS)), BITS)
        yield _vector(texts[0], tally, total)
        return
    points, starts = grams.code_points(texts)
    for t, a, b, found in zip(texts, starts, starts[1:], grams.buckets(points, starts, ORDERS, BITS), strict=False):
        yield _vector(t, _tally(points[a : b - 1]), grams.counts(found, BITS))


def _vector(text: str, tally: np.ndarray, total: np.ndarray) -> np.ndarray:
    shares = total / max(1, int(total.sum()))
    return np.concatenate([_measures(text, *map(int, tally)), np.sqrt(shares)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> float:
        return float(((x - self.mean) / self.scale) @ self.weights + self.bias)

    def score(self, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.raw(x) + self.shift))))


def _rows(rows: DataFrame) -> dict[int, list[bytes]]:
    """Per label, the features (counted on the executors, as halves) of a bounded sample, in the order of the ids."""

    def run(batches):
        for b in batches:
            ids, texts, y = (c.to_pylist() for c in b.columns)
            for rows, part in grams.passes(list(range(len(texts))), [t or "" for t in texts]):
                yield {"doc_id": [ids[i] for i in rows], "y": [y[i] for i in rows], "x": [x.astype("<f2").tobytes() for x in features(part)]}

    got = arrow_map(rows.select("doc_id", "text", "y"), run, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return {y: [r["x"] for r in got if r["y"] == y] for y in (0, 1)}


def _matrix(rows: list[bytes]) -> np.ndarray:
    """One row of float32 after another; the driver holds no second copy."""
    x = np.empty((len(rows), MEASURES + (1 << BITS)), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r, "<f2")
    return x


def nnpu(x: np.ndarray, p: int, prior: float, steps: int = 300, rate: float = 0.02, decay: float = 1e-3, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk of ``p`` rows of positives, then the unlabelled; features must be standardised. Returns weights and bias."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    for t in range(1, steps + 1):
        z = x @ w[:-1].astype(np.float32) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # slope of the loss as a negative; s - 1 as a positive
        as_negative = np.logaddexp(0, z)
        rest = as_negative[p:].mean() - prior * as_negative[:p].mean()
        slope = np.empty_like(z)
        if rest >= -beta:
            slope[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            slope[p:] = s[p:] / (len(z) - p)
        else:  # the part that cannot be negative is: undo it
            slope[:p] = prior * s[:p] / p
            slope[p:] = -s[p:] / (len(z) - p)
        grad = np.append(x.T @ slope.astype(np.float32) + decay * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def class_prior(x: np.ndarray, p: int, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled rows from ``p`` on, by the best bin: two classifiers of P against U, each judging the half it did not see.

    The least upper confidence bound of U's share over P's decides, so that small bins do not; at
    most 0.98 and at least 0.02.
    """
    z = [np.zeros(p), np.zeros(len(x) - p)]
    for half in (0, 1):
        some = np.concatenate([x[half:p:2], x[p + half :: 2]])
        w, b = nnpu(some, len(range(half, p, 2)), 0.5, steps=100, beta=np.inf)
        z[0][1 - half :: 2], z[1][1 - half :: 2] = x[1 - half : p : 2] @ w + b, x[p + 1 - half :: 2] @ w + b
    z[0].sort()
    z[1].sort()
    above = 1 - np.searchsorted(z[0], z[0]) / len(z[0])
    share = 1 - np.searchsorted(z[1], z[0]) / len(z[1])
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(z[0])) + 1 / np.sqrt(len(z[1])))
    best = int(((share + slack) / np.maximum(above, 1e-9)).argmin())
    return float(np.clip(share[best] / above[best], 0.02, 0.98))


def train(docs: DataFrame, label_rows: DataFrame, held: int = 2, folds: int = 4, positives: int = 2000, unlabelled: int = 3000, negatives: int = 1000, seed: int = 17) -> Model | None:
    known = _rows(labelled_sample(docs, label_rows, "quality", folds, held, {1: positives, 0: negatives}))
    free = _rows(text_sample(docs, unlabelled, seed).withColumn("y", F.lit(0)))[0]
    p = len(known[1])
    if p < 2 or len(free) < 2:
        return None
    x, bad = _matrix(known[1] + free), _matrix(known[0])
    del known, free
    mean, scale = x[p:].mean(axis=0), x[p:].std(axis=0) + np.float32(1e-3)
    scale[MEASURES:] *= 4  # n-grams each count for less than a measure
    x -= mean
    x /= scale
    prior = class_prior(x, p)
    model = Model(mean, scale, *nnpu(x, p, prior))
    if len(bad):
        z = np.append(x[:p] @ model.weights + model.bias, [model.raw(r) for r in bad])
        good = x[:p]
        target = np.append(np.ones(len(good)), np.zeros(len(bad)))
        weight = np.append(np.full(len(good), prior / len(good)), np.full(len(bad), (1 - prior) / len(bad))) * len(z)
        a = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a[0] * z + a[1], -30, 30)))
            d = np.stack([z, np.ones_like(z)], axis=1)
            hessian = (d * (weight * p * (1 - p))[:, None]).T @ d + np.eye(2) * 0.1
            a = a + np.linalg.solve(hessian, d.T @ (weight * (target - p)) - 0.1 * (a - [1.0, 0.0]))
        model.slope, model.shift = max(1e-3, float(a[0])), float(a[1])
    return model


def scored(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """``docs`` with a column of scores; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def scores(texts: list[str]) -> list[float]:
        m = shared.value
        if m is None:
            return [0.5] * len(texts)
        return [m.score(x) for _, part in grams.passes(texts, texts) for x in features(part)]

    return text_scores(docs, into, scores)


def assess(docs: DataFrame, label_rows: DataFrame, held: int = 2, folds: int = 4, threshold: float = 0.7, **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(rows, train(docs, label_rows, held, folds, **kw))
    return rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
