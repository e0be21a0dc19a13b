"""Operator 9: language identification.

A sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams,
trained by follow-the-regularised-leader (proximal, per-coordinate rates) with elastic-net
penalties, then calibrated by a temperature fitted on examples it did not train on.

The model trains on at most ``per_language`` texts of each language, and on at most ``texts`` in
all or one of each language, whichever is more: no language is left out. Document frequencies
are counted over all documents, and every whole text is scored. A text that several rows repeat counts
once for each language that they give it. A very long text is taken in slices of ``PASS`` code points. A text that is null or has no letter is ``und`` with score 0. Where nothing can be
learned every prediction is ``und``. Rows are scored by themselves: null ids and repeated rows
are kept, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import grams
from tallyspark.llm.common import arrow_map, fold, materialize, text_chunks

ORDERS = (1, 2, 3)
BITS = 15
UNKNOWN = "und"


def text_buckets(texts: list[str]):
    """Per text, its n-gram buckets: lower case, all but letters as one space; None without a letter."""
    points, starts = grams.code_points([t.lower() for t in texts])
    is_letter = grams.letters()[points]
    points = np.where(is_letter, points, np.uint32(32))
    for (a, b), found in zip(zip(starts, starts[1:], strict=False), grams.buckets(points, starts, ORDERS, BITS), strict=True):
        yield found if is_letter[a:b].any() else None


def counted(texts: list[str]):
    """Per text, how often each bucket occurs; None without a letter. Texts of together about PASS code points."""
    if len(texts) == 1 and len(texts[0]) > grams.PASS:
        found = [x for part in grams.slices(texts[0]) for x in counted_part([part]) if x is not None]
        yield sum(found) if found else None
    else:
        yield from counted_part(texts)


def counted_part(texts: list[str]):
    for found in text_buckets(texts):
        yield None if found is None else grams.counts(found, BITS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counted: np.ndarray) -> np.ndarray:
        x = counted * self.idf
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def predict(self, counted: np.ndarray) -> tuple[str, float]:
        z = self.logits(self.features(counted)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def samples(docs: DataFrame, held: int, folds: int, per_language: int = 800, texts: int = 40_000, seed: int = 3) -> DataFrame:
    """(doc_id, text, lang) of the texts to learn from, first by a hash of id and text.

    A threshold on the hash keeps about four times as many as are wanted of each language, wherever
    they lie; only these are sorted, so that a hot language costs no more than others.
    """
    rows = docs.select("doc_id", "text", F.col("lang").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != held))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.withColumnRenamed("lang", "lang_"), "languages")
    many = max(1, min(per_language, texts // max(1, sizes.count())))
    share = F.least(F.lit(1.0), F.lit(4.0 * many) / F.col("n"))
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    drawn = rows.where("text IS NOT NULL").withColumn("key", key).join(sizes, F.col("lang") == F.col("lang_"))
    drawn = drawn.where(F.pmod("key", F.lit(1 << 40)) < share * float(1 << 40))
    once = drawn.groupBy("lang", "key").agg(F.min(F.struct("doc_id", "text")).alias("one"))
    order = Window.partitionBy("lang").orderBy("key")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= many).select("one.doc_id", "one.text", "lang")


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Over all documents: how many have a letter, and in how many each bucket occurs."""

    def run(batches):
        found, n = np.zeros((1 << BITS) + 1, dtype=np.int64), 0
        for ids, texts in text_chunks(batches):
            for _, part in grams.passes(ids, [t or "" for t in texts]):
                for c in counted(part):
                    if c is not None:
                        found[:-1] += c > 0
                        n += 1
        found[-1] = n
        hit = np.flatnonzero(found)
        yield {"bucket": hit.tolist(), "n": found[hit].tolist()}

    rows = arrow_map(docs.select("doc_id", "text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for r in rows.collect():  # at most 2 ** BITS + 1
        out[r["bucket"]] = r["n"]
    return int(out[-1]), out[:-1]


def sample_counts(sample: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of the sampled texts, counted on the executors, in the order of their ids."""

    def run(batches):
        for b in batches:
            ids, texts, langs = (c.to_pylist() for c in b.columns)
            for rows, part in grams.passes(list(range(len(texts))), texts):
                out = {"doc_id": [], "lang": [], "buckets": [], "counts": []}
                for i, found in zip(rows, counted(part), strict=True):
                    if found is not None:
                        hit = np.flatnonzero(found)
                        out["doc_id"].append(ids[i])
                        out["lang"].append(langs[i])
                        out["buckets"].append(hit.astype("<u2").tobytes())
                        out["counts"].append(np.minimum(found[hit], 65535).astype("<u2").tobytes())
                yield out

    got = arrow_map(sample, run, "doc_id long, lang string, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["buckets"], r["counts"]))
    return [(r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<u2").astype(np.float32)) for r in got]


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], total: int, frequency: np.ndarray, alpha: float = 0.5, beta: float = 1.0,
          l1: float = 0.02, l2: float = 0.01, epochs: int = 3, seed: int = 5) -> Model | None:
    """FTRL-proximal over four fifths of the sample, the temperature on the rest."""
    names = sorted({s[0] for s in sample})
    if not names:
        return None
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    index = {name: i for i, name in enumerate(names)}
    c, rng = len(names), np.random.default_rng(seed)
    model = Model(names, idf, np.zeros((1 << BITS, c), np.float32), np.zeros(c, np.float32))
    examples = []
    for lang, hit, n in sample:
        x = n * idf[hit]
        examples.append((index[lang], hit.astype(np.int64), x / max(float(np.sqrt(x @ x)), 1e-12)))
    order = rng.permutation(len(examples))
    held = order[: len(order) // 5]
    learn = order[len(held) :]
    z, g2 = np.zeros(((1 << BITS) + 1, c)), np.zeros(((1 << BITS) + 1, c))

    def solved(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        w = -(zr - np.sign(zr) * l1) / ((beta + np.sqrt(g2[rows])) / alpha + l2)
        return np.where(np.abs(zr) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(learn):
            label, hit, x = examples[i]
            rows, value = np.append(hit, 1 << BITS), np.append(x, 1.0)  # the last row is the bias
            w = solved(rows)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            grad = value[:, None] * p
            before = g2[rows]
            g2[rows] = before + grad * grad
            z[rows] += grad - (np.sqrt(g2[rows]) - np.sqrt(before)) / alpha * w
    every = solved(np.arange((1 << BITS) + 1))
    model.weights, model.bias = every[:-1].astype(np.float32), every[-1].astype(np.float32)
    if len(held) and c > 1:
        logits = np.array([examples[i][2] @ model.weights[examples[i][1]] + model.bias for i in held], dtype=np.float64)
        truth = np.array([examples[i][0] for i in held])

        def loss(t: float) -> float:
            s = logits / t
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def identify(docs: DataFrame, held: int = 2, folds: int = 4, per_language: int = 800) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    sample = sample_counts(samples(docs, held, folds, per_language))
    total, frequency = document_frequencies(docs)
    model = train(sample, total, frequency)
    return predict(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", folds) == held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats a language

    def run(batches):
        m = shared.value
        for ids, texts in text_chunks(batches):
            for part_ids, part in grams.passes(ids, [t or "" for t in texts]):
                got = [(UNKNOWN, 0.0) if c is None or m is None else m.predict(c) for c in counted(part)]
                yield {"doc_id": part_ids, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")
