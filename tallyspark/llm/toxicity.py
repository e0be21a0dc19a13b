"""Operator 6: toxicity by nearest labelled examples.

Terms are words. The vocabulary is all words that occur in two or more texts of a bounded labelled sample
of both classes (a word of one example can bring no two texts together). Document frequencies
are counted over all documents. A document's neighbours are the examples of highest TF-IDF
cosine, found exactly by a block-max inverted index: similar examples share a block, each term has
its largest weight in each block, and blocks are opened by falling upper bound until no closed one
can hold a nearer example. The neighbours' labels vote, weighted by similarity. A second vote, by
an index of the same kind, is that of the nearest examples by the tied terms alone (chi-squared test
on the sample, largest first), which a long text's other words would drown. A logistic curve fitted
to leave-one-out votes of the examples, at the labels' true class rates, turns both into a probability.

Texts without any term of the vocabulary (empty and null ones too) get the rate of class 1 among
such examples. Without labels of both classes the score is 0. Rows are scored by themselves:
null ids and repeated rows are kept, an empty table gives an empty result, other columns are
ignored. The index holds at most ``2 * examples`` examples. A text is taken in slices of ``PASS`` code
points, so that a very long one holds no more words at once than others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import grams
from tallyspark.llm.common import arrow_map, fold, labelled_sample, text_chunks, text_scores

WORD = re.compile(r"[^\W\d_]+")
#: Examples of a block.
BLOCK = 128
#: Of the 256 characters of Latin-1, the lower case of those in words, a space for the others.
_LATIN = b"".join(c.lower().encode("latin-1") if WORD.match(c) else b" " for c in map(chr, range(256)))


def words_of(text: str) -> list:
    """The words of a text in lower case, as Latin-1 bytes or, where it has other characters, as text."""
    try:
        return text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


class TermCounter:
    """Counts the vocabulary's words in texts. What it holds is the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]):
        self.places = dict(vocabulary)
        for word, i in vocabulary.items():
            if words_of(word) and isinstance(words_of(word)[0], bytes):
                self.places[word.encode("latin-1")] = i
        self.size = len(vocabulary)

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every occurrence."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        codes = np.fromiter(map(self.places.get, chain.from_iterable(split), repeat(-1)), dtype=np.int64, count=int(sizes.sum()))
        known = codes >= 0
        return np.repeat(np.arange(len(texts)), sizes)[known], codes[known]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences), by row and term, of texts of together about PASS code points."""
        if len(texts) == 1 and len(texts[0]) > grams.PASS:
            total = np.zeros(self.size, dtype=np.int64)
            for part in grams.slices(texts[0]):
                total += np.bincount(self._codes([part])[1], minlength=self.size)
            hit = np.flatnonzero(total)
            return np.zeros(len(hit), np.int64), hit, total[hit]
        rows, codes = self._codes(texts)
        most = max(1, self.size)
        key, n = np.unique(rows * most + codes, return_counts=True)
        return key // most, key % most, n


class BlockMaxIndex:
    """Inverted index over unit vectors, given as (example, term, weight), with the largest weight of each term in each block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms: int):
        self.size, self.blocks = size, max(1, -(-size // BLOCK))
        key = term * self.blocks + example // BLOCK
        order = np.argsort(key, kind="stable")
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=terms * self.blocks))]).astype(np.int32)
        maxima = np.zeros(terms * self.blocks, np.float32)
        np.maximum.at(maxima, key, np.nextafter(weight.astype(np.float32), np.float32(2)))  # never under the weight
        self.maxima = maxima.reshape(terms, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k of highest positive cosine, ties to the smaller number. Exact."""
        bounds = weights @ self.maxima[terms]
        order = np.argsort(-bounds, kind="stable")
        scores, least, done, step = np.zeros(self.size), 0.0, 0, 2
        while done < self.blocks:
            some = order[done : done + step]
            some = some[(bounds[some] > 0) & (bounds[some] >= least - 1e-9)]
            if not len(some):
                break
            key = (terms[:, None] * self.blocks + some).ravel()
            first, many = self.at[key], self.at[key + 1] - self.at[key]
            ends = np.cumsum(many)
            where = np.repeat(first - ends + many, many) + np.arange(ends[-1])
            scores += np.bincount(self.example[where], self.weight[where] * np.repeat(np.repeat(weights, len(some)), many), self.size)
            if skip >= 0:
                scores[skip] = 0
            if np.count_nonzero(scores) > k:
                least = float(np.partition(scores, self.size - k)[self.size - k])
            done += step
            step *= 4
            if stats is not None:
                stats["opened"] = stats.get("opened", 0) + len(some)
        found = np.flatnonzero((scores > 0) & (scores >= least))
        found = found[np.argsort(-scores[found], kind="stable")][:k]
        return scores[found], found


def by_likeness(example: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms: int) -> np.ndarray:
    """An order of the examples in which similar ones are close: halves by the sign of the main component, again and again."""
    order, todo = [], [np.arange(size)]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            order.append(part)
            continue
        place = np.full(size, -1)
        place[part] = np.arange(len(part))
        mine = place[example] >= 0
        e, t, w = place[example[mine]], term[mine], weight[mine]
        mean = np.bincount(t, w, terms) / len(part)
        side = np.cos(np.arange(len(part)))
        for _ in range(8):
            axis = np.bincount(t, w * side[e], terms) - mean * side.sum()
            side = np.bincount(e, w * axis[t], len(part)) - mean @ axis
            side /= np.abs(side).max() or 1.0
        half = -(-len(part) // (2 * BLOCK)) * BLOCK  # blocks stay whole
        split = part[np.argsort(side, kind="stable")]
        todo += [split[half:], split[:half]]
    return np.concatenate(order) if order else np.zeros(0, np.int64)


@dataclass
class Model:
    vocabulary: dict[str, int]  # the terms tied to class 1 first
    tied: int
    idf: np.ndarray
    full: BlockMaxIndex
    index: BlockMaxIndex
    ids: list[int]
    labels: np.ndarray
    neighbours: int
    tied_neighbours: int
    curve: np.ndarray  # logistic coefficients: constant; vote, similarity, mass; vote, similarity, mass of tied terms
    empty_rate: float

    def weights(self, row, term, n, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors, as (row, term, weight)."""
        w = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, w * w, rows))
        return row, term, w / norm[row]

    def vectors(self, row, term, n, rows: int) -> tuple[tuple, tuple]:
        """Over all terms, and over the tied ones."""
        return self.weights(row, term, n, rows), self.weights(*(x[term < self.tied] for x in (row, term, n)), rows)

    def _vote(self, scores: np.ndarray, near: np.ndarray) -> list[float]:
        return [float(scores @ self.labels[near] / scores.sum()), float(scores[0])] if len(near) else [0.0, 0.0]

    def votes(self, counted: tuple, rows: int, alone: bool = False) -> Iterator[tuple[list[float] | None, np.ndarray]]:
        """For each text its votes (None without terms) and its nearest examples; ``alone``: text i is example i, which has no vote."""
        row, term, n = counted
        (_, _, w), (tied_row, tied_term, tied_w) = self.vectors(row, term, n, rows)
        edges, tied = (np.searchsorted(x, np.arange(rows + 1)) for x in (row, tied_row))
        for i in range(rows):
            if edges[i] == edges[i + 1]:
                yield None, np.zeros(0, np.int64)
                continue
            some = slice(edges[i], edges[i + 1])
            mass, tied_mass = math.log1p(n[some].sum()), math.log1p(n[some][term[some] < self.tied].sum())
            skip = i if alone else -1
            scores, near = self.full.nearest(term[some], w[some], self.neighbours, skip)
            by_tied = [0.0, 0.0]
            if tied[i] < tied[i + 1]:
                by_tied = self._vote(*self.index.nearest(tied_term[tied[i] : tied[i + 1]], tied_w[tied[i] : tied[i + 1]], self.tied_neighbours, skip))
            yield [1.0, *self._vote(scores, near), mass, *by_tied, tied_mass], near

    def judge(self, counter: TermCounter, texts: list[str]) -> Iterator[tuple[float, list[int]]]:
        """For each text the score, and as evidence the ids of the nearest examples, nearest first."""
        for x, near in self.votes(counter.count(texts), len(texts)):
            if x is None:
                yield self.empty_rate, []
            else:
                yield 1 / (1 + math.exp(-float(np.dot(self.curve, x)))), [self.ids[i] for i in near]


def _passes(batches) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of together about PASS code points each."""
    for ids, texts in text_chunks(batches):
        yield from grams.passes(ids, [t or "" for t in texts])


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, a, b): examples of class 1 and 0 of a labelled sample that hold the term."""

    def run(batches):
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = set()
                for part in grams.slices(text):
                    found.update(w if isinstance(w, str) else w.decode("latin-1") for w in set(words_of(part)))
                yield {"term": list(found), "y": [y] * len(found)}

    return arrow_map(sample, run, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))


def select_terms(counts: DataFrame, positives: int, negatives: int, terms: int, lift: float = 4.0, chi2: float = 30.0) -> list[str]:
    """Terms tied to class 1, by falling chi-squared."""
    n, p, q = positives + negatives, float(positives), float(negatives)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    value = n * (a * (q - b) - b * (p - a)) ** 2 / (p * q * (a + b) * (n - a - b + 1e-9))
    kept = counts.where((a >= 5) & (a / p >= lift * (b + 0.5) / q)).withColumn("chi2", value).where(F.col("chi2") >= chi2)
    return [r["term"] for r in kept.orderBy(F.desc("chi2"), "term").limit(terms).collect()]


def counted_terms(sample: DataFrame, vocabulary: dict[str, int]) -> list:
    """(doc_id, y, terms, counts) of a bounded sample, counted on the executors, in the order of the ids."""

    def run(batches):
        counter = TermCounter(vocabulary)
        for b in batches:
            for doc_id, text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, term, n = counter.count([text])
                yield {"doc_id": [doc_id], "y": [y], "terms": [term.astype("<i8").tobytes()], "counts": [n.astype("<i8").tobytes()]}

    return sorted(arrow_map(sample, run, "doc_id long, y int, terms binary, counts binary").collect(), key=lambda r: r["doc_id"])


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each term of the vocabulary occurs: all whole texts are counted."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of the sample, which bounds them

    def run(batches):
        counter, total = TermCounter(shared.value), 0
        found = np.zeros(counter.size + 1, dtype=np.int64)
        for _, texts in _passes(batches):
            total += len(texts)
            found[:-1] += np.bincount(counter.count(texts)[1], minlength=len(found) - 1)
        found[-1] = total
        hit = np.flatnonzero(found)
        yield {"term": hit.tolist(), "n": found[hit].tolist()}

    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in arrow_map(docs.select("doc_id", "text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[-1]), out[:-1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, label_rows: DataFrame, held: int = 0, folds: int = 5, examples: int = 1500, terms: int = 1024, neighbours: int = 50, tied_neighbours: int = 10) -> Model | None:
    learn = label_rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", folds) != held))
    rates = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = labelled_sample(docs, label_rows, "toxic", folds, held, {0: examples, 1: examples}).cache()
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        sample.unpersist()
        return None
    counts = term_counts(sample).cache()
    tied = select_terms(counts, sizes[1], sizes[0], terms)
    words = [r["term"] for r in counts.where("a + b >= 2").select("term").orderBy("term").collect()]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(tied + words))}
    rows = counted_terms(sample, vocabulary)
    counts.unpersist()
    sample.unpersist()
    total, frequency = document_frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + frequency)) + 0.1
    counted = [tuple(np.frombuffer(r[k], "<i8") for k in ("terms", "counts")) for r in rows]
    weight = {y: rates[y] / sizes[y] for y in sizes}
    empty = {y: weight[y] * sum(r["y"] == y and not len(c[0]) for r, c in zip(rows, counted, strict=True)) for y in (0, 1)}
    some = [(r, c) for r, c in zip(rows, counted, strict=True) if len(c[0])]
    none = BlockMaxIndex(*(np.zeros(0, t) for t in (np.int64, np.int64, float)), 0, 0)
    model = Model(vocabulary, len(tied), idf, none, none, [], np.zeros(0), neighbours, tied_neighbours, np.zeros(7), (empty[1] + 0.01) / (empty[0] + empty[1] + 1))
    if some:
        size = len(some)

        def flat(order):
            sizes = [len(some[i][1][0]) for i in order]
            return np.repeat(np.arange(size), sizes), *(np.concatenate([some[i][1][k] for i in order]) for k in (0, 1))

        order = by_likeness(*model.vectors(*flat(range(size)), size)[0], size, len(vocabulary))
        model.ids, model.labels = [some[i][0]["doc_id"] for i in order], np.array([some[i][0]["y"] for i in order], dtype=float)
        every = flat(order)
        full, of_tied = model.vectors(*every, size)
        model.full, model.index = BlockMaxIndex(*full, size, len(vocabulary)), BlockMaxIndex(*of_tied, size, len(tied))
        x = np.array([v for v, _ in model.votes(every, size, alone=True)])
        model.curve = _logistic(x, model.labels, np.array([weight[int(y)] for y in model.labels]))
    return model


def scored(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """``docs`` with a column of scores; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * examples vectors
    counters: list[TermCounter] = []

    def scores(texts: list[str]) -> list[float]:
        m = shared.value
        if m is None:
            return [0.0] * len(texts)
        if not counters:
            counters.append(TermCounter(m.vocabulary))
        return [s for _, part in grams.passes(texts, texts) for s, _ in m.judge(counters[0], part)]

    return text_scores(docs, into, scores)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, neighbours): the nearest labelled examples' ids, nearest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        counter = TermCounter(m.vocabulary)
        for ids, texts in _passes(batches):
            got = list(m.judge(counter, texts))
            yield {"doc_id": ids, "score": [g[0] for g in got], "neighbours": [g[1] for g in got]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, neighbours array<long>")


def assess(docs: DataFrame, label_rows: DataFrame, held: int = 0, folds: int = 5, threshold: float = 0.5, **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(rows, train(docs, label_rows, held, folds, **kw))
    return rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
