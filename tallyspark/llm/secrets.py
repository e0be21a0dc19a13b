"""Operator 7: secret scans by fixed patterns and character Markov models, without Python on executors.

Fixed patterns give the base spans. Beside them, every maximal run of at least ``min_length``
token characters that overlaps no base span is scored by two first-order Markov models of
characters, one of random strings and one of ordinary identifiers: the sum over its pairs of
neighbours of the log-likelihood ratio. Runs at the threshold or more are spans of kind ``random``,
unless their shape is that of an ordinary number (:data:`ORDINARY`: UUIDs, dates and other runs of
digits and marks). The models are pair counts of labelled samples with additive smoothing; on the
corpus itself, all base matches are the random ones and the words of all documents outside them, with
and without digits, the ordinary ones: equal values are counted first, and their counts weigh them, so
nothing is sampled. Four fifths of the values (by a hash of the value) train; the rest set the threshold: ``least`` nats, or the score that one in a thousand of
the ordinary ones exceeds if that is more (:func:`calibrate`, which also measures precision and recall).

Positions are code points from 0, the end exclusive. Null texts count as empty and have no
spans; rows are independent, so null ids, repeated rows and extra columns change nothing; an
empty table gives an empty result, and models without samples give no ``random`` spans.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base kinds, and the lengths their matches must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
#: Characters of the runs that the models score, and of what the samples may hold.
RUN = r"[A-Za-z0-9+/_=-]"
#: Shapes of runs that are no secrets however unlikely their characters: UUIDs, and digits with marks (dates, phone numbers).
ORDINARY = r"(?i)^[-=]*(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9+/_=-]+)[-=]*$"
#: Of the samples, one part in so many is held out.
HELD = 5
#: Code points that the models know; others share the last class.
CLASSES = 128


def _positions(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value: the group, or the match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("size"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc, x):
        start = acc["pos"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(
        F.filter(steps, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("pos"), empty.alias("out")), add, lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), found).otherwise(empty)


def find_base(docs: DataFrame, min_length: int = 16, keep_rows: bool = False) -> DataFrame:
    """(doc_id, assign, access, hex, runs[, row]): spans with values, each an array by start; ``row``: the document's columns."""
    text = F.col("text")
    run = RUN + "{" + str(min_length) + ",}"
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * keep_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    rows = rows.withColumn("runs", _positions(text, run))
    # matches of the other two kinds that are long enough lie within a run
    inside = F.size("runs") > 0
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    short = RUN + "{" + str(min(min_length, 16)) + ",}"
    some = inside if min_length <= 16 else text.rlike(short)
    return rows.select(
        "doc_id",
        F.filter(_positions(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LENGTH).alias("assign"),
        F.when(some, F.filter(_positions(text, ACCESS), lambda x: F.length(x["value"]) >= ACCESS_LENGTH)).otherwise(none).alias("access"),
        F.when(some, _positions(text, HEX)).otherwise(none).alias("hex"),
        "runs",
        *["row"] * keep_rows,
    )


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(CLASSES - 1)))


def _pairs(value: Column) -> Column:
    """Indices into a table of CLASSES * CLASSES, one for each pair of neighbours."""
    codes = _codes(value)
    return F.zip_with(F.slice(codes, 1, F.greatest(F.length(value) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.length(value), F.lit(1))), lambda a, b: F.when(b.isNotNull(), a * CLASSES + b))


def _times(samples: DataFrame) -> Column:
    return F.col("n") if "n" in samples.columns else F.lit(1).cast("long")


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all pairs from labelled samples (value, label 1: random, 0: ordinary[, n: how often]).

    The counts that reach the driver are at most 2 * CLASSES * CLASSES rows.
    """
    pairs = samples.select("label", _times(samples).alias("n"), F.explode(_pairs(F.col("value"))).alias("pair")).where("pair IS NOT NULL")
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()}
    if {0, 1} - {label for label, _ in counts}:
        return []
    known = [chr(c) for c in range(CLASSES) if chr(c).isalnum() or chr(c) in "+/_=-"]
    codes = sorted({ord(c) for c in known})
    logs: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for label, log in logs.items():
        for a in codes:
            total = sum(counts.get((label, a * CLASSES + b), 0) for b in codes) + smoothing * len(codes)
            for b in codes:
                log[a * CLASSES + b] = math.log((counts.get((label, a * CLASSES + b), 0) + smoothing) / total)
    return [logs[1].get(i, 0.0) - logs[0].get(i, 0.0) for i in range(CLASSES * CLASSES)]


def log_ratio(value: Column, model: list[float]) -> Column:
    """Sum of the pairs' log-likelihood ratios; 0 without a model."""
    if not model:
        return F.lit(0.0)
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    scores = F.transform(_pairs(value), lambda i: F.coalesce(F.get(table, i), F.lit(0.0)))
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)


def corpus_samples(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(value, label, n) of the whole corpus: base matches by their number, and words outside them by the number of documents that hold them."""
    values = F.concat(*(F.transform(k, lambda x: x["value"]) for k in KINDS[:3]))
    secrets = base.select(F.explode(values).alias("value"), F.lit(1).alias("label"))
    words = docs.select(F.explode(F.array_except(F.regexp_extract_all("text", F.lit(RUN + "{4,}"), F.lit(0)), F.flatten(F.array(
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))))).alias("value"))
    ordinary = words.where(~F.col("value").contains("=")).select("value", F.lit(0).alias("label"))
    return secrets.unionByName(ordinary).groupBy("value", "label").agg(F.count("*").alias("n"))


def held_out(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples to train on, and the rest; equal values lie together."""
    part = F.pmod(F.xxhash64(F.lit(29), "value"), F.lit(HELD))
    return samples.where(part != 0), samples.where(part == 0)


def calibrate(samples: DataFrame, model: list[float], least: float = 12.0, min_length: int = 16) -> dict[str, float]:
    """From samples (value, label[, n]) that did not train: the threshold, and at it recall and precision on values of ``min_length`` or more.

    The percentile is of ratios rounded up to hundredths, so that what one task holds is bounded by their range;
    without such samples the threshold is ``least`` and both are 1.
    """
    some = samples.where((F.length("value") >= min_length) & ~F.col("value").rlike(ORDINARY)).select("label", _times(samples).alias("n"), log_ratio(F.col("value"), model).alias("ratio"))
    ordinary = some.where("label = 0").groupBy((F.ceil(F.col("ratio") * 100) / 100).alias("ratio")).agg(F.sum("n").alias("n"))
    high = ordinary.agg(F.percentile("ratio", 0.999, F.col("n")).alias("high")).first()["high"]
    threshold = max(least, high if high is not None else least)
    hit = F.col("ratio") >= threshold
    n = some.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("tp", (F.col("label") == 1) & hit), ("p", F.col("label") == 1), ("said", hit)))).first()
    return {"threshold": threshold, "recall": n["tp"] / n["p"] if n["p"] else 1.0, "precision": n["tp"] / n["said"] if n["said"] else 1.0}


def learn(docs: DataFrame, base: DataFrame, least: float = 12.0, min_length: int = 16) -> tuple[list[float], dict[str, float]]:
    """A model trained on the corpus, and its threshold with the held-out measures."""
    values = materialize(corpus_samples(docs, base), "samples")
    training, rest = held_out(values)
    model = train(training)
    told = calibrate(rest, model, least, min_length)
    discard(values)
    return model, told


def scan(docs: DataFrame, model: list[float] | None = None, min_length: int = 16, threshold: float = 12.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, found): found is array<struct<start, kind, end, value>> by start, then kind.

    Without a model, one is trained on the corpus itself, and ``threshold`` is the least that it may be.
    """
    base = materialize(find_base(docs, min_length), "secrets")
    if model is None:
        model, told = learn(docs, base, threshold, min_length)
        threshold = told["threshold"]
    return score(base, model, threshold)


def score(base: DataFrame, model: list[float], threshold: float) -> DataFrame:
    fixed = F.concat("assign", "access", "hex")
    fresh = F.filter("runs", lambda x: ~_overlaps(x, F.col("fixed")))
    ratios = F.filter(F.col("fresh"), lambda x: (log_ratio(x["value"], model) >= threshold) & ~x["value"].rlike(ORDINARY))
    rows = base.withColumn("fixed", fixed).withColumn("fresh", fresh).withColumn("random", ratios)

    def of_kind(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    every = F.concat(*map(of_kind, range(len(KINDS))))
    kept = [c for c in base.columns if c == "row"]
    return rows.select("doc_id", *kept, *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.array_sort(every).alias("found"))


def redact_documents(docs: DataFrame, model: list[float] | None = None, min_length: int = 16, threshold: float = 12.0) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; ``n_chars``, if there, follows the text."""
    base = materialize(find_base(docs, min_length, keep_rows=True), "secrets")
    if model is None:
        model, told = learn(docs, base, threshold, min_length)
        threshold = told["threshold"]
    found = score(base, model, threshold)
    text = redact(F.col("row.text"), F.col("found"))
    values = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.size("found") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    return found.select(*(v.alias(c) for c, v in values.items()))


def span_text(found: Column, kinds: int = len(KINDS)) -> Column:
    """kind:start:end of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter(found, lambda x: x["kind"] < kinds)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by ``[SECRET]``."""
    mark = "[SECRET]"

    def step(acc, x):
        new = x["start"] >= acc["pos"]
        gap = F.when(new, F.concat(F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], F.array(gap)).alias("out"))

    parts = F.aggregate(found, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, F.length(text)))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)
