"""A corpus for training: toxicity, quality, near duplicates, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``. Null and empty texts pass the filters by their scores;
an empty table stays empty; further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, near, packing, quality, secrets, toxicity


def _without(docs: DataFrame, scored: DataFrame, keep) -> DataFrame:
    return scored.where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free_name(docs: DataFrame) -> str:
    name = "score"
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go."""
    name = _free_name(docs)
    return _without(docs, toxicity.scored(docs, toxicity.train(docs, common.labels(spark, sf_dir)), name), F.col(name) < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 for quality go: as likely as not they are good is enough to stay."""
    name = _free_name(docs)
    return _without(docs, quality.scored(docs, quality.train(docs, common.labels(spark, sf_dir)), name), F.col(name) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays."""
    return near.deduplicate(docs, words=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; the documents stay."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages learn and link iteratively: not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            common.discard(before)  # nothing reads a stage's input any more once its output is written
    return STAGES[-1][1](spark, docs, sf_dir)
