"""The corpus pipeline, stage by stage."""

import random
import zlib

import corpus_pipeline
import pytest
from test_llm import labelled, prose

from tallyspark.llm import near, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    docs, labels = labelled(spark, 300)
    rows = [(r["doc_id"], r["text"], "en", "s", None if r["text"] is None else len(r["text"])) for r in docs.collect()]
    rows += [(1000 + i, rows[2 + i][1], "en", "s", 1) for i in range(5)] + [(2000, prose(random.Random(1), 60) + " token='abcdefghijkl0123' " + prose(random.Random(2), 30), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    labels.write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        docs = near.materialize(out, name)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    toxic = {i for i in before if i is not None and i < 300 and i % 3 == 0 and i != 5}
    assert not toxic & set(seen["toxicity"]) and len(set(before) - set(seen["toxicity"]) - toxic) <= 3 + 5
    bad = {i for i in seen["toxicity"] if i is not None and i < 300 and i % 4 == 1}
    assert len(bad & set(seen["quality"])) <= 1
    assert not {1000 + i for i in range(5)} & set(seen["near_dedup"])
    assert "[SECRET]" in seen["secrets"][2000] and set(seen["secrets"]) == set(seen["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(seen["secrets"])


def test_run_gives_the_packed_rows(spark, folder):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, folder).where("offset + length > 2048").count() == 0


def test_packed_rows_hold_their_tokens(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for packed in (corpus_pipeline.pack(spark, docs, folder), queries.op3_best_fit(spark, folder)):
        rows = packed.select("length", "ids", "ids_crc32").collect()
        assert rows and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
