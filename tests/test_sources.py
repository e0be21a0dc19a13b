import json

import numpy as np
from pyspark.sql import functions as F

from tallyspark.plans import invoices, metrics
from tallyspark.sources import documents, preprocess, sinks
from tallyspark.sources.options import Options
from tallyspark.streaming import files as streaming

FILES = "path string, content bytes, length long".replace("bytes", "binary")


def page(layer, image=b"\x01" * 12):
    return {"index": 0, "image": image, "height": 2, "width": 2, "dpi": 200, "source": "pdf-text" if layer else "pdf-scan", "text_layer": layer}


def test_guards_and_broken_files(spark):
    rows = [("a.pdf", b"", 0), ("b.png", b"junk", 4), ("c.bin", b"x", 26 * 1024 * 1024)]
    got = {r["path"]: r for r in documents.load(spark.createDataFrame(rows, FILES)).collect()}
    assert [got[k]["status"] for k in ("a.pdf", "b.png", "c.bin")] == [400, 400, 413]
    assert got["b.png"]["error"] and not got["b.png"]["pages"]


def test_is_pdf(spark):
    df = spark.createDataFrame([(b"%PDF-1.7", None, None), (b"x", "application/PDF", "a"), (b"x", "image/png", "A.PDF"), (b"x", "image/png", "a.png")], "c binary, t string, n string")
    assert [r[0] for r in df.select(documents.is_pdf(F.col("c"), F.col("t"), F.col("n"))).collect()] == [True, True, True, False]


def test_text_layer_reader_and_json(spark):
    def codec(content, pdf, options):
        return [page("Invoice No: A-77\nGrand Total: 10.00"), page(" \n"), page("second page")], "pdf-text", None

    read = documents.read(spark.createDataFrame([("a.pdf", b"%PDF-", 5)], FILES), codec=codec)
    r = invoices.result(invoices.structure(read))
    x = json.loads(invoices.to_json(r).first()["json"])
    assert x["pageCount"] == 3 and x["text"].endswith("\n\nsecond page") and x["invoice"]["invoice"]["number"] == "A-77"
    assert x["invoice"]["invoice"]["dueDate"] is None and "dueDate" in x["invoice"]["invoice"]


def test_detected_pages_and_missing_reader(spark):
    def codec(content, pdf, options):
        return [page("layer"), page("")], "ocr", None

    def detect(image, height, width):
        return [(30.0, 0.0, "below"), (1.0, 50.0, "right"), (2.0, 0.0, "left"), (5.0, 5.0, "  ")]

    df = spark.createDataFrame([("a.pdf", b"%PDF-", 5)], FILES)
    got = documents.read(df, Options(reader_engine="rapid"), codec, detect).first()
    assert got["text"] == "layer\n\nleft  right\nbelow"
    lacking = documents.read(df, Options(reader_engine="rapid"), codec).first()
    assert lacking["status"] == 503 and lacking["error"]
    assert documents.extract(df, codec=codec).first()["engine"] == "null"


def rows_of(spark, *pages_of):
    names = [f"{i}.pdf" for i in range(len(pages_of))]
    return spark.createDataFrame([(n, b"%PDF-", 5) for n in names], FILES), lambda content, pdf, options: (list(pages_of[0]), "ocr", None)


def test_bytes_to_json_through_codec_enhancer_reader_and_model(spark):
    """The whole job: a page with a text layer skips both the enhancer and the reader."""
    df, codec = rows_of(spark, [page("Invoice No: B-1\nDate: 1"), page("")])

    def enhance(image, options):
        return np.full((4, 6, 3), 7, np.uint8)

    def detect(image, height, width):
        assert (height, width, image[0]) == (4, 6, 7)  # the enhanced image
        return [(90.0, 0.0, "Grand Total: 118.00"), (0.0, 60.0, "9983"), (0.0, 0.0, "Survey work")]

    def model(prompts):
        assert "prompt" in prompts.columns
        answer = json.dumps({"seller": {"name": "Lens & Co"}, "lineItems": [{"description": "Survey work", "quantity": 1, "rate": 100, "gstRate": 18, "taxableAmount": 100}]})
        return prompts.withColumn("answer", F.when(F.col("prompt").contains("Survey work  9983"), answer))

    done = invoices.parse(df, Options(), model, codec, detect, None, enhance)
    x = json.loads(invoices.to_json(done).first()["json"])
    assert x["pageCount"] == 2 and x["method"] == "ocr" and x["durationMs"] >= 0
    assert x["text"] == "Invoice No: B-1\nDate: 1\n\nSurvey work  9983\nGrand Total: 118.00"
    line = x["invoice"]["lineItems"][0]
    assert (line["hsnSac"], line["taxableAmount"], x["invoice"]["invoice"]["number"], x["invoice"]["seller"]["name"]) == ("9983", 100.0, "B-1", "Lens & Co")


def test_markdown_reader_and_layout_by_page(spark):
    """A table at the end of a page does not run on into the next; results of any shape are decoded."""
    df, codec = rows_of(spark, [page(""), page(""), page("layer")])
    shapes = iter([{"markdown": {"markdown_texts": "# Head\n| Item | Rate |\n|---|---|\n| a | 1 |"}}, ["| Item | Rate |\n| b | 2 |", None]])
    out = documents.read(df, Options(preprocess=False, reader_engine="vl"), codec, write=lambda image, height, width: next(shapes)).first()
    assert out["pageMarkdowns"][1:] == ["| Item | Rate |\n| b | 2 |", "layer"] and out["text"].startswith("Head\nItem")
    kept = spark.createDataFrame([out.asDict()], "text string, markdown string, pageMarkdowns array<string>")
    blocks = kept.select(invoices.page_blocks(kept, F.col("markdown")).alias("b")).first()["b"]
    assert [(b["kind"], b["reading_order"]) for b in blocks] == [("title", 0), ("table", 1), ("table", 0), ("text", 0)]
    given = kept.withColumn("pageBlocks", F.array(*(F.array(F.struct(F.lit("table").alias("kind"), F.lit("own").alias("text"), F.lit(0).alias("reading_order"), F.array(F.array(F.lit("x"))).alias("table"))) for _ in range(1))))
    blocks = given.select(invoices.page_blocks(given, F.col("markdown")).alias("b")).first()["b"]
    assert [b["text"] for b in blocks] == ["own", "| Item | Rate |\n| b | 2 |", "layer"]

    class Saves:
        markdown = None

        def save_to_markdown(self, save_path):
            open(f"{save_path}/a.md", "w").write(" saved ")

    assert [documents.markdown_of(r) for r in (None, " a ", {"markdown": "b"}, {"markdown": {"markdown": "c"}}, {"json": {"k": 1}}, {}, Saves())] == ["", "a", "b", "c", '{"k": 1}', "", "saved"]


def test_registered_readers_and_extractors(spark):
    df, codec = rows_of(spark, [page("")])

    def lines(options):
        return lambda image, height, width: (["low", "right", "left", " "], [[0, 50, 9, 60], [[30, 2], [40, 2], [40, 9]], [[1, 0], [9, 0]]])

    def broken(options):
        raise RuntimeError("no model here")

    try:
        documents.READERS["classic"] = documents.Reader("boxes", lines)
        documents.EXTRACTORS["tiny"] = lambda options: lambda prompt: '{"seller": {"name": "T%d"}}' % options.output_tokens
        options = Options(reader_engine="ppocr", extractor_engine="tiny", output_tokens=7)
        assert documents.health(options)["status"] == "ok"
        out = invoices.parse(df, options, codec=codec).first()
        assert out["text"] == "left  right\nlow" and out["invoice"]["seller"]["name"] == "T7"
        documents.EXTRACTORS["tiny"] = broken
        assert invoices.parse(df, options, codec=codec).first()["status"] == 200  # the rules extract
        strict = Options(reader_engine="ppocr", extractor_engine="tiny", fallback=False)
        assert invoices.parse(df, strict, codec=codec).first()["status"] == 503
        documents.READERS["classic"] = documents.Reader("tokens", broken)
        failed = invoices.parse(df, options, codec=codec).first()
        assert failed["status"] == 503 and "no model here" in failed["error"]
    finally:
        documents.READERS.clear()
        documents.EXTRACTORS.clear()
    absent = Options(extractor_engine="absent", fallback=False)
    assert invoices.parse(*rows_of(spark, [page("text")])[:1], absent, codec=lambda c, p, o: ([page("text")], "pdf-text", None)).first()["status"] == 503


def test_artifacts_are_kept_when_switched_on(spark, tmp_path):
    df, _ = rows_of(spark, [])
    rows = invoices.structured(df, codec=lambda c, p, o: ([page("Invoice No: Q-5\nGrand Total: 7.00")], "pdf-text", None)).withColumn("request_id", F.lit("r9"))
    sinks.write_job(rows, str(tmp_path / "off"), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "off")).count() == 1 and not (tmp_path / "none").exists()
    sinks.write_job(rows, str(tmp_path / "on"), str(tmp_path / "kept"), Options(save_artifacts=True))
    kept = {r["name"]: r["value"] for r in spark.read.text(str(tmp_path / "kept"), wholetext=True).collect()}
    assert kept["reader.md"].startswith("Invoice No: Q-5") and json.loads(kept["raw.json"])["invoice"]["number"] == "Q-5"
    sinks.write_byte_artifacts(spark.createDataFrame([("r1", b"ab"), ("r2", b"")], "request_id string, v binary"), str(tmp_path / "bytes"), "page.png", "v")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "bytes")).select("request_id", "name", "value").collect()] == [("r1", "page.png", bytearray(b"ab"))]


def test_preprocess_skips_text_pages_and_failures(spark):
    def codec(content, pdf, options):
        return [page("layer"), page("")], "ocr", None

    loaded = documents.load(spark.createDataFrame([("a.pdf", b"%PDF-", 5)], FILES), codec=codec)
    pages = preprocess.preprocess(loaded, function=lambda a, o: np.zeros((4, 4, 3), np.uint8)).first()["pages"]
    assert (pages[0]["height"], pages[1]["height"]) == (2, 4)
    assert preprocess.preprocess(loaded, Options(preprocess=False)) is loaded
    image = np.full((200, 300, 3), 255, np.uint8)
    assert preprocess.enhance(image, Options()).dtype == np.uint8


def test_image_arithmetic(spark):
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame([([(0.0, 0.0, 100.0, 5.0), (0.0, 0.0, 1.0, 90.0), (0.0, 0.0, 100.0, 7.0), (0.0, 0.0, 100.0, 9.0)],), ([],)], f"s {kind}")
    angle = [r[0] for r in df.select(preprocess.skew_angle(F.col("s"))).collect()]
    assert abs(angle[0] - 4.0) < 0.02 and angle[1] is None
    scale = spark.createDataFrame([(200, 300), (900, 5000), (990, 1200), (2000, 2000)], "h int, w int").select(documents.resize_scale(F.col("h"), F.col("w")))
    assert [round(r[0], 3) for r in scale.collect()] == [5.0, 0.8, 1.0, 1.0]
    assert documents.to_rgb(bytes(range(4)), 2, 2, 1).shape == (2, 2, 3) and documents.to_rgb(bytes(16), 2, 2, 4).shape == (2, 2, 3)


def test_options_and_health(spark):
    spark.conf.set("spark.tallyspark.max_pages", "7")
    spark.conf.set("spark.tallyspark.threshold", "true")
    assert (Options.of(spark).max_pages, Options.of(spark).threshold) == (7, True)
    assert documents.health()["status"] == "ok" and documents.health(Options(reader_engine="vl"))["status"] == "degraded"
    assert [documents.engine_of(n) for n in ("pdf-text", "VL", "ppocr", "anything")] == ["null", "vl", "classic", "detection"]


def test_sinks_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Invoice No: S-100\nGrand Total: 12.50\n")
    (source / "b.txt").write_text("  \n")
    q = streaming.parse_texts(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert json.loads(got["a.txt"]["json"])["invoice"]["invoice"]["number"] == "S-100" and got["b.txt"]["status"] == 400
    df = spark.createDataFrame([("r1", "text", "Invoice No: Z-9", "Invoice No: Z-9"), ("r2", "", "x", "x")], "request_id string, reader string, text string, markdown string")
    sinks.write_artifacts(df, str(tmp_path / "art"), "reader.md", "reader")
    assert (tmp_path / "art" / "request_id=r1" / "name=reader.md").exists() and not (tmp_path / "art" / "request_id=r2").exists()
    sinks.write_json(invoices.result(invoices.structure(df)), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 2


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (3, 1, 2, 4, 10)], "k string, s double")
    assert tuple(metrics.latency(df, "k", "s").first()) == ("a", 5, 3.0, 10.0, 10.0)
    r = metrics.bench_stats(df, "k", "s", 1.0).first()
    assert (r["best"], r["mean"], r["passed"]) == (1.0, 4.0, True)


def test_latency_on_many_partitions(spark):
    """What deals the values to tasks must come out the same wherever it is computed."""
    def want(values):
        v = sorted(values)
        return (len(v), v[round(0.5 * (len(v) - 1))], v[round(0.95 * (len(v) - 1))], v[-1])

    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(0, 300_000, 1, 16).select((F.col("id") % 2).cast("string").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 100.0).alias("s"))
        values = df.collect()
        got = {r["k"]: tuple(r)[1:] for r in metrics.latency(df, "k", "s").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: want([r["s"] for r in values if r["k"] == k]) for k in "01"}


def test_latency_of_odd_values(spark):
    inf = float("inf")
    odd = [-inf, -1e308, -2.5, -0.25, -5e-324, 0.0, 5e-324, 1e-9, 0.004, 0.005, 3.0, 1e9, 1.7e308, inf]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in odd] + [("b", float("nan")), ("b", 1.0), ("b", None), ("c", -0.0)], "k string, s double")
    got = {r["k"]: tuple(r)[1:] for r in metrics.latency(df, "k", "s").collect()}
    assert got["a"] == got[None] == (14, odd[6], odd[12], inf) and got["c"] == (1, 0.0, 0.0, 0.0)
    assert got["b"][:2] == (2, 1.0) and str(got["b"][2]) == str(got["b"][3]) == "nan"
    parts = [r["p"] for r in spark.createDataFrame([(v,) for v in [*odd, float("nan")]], "s double").select(metrics.value_range(F.col("s")).alias("p")).collect()]
    assert parts == sorted(parts)
