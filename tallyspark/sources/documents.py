"""Document bytes to pages to text, as data: rows never fail a job, they carry a status.

Codecs and readers that need native libraries are functions handed in or registered; the default
reader is the text layer. Each runs once a partition over Arrow batches, so a model is loaded once.
"""

from __future__ import annotations

import io
import json
import tempfile
import time
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tallyspark.operators import reading
from tallyspark.sources.options import Options

PAGE = "struct<index:int,image:binary,height:int,width:int,dpi:int,source:string,text_layer:string>"

#: Engine names of readers, from the name in the options to the registered one.
ENGINES = {"null": "null", "none": "null", "pdf-text": "null", "paddleocr-vl": "vl", "vl": "vl", "paddleocr": "classic", "ppocr": "classic", "classic": "classic"}
@dataclass(frozen=True)
class Reader:
    """A page reader: ``load(options)`` is called once a partition and gives a function(image bytes, height, width).

    kind ``tokens``: the function returns (y, x, text) tuples; ``boxes``: texts, and for each a flat box (x1, y1, x2, y2) or a
    polygon of points, as far as there are any; ``markdown``: whatever :func:`markdown_of` understands.
    """

    kind: str
    load: Callable


#: Registered readers, by engine; and extractors: ``load(options)`` gives a function from a prompt to an answer.
READERS: dict[str, Reader] = {}
EXTRACTORS: dict[str, Callable] = {}


def engine_of(name: str) -> str:
    """Any other name means the detection engine."""
    return ENGINES.get(name.lower(), "detection")


def extractor_of(name: str) -> str:
    return "rules" if name.lower() in ("rules", "none", "null") else "model"


def is_pdf(content: Column, content_type: Column, name: Column) -> Column:
    magic = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    return F.coalesce(magic, F.lit(False)) | F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def guess_dpi(metadata: Column) -> Column:
    return F.coalesce(F.bround(metadata, 0).cast("int"), F.lit(0))


def upload_status(length: Column, max_mb: int = 25) -> Column:
    """200, 400 for an empty upload, 413 for one that is too large."""
    return F.when(length == 0, 400).when(length > max_mb * 1024 * 1024, 413).otherwise(200)


def method_of(text_layers: Column, min_chars: int = 40) -> Column:
    """pdf-text if every page of a document has a text layer of some length, else ocr."""
    return F.when(F.forall(text_layers, lambda t: F.length(reading.trim_space(t)) >= min_chars), "pdf-text").otherwise("ocr")


def method_of_pages(pages: DataFrame, key: str, order: tuple[str, ...], layer: str, options: Options | None = None) -> DataFrame:
    """(key, method, count) of documents whose pages are rows: the rule of :func:`method_of` on the first ``max_pages`` of each.

    Only the length of a page's text layer is shuffled and sorted, never the text; groups are cut to
    the cap before the shuffle.
    """
    options = options or Options()
    rows = pages.select(key, *order, (F.length(reading.trim_space(F.col(layer))) >= options.pdf_text_min_chars).alias("long"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    capped = rows.withColumn("place", place).where(F.col("place") <= options.max_pages)
    grouped = capped.groupBy(key).agg(F.count("*").cast("int").alias("count"), F.bool_and("long").alias("long"))
    return grouped.select(key, F.when(F.col("long"), "pdf-text").otherwise("ocr").alias("method"), "count")


def resize_scale(height: Column, width: Column, short: int = 1000, long: int = 4000) -> Column:
    """Factor that brings the short edge up to ``short`` and the long edge down to ``long``; 1 if it changes little."""
    edge, far = F.least(height, width), F.greatest(height, width)
    scale = F.when(edge < short, short / edge).otherwise(1.0)
    scale = F.when(far * scale > long, long / far).otherwise(scale)
    return F.when(F.abs(scale - 1) < 0.02, 1.0).otherwise(scale)


def decode(content: bytes | None, pdf: bool, options: Options) -> tuple[list[dict], str, str | None]:
    """Pages, method and error of one document, by the libraries that are installed."""
    if not content:
        return [], "ocr", "the document is empty"
    try:
        return (_decode_pdf if pdf else _decode_image)(content, options)
    except ImportError as missing:
        return [], "ocr", f"the codec is missing: {missing.name}"
    except Exception as error:  # whatever a codec raises on broken bytes is the row's error
        return [], "ocr", f"the document cannot be read: {error}"


def _decode_pdf(content: bytes, options: Options) -> tuple[list[dict], str, str | None]:
    import fitz

    pages = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for index in range(min(len(doc), options.max_pages)):
            page = doc[index]
            layer = page.get_text("text").strip()
            picture = page.get_pixmap(matrix=fitz.Matrix(options.pdf_dpi / 72, options.pdf_dpi / 72), alpha=False)
            pages.append(_page(index, to_rgb(picture.samples, picture.height, picture.width, picture.n), options.pdf_dpi, "pdf-text" if layer else "pdf-scan", layer))
    if not pages:
        return [], "ocr", "the document has no pages"
    texts = all(len(p["text_layer"]) >= options.pdf_text_min_chars for p in pages)
    return pages, "pdf-text" if texts else "ocr", None


def _decode_image(content: bytes, options: Options) -> tuple[list[dict], str, str | None]:
    from PIL import Image, ImageOps, ImageSequence

    picture = Image.open(io.BytesIO(content))
    dpi = picture.info.get("dpi") or (0,)
    pages = []
    for index, frame in enumerate(ImageSequence.Iterator(picture)):
        if index >= options.max_pages:
            break
        pages.append(_page(index, np.asarray(ImageOps.exif_transpose(frame).convert("RGB"), dtype=np.uint8), round(float(dpi[0])), "image", ""))
    return (pages, "ocr", None) if pages else ([], "ocr", "the document has no pages")


def to_rgb(samples: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) of packed samples: alpha dropped, grey repeated."""
    a = np.frombuffer(samples, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else np.ascontiguousarray(a[:, :, :3])


def _page(index: int, image: np.ndarray, dpi: int, source: str, layer: str) -> dict:
    return {"index": index, "image": image.tobytes(), "height": image.shape[0], "width": image.shape[1], "dpi": dpi, "source": source, "text_layer": layer}


def load(files: DataFrame, options: Options | None = None, codec: Callable | None = None) -> DataFrame:
    """(path, status, error, method, durationMs, pages) of binary files (path, content, length[, content_type])."""
    options = options or Options()
    kind = F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string")
    guarded = files.withColumn("status", upload_status(F.coalesce(F.col("length"), F.lit(0)), options.max_upload_mb)).withColumn("pdf", is_pdf(F.col("content"), kind, F.col("path")))
    use = codec or decode

    ddl = f"path string, status int, error string, method string, durationMs int, pages array<{PAGE}>"
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            # one document at a time: its rasters are what memory must hold
            for path, content, status, pdf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                began = time.monotonic()
                if status != 200:
                    row = (path, status, "the upload is empty" if status == 400 else "the upload is too large", "ocr", 0, [])
                else:
                    pages, method, error = use(content, bool(pdf), options)
                    row = (path, 400 if error else 200, error, method, int(1000 * (time.monotonic() - began)), pages)
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(target.names, row, strict=True)}, schema=target)

    return guarded.select("path", "content", "status", "pdf").mapInArrow(run, ddl)


def read_text_layer(loaded: DataFrame) -> DataFrame:
    """The default reader: text and markdown are the pages' text layers, a blank line apart."""
    layers = F.transform("pages", lambda p: reading.trim_space(F.coalesce(p["text_layer"], F.lit(""))))
    return loaded.withColumn("pageMarkdowns", layers).withColumn("text", reading.join_pages(F.col("pageMarkdowns"))).withColumn("markdown", F.col("text")).withColumn("pageCount", F.size("pages"))


def markdown_of(result) -> str:
    """Markdown of a model's result for a page, in any of its usual shapes; what has none of them is written as JSON.

    A text; a mapping or object whose ``markdown`` is a text or a mapping that holds one; an object that saves
    its markdown to a folder; a mapping or object with ``json``.
    """
    if result is None or isinstance(result, str):
        return (result or "").strip()

    def field(name: str):
        return result.get(name) if isinstance(result, Mapping) else getattr(result, name, None)

    found = field("markdown")
    if isinstance(found, Mapping):
        found = next((found[k] for k in ("markdown_texts", "markdown") if found.get(k)), "")
    if isinstance(found, str):
        return found.strip()
    if hasattr(result, "save_to_markdown"):
        try:
            with tempfile.TemporaryDirectory() as folder:  # scratch of one call
                result.save_to_markdown(save_path=folder)
                for path in sorted(Path(folder).rglob("*.md")):
                    return path.read_text("utf-8").strip()
        except Exception as error:  # whatever a model raises: its other shapes may still hold
            warnings.warn(f"the result cannot be saved as markdown: {error}", stacklevel=2)
    payload = field("json")
    return json.dumps(payload, ensure_ascii=False) if payload else ""


def _by_page(loaded: DataFrame, kind: str, each: Callable, start: Callable) -> DataFrame:
    """(path, status, error, method, durationMs, pageCount, layers, found): ``each(function, page, layer)`` of every page.

    Pages with a text layer never reach the reader: the test stands inside the task, where Spark cannot reorder it.
    A document at a time is read, and images end here. A reader that fails is the row's error.
    """
    ddl = f"path string, status int, error string, method string, durationMs int, pageCount int, layers array<string>, found array<{kind}>"
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        function = None
        for b in batches:
            for i in range(b.num_rows):
                path, status, error, method, ms, pages = (b.column(k)[i].as_py() for k in range(6))
                began, found, pages = time.monotonic(), [], pages or []
                layers = [(p["text_layer"] or "").strip() for p in pages]
                try:
                    for p, layer in zip(pages, layers, strict=True):
                        if not layer and function is None:
                            function = start()
                        found.append(each(function, p, layer))
                except Exception as failed:  # the next run may succeed
                    found, layers, status, error = [], [], 503, f"the reader failed: {failed}"
                row = (path, status, error, method, ms + int(1000 * (time.monotonic() - began)), len(pages), layers, found)
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(target.names, row, strict=True)}, schema=target)

    return loaded.select("path", "status", "error", "method", "durationMs", "pages").mapInArrow(run, ddl)


def _of_tokens(found: DataFrame, tokens: Callable[[Column], Column], tolerance: float) -> DataFrame:
    """Text, markdown and pages' markdown: a page's text layer, else its tokens in reading order."""
    pages = F.zip_with("layers", "found", lambda layer, t: F.when(layer != "", layer).otherwise(reading.reading_order_text(tokens(t), tolerance)))
    out = found.withColumn("pageMarkdowns", pages)
    return out.withColumn("text", reading.join_pages(F.col("pageMarkdowns"))).withColumn("markdown", F.col("text")).drop("layers", "found")


def read_detected(loaded: DataFrame, start: Callable, tolerance: float = 12.0) -> DataFrame:
    """Text of detected tokens, in reading order, for pages without a text layer."""

    def each(detect, page, layer):
        return [] if layer else [{"y": float(y), "x": float(x), "text": t} for y, x, t in detect(page["image"], page["height"], page["width"])]

    return _of_tokens(_by_page(loaded, f"array<{reading.TOKEN}>", each, start), lambda t: F.filter(t, lambda x: ~reading.is_blank(x["text"])), tolerance)


def read_boxes(loaded: DataFrame, start: Callable, tolerance: float = 12.0) -> DataFrame:
    """As :func:`read_detected`, for a reader that returns texts beside boxes or polygons."""

    def each(lines, page, layer):
        texts, boxes = ([], []) if layer else lines(page["image"], page["height"], page["width"])
        points = [[b[:2], b[2:4]] if len(b) and not hasattr(b[0], "__len__") else b for b in boxes]
        return {"texts": list(texts), "boxes": [[[float(c) for c in p] for p in b] for b in points]}

    found = _by_page(loaded, "struct<texts:array<string>,boxes:array<array<array<double>>>>", each, start)
    return _of_tokens(found, lambda t: reading.zip_lines(t["texts"], F.transform(t["boxes"], reading.top_left)), tolerance)


def read_markdown(loaded: DataFrame, start: Callable) -> DataFrame:
    """Markdown that a model writes for pages without a text layer; the text is that of the markdown, page by page."""

    def each(write, page, layer):
        result = layer or write(page["image"], page["height"], page["width"])
        parts = result if isinstance(result, (list, tuple)) else [result]
        return "\n\n".join(filter(None, map(markdown_of, parts))).strip()

    found = _by_page(loaded, "string", each, start).withColumnRenamed("found", "pageMarkdowns").drop("layers")
    texts = F.transform("pageMarkdowns", reading.markdown_to_text)
    return found.withColumn("text", reading.join_pages(texts)).withColumn("markdown", reading.join_pages(F.col("pageMarkdowns")))


READS = {"tokens": read_detected, "boxes": read_boxes, "markdown": read_markdown}


def read(files: DataFrame, options: Options | None = None, codec: Callable | None = None, detect: Callable | None = None, write: Callable | None = None, enhance: Callable | None = None) -> DataFrame:
    """Files to rows with text, markdown, pageMarkdowns, pageCount, method, durationMs, status and error.

    ``detect`` (tokens of a page) or ``write`` (its markdown) read pages without a text layer, else the reader that
    is registered for the engine; images are enhanced before. The text layer alone needs no images.
    """
    from tallyspark.sources import preprocess

    options = options or Options()
    loaded = load(files, options, codec)
    engine = engine_of(options.reader_engine)
    reader = READERS.get(engine)
    if detect or write:
        reader = Reader("tokens", lambda _: detect) if detect else Reader("markdown", lambda _: write)
    elif engine == "null":
        return read_text_layer(loaded)
    if reader is None:
        rows = read_text_layer(loaded)
        needs = (F.col("status") == 200) & F.exists("pages", lambda p: reading.is_blank(p["text_layer"]))
        lacking = F.when(needs, f"no reader is registered for {options.reader_engine}").otherwise(F.col("error"))
        return rows.withColumn("error", lacking).withColumn("status", F.when(needs, 503).otherwise(F.col("status")))
    loaded = preprocess.preprocess(loaded, options, *([enhance] if enhance else []))
    return READS[reader.kind](loaded, lambda: reader.load(options))


def answers(prompts: DataFrame, load: Callable, options: Options) -> DataFrame:
    """Adds ``answer`` to rows with ``prompt``: ``load(options)`` is called once a partition and gives a function from a prompt to a text.

    A prompt that the model fails on has no answer, so that the rules extract, or the row may be tried again.
    """

    schema = StructType([*prompts.schema.fields, StructField("answer", StringType())])
    target, at = to_arrow_schema(schema), prompts.columns.index("prompt")

    def run(batches):
        model = None
        for b in batches:
            out = []
            for prompt in b.column(at).to_pylist():
                try:
                    model = model or load(options)
                    out.append(model(prompt))
                except Exception as failed:
                    warnings.warn(f"the extractor failed: {failed}", stacklevel=2)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, target, strict=False)] + [pa.array(out, pa.string())], schema=target)

    return prompts.mapInArrow(run, schema)


def extract(files: DataFrame, options: Options | None = None, **readers) -> DataFrame:
    """Reader output only: method, engine, pageCount, text, markdown. Every failure is retryable here."""
    rows = read(files, options, **readers)
    engine = engine_of((options or Options()).reader_engine)
    return rows.select("path", "method", F.lit(engine).alias("engine"), "pageCount", "durationMs", "text", "markdown", F.when(F.col("status") == 200, 200).otherwise(503).alias("status"), "error")


def health(options: Options | None = None) -> dict:
    options = options or Options()
    reader, extractor = engine_of(options.reader_engine), extractor_of(options.extractor_engine)
    ready = {"reader_ready": reader == "null" or reader in READERS, "extractor_ready": extractor == "rules" or options.extractor_engine.lower() in EXTRACTORS}
    return {"status": "ok" if all(ready.values()) else "degraded", "engine": options.reader_engine, "extractor": options.extractor_engine, **ready, "version": 1, "gpu": False}
