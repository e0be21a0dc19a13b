"""What several operators share: shared storage, Arrow plumbing, labels, components, ranks."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that goes to Python.
BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. A local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Lost executors then cost at most a re-read, and what follows is not computed twice.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark) + "/tallyspark/"
    plain = base.split(":", 1)[-1].lstrip("/")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain in d:
            path = jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds)).cast("int")


def fold_of(doc_id, folds: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows, unless the session sets a number of its own.

    The JVM, outside its heap, and Python each hold a whole batch of texts, for every task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH))


def arrow_map(df: DataFrame, fn: Callable[[list[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` gets one iterator of Arrow batches and yields dicts of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_pydict(cols, schema=target)

    return df.mapInArrow(run, schema)


def text_chunks(batches, size: int = 512) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at most ``size`` rows: what Python holds at once stays small."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            part = b.slice(i, size)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def text_scores(docs: DataFrame, into: str, scores: Callable[[list[str]], list[float]]) -> DataFrame:
    """``docs`` with a column of doubles made from ``text``; null texts count as empty.

    ``scores`` gets the texts of at most 512 rows at a time; all other columns stay as they are.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[float] = []
            for i in range(0, len(texts), 512):
                out += scores([t or "" for t in texts.slice(i, 512).to_pylist()])
            yield pa.array(out, pa.float64())

    return docs.withColumn(into, score(F.col("text").cast("string")))


def bounded_sample(rows: DataFrame, key: str | list[str], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, first by a hash of ``key``: the same rows on every run and layout."""
    key = [key] if isinstance(key, str) else key
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(limit)


def text_sample(docs: DataFrame, limit: int, seed: int) -> DataFrame:
    """(doc_id, text) of at most ``limit`` documents with id and text, picked by a hash of both; repeated rows count once.

    About four times as many are drawn by a threshold on the hash, before anything is sorted or shuffled.
    """
    total = docs.select("doc_id").count()
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    some = docs.select("doc_id", "text", key.alias("key_")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    if total > 4 * limit:
        some = some.where(F.pmod("key_", F.lit(1 << 40)) < int((1 << 40) * (4 * limit / total)))
    once = some.groupBy("key_").agg(F.min(F.struct("doc_id", "text")).alias("one"))
    return once.orderBy("key_").limit(limit).select("one.doc_id", "one.text")


def labelled_sample(docs: DataFrame, label_rows: DataFrame, label: str, folds: int, held: int, limits: dict[int, int], seed: int = 11) -> DataFrame:
    """One text each of at most ``limits[y]`` labelled documents of each class ``y`` outside the held-out fold.

    Ids labelled twice with different values teach nothing and are left out, as are null
    ids, labels and texts. The sample is picked among the labels alone, so only its ids,
    as many longs at most, are broadcast to the scan of the texts. An id that several rows
    share stands for one of their texts, the first by its hash.
    """
    one = (
        label_rows.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("y"))
        .where(F.col("id_").isNotNull() & F.col("y").isin(0, 1) & (fold("id_", folds) != held))
        .groupBy("id_").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    )
    ids = bounded_sample(one.where("y = 1"), "id_", limits[1], seed).unionByName(bounded_sample(one.where("y = 0"), "id_", limits[0], seed))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("id_"))
    first = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return first.select("doc_id", "first.text", "y")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node reachable over ``edges(a, b)`` for every row of ``nodes(node)``.

    Min-label propagation with pointer jumping, distributed throughout; every round is
    written to the shared folder, so lineage stays short and a lost executor costs one round.
    Returns (node, root).
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    near = both.groupBy("a").agg(F.min("b").alias("m"))
    state = materialize(near.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = state.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        step = materialize(step, "roots")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(step.join(jump, "root").select("node", "old", F.col("up").alias("root")), "roots")
        moved = new.where("root <> old").limit(1).count()
        discard(step)
        discard(state)
        state = new.drop("old")
        if not moved:
            break
    discard(both)
    return nodes.join(state, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def salts_for(rows: int) -> int:
    """Parts into which the rows of one key are dealt before they are numbered: about 4 million rows each, 16 to 1024."""
    return max(16, min(1024, rows >> 22))


def numbered(df: DataFrame, key: list[str], order: list[str], salts: int) -> DataFrame:
    """Adds ``salt`` and ``nth``: gapless from 0 within (key, salt). A hot key is spread over all salts."""
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    return df.withColumn("salt", salt).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "salt").orderBy(*order)).cast("long") - 1)


def numbering_bases(numbered_rows: DataFrame, key: list[str], *aggs: Column) -> tuple[list, dict]:
    """Per (key, salt) the number of the key's rows before it, and per key the totals.

    What reaches the driver is one row for each (key, salt), bounded by the key's values
    (fixed by the caller) times 1024. Returns (rows (*key, salt, base), {key: [n, *sums]}).
    """
    found = numbered_rows.groupBy(*key, "salt").agg(F.count("*").alias("n"), *aggs).collect()
    bases, totals = [], {}
    for r in sorted(found, key=lambda r: r[: len(key) + 1]):
        k = r[: len(key)]
        sums = totals.setdefault(k, [0] * (1 + len(aggs)))
        bases.append((*k, r["salt"], sums[0]))
        for i, v in enumerate(r[len(key) + 1 :]):
            sums[i] += v
    return bases, totals
