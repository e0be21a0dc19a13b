"""Operator 2: resharding by minimum-cost flow.

Rows of one old shard and one size class form a block. From the old shard sizes and the new
capacities (rows a shard, at most one apart), the driver solves the flow of rows from blocks to
shards that moves the fewest bytes: staying costs nothing, leaving costs the block's bytes a
row. Starting with everything in place, it sends rows along cheapest paths between shards in
the residual network until no shard is over capacity (successive shortest paths).

The driver sees one count per (old shard, size class, salt), a bounded number. Executors number
the rows of each block (salted, so that a hot old shard spreads out) and look up where a rank
goes. :func:`rewrite` then writes the affected shards only.

A null text has no bytes and its CRC is 0; a null key of the old layout counts as the empty
text. Repeated rows are rows of their own; ids may be null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, numbered, numbering_bases, salts_for

#: Size classes for each doubling of the size.
CLASSES = 4


def capacities(old: Sequence[int], shards: int) -> list[int]:
    """Rows a new shard: at most one apart, the larger ones where most rows are already."""
    total = sum(old)
    low, extra = divmod(total, shards)
    have = [old[j] if j < len(old) else 0 for j in range(shards)]
    first = sorted(range(shards), key=lambda j: (-have[j], j))[:extra]
    return [low + (j in first) for j in range(shards)]


def transfers(blocks: Sequence[tuple[int, int, float]], capacity: Sequence[int], distance: np.ndarray | None = None) -> np.ndarray:
    """Minimum-cost flow: rows of each block that each new shard gets.

    blocks: (old shard, rows, bytes a row); old shards from ``len(capacity)`` on are given up.
    distance: cost factor from old to new shard (0 for staying, else 1, unless given).
    """
    new = len(capacity)
    all_shards = max([new, *(b[0] + 1 for b in blocks)])
    home = np.array([b[0] for b in blocks], dtype=np.int64)
    unit = np.array([b[2] for b in blocks], dtype=np.float64)
    if distance is None:
        distance = 1.0 - np.eye(all_shards)
    cost = unit[:, None] * distance[home]
    at = np.zeros((len(blocks), all_shards), dtype=np.int64)
    at[np.arange(len(blocks)), home] = [b[1] for b in blocks]
    room = np.zeros(all_shards, dtype=np.int64)
    room[:new] = capacity
    over = at.sum(axis=0) - room
    if over.sum() > 0:
        raise ValueError("the new shards hold fewer rows than there are")
    while (over > 0).any():
        # cheapest change of cost for one row that now lies in i to lie in j, and its block
        step = np.full((all_shards, all_shards), np.inf)
        which = np.zeros((all_shards, all_shards), dtype=np.int64)
        for i in range(all_shards):
            held = np.flatnonzero(at[:, i])
            if len(held):
                change = cost[held] - cost[held, i][:, None]
                which[i] = held[change.argmin(axis=0)]
                step[i] = change.min(axis=0)
        step[:, new:] = np.inf
        np.fill_diagonal(step, np.inf)
        far = np.where(over > 0, 0.0, np.inf)
        before = np.full(all_shards, -1)
        for _ in range(all_shards):
            through = far[:, None] + step
            best = through.argmin(axis=0)
            found = through[best, np.arange(all_shards)]
            better = found < far - 1e-9
            if not better.any():
                break
            far, before = np.where(better, found, far), np.where(better, best, before)
        goal = int(np.where(over < 0, far, np.inf).argmin())
        path, j = [], goal
        while before[j] >= 0:
            path.append((int(before[j]), j))
            j = int(before[j])
        amount = min(int(over[j]), int(-over[goal]), *(int(at[which[i, k], i]) for i, k in path))
        for i, k in path:
            at[which[i, k], i] -= amount
            at[which[i, k], k] += amount
        over[j] -= amount
        over[goal] += amount
    return at[:, :new]


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard.

    ``old_shard`` is the shard (from 0) that a row of ``docs`` lies in now.
    """
    spark = docs.sparkSession
    raw = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
    ).withColumn("size", F.col("bytes") + 1).drop("bytes")
    rows = rows.withColumn("size_class", F.floor(F.log2("size") * CLASSES).cast("int"))
    rows = materialize(rows, "sizes")
    key = ["old_shard", "size_class"]
    ranked = materialize(numbered(rows, key, ["doc_id", "text_crc32", "size"], salts_for(rows.count())), "numbered")
    bases, totals = numbering_bases(ranked, key, F.sum("size").alias("bytes"))
    keys = list(totals)
    old = [0] * old_shards
    for k in keys:
        old[k[0]] += totals[k][0]
    flow = transfers([(k[0], totals[k][0], totals[k][1] / totals[k][0]) for k in keys], capacities(old, shards))
    goes, used = [], [0] * shards
    for k, row in zip(keys, flow.tolist(), strict=True):
        ranges, rank = [], 0
        # rows that stay come first
        for j in sorted(range(shards), key=lambda j: (j != k[0], j)):
            if row[j]:
                ranges.append((rank, rank + row[j], j, used[j]))
                rank += row[j]
                used[j] += row[j]
        goes.append((*k, ranges))
    # at most old_shards * 64 * CLASSES rows here, and 1024 times that in the bases
    base = spark.createDataFrame(bases, "old_shard int, size_class int, salt int, base long")
    goal = spark.createDataFrame(goes, "old_shard int, size_class int, goes array<struct<a:long,b:long,shard:int,slot:long>>")
    placed = ranked.join(F.broadcast(base), [*key, "salt"]).join(F.broadcast(goal), key).withColumn("rank", F.col("base") + F.col("nth"))
    placed = placed.withColumn("to", F.expr("filter(goes, x -> x.a <= rank AND rank < x.b)[0]"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to.shard").alias("shard"),
        F.expr("to.slot + rank - to.a").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def affected(plan: DataFrame) -> list[int]:
    """The shards, old and new, whose rows change: at most as many values as there are shards."""
    moved = plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    return sorted(r["shard"] for r in moved.collect())


def rewrite(docs: DataFrame, plan: DataFrame, out: str, rows_a_file: int = 2_000_000) -> list[int]:
    """Write the affected shards' documents to ``out/shard=K``, by slot, in files of ranges of slots; returns these shards.

    ``docs`` may lie in ``out`` itself: all that is written is staged in the shared folder first.
    Folders of unaffected shards stay as they are; that of an affected shard without rows any more is removed.
    Documents are matched by (doc_id, text_crc32); null ids match, and the n-th of repeated
    rows goes to the n-th of their places. A caller's columns ``shard`` and ``slot`` give way to the new
    ones; columns of other names are written as they are.
    """
    changed = affected(plan)
    spark, other = docs.sparkSession, [c for c in docs.columns if c not in ("shard", "slot")]
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in other])
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), crc.alias("crc"), row.alias("row"))
    to = plan.where(F.col("shard").isin(changed)).select(F.col("doc_id").alias("to_id"), F.col("text_crc32").alias("to_crc"), "shard", "slot")
    same = F.col("id").eqNullSafe(F.col("to_id")) & (F.col("crc") == F.col("to_crc"))
    often = plan.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("many_id"), F.col("text_crc32").alias("many_crc"))
    often = materialize(often, "repeated")
    twice = F.col("id").eqNullSafe(F.col("many_id")) & (F.col("crc") == F.col("many_crc"))
    again = F.col("to_id").eqNullSafe(F.col("many_id")) & (F.col("to_crc") == F.col("many_crc"))
    single = keyed.join(often, twice, "left_anti").join(to.join(often, again, "left_anti"), same)
    # all places of repeated rows take part, those in shards that do not change too
    places = plan.select(F.col("doc_id").alias("to_id"), F.col("text_crc32").alias("to_crc"), "shard", "slot", "old_shard").join(often, again, "left_semi")
    here = F.when(F.col("shard") == F.col("old_shard"), 0).otherwise(1)
    places = places.withColumn("nth", F.row_number().over(Window.partitionBy("to_id", "to_crc").orderBy(here, "shard", "slot")))
    copies = keyed.join(often, twice, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("id", "crc").orderBy(F.xxhash64("row"))))
    double = copies.join(places, same & (F.col("copy") == F.col("nth"))).where(F.col("shard").isin(changed))
    rows = single.select("row", "shard", "slot").unionByName(double.select("row", "shard", "slot"))
    staged = materialize(rows, "rewrite")
    dealt = staged.withColumn("file", F.floor(F.col("slot") / rows_a_file))
    dealt = dealt.repartition("shard", "file").sortWithinPartitions("shard", "slot").select(*[F.col("row")[c].alias(c) for c in other], "shard", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    filled = {r["shard"] for r in staged.select("shard").distinct().collect()}
    for shard in set(changed) - filled:
        path = jvm.org.apache.hadoop.fs.Path(f"{out}/shard={shard}")
        path.getFileSystem(conf).delete(path, True)
    discard(often)
    discard(staged)
    return changed
