"""Operator 8: near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct shingles of ``words`` words (64-bit hashes). Its signature has
``CHUNKS * SYMBOLS`` b-bit MinHash symbols. Two signatures that differ in at most
``SURE = CHUNKS * (ERRORS + 1) - 1`` symbols agree, by the pigeonhole principle, in some chunk up to
``ERRORS`` symbols; every chunk is therefore entered once for each choice of ERRORS places left
out, and any such pair meets under a common key. What meets is confirmed on full sets.

Steps, all distributed:

1. one pass over the texts: set size, 128-bit hash of the set, signature;
2. equal sets become one class, the node of what follows;
3. under every key that nodes share, the nodes whose signatures are close are searched breadth first:
   a node is compared with those not reached yet, so that a group of thousands of copies costs about
   one comparison a copy, and only a spanning forest leaves the task. Its components are clusters;
   every pair that meets and is close lies in one of them;
4. within every cluster the full sets are compared in the same way; the components of these links are
   the result.

Keys and clusters of over ``BLOCK`` nodes are dealt out as pairs of blocks; no key is sampled or capped.
A null text, or one without words, has an empty set, links with nothing and is its own component; where
its doc_id is null too, so is its component. Repeated rows share their class. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_map, components, discard, materialize

CHUNKS, SYMBOLS, ERRORS = 6, 5, 1
LENGTH = CHUNKS * SYMBOLS
#: Symbol differences up to which a pair is sure to meet.
SURE = CHUNKS * (ERRORS + 1) - 1
#: Symbol differences up to which pairs that meet are compared on full sets. Of pairs with similarity 0.85,
#: fewer than one in 100,000 differ in more; of those with 0.8, one in 4,300.
THRESHOLD = SURE + 3
#: Nodes of a block.
BLOCK = 2048
_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, LENGTH, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z; white space of ASCII
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out ^= out >> np.uint64(29)
            out *= _M
            out += h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def signature(items: np.ndarray) -> np.ndarray:
    """LENGTH symbols of 16 bits: of each permutation, the top bits of a mix of the smallest hash."""
    a, b = _permutations()
    low = np.full(LENGTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 4096):
            part = items[i : i + 4096]
            np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=low)
        low ^= low >> np.uint64(31)
        low *= _M
    return (low >> np.uint64(48)).astype(np.uint16)


def profiles(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, sig): node is the 128-bit hash of the set, null for an empty one."""

    def run(batches):
        for b in batches:
            ids, hashes, texts = (b.column(i).to_pylist() for i in range(3))
            out = {"doc_id": ids, "text_hash": hashes, "n_shingles": [], "node": [], "sig": []}
            for t in texts:
                items = shingles(t, words)
                out["n_shingles"].append(len(items))
                out["node"].append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                out["sig"].append(signature(items).astype("<u2").tobytes() if len(items) else None)
            yield out

    return arrow_map(_texts(docs), run, "doc_id long, text_hash long, n_shingles long, node binary, sig binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def keys(sig: Column) -> Column:
    """The keys of a signature: of every chunk, all choices of SYMBOLS - ERRORS places, hashed."""
    from itertools import combinations

    found = []
    for c in range(CHUNKS):
        for k, kept in enumerate(combinations(range(SYMBOLS), SYMBOLS - ERRORS)):
            parts = [F.substring(sig, 2 * (c * SYMBOLS + i) + 1, 2) for i in kept]
            found.append(F.xxhash64(F.lit(c * 64 + k), F.concat(*parts)))
    return F.array(*found)


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``linked(p, rest)`` gives the positions in ``rest`` that p links with."""
    edges, left = [], np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            hit = linked(p, left)
            if len(hit):
                found = left[hit]
                edges += [(p, int(q)) for q in found]
                queue += found.tolist()
                left = np.delete(left, hit)
    return edges


def _dealt(rows: DataFrame, key: str, size: str, *columns: str) -> DataFrame:
    """Rows (group, node, *columns) sorted by group: a key, or a pair of blocks of one that has more than BLOCK nodes."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    # with one block there is one group; else every pair of different blocks
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine"))))
    rows = rows.withColumn("other", other)
    group = F.struct(F.col(key).alias("key"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    rows = rows.select(F.xxhash64(group).alias("part"), group.alias("group"), "node", *columns)
    return rows.repartition("group").sortWithinPartitions("part", "group", "node").select("group", "node", *columns)


def _groups(batches):
    """(rows) of each group of a sorted stream, every node once."""
    at, rows = None, []
    for b in batches:
        names = b.column(0)
        columns = [c.to_pylist() for c in b.columns[1:]]
        for k in range(b.num_rows):
            group = names[k]
            row = [c[k] for c in columns]
            if at is None or group != at:
                if len(rows) > 1:
                    yield rows
                at, rows = group, []
            if not rows or rows[-1][0] != row[0]:
                rows.append(row)
    if len(rows) > 1:
        yield rows


def _edges(found) -> dict:
    return {"a": [min(x, y) for x, y in found], "b": [max(x, y) for x, y in found]}


def _clusters(met: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the nodes of met(key, n, node, sig) that share a key and are close."""

    def run(batches):
        for rows in _groups(batches):
            s = np.frombuffer(b"".join(r[1] for r in rows), "<u2").reshape(-1, LENGTH)
            forest = _forest(len(rows), lambda p, rest, s=s: np.flatnonzero((s[rest] != s[p]).sum(axis=1) <= THRESHOLD))
            if forest:
                yield _edges([(rows[p][0], rows[q][0]) for p, q in forest])

    return arrow_map(_dealt(met, "key", "n", "sig"), run, "a binary, b binary").distinct()


def _links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning edges (a, b) of members(root, n, node, sig, items) with den * intersection >= num * union."""

    def run(batches):
        for rows in _groups(batches):
            s = np.frombuffer(b"".join(r[1] for r in rows), "<u2").reshape(-1, LENGTH)
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            size = np.array([len(x) for x in sets])

            def linked(p, rest, s=s, sets=sets, size=size):
                fit = (den * np.minimum(size[rest], size[p]) >= num * np.maximum(size[rest], size[p])) & ((s[rest] != s[p]).sum(axis=1) <= THRESHOLD)
                return np.array([k for k in np.flatnonzero(fit) if _similar(sets[p], sets[rest[k]], num, den)], dtype=np.int64)

            forest = _forest(len(rows), linked)
            if forest:
                yield _edges([(rows[p][0], rows[q][0]) for p, q in forest])

    return arrow_map(_dealt(members, "root", "n", "sig", "items"), run, "a binary, b binary")


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    inter = int((large[at] == small).sum())
    return den * inter >= num * (len(x) + len(y) - inter)


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members(root, n, node, sig, doc_id, text_hash) with ``items``, the full set, from one document that has it."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = {c: part.column(c).to_pylist() for c in ("root", "n", "node", "sig")}
                yield out | {"items": [shingles(t, words).tobytes() for t in part.column("text").to_pylist()]}

    one = members.withColumnRenamed("doc_id", "id_").withColumnRenamed("text_hash", "hash_")
    picked = _texts(docs).join(one, (F.col("text_hash") == F.col("hash_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
    return arrow_map(picked.select("root", "n", "node", "sig", "text"), run, "root binary, n long, node binary, sig binary, items binary")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links: den * intersection >= num * union."""
    out = classes(docs, words, num, den)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, num: int = 85, den: int = 100, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id. Rows without words all stay; columns may have any names."""
    found = materialize(classes(docs, words, num, den), "classes")
    gone = materialize(found.where(~F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    many = found.where("first AND n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    many = materialize(many.select(F.col("doc_id").alias("many_id"), F.col("text_hash").alias("many_hash")), "many")
    discard(found)
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone  # 16 bytes a row
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    left = rows.join(side, (F.col("hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    if not many.isEmpty():  # rows that repeat both id and text: one of them stays
        same = (F.col("hash") == F.col("many_hash")) & F.col("id").eqNullSafe(F.col("many_id"))
        once = left.join(many, same, "left_semi").dropDuplicates(["id", "hash"])
        left = left.join(many, same, "left_anti").unionByName(once)
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def classes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first): ``first`` marks the rows of the document that stands for its component."""
    rows = materialize(profiles(docs, words), "profiles")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"), F.first("sig").alias("sig"))
    entries = materialize(nodes.select("node", "one.doc_id", "one.text_hash", "sig"), "nodes")
    index = entries.select("node", F.explode(keys(F.col("sig"))).alias("key"))
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = index.join(shared, "key").join(entries.select("node", "sig"), "node")
    close = materialize(_clusters(met.select("key", "n", "node", "sig")), "close")
    touched = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    clusters = materialize(components(touched, close), "clusters")
    members = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("n")), "root").join(entries, "node")
    members = materialize(members.select("root", "n", "node", "sig", "doc_id", "text_hash"), "members")
    links = materialize(_links(_sets(docs, members, words), num, den), "links")
    joined = components(members.select("node"), links)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    smallest = joined.join(entries.select("node", own.alias("own")), "node")
    least = smallest.groupBy("root").agg(F.min("own").alias("least"))
    grouped = smallest.select("node", "root").join(least, "root").select("node", "least")
    # every class has a component: itself if it met nobody
    of_class = entries.select("node", own.alias("own")).join(grouped, "node", "left").select("node", F.coalesce("least", "own").alias("least"))
    of_class = materialize(of_class, "classes")
    for done in (close, clusters, members, links):
        discard(done)
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(of_class, "node", "left")
    first = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), first.alias("first"))
