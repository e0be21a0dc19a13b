"""Operator 5: near-duplicate vectors by NN-descent.

1. *Start.* Random hyperplane trees, ``TREES`` at least and more for deeper ones (:func:`trees_for`),
   put each vector into a leaf each; in a leaf every vector takes its nearest leaf-mates. Leaves over
   ``LEAF`` vectors are split at the median of further hyperplanes within their task.
2. *Descent.* In a round every vector hands its neighbours, in both directions, to one another
   (neighbours of neighbours); a candidate enters a list only if it is nearer than the last entry.
   A vector with a great many neighbours deals them out in groups of ``GROUP``. After ``rounds`` rounds
   at least, rounds go on until one brings at most ``QUIET`` new links for each link there is.
3. *Threshold.* Entries at the threshold or above, in double precision, are links; they join
   vectors into components.
4. *Enlargement.* A list of ``K`` entries that are all links is saturated: its vector may have more,
   within its component and beyond. Saturated vectors are therefore searched again with lists that leave
   out their own component; links found so join components, until a search finds none. (A list that is not
   saturated holds all its vector's links, so links that are in no list run between saturated vectors.)
   Then every list is enlarged to its whole component, compared in blocks, so that counts of links are
   exact within components whatever their size, and no list is written out.
5. *Audit.* The recall of links is measured on ``AUDIT`` vectors (:func:`audit`), other ones each time.
   While it is under ``RECALL``, twice as many new trees as before add to the lists, and 2 to 5 are repeated.

Vectors that are null, zero, or hold null or non-finite components have no links. Equal vectors are
collapsed first and counted with their multiplicity. Repeated ids are rows of their own and may have
different vectors; the component is the smallest id reachable, for a null id without links null. An empty
table gives an empty result; other columns, labels among them, are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_map, bounded_sample, components, discard, materialize

K = 10
TREES, LEAF = 6, 256
GROUP = 64
BLOCK = 1024
#: A pair at the threshold shares no leaf of the first trees with this chance at most (by the planes of their depth).
MISS = 0.01
QUIET = 0.001
AUDIT, RECALL = 1000, 0.999


def clean(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, node): unit vector as packed doubles and the hash of the vector; null where it links with nothing."""

    def run(batches):
        for b in batches:
            out = {"vec_id": b.column(0).to_pylist(), "v": [], "node": []}
            for x in b.column(1).to_pylist():
                v = None
                if x and None not in x:
                    a = np.array(x, dtype=np.float64)
                    if np.isfinite(a).all() and (n := float(np.sqrt(a @ a))) > 0 and np.isfinite(n):
                        v = a / n
                out["v"].append(None if v is None else v.tobytes())
                out["node"].append(None if v is None else xxhash.xxh3_128_digest(np.array(x, dtype=np.float64).tobytes()))
            yield out

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    return arrow_map(rows, run, "vec_id long, v binary, node binary")


def _array(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)


def _groups(batches):
    """(key, rows) of a stream sorted by its first column."""
    at, rows = None, []
    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != at and rows:
                yield at, rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield at, rows


def _batched(records, names: list[str], size: int = 20_000):
    out: dict[str, list] = {n: [] for n in names}
    for r in records:
        for n, values in zip(names, r, strict=True):
            out[n] += values
        if len(out[names[0]]) >= size:
            yield out
            out = {n: [] for n in names}
    yield out


def _cosines(x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Cosines of all pairs, -2 where both are of one root (a vector and itself among them)."""
    cos = x @ x.T
    cos[root[:, None] == root[None, :]] = -2
    return cos


def _numbers(roots: list[bytes]) -> np.ndarray:
    at = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([at[r] for r in roots])


def _tops(node: list[bytes], x: np.ndarray, root: np.ndarray, k: int, rng) -> tuple[list, list, list]:
    """The k nearest of other roots of each vector within leaves of at most LEAF, split at medians."""
    a, b, c = [], [], []
    todo = [np.arange(len(node))]
    while todo:
        part = todo.pop()
        if len(part) > LEAF:
            side = x[part] @ rng.standard_normal(x.shape[1])
            order = np.argsort(side, kind="stable")
            todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        elif len(part) > 1:
            cos = _cosines(x[part], root[part])
            near = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            for i, row in enumerate(near):
                row = row[cos[i, row] > -2]
                a += [node[part[i]]] * len(row)
                b += [node[part[j]] for j in row]
                c += cos[i, row].tolist()
    return a, b, c


def depth_for(leaves: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, leaves)))))


def trees_for(leaves: int, threshold: float) -> int:
    """Trees of so many leaves after which a pair at the threshold has shared no leaf with a chance of MISS at most."""
    together = (1 - np.arccos(threshold) / np.pi) ** depth_for(leaves)
    return TREES if together >= 1 else max(TREES, int(np.ceil(np.log(MISS) / np.log1p(-together))))


def start(vectors: DataFrame, leaves: int, k: int = K, seed: int = 1, trees: int = TREES) -> DataFrame:
    """(a, b, cos): directed entries of the first lists of vectors(node, v, root), of one length and between different roots."""
    depth = depth_for(leaves)

    def code(batches):
        for b in batches:
            rows: dict[int, list] = {}
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.setdefault(len(r[1]) // 8, []).append(r)
            for dim, some in rows.items():  # vectors of different lengths never link: a leaf has one length
                node, v, root = zip(*some, strict=True)
                x, planes = _array(v), np.random.default_rng(seed).standard_normal((trees, depth, dim))
                for t in range(trees):
                    bits = (x @ planes[t].T > 0).astype(np.int64) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(node), np.int64)
                    yield {"leaf": [f"{dim}-{leaf}" for leaf in (bits * trees + t).tolist()], "node": node, "v": v, "root": root}

    def run(batches):
        def found():
            for leaf, rows in _groups(batches):
                if len(rows) > 1:
                    rng = np.random.default_rng([seed, *map(int, leaf.split("-"))])
                    yield _tops([r[0] for r in rows], _array([r[1] for r in rows]), _numbers([r[2] for r in rows]), k, rng)

        yield from _batched(found(), ["a", "b", "cos"])

    coded = arrow_map(vectors.select("node", "v", "root"), code, "leaf string, node binary, v binary, root binary")
    dealt = coded.repartition("leaf").sortWithinPartitions("leaf", "node")
    return arrow_map(dealt, run, "a binary, b binary, cos double")


def _lists(entries: DataFrame, k: int) -> DataFrame:
    """(node, near, last): the k nearest distinct entries of each vector, nearest first."""
    best = entries.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    from pyspark.sql import Window

    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    top = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    grouped = top.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("d"), "b"))).alias("near"))
    return grouped.select(F.col("a").alias("node"), "near", F.when(F.size("near") >= k, -F.element_at("near", -1)["d"]).otherwise(F.lit(-2.0)).alias("last"))


def descend(lists: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """One round: entries (a, b, cos) that are nearer than the last of a's list, found among neighbours' neighbours."""
    forward = lists.select(F.col("node").alias("hub"), F.explode("near.b").alias("node"))
    both = forward.unionByName(forward.select(F.col("node").alias("hub"), F.col("hub").alias("node"))).distinct()
    own = vectors.join(lists.select("node", "last"), "node").select("node", "v", "last", "root")
    sizes = both.groupBy("hub").agg(F.count("*").alias("n"))
    dealt = both.join(sizes, "hub").withColumn("group", F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP)))).select("group", "node")
    rows = dealt.join(own, "node").select("group", "node", "v", "last", "root").repartition("group").sortWithinPartitions("group", "node")

    def run(batches):
        def found():
            for _, group in _groups(batches):
                if len(group) > 1:
                    node, x, last = [g[0] for g in group], _array([g[1] for g in group]), np.array([g[2] for g in group])
                    cos = _cosines(x, _numbers([g[3] for g in group]))
                    near = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                    i, j = np.nonzero(np.take_along_axis(cos, near, 1) > last[:, None])
                    j = near[i, j]
                    yield [node[p] for p in i], [node[q] for q in j], cos[i, j].tolist()

        yield from _batched(found(), ["a", "b", "cos"])

    return arrow_map(rows, run, "a binary, b binary, cos double")


def search(vectors: DataFrame, threshold: float, rounds: int, k: int = K, seed: int = 1, more: int = 1, lists: DataFrame | None = None) -> DataFrame:
    """(node, near, last): lists of the nearest of vectors(node, v, root) with other roots.

    ``lists`` are earlier ones, which new trees (``more`` times as many as a first search has) add to.
    """
    leaves = -(-vectors.count() // (LEAF // 2))
    entries = start(vectors, leaves, k, seed, more * trees_for(leaves, threshold))
    lists = materialize(_lists(entries if lists is None else _entries(lists).unionByName(entries), k), "lists")
    for done in itertools.count(1):  # ends: the links of lists only grow, and are at most k a vector
        new = materialize(_lists(_entries(lists).unionByName(descend(lists, vectors, k)), k), "lists")
        links = _links(new, threshold).count()
        fresh = links - _links(lists, threshold).count()
        discard(lists)
        lists = new
        if done >= rounds and fresh <= QUIET * links:
            return lists


def _entries(lists: DataFrame) -> DataFrame:
    """(a, b, cos) of all lists."""
    return lists.select(F.col("node").alias("a"), F.explode("near").alias("e")).select("a", F.col("e.b").alias("b"), (-F.col("e.d")).alias("cos"))


def _links(lists: DataFrame, threshold: float) -> DataFrame:
    return _entries(lists).where(F.col("cos") >= threshold).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of all vectors with links."""
    return materialize(components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links), "roots")


def across(lists: DataFrame, vectors: DataFrame, threshold: float, rounds: int, k: int = K, seed: int = 2, more: int = 1) -> DataFrame:
    """All links (a, b): those of the lists, and those by which saturated vectors reach other components."""
    links = _links(lists, threshold)
    saturated = lists.where(F.col("last") >= threshold).select("node")
    if saturated.isEmpty():
        return links
    space = vectors.select("node", "v").join(saturated, "node")
    for at in itertools.count(seed):  # ends: every pass but the last joins components
        some = materialize(space.join(_roots(links), "node"), "saturated")
        if some.select("root").distinct().limit(2).count() < 2:
            return links
        found = materialize(_links(search(some, threshold, rounds, k, at, more), threshold), "across")
        if found.isEmpty():
            return links
        links = links.unionByName(found)


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): within each group of members(root, size, node, v, many), the vectors at the threshold or above.

    Groups of over BLOCK nodes are dealt out as pairs of blocks, one task's share at a time.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.concat(F.col("root"), F.encode(F.concat_ws("-", F.least("mine", "other"), F.greatest("mine", "other")), "UTF-8"))
    dealt = rows.select(key.alias("key"), "node", "v", "many", F.col("mine"), F.greatest("mine", "other").alias("hi"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "node")

    def run(batches):
        def found():
            for _, group in _groups(batches):
                node, x, many = [g[0] for g in group], _array([g[1] for g in group]), np.array([g[2] for g in group])
                mine, hi = np.array([g[3] for g in group]), group[0][4]
                total = np.zeros(len(group), dtype=np.int64)
                lows, highs = np.flatnonzero(mine != hi), np.flatnonzero(mine == hi)
                if len(lows):  # two blocks: each counts the other
                    for at in range(0, len(lows), 512):
                        hit = x[lows[at : at + 512]] @ x[highs].T >= threshold
                        total[lows[at : at + 512]] += hit @ many[highs]
                        total[highs] += many[lows[at : at + 512]] @ hit
                elif _same(group):
                    for at in range(0, len(highs), 512):
                        hit = x[at : at + 512] @ x.T >= threshold
                        hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
                        total[at : at + 512] = hit @ many
                yield node, total.tolist()

        yield from _batched(found(), ["node", "links"])

    return arrow_map(dealt, run, "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _same(group: list) -> bool:
    return len({g[3] for g in group}) == 1


def joined(vectors: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(node, n, component) of all vectors: counts are exact within the components that the links make."""
    roots = _roots(links)
    groups = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = roots.join(groups, "root").join(vectors, "node")
    exact = link_counts(members.select("root", "size", "node", "v", "many"), threshold)
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    told = vectors.select("node", "many", "least").join(roots.join(least, "root").select("node", "component"), "node", "left").join(exact, "node", "left")
    return materialize(told.select("node", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component")), "links")


def near_duplicates(df: DataFrame, threshold: float = 0.95, rounds: int = 2, k: int = K) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = materialize(clean(df), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("many"), F.min("vec_id").alias("least"))
    vectors = materialize(nodes, "nodes")
    space, lists = vectors.withColumn("root", F.col("node")), None
    for at in itertools.count():  # ends: new trees find each link that is left sooner or later
        lists = search(space, threshold, rounds, k, 1 + 1000 * at, 2**at, lists)
        told = joined(vectors, across(lists, space, threshold, rounds, k, 2 + 1000 * at, 2**at), threshold)
        if recall(vectors.select(F.col("node").alias("key"), "v", "many"), told.select(F.col("node").alias("key"), "n"), threshold, AUDIT, 9 + at) >= RECALL:
            break
    out = rows.select("vec_id", "node").join(told, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit(df: DataFrame, found: DataFrame, threshold: float = 0.95, sample: int = 200, seed: int = 9) -> float:
    """Recall of links, against brute force for a bounded sample of vectors (by a hash of the id)."""
    rows = clean(df).where("node IS NOT NULL").select(F.col("vec_id").alias("key"), "v", F.lit(1).cast("long").alias("many"))
    return recall(rows, found.select(F.col("vec_id").alias("key"), F.col("n_links").alias("n")), threshold, sample, seed)


def recall(vectors: DataFrame, counts: DataFrame, threshold: float, sample: int, seed: int) -> float:
    """Share of the links of a sample of vectors(key, v, many) that are in counts(key, n).

    Pairs within 1e-12 of the threshold, where the last bits decide, are not asked for.
    """
    some = bounded_sample(vectors, "key", sample, seed).collect()  # at most ``sample`` vectors
    if not some:
        return 1.0
    spaces: dict[int, list] = {}
    for i, r in enumerate(some):
        spaces.setdefault(len(r["v"]), []).append(i)
    packed = {size: _array([some[i]["v"] for i in at]) for size, at in spaces.items()}

    def run(batches):
        total = np.zeros(len(some), dtype=np.int64)
        for b in batches:
            rows: dict[int, list] = {}
            for v, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(v) in spaces:
                    rows.setdefault(len(v), []).append((v, many))
            for size, part in rows.items():
                hit = _array([v for v, _ in part]) @ packed[size].T >= threshold + 1e-12
                total[spaces[size]] += np.array([many for _, many in part]) @ hit
        yield {"at": list(range(len(some))), "n": total.tolist()}

    true = {r["at"]: r["n"] - 1 for r in arrow_map(vectors.select("v", "many"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    keys = counts.sparkSession.createDataFrame([(r["key"], true[i]) for i, r in enumerate(some)], counts.select("key").schema.add("true", "long"))
    r = keys.join(counts, "key").agg(F.sum("true").alias("true"), F.sum(F.least("true", "n")).alias("got")).first()
    return 1.0 if not r["true"] else r["got"] / r["true"]
