"""Operator 10: exact top-k search by M-trees, best first.

Vectors become whole numbers, ``floor(scale * x)``. Adding the coordinate ``sqrt(R^2 - |x|^2)``
(R the largest norm in a tree) and 0 to queries makes the largest inner product the smallest
Euclidean distance, a metric. Blocks of at most ``BLOCK`` rows become M-trees: pages of at most
``PAGE`` entries, each entry with a routing vector, the covering radius of what is below it and its
distance to the parent's routing vector. An entry is first bounded by the stored parent distance and
the triangle inequality; only if that does not rule it out is its own distance computed. A query visits
the pages of a tree by growing lower bound, the first ``ROUNDS`` in its own order and then what no
bound rules out by then; queries that visit a page at the same time share one product of matrices.
What cannot reach the k-th score is never computed, ties are kept, and scores are whole-number inner
products, so the result is exact.

Trees stay where they were written; queries travel: blocks of them of at most ``QUERY_BYTES`` are
broadcast in turn to one scan of the trees, in which each task carries the best scores from tree to tree.
Only k rows for each query and task are shuffled and merged.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id. Rows of a query's own id are not its candidates; repeated ids are queries and candidates of
their own. Vectors are compared with those of equal length. Empty tables give an empty result; other
columns are ignored. Scores must stay below 2**53.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_map, fresh_path, materialize

PAGE, FAN = 128, 16
BLOCK = 4096
#: Pages that each query visits in its own order.
ROUNDS = 3
#: Bytes of query vectors that are broadcast at once, and queries that a task searches at once.
QUERY_BYTES, PACK = 32 << 20, 1024


class Best:
    """The k best (score, id) of each of some queries so far, in order."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some, k = np.unique(query), self.score.shape[1]
        query = np.concatenate([query, np.repeat(some, k)])
        score = np.concatenate([score, self.score[some].ravel()])
        ids = np.concatenate([ids, self.id[some].ravel()])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        kept = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        self.score[some], self.id[some] = score[kept].reshape(-1, k), ids[kept].reshape(-1, k)


class Tree:
    """A bulk-loaded M-tree over whole-number vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        self.page = page
        self.norm2 = float((x * x).sum(axis=1).max())
        self.ids, self.x = ids, x
        self.pages: list[dict] = []
        self.leaves: list[dict] = []
        metric = np.concatenate([x, np.sqrt(np.maximum(0, self.norm2 - (x * x).sum(axis=1)))[:, None]], axis=1)
        self.root = self._build(metric, np.arange(len(x)), metric[:1].mean(axis=0))
        del self.ids, self.x  # the pages hold them

    def _build(self, metric: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> int:
        """The number of a page; of a leaf, -1 - its number."""
        to_parent = np.sqrt(((metric[rows] - parent) ** 2).sum(axis=1))
        if len(rows) <= self.page:
            self.leaves.append({"ids": self.ids[rows], "x": np.ascontiguousarray(self.x[rows]), "to_parent": to_parent})
            return -len(self.leaves)
        page = {"routes": [], "radius": [], "to_parent": [], "below": []}
        for part in self._split(metric, rows):
            route = metric[part].mean(axis=0)
            page["routes"].append(route)
            page["radius"].append(float(np.sqrt(((metric[part] - route) ** 2).sum(axis=1).max())))
            page["to_parent"].append(float(np.sqrt(((route - parent) ** 2).sum())))
            page["below"].append(self._build(metric, part, route))
        self.pages.append({k: np.array(v) for k, v in page.items()})
        return len(self.pages) - 1

    def _split(self, metric: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """At most FAN parts: by the nearest of pivots that lie far apart; even parts if all are alike."""
        n = min(FAN, -(-len(rows) // self.page) + 1)
        pivots, far = [rows[0]], np.full(len(rows), np.inf)
        nearest = np.zeros(len(rows), dtype=np.int64)
        for k in range(n):
            d = ((metric[rows] - metric[pivots[k]]) ** 2).sum(axis=1)
            nearest[d < far] = k
            far = np.minimum(far, d)
            if far.max() <= 0:
                break
            pivots.append(rows[int(far.argmax())])
        parts = [rows[nearest == k] for k in range(n) if (nearest == k).any()]
        if len(parts) == 1:
            parts = np.array_split(rows, n)
        return parts

    def search(self, ids: np.ndarray, q: np.ndarray, best: Best, stats: dict | None = None) -> None:
        """Adds this tree's rows to the best of the queries ``q`` with the given ids."""
        q2 = (q * q).sum(axis=1)
        slack = 1e-7 * (q2 + self.norm2 + 1)
        low = np.full((len(q), len(self.leaves)), np.inf)  # of each query and leaf: the least distance of a row in it
        far = np.zeros_like(low)  # and the distance to its routing vector

        def open_(rows: np.ndarray, distance: np.ndarray) -> np.ndarray:
            """Whether rows at these distances or beyond can reach the k-th score of the queries."""
            most = ((q2 + slack)[rows] + self.norm2 + slack[rows]) / 2
            return most.reshape(-1, *[1] * (distance.ndim - 1)) - distance * distance / 2 >= best.least[rows].reshape(-1, *[1] * (distance.ndim - 1))

        def descend(at: int, rows: np.ndarray, to_route: np.ndarray | None) -> None:
            page = self.pages[at]
            if to_route is None:
                keep = np.ones((len(rows), len(page["below"])), dtype=bool)
            else:  # without a distance of the entries' own
                keep = open_(rows, np.maximum(0, np.abs(page["to_parent"] - to_route[:, None]) - page["radius"]))
            for i, below in enumerate(page["below"]):
                some = rows[keep[:, i]]
                if not len(some):
                    continue
                route = page["routes"][i]
                d = np.sqrt(np.maximum(0, q2[some] + route @ route - 2 * (q[some] @ route[:-1])))
                least = np.maximum(0, d - page["radius"][i])
                ok = open_(some, least)
                if below < 0:
                    low[some[ok], -1 - below], far[some[ok], -1 - below] = least[ok], d[ok]
                elif ok.any():
                    descend(below, some[ok], d[ok])

        def visit(leaf: int, rows: np.ndarray) -> None:
            page = self.leaves[leaf]
            rows = rows[open_(rows, low[rows, leaf])]
            if not len(rows):
                return
            entries = open_(rows, np.abs(page["to_parent"] - far[rows, leaf][:, None])).any(axis=0) if self.pages else slice(None)
            x, of = page["x"][entries], page["ids"][entries]
            if stats is not None:
                stats["computed"] = stats.get("computed", 0) + len(rows) * len(x)
            score = q[rows] @ x.T
            score[ids[rows][:, None] == of] = -np.inf
            least, k = best.least[rows], best.score.shape[1]
            if len(x) > k and np.isinf(least).any():
                least = np.maximum(least, np.partition(score, len(x) - k, axis=1)[:, len(x) - k])
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            if len(i):
                best.add(rows[i], score[i, j], of[j])

        every = np.arange(len(q))
        if self.root < 0:
            low[:] = 0
        else:
            descend(self.root, every, None)
        order = np.argsort(low, axis=1, kind="stable")[:, :ROUNDS]
        for nth in order.T:
            for leaf in np.unique(nth):
                visit(int(leaf), every[(nth == leaf) & (low[:, leaf] < np.inf)])
        done = np.zeros(low.shape, dtype=bool)
        np.put_along_axis(done, order, True, axis=1)
        for leaf in range(low.shape[1]):
            visit(leaf, every[~done[:, leaf] & (low[:, leaf] < np.inf)])


def whole(df: DataFrame, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of the vectors that take part, as an array of doubles."""
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    return rows.select("vec_id", F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def _chunks(batches, size: int):
    """(dim, ids, matrix) of at most ``size`` rows, from a stream of (vec_id, dim, v) sorted by dim."""
    at, ids, vs = None, [], []
    for b in batches:
        values = b.column(2).flatten().to_numpy(zero_copy_only=False)
        lo = 0
        for vec_id, dim in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (dim != at or len(ids) == size):
                yield at, np.array(ids), np.array(vs)
                ids, vs = [], []
            at = dim
            ids.append(vec_id)
            vs.append(values[lo : lo + dim])
            lo += dim
    if ids:
        yield at, np.array(ids), np.array(vs)


def _packed(rows: DataFrame, parts: int, size: int, pack) -> DataFrame:
    """One row (part, dim, body) for each block of rows; ``part`` is below ``parts``."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    dealt = dealt.sortWithinPartitions("part", "dim", "vec_id").select("vec_id", "dim", "v", "part")

    def run(batches):
        def of_part():
            for b in batches:
                p = b.column(3).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo:
                        yield int(p[lo]), b.slice(lo, hi - lo)

        def stream():
            from itertools import groupby

            for part, group in groupby(of_part(), key=lambda g: g[0]):
                for dim, ids, x in _chunks((g[1] for g in group), size):
                    yield part, dim, pack(ids, x)

        for part, dim, body in stream():
            yield {"part": [part], "dim": [dim], "body": [body]}

    return arrow_map(dealt, run, "part int, dim int, body binary")


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query: the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = materialize(whole(df, scale), "whole")
    queries = materialize(rows.where(F.col("vec_id") % every == 0).withColumn("copy", F.monotonically_increasing_id()), "queries")
    found = rows.count()
    trees = -(-max(1, found) // (BLOCK * 3 // 4))
    tree_rows = materialize(_packed(rows, trees, BLOCK, lambda ids, x: pickle.dumps(Tree(ids, x))).select("dim", "body"), "trees")
    size = queries.agg(F.sum(F.col("dim") * 8 + 16)).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    out = fresh_path(spark, "best")
    schema = "query_id long, copy long, vec_id long, score long"
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("copy"), F.lit(blocks)) == block).select("dim", "vec_id", "copy", "v")
        _best(tree_rows, mine, k, schema).write.parquet(f"{out}/block={block}")
    if not blocks:
        spark.createDataFrame([], schema).write.parquet(f"{out}/block=0")
    merged = spark.read.schema(schema).parquet(out)
    return merged.withColumn("rank", _rank()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rank():
    return F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))


def _best(tree_rows: DataFrame, queries: DataFrame, k: int, schema: str) -> DataFrame:
    """The k best of each query in the trees of each task; ``queries`` are about QUERY_BYTES together."""
    dims: dict[int, list] = {}
    for r in queries.toArrow().to_batches():
        for dim, vec_id, copy, v in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist(), r.column(3), strict=True):
            dims.setdefault(dim, []).append((vec_id, copy, v.values.to_numpy()))
    packed = {dim: (np.array([r[0] for r in some]), np.array([r[1] for r in some]), np.array([r[2] for r in some])) for dim, some in dims.items()}
    shared = queries.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        best: dict[tuple[int, int], Best] = {}
        of = shared.value
        for b in batches:
            for dim, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if dim not in of:
                    continue
                tree, (ids, _, q) = pickle.loads(body.as_py()), of[dim]
                for at in range(0, len(ids), PACK):
                    part = slice(at, at + PACK)
                    tree.search(ids[part], q[part], best.setdefault((dim, at), Best(len(ids[part]), k)))
        for (dim, at), found in best.items():
            ids, copies, _ = of[dim]
            i, j = np.nonzero(found.score > -np.inf)
            yield {"query_id": ids[at + i], "copy": copies[at + i], "vec_id": found.id[i, j], "score": found.score[i, j].astype(np.int64)}

    return arrow_map(tree_rows, run, schema)


def share_scored(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, sample: int = 4096) -> float:
    """Share of (query, row) pairs that a tree of at most ``sample`` rows computes: 1 if bounds rule out nothing."""
    rows = whole(df, scale).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ids, x, stats = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows]), {}
    some = ids % every == 0
    Tree(ids, x).search(ids[some], x[some], Best(int(some.sum()), k), stats)
    return stats["computed"] / (some.sum() * len(x))
