"""Nearest neighbours by inner product: a forest of random-projection trees searched through one shared priority queue.

The trees are fitted on a bounded sample, every row is indexed: it belongs to one leaf of each tree. A query walks all trees at
once: branches not taken go to one queue, ordered by their squared distance from the query's cell, and leaves are taken from it until they hold a share of
all rows. That share is set on the sample, against brute force, to reach ``RECALL``: small where the vectors have structure, large where
they have none. Rows and queries then meet by leaf in a shuffle, each leaf reranks its candidates exactly, and the best of each
query's leaves are merged. Large leaves are cut into blocks of rows that the leaf's queries all visit.

Inner products turn into distances by one more component, sqrt(M^2 - |x|^2) with the greatest norm M; 0 for queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

TREES = 6
#: Rows at most that the trees are fitted on, and rows of this sample in a leaf aimed at. The number of leaves so is bounded, and
#: with it what the leaves of a query give to be merged; leaves grow with the table and are cut into blocks.
SAMPLE, LEAF = 20_000, 320
MAX_DEPTH = 9
#: Rows of a block, and queries beyond which a leaf's queries are cut too.
BLOCK, QUERY_BLOCK = 4_096, 1 << 15
RECALL = 0.95


@dataclass
class Forest:
    """Complete binary trees in heap order: planes [trees, inner nodes, d + 1], cuts [trees, inner nodes]."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate((x, rest[:, None]), 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree: [rows, trees]."""
        up = self.lifted(x)
        out = np.empty((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", up, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def route(self, q: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold ``enough`` rows."""
        up = np.append(q, 0.0)
        margin = self.planes @ up - self.cuts  # every tree's distances from its planes
        inner = (1 << self.depth) - 1
        heap = [(0.0, t, 0) for t in range(len(self.planes))]
        taken, held = [], 0
        while heap and held < enough:
            far, t, node = heapq.heappop(heap)
            while node < inner:
                d = margin[t, node]
                right = d > 0
                heapq.heappush(heap, (far + d * d, t, 2 * node + 2 - right))
                node = 2 * node + 1 + right
            n = counts[t, node - inner]
            if n:
                taken.append((t, int(node - inner)))
                held += n
        return taken


def fit(sample: np.ndarray, norm: float, trees: int = TREES, seed: int = 5) -> Forest:
    """Random planes with cuts at the sample's median in each node."""
    rng = np.random.default_rng(seed)
    depth = int(np.clip(np.ceil(np.log2(max(len(sample), 1) / LEAF)), 0, MAX_DEPTH))
    inner = (1 << depth) - 1
    planes = rng.normal(size=(trees, inner, sample.shape[1] + 1))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    forest = Forest(planes, np.zeros((trees, inner)), depth, norm)
    up = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                here = np.nonzero(node == k)[0]
                p = up[here] @ planes[t, k]
                cut = np.median(p) if len(p) else 0.0
                forest.cuts[t, k] = cut
                node[here] = 2 * k + 1 + (p > cut)
    return forest


def needed_share(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, queries: int = 200) -> float:
    """Share of all rows that leaves must hold (each tree counts anew) so that the sample's mean recall reaches ``recall``."""
    n = len(sample)
    if n <= 4 * k:
        return float(len(forest.planes))
    leaf = forest.leaves(sample)
    counts = np.stack([np.bincount(leaf[:, t], minlength=1 << forest.depth) for t in range(leaf.shape[1])])
    picked = np.linspace(0, n - 1, min(queries, n)).astype(int)
    seen_at = []
    for i in picked:
        s = sample @ sample[i]
        s[i] = -np.inf
        best = np.argpartition(-s, k)[:k]
        at, held = {}, 0
        for t, f in forest.route(sample[i], counts, np.inf):
            held += counts[t, f]
            at[(t, f)] = held / n
        seen_at.append([min(at[(t, leaf[j, t])] for t in range(leaf.shape[1])) for j in best])
    return float(np.quantile(np.concatenate(seen_at), recall))


def _array(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.values
    return np.asarray(flat.cast(pa.float64())).reshape(-1, width)


def _search_width(valid: DataFrame, width: int, every: int, k: int) -> DataFrame:
    spark = valid.sparkSession
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows, norm = valid.agg(F.count("*"), F.sqrt(F.max(norm2))).first()
    sample = valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = np.stack(sample.to_list()) if len(sample) else np.zeros((0, width))
    forest = fit(sample, float(norm or 0))
    share = needed_share(forest, sample, k)
    shared = spark.sparkContext.broadcast(vars(forest))
    trees, leaves = len(forest.planes), 1 << forest.depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Forest(**shared.value), np.zeros((trees, leaves), np.int64)
        for b in batches:
            leaf = own.leaves(_array(b.column(0), width))
            for t in range(trees):
                total[t] += np.bincount(leaf[:, t], minlength=leaves)
        t, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[t, f])], names=["tree", "leaf", "n"])

    counts = np.zeros((trees, leaves), np.int64)
    for r in valid.select("v").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf
        counts[r["tree"], r["leaf"]] = r["n"]
    blocks, cuts = -(-counts // BLOCK), np.maximum(1, -(-counts // (every * QUERY_BLOCK)))
    enough = max(share * rows, trees * (k + 1))
    plan = spark.sparkContext.broadcast((counts, blocks, cuts))

    def mixed(ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (_, blocks, cuts) = Forest(**shared.value), plan.value
        for b in batches:
            x, ids = _array(b.column(1), width), np.asarray(b.column(0), np.int64)
            leaf = own.leaves(x)
            raw = [v.tobytes() for v in x]
            for t in range(trees):
                f = leaf[:, t]
                block = mixed(ids) % np.maximum(1, blocks[t][f])
                for c in range(int(cuts[t].max())):
                    on = np.nonzero(c < cuts[t][f])[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), t, np.int32)), pa.array(f[on].astype(np.int32)), pa.array(block[on].astype(np.int32)), pa.array(np.full(len(on), c, np.int32)), pa.array(ids[on]), pa.array([raw[i] for i in on], pa.binary())], names=["tree", "leaf", "block", "cut", "id", "x"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (counts, blocks, cuts) = Forest(**shared.value), plan.value
        for b in batches:
            x, ids = _array(b.column(1), width), np.asarray(b.column(0), np.int64)
            mark = mixed(ids)
            out: list[tuple] = []
            for i, q in enumerate(x):
                raw = q.tobytes()
                for t, f in own.route(q, counts, enough):
                    out += [(t, f, s, int(mark[i] % cuts[t, f]), int(ids[i]), raw) for s in range(blocks[t, f])]
                if len(out) > 20_000 or i == len(x) - 1:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in list(zip(*out))[:4]), pa.array([o[4] for o in out], pa.int64()), pa.array([o[5] for o in out], pa.binary())], names=["tree", "leaf", "block", "cut", "query", "q"])
                    out = []

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, x = np.asarray(left["id"]), np.frombuffer(b"".join(left["x"].to_pylist()), np.float64).reshape(-1, width)
        asked, q = np.asarray(right["query"]), np.frombuffer(b"".join(right["q"].to_pylist()), np.float64).reshape(-1, width)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        found = []
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ x.T
            rough[asked[at : at + 256, None] == ids[None, :]] = -np.inf
            for i, s in enumerate(rough):
                top = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                near = np.nonzero((s >= top - 1e-9 * (1 + abs(top))) & (s > -np.inf))[0] if np.isfinite(top) else np.nonzero(s > -np.inf)[0]
                exact = (x[near] * q[at + i]).sum(1)  # the same sum for equal vectors, wherever they lie
                best = np.lexsort((ids[near], -exact))[:k]
                found.append((np.full(len(best), asked[at + i]), ids[near][best], exact[best]))
        return pa.table([np.concatenate(c) for c in zip(*found)], names=names)

    keys = ["tree", "leaf", "block", "cut"]
    kinds = "tree int, leaf int, block int, cut int, "
    data = valid.select("id", "v").mapInArrow(placed, kinds + "id long, x binary")
    asked = valid.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(routed, kinds + "query long, q binary")
    return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank, "query long, id long, score double")


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id divides by ``every`` its ``k`` nearest found among the others.

    Null, zero and not finite vectors, and rows with null ids, take no part. Vectors meet those of their length only. Rows
    that repeat an id count once, with the best score; as a query the smallest vector of the id asks. Ties go to the
    smaller id. An empty table gives no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = settle(vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine), "vectors")
    found = None
    for width in sorted(r[0] for r in valid.select(F.size("v")).distinct().collect()):
        part = _search_width(valid.where(F.size("v") == width), width, every, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    listed = best.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))), 1, k).alias("near"))
    return listed.select(F.col("query").alias("query_id"), F.posexplode("near").alias("at", "n")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score"))
