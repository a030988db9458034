"""Approximate nearest neighbours in a hierarchical k-means tree, best bin first.

1. The tree: spherical k-means with BRANCH centroids, again inside each cluster, on a sample of
   at most SAMPLE rows drawn by hash of the id; a leaf aims at LEAF rows, MAX_LEAVES bounds the
   tree. Every row is then indexed: it goes down to the nearest centroid at each level.
2. Rows of a leaf lie in blocks of a bounded number of rows, so that a leaf with a third of all
   rows is many tasks' work. Equal vectors are told apart by id only.
3. A query goes through the tree with a priority queue: the open branch whose centroid is nearest
   is next, until enough leaves are open. How many are enough is calibrated: for up to
   CALIBRATE rows the true neighbours are found by brute force in blocks, and the number of leaf
   visits is the least that reaches RECALL. A query also goes on until its leaves hold as many
   candidates as it wants neighbours (all leaves, if need be).
4. Blocks score their queries by the exact cosine in double precision; best rows are merged by
   query.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part; a query's own row is no candidate (by id); equal scores go by
the smaller id; with fewer candidates than K all come.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.llm.common import parts, prepare, stage, table

K = 5
BRANCH = 8
LEAF = 512  # a leaf is one matrix product; smaller ones cost more in rows than they save
MAX_LEAVES = 4096
SAMPLE = 20_000
CALIBRATE = 200
RECALL = 0.95
BLOCK_ROWS = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) for j in range(len(centres))])
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return np.unique(centres.round(12), axis=0)


class Tree:
    """Nodes are (centroids, children); a child is a node or a leaf's number."""

    def __init__(self, x: np.ndarray, rows: int):
        self.rng = np.random.default_rng(5)
        self.leaves = 0
        wanted = max(1, min(MAX_LEAVES, rows // LEAF, len(x) // 4))
        self.least = max(4, len(x) // wanted)
        self.root = self._build(x, 0)

    def _build(self, x: np.ndarray, depth: int):
        if len(x) > self.least and depth < 12 and self.leaves < MAX_LEAVES:
            centres = _kmeans(x, min(BRANCH, -(-len(x) // self.least)), self.rng)
            if len(centres) > 1:
                own = (x @ centres.T).argmax(axis=1)
                if np.bincount(own).max() < len(x):
                    return centres, [self._build(x[own == j], depth + 1) for j in range(len(centres))]
        self.leaves += 1
        return self.leaves - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)

        def go(node, at: np.ndarray) -> None:
            if isinstance(node, int):
                out[at] = node
                return
            own = (x[at] @ node[0].T).argmax(axis=1)
            for j, child in enumerate(node[1]):
                if (own == j).any():
                    go(child, at[own == j])

        go(self.root, np.arange(len(x)))
        return out

    def visits(self, q: np.ndarray):
        """Leaves in the order in which a best-bin-first search opens them."""
        heap, count = [(0.0, 0, self.root)], 1
        while heap:
            _, _, node = heapq.heappop(heap)
            if isinstance(node, int):
                yield node
                continue
            for near, child in zip((node[0] @ q).tolist(), node[1], strict=True):
                heapq.heappush(heap, (-near, count, child))
                count += 1


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _indexer(tree: Tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(tree.assign(_unit(_vectors(batch.column("v")))))], ["id", "v", "leaf"])

    return run


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of the rows x, itself left out: query, id, score."""
    xs, out = _unit(x), []
    lengths = np.sqrt((x**2).sum(axis=1))
    for first in range(0, len(q), 64):
        some, some_ids = q[first : first + 64], query_ids[first : first + 64]
        near = _unit(some) @ xs.T
        near[some_ids[:, None] == ids[None, :]] = -np.inf
        cut = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]] if near.shape[1] > k else np.full((len(some), 1), -2.0)
        i, j = np.nonzero(near >= np.maximum(cut - 1e-9, -2.0))  # a little more than k, for ties and rounding
        exact = np.einsum("nd,nd->n", x[j], some[i]) / (lengths[j] * np.sqrt((some**2).sum(axis=1))[i])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out.append((some_ids[i[keep]], ids[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))


def _pairs_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "id", "score"])


def _brute(query_ids: np.ndarray, q: np.ndarray, k: int):
    """Each batch of rows against the given queries."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(query_ids):
                yield _pairs_batch(_best(batch.column("id").to_numpy(), _vectors(batch.column("v")), query_ids, q, k))

    return run


def _router(tree: Tree, leaves: int, loads: np.ndarray, wanted: int):
    """Queries to the leaves they visit."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_vectors(batch.column("v")))
            rows, opened = [], []
            for i in range(len(x)):
                have = 0
                for n, leaf in enumerate(tree.visits(x[i])):
                    if n >= leaves and have >= wanted:
                        break
                    have += loads[leaf]
                    if loads[leaf]:
                        rows.append(i)
                        opened.append(leaf)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), batch.column("v").take(pa.array(rows, pa.int64())), pa.array(opened, pa.int32())], ["id", "v", "leaf"])

    return run


def _scan(k: int):
    """Rows (kind 0) and queries (kind 1) sorted by leaf, block and kind: scores block by block."""

    def run(batches):
        key, ids, x = None, [], []
        done = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "block", "kind", "id")]
            v = _vectors(batch.column("v")) if batch.num_rows else None
            cut = np.flatnonzero(np.diff(np.stack(cols[:3]), axis=1).any(axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if a == b:
                    continue
                now = (cols[0][a], cols[1][a])
                if now != key:
                    key, ids, x, done = now, [], [], None
                if cols[2][a] == 0:
                    ids.append(cols[3][a:b])
                    x.append(v[a:b])
                elif ids:
                    done = done or (np.concatenate(ids), np.concatenate(x))
                    yield _pairs_batch(_best(*done, cols[3][a:b], v[a:b], k))

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = df.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.filter(fine)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (most["d"] if most else 0))


def _draw(rows: DataFrame, count: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About `most` rows at most, by hash of the id: ids and vectors, in order of id."""
    share = min(1.0, most / max(count, 1))
    got = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * most).toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    column = got.column("v").chunk(0)
    ids = got.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], _vectors(column)[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, id, score: each query's k nearest rows of vectors found. queries has the
    columns id and v."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col), "ann-rows")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    _, sample = _draw(rows, count, SAMPLE, 3)
    tree = Tree(_unit(sample) if len(sample) else np.ones((1, 1)), count)
    leafed = rows.mapInArrow(_indexer(tree), "id long, v array<double>, leaf int")
    index = stage(leafed, "ann-index")
    loads = np.zeros(tree.leaves, dtype=np.int64)
    for r in index.groupBy("leaf").count().collect():  # at most MAX_LEAVES rows
        loads[r["leaf"]] = r["count"]

    ids, q = _draw(rows, count, CALIBRATE, 4)
    visits = _calibrate(tree, index, ids, q, k, recall)

    blocks = np.maximum(1, -(-loads // BLOCK_ROWS))
    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("leaf") + 1) if blocks.max() > 1 else F.lit(1)
    stored = index.select("leaf", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    routed = queries.mapInArrow(_router(tree, visits, loads, k + 1), "id long, v array<double>, leaf int")
    asked = routed.select("leaf", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    both = stored.unionByName(asked).repartition(parts(spark), "leaf", "block").sortWithinPartitions("leaf", "block", "kind", "id")
    found = both.mapInArrow(_scan(k), "query_id long, id long, score double")
    return _top(found, k)


def _calibrate(tree: Tree, index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Leaf visits that reach the recall on the given queries, by brute force over all rows."""
    if not len(ids):
        return tree.leaves
    truth = _top(index.select("id", "v").mapInArrow(_brute(ids, q, k), "query_id long, id long, score double"), k)
    where = truth.join(index.select("id", "leaf"), "id").select("query_id", "leaf").collect()  # CALIBRATE * k rows
    unit, order = _unit(q), {}
    for i, query in enumerate(ids.tolist()):
        order[query] = {leaf: n for n, leaf in enumerate(tree.visits(unit[i]))}
    depths = np.sort([order[r["query_id"]][r["leaf"]] for r in where])
    return int(depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))) - 1)]) + 1 if len(depths) else 1


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings")
    queries = usable(vectors, "vec_id", "embedding").filter("id % 50 = 0")
    return nearest(vectors, queries).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


QUERIES = {"op9_ann": op9_ann}
