"""Exact top-k inner products by M-tree best-first search.

A vector's components become integers, floor(256 x). With one more component that brings all
candidates of a tree to the same length, the largest inner product with a query is the smallest
Euclidean distance to it, which is a metric. Candidates are dealt into shards of bounded size,
and each shard is an M-tree of pages: an inner page lists its children's routing vectors with
their covering radii and their distances to the page's own routing vector; a leaf page lists its
vectors with their distances to the routing vector. A search takes the page with the least
possible distance first, skips entries that the triangle inequality excludes by the stored
distances alone, and stops when no page left can hold anything nearer than the k-th result. Bounds
are compared with room for rounding; scores are exact integers, and ties go to the smaller id.

Queries go to every shard in blocks; the k best of each shard and query meet in one top-k.

Defined results: vectors that are null, empty or hold null or non-finite components take no part,
nor do rows with a null id; only vectors of equal length are compared; rows that repeat an id
with the same vector count once; a query's own id is never its result; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginmart.llm import _common

SCALE, TOP, EVERY = 256, 5, 50
#: Entries of a page; vectors of a shard; queries of a block.
PAGE, SHARD, BLOCK = 128, 16384, 1024


class Page:
    """A node: routing vector, covering radius, and entries with their distances to the routing vector."""

    __slots__ = ("center", "radius", "rows", "children", "to_center", "centers", "radii")

    def __init__(self, center: np.ndarray, rows: np.ndarray | None, children: list[Page], points: np.ndarray | None):
        self.center, self.rows, self.children = center, rows, children
        if rows is not None:
            self.to_center = _distances(points[rows], center)
            order = np.argsort(self.to_center, kind="stable")
            self.rows, self.to_center = rows[order], self.to_center[order]
            self.radius = float(self.to_center[-1]) if len(rows) else 0.0
        else:
            self.centers = np.array([c.center for c in children])
            self.radii = np.array([c.radius for c in children])
            self.to_center = _distances(self.centers, center)
            self.radius = float((self.to_center + self.radii).max())


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def build(points: np.ndarray, page: int = PAGE) -> Page:
    """Bulk load: pick spread-out routing vectors, give each point to the nearest, and go on within each."""
    return _build(points, np.arange(len(points)), page)


def _build(points: np.ndarray, rows: np.ndarray, page: int) -> Page:
    center = points[rows].mean(0)
    if len(rows) <= page:
        return Page(center, rows, [], points)
    k = min(page, -(-len(rows) // page) * 2)
    # Every n-th row, in id order, is a routing vector.
    seeds = points[rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)]]
    nearest = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        part = points[rows[at : at + 4096]]
        nearest[at : at + 4096] = (np.einsum("ij,ij->i", seeds, seeds) - 2 * part @ seeds.T).argmin(1)
    groups = [rows[nearest == g] for g in range(k)]
    groups = [g for g in groups if len(g)]
    if len(groups) == 1:  # equal points: any split is as good
        groups = [rows[at : at + -(-len(rows) // page)] for at in range(0, len(rows), -(-len(rows) // page))]
    return Page(center, None, [_build(points, g, page) for g in groups], points)


class MTree:
    """The tree of one shard: int64 vectors and their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lengths = np.einsum("ij,ij->i", self.vectors.astype(float), self.vectors.astype(float))
        self.most = float(lengths.max())
        self.points = np.hstack([self.vectors.astype(float), np.sqrt(np.maximum(0, self.most - lengths))[:, None]])
        self.root = build(self.points, page)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) without the own id, best first, and how many vectors were scored."""
        q = np.append(query.astype(float), 0.0)
        square = float(q @ q)
        room = 1e-9 * (square + self.most) + 1e-6  # for rounding, on squared distances
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst result first
        reach = np.inf  # distance within which a vector can still be among the results
        scored = 0
        root = self.root
        to_root = float(np.sqrt(((q - root.center) ** 2).sum()))
        queue = [(max(0.0, to_root - root.radius), 0, to_root, root)]
        count = 0
        while queue and queue[0][0] <= reach:
            _, _, to_page, page = heapq.heappop(queue)
            if page.rows is None:
                near = np.abs(to_page - page.to_center) - page.radii <= reach
                for i in np.flatnonzero(near).tolist():
                    gap = q - page.centers[i]
                    to_child = float(np.sqrt(gap @ gap))
                    least = max(0.0, to_child - page.radii[i])
                    if least <= reach:
                        count += 1
                        heapq.heappush(queue, (least, count, to_child, page.children[i]))
                continue
            low, high = np.searchsorted(page.to_center, [to_page - reach, to_page + reach])
            rows = page.rows[low : high + 1]
            scored += len(rows)
            scores = self.vectors[rows] @ query
            if len(best) == k:
                rows, scores = rows[scores >= best[0][0]], scores[scores >= best[0][0]]
            for score, i in zip(scores.tolist(), self.ids[rows].tolist()):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                reach = float(np.sqrt(max(0.0, square + self.most - 2 * best[0][0] + room)))
        return [(s, -i) for s, i in sorted(best, reverse=True)], scored


def quantized(rows: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<long>, floor(scale x)) of the rows that take part, one for each id and vector."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(id_column).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP, page: int = PAGE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each query's k best candidates by inner product: query_id, rank, vec_id, score. Both sides as quantized() gives them."""
    sizes = candidates.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    asked = queries.groupBy(F.size("v").alias("q_dim")).agg(F.count(F.lit(1)).alias("m"))
    # Shards and blocks of each vector length, by the counts: hashes of ids fill them evenly.
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.greatest(F.lit(1).cast("long"), n))
    shards = F.ceil(F.col("n") / shard)
    stored = candidates.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim").withColumn("shard", deal("vec_id", shards))
    blocks = F.ceil(F.col("m") / block)
    asking = queries.withColumn("q_dim", F.size("v")).join(F.broadcast(asked), "q_dim").join(F.broadcast(sizes), F.col("q_dim") == F.col("dim")).withColumn("block", deal("vec_id", blocks))
    # A query goes to each shard of its length once.
    sent = asking.select("dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    packed = lambda df, names, key, out: df.groupBy(*key).agg(F.collect_list(F.struct(*names)).alias(out))
    trees = packed(stored, ("vec_id", "v"), ("dim", "shard"), "points")
    asks = packed(sent, ("query_id", "q"), ("dim", "shard", "block"), "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, number = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if built != (dim, number):
                    points = batch.column(2)[row].values
                    built, tree = (dim, number), MTree(points.field(0).to_numpy(), _matrix(points.field(1), dim), page)
                wanted = batch.column(3)[row].values
                out: list[tuple[int, int, int]] = []
                for own, query in zip(wanted.field(0).to_pylist(), _matrix(wanted.field(1), dim)):
                    out += [(own, i, s) for s, i in tree.search(query, own, k)[0]]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    # A row holds a shard and a block, some MB: few rows go to Python at once.
    found = trees.join(asks, ["dim", "shard"]).select("dim", "shard", "points", "asks").mapInArrow(search, "query_id long, vec_id long, score long")
    found = _common.staged(found, "mtree", batch_rows=4)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array of equally long integer lists."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def every(column: Column, n: int = EVERY) -> Column:
    return column % n == 0


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products for each vector whose id is divisible by 50, over all vectors."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(every(F.col("vec_id"))))


OP2_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
