"""Exact top-k search by inner product with a KD-tree for each shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. A shard's tree splits at the
median of its widest dimension down to leaves of ``LEAF_ROWS``, and every leaf has a tight bounding box.
The largest inner product of a query with a box bounds all scores in it, so a search takes leaves from
the best bound down and stops when the bound is below the k-th score found.

The k-th score is propagated: each query is first searched in one shard, and what it finds there is the
floor from which it searches all others. Queries travel to the shards in blocks of ``BLOCK_ROWS``, so a
task holds one tree and one block, whatever the number of either.

Scores are exact integers whatever the size of the components: shards or queries with large ones are searched
with Python's integers instead of 64-bit ones, and scores travel as bytes that sort like the integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

SCALE = 256
SHARD_ROWS = 8192
LEAF_ROWS = 64
BLOCK_ROWS = 4096
#: 64-bit integers serve while no product of a query and a vector can pass 2 ** 62.
EXACT_BITS = 62
LONGEST = (1 << 63) - 1


def sound(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, dims``: components as doubles; rows that take no part are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
        .select("vec_id", x.alias("v")).withColumn("dims", F.size("v"))
    )


def unpack(values: pd.Series, dims: int) -> np.ndarray:
    """Components as floor(256 * x): 64-bit integers if all are small, else Python's.

    256 * x only moves the exponent of a double, so the product is exact as long as it is finite.
    """
    points = np.array(values.tolist(), dtype=np.float64).reshape(-1, dims)
    if not points.size or np.abs(points).max() < (1 << EXACT_BITS) / SCALE:
        return np.floor(points * SCALE).astype(np.int64)
    large = np.frompyfunc(lambda x: math.floor(Fraction(x) * SCALE), 1, 1)
    return large(points)


def fitting(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in 64 bits if all scores and bounds fit, else both as Python's integers."""
    def largest(side: np.ndarray) -> int:
        return max(int(side.max()), -int(side.min()), 1)

    bits = largest(points).bit_length() + largest(queries).bit_length() + points.shape[1].bit_length() + 1
    if bits <= EXACT_BITS and points.dtype != object and queries.dtype != object:
        return points, queries
    return points.astype(object), queries.astype(object)


def sortable(score: int) -> bytes:
    """Bytes in the order of the integers: sign, length and digits, all turned round for negative ones."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + body if score >= 0 else b"\0" + bytes(255 - x for x in body)


def integer(code: bytes) -> int:
    """The integer of :func:`sortable`."""
    digits = code[3:]
    return int.from_bytes(digits, "big") if code[0] else -int.from_bytes(bytes(255 - x for x in digits), "big")


def split_leaves(points: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each leaf: median splits of the widest dimension; equal points are not parted for long."""
    pending = [rows]
    while pending:
        own = pending.pop()
        spread = points[own].max(axis=0) - points[own].min(axis=0) if len(own) > LEAF_ROWS else np.zeros(1, np.int64)
        if len(own) <= LEAF_ROWS or not spread.any():
            yield own
            continue
        middle = len(own) // 2
        order = np.argpartition(points[own, int(spread.argmax())], middle)
        pending += [own[order[middle:]], own[order[:middle]]]


class Tree:
    """Leaves of one shard with their boxes; rows are in the order of their leaves, then of their ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, points = ids[by_id], points[by_id]
        leaves = [np.sort(leaf) for leaf in split_leaves(points, np.arange(len(ids)))]
        order = np.concatenate(leaves)
        self.ids, self.points = ids[order], points[order]
        self.edges = np.cumsum([0] + [len(leaf) for leaf in leaves])
        starts = self.edges[:-1]
        self.low = np.minimum.reduceat(self.points, starts, axis=0)
        self.high = np.maximum.reduceat(self.points, starts, axis=0)
        self.first_id = np.minimum.reduceat(self.ids, starts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: int, point: np.ndarray, bounds: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """Up to k pairs of score and negated id, best first, none worse than ``floor``.

        Leaves are visited by falling bound. A leaf whose bound equals the k-th score can only help
        with a smaller id.
        """
        best: list[tuple[int, int]] = []
        for leaf in np.argsort(-bounds, kind="stable"):
            worst = best[0] if len(best) == k else None
            if floor is not None and (worst is None or floor > worst):
                worst = floor
            if worst is not None:
                if int(bounds[leaf]) < worst[0]:
                    break
                if (int(bounds[leaf]), -int(self.first_id[leaf])) < worst:
                    continue
            rows = slice(self.edges[leaf], self.edges[leaf + 1])
            scores = self.points[rows] @ point
            ids = self.ids[rows]
            keep = np.flatnonzero(ids != query if worst is None else (ids != query) & (scores >= worst[0]))
            if len(keep) > k:  # ids rise within a leaf, so ties keep the smallest
                keep = keep[np.argsort(-scores[keep], kind="stable")[:k]]
            for at in keep:
                pair = (int(scores[at]), -int(ids[at]))
                if worst is not None and pair < worst:
                    continue
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)
        return sorted(best, reverse=True)


def search_shards(queries: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, code, score``: the best k of each query in each shard that it is sent to.

    Both sides are grouped by ``shard, part``: one shard and one block of queries.
    """

    def found(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, bytes, int]] = []
        if len(own) and len(rows):
            dims = int(rows["dims"].iloc[0])
            points, asked = fitting(unpack(rows["v"], dims), unpack(own["v"], dims))
            tree = Tree(rows["vec_id"].to_numpy(), points)
            floors = zip(own["floor"], own["floor_id"], strict=True)
            for query, point, bounds, (score, vec) in zip(own["vec_id"], asked, tree.bounds(asked), floors, strict=True):
                floor = None if score is None else (integer(score), -int(vec))
                out += [
                    (query, -at, sortable(got), max(-LONGEST - 1, min(LONGEST, got)))
                    for got, at in tree.search(query, point, bounds, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "code", "score"])

    keys = ["shard", "part"]
    return queries.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(
        found, "query_id long, vec_id long, code binary, score long"
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query; a shard gives k rows at most, so groups stay small."""
    order = Window.partitionBy("query_id").orderBy(F.desc("code"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of all rows for each row whose id ``every`` divides.

    Vectors that are null or empty, or hold null or non-finite components, and rows without an id take no part.
    A score beyond a long stands as the nearest long; its place in the order is exact. Only vectors of one length are compared. A query's own id is
    never among its results. Equal scores go to the smaller id. Of repeated rows and of several vectors
    with one id all are candidates, and an id counts as often as it has rows; a query id with several
    vectors is answered for the smallest vector. Fewer candidates than ``k`` give fewer rows; an empty
    table gives none. Other columns are not read.
    """
    rows = materialize(sound(vectors).where("dims > 0"), "top-vectors")
    counts = {row["dims"]: row["n"] for row in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    spark = vectors.sparkSession
    plan = spark.createDataFrame(
        [(dims, -(-n // SHARD_ROWS)) for dims, n in counts.items()], "dims int, shards long"
    )
    dealt = rows.join(F.broadcast(plan), "dims")
    place = F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    shards = dealt.withColumn("shard", F.concat_ws(":", "dims", place)).select("shard", "dims", "vec_id", "v")
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("dims", "v", "shards")).alias("q")
    ).select("vec_id", "q.*")
    parts = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts)).cast("int"))
    asked = materialize(asked.withColumn("home", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("shards"))), "top-queries")
    spread = materialize(
        shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "top-shards"
    )
    columns = ["shard", "part", "vec_id", "v", "floor", "floor_id"]
    none = [F.lit(None).cast("binary").alias("floor"), F.lit(None).cast("long").alias("floor_id")]
    at_home = asked.withColumn("shard", F.concat_ws(":", "dims", "home")).select(*columns[:4], *none)
    first = materialize(search_shards(at_home, spread, k), "top-first")
    floor = ranked(first, k).where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("code").alias("floor"), F.col("vec_id").alias("floor_id")
    )
    away = asked.join(floor, "vec_id", "left").withColumn(
        "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    ).where("place <> home").withColumn("shard", F.concat_ws(":", "dims", "place"))
    rest = search_shards(away.select(*columns), spread, k)
    return ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL: brute force.
SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
