"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, ship

#: Vectors that a task holds at once, about: larger leaves are cut to slices, each of which all queries of the leaf ask.
VECTORS_PER_SLICE = 50_000
#: Queries whose visits are told at once, and scores that are computed at once.
PROBED, SCORED = 64, 4_000_000


class Forest:
    """Trees of equal depth: at each inner node a direction between two centres of sampled points, split at the median.

    Points carry one more coordinate, ``sqrt(longest^2 - |x|^2)``, and queries a zero, so that the nearest direction is
    the largest inner product, whatever the vectors' lengths.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, longest: float, seed: int = 11):
        self.longest, self.depth, self.trees = longest, depth, trees
        rng = np.random.default_rng(seed)
        self.sample = sample
        points = self.lifted(sample)
        inner = 2**depth - 1
        self.normals, self.offsets = np.zeros((trees, inner, points.shape[1])), np.zeros((trees, inner))
        for t in range(trees):
            groups = [np.arange(len(points))]
            for node in range(inner):
                own = points[groups[node]]
                w = self._direction(own, rng)
                p = own @ w
                cut = float(np.median(p)) if len(p) else 0.0
                self.normals[t, node], self.offsets[t, node] = w, cut
                groups += [groups[node][p <= cut], groups[node][p > cut]]

    @staticmethod
    def _direction(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        w = rng.standard_normal(points.shape[1])
        if len(points) > 1:
            a, b = points[rng.choice(len(points), 2, replace=False)]
            for _ in range(3):
                side = points @ (a - b) > (a + b) @ (a - b) / 2
                if side.all() or not side.any():
                    break
                a, b = points[side].mean(axis=0), points[~side].mean(axis=0)
            if np.linalg.norm(a - b) > 0:
                w = a - b
        return w / np.linalg.norm(w)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        x, out = self.lifted(x), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + ((x * self.normals[t, at]).sum(axis=1) > self.offsets[t, at])
            out[:, t] = at - (2**self.depth - 1)
        return out

    def floors(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query the k-th best score within the sample: nothing below it can be among the k best of all vectors."""
        if len(self.sample) < k:
            return np.full(len(queries), -np.inf)
        out = [np.partition(queries[i : i + 64] @ self.sample.T, -k, axis=1)[:, -k] for i in range(0, len(queries), 64)]
        return np.concatenate(out)

    def visit(self, query: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """``(tree, leaf)`` in the order in which one queue over all trees yields them: by the smallest margin on the way."""
        margins = self.normals[:, :, :-1] @ query - self.offsets
        inner, out = margins.shape[1], []
        queue = [(-math.inf, t, 0) for t in range(self.trees)]
        heapq.heapify(queue)
        while queue and len(out) < visits:
            worst, t, node = heapq.heappop(queue)
            if node >= inner:
                out.append((t, node - inner))
                continue
            m = margins[t, node]
            heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
        return out


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last: independent of how rows are batched."""
    return np.cumsum(q * v, axis=1)[:, -1]


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 8, visit_share: float = 0.15, sample: int = 20_000, leaf_scale: float = 1.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` candidates with the largest inner product for each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. The forest is
    fitted on the ``sample`` vectors with the smallest hash (this bounds what the driver holds) and indexes every vector.
    A leaf holds about ``leaf_scale * sqrt(n)`` of n distinct vectors, as long as the sample can tell so many leaves
    apart. A query visits ``visit_share`` of all leaves of the forest, and one more of each tree, in the order of one shared
    queue, and all vectors found there are ranked by the exact inner product in double precision, ties by the smaller id.
    A leaf's vectors, in slices of bounded size, are read before its queries, which then stream by: no vector is repeated
    for the number of queries, and a task holds one slice and a batch of queries. Vectors travel in the type of their column.

    The first leaf of each tree passes on its ``k + 1`` best for a query; the others only what reaches the query's
    (k + 1)-th best score within the sample, since nothing below it is among the best of all vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id
    or vectors of another length than the commonest. Rows that repeat an id and vector count once. Equal vectors are
    searched once, each with its ``k + 1`` smallest ids; more could not be in a result. Fewer candidates than ``k`` give
    fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(_usable(F.col("v")) & F.col("id").isNotNull())
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common.n
    rows = rows.where(F.size("v") == dims).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    few = rows.dropDuplicates(["id", "h1", "h2"]).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = materialise(few.groupBy("h1", "h2").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "forest-vectors")
    size = distinct.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest")).first()
    chosen = np.array([r.v for r in distinct.select("v", F.xxhash64("h1").alias("h"), "h2").orderBy("h", "h2").limit(sample).select("v").collect()], float)
    depth = max(0, min(int(math.log2(max(size.n / (leaf_scale * math.sqrt(size.n)), 1))), int(math.log2(max(len(chosen) / 16, 1)))))
    forest = spark.sparkContext.broadcast(Forest(chosen, trees, depth, size.longest))
    visits = min(trees + math.ceil(visit_share * trees * 2**depth), trees * 2**depth)

    asked = rows.where(F.col("id") % every == 0).select("id", "h1", "h2").distinct()
    queries = distinct.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("key", "v")
    slices = max(1, math.ceil(size.n / 2**depth / VECTORS_PER_SLICE))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaves = forest.value.leaves(np.stack(b["v"].to_numpy()).astype(float))
                yield pd.concat([pd.DataFrame({"tree": t, "leaf": leaves[:, t], "key": b["key"], "v": b["v"]}) for t in range(trees)])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PROBED):
                b = batch.iloc[start : start + PROBED]
                floors = forest.value.floors(np.stack(b["v"].to_numpy()).astype(float), k + 1)
                found = []
                for key, v, floor in zip(b["key"], b["v"], floors.tolist(), strict=True):
                    whole = set()
                    for t, leaf in forest.value.visit(np.asarray(v, float), visits):
                        found.append((t, leaf, key, v, floor if t in whole else -math.inf))
                        whole.add(t)
                yield pd.DataFrame(found, columns=["tree", "leaf", "key", "v", "floor"])

    def best_of(q: np.ndarray, floor: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        top, step = min(k + 1, len(v)), max(1, SCORED // len(v))
        for start in range(0, len(q), step):
            own = q[start : start + step]
            s = own @ v.T
            least = np.maximum(floor[start : start + step], np.partition(s, -top, axis=1)[:, -top]) - 1e-9
            at, best = np.nonzero(s >= least[:, None])
            yield start + at, best, _exact(own[at], v[best])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, points = None, [], None  # the slice at hand: its parts as they come, and as one once a query asks
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.column_stack([b.column(c).to_numpy() for c in ("tree", "leaf", "slice")])
            key, v = b.column("key").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, dims).astype(float)
            asks, floor = b.column("floor").is_valid().to_numpy(zero_copy_only=False), b.column("floor").to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1, b.num_rows]
            out, start = [], 0
            for end in ends.tolist():
                if group is None or (ids[start] != group).any():
                    group, held, points = ids[start], [], None
                if not asks[start]:
                    held.append((key[start:end], v[start:end]))
                elif held:
                    points = points or tuple(map(np.concatenate, zip(*held, strict=True)))
                    out += [(key[start + at], points[0][best], score) for at, best, score in best_of(v[start:end], floor[start:end], points[1])]
                start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q", "key", "score"])

    shape = f"tree int, leaf long, key long, v {kind}"
    index = distinct.select("key", "v").mapInPandas(place, shape).withColumns({"floor": F.lit(None).cast("double"), "slice": F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")})
    probes = queries.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key").mapInPandas(probe, f"{shape}, floor double")
    probes = probes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    group = ["tree", "leaf", "slice"]
    # vectors have no floor and so come first in their group
    met = index.unionByName(probes).repartition(*group).sortWithinPartitions(*group, F.col("floor").asc_nulls_first())
    found = met.mapInArrow(rank, "q long, key long, score double")
    # of each distinct vector the k + 1 best others: the query's own row is one of them at most
    best = found.groupBy("q", "key").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("n") <= k + 1).select("q", "key", "score")
    named = asked.join(distinct.select("h1", "h2", F.col("key").alias("q")), ["h1", "h2"]).select(F.col("id").alias("query_id"), "q")
    pairs = named.join(best, "q").join(distinct.select("key", "ids"), "key").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
