"""Clustering of integer vectors round moving centroids, by an equal-average equal-variance search.

A vector's components become whole numbers. The centroids are kept in the order of their component sums (their means).
For each vector the search starts at its own mean and goes outward to both sides, always on the nearer one. With d
components, d * distance is at least the squared difference of the sums, and at least that plus the squared difference
of the two deviations: the first inequality ends the search (all centroids farther out have a larger difference), the second
passes over a centroid. What remains is compared exactly, in integers, so the inequalities change no result.

Each round is one pass over the vectors. A task sends the exact sums of its clusters, at most one row per cluster and
component; the new centroids, whose number is a parameter, are all that the driver holds.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; ties of
distance go to the smaller centroid; repeated ids are rows of their own; a null id is a row too, but a first centroid only where
there are too few others; rows that tie for a first centroid are taken in the order of their components; fewer vectors than centroids
give fewer centroids; no vectors give no rows; columns other than id and vector are not read; distances and sums beyond 64 bits
are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import saved

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = "1"


class Centroids:
    """Integer centroids in the order of their means, and the search for the nearest of them."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        self.dims = len(rows[0])
        self.limit = 2**31 // (2 * self.dims)  # below it, no product here passes 2**62
        self.plain = all(-self.limit < x < self.limit for row in rows for x in row)
        sums = [sum(row) for row in rows]
        self.order = sorted(range(len(rows)), key=lambda i: (sums[i], i))
        self.sums = [sums[i] for i in self.order]
        if self.plain:
            self.table = np.array([rows[i] for i in self.order], dtype=np.int64)
            self.sum_row = np.array(self.sums, dtype=np.int64)
            self.number = np.array(self.order, dtype=np.int64)
            self.spread = self.dims * (self.table**2).sum(axis=1) - self.sum_row**2
            self.deviation = np.sqrt(self.spread.astype(np.float64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of a table of 64-bit integers."""
        n, k = len(vectors), len(self.rows)
        sums = vectors.sum(axis=1)
        spread = self.dims * (vectors**2).sum(axis=1) - sums**2
        deviation = np.sqrt(spread.astype(np.float64))
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k, dtype=np.int64)
        right = np.searchsorted(self.sum_row, sums)
        left = right - 1
        live = np.arange(n)
        far = np.iinfo(np.int64).max
        while len(live):
            l, r = left[live], right[live]
            to_left = np.where(l >= 0, sums[live] - self.sum_row[np.maximum(l, 0)], far)
            to_right = np.where(r < k, self.sum_row[np.minimum(r, k - 1)] - sums[live], far)
            go_left = to_left <= to_right
            gap = np.where(go_left, to_left, to_right)
            bound = self.dims * best[live].astype(np.float64)
            by_mean = gap.astype(np.float64) ** 2
            on = (gap < far) & (by_mean <= bound * (1 + 1e-12))
            live, at, go_left, by_mean, bound = live[on], np.where(go_left, l, r)[on], go_left[on], by_mean[on], bound[on]
            left[live] -= go_left
            right[live] += ~go_left
            slack = 1e-12 * (spread[live].astype(np.float64) + self.spread[at] + by_mean + 1)  # far above the rounding of the roots
            near = by_mean + (deviation[live] - self.deviation[at]) ** 2 <= bound + slack
            rows, at = live[near], at[near]
            distance = ((vectors[rows] - self.table[at]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (self.number[at] < number[rows]))
            best[rows[better]] = distance[better]
            number[rows[better]] = self.number[at[better]]
        return number, best

    def nearest_wide(self, vector: list[int]) -> tuple[int, int]:
        """The same for one vector of integers of any size."""
        own = sum(vector)
        best: tuple[int, int] | None = None
        for at in sorted(range(len(self.order)), key=lambda i: abs(own - self.sums[i])):
            if best and (own - self.sums[at]) ** 2 > self.dims * best[0]:
                break
            found = (sum((x - y) ** 2 for x, y in zip(vector, self.rows[self.order[at]], strict=True)), self.order[at])
            best = found if best is None or found < best else best
        assert best
        return best[1], best[0]


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for any finite double."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _assigned(batch: pa.RecordBatch, centroids: Centroids, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray | list, np.ndarray, np.ndarray]]:
    """Parts of a batch: (rows, integer vectors, cluster, distance)."""
    values = _vectors(batch.column(1), centroids.dims)
    plain = (np.abs(values) * scale < centroids.limit - 1).all(axis=1) & centroids.plain
    if plain.any():
        whole = np.floor(values[plain] * scale).astype(np.int64)
        yield np.flatnonzero(plain), whole, *centroids.nearest(whole)
    rows = np.flatnonzero(~plain)
    if len(rows):
        wide = [[_whole(x, scale) for x in values[i].tolist()] for i in rows.tolist()]
        found = [centroids.nearest_wide(v) for v in wide]
        yield rows, wide, np.array([c for c, _ in found]), np.array([d for _, d in found], dtype=object)


def _sums(rows: list[list[int]], scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        total = {}
        for batch in batches:
            for _, vectors, cluster, _ in _assigned(batch, centroids, scale):
                for c in np.unique(cluster).tolist():
                    mine = np.flatnonzero(cluster == c).tolist()
                    if isinstance(vectors, np.ndarray):
                        own = vectors[mine].sum(axis=0).tolist()
                    else:
                        own = [sum(column) for column in zip(*(vectors[i] for i in mine), strict=True)]
                    n, old = total.get(c, (0, [0] * centroids.dims))
                    total[c] = (n + len(mine), [x + y for x, y in zip(old, own, strict=True)])
        places = [(c, i) for c in total for i in range(centroids.dims)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in places], pa.int32()),
                pa.array([i for _, i in places], pa.int32()),
                pa.array([total[c][0] for c, _ in places], pa.int64()),
                pa.array([Decimal(total[c][1][i]) for c, i in places], pa.decimal128(38, 0)),
            ],
            names=["cluster", "place", "n", "total"],
        )

    return run


def _labels(rows: list[list[int]], scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        for batch in batches:
            for own, _, cluster, distance in _assigned(batch, centroids, scale):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMENSIONS) -> DataFrame:
    """Rows (vec_id, vector) with exactly `dims` finite components."""
    whole = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = df.where((F.size(vector_col) == dims) & whole)
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED, scale: int = SCALE) -> list[list[int]]:
    """The k vectors whose ids have the smallest SHA-256 with the seed, as integers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("key")
    found = vectors.select(key, "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return [[_whole(x, scale) for x in r["vector"]] for r in found]


def moved_centroids(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Every centroid that has vectors at the floor of their mean, the others where they are."""
    parts = vectors.mapInArrow(_sums(centroids, scale), "cluster int, place int, n bigint, total decimal(38,0)")
    sums = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = [list(row) for row in centroids]
    for r in sums.collect():  # centroids x components rows
        moved[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return moved


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    schema = "vec_id bigint, cluster int, distance bigint"
    vectors = usable_vectors(df, id_col, vector_col, dims)
    centroids = first_centroids(vectors, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved_centroids(vectors, centroids, scale)
    found = saved(vectors.mapInArrow(_labels(centroids, scale), schema), "clusters")
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = [
        (c, total, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, total in sorted(inertia.items())
    ]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
