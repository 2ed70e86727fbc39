"""Centroid clustering of vectors, nearest centroids by equal-average equal-variance search.

Centroids are sorted by the mean of their components. A vector is compared outward from its own
mean: no centroid farther off in the mean than the best distance so far allows can be nearer, nor
can one whose deviation differs too much, so most are rejected by two numbers. Those that remain
are compared exactly, in integers.

Components are integers, ``floor(64 * x)``, and centroids are exact floors of means, so the
result does not depend on the order in which sums are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 64  # components of a vector
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Components beyond this count as this, so that every distance fits into 64 bits.
LARGEST = 1 << 27
_ROWS = 4096  # vectors compared at a time


def _usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def usable_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE
) -> DataFrame:
    """``key`` and ``vector`` (as doubles) of the rows whose vector has ``size`` components, none
    of them NULL, NaN or infinite."""
    found = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    kept = found.where(_usable(F.col("vector"), size))
    return kept.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))


def as_integers(column: pa.Array, size: int = SIZE) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):  # what overflows is cut to LARGEST
        scaled = np.floor(values * float(SCALE))
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64).reshape(-1, size)


@dataclass(frozen=True)
class _Spread:
    """Sums, and roots of the summed squared deviations, of the rows of a matrix."""

    sums: np.ndarray
    deviations: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> "_Spread":
        sums = rows.sum(axis=1)
        centred = rows - (sums / rows.shape[1])[:, None]
        return _Spread(sums.astype(float), np.sqrt((centred * centred).sum(axis=1)))


class Centroids:
    """Centroids, numbered by their rows, ready to be searched."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        spread = _Spread.of(rows)
        self.order = np.argsort(spread.sums, kind="stable")
        self.sums = spread.sums[self.order]
        self.deviations = spread.deviations[self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the number of its nearest centroid, of equal ones the smallest, and the
        squared distance."""
        parts = [
            self._nearest(vectors[at : at + _ROWS]) for at in range(0, len(vectors), _ROWS)
        ]
        numbers, distances = zip(*parts) if parts else ((), ())
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *numbers]), np.concatenate([empty, *distances])

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = vectors.shape
        count = len(self.order)
        spread = _Spread.of(vectors)
        number = np.full(n, count, np.int64)
        best = np.full(n, np.iinfo(np.int64).max)
        above = np.searchsorted(self.sums, spread.sums)  # the next centroid upward
        below = above - 1
        active = np.arange(n)
        # NaN-free gaps: beyond either end of the centroids everything is infinitely far.
        sums = np.concatenate(([-np.inf], self.sums, [np.inf]))
        while len(active):
            own = spread.sums[active]
            up, down = sums[above[active] + 1] - own, own - sums[below[active] + 1]
            upward = up <= down
            gap = np.where(upward, up, down)
            # The squared distance is at least size * (difference of means) ** 2, which is
            # gap ** 2 / size; all further centroids have a gap no smaller.
            limit = best[active].astype(float) * size
            going = gap * gap <= limit
            active, upward, gap, limit = active[going], upward[going], gap[going], limit[going]
            place = np.where(upward, above[active], below[active])
            above[active] += upward
            below[active] -= ~upward
            # The deviations add their part. Their rounding errors must not reject a centroid.
            theirs, ours = self.deviations[place], spread.deviations[active]
            apart = np.maximum(np.abs(theirs - ours) - 1e-9 * (theirs + ours), 0.0)
            near = gap * gap + size * (apart * apart) <= limit
            rows, place = active[near], self.order[place[near]]
            apart = vectors[rows] - self.rows[place]
            distance = np.einsum("ij,ij->i", apart, apart)
            better = (distance < best[rows]) | ((distance == best[rows]) & (place < number[rows]))
            best[rows[better]] = distance[better]
            number[rows[better]] = place[better]
        return number, best


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, size: int = SIZE) -> np.ndarray:
    """The vectors whose id, hashed as ``1:<id>``, comes first; a NULL id comes last, equal ids by
    their vectors. Fewer vectors than ``clusters`` are all taken."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(clusters).select("vector")
    return as_integers(chosen.toArrow().column(0).combine_chunks(), size)


def _sums(vectors: DataFrame, centroids: Centroids, size: int) -> DataFrame:
    """Of every centroid its number, how many vectors are nearest to it, and their sums; added up
    in every task first."""
    fields = ", ".join(f"s{i} long" for i in range(size))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids.rows), np.int64)
        sums = np.zeros(centroids.rows.shape, np.int64)
        for batch in batches:
            rows = as_integers(batch.column(0), size)
            numbers, _ = centroids.nearest(rows)
            counts += np.bincount(numbers, minlength=len(counts))
            np.add.at(sums, numbers, rows)
        yield pa.record_batch(
            [pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts), *map(pa.array, sums.T)],
            names=["cluster", "n", *(f"s{i}" for i in range(size))],
        )

    parts = vectors.select("vector").mapInArrow(add, f"cluster int, n long, {fields}")
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(size))
    )


def fit_centroids(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE
) -> np.ndarray:
    """Centroids after ``rounds`` of assigning all vectors and replacing each centroid that has
    some by the floor of their mean; no vectors give no centroids.

    The driver holds the centroids alone: ``clusters`` rows come back from every round.
    """
    rows = first_centroids(vectors, clusters, size)
    for _ in range(rounds if len(rows) else 0):
        rows = rows.copy()
        for found in _sums(vectors, Centroids(rows), size).where("n > 0").collect():
            rows[found.cluster] = [found[f"s{i}"] // found.n for i in range(size)]
    return rows


def assigned(vectors: DataFrame, centroids: np.ndarray, size: int = SIZE) -> DataFrame:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of every vector."""
    searched = Centroids(centroids)

    @F.arrow_udf("cluster int, distance long")
    def nearest(column: pa.Array) -> pa.Array:
        numbers, distances = searched.nearest(as_integers(column, size))
        return pa.StructArray.from_arrays(
            [pa.array(numbers.astype(np.int32)), pa.array(distances)], ["cluster", "distance"]
        )

    return vectors.select("vec_id", nearest("vector").alias("found")).select("vec_id", "found.*")


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def cluster_vectors(
    table: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    key: str = "vec_id",
    vector: str = "embedding",
    size: int = SIZE,
) -> DataFrame:
    """Every usable vector with its cluster, the squared distance to its centroid, the distances
    summed over the cluster (``cluster_inertia``) and over all (``inertia``), and the digest of
    the centroid.

    Other rows are left out. Repeated rows count as often as they come; an empty table gives no
    rows; other columns of the table are not read. The input is read once for every round and
    twice for the result, and nothing but sums of a task is shuffled, so no cluster is too large.
    """
    vectors = usable_vectors(table, key, vector, size)
    centroids = fit_centroids(vectors, clusters, rounds, size)
    found = assigned(vectors, centroids, size)
    spark = table.sparkSession
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    digests = centroid_digests(centroids)
    total = sum(r.cluster_inertia for r in sums)
    of_cluster = spark.createDataFrame(
        [(r.cluster, r.cluster_inertia, total, digests[r.cluster]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # A row for every cluster, of which there are ``clusters`` at most.
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", *found.columns[1:], *of_cluster.columns[1:])
