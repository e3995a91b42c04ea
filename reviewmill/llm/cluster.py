"""Exact centroid clustering of whole-number vectors, with bounds that spare most scans.

Every vector keeps an upper bound of the distance to its own centroid and a
lower bound of that to all others.  Centroids move between rounds.  The vectors of a cluster lie in a
sphere around its old centroid; how much nearer a moved centroid can have come to any of
them is a question in the plane through the centre of the sphere and the two places of that centroid, and
its answer is less than the whole drift unless the centroid moved straight
towards the sphere.  The lower bounds give way by that much only.  Vectors whose bounds then overlap are
ambiguous and are scanned exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.sources import files

#: Whole numbers of this size or more would overflow a squared distance.
LIMIT = 1 << 27
#: Up to this size squared distances are exact in doubles.
_EXACT = 1 << 21
_ARCS = 64
#: By how much rounding may have moved a bound, of its size and at least.
_SLACK = 1e-9


def drift(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray, arcs: int = _ARCS) -> float:
    """By how much the distance from `old` can exceed that from `new`, for any point of a sphere.

    In the plane through the three points let h run along the move, from its middle, and q
    be the distance from its line.  The difference of distances grows with h; it falls
    with q where h is above 0 and grows with it below.  So its maximum lies on the rim of
    the disk, and each arc of the rim is bounded by the corner of its box that is worst.
    """
    move = new - old
    length = float(np.sqrt((move * move).sum()))
    if length == 0:
        return 0.0
    from_middle = centre - (old + new) / 2
    h0 = float(from_middle @ move) / length
    q0 = float(np.sqrt(max(0.0, float(from_middle @ from_middle) - h0 * h0)))
    turns = np.linspace(0, 2 * np.pi, arcs + 1)
    h, q = h0 + radius * np.cos(turns), q0 + radius * np.sin(turns)
    # A quarter turn is a whole number of arcs, so on each arc both are monotone.
    h = np.maximum(h[:-1], h[1:])
    low, high = np.minimum(q[:-1], q[1:]), np.maximum(q[:-1], q[1:])
    low = np.where((low < 0) & (high > 0), 0.0, np.minimum(np.abs(low), np.abs(high)))
    high = np.maximum(np.abs(q[:-1]), np.abs(q[1:]))
    q = np.where(h > 0, low, high)
    gain = np.hypot(h + length / 2, q) - np.hypot(h - length / 2, q)
    return float(min(gain.max(), length))


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any other centroid can have come nearer to a vector of it."""
    old, new = old.astype(float), new.astype(float)
    out = np.full(len(old), -np.inf)
    for i in range(len(old)):
        for j in range(len(old)):
            if i != j:
                out[i] = max(out[i], drift(old[i], radii[i], old[j], new[j]))
    return np.where(np.isfinite(out), out, 0.0)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points from all centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def own_squared(points: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point from the centroid of its cluster."""
    off = points - centroids[cluster]
    return (off * off).sum(1)


@dataclass(frozen=True)
class Move:
    """What a round needs to know: the centroids, and how the last move changes the bounds of each cluster."""

    centroids: np.ndarray
    moved: np.ndarray | None = None
    loosened: np.ndarray | None = None

    def assign(self, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray,
               lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroid of each point, new bounds, and how many points were scanned."""
        if self.moved is None:
            unsure = np.arange(len(points))
            cluster, upper, lower = (np.zeros(len(points), t) for t in (np.int64, float, float))
        else:
            upper = (upper + self.moved[cluster]) * (1 + _SLACK)
            lower = (lower - self.loosened[cluster]) - _SLACK * (1 + np.abs(lower))
            unsure = np.flatnonzero(upper + _SLACK >= lower)
            tight = np.sqrt(own_squared(points[unsure], self.centroids, cluster[unsure]).astype(float))
            upper[unsure] = tight * (1 + _SLACK)
            unsure = unsure[upper[unsure] + _SLACK >= lower[unsure]]
        if len(unsure):
            found = squared(points[unsure], self.centroids)
            best = found.argmin(axis=1)  # the first of equals
            rows = np.arange(len(unsure))
            cluster[unsure], upper[unsure] = best, np.sqrt(found[rows, best].astype(float)) * (1 + _SLACK)
            found[rows, best] = np.iinfo(np.int64).max
            lower[unsure] = np.sqrt(found.min(axis=1).astype(float)) * (1 - _SLACK)
        return cluster, upper, lower, len(unsure)


def _points(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def whole(vector: Column, scale: int) -> Column:
    """Components times `scale`, rounded down; a component too large for exact distances is an error."""
    def component(x: Column) -> Column:
        number = F.floor(F.lit(float(scale)) * x.cast("double"))
        far = F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("bigint")
        return F.when(F.abs(number) < LIMIT, number).otherwise(far)
    return F.transform(vector, component)


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly `size` components, none missing or not finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, finite), F.lit(False))


def _assigned(state: DataFrame, move: Move, id_col: str, size: int) -> DataFrame:
    held = state.sparkSession.sparkContext.broadcast(move)

    def run(batch: pa.RecordBatch) -> dict:
        known = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4))
        cluster, upper, lower, scanned = held.value.assign(_points(batch.column(1), size), *known)
        marks = np.zeros(batch.num_rows, np.int64)
        marks[:1] = scanned
        return {id_col: batch.column(0), "point": batch.column(1), "cluster": pa.array(cluster),
                "upper": pa.array(upper), "lower": pa.array(lower), "scanned": pa.array(marks)}

    schema = common.struct(
        (id_col, common.id_type(state, id_col)), ("point", "array<bigint>"), ("cluster", "bigint"),
        ("upper", "double"), ("lower", "double"), ("scanned", "bigint"))
    columns = (id_col, "point", "cluster", "upper", "lower")
    return common.staged(common.map_rows(state.select(*columns), schema, run), "assigned-vectors")


def _sums(state: DataFrame, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and number of the vectors of each cluster, and the largest upper bound; a row for each of a task's clusters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, far = np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int64), np.zeros(clusters)
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            own = np.bincount(cluster, minlength=clusters)
            some = np.flatnonzero(own)
            if len(some):
                starts = (np.cumsum(own) - own)[some]
                total[some] += np.add.reduceat(_points(batch.column(0), size)[order], starts)
            n += own
            np.maximum.at(far, cluster, batch.column(2).to_numpy())
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(n[met]), pa.array(far[met]),
             pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "n", "far", "total"])

    parts = state.select("point", "cluster", "upper").mapInArrow(
        run, "cluster bigint, n bigint, far double, total array<bigint>")
    rows = parts.select("cluster", "n", "far", F.posexplode("total").alias("place", "part")).groupBy(
        "cluster", "place").agg(F.sum("part").alias("total"), F.sum("n").alias("n"), F.max("far").alias("far"))
    total, n, far = np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int64), np.zeros(clusters)
    for r in rows.collect():  # at most clusters x size
        total[r["cluster"], r["place"]], n[r["cluster"]], far[r["cluster"]] = r["total"], r["n"], r["far"]
    return total, n, far


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256,
            seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, point) of every usable vector.

    The first centroids are the vectors with the smallest SHA-256 of `seed:id`, ties the smaller
    vector.  Each round assigns all vectors, ties to the smaller number, and moves the
    centroids to the floored means; a last assignment follows.  Distances are squared and exact.
    Vectors that are missing, of another size, or with a missing or non-finite
    component are left out.  Fewer vectors than `clusters` make fewer clusters, none an empty table.  Repeated
    rows count as they come; a missing id counts as no text.  Other columns do not matter.
    Vectors are never shuffled; the driver sees the centroids and one sum for each of their components.
    """
    kept = vectors.select(F.col(id_col), F.col(vector_col).alias("_vector")).where(usable(F.col("_vector"), size))
    state = kept.select(
        id_col, whole(F.col("_vector"), scale).alias("point"), F.lit(0).cast("bigint").alias("cluster"),
        F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    first = state.orderBy(digest, "point").limit(clusters).select("point").collect()
    names = (id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "point")
    if not first:
        return state.select(id_col, "cluster", *(F.lit(0).cast("bigint").alias(c) for c in names[2:5]),
                            F.lit("").alias("centroid_sha256"), "point")
    move = Move(np.array([r["point"] for r in first], np.int64))
    state = _assigned(state, move, id_col, size)
    for _ in range(rounds):
        total, n, far = _sums(state, len(first), size)
        old = move.centroids
        new = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], old)
        moved = np.sqrt(((new - old).astype(float) ** 2).sum(1))
        move = Move(new, moved, loosening(old, new, far))
        last, state = state, _assigned(state, move, id_col, size)
        files.drop_staged(state.sparkSession, last)
    centroids = move.centroids
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = state.sparkSession.createDataFrame(
        [(k, d, c) for k, (d, c) in enumerate(zip(digests, centroids.tolist()))],
        "cluster bigint, centroid_sha256 string, centroid array<bigint>")
    apart = F.zip_with("point", "centroid", lambda x, c: (x - c) * (x - c))
    found = state.join(F.broadcast(table), "cluster").withColumn(
        "distance", F.aggregate(apart, F.lit(0).cast("bigint"), lambda a, x: a + x))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    sums = state.sparkSession.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in inertia)) for r in inertia],
        "cluster bigint, cluster_inertia bigint, inertia bigint")
    return found.join(F.broadcast(sums), "cluster").select(*names)
