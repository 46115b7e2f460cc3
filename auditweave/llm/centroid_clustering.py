"""Centroid clustering (Lloyd's rounds, exact in integers) with Shallot search.

A vector remembers its nearest and its second-nearest centroid, an upper bound of its distance to the
first and a lower bound of its distance to all others. When centroids have moved, the bounds are widened by
how far; only where they meet is the vector looked at. It then starts from the closer of its two
remembered centroids and walks through the others in the order of their distance from that one, while they
are within a ball: no centroid beyond (distance to the start + distance to the second best so far) can enter
the best two. The ball shrinks with each better second. Centroids in the ball are compared by exact
squared integer distances; ties go to the smaller number.

Bounds are floating-point numbers, rounded outwards, so they only ever spare exact work. The rows of a
table go through the rounds in batches of numpy arrays; centroids and their distances from each other
(centroids x centroids) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.session import durable, forget, send_with_tasks

#: Squares of differences of integers below this, summed over up to 64 components, fit 64 bits.
_NARROW = 1 << 27
#: Limits outwards, for rounding.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
_LIMB = 1 << 32
_HUGE = 10**300
#: A root that is surely not more than that of a square over 10^300.
_HUGE_ROOT = 1e150


def as_integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: in 64 bits where all are below 2^27, in Python's integers else."""
    if not values.size or np.abs(values).max() < _NARROW / scale:
        return np.floor(values * float(scale)).astype(np.int64)
    wide = np.empty(values.shape, object)
    for at, x in np.ndenumerate(values):
        top, bottom = float(x).as_integer_ratio()
        wide[at] = scale * top // bottom
    return wide


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def _root(squared: np.ndarray, beyond: float = math.inf) -> np.ndarray:
    """The root as a float; ``beyond`` for what is over 10^300."""
    if squared.dtype == object:
        return np.array([math.sqrt(v) if v < _HUGE else beyond for v in squared.ravel()], float).reshape(squared.shape)
    return np.sqrt(squared.astype(float))


class Centroids:
    """The centroids of a round, how far each has moved, and each one's others by distance."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None):
        narrow = all(abs(x) < _NARROW for p in points for x in p)
        self.points = np.array(points, np.int64 if narrow else object).reshape(len(points), -1)
        gaps = np.array([_root(_squared(self.points, p), _HUGE_ROOT) for p in self.points]).reshape(len(points), len(points))
        np.fill_diagonal(gaps, -1.0)  # itself first
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1) * _DOWN
        self.moved = np.zeros(len(points))
        if before is not None:
            steps = [sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) for p, q in zip(points, before, strict=True)]
            self.moved = _root(np.array(steps, object)) * _UP


def assign(x: np.ndarray, at: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """New ``first, second, upper, lower, distance`` of rows ``x``; distance is squared, -1 where it was not needed.

    ``first`` is -1 for rows not seen before.
    """
    k = len(at.points)
    points = at.points
    if x.dtype == object or points.dtype == object:
        x, points = x.astype(object), points.astype(object)
    first, second, upper, lower = first.copy(), second.copy(), upper.copy(), lower.copy()
    distance = np.full(len(x), -1, x.dtype)
    new = first < 0
    first[new], second[new] = 0, min(1, k - 1)
    upper = (upper + at.moved[first]) * _UP
    lower = (lower - at.moved.max(initial=0.0)) * _DOWN
    open_ = np.flatnonzero(new | ~(upper < lower))
    if not len(open_) or k == 1:
        if k == 1:
            distance = _squared(x, points[0])
        return first, second, upper, lower, distance
    # The bound of the first is made exact; this settles many rows.
    a = first[open_]
    da = _squared(x[open_], points[a])
    distance[open_], upper[open_] = da, _root(da) * _UP
    still = new[open_] | ~(upper[open_] < lower[open_])
    rows, a, da = open_[still], a[still], da[still]
    b = second[rows]
    db = _squared(x[rows], points[b])
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, reach = a.copy(), _root(da)
    walking = np.arange(len(rows))
    for step in range(1, k):
        # Others come in order of their distance from the start, so the first one outside ends the walk.
        walking = walking[at.gaps[start[walking], step] <= (reach[walking] + _root(db[walking])) * _UP]
        if not len(walking):
            break
        c = at.order[start[walking], step]
        fresh = (c != a[walking]) & (c != b[walking])
        w, c = walking[fresh], c[fresh]
        d = _squared(x[rows[w]], points[c])
        best = (d < da[w]) | ((d == da[w]) & (c < a[w]))
        next_best = ~best & ((d < db[w]) | ((d == db[w]) & (c < b[w])))
        i = w[best]
        b[i], db[i], a[i], da[i] = a[i], da[i], c[best], d[best]
        j = w[next_best]
        b[j], db[j] = c[next_best], d[next_best]
    first[rows], second[rows], distance[rows] = a, b, da
    upper[rows], lower[rows] = _root(da) * _UP, _root(db, _HUGE_ROOT) * _DOWN
    return first, second, upper, lower, distance


_STATE = "first int, second int, upper double, lower double"


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _assigned(at: Centroids, width: int, scale: int, last: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_integers(_matrix(batch, width), scale)
            state = [batch.column(c).to_numpy() for c in ("first", "second", "upper", "lower")]
            first, second, upper, lower, distance = assign(x, at, *state)
            if not last:
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "vector": batch.column("vector"), "first": pa.array(first), "second": pa.array(second),
                                       "upper": pa.array(upper), "lower": pa.array(lower)})
                continue
            points = at.points.astype(object) if x.dtype == object else at.points
            distance = np.where(distance < 0, _squared(x, points[first]), distance)
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(first), "distance": pa.array(fits, pa.int64())})

    return work


def _sums(width: int, scale: int):
    """Per task: ``cluster, place, limb, total``; place -1 counts rows, a sum of any size goes in limbs of 32 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = as_integers(_matrix(batch, width), scale)
            first = batch.column("first").to_numpy()
            for c in np.unique(first).tolist():
                own = x[first == c]
                total[c] = total.get(c, 0) + np.append(own.sum(0).astype(object), len(own))
        out = []
        for c, sums in total.items():
            for place, value in enumerate(sums.tolist()):
                sign, value, limb = (-1 if value < 0 else 1), abs(int(value)), 0
                while value or not limb:
                    value, low = divmod(value, _LIMB)
                    out.append((c, place if place < width else -1, limb, sign * low))
                    limb += 1
        yield pa.record_batch([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                              names=["cluster", "place", "limb", "total"])

    return work


def _moved(rows: DataFrame, points: list[list[int]], width: int, scale: int) -> list[list[int]]:
    """Every centroid with rows becomes their mean, rounded down; clusters x components numbers come to the driver."""
    partial = rows.select("vector", "first").mapInArrow(_sums(width, scale), "cluster int, place int, limb int, total bigint")
    exact: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("cluster", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        key = (r["cluster"], r["place"])
        exact[key] = exact.get(key, 0) + int(r["total"]) * _LIMB ** r["limb"]
    return [[exact[c, i] // exact[c, -1] for i in range(width)] if exact.get((c, -1)) else p for c, p in enumerate(points)]


def _starts(kept: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors of least hash of ``seed:vec_id``; equal ids by their components, NULL ids last."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("vec_id", "vector", named.alias("h")).orderBy(F.asc_nulls_last("h"), "vector").limit(clusters).collect()
    return [[int(v) for v in as_integers(np.array(r["vector"], float), scale)] for r in first]


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector kept.

    ``vectors``: vec_id, embedding (an array of numbers), any more. Kept are vectors of exactly ``width``
    components, all finite; their components become floor(``scale`` * x). Each of ``rounds`` rounds assigns
    all vectors and moves each centroid that has some to their mean, rounded down. distance is the squared
    distance to the final centroid, inertia its sum; a figure over 2^63 - 1 is NULL (components from 2^27 on
    are reckoned in Python's integers).

    NULL embedding, NULL or non-finite components, another length: no row. NULL vec_id: kept, last in the
    choice of starts. Repeated rows: rows of their own; equal ids: ordered by their components. Fewer vectors than
    ``clusters``: as many clusters as vectors. Empty table: no row. ``width`` is 64 at most.
    """
    if not 0 < width <= 64:
        raise ValueError("width must be from 1 to 64")
    send_with_tasks("auditweave.llm.centroid_clustering")
    held = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    vector = F.col("embedding").cast(held)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", vector.alias("vector")).where((F.size("vector") == width) & ~bad)
    fresh = (F.lit(-1).alias("first"), F.lit(-1).alias("second"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    rows = durable(kept.select("vec_id", "vector", *fresh))
    points, before = _starts(rows, clusters, seed, scale), None
    if not points:
        empty = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, {empty}")
    kind = f"vec_id {dict(vectors.dtypes)['vec_id']}"
    for _ in range(rounds):
        done = durable(rows.mapInArrow(_assigned(Centroids(points, before), width, scale, False), f"{kind}, vector {held}, {_STATE}"))
        forget(rows)  # the next table is written, nothing reads this one again
        rows, before = done, points
        points = _moved(rows, points, width, scale)
    final = durable(rows.mapInArrow(_assigned(Centroids(points, before), width, scale, True), f"{kind}, cluster int, distance bigint"))
    forget(rows)
    return _reported(final, points)


def _reported(final: DataFrame, points: list[list[int]]) -> DataFrame:
    """Add the sums and the centroid's digest: one row per cluster, sent to all tasks."""
    spark = final.sparkSession
    wide = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(wide.alias("s")).collect()}
    everything = None if None in sums.values() else sum(sums.values())

    def fits(value) -> int | None:
        return int(value) if value is not None and value < 1 << 63 else None

    told = [(c, fits(sums[c]), fits(everything), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c in sorted(sums)]
    rows = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return final.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
