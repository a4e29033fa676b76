"""Exact centroid clustering of integer vectors with bounds, by a Shallot search.

A vector keeps its centroid, the second-nearest one, an upper bound of the distance to the
first and a lower bound of the distance to all others. When the centroids move, the bounds
move with them, and a vector whose upper bound stays below the lower one (or below half the
way to the nearest other centroid) keeps its centroid unseen. The others are measured
against their two remembered centroids; the search starts at the closer one and looks at its
neighbours in the order of their distance from it. Only neighbours inside the ball
whose radius is the way to the start plus that to the second-best centroid so far can be among
the two nearest, so the ball shrinks while the search goes on. Those inside it are
compared by exact squared integer distances; bounds are floating point with a margin, and an
equal one never skips a vector.

The state of a round is written to the shared folder beside the vectors. Sums of a cluster are
aggregates with map-side combine, so a cluster with most of the rows sends one row a task; only
centroids (``k`` times the dimensions) reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import staged
from panelmark.session import constant

#: Scaled components below this leave squared distances of 64 dimensions within 64 bits.
WIDEST = 1 << 27
#: Share by which floating-point bounds are widened.
MARGIN = 1e-9
STATE = "id long, point array<int>, near int, second int, upper double, lower double, distance long"
RESULT = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _scaled(x: Column, scale: int) -> Column:
    wide = x.cast("double") * scale
    return F.when(F.abs(wide) < WIDEST, F.floor(wide).cast("int")).otherwise(
        F.raise_error(F.lit(f"a vector component times {scale} is beyond {WIDEST}: its squared distances may not fit 64 bits")).cast("int")
    )


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, point) of the vectors with exactly ``dims`` components, all of them finite."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
    sound = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.col("vector").isNotNull() & (F.size("vector") == dims) & sound
    return rows.filter(whole).select("id", F.transform("vector", lambda x: _scaled(x, scale)).alias("point"))


def _ways(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours of each centroid by distance, these distances, half the least of them)."""
    gaps = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
    np.fill_diagonal(gaps, -1.0)
    order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(gaps, order, axis=1)
    half = gaps[:, 0] / 2 if gaps.shape[1] else np.full(len(centroids), np.inf)
    return order, gaps, half


def _squared(points: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    apart = points - centroids[which]
    return np.einsum("ij,ij->i", apart, apart)


def shallot(points: np.ndarray, centroids: np.ndarray, ways: tuple, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nearest, second, squared distance of each) of every point, begun at two centroids it knows."""
    order, gaps, _half = ways
    d1, d2 = _squared(points, centroids, one), _squared(points, centroids, other)
    swap = (d2 < d1) | ((d2 == d1) & (other < one))
    one, other, d1, d2 = np.where(swap, other, one), np.where(swap, one, other), np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known, reach = one, other, np.sqrt(d1.astype(np.float64))
    best, second = one.copy(), other.copy()
    at = np.arange(len(points))
    for step in range(order.shape[1]):
        ball = (reach[at] + np.sqrt(d2[at].astype(np.float64))) * (1 + MARGIN)
        at = at[gaps[start[at], step] <= ball]  # distances only grow from here, and balls only shrink
        if not len(at):
            break
        mate = order[start[at], step]
        rows, mate = at[mate != known[at]], mate[mate != known[at]]
        d = _squared(points[rows], centroids, mate)
        first = (d < d1[rows]) | ((d == d1[rows]) & (mate < best[rows]))
        next_ = ~first & ((d < d2[rows]) | ((d == d2[rows]) & (mate < second[rows])))
        a, b = rows[first], rows[next_]
        second[a], d2[a] = best[a], d1[a]
        best[a], d1[a] = mate[first], d[first]
        second[b], d2[b] = mate[next_], d[next_]
    return best, second, d1, d2


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, exact: bool) -> DataFrame:
    """The next state: every vector with its nearest of ``centroids``, which moved by
    ``moved`` since the last one. ``exact`` asks for the squared distance of all vectors."""
    k = len(centroids)
    ways = _ways(centroids)
    farthest = np.argsort(-moved, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            points = np.asarray(batch.column("point").flatten()).astype(np.int64).reshape(n, centroids.shape[1])
            near, second = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("near", "second"))
            upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
            distance = np.full(n, -1, np.int64)
            upper += moved[near] * (1 + MARGIN)
            lower -= moved[np.where(near == farthest[0], farthest[1 % k], farthest[0])] * (1 + MARGIN)
            bound = np.maximum(lower, ways[2][near]) * (1 - MARGIN)
            at = np.flatnonzero(upper * (1 + MARGIN) >= bound) if k > 1 else np.zeros(0, np.int64)
            distance[at] = _squared(points[at], centroids, near[at])
            upper[at] = np.sqrt(distance[at].astype(np.float64))
            at = at[upper[at] * (1 + MARGIN) >= bound[at]]
            if len(at):
                near[at], second[at], d1, d2 = shallot(points[at], centroids, ways, near[at], second[at])
                distance[at], upper[at], lower[at] = d1, np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
            if exact:
                rest = np.flatnonzero(distance < 0)
                distance[rest] = _squared(points[rest], centroids, near[rest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("point"), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance)],
                ["id", "point", "near", "second", "upper", "lower", "distance"],
            )

    return state.mapInArrow(run, STATE)


def _first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    rows = points.select(F.sha2(name, 256).alias("mark"), "point").orderBy("mark", "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a centroid without vectors stays."""
    dims = centroids.shape[1]
    sums = state.groupBy("near").agg(F.count("*").alias("n"), *(F.sum(F.col("point")[i].cast("long")).alias(f"s{i}") for i in range(dims)))
    out = centroids.copy()
    for row in sums.collect():  # one row a centroid
        out[row.near] = [row[f"s{i}"] // row.n for i in range(dims)]
    return out


def clustered(df: DataFrame, id_col: str, vec_col: str, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each kept vector.

    Vectors without exactly ``dims`` components, or with a null or non-finite one, are left out.
    Components are taken as floor(``scale`` * x); one beyond 2**27 ends the job with an
    error, since its distances may not fit a long. The first centroids are the vectors with the
    smallest SHA-256 of ``seed:id`` (null as "null"; of one id by components); with fewer than
    ``k`` vectors there are fewer centroids. Ties go to the smaller number. Rows repeated under
    an id are vectors like any other. No vectors give no rows.
    """
    spark = df.sparkSession
    points = staged(integer_vectors(df, id_col, vec_col, dims, scale), "cluster-points")
    centroids = _first_centroids(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    begin = {"near": F.lit(0), "second": F.lit(min(1, len(centroids) - 1)), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}
    state, moved = points.select("id", "point", *(v.alias(c) for c, v in begin.items())), np.zeros(len(centroids))
    for turn in range(rounds + 1):
        state = staged(assigned(state, centroids, moved, exact=turn == rounds), "cluster-state")
        if turn < rounds:
            after = _moved(state, centroids)
            moved = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64))
            centroids = after
    inertia = {r.near: r.total for r in state.groupBy("near").agg(F.sum("distance").alias("total")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = constant(
        spark, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
        [(c, inertia[c], sum(inertia.values()), marks[c]) for c in sorted(inertia)],
    )
    return state.withColumnRenamed("near", "cluster").join(about, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
