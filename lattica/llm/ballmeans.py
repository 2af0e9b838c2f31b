"""Centroid clustering by ball k-means, exact in whole numbers.

A cluster is a ball: its centroid and the largest distance of a member. Another centroid matters to a ball only if half the way
to it is no longer than the radius. A member nearer than half the way to the nearest such neighbour is in the stable core and stays
without a comparison; the others lie in annuli, the m-th of which meets the m nearest neighbours only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_staged, stage

#: Scaled components stay below this in magnitude, so that four times a squared distance of 64 components fits in a long.
REACH = 1 << 26
STATE = "id long, cluster int, distance long, v binary, sums array<long>, n long, reach long"


class Balls:
    """Centroids as rows of whole numbers, for each the others in order of distance, and which clusters keep their members unseen."""

    def __init__(self, centroids: list[list[int]], before: Balls | None = None, reach: dict[int, int] | None = None):
        self.at = np.array(centroids, np.int64)
        gaps = self.at[:, None] - self.at[None]
        self.gap = (gaps * gaps).sum(axis=2)
        self.others = [[j for j in np.argsort(g, kind="stable").tolist() if j != i] for i, g in enumerate(self.gap)]
        k = len(centroids)
        self.still = np.zeros(k, bool)
        if before is not None:
            moved = (self.at != before.at).any(axis=1)
            for i in range(k):  # a neighbour that moved may take members; one beyond twice the radius can't
                near = self.gap[i] <= 4 * (reach or {}).get(i, 0)
                near[i] = True
                self.still[i] = not (moved & near).any()

    def distance(self, v: np.ndarray, k: int) -> np.ndarray:
        d = v - self.at[k]
        return np.einsum("ij,ij->i", d, d)

    def assign(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of every row and the squared distance; ties go to the smaller number. cluster -1: not in a ball yet."""
        cluster, distance = cluster.copy(), distance.copy()
        new = np.flatnonzero(cluster < 0)
        if len(new):
            every = np.stack([self.distance(v[new], k) for k in range(len(self.at))])
            cluster[new] = every.argmin(axis=0)
            distance[new] = every.min(axis=0)
        held = cluster.copy()
        held[new] = -1
        for i in range(len(self.at)):
            rows = np.flatnonzero(held == i)
            if not len(rows) or self.still[i]:
                continue
            own = self.distance(v[rows], i)
            best, to = own.copy(), np.full(len(rows), i)
            radius = int(own.max())
            near = [j for j in self.others[i] if self.gap[i, j] <= 4 * radius]
            annulus = np.searchsorted(self.gap[i, near], 4 * own, side="right")  # 0: the core
            for m, j in enumerate(near):
                outer = np.flatnonzero(annulus > m)
                d = self.distance(v[rows[outer]], j)
                wins = (d < best[outer]) | ((d == best[outer]) & (j < to[outer]))
                best[outer[wins]], to[outer[wins]] = d[wins], j
            cluster[rows], distance[rows] = to, best
        return cluster, distance


def _whole(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors of `dims` finite components as packed 32-bit whole numbers; v is null where one is out of range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fit = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy() == dims)
            x = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            finite = np.isfinite(x).all(axis=1)
            fit, x = fit[finite], x[finite]
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            inside = (np.abs(x) < REACH).all(axis=1)
            packed = np.where(inside[:, None], x, 0).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit)), pa.array([r.tobytes() if ok else None for r, ok in zip(packed, inside, strict=True)], pa.binary())], names=["id", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")


def _round(state: DataFrame, balls: Balls, dims: int) -> DataFrame:
    """Every row with its nearest centroid. In each batch one row of a cluster carries the cluster's sums, count and largest distance there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            cluster, distance = balls.assign(v, batch.column(1).to_numpy(), batch.column(2).to_numpy())
            sums, n, reach = ([None] * len(v) for _ in range(3))
            for k in np.unique(cluster):
                rows = np.flatnonzero(cluster == k)
                sums[rows[0]], n[rows[0]], reach[rows[0]] = v[rows].sum(axis=0), len(rows), int(distance[rows].max())
            columns = [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), batch.column(3), pa.array(sums, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(reach, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "v", "sums", "n", "reach"])

    return state.select("id", "cluster", "distance", "v").mapInArrow(run, STATE)


def ball_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, tag: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id_col, cluster, distance) of every vector with exactly `dims` finite components, and the final centroids.

    A component x becomes floor(scale * x). The first centroids are the k vectors with the smallest sha256 of tag and id; of repeated
    ids the smallest vector goes first, null ids go last. Each of `rounds` rounds assigns all vectors and moves every
    centroid that has members to the floor of their mean; then vectors are assigned once more. Equal vectors share a cluster. With fewer vectors
    than k there are fewer centroids; without any the result is empty. A vector with a component of 2**26 or more in magnitude after
    scaling has no squared distance that is sure to fit in a long: it comes back with null cluster and distance and moves nothing. Other columns
    are left out.

    A round reads the vectors once and shuffles nothing but sums, of which the driver gets k * dims.
    """
    whole = stage(_whole(vectors, dims, scale, id_col, vec_col))
    state = whole.where("v is not null").select("id", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), "v")
    order = F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 256)
    seeds = state.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    out = whole.where("v is null").select(F.col("id").alias(id_col), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    if not seeds:
        return out, []
    balls = Balls([np.frombuffer(r["v"], "<i4").tolist() for r in seeds])
    for left in range(rounds, -1, -1):
        done = stage(_round(state, balls, dims))
        drop_staged(state)
        state = done
        if not left:
            break
        parts = state.where("sums is not null").select("cluster", "n", "reach", F.posexplode("sums").alias("p", "s"))
        found = parts.groupBy("cluster", "p").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("reach").alias("reach")).collect()  # k * dims rows
        centroids, reach = balls.at.tolist(), {}
        for r in found:
            centroids[r["cluster"]][r["p"]] = r["s"] // r["n"]
            reach[r["cluster"]] = r["reach"]
        balls = Balls(centroids, balls, reach)
    return state.select(F.col("id").alias(id_col), "cluster", "distance").union(out), balls.at.tolist()
