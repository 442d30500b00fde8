"""Operator 11: k-means over integer vectors with Yinyang bounds.

Centroids are put into groups once, by a small k-means over the first centroids.
Every vector keeps its cluster, an upper bound of the distance to its centroid and
one lower bound a group of the distance to any other centroid of it.  When centroids
have moved, the upper bound grows by its own centroid's way, each lower bound shrinks
by the longest way in its group, and

1. a vector whose upper bound is below all its lower bounds stays (global filter),
   first with the bound as it is, then with its exact distance;
2. of the others only groups whose lower bound is not above the distance are looked
   at (group filter);
3. the centroids of these groups are scanned exactly.

Distances are exact integers; bounds are floats with room for rounding, and a bound
that only equals is no reason to skip, so ties go to the smaller number as in a full
scan.  A centroid becomes the componentwise floor(sum / count) of its vectors, from
sums that are kept and changed by the vectors that moved; an empty one stays.

Each round reads a table of vectors with clusters and bounds and writes the next one
in the shared folder, a scan without shuffle; sums are added up a task and component
before they are shuffled.  What reaches the driver are ``k`` centroids and sums.

Vectors with another number of components than ``dims``, or with null or non-finite
ones, are left out.  A component x becomes floor(scale * x), held within +-2**27, so
that distances fit a long; an inertia that doesn't is null.  Rows with equal vec_id are
vectors of their own; as first centroids they go by their components, and rows without
vec_id come last.  With fewer than ``k`` vectors each is a first centroid.  Columns
other than vec_id and embedding aren't read, whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import discard, prepare, written

#: Components lie within this; squared differences of 64 of them fit a long.
LIMIT = 1 << 27
#: Up to this, distances by a matrix product of doubles are exact.
EXACT = 1 << 21
STATE = "vec_id long, q array<int>, cluster int, was int, upper double, lower array<double>"


def integers(vectors: DataFrame, dims: int, scale: int = 64) -> DataFrame:
    """vec_id and q, the integer components, of the vectors that count."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = F.transform(x, lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(scale * c.cast("double")).cast("double"))).cast("int"))
    return vectors.filter((F.size(x) == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("q"))


def first_centroids(kept: DataFrame, k: int, prefix: str = "1:") -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``prefix`` and vec_id."""
    order = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: k-means over the centroids, begun with evenly spaced ones; numbers without gaps."""
    x = centroids.astype(np.float64)
    middle = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)]
    for _ in range(rounds):
        own = ((x[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.stack([x[own == g].mean(axis=0) if (own == g).any() else middle[g] for g in range(len(middle))])
    return np.unique(own, return_inverse=True)[1]


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``q`` to each row of ``c``."""
    if not len(q) or max(np.abs(q).max(), np.abs(c).max()) <= EXACT:
        a, b = q.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((q - x) ** 2).sum(axis=1) for x in c], axis=1)


def _own(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``q`` to the same row of ``c``."""
    return ((q - c) ** 2).sum(axis=1)


def _below(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Where a lower bound is surely above the upper bound, whatever was rounded."""
    return lower > upper * (1 + 1e-9) + 1e-6


def assign_all(q: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bounds, lower bounds of each group) by a full scan."""
    d = squared(q, c)
    cluster = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(q)), cluster])
    others = np.sqrt(d)
    others[np.arange(len(q)), cluster] = np.inf
    return cluster, upper, np.stack([others[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)


def assign_moved(q, c, group, cluster, upper, lower, moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the last round's, after centroids have moved by ``moved``; also the number of distances computed."""
    cluster, upper = cluster.copy(), upper + moved[cluster]
    lower = lower - np.array([moved[group == g].max() for g in range(group.max() + 1)])
    rows = np.flatnonzero(~_below(lower.min(axis=1), upper))
    own = _own(q[rows], c[cluster[rows]])
    upper[rows] = np.sqrt(own)
    open_ = ~_below(lower[rows], upper[rows, None])
    some = open_.any(axis=1)
    count = len(rows)
    rows, own, open_ = rows[some], own[some], open_[some]
    old, best, at = cluster[rows], own.copy(), cluster[rows].copy()
    scanned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(group.max() + 1):
        mine, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if not len(mine):
            continue
        d = squared(q[rows[mine]], c[members])
        count += d.size
        scanned.append((mine, members, d))
        k = d.argmin(axis=1)
        near, number = d[np.arange(len(mine)), k], members[k]
        better = (near < best[mine]) | ((near == best[mine]) & (number < at[mine]))
        best[mine[better]], at[mine[better]] = near[better], number[better]
    for mine, members, d in scanned:  # bounds of what was scanned, without each vector's own centroid
        other = np.where(members[None] == at[mine][:, None], np.inf, np.sqrt(d))
        lower[rows[mine], group[members[0]]] = other.min(axis=1)
    went = np.flatnonzero(at != old)
    g = group[old[went]]
    lower[rows[went], g] = np.minimum(lower[rows[went], g], np.sqrt(own[went]))
    cluster[rows], upper[rows] = at, np.sqrt(best)
    return cluster, upper, lower, count


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A list column whose rows have equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.empty((0, 1), kind)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _rows(b: pa.RecordBatch, cluster, was, upper, lower) -> pa.RecordBatch:
    cols = [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper, pa.float64()), _lists(lower, pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["vec_id", "q", "cluster", "was", "upper", "lower"])


def _first_round(kept: DataFrame, c: np.ndarray, group: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, upper, lower = assign_all(_matrix(b.column(1), np.int64), c, group)
                yield _rows(b, cluster, np.full(b.num_rows, -1), upper, lower)

    return kept.mapInArrow(run, STATE)


def _next_round(state: DataFrame, c: np.ndarray, group: np.ndarray, moved: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                was = b.column(2).to_numpy().astype(np.int64)
                cluster, upper, lower, _ = assign_moved(_matrix(b.column(1), np.int64), c, group, was, b.column(4).to_numpy(), _matrix(b.column(5), np.float64), moved)
                yield _rows(b, cluster, was, upper, lower)

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int]]:
    """By how much each cluster's sums and count change by the vectors that came or went in the last round."""

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        seen, n = False, 0

        def rows():
            at = np.arange(k * dims)
            return pa.RecordBatch.from_arrays([pa.array(at // dims, pa.int32()), pa.array(at % dims, pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(count, dims))], ["cluster", "place", "total", "n"])

        for b in batches:
            q = _matrix(b.column(0), np.int64)
            for column, sign in ((1, 1), (2, -1)):
                own = b.column(column).to_numpy()
                for j in np.unique(own[own >= 0]).tolist():
                    total[j] += sign * q[own == j].sum(axis=0)
                    count[j] += sign * int((own == j).sum())
            seen, n = True, n + b.num_rows
            if n > 1 << 30:  # before a sum of this task leaves a long
                yield rows()
                total[:], count[:], n = 0, 0, 0
        if seen:
            yield rows()

    moved = state.filter(F.col("cluster") != F.col("was")).select("q", "cluster", "was")
    sums = moved.mapInArrow(run, "cluster int, place int, total long, n long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    total, count = [[0] * dims for _ in range(k)], [0] * k
    for r in sums.collect():  # k * dims rows
        total[r["cluster"]][r["place"]], count[r["cluster"]] = int(r["total"]), int(r["n"])
    return total, count


@dataclass
class Clusters:
    """``state``: the written table of vectors, clusters and bounds; ``centroids``: the final ones, by number."""

    state: DataFrame
    centroids: np.ndarray
    groups: np.ndarray

    def assigned(self) -> DataFrame:
        """vec_id, cluster and the exact squared distance of each vector."""
        c = self.centroids

        def run(batches):
            for b in batches:
                if b.num_rows:
                    distance = _own(_matrix(b.column(1), np.int64), c[b.column(2).to_numpy()])
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(distance)], ["vec_id", "cluster", "distance"])

        return self.state.select("vec_id", "q", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, groups: int | None = None, dims: int = 64, scale: int = 64, prefix: str = "1:") -> Clusters | None:
    """``rounds`` rounds of assigning and moving centroids, then assigning once more; None without vectors."""
    spark = prepare(vectors.sparkSession)
    kept = integers(vectors, dims, scale)
    c = first_centroids(kept, k, prefix)
    k = len(c)
    if not k:
        return None
    group = group_centroids(c, groups or max(1, round(k**0.5)))
    state = written(_first_round(kept, c, group), "yinyang")
    total, count = [[0] * dims for _ in range(k)], [0] * k
    for _ in range(rounds):
        more, came = _changes(state, k, dims)
        total = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(total, more, strict=True)]
        count = [a + b for a, b in zip(count, came, strict=True)]
        new = np.array([[t // n for t in x] if n else old for x, n, old in zip(total, count, c.tolist(), strict=True)], np.int64)
        moved = np.sqrt(_own(new, c))
        c = new
        if not moved.any():  # no vector would go elsewhere
            break
        before, state = state, written(_next_round(state, c, group, moved), "yinyang")
        discard(before)
    return Clusters(state, c, group)


def report(vectors: DataFrame, **how) -> DataFrame:
    """One row a vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, found = vectors.sparkSession, cluster(vectors, **how)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = written(found.assigned(), "assigned")
    discard(found.state)
    sums = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(sums.values()))
    said = [(j, fits(d), whole, hashlib.sha256(",".join(map(str, found.centroids[j].tolist())).encode()).hexdigest()) for j, d in sums.items()]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
