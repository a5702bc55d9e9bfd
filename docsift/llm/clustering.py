"""Exact k-means on integer vectors with Hamerly's bounds.

Every vector keeps one upper bound of the distance to its own centroid and one lower bound of the distance to the second nearest. When
centroids move, the upper bound grows by the drift of its own and the lower bound falls by the largest drift of the others. While the upper bound
stays below the lower one, or below half the distance from its centroid to the next, the assignment stands and no distance is worked out. All
other vectors are ambiguous and get a full scan of all centroids in exact integers.

A round is one pass without a shuffle: it reads vectors and bounds and writes both, and with them, once for each task and cluster,
the sum of what has changed its cluster. These few rows are added to the sums of the round before, so that centroids are exact. The
k centroids are all that the driver holds.

Kept are vectors with exactly SIZE components, none null or not finite, all within LIMIT; larger ones are left out like those that aren't
finite, as their squared distances don't fit a long. Ties: the smaller number wins. Rows that occur twice are vectors of their own; as
starts, vectors of one id are ordered by their components. Fewer vectors than k: as many clusters. Empty table, or no vector kept: no rows. Extra
columns are left out, whatever their names. A null id is kept, and is no start unless there are too few.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import discard, tidied, written

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: Of a scaled component: 64 squares of differences of such values fit a long.
LIMIT = 1 << 27
#: Bounds are floats; they decide only where they are apart by more than their rounding.
MARGIN = 1e-9

STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, sums array<long>, part boolean"
NAMES = ["vec_id", "v", "cluster", "upper", "lower", "sums", "part"]


def scaled(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null unless the vector is kept."""
    fits = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LIMIT), F.lit(False))
    return F.when((F.size(vector) == size) & F.forall(vector, fits), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def exact_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, as 64-bit integers."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        d = v - centre
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    d = np.sqrt(exact_distances(centroids, centroids).astype(float))
    np.fill_diagonal(d, np.inf)
    return d.min(1) / 2


def loosened(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after centroids have moved by drift."""
    order = np.argsort(-drift, kind="stable")
    others = np.full(len(drift), drift[order[0]])
    others[order[0]] = drift[order[1]] if len(drift) > 1 else 0.0
    return upper + drift[cluster], lower - others[cluster]


def assigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds against these centroids, and how many vectors were scanned. Bounds are loosened already; cluster is -1 for new vectors."""
    gap = half_gaps(centroids)
    sure = (cluster >= 0) & (upper * (1 + MARGIN) < np.maximum(lower, gap[cluster]) * (1 - MARGIN))
    scan = np.flatnonzero(~sure)
    if len(scan):
        d = exact_distances(v[scan], centroids)
        best = d.argmin(1)  # the first of equals
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        cluster[scan], upper[scan] = best, np.sqrt(d[np.arange(len(scan)), best].astype(float))
        d[np.arange(len(scan)), best] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(d.min(1).astype(float)) if len(centroids) > 1 else np.inf
    return cluster, upper, lower, len(scan)


def vectors_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def pass_over(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state against these centroids; rows with part have, by cluster, the change of its sum of vectors and (last) of their count."""
    k, size = centroids.shape

    @tidied
    def run(batches):
        change = np.zeros((k, size + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v = vectors_of(b.column(1), size)
            before, upper, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            upper, lower = loosened(before, upper, lower, drift)
            after, upper, lower, _ = assigned(v, before.astype(np.int64), upper, lower, centroids)
            moved = np.flatnonzero(after != before)
            for sign, own in ((1, after[moved]), (-1, before[moved])):
                there = own >= 0
                np.add.at(change[:, :size], own[there], sign * v[moved[there]])
                np.add.at(change[:, size], own[there], sign)
            none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(after, pa.int32()), pa.array(upper), pa.array(lower), none, pa.array(np.zeros(b.num_rows, bool))], NAMES)
        own = np.flatnonzero(change.any(1))
        if len(own):
            nulls = [pa.nulls(len(own), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([nulls[0], nulls[1], pa.array(own, pa.int32()), nulls[2], nulls[3], pa.array(change[own].tolist(), pa.list_(pa.int64())), pa.array(np.ones(len(own), bool))], NAMES)

    return state.where("not part").mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, size: int) -> list[list[int]]:
    """By cluster, the sum of the tasks' changes. At most k * (size + 1) numbers come to the driver."""
    rows = state.where("part").select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [[0] * (size + 1) for _ in range(k)]
    for r in rows.collect():
        out[r["cluster"]][r["i"]] = int(r["x"])
    return out


def k_means(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Starts are the k vectors with the smallest sha256 of seed:id. Each round assigns all vectors and moves every centroid that has any to the
    floor of their mean; after the last one they are assigned once more.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), size, scale).alias("v")).where("v is not null")
    blank = kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(math.inf).alias("upper"), F.lit(0.0).alias("lower"), F.lit(None).cast("array<long>").alias("sums"), F.lit(False).alias("part"))
    state = written(blank, "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = state.select("v", rank.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in starts], np.int64)
    drift, sums = np.zeros(len(centroids)), [[0] * (size + 1) for _ in starts]
    for i in range(rounds + 1):
        after = written(pass_over(state, centroids, drift), f"round{i}")
        discard(state)
        state = after
        if i == rounds:
            break
        sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, changes(state, len(starts), size), strict=True)]
        moved = np.array([[x // own[-1] for x in own[:-1]] if own[-1] else centroids[c].tolist() for c, own in enumerate(sums)], np.int64)
        # rounded up, so that a drift is never too small
        drift = np.array([np.nextafter(math.sqrt(d) * (1 + MARGIN), math.inf) if d else 0.0 for d in ((moved - centroids) ** 2).sum(1).tolist()])
        centroids = moved
    return with_inertia(state.where("not part"), centroids)


def with_inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The results of a state whose clusters are those of these centroids."""
    k, size = centroids.shape

    @tidied
    def run(batches):
        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False)
            d = vectors_of(b.column(1), size) - centroids[own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.einsum("ij,ij->i", d, d))], ["vec_id", "cluster", "distance"])

    rows = state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # of each cluster, of at most k: a literal, so no join
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return rows.select("vec_id", "cluster", "distance", of([sums.get(c) for c in range(k)], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
