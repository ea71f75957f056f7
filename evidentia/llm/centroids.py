"""Centroid clustering over integer vectors, each assignment by annulus search.

A centroid nearer to a vector than some bound has a norm within that bound of
the vector's norm. So centroids are sorted by norm, the one nearest in norm
gives each vector its bound, binary search finds the annulus of norms within it,
and only the centroids in there are compared, exactly, in integers. Bounds are
widened by more than floating point can err, so ties on the edge are compared
as well. Vectors are written once as fixed-width items; a round is one scan of
them that adds up each task's vectors by cluster, so that a shuffle carries one
row for each task, cluster and component at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
#: Greatest magnitude of a scaled component: squared distances of 64 of them fit a long.
MOST = 1 << 27
_ITEM = np.dtype("<i4")


def whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow list column, the rows that hold exactly dims finite numbers, and those numbers as doubles."""
    at = np.flatnonzero((column.value_lengths().fill_null(-1).to_numpy() == dims))
    values = column.take(pa.array(at)).flatten()
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dims)  # nulls become not a number
    finite = np.isfinite(numbers).all(axis=1)
    return at[finite], numbers[finite]


def vectors(df: DataFrame, *, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id, item: the whole vectors of df as dims integers of 4 bytes, floor(scale * x), at most MOST in magnitude."""
    flat = _shared.positional(df).select(_shared.column(df, id_col).cast("long").alias("vec_id"), _shared.column(df, vector_col).cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            at, numbers = whole(batch.column(1), dims)
            made = np.clip(np.floor(scale * numbers), -MOST, MOST).astype(_ITEM)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([row.tobytes() for row in made], pa.binary())], ["vec_id", "item"])

    return _shared.map_arrow(flat, run, "vec_id long, item binary")


def items(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _ITEM).reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of x, the least number among ties, its squared distance, and the number of pairs compared."""
    squares, own = (centroids * centroids).sum(axis=1), (x * x).sum(axis=1)
    order = np.argsort(squares, kind="stable")
    norms, of_x = np.sqrt(squares[order].astype(float)), np.sqrt(own.astype(float))
    after = np.searchsorted(norms, of_x)
    left, right = np.maximum(after - 1, 0), np.minimum(after, len(norms) - 1)
    first = np.where(np.abs(norms[left] - of_x) <= np.abs(norms[right] - of_x), left, right)
    cluster = order[first]
    best = ((x - centroids[cluster]) ** 2).sum(axis=1)
    bound = np.sqrt(best.astype(float))
    slack = 1e-9 * (bound + of_x + norms[-1]) + 1e-9
    lo, hi = np.searchsorted(norms, of_x - bound - slack, "left"), np.searchsorted(norms, of_x + bound + slack, "right")
    for k in range(len(order)):
        rows = np.flatnonzero((lo <= k) & (k < hi) & (first != k))
        far = ((x[rows] - centroids[order[k]]) ** 2).sum(axis=1)
        better = (far < best[rows]) | (far == best[rows]) & (order[k] < cluster[rows])
        best[rows[better]], cluster[rows[better]] = far[better], order[k]
    return cluster, best, int((hi - lo).sum())


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the vectors of each centroid; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = items(batch.column(0), dims)
            cluster, _, _ = nearest(x, centroids)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = _shared.map_arrow(kept.select("item"), run, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for row in each.collect():  # one row for each centroid and component
        out[row["cluster"], row["pos"]] = int(row["total"]) // row["n"]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every whole vector, and the final centroids.

    Whole vectors have exactly dims components, none null or not finite; other
    rows, null vectors among them, give none. Components become
    floor(scale * x), beyond MOST in magnitude MOST. The first centroids are the
    k vectors whose SHA-256 of "seed:id" is least, equal ids (repeated rows) in
    the order of their items, null ids last; where there are fewer vectors, all
    are centroids. Ties go to the smaller number. Repeated rows count, and are
    returned, one by one. An empty table gives no rows and no centroid. Other
    columns don't matter, whatever their names.
    """
    kept = _shared.materialize(vectors(df, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = kept.select(rank.alias("rank"), "item").orderBy(F.asc_nulls_last("rank"), "item").limit(k).collect()
    centroids = items(pa.array([bytes(r["item"]) for r in start], pa.binary()), dims)
    for _ in range(rounds if start else 0):
        centroids = _moved(kept, centroids)

    def run(batches):
        for batch in batches:
            at, far, _ = nearest(items(batch.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return _shared.map_arrow(kept, run, "vec_id long, cluster int, distance long"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (null beyond a long) and centroid_sha256; what is joined has a row for each centroid."""
    assigned = _shared.materialize(assigned, "clusters")
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    by_cluster = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # one row for each centroid
    whole_sum, most = sum(by_cluster.values()), (1 << 63) - 1
    rows = [(c, s if s <= most else None, whole_sum if whole_sum <= most else None, digest(centroids[c])) for c, s in sorted(by_cluster.items())]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """The cluster of every embedding after three rounds from sixteen centroids, with inertias."""
    return report(*cluster(_shared.table(spark, sf_dir, "embeddings")))


def _rounds() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
pairs{r} AS (SELECT v.row, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r} AS c),
a{r} AS (SELECT row, cluster, distance FROM pairs{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < ROUNDS:
            steps.append(f"""
sums{r} AS (SELECT a.cluster, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{r} AS a JOIN v USING (row), range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY a.cluster, i),
means{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums{r} GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN means{r} AS m USING (cluster))""")
    return ",".join(steps)


ORACLE_SQL = f"""
WITH whole AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMENSIONS}),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM whole),
ranked AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS nth FROM v),
c0 AS (SELECT nth::INTEGER AS cluster, x FROM ranked WHERE nth < {CENTROIDS}),{_rounds()}
SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (row) JOIN c{ROUNDS} AS c USING (cluster)
"""
