"""Operator 11: centroid clustering with an equal-average equal-variance nearest-centroid search.

For integer vectors x and c of n components, with sums S and deviations D = sqrt(n * (sum of squares) - S^2), n times the
squared distance is at least (Sx - Sc)^2 + (Dx - Dc)^2. Centroids lie sorted by their component sum (n times their mean).
The search starts at the vector's own mean and goes outward to both sides: once the next gap between means alone exceeds
the best distance, all that lie further out are rejected; a centroid whose deviation adds too much is skipped; only what
is left has its distance taken, exactly, in 64-bit integers. All vectors of an Arrow batch advance together.

A round is one pass over the vectors: each task returns one row of sums for each of its centroids, Spark adds those up, and
the driver sees the number of centroids times the number of components, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import shared_folder, table

DIM = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Components stay below this, so that all sums of 64 of them, their squares and 64 times a distance fit 64 bits.
LIMIT = 1 << 24

_SUMS = T.StructType(
    [T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
)
_ARROW_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _floored(column: pa.ListArray, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows): the vectors of a batch that are kept, as whole numbers, and where they stand in it."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(places)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component is NaN here
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        fits = (np.abs(x) <= LIMIT).all(axis=1)  # false for NaN and infinities
    return places[fits], x[fits].astype(np.int64)


def whole_vectors(embeddings: DataFrame, vec: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of exactly ``dim`` finite components, each component floor(scale * x), in a table of the
    shared folder that all rounds read.

    Null vectors, vectors of another length and those with a null or non-finite component are left out, as are vectors
    with a component beyond +-2^24 after scaling, of which distances would not fit a long. A null or repeated vec_id is
    kept as it is; every row is a vector of its own. Other columns are not read.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = _floored(batch.column(1), dim, scale)
            flat = pa.array(x.astype(np.int32).reshape(-1))
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), v], names=["vec_id", "v"])

    spark = embeddings.sparkSession
    kind = T.StructType([embeddings.schema["vec_id"], T.StructField("v", T.ArrayType(T.IntegerType()))])
    doubles = embeddings.select("vec_id", F.col(vec).cast("array<double>").alias("v"))
    folder = shared_folder(spark, "vectors")
    doubles.mapInArrow(convert, kind).write.parquet(folder)
    return spark.read.parquet(folder)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; of equal hashes (repeated ids) the
    smaller vector first. A null vec_id counts as ''. Fewer vectors than ``k``: as many centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k)
    return [list(r.v) for r in sorted(first.collect(), key=lambda r: (r.key, r.v))]


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - sums * sums).astype(np.float64))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, squared distances, distances taken): for each row of ``x`` the nearest of ``centroids``, of equally near
    ones the smallest number."""
    n, dim = x.shape
    k = len(centroids)
    c_sum = centroids.sum(axis=1)
    order = np.argsort(c_sum, kind="stable")
    c, c_sum = centroids[order], c_sum[order]
    c_dev = _deviation(c, c_sum)
    x_sum = x.sum(axis=1)
    x_dev = _deviation(x, x_sum)
    high = np.searchsorted(c_sum, x_sum)
    low = high - 1
    best = np.full(n, np.iinfo(np.int64).max)
    who = np.full(n, k, np.int64)
    live = np.arange(n)
    far = np.iinfo(np.int64).max
    taken = 0
    for _ in range(k):
        below, above = low[live], high[live]
        gap_low = np.where(below >= 0, x_sum[live] - c_sum[np.maximum(below, 0)], far)
        gap_high = np.where(above < k, c_sum[np.minimum(above, k - 1)] - x_sum[live], far)
        down = gap_low <= gap_high
        gap = np.where(down, gap_low, gap_high)
        # sums lie within 2^30, so the square of a gap fits; before the first distance nothing is rejected
        fresh = who[live] == k
        on = (gap < far) & (fresh | (np.where(gap < far, gap, 0) ** 2 <= dim * np.where(fresh, 0, best[live])))
        live, down, gap, fresh = live[on], down[on], gap[on], fresh[on]
        if not len(live):
            break
        at = np.where(down, low[live], high[live])
        low[live] -= down
        high[live] += ~down
        # roots are rounded: a little slack keeps the bound below the true one
        spread = np.maximum(np.abs(x_dev[live] - c_dev[at]) - 1e-3, 0.0)
        bound = (gap.astype(np.float64) ** 2 + spread**2) * (1 - 1e-12)
        near = fresh | (bound <= dim * np.where(fresh, 0, best[live]).astype(np.float64))
        rows, at = live[near], at[near]
        d = ((x[rows] - c[at]) ** 2).sum(axis=1)
        taken += len(rows)
        number = order[at]
        better = (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], number[better]
    return who, best, taken


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid becomes the floor of the mean of its vectors; one without vectors stays."""
    k, dim = len(centroids), len(centroids[0])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _rows(batch.column(0), dim)
            who = nearest(x, c)[0]
            np.add.at(sums, who, x)
            counts += np.bincount(who, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pylist(
            [{"cluster": int(i), "n": int(counts[i]), "sums": sums[i].tolist()} for i in used], _ARROW_SUMS
        )

    parts = vectors.select("v").mapInArrow(sums_of, _SUMS).select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = parts.groupBy("cluster", "at").agg(exact("n").alias("n"), exact("s").alias("s")).collect()
    out = [list(c) for c in centroids]
    for r in found:  # at most clusters x components rows
        out[r["cluster"]][r["at"]] = int(r["s"]) // int(r["n"])
    return out


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over all ``vectors`` (see ``whole_vectors``). None for an empty table."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance), one row per vector. Without centroids there are no vectors, so no rows."""
    kind = T.StructType(
        [vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            who, d, _ = nearest(_rows(batch.column(1), c.shape[1]), c)
            out = [batch.column(0), pa.array(who.astype(np.int32)), pa.array(d)]
            yield pa.RecordBatch.from_arrays(out, names=kind.names)

    return vectors.select("vec_id", "v").mapInArrow(search, kind)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector."""
    spark: SparkSession = vectors.sparkSession
    centroids = fit(vectors, k, rounds, seed)
    folder = shared_folder(spark, "clusters")
    assign(vectors, centroids).write.parquet(folder)
    found = spark.read.parquet(folder)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    of_cluster = found.groupBy("cluster").agg(total("distance").alias("s")).collect()  # at most k rows
    inertia = sum(int(r["s"]) for r in of_cluster)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(r["cluster"], int(r["s"]), inertia, digest[r["cluster"]]) for r in of_cluster]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def query(spark, sf_dir):
    return cluster(whole_vectors(table(spark, sf_dir, "embeddings")))


def clusters_sql(embeddings: str, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB text: every distance of every round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {embeddings}
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS cluster, v AS c
  FROM kept ORDER BY cluster LIMIT {k}
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT row_no, min(p) AS p FROM (
    SELECT row_no, {{'distance': CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'cluster': cluster}} AS p
    FROM kept, c{i}
  ) GROUP BY row_no
)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY place) AS c FROM (
    SELECT cluster, place, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT p.cluster AS cluster, place, sum(v[place]) AS s, count(*) AS n FROM kept JOIN a{i} USING (row_no), range(1, {DIM + 1}) AS r(place)
      GROUP BY 1, 2
    )
  ) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster AS cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster)
)""")
    return f"""WITH {', '.join(parts)}, sums AS (
  SELECT p.cluster AS cluster, CAST(sum(p.distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1
)
SELECT vec_id, p.cluster AS cluster, p.distance AS distance, cluster_inertia,
  (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM sums) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row_no) JOIN sums ON sums.cluster = p.cluster JOIN c{rounds} ON c{rounds}.cluster = p.cluster"""


QUERIES = {"op11_centroid_clusters": query}
ORACLE = {"op11_centroid_clusters": clusters_sql("embeddings")}
