"""Ball k-means: exact rounds of nearest centroids, where clusters are balls and members are compared with few centroids.

Within a task the members of a cluster form a ball around its centroid. Half the distance to another centroid tells who can go over to
it: a member nearer to its own centroid than half the distance between the two is nearer to its own, strictly. So centroids are
neighbours if half their distance lies within the ball's radius; members below the nearest neighbour's half distance are the stable
core and are compared with none; the rest lie in annuli between the half distances of consecutive neighbours, and those of the k-th
annulus are compared with the k nearest neighbours alone. A task's ball holds the members that it reads, so its radius is at most the
whole cluster's, and no exchange is needed for it. In the first assignment nobody has a cluster, and all centroids are compared.

Everything is exact: components are integers, distances are squared 64-bit integers and ties go to the smaller number. Each round is one
pass that writes the vectors with their clusters, and one row of sums for each task and cluster beside them; only the sums' total, a
row for each cluster, comes to the driver, and centroids are sent about (k x width numbers, a parameter). A round's table replaces
the one before it, which is deleted. A lost executor costs the tasks of one pass.

Defined results: vectors that are null, not of the given width or with a null or non-finite component are left out, and so are those with a
component of 2^18 or more in absolute value, whose squared distances 64 bits may not hold. Repeated rows are vectors of their own; of
rows with equal ids those of the lesser vector come first when centroids are chosen, and a null id is hashed as an empty one. With fewer
vectors than k there are as many centroids as vectors. An empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.shared import removed
from veilwork.llm._common import passing, shared_dir, table

SCALE = 256
LARGEST = 1 << 18
#: Vectors that are compared at once.
BLOCK = 4096
#: Squared norms of up to so much are exact in doubles, and so are products of the vectors.
EXACT = 1 << 50


def usable(vector: str, width: int) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return F.coalesce((F.size(vector) == width) & ~bad, F.lit(False))


def scaled(values: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) for each component, as integers."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, width)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point and its squared distance, all centroids compared."""
    if max((points * points).sum(1).max(initial=0), (centroids * centroids).sum(1).max(initial=0)) <= EXACT:
        a, b = points.astype(np.float64), centroids.astype(np.float64)
        far = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        far = np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)
    best = far.argmin(1)  # the first of equal ones
    return best, far[np.arange(len(points)), best]


class Balls:
    """Centroids with the order of all others by distance, for each."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.between = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
        self.order = np.argsort(self.between, axis=1, kind="stable")
        self.compared = 0

    def reassigned(self, points: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each point and its squared distance, given the clusters of the round before."""
        own = ((points - self.centroids[clusters]) ** 2).sum(1)
        best, least = clusters.copy(), own.copy()
        by_ball = np.lexsort((-own, clusters))
        begins = np.flatnonzero(np.diff(clusters[by_ball], prepend=-1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(by_ball)], strict=True):
            members = by_ball[begin:end]  # the farthest first
            ball = int(clusters[members[0]])
            reach = 4 * own[members]
            for j in self.order[ball].tolist():
                if j == ball:
                    continue
                beyond = int(np.searchsorted(-reach, -self.between[ball, j], side="right"))  # those at or beyond half the distance
                if not beyond:
                    break  # this centroid and all farther ones are no neighbours of the ball
                outer = members[:beyond]
                far = ((points[outer] - self.centroids[j]) ** 2).sum(1)
                self.compared += beyond
                better = (far < least[outer]) | ((far == least[outer]) & (j < best[outer]))
                best[outer[better]], least[outer[better]] = j, far[better]
        return best, least


def _assign(rows: DataFrame, key: str, centroids: np.ndarray, first: bool) -> DataFrame:
    """key, v, cluster, distance for each vector, and for each task and cluster a row with part true: number, distance and sums of its vectors."""
    k, width = centroids.shape
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = f"`{key}` {kind}, v binary, cluster int, distance long, part boolean, n long, sums array<long>"
    names = [key, "v", "cluster", "distance", "part", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(sent.value)
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        ids = pa.null()
        for batch in batches:
            ids = batch.column(0).type
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if first:
                    points = scaled(part.column(1), width)
                    best, far = nearest(points, sent.value)
                else:
                    points = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
                    best, far = balls.reassigned(points, part.column(2).to_numpy().astype(np.int64))
                n += np.bincount(best, minlength=k)
                np.add.at(inertia, best, far)
                np.add.at(sums, best, points)
                stored = pa.array([p.tobytes() for p in points.astype(np.int32)], pa.binary())
                none = pa.nulls(len(best), pa.int64())
                columns = [part.column(0), stored, pa.array(best, pa.int32()), pa.array(far), pa.array(np.zeros(len(best), bool)), none, pa.nulls(len(best), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)
        met = np.flatnonzero(n)
        if len(met):
            lists = pa.array(sums[met].tolist(), pa.list_(pa.int64()))
            columns = [pa.nulls(len(met), ids), pa.nulls(len(met), pa.binary()), pa.array(met, pa.int32()), pa.array(inertia[met]), pa.array(np.ones(len(met), bool)), pa.array(n[met]), lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def _totals(stored: DataFrame, width: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each cluster met: its number of vectors, its distance and its sums; a row for each cluster."""
    whole = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    rows = stored.filter("part").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("distance"), *whole).collect()
    return {r["cluster"]: (r["n"], int(r["distance"]), [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector, and the final centroids (integers)."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{key}`"), F.col(f"`{vector}`").alias("v")).filter(usable("v", width))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    chosen = kept.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    centroids = scaled(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())), width) if chosen else np.zeros((1, width), np.int64)
    folder = passing(spark, f"{shared_dir(spark)}/balls-{uuid.uuid4().hex}")
    for turn in range(rounds + 1):
        out = _assign(kept, key, centroids, first=turn == 0)
        out.write.parquet(f"{folder}/{turn}")
        now = spark.read.schema(out.schema).parquet(f"{folder}/{turn}")
        totals = _totals(now, width)
        if turn:
            removed(spark, f"{folder}/{turn - 1}")
        kept = now.filter("not part").select(f"`{key}`", "v", "cluster")
        if turn < rounds:
            centroids = centroids.copy()
            for cluster, (n, _, sums) in totals.items():
                centroids[cluster] = [s // n for s in sums]
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = sum(t[1] for t in totals.values())
    told = spark.createDataFrame([(c, t[1], inertia, digest[c]) for c, t in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows, so they go to every task.
    return now.filter("not part").select(f"`{key}`", "cluster", "distance").join(F.broadcast(told), "cluster").select(f"`{key}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))[0]


def _sql(k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2) -> str:
    steps = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x) >= {LARGEST})) = 0)""",
        f"""c0 as materialized (
  select row_number() over (order by sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as cluster, v from kept
  order by cluster limit {k})""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} as materialized (
  select r, best.c as cluster, best.d as distance from (
    select r, min({{'d': cast(list_inner_product(cast(kept.v as double[]), cast(kept.v as double[])) - 2 * list_inner_product(cast(kept.v as double[]), cast(c{t}.v as double[]))
      + list_inner_product(cast(c{t}.v as double[]), cast(c{t}.v as double[])) as bigint), 'c': cluster}}) as best
    from kept, c{t} group by r))""")
        if t < rounds:
            steps.append(f"""c{t + 1} as materialized (
  select c{t}.cluster, coalesce(m.v, c{t}.v) as v from c{t} left join (
    select cluster, list((s - (s % n + n) % n) // n order by i) as v from (
      select cluster, i, sum(x) as s, count(*) as n from (select r, unnest(v) as x, generate_subscripts(v, 1) as i from kept) join a{t} using (r) group by cluster, i)
    group by cluster) m using (cluster))""")
    last = rounds
    return (
        "with " + ",\n".join(steps) + f"""
select vec_id, cast(cluster as integer) as cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c{last}.v, ',')) as centroid_sha256
from kept join a{last} using (r) join c{last} using (cluster)"""
    )


#: Every vector is compared with every centroid here: a stated set of k rows.
SQL = _sql()
