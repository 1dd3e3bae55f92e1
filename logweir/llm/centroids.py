"""Exact centroid clustering in rounds, most vectors kept in place by geometric bounds.

A vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to every
other one. When centroids move, the upper bound grows by the drift of its own centroid. The lower bound shrinks by less
than the largest drift: all vectors of a cluster lie in a sphere around its old centroid, and seen from the middle of
another centroid's move that sphere fills a cone of directions. In the plane through the move and the sphere's centre,
the points that come nearer by more than p cos(t) lie on a hyperbola's inner side, within the angle t of the direction of
the move, where p is the drift. So a sphere whose cone keeps off by the angle t loses at most p cos(t), and nothing where
it lies behind. Vectors whose bounds still overlap are ambiguous and are measured against all centroids.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, kept, work_folder

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, "1"
#: Whole-number components must stay below this, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: Below this, products and sums of doubles are exact.
_EXACT = 1 << 22
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_STATE = "vec_id long, parts array<long>, cluster int, distance long, upper double, lower double, rows long, scanned long"


def usable(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, parts): vectors of ``size`` finite components, each turned into floor(scale * x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) == size).where(~bad).select("vec_id", "embedding")
    huge = F.exists("embedding", lambda x: F.abs(x.cast("double") * float(scale)) >= float(LIMIT))
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    error = F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("array<long>")
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(huge, error).otherwise(parts).alias("parts"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the least hash of ``seed:vec_id``; without an id last; equal ids by their components."""
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(name.alias("name"), "parts").orderBy(F.asc_nulls_last("name"), "parts").limit(clusters).collect()
    return np.array([r["parts"] for r in chosen], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: how much nearer centroid j may have come to a vector within ``radius[i]`` of old centroid i."""
    move, middle = (new - old).astype(np.float64), (new + old) / 2.0
    drift = np.sqrt((move * move).sum(1))
    away = old[:, None, :] - middle[None]
    far = np.sqrt((away * away).sum(2))
    off = far > radius[:, None] * (1 + 1e-9)  # the middle of the move lies outside the sphere
    with np.errstate(divide="ignore", invalid="ignore"):
        direction = np.arccos(np.clip((away * move[None]).sum(2) / (far * drift[None]), -1, 1))
        open_angle = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
        lost = drift[None] * np.clip(np.cos(np.maximum(direction - open_angle, 0)), 0, 1)
    lost = np.where(off, lost, drift[None])
    return np.where(drift[None] > 0, np.minimum(lost * (1 + 1e-9) + 1e-9 * drift[None], drift[None]) * _UP, 0)


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


class _Pass:
    """Assigns vectors to centroids; bounds tell which of them need all distances."""

    def __init__(self, centroids: np.ndarray, drift: np.ndarray | None, lost: np.ndarray | None, exact: bool):
        self.centroids, self.drift, self.exact = centroids, drift, exact
        if lost is not None:
            others = np.where(np.eye(len(lost), dtype=bool), 0, lost)
            self.lost = others.max(1, initial=0)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        n = len(vectors)
        distance = np.full(n, -1, np.int64)
        if self.drift is None:
            cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            unsure = np.arange(n)
        else:
            lower = lower - self.lost[cluster]
            upper = (upper + self.drift[cluster]) * _UP
            near = np.arange(n) if self.exact else np.flatnonzero(upper >= lower)
            distance[near] = ((vectors[near] - self.centroids[cluster[near]]) ** 2).sum(1)
            upper[near] = np.sqrt(distance[near]) * _UP
            unsure = near[upper[near] >= lower[near]]
        if len(unsure):
            found = _squares(vectors[unsure], self.centroids)
            best = found.argmin(1)  # the smaller number among equals
            at = np.arange(len(unsure))
            cluster[unsure], distance[unsure] = best, found[at, best]
            upper[unsure] = np.sqrt(found[at, best]) * _UP
            if found.shape[1] > 1:
                found[at, best] = np.iinfo(np.int64).max
                lower[unsure] = np.sqrt(found.min(1)) * _DOWN
            else:
                lower[unsure] = np.inf
        return cluster, distance, upper, lower, len(unsure)


def _assigned(rows: DataFrame, work: _Pass, first: bool) -> DataFrame:
    """Every row with its new state; after a task's rows, one row for each cluster with the task's sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = work.centroids.shape
        sums, counts, reach, scanned = np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, size)
            state = (np.zeros(n, np.int64),) + (np.zeros(n),) * 2 if first else (
                batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy())
            cluster, distance, upper, lower, looked = work.assign(vectors, *state)
            scanned += looked
            order = np.argsort(cluster, kind="stable")
            heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            own = cluster[order][heads]
            sums[own] += np.add.reduceat(vectors[order], heads)
            counts += np.bincount(cluster, minlength=k)
            np.maximum.at(reach, cluster, upper)
            yield _rows(batch.column(0), batch.column(1), cluster, distance, upper, lower, np.zeros(n, np.int64), np.zeros(n, np.int64))
        used = np.flatnonzero(counts)
        if len(used):
            lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * size, pa.array(sums[used].ravel()))
            yield _rows(pa.nulls(len(used), pa.int64()), lists, used, np.zeros(len(used), np.int64), reach[used],
                        np.zeros(len(used)), counts[used], np.where(np.arange(len(used)) == 0, scanned, 0))

    return arrow_map(rows, task, _STATE)


def _rows(ids, parts, cluster, distance, upper, lower, rows, scanned) -> pa.RecordBatch:
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.RecordBatch.from_arrays([ids, parts, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper),
                                       pa.array(lower), pa.array(rows), pa.array(scanned)], names=names)


def _sums(table: DataFrame) -> tuple[dict[int, list[int]], dict[int, tuple]]:
    """Exact sums of components, and count, reach and measured vectors of each cluster; clusters times components rows."""
    partial = table.where("rows > 0")
    summed = partial.select("cluster", F.posexplode("parts").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part").alias("part"))
    parts: dict[int, dict[int, int]] = {}
    for row in summed.collect():
        parts.setdefault(row["cluster"], {})[row["at"]] = row["part"]
    facts = partial.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.max("upper").alias("reach"), F.sum("scanned").alias("scanned"))
    return ({c: [own[i] for i in range(len(own))] for c, own in parts.items()},
            {r["cluster"]: (r["rows"], r["reach"], r["scanned"]) for r in facts.collect()})


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, parts, cluster, distance) of every usable vector, the final centroids, and how many vectors each pass
    measured against all centroids.

    Vectors that are null, of another length or hold a null or non-finite component take no part. Rows that share an
    id, or have none, are vectors each. With fewer vectors than ``clusters`` there are as many centroids as vectors;
    no vectors give no rows. Of equal distances the smaller number wins; an empty cluster keeps its centroid. Every
    pass reads the vectors with their state and writes them again below the shared folder, and its tasks add one row a
    cluster, so the driver sees sums of clusters times components whatever the table's size. No row depends on which
    task holds it: sums are whole numbers. Components of |scale * x| from 2^27 are an error.
    """
    folder = work_folder(vectors.sparkSession, "centroids")
    rows = usable(vectors, size, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, parts array<long>, cluster int, distance long"), centroids, []
    drift = lost = None
    measured = []
    for turn in range(rounds + 1):
        work = _Pass(centroids, drift, lost, exact=turn == rounds)
        table = kept(_assigned(rows, work, turn == 0), folder, f"pass{turn}")
        rows = table.where("rows = 0").select("vec_id", "parts", "cluster", "upper", "lower")
        sums, facts = _sums(table) if turn < rounds else ({}, {})
        if turn < rounds:
            measured.append(sum(f[2] for f in facts.values()))
            moved, reach = centroids.copy(), np.zeros(len(centroids))
            for c, (count, far, _) in facts.items():
                moved[c], reach[c] = [s // count for s in sums[c]], far
            lost = loosening(centroids, moved, reach)
            drift = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(1)) * _UP
            centroids = moved
    measured.append(table.agg(F.sum("scanned")).first()[0])
    return table.where("rows = 0").select("vec_id", "parts", "cluster", "distance"), centroids, measured


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    rows, centroids, _ = cluster_vectors(vectors, **settings)
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a cluster
    total = sum(r["cluster_inertia"] for r in inertia)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = rows.sparkSession.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], total, digests[r["cluster"]]) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def duckdb_sql() -> str:
    """The same rounds, every vector measured against every centroid, as DuckDB SQL."""
    steps = [f"""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS INT) AS cluster, e
       FROM v QUALIFY cluster < {CLUSTERS})"""]
    for turn in range(ROUNDS + 1):
        steps.append(f"""a{turn} AS (
  SELECT v.r, v.vec_id, v.e, c.cluster, c.e AS c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
  FROM v, c{turn} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY distance, c.cluster) = 1)""")
        if turn < ROUNDS:
            steps.append(f"""s{turn} AS (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(range({SIZE})) AS i, unnest(e) AS x FROM a{turn}) GROUP BY cluster, i),
m{turn} AS (SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{turn} GROUP BY cluster),
c{turn + 1} AS (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{turn} c LEFT JOIN m{turn} m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS}
"""
