"""Exact top-k by inner product: bounds from segment means and deviations, coarse to fine, then exact scores."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, kept, work_folder

K = 10
#: Segments of a vector on each level, coarse to fine.
LEVELS = (1, 4, 16)
#: Queries that travel to every task at a time, in components; more are answered in further passes.
QUERY_COMPONENTS = 4 << 20
#: Vectors that give the first thresholds; they prune, and never decide.
SAMPLE = 1024
_BLOCK, _QUERIES = 2048, 512
_LOW = -(1 << 63)


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of each component, in doubles: whole numbers, exact below 2^53."""
    return np.floor(1024.0 * vectors.astype(np.float64))


def segments(vectors: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, mean and deviation from it (as a norm) of each segment of each vector."""
    bounds = np.linspace(0, vectors.shape[1], min(parts, vectors.shape[1]) + 1).astype(int)
    sizes = np.diff(bounds).astype(np.float64)
    means = np.add.reduceat(vectors, bounds[:-1], axis=1) / sizes
    apart = vectors - np.repeat(means, np.diff(bounds), axis=1)
    return sizes, means, np.sqrt(np.add.reduceat(apart * apart, bounds[:-1], axis=1))


def bound(queries: tuple, vectors: tuple) -> np.ndarray:
    """The most that inner products can be (least distances, with the sign turned): in each segment the
    means multiply, and what deviates from them is at most the product of the deviations."""
    sizes, q_mean, q_dev = queries
    _, v_mean, v_dev = vectors
    most = np.hstack([q_mean * sizes, q_dev]) @ np.hstack([v_mean, v_dev]).T
    return np.where(np.isfinite(most), most, np.inf)  # beyond what doubles hold nothing is pruned


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of matching rows as 64-bit integers; beyond that range they stay at its ends."""
    most = float(np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)]
    return np.array([max(_LOW, min((1 << 63) - 1, x)) for x in exact], np.int64)


class TopK:
    """The best rows so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int = K):
        self.ids, self.queries, self.k = ids, queries, k
        self.floors = floors.copy()
        with np.errstate(over="ignore", invalid="ignore"):
            self.stats = [segments(queries, s) for s in LEVELS]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self._add(ids, vectors)

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for low in range(0, len(ids), _BLOCK):
            own, block = ids[low:low + _BLOCK], vectors[low:low + _BLOCK]
            stats = [segments(block, s) for s in LEVELS]
            reach = float(np.sqrt((block * block).sum(1).max(initial=0)))
            for q in range(0, len(self.ids), _QUERIES):
                self._block(slice(q, q + _QUERIES), own, block, stats, reach)

    def _block(self, part: slice, ids: np.ndarray, block: np.ndarray, stats: list, reach: float) -> None:
        slack = 0.5 + 1e-9 * reach * np.sqrt((self.queries[part] ** 2).sum(1))
        need = self.floors[part].astype(np.float64) - np.nan_to_num(slack, nan=np.inf, posinf=np.inf)
        rows, columns = np.arange(len(need)), np.arange(len(ids))
        alive = np.ones((len(rows), len(columns)), bool)
        for (sizes, means, devs), (_, v_means, v_devs) in zip(self.stats, stats, strict=True):
            most = bound((sizes, means[part][rows], devs[part][rows]), (sizes, v_means[columns], v_devs[columns]))
            alive &= most >= need[rows, None]
            some, other = alive.any(1), alive.any(0)
            rows, columns, alive = rows[some], columns[other], alive[some][:, other]
            if not len(rows):
                return
        for r, keep in zip(rows, alive, strict=True):
            at = part.start + r
            found = columns[keep]
            found = found[ids[found] != self.ids[at]]
            if len(found):
                self._merge(at, ids[found], scores(np.broadcast_to(self.queries[at], (len(found), block.shape[1])), block[found]))

    def _merge(self, at: int, ids: np.ndarray, found: np.ndarray) -> None:
        ids, found = np.concatenate([self.best[at][0], ids]), np.concatenate([self.best[at][1], found])
        order = np.lexsort((ids, np.bitwise_not(found)))[: self.k]
        self.best[at] = ids[order], found[order]
        if len(order) == self.k:
            self.floors[at] = max(self.floors[at], found[order[-1]])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)


def top_k(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose id ``every`` divides.

    Queries travel to the tasks in passes of bounded size, and each pass streams all vectors once; a task
    keeps k rows a query, and the tasks' rows meet in one window per query. A query's own rows are those with
    its id; other rows that share an id are candidates each, and equal query rows are one query. Only vectors
    of a query's length are its candidates. Ties go to the smaller id. Vectors that are null or empty, hold
    null or non-finite components or have no id take no part; no queries give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    facts = asked.agg(F.sum(F.size("embedding")).alias("components")).first()
    passes = math.ceil((facts["components"] or 0) / QUERY_COMPONENTS)
    sample = [(r["vec_id"], r["embedding"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    found, folder = None, work_folder(spark, "topk")
    for turn in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn).collect()  # bounded by the pass
        answers, sent = _one_pass(rows, _by_length([(r["vec_id"], r["embedding"]) for r in mine]), _by_length(sample), turn, k)
        answers = kept(answers, folder, f"pass{turn}")  # one pass after another, each handing back what it sent
        sent.destroy()
        found = answers if found is None else found.unionByName(answers)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _by_length(rows: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, list] = {}
    for row in rows:
        groups.setdefault(len(row[1]), []).append(row)
    return {n: (np.array([i for i, _ in own], np.int64), quantised(np.array([v for _, v in own]))) for n, own in groups.items()}


def _one_pass(rows: DataFrame, queries: dict, sample: dict, turn: int, k: int) -> tuple[DataFrame, Broadcast]:
    state = {}
    for n, (ids, own) in queries.items():
        primed = TopK(ids, own, np.full(len(ids), _LOW, np.int64), k)
        if n in sample:
            primed.add(*sample[n])
        state[n] = (ids, own, primed.floors)
    sent = rows.sparkSession.sparkContext.broadcast(state)  # at most QUERY_COMPONENTS components and their floors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {n: TopK(ids, own, floors, k) for n, (ids, own, floors) in sent.value.items()}
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for n, top in tops.items():
                at = np.flatnonzero(sizes == n)
                if len(at):
                    top.add(ids[at], quantised(flat[starts[at][:, None] + np.arange(n)]))
        base = 0
        for n, top in tops.items():
            for at, (ids, found) in enumerate(top.best):
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), (turn << 32) + base + at)), pa.array(np.full(len(ids), top.ids[at])),
                         pa.array(ids), pa.array(found)], names=["query", "query_id", "vec_id", "score"])
            base += len(top.ids)

    return arrow_map(rows, search, "query long, query_id long, vec_id long, score long"), sent
