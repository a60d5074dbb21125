"""Exact top-k search by inner product with block-at-a-time pruning.

A vector's components are terms with integer weights floor(scale * x). Rows of a task are put in an order that brings
like vectors together and cut into ranges of BLOCK; each range keeps its forward index (the vectors) and, for every
term, the largest and smallest weight. For a query the sum over terms of weight times the fitting extreme bounds every
score in a range. Ranges are visited in falling order of that bound, all queries of a batch that still need a
range scoring it in one product, until a query's next bound lies below its kth score; equal bounds are still visited,
so ties go to the smaller id exactly.

Each query first gets a floor: its kth score among at most 2 * SEED rows (those whose id's hash says so), which are
sent to all tasks. The kth score is never lower, so ranges bounded below it are not read, and rows below it leave no
task. The first PIVOTS of these rows also order candidates: by the pivot that each is most like, then by that likeness.

Queries meet candidates in large units: a batch of up to BATCH queries and a group of up to GROUP candidates, both
in the least integer type that holds their weights, go to one task, which takes STEP queries and SLICE candidates at
a time. So a candidate is copied once for each BATCH queries. Bounds cost little but can't help where vectors point
everywhere alike: then all ranges are scored (see README).

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Shorter vectors are
filled up with zeros, also under one query id, whose vectors then share a ranking. Scores beyond 64 bits become the nearest 64-bit value. A query's own row is every row with its id. Repeated candidates count each; repeated queries once.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128
#: Candidates in a chunk, in a group at most, in a slice; queries in a batch at most, in a step.
CHUNK, GROUP, SLICE, BATCH, STEP = 4096, 1 << 18, 1 << 14, 1 << 18, 512
SEED, PIVOTS = 4096, 64
BLOB = "part long, ids binary, kind string, width int, vectors binary"


def weights(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def sound(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def dense(v: pa.Array) -> np.ndarray:
    """Lists of integers as rows of a matrix, shorter ones filled up with zeros."""
    lens = v.value_lengths().to_numpy()
    x = np.zeros((len(lens), max(1, int(lens.max(initial=0)))), np.int64)
    x[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = v.flatten().to_numpy()
    return x


def blobs(df: DataFrame, rows: int) -> DataFrame:
    """df (id long, v array<long>) as chunks of at most so many rows; vectors are row by row, of the least type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            nonlocal part
            t = pa.Table.from_batches(held).combine_chunks()
            ids, x = t.column(0).to_numpy(), dense(t.column(1).combine_chunks())
            least, most = int(x.min(initial=0)), int(x.max(initial=0))
            kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
            held.clear()
            part += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part - 1]),
                    pa.array([ids.astype("<i8").tobytes()]),
                    pa.array([kind]),
                    pa.array([x.shape[1]], pa.int32()),
                    pa.array([x.astype(kind).tobytes()]),
                ],
                names=["part", "ids", "kind", "width", "vectors"],
            )

        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == rows:
                    yield out()
                    n = 0
        if n:
            yield out()

    return df.mapInArrow(run, BLOB)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of some blobs together."""
    width = max(t.column("width").to_pylist())
    ids, xs = [], []
    for i, k, w, v in zip(*(t.column(c).to_pylist() for c in ("ids", "kind", "width", "vectors")), strict=True):
        xs.append(widened(np.frombuffer(v, k).reshape(-1, w), width))
        ids.append(np.frombuffer(i, "<i8"))
    return np.concatenate(ids), np.concatenate(xs)


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest type in which all inner products of q and x are exact."""
    size = lambda v: max(-int(v.min(initial=0)), int(v.max(initial=0)))
    most = size(q) * size(x) * x.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def lowest(kind: type):
    return np.iinfo(np.int64).min if kind is np.int64 else -np.inf


class Ranges:
    """Candidates in an order that brings like ones together, cut into ranges, with each range's extremes by term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind: type, pivots: np.ndarray, block: int = BLOCK) -> None:
        like = x.astype(np.float64) @ widened(pivots, x.shape[1]).astype(np.float64).T if len(pivots) else np.zeros((len(x), 1))
        near = like.argmax(axis=1)
        order = np.lexsort((ids, -like[np.arange(len(x)), near], near))
        self.ids, self.x, self.kind, self.block = ids[order], x[order].astype(kind), kind, block
        self.edges = np.arange(0, len(x), block)
        self.top, self.low = np.maximum.reduceat(self.x, self.edges), np.minimum.reduceat(self.x, self.edges)
        self.by_id = np.argsort(self.ids, kind="stable")

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query the ids and scores of its k best rows, best first, none below its floor; and how many
        (query, range) were scored."""
        x, edges, block, none = self.x, self.edges, self.block, lowest(self.kind)
        bound = np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.low.T
        scores = np.full((len(q), len(x)), none, self.kind)
        visit = np.argsort(-bound, axis=1, kind="stable")
        rank = np.empty_like(visit)
        np.put_along_axis(rank, visit, np.arange(visit.shape[1])[None, :], axis=1)
        kth, done = floor.copy(), 0
        wave = max(-(-k // block), -(-len(edges) // 8))
        a, b = (np.searchsorted(self.ids[self.by_id], q_ids, side) for side in ("left", "right"))
        for first in range(0, len(edges), wave):
            due = (rank >= first) & (rank < first + wave) & (bound >= kth[:, None])
            if not due.any():
                continue
            for j in np.flatnonzero(due.any(axis=0)):
                rows = np.flatnonzero(due[:, j])
                scores[rows, edges[j] : edges[j] + block] = q[rows] @ x[edges[j] : edges[j] + block].T
            done += int(due.sum())
            for r in np.flatnonzero(b > a):
                scores[r, self.by_id[a[r] : b[r]]] = none
            if len(x) > k:
                kth = np.maximum(kth, np.partition(scores, len(x) - k, axis=1)[:, len(x) - k])
        out_i, out_s = [], []
        for r in range(len(q)):
            got = np.flatnonzero((scores[r] >= kth[r]) & (scores[r] > none))
            own = scores[r][got]
            own = np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in own], np.int64) if self.kind is object else own.astype(np.int64)
            order = np.lexsort((self.ids[got], ~own))[:k]
            out_i.append(self.ids[got[order]])
            out_s.append(own[order])
        return out_i, out_s, done


def best_of(
    q_ids: np.ndarray,
    q: np.ndarray,
    ids: np.ndarray,
    x: np.ndarray,
    k: int,
    seed: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, ids and scores of the k best rows of x for each query, and how many (query, range) were scored."""
    width = max(q.shape[1], x.shape[1], seed[1].shape[1])
    q, x, s = widened(q, width), widened(x, width), widened(seed[1], width)
    kind = exact_kind(q, np.concatenate([x, s]))
    none = lowest(kind)
    ranges = [Ranges(ids[a : a + SLICE], x[a : a + SLICE], kind, s[:PIVOTS]) for a in range(0, len(ids), SLICE)]
    s = s.astype(kind)
    out: list[list] = [[], [], []]
    scored = 0
    for a in range(0, len(q), STEP):
        own, some = q_ids[a : a + STEP], q[a : a + STEP].astype(kind)
        first = some @ s.T if len(s) else np.zeros((len(some), 0), kind)
        first[own[:, None] == seed[0][None, :]] = none
        floor = np.partition(first, len(s) - k, axis=1)[:, len(s) - k] if len(s) >= k else np.full(len(some), none, kind)
        held: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(some)
        for r in ranges:
            found, scores, n = r.best(own, some, k, floor)
            scored += n
            for i in range(len(some)):
                if len(found[i]):
                    both = [np.concatenate(c) for c in zip(held[i], (found[i], scores[i]), strict=True)]
                    order = np.lexsort((both[0], ~both[1]))[:k]
                    held[i] = (both[0][order], both[1][order])
                    if len(order) == k and kind is not object:
                        floor[i] = max(floor[i], held[i][1][-1])
        out[0].append(np.repeat(own, [len(h[0]) for h in held]))
        out[1] += [h[0] for h in held]
        out[2] += [h[1] for h in held]
    return *(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out), scored


def search(queries: DataFrame, rows: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query, all if there are fewer."""
    picked = lambda df: df.where(F.col(id_col).isNotNull() & sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), weights(F.col(vector_col), scale).alias("v"))
    mine, theirs = picked(queries).distinct(), picked(rows)
    every = max(1, theirs.count() // SEED)
    drawn = theirs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * SEED).toArrow()
    ids, vectors = drawn.column(0).to_numpy(), dense(drawn.column(1).combine_chunks())
    order = np.lexsort((*vectors.T[::-1], ids))
    seed = (ids[order], vectors[order])
    q = blobs(mine, CHUNK)
    x = blobs(theirs, CHUNK)
    n_q, n_x = q.count(), x.count()  # of blobs
    batches = max(1, -(-n_q * CHUNK // BATCH))
    spread = -(-2 * queries.sparkSession.sparkContext.defaultParallelism // batches)
    groups = max(1, -(-n_x * CHUNK // GROUP), min(n_x, spread))
    # explicit units: a batch of queries is sent to every group, a group to every batch
    q = q.withColumn("q", F.pmod(F.xxhash64("part"), F.lit(batches))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    x = x.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")).withColumn(
        "q",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))),
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            found = best_of(*unpacked(left), *unpacked(right), k, seed)[:3]
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    near = q.groupBy("q", "g").cogroup(x.groupBy("q", "g")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows.where("vec_id % 20 = 0"), rows)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
