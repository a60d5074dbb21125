"""Joins of suspects with evidence by hash, by tag and by SimHash distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineamark.functions.text import hamming, marked, normalized_sha, sha, tag_id, watermark_id
from lineamark.tables import written


#: Bits from which SimHash values are compared in blocks; values of a block of either side.
FLIPPED, LEFT, RIGHT = 8, 512, 32_768


def evidence_of(docs: DataFrame, key: str, text: str, url: Column) -> DataFrame:
    """A row for each document: tag, hashes before and after marking, plain and of the normal form."""
    t, tag = F.col(text), watermark_id(F.col(key))
    after = marked(t, tag, url)
    return docs.select(
        F.col(key).alias("artifact_id"),
        tag.alias("watermark_id"),
        sha(t).alias("hash_before"),
        sha(after).alias("hash_after"),
        normalized_sha(t).alias("norm_before"),
        normalized_sha(after).alias("norm_after"),
    )


def hashes_of(suspects: DataFrame) -> DataFrame:
    """suspect_id, family (raw, norm), hash."""
    return suspects.select(
        "suspect_id",
        F.inline(
            F.array(
                F.struct(F.lit("raw").alias("family"), sha(F.col("text")).alias("hash")),
                F.struct(F.lit("norm").alias("family"), normalized_sha(F.col("text")).alias("hash")),
            )
        ),
    )


def exact_matches(suspects: DataFrame, evidence: DataFrame) -> DataFrame:
    """suspect_id, artifact_id, how (after, before, normalized), confidence: the best evidence for each suspect.

    Evidence keeps one artifact for each hash before the join, so copies don't multiply.
    """
    kinds = [
        ("after", "hash_after", "raw", 1.0),
        ("before", "hash_before", "raw", 1.0),
        ("normalized", "norm_after", "norm", 0.95),
        ("normalized", "norm_before", "norm", 0.95),
    ]
    keys = evidence.select("artifact_id", F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(k).alias("how"), F.col(c).alias("hash"), F.lit(w).alias("confidence"), F.lit(i).alias("place")) for i, (k, c, f, w) in enumerate(kinds)))))
    keys = keys.where("hash is not null").groupBy("family", "hash").agg(F.min(F.struct("place", "artifact_id", "how", "confidence")).alias("e"))
    mine = hashes_of(suspects)
    return mine.join(keys, ["family", "hash"]).groupBy("suspect_id").agg(F.min("e").alias("e")).select(
        "suspect_id",
        "e.artifact_id",
        "e.how",
        "e.confidence",
    )


def tag_matches(suspects: DataFrame, evidence: DataFrame) -> DataFrame:
    """suspect_id, watermark_id, artifact_id (null for a foreign tag): suspects that carry a tag."""
    tagged = suspects.select("suspect_id", tag_id(F.col("text")).alias("watermark_id")).where("watermark_id is not null")
    return tagged.join(
        evidence.groupBy("watermark_id").agg(F.min("artifact_id").alias("artifact_id")),
        "watermark_id",
        "left",
    ).select("suspect_id", "watermark_id", "artifact_id")


def flips(width: int, radius: int) -> list[int]:
    """All masks of width bits with at most radius ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def bands(value: Column, k: int, side: int) -> Column:
    """Keys of 64 bits such that values within distance k share one, if the one has side 0 and the other side 1.

    The bits are cut into bands, of which one differs in at most k // bands bits. Up to 7 bits there are k + 1 bands,
    which agree in one; beyond, 4, and each side flips its half of the bits that may differ, in all ways.
    """
    n = k + 1 if k < 8 else 4
    radius = k // n
    own = (radius + 1 - side) // 2
    edges = [64 * i // n for i in range(n + 1)]
    keys = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(value, a).bitwiseAND((1 << (b - a)) - 1).bitwiseXOR(mask).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for mask in flips(b - a, own)]
    return F.array(*keys)


def near_simhashes(left: DataFrame, right: DataFrame, k: int, half: bool = False) -> DataFrame:
    """a, b, distance: distinct values of left (column simhash) and right within k bits; with half, only those of a < b.

    Values, not rows, meet: copies share a value and are joined back by it. Up to 7 bits they meet on bands; beyond,
    flipped bands bring so many together that all values are compared in blocks, which leave nothing but the matches.
    """
    if not 0 <= k < 32:
        raise ValueError("k must be from 0 to 31")
    a, b = (df.select("simhash").where("simhash is not null").distinct() for df in (left, right))
    if k >= FLIPPED:
        return compared(a, b, k, half)
    a, b = (df.select(F.col("simhash"), F.inline(bands(F.col("simhash"), k, side))) for side, df in enumerate((a, b)))
    near = a.withColumnRenamed("simhash", "a").join(b.withColumnRenamed("simhash", "b"), ["band", "bits"])
    if half:
        near = near.where("a < b")
    return near.withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= k).select("a", "b", "distance").distinct()


def packed(values: DataFrame, name: str, size: int) -> DataFrame:
    """Values (simhash) in order, size of them to a row, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        for at in range(0, len(own), size):
            yield pa.RecordBatch.from_arrays([pa.array([own[at : at + size].tobytes()], pa.binary())], names=[name])

    return values.sort("simhash").mapInArrow(run, f"{name} binary")


def compared(left: DataFrame, right: DataFrame, k: int, half: bool) -> DataFrame:
    """a, b, distance: all pairs of values (simhash) of left and right within k bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                u, v = (np.frombuffer(c.as_py(), np.int64) for c in (x, y))
                if half:
                    v = v[np.searchsorted(v, u[0], "right") :]
                for at in range(0, len(u) if len(v) else 0, 32):
                    w = u[at : at + 32, None]
                    d = np.bitwise_count((w ^ v[None, :]).view(np.uint64))
                    near = np.flatnonzero((d <= k) & (w < v[None, :]) if half else d <= k)
                    if len(near):
                        i, j = np.divmod(near, len(v))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(w[i, 0]), pa.array(v[j]), pa.array(d.ravel()[near].astype(np.int32))],
                            names=["a", "b", "distance"],
                        )

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed(left, "x", LEFT).repartition(parts).crossJoin(packed(right, "y", RIGHT).repartition(1))
    return pairs.mapInArrow(run, "a long, b long, distance int")


def simhash_matches(suspects: DataFrame, evidence: DataFrame, k: int = 25, first: int = 10) -> DataFrame:
    """suspect_id, artifact_id, distance: nearest evidence within k bits. Both have simhash; evidence of one value counts
    by its least id. Values with a neighbour within first bits are done by bands; what is left is compared in blocks,
    whose work grows with the number of values left times that of the evidence. Values and near pairs are written, so that
    texts are hashed and values compared once."""
    best = evidence.where("simhash is not null").groupBy("simhash").agg(F.min("artifact_id").alias("artifact_id"))
    best, suspects = written(best, "evidence-values"), written(suspects.select("suspect_id", "simhash"), "suspect-values")
    near = written(near_simhashes(suspects, best, min(k, first)), "near-values")
    near = near.groupBy("a").agg(F.min("distance").alias("distance")).join(near, ["a", "distance"])
    if k > first:
        left = written(
            suspects.where("simhash is not null").select("simhash").distinct().join(
                near.select(F.col("a").alias("simhash")),
                "simhash",
                "left_anti",
            ),
            "far-values",
        )
        near = near.select("a", "b", "distance").unionByName(blocked_distances(left, best.select("simhash"), k))
    found = suspects.join(near, suspects["simhash"] == near["a"]).join(best.withColumnRenamed("simhash", "b"), "b")
    return found.groupBy("suspect_id").agg(F.min(F.struct("distance", "artifact_id")).alias("m")).select("suspect_id", "m.artifact_id", "m.distance")


def blocked_distances(left: DataFrame, right: DataFrame, k: int, most: int = 200_000) -> DataFrame:
    """a, b, distance for the nearest b of each a within k bits, in blocks by blocks of about most values at most; 8 blocks at least."""
    size = lambda df: df.agg(F.count("*").alias("n")).scalar()
    parts = F.greatest(F.lit(8), F.ceil(size(left) / most), F.ceil(size(right) / most)).cast("int")
    block = lambda c: F.pmod(F.xxhash64(c), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    a = left.select("simhash").withColumn("p", block("simhash")).withColumn("q", every)
    b = right.select("simhash").withColumn("q", block("simhash")).withColumn("p", every)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        u, v = x.column("simhash").to_numpy(), np.sort(y.column("simhash").to_numpy())
        out: list[list] = [[], [], []]
        step = max(1, (1 << 22) // max(1, len(v)))
        for at in range(0, len(u) if len(v) else 0, step):
            d = np.bitwise_count((u[at : at + step, None] ^ v[None, :]).view(np.uint64))
            best = d.min(axis=1)
            i, j = np.nonzero((d == best[:, None]) & (best <= k)[:, None])
            for c, w in zip(out, (u[at : at + step][i], v[j], best[i]), strict=True):
                c.append(w)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["a", "b", "distance"])

    return a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInArrow(run, "a long, b long, distance long")
