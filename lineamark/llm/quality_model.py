"""Quality classifier: histogram gradient-boosted trees over document statistics.

FEATURES are statistics of one whole text; ids, labels, languages and sources never enter. Trees are grown level by
level on features cut into at most BINS quantile bins, with gradients and curvatures of the logistic loss summed by bin.
The ensemble is flattened into arrays (feature, threshold, left, right, value), which numpy walks for all rows and
trees at once. Learning takes at most SAMPLE labelled rows, those of least hash of their id: this is the only bound.

A null text is the empty text; it is scored like any other. Rows without a label (or a null one) teach nothing; with
no labelled rows all scores are 0.5, with labels of one kind all are near it. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.llm.langid import held_out
from lineamark.llm.quality_rules import text_stats
from lineamark.llm.shared import least_hashed, small_batches
from lineamark.llm.spans import lean, pieces, text_bytes, word_codes, words

#: Labelled rows to learn from.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 80, 4, 0.12, 10, 1.0
THRESHOLD = 0.7
FEATURES = (
    "words",
    "mean_word",
    "symbols",
    "dup_lines",
    "repeat_words",
    "lines",
    "words_a_line",
    "upper",
    "digits",
    "punctuation",
    "bangs",
    "pipes",
    "stops",
    "commas",
    "beyond_ascii",
    "distinct",
    "top_word",
    "twins",
    "longest_word",
    "capitals",
    "shortest_line",
    "gaps",
)


def features(col: pa.Array) -> np.ndarray:
    """Rows x FEATURES."""
    data, rows = text_bytes(col)
    n = len(rows) - 1
    out = np.zeros((n, len(FEATURES)), np.float64)
    if not len(data):
        return out
    (n_words, chars, symbols, dup, repeated), (_, sizes, at_line) = text_stats(col)
    w, size = np.maximum(n_words, 1), np.maximum(rows[1:] - rows[:-1], 1)
    n_lines = at_line[1:] - at_line[:-1]

    def share(of: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(of))
        return (sums[rows[1:]] - sums[rows[:-1]]) / size

    punct = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    begin, end, at = words(data, rows)
    codes, _ = word_codes(data, begin, end)
    row = np.repeat(np.arange(n), n_words)
    twins = np.zeros(len(codes), bool)
    if len(codes):
        twins[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    key, times = np.unique(row * np.int64(len(data) + 1) + codes, return_counts=True)
    key //= len(data) + 1
    top, longest, shortest = np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(top, key, times)
    np.maximum.at(longest, row, end - begin)
    shortest[:] = 1000
    np.minimum.at(shortest, np.repeat(np.arange(n), n_lines), sizes)
    first = data[begin] if len(begin) else np.zeros(0, np.uint8)
    count = lambda x: np.bincount(row, x, minlength=n)
    columns = [
        np.log1p(n_words),
        chars / w,
        symbols / w,
        dup / np.maximum(n_lines, 1),
        repeated / w,
        np.log1p(n_lines),
        n_words / np.maximum(n_lines, 1),
        share((data >= 65) & (data <= 90)),
        share((data >= 48) & (data <= 57)),
        share(punct[data]),
        share(data == 33),
        share(data == 124),
        share(data == 46),
        share(data == 44),
        share(data >= 128),
        np.bincount(key, minlength=n) / w,
        top / w,
        count(twins) / w,
        longest,
        count((first >= 65) & (first <= 90)) / w,
        np.minimum(shortest, 1000),
        share(np.isin(data, [9, 10, 13, 32])),
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Boosted trees on x (rows x features) and y (0 or 1), flattened."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), np.int64)
    mean = min(max(float(y.mean()) if n else 0.5, 0.01), 0.99)
    base = float(np.log(mean / (1 - mean)))
    flat: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    roots = []

    def node() -> int:
        for k in flat:
            flat[k].append(0)
        return len(flat["value"]) - 1

    score = np.full(n, base)
    places = binned + np.arange(m) * BINS
    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            after = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                flat["left"][at] = flat["right"][at] = at
                flat["value"][at] = rate * gs / (hs + RIDGE)
                if d < depth and len(rows) >= 2 * LEAST:
                    flatb = places[rows].ravel()
                    hist = [np.bincount(flatb, np.repeat(v[rows], m), m * BINS).reshape(m, BINS).cumsum(axis=1) for v in (g, h)]
                    count = np.bincount(flatb, minlength=m * BINS).reshape(m, BINS).cumsum(axis=1)
                    gl, hl = hist
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(count < LEAST) | (len(rows) - count < LEAST)] = 0
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        left = binned[rows, j] <= b
                        flat["feature"][at], flat["threshold"][at] = int(j), float(edges[j][b])
                        flat["left"][at], flat["right"][at] = node(), node()
                        after += [(flat["left"][at], rows[left]), (flat["right"][at], rows[~left])]
                        continue
                score[rows] += flat["value"][at]
            level = after
    return {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in flat.items()} | {"roots": np.array(roots, np.int64), "base": base, "depth": depth}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: all trees are walked at once, a leaf leads to itself."""
    at = np.repeat(model["roots"][None, :], len(x), axis=0)
    row = np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        at = np.where(x[row, model["feature"][at]] <= model["threshold"][at], model["left"][at], model["right"][at])
    return 1 / (1 + np.exp(-(model["base"] + model["value"][at].sum(axis=1))))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> dict:
    """Train on at most sample rows of docs that labels marks; of repeated labels of an id, the least counts."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    picked = least_hashed(marks.withColumn("h", F.xxhash64("i")), sample).drop("h")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    # the picked ids are at most sample rows of 12 bytes
    rows = texts.join(F.broadcast(picked), "i").select("i", "y", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                x = features(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "x"])

    # of repeated rows of an id no more than the sample in all
    learned = rows.mapInArrow(run, "i long, y int, x array<double>").orderBy(F.xxhash64("i"), "i", "x").limit(sample)
    got = sorted((r["i"], r["y"], tuple(r["x"])) for r in learned.collect())
    return grow(np.array([x for _, _, x in got]).reshape(len(got), len(FEATURES)), np.array([y for _, y, _ in got], np.float64))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row for each row of docs."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predict(model, features(part.column(1))))], names=["doc_id", "score"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
