"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is a position: its embedding goes through one GRU from the left and one from the right, and
a linear layer labels the position from both states. A document's probabilities are the softmax of the mean of its
positions' log-probabilities, times SHARPNESS. Texts are cut into segments of SEGMENT bytes in which both directions
begin afresh, so any text is read whole in bounded memory, segments side by side in one matrix. Runs of digits,
signs and white space are masked as byte 32 before, and ASCII letters are lowered.

Training is plain numpy: backpropagation through time over both directions, Adam, on at most SAMPLE labelled
documents (those of least hash of their id), of each PER_DOCUMENT segments from places anywhere in its text. This
sample is the only bound.

A null text, or one without a letter, is "und" with score 0. A null or empty label is not learned. With no labelled
rows at all every text is "und". Repeated rows are labelled each; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineamark.llm.shared import free_name, least_hashed, small_batches
from lineamark.llm.spans import LOWER, lean, pieces, text_bytes

#: Labelled documents to learn from, segments of each, epochs.
SAMPLE, PER_DOCUMENT, EPOCHS = 3000, 1, 6
SEGMENT, WARM = 96, 4
HIDDEN = 8
SHARPNESS = 12.0
UNKNOWN = "und"

CLEAN = LOWER.copy()
CLEAN[: 0x80][~np.isin(np.arange(0x80), [*range(65, 91), *range(97, 123)])] = 32


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


class Network:
    """Weights: for each direction x, u (from byte and state to the gates update and reset and the candidate) and b; out, bias."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w[d + "x"] = (r.normal(size=(256, 3 * hidden)) * 0.3).astype(np.float32)
            self.w[d + "u"] = (r.normal(size=(hidden, 3 * hidden)) / hidden**0.5).astype(np.float32)
            self.w[d + "b"] = np.zeros(3 * hidden, np.float32)
        self.w["out"] = (r.normal(size=(2 * hidden, n_labels)) / hidden**0.5).astype(np.float32)
        self.w["bias"] = np.zeros(n_labels, np.float32)

    def states(self, d: str, codes: np.ndarray, keep: bool = False):
        """States after each step of codes (steps x segments); with keep, what backpropagation needs too."""
        h, steps, m = self.h, len(codes), codes.shape[1]
        x, u = self.w[d + "x"] + self.w[d + "b"], self.w[d + "u"]
        half = np.float32(0.5)  # sigmoid(a) = 0.5 + 0.5 * tanh(a / 2)
        xs = [np.ascontiguousarray(x[:, k * h : k * h + h]) * (half if k < 2 else 1) for k in range(3)]
        us = [np.ascontiguousarray(u[:, k * h : k * h + h]) * (half if k < 2 else 1) for k in range(3)]
        out = np.empty((steps, m, h), np.float32)
        kept = []
        s = np.zeros((m, h), np.float32)
        for t in range(steps):
            code = codes[t]
            z, r, c = (x.take(code, axis=0) for x in xs)
            for g, u in ((z, us[0]), (r, us[1])):
                g += s @ u
                np.tanh(g, out=g)
                g *= half
                g += half
            c += (r * s) @ us[2]
            np.tanh(c, out=c)
            if keep:
                kept.append((s, z, r, c))
            move = c - s
            move *= z
            s = np.add(s, move, out=out[t])
        return (out, kept) if keep else out

    def labels(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities for every position: labels x steps x segments."""
        h = self.h
        f = self.states("f", codes).reshape(-1, h)
        b = self.states("b", codes[::-1])[::-1].reshape(-1, h)
        o = self.w["out"][:h].T @ f.T
        o += self.w["out"][h:].T @ b.T
        o += self.w["bias"][:, None]
        o -= o.max(axis=0)
        o -= np.log(np.exp(o).sum(axis=0))
        return o.reshape(-1, *codes.shape)

    def backward(self, d: str, codes: np.ndarray, kept: list, grad: np.ndarray, g: dict) -> None:
        h, u = self.h, self.w[d + "u"]
        ds = np.zeros_like(grad[0])
        gx, gu = np.zeros((256, 3 * h), np.float32), np.zeros_like(u)
        for t in range(len(codes) - 1, -1, -1):
            s, z, r, c = kept[t]
            ds = ds + grad[t]
            da = np.empty((len(s), 3 * h), np.float32)
            da[:, :h] = ds * (c - s) * z * (1 - z)
            da[:, 2 * h :] = ds * z * (1 - c * c)
            drs = da[:, 2 * h :] @ u[:, 2 * h :].T
            da[:, h : 2 * h] = drs * s * r * (1 - r)
            ds = ds * (1 - z) + drs * r + da[:, : 2 * h] @ u[:, : 2 * h].T
            gu[:, : 2 * h] += s.T @ da[:, : 2 * h]
            gu[:, 2 * h :] += (r * s).T @ da[:, 2 * h :]
            np.add.at(gx, codes[t], da)
        g[d + "x"], g[d + "u"], g[d + "b"] = gx, gu, gx.sum(axis=0)

    def step(self, codes: np.ndarray, y: np.ndarray, mask: np.ndarray, adam: dict, rate: float) -> float:
        h = self.h
        f, fk = self.states("f", codes, True)
        b, bk = self.states("b", codes[::-1], True)
        both = np.concatenate([f, b[::-1]], axis=2)
        o = both @ self.w["out"] + self.w["bias"]
        o -= o.max(axis=2, keepdims=True)
        p = np.exp(o)
        p /= p.sum(axis=2, keepdims=True)
        n = max(1, mask.sum())
        loss = -float((np.log(p[:, np.arange(len(y)), y] + 1e-9) * mask).sum() / n)
        do = p
        do[:, np.arange(len(y)), y] -= 1
        do *= (mask / n)[:, :, None]
        g = {"out": both.reshape(-1, 2 * h).T @ do.reshape(-1, do.shape[2]), "bias": do.sum(axis=(0, 1))}
        db = do @ self.w["out"].T
        self.backward("f", codes, fk, db[:, :, :h], g)
        self.backward("b", codes[::-1], bk, db[::-1, :, h:], g)
        adam["t"] += 1
        for k, v in g.items():
            m, s = adam.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
            adam[k] = (m, s)
            self.w[k] = (self.w[k] - rate * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(s / (1 - 0.99 ** adam["t"])) + 1e-8)).astype(np.float32)
        return loss


def segments(data: np.ndarray, rows: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (size x segments), length of each segment, and its row."""
    lens = rows[1:] - rows[:-1]
    count = -(-lens // size)
    row = np.repeat(np.arange(len(lens)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = rows[:-1][row] + nth * size
    length = np.minimum(size, rows[1:][row] - begin)
    at = begin[None, :] + np.arange(size)[:, None]
    codes = np.where(
        np.arange(size)[:, None] < length[None, :],
        CLEAN[data[np.minimum(at, max(0, len(data) - 1))]],
        32,
    ) if len(row) else np.zeros((size, 0), np.uint8)
    return codes, length, row


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Learn from PER_DOCUMENT segments of each text, drawn from all of it; gives {"labels", "w"}."""
    r = np.random.default_rng(seed)
    parts = []
    for t in texts:
        b = (t or "").encode()
        starts = [int(r.integers(0, max(1, len(b) - SEGMENT))) for _ in range(PER_DOCUMENT if len(b) > SEGMENT else 1)]
        parts.append([b[a : a + SEGMENT] for a in starts])
    return fit(parts, langs, epochs, r)


def fit(drawn: list[list[bytes]], langs: list[str], epochs: int, r: np.random.Generator) -> dict:
    """Learn from the segments drawn from each document."""
    labels = sorted(set(langs))
    net = Network(len(labels))
    parts = [p for some in drawn for p in some]
    y = [labels.index(lang) for some, lang in zip(drawn, langs, strict=True) for _ in some]
    if len(labels) > 1:
        data = np.frombuffer(b"".join(parts), np.uint8)
        codes, length, row = segments(data, np.append(0, np.cumsum([len(p) for p in parts])))
        y = np.array(y)[row]
        share = np.bincount(y, minlength=len(labels))
        weight = len(y) / np.maximum(1, share)[y] / len(labels)
        mask = (np.arange(SEGMENT)[:, None] < length[None, :]) & (codes != 32)
        adam = {"t": 0}
        for e in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), 128):
                k = order[i : i + 128]
                net.step(codes[:, k], y[k], (mask[:, k] * weight[k]).astype(np.float32), adam, 0.02 if e < epochs - 2 else 0.006)
    return {"labels": labels, "w": net.w}


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Train on the labelled rows of docs: at most sample of them, of least hash of their id.

    Segments are drawn from whole texts on the executors, at places by hash of the id; only they go to the driver.
    """
    rows = docs.where(
        F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull()
    )
    i, b = F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary")
    more = F.greatest(F.lit(0), F.octet_length(b) - SEGMENT)
    drawn = F.array(
        *(F.substring(b, (F.pmod(F.xxhash64(F.lit("segment"), F.lit(k), i), more + 1) + 1).cast("int"), SEGMENT) for k in range(PER_DOCUMENT))
    )
    keyed = rows.select(
        F.xxhash64(i).alias("h"),
        i.alias("i"),
        F.when(more > 0, drawn).otherwise(F.slice(drawn, 1, 1)).alias("t"),
        F.col(lang_col).alias("l"),
    )
    # ids are picked first, so that a task sends the driver no segments but those that are learned; at most sample ids
    picked = least_hashed(keyed.select("h", "i").distinct(), sample)
    got = keyed.join(F.broadcast(picked), ["h", "i"], "left_semi").orderBy("h", "i", "t").limit(sample).collect()
    return fit([[bytes(p) for p in r["t"]] for r in got], [r["l"] for r in got], EPOCHS, np.random.default_rng(7))


class Predictor:
    def __init__(self, model: dict) -> None:
        self.labels = model["labels"]
        self.net = Network(max(1, len(self.labels)))
        self.net.w = model["w"]

    def __call__(self, col: pa.Array, at_once: int = 1024) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UNKNOWN] * len(col), [0.0] * len(col)
        data, rows = text_bytes(col)
        n = len(rows) - 1
        total = np.zeros((n, len(self.labels)))
        seen = np.zeros(n)
        if len(data):
            lens = rows[1:] - rows[:-1]
            edge = np.append(0, np.cumsum(-(-lens // SEGMENT)))
            first = 0
            while first < n:  # rows with about at_once segments; a longer text is cut by bytes below
                last = max(first + 1, int(np.searchsorted(edge, edge[first] + at_once, "right")) - 1)
                for a in range(int(rows[first]), int(rows[last]) or 1, SEGMENT * at_once) if last == first + 1 else [None]:
                    if a is None:
                        codes, length, row = segments(data, rows[first : last + 1])
                    else:
                        codes, length, row = segments(data, np.array([a, min(rows[last], a + SEGMENT * at_once)]))
                    if not len(row):
                        continue
                    p = self.net.labels(codes)
                    use = (np.arange(SEGMENT)[:, None] < length[None, :]) & (codes != 32)
                    p *= use
                    at = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
                    total[first + row[at]] += np.add.reduceat(p.sum(axis=1).astype(np.float64), at, axis=1).T
                    seen[first + row[at]] += np.add.reduceat(use.sum(axis=0), at)
                first = last
        mean = total / np.maximum(1, seen)[:, None] * SHARPNESS
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        # letters beyond ASCII make bytes over 0x7F; only rows without ASCII letters need to be looked at
        known = np.zeros(n, bool)
        ascii_letter = np.append(0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122)))
        known |= ascii_letter[rows[1:]] > ascii_letter[rows[:-1]]
        for r in np.flatnonzero(~known):
            known[r] = has_letter(col[int(r)].as_py())
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(p[r, b]) if known[r] else 0.0 for r, b in enumerate(best)]


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (with underscores where docs has such names)."""
    small_batches(docs.sparkSession)
    names = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    text = docs.columns.index(text_col)
    plain = docs.withColumn(text_col, F.col(text_col).cast("string"))
    columns = plain.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model)
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                lang, score = predict(part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*columns, *names],
                )

    schema = T.StructType([*plain.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return plain.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, model: dict, least: float = 0.5, **how) -> DataFrame:
    """The rows of docs in a language that is known, with at least so much probability."""
    found = identify(docs, model, **how)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
