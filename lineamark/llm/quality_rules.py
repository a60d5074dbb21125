"""Quality rules with cross-document line frequency.

Base rules look at one text: its words, symbols, repeated lines and repeated 8-word windows. The method then looks
across documents: each line is normalised (ASCII lower case, words joined by one space) and hashed, distinct
documents that hold the line are counted per host, and lines in more documents than the limit are taken out. A
document that keeps less than min_share of its words, or fewer than MIN_LEFT words, is depleted and rejected.

Copies are one document here: documents of a host with the same normalised lines in the same order count once for a
line, so a much-copied text isn't taken for boilerplate. Texts that differ in any line are different documents. A
line in very many documents is one key: its rows are kept out of the shuffle (looked_up).

A null text has no words and fails the base rule of min_words. A null host is a host of its own. A null id is kept as
a row; repeated rows are judged each, and count once. Empty tables give no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.llm.shared import free_name, looked_up, small_batches, written
from lineamark.llm.spans import lean, pieces, text_bytes, word_codes, words

MIN_WORDS = 20
#: A line of more distinct documents of its host than this is boilerplate.
LINE_LIMIT = 25
#: A document must keep this share of its words.
MIN_SHARE = 0.2
#: And so many words.
MIN_LEFT = 5
WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Odd factors of the words in a window, one for each place after the first.
MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(1, WINDOW)]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run codes[begin:end], of its values in their order."""
    step = np.uint64(0x9E3779B97F4A7C15 | 1)
    n = int((end - begin).max(initial=0))
    weight = np.ones(n + 1, np.uint64)
    weight[1:] = np.multiply.accumulate(np.full(n, step, np.uint64)) if n else weight[1:]
    inside = np.arange(end.sum() - begin.sum()) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
    values = mixed(codes[np.repeat(begin, end - begin) + inside]) * weight[inside]
    sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    at = np.append(0, np.cumsum(end - begin))
    return mixed(sums[at[1:]] - sums[at[:-1]] + mixed((end - begin).astype(np.uint64)))


def before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, and how many there are."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, dtype=np.int32, out=out[1:])
    return out


def text_stats(col: pa.Array) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The columns of STATS; hashes and numbers of words of all lines that have a word, and where rows begin in them."""
    data, rows = text_bytes(col)
    n_rows = len(rows) - 1
    zero = np.zeros(n_rows, np.int64)
    lines = (np.zeros(0, np.uint64), zero[:0], np.zeros(n_rows + 1, np.int64))
    if not len(data):
        return [zero] * 5, lines
    begin, end, at = words(data, rows)
    heads = before((data & 0xC0) != 0x80)  # code points before a byte
    chars = np.append(0, np.cumsum((heads[end] - heads[begin]).astype(np.int64)))
    symbols = before(IS_SYMBOL[data])
    n_words = at[1:] - at[:-1]
    stats = [n_words, chars[at[1:]] - chars[at[:-1]], (symbols[rows[1:]] - symbols[rows[:-1]]).astype(np.int64), zero.copy(), zero.copy()]
    codes, known = word_codes(data, begin, end)
    digest = xxhash.xxh3_64_intdigest
    wide = np.array([digest(w) for w in known], np.uint64)[codes] if len(begin) else np.zeros(0, np.uint64)
    low = np.array([digest(w.lower()) for w in known], np.uint64)[codes] if len(begin) else wide
    # lines: cut at \n; exact text for repeats within a text, normalised words across texts
    cut = np.flatnonzero(data == 10)
    lines_b = np.unique(np.concatenate([rows[:-1], cut + 1]))
    lines_b = lines_b[lines_b < len(data)]
    lines_e = np.append(lines_b[1:], len(data))
    stop = np.where(data[lines_e - 1] == 10, lines_e - 1, lines_e)
    first_word, last_word = np.searchsorted(begin, lines_b), np.searchsorted(begin, lines_e)
    full = last_word > first_word
    lines_b, stop, first_word, last_word = lines_b[full], stop[full], first_word[full], last_word[full]
    line_row = np.searchsorted(rows, lines_b, "right") - 1
    line_at = np.searchsorted(line_row, np.arange(n_rows + 1))
    if len(lines_b):
        exact, _ = word_codes(data, lines_b, stop)
        hashes = run_hashes(low, first_word, last_word)
        distinct = np.unique(line_row * np.int64(len(data) + 1) + exact) // np.int64(len(data) + 1)
        stats[3] = line_at[1:] - line_at[:-1] - np.bincount(distinct, minlength=n_rows)
        lines = (hashes, last_word - first_word, line_at)
    if (n_words >= WINDOW).any():
        n = len(wide) - WINDOW + 1
        windows = wide[:n].copy()
        for k, m in enumerate(MULTIPLIERS, 1):
            windows += wide[k : n + k] * m
    for r in np.flatnonzero(n_words >= WINDOW):
        w = windows[at[r] : at[r + 1] - WINDOW + 1]
        whole = np.sort(w)
        if (whole[1:] == whole[:-1]).any():
            order = np.argsort(w, kind="stable")
            same = w[order][1:] == w[order][:-1]
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n_words[r] + 1, np.int64)
            edge[:-WINDOW] += twice
            edge[WINDOW:] -= twice
            stats[4][r] = int((np.cumsum(edge) > 0).sum())
    return stats, lines


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str, row: str) -> DataFrame:
    """A row for each document: its key, id, host, STATS, a hash of all its lines, and its distinct lines' hashes with
    their words (over all their places)."""

    def of_rows(hashes: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        whole, lines, words_in, ends = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            whole.append(xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()))
            own, place = np.unique(hashes[a:b], return_inverse=True)
            lines.append(own)
            words_in.append(np.bincount(place, sizes[a:b], len(own)).astype(np.int64))
            ends.append(ends[-1] + len(own))
        return whole, np.array(ends, np.int32), np.concatenate(lines), np.concatenate(words_in)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 3, 1 << 21):
                stats, found = text_stats(part.column(3))
                whole, ends, hashes, sizes = of_rows(*found)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype(np.int64))) for c in (hashes, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), *map(pa.array, stats), pa.array(np.array(whole, np.uint64).view(np.int64)), *lists],
                    names=names,
                )

    names = ["row", "doc_id", "host", *(s.split()[0] for s in STATS.split(", ")), "whole", "hashes", "sizes"]
    picked = docs.select(
        F.col(row).cast("string").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.col(text_col).cast("string").alias("text"),
    )
    return picked.mapInArrow(run, f"row string, doc_id long, host string, {STATS}, whole long, hashes array<long>, sizes array<long>")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = MIN_WORDS,
    line_limit: int = LINE_LIMIT,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """doc_id, STATS, base_failed, removed_words, kept: one row for each row of docs.

    Rows are told apart by their id; rows that share an id (or a null id) are told apart by a hash of their text.
    """
    small_batches(docs.sparkSession)
    key = free_name(docs, "row_key")
    docs = docs.withColumn(key, F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col, host_col).cast("string")))
    table = written(line_table(docs, id_col, text_col, host_col, key), "lines")
    host = F.coalesce("host", F.lit("\0")).alias("host")
    lines = table.select("row", host, "whole", F.explode(F.arrays_zip("hashes", "sizes")).alias("l")).select(
        "row",
        "host",
        "whole",
        F.col("l.hashes").alias("line"),
        F.col("l.sizes").alias("size"),
    )
    # documents of a line: distinct texts of a host, counted in tasks first
    counted = lines.groupBy("host", "line", "whole").agg(F.count("*").alias("rows")).groupBy("host", "line").agg(
        F.count("*").alias("n"),
        F.sum("rows").alias("rows"),
    )
    frequent = written(counted.where(F.col("n") > line_limit).select("host", "line", "rows"), "frequent-lines")
    total = table.agg(F.sum(F.size("sizes"))).first()[0] or 0
    removed = looked_up(
        lines.select("row", "host", "line", "size"),
        frequent,
        ["host", "line"],
        "rows",
        total,
    ).where("rows is not null").groupBy("row").agg(F.sum("size").alias("removed"))
    # repeated rows have one key: their lines were counted once for each
    copies = table.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    out = table.drop("hashes", "sizes", "whole").join(removed, "row", "left").join(copies, "row", "left")
    gone = (F.coalesce("removed", F.lit(0)) / F.coalesce("copies", F.lit(1))).cast("long")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        gone.alias("removed_words"),
        "row",
    ).withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT) & (left >= F.col("n_words") * min_share)).withColumnRenamed("row", "row_key")


def keep(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs."""
    key = free_name(docs, "row_key_")
    id_col, text_col, host_col = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("host_col", "source")
    good = judge(docs, **how).where("kept").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col, host_col).cast("string")))
    return keyed.join(good, key, "left_semi").select(*docs.columns)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "removed_words",
    )


#: The same in SQL, for texts with distinct ids. Words and lines are exact here, not hashed.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, host, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
normal AS (SELECT doc_id, host, list_transform(l, lambda x: array_to_string(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) AS l FROM lines),
each AS (SELECT doc_id, host, whole, line, len(string_split(line, ' ')) AS size FROM (SELECT doc_id, host, array_to_string(l, chr(10)) AS whole, unnest(l) AS line FROM normal)),
frequent AS (SELECT host, line FROM (SELECT DISTINCT host, line, whole FROM each) GROUP BY host, line HAVING count(*) > {LINE_LIMIT}),
removed AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS removed FROM each JOIN frequent USING (host, line) GROUP BY doc_id),
runs AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY doc_id),
stats AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words FROM d JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
SELECT *, NOT base_failed AND n_words - removed_words >= {MIN_LEFT} AND n_words - removed_words >= {MIN_SHARE} * n_words AS kept FROM judged
"""
