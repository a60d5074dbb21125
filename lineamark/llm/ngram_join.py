"""N-gram Jaccard self-join by PartEnum signatures.

A document's features are the hashes of its distinct word n-grams. Sets are dealt into bands by size. Two sets that
are similar enough differ in at most k features, k being that of the larger one's band, for which the smaller one is
signed too. The feature domain is cut by hash into p partitions, each of these into three parts, and a signature is
enumerated for each subset of two parts. A partition without a difference gives both sets the same three signatures, one
with a single difference the same one. So k differences leave at least 2 * p - k signatures in common, and p is chosen
so that these are more than the number t that a set may leave out. Signatures are ordered by how many sets hold them;
each set leaves out the t most frequent of its own in each band, which are the ones that common passages and parts
with few features make, and similar sets still share one.

Sets that share a signature are candidates. Their clusters are found by stars, so no pairs are emitted. A cluster's
sets meet in blocks of bounded size: all pairs of a block pair are checked exactly, 100 * common >= percent * union,
by a product of 0/1 matrices, and only a spanning forest of the links leaves the task. Components of these links
are the result. Exact copies are one set from the first count on. Equal 64-bit hashes count as equal features and sets.

Signatures of very many rows are found on a sample of about PROBE documents and split by a salt before they are
counted; what the sample misses is only not split. No result depends on it.

A null or wordless text has no features: n_shingles 0, linked with nothing. A text of fewer words than n has one
feature, the whole sequence. Rows with a null id get a null component and link nothing. Repeated rows are copies. Rows
that share an id but not their text are documents of their own; their component is named by the id. An empty table
gives no rows. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineamark.llm.components import components
from lineamark.llm.quality_rules import mixed
from lineamark.llm.shared import free_name, looked_up, remove, small_batches, written
from lineamark.llm.spans import LOWER, lean, pieces, text_bytes, word_codes, words

#: Width of a band: its largest size over its smallest.
BAND = 1.5
#: Parts of a partition, and of these in a subset: all but the one that may hold a difference.
PARTS, KEPT = 3, 2
#: Documents on which hot signatures are looked for, about; those in one of HOT_SHARE of them are split into SALTS.
PROBE, HOT_SHARE, SALTS = 8192, 128, 64
#: Sets that a task remembers to have signed.
REMEMBERED = 200_000
#: Sets, and features, that one block of a large cluster holds about.
BLOCK_SETS, BLOCK_FEATURES = 1024, 1_000_000


def shingle_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its features: sorted distinct 64-bit hashes of runs of n words, ASCII letters in lower case."""
    data, rows = text_bytes(col)
    if not len(data):
        yield from [np.zeros(0, np.uint64)] * (len(rows) - 1)
        return
    begin, end, at = words(data, rows)
    codes, known = word_codes(LOWER[data], begin, end)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in known], np.uint64)[codes] if len(begin) else np.zeros(0, np.uint64)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, n + 1)]
    size = max(0, len(hashes) - n + 1)
    runs = np.zeros(size, np.uint64)
    for k, f in enumerate(factors):
        runs += hashes[k : size + k] * f
    runs = mixed(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(runs[a : b - n + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i, f in zip(range(a, b), factors, strict=False):
                short = mixed(short + hashes[i : i + 1] * f)
            yield short
        else:
            yield np.zeros(0, np.uint64)


def set_id(features: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed value."""
    return int(np.array([xxhash.xxh3_64_intdigest(features.tobytes())], np.uint64).view(np.int64)[0])


class Bands:
    """For each band: sizes from low to high; partitions, and how many of a set's signatures may be left out."""

    def __init__(self, percent: int) -> None:
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent = percent
        self.low, self.parts, self.spare = [1], [], []
        while len(self.low) < 90:
            low = self.low[-1]
            high = max(low, ceil(low * BAND) - 1)
            k = (100 - percent) * 2 * high // (100 + percent)
            t = 2 + k // 6 if k else 0
            self.parts.append((k + t + 2) // 2 if k else 1)  # 2 * p - k > t
            self.spare.append(t)
            self.low.append(high + 1)
        self.low = self.low[:-1]

    def of(self, size: int) -> list[int]:
        """The band of a size, and all above it in which a set can be similar."""
        i = int(np.searchsorted(self.low, size, "right")) - 1
        return [i, *(j for j in range(i + 1, len(self.low)) if 100 * size >= self.percent * self.low[j])]


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's signatures as signed 64-bit values, the band in the top 7 bits below the sign."""
    out = []
    value = mixed(features ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for i in bands.of(len(features)):
        n = bands.parts[i]
        fine = PARTS if n > 1 else 1
        part = ((mixed(features + np.uint64(i + 1)) >> np.uint64(32)) * np.uint64(n * fine)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        sums = np.append(np.uint64(0), np.cumsum(value[order], dtype=np.uint64))
        at = np.append(0, np.cumsum(np.bincount(part.astype(np.int64), minlength=n * fine)))
        # a hash of each part's features in its place; a subset's is the sum of these
        each = mixed(sums[at[1:]] - sums[at[:-1]] + np.arange(1, n * fine + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, fine)
        for subset in combinations(range(fine), min(fine, KEPT)):
            out.append((mixed(each[:, list(subset)].sum(axis=1, dtype=np.uint64)) >> np.uint64(8)) | (np.uint64(i) << np.uint64(56)))
    return np.concatenate(out).view(np.int64)


def linked(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """For each set the number of the first set of its component, by links 100 * common >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    m = len(sets)
    row = np.repeat(np.arange(m), sizes)
    values, column = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True)
    times = np.bincount(column, minlength=len(values))
    kind = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64  # counts are exact in it
    common = np.zeros((m, m), kind)
    number = np.cumsum(times > 1) - 1
    use = times[column] > 1
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, columns):
        b = min(a + columns, last)
        i, j = np.searchsorted(column, [a, b])
        x = np.zeros((m, b - a), np.float32)
        x[row[i:j], column[i:j] - a] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    first = np.full(m, -1)
    for s in range(m):
        if first[s] < 0:
            reached = np.zeros(m, bool)
            reached[s] = True
            edge = reached.copy()
            while edge.any():
                new = link[edge].any(axis=0) & ~reached
                reached |= new
                edge = new
            first[reached] = s
    return first


def signed(texts: DataFrame, n: int, bands: Bands) -> DataFrame:
    """doc_id, set_id, sig of texts (doc_id, text). A task signs a set once, as far as it remembers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, 1, 1 << 21):
                row, ids, sigs = [], [], []
                for k, s in enumerate(shingle_sets(part.column(1), n)):
                    own = set_id(s)
                    if len(s) and own not in seen:
                        sigs.append(signatures(s, bands))
                        ids.append(own)
                        row.append(k)
                        seen.add(own)
                if len(seen) > REMEMBERED:
                    seen.clear()
                at = np.append(0, np.cumsum([len(s) for s in sigs])).astype(np.int32)
                values = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)],
                    names=["doc_id", "set_id", "sigs"],
                )

    return texts.mapInArrow(run, "doc_id long, set_id long, sigs array<long>").select("doc_id", "set_id", F.explode("sigs").alias("sig"))


def candidates(texts: DataFrame, n: int, bands: Bands, documents: int) -> DataFrame:
    """a, b: each set and the least set of each of its signatures, of those that it doesn't leave out."""
    probe = signed(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, documents // PROBE))) == 0), n, bands)
    # at most HOT_SHARE keys for each signature of a document, on average
    often = F.col("n") >= max(2, min(documents, PROBE) // HOT_SHARE)
    hot = written(probe.groupBy("sig").agg(F.count("*").alias("n")).where(often).select("sig"), "hot-signatures")
    salted = signed(texts, n, bands).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left")
    salt = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    salted = salted.select("set_id", "sig", salt.alias("salt"))
    by_sig = Window.partitionBy("sig", "salt")
    counted = salted.withColumns({"least": F.min("set_id").over(by_sig), "most": F.max("set_id").over(by_sig), "n": F.count("set_id").over(by_sig)})
    # hot signatures count as the most frequent, all alike; the order of signatures need only be the same for all sets
    shared = counted.where("salt > 0 or least <> most").select("set_id", "sig", F.when(F.col("salt") > 0, 1 << 40).otherwise(F.col("n")).alias("n"))
    # copies of a set become one row; then each set ranks its own signatures where they are
    band = F.shiftright("sig", 56).cast("int")
    hottest = Window.partitionBy("set_id", band).orderBy(F.desc("n"), "sig")
    spare = F.element_at(F.array(*map(F.lit, bands.spare)), band + 1)
    once = shared.repartition("set_id").groupBy("set_id", "sig").agg(F.max("n").alias("n"))
    cool = written(once.withColumn("rank", F.row_number().over(hottest)).where(F.col("rank") > spare).select("set_id", "sig"), "signatures")
    remove(hot)
    least = cool.groupBy("sig").agg(F.min("set_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    tied = looked_up(cool, least, ["sig"], "n", cool.count()).where("set_id <> least")
    found = written(tied.select(F.col("set_id").alias("a"), F.col("least").alias("b")).distinct(), "candidates")
    remove(cool)
    return found


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id, component_id (the least id that links reach), class (of sets; null without features),
    text_key (a hash of the text): one row for each row of docs."""
    small_batches(docs.sparkSession)
    bands = Bands(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.where("doc_id is not null")

    @lean
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                found = [(len(s), set_id(s)) for s in shingle_sets(part.column(1), n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64()), part.column(2)],
                    names=["doc_id", "n_shingles", "set_id", "text_key"],
                )

    table = written(
        rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(sized, "doc_id long, n_shingles long, set_id long, text_key long"),
        "sets",
    )
    near = candidates(texts, n, bands, table.count())
    clusters = components(near)
    # where all rows of a set have one id and one text, that stands for it; else the least of both
    sizes = table.where("doc_id is not null").groupBy("set_id").agg(
        F.max("n_shingles").alias("n"),
        F.min(F.struct("doc_id", "text_key")).alias("first"),
    ).select("set_id", "n", "first.doc_id", "first.text_key")
    members = written(clusters.withColumnRenamed("node", "set_id").join(sizes, "set_id"), "clusters")
    size = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_FEATURES)).cast("int").alias("k")
    sized_clusters = members.join(members.groupBy("component").agg(size), "component")
    small = sized_clusters.where("k = 1").select("set_id", F.concat(F.lit("s"), F.col("component")).alias("block"))
    # sets of a large one meet only if their sizes allow a link: those of a step of sizes and of the step below
    step = F.floor(F.log(F.col("n").cast("double")) / (log(100 / percent) * 1.0001)).cast("int") if percent < 100 else F.col("n")
    steps = sized_clusters.where("k > 1").select("component", "set_id", "n", F.explode(F.array(step, step + 1)).alias("step"))
    cut = steps.join(steps.groupBy("component", "step").agg(size), ["component", "step"]).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("k")))
    # a step of many sets has k blocks, and all pairs of these are checked
    pairs = F.expr("transform(sequence(0, k - 1), x -> concat_ws(':', component, step, least(x, own), greatest(x, own)))")
    large = cut.select("set_id", F.explode(pairs).alias("block"))
    placed = small.unionByName(large).groupBy("set_id").agg(F.collect_list("block").alias("blocks")).join(
        members.select("set_id", "doc_id", "text_key"),
        "set_id",
    )
    having = texts.withColumn("text_key", F.xxhash64("text")).join(placed, ["doc_id", "text_key"]).select("set_id", "text", "blocks")

    @lean
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                sets = [s.tobytes() for s in shingle_sets(part.column(1), n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.binary()), part.column(2)],
                    names=["set_id", "features", "blocks"],
                )

    def checked(key: tuple, got: pa.Table) -> pa.Table:
        ids, at = np.unique(got.column("set_id").to_numpy(), return_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in got.column("features").take(pa.array(at)).to_pylist()]
        first = linked(sets, percent)
        return pa.table({"a": pa.array(ids), "b": pa.array(ids[first])})

    features = having.mapInArrow(
        featured,
        "set_id long, features binary, blocks array<string>",
    ).select("set_id", "features", F.explode("blocks").alias("block"))
    links = features.groupBy("block").applyInArrow(checked, "a long, b long").where("a <> b")
    classes = components(links).withColumnRenamed("node", "set_id").withColumnRenamed("component", "class")
    least = sizes.join(classes, "set_id", "left").select("set_id", "doc_id", F.coalesce("class", "set_id").alias("class"))
    least = written(least, "classes")
    remove(members)
    remove(near)
    ids = least.groupBy("class").agg(F.min("doc_id").alias("least"))
    found = least.join(ids, "class").select("set_id", "least", "class")
    # n_shingles 0: linked with nothing, so each is its own component
    empty = F.col("n_shingles") == 0
    none = F.col("doc_id").isNull()
    return table.join(found, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        "set_id",
        F.when(none, None).when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.when(~none & ~empty, F.col("class")).alias("class"),
        "text_key",
    )


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their class: of each, the row of least id (and least hash of its text).

    Rows without features stay, one for each id and text; rows with a null id stay all.
    """
    found = join(docs, n, percent, id_col, text_col)
    key = free_name(docs, "first_text")
    own = free_name(docs, "first_id")
    first = found.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    first = first.unionByName(
        found.where("n_shingles = 0 and doc_id is not null").select("doc_id", "text_key").distinct()
    ).select(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    keyed = docs.where(F.col(id_col).isNotNull()).withColumns({own: F.col(id_col).cast("long"), key: F.xxhash64(F.col(text_col).cast("string"))})
    firsts = keyed.join(first, [own, key], "left_semi").dropDuplicates([own, key]).select(*docs.columns)
    return docs.where(F.col(id_col).isNull()).unionByName(firsts)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: The same in SQL: exact shingles, all pairs that share one, and what their links reach.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 4 THEN w ELSE list_slice(w, i, i + 3) END, ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM f x JOIN f y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""
