"""Packing of documents into token windows by multiway number partitioning.

A document's tokens, closed by an end token, are cut into full windows; what is left over (less than a window)
is packed with the left-overs of its neighbours. Karmarkar-Karp multiway differencing merges partial partitions
with opposing imbalances, which gives windows of nearly equal sums; where one would exceed the capacity, the
number of windows rises by one and the differencing is run again. Groups have a bounded number of left-overs, so
a task's memory doesn't grow with its input, and no row leaves its partition: there is no shuffle.

Null or empty texts are a document of the end token alone. Repeated rows are packed each. A null id stays null.
An empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.llm.shared import small_batches
from lineamark.llm.spans import encoded, lean, pieces, release, text_bytes
from lineamark.llm.transducer import byte_alphabet

CAPACITY = 2048
#: Left-overs that are packed together: bounds memory; padding is about half a window for each group.
GROUP = 1024
#: Bytes of words and their ids that a worker remembers, about; longer words aren't remembered.
REMEMBERED, LONG = 16_000_000, 128
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: deal the numbered sizes into k windows with nearly equal sums.

    Each entry of the heap is a partial partition: k sums in falling order and, for each, a tree of the items in
    it. The two entries of the widest spread are merged, the largest sums of one with the smallest of the other.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    left: list[int] = [-1] * len(sizes)
    right: list[int] = [-1] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, trees = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], trees[0] = s, i
        heap.append((-s, i, sums, trees))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        b, bt = b[::-1], bt[::-1]
        trees = np.where(at < 0, bt, at)
        for i in np.flatnonzero((at >= 0) & (bt >= 0)):
            left.append(int(at[i]))
            right.append(int(bt[i]))
            trees[i] = len(left) - 1
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), count, sums, trees))
        count += 1
    windows = []
    for tree in heap[0][3] if heap else []:
        items, stack = [], [int(tree)] if tree >= 0 else []
        while stack:
            t = stack.pop()
            if left[t] < 0:
                items.append(t)
            else:
                stack += (left[t], right[t])
        windows.append(sorted(items))
    return windows


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity: as few as the sum allows, more only where differencing exceeds the capacity.

    No two sizes over half the capacity fit together, so there are as many windows at least.
    """
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        dealt = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [w for w in dealt if w]
        k += 1


class Tokens:
    """Token ids of whole texts by a byte-level BPE file, cut by its pattern, with a bounded memory of words."""

    #: The byte classes of the cutting pattern for ASCII and two-byte Latin letters.
    LETTER, DIGIT, OTHER, BLANK, SPACE = 1, 2, 3, 4, 5

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.single = None
        self.pattern = regex.compile(PATTERN)
        self.special = {t.content.encode(): np.uint32(i).tobytes() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.known = self.memory()
        kind = np.full(256, self.OTHER, np.uint8)
        for a, b in ((65, 91), (97, 123), (0x80, 0x100)):
            kind[a:b] = self.LETTER
        kind[48:58] = self.DIGIT
        kind[9:14] = self.SPACE
        kind[32] = self.BLANK
        self.kind = kind
        odd = np.zeros(256, bool)  # apostrophes may begin contractions; these lead bytes may not be letters
        odd[0x27] = True
        odd[0xC2], odd[0xC6:0x100] = True, True
        self.odd = odd

    def memory(self) -> dict[bytes, bytes]:
        """Ids of each piece that was seen, as bytes; new pieces are merged by rank.

        Where a file's ids rise with its merges, as ranks do, pieces go to a merger by rank; else to the library.
        """
        if self.single is None:
            model = json.loads(self.tok.to_str())["model"]
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [model["vocab"][a + b] for a, b in merges]
            byte = {c: b for b, c in enumerate(byte_alphabet())}
            if made == sorted(made) and not model.get("ignore_merges") and all(c in model["vocab"] for c in byte):
                import tiktoken

                joined = {a + b for a, b in merges} | set(byte)
                ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t in joined}
                self.single = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            else:
                self.single = lambda w: self.tok.encode(w.decode(), add_special_tokens=False).ids
        single = self.single

        class Memory(dict):
            held = 0

            def __missing__(self, w: bytes) -> bytes:
                ids = single(w)
                ids = struct.pack(f"<{len(ids)}I", *ids)
                if len(w) <= LONG:
                    self[w] = ids
                    self.held += 200 + len(w) + len(ids)
                return ids

        return Memory(self.special)

    def cut(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the pattern's pieces begin, and the end of the data."""
        n = len(data)
        kind = self.kind[data]
        blank = kind == self.BLANK
        kind[blank] = self.SPACE
        space = kind == self.SPACE
        head = np.zeros(n + 1, bool)
        head[rows] = True
        head = head[:n]
        start = head.copy()
        start[1:] |= kind[1:] != kind[:-1]
        start[1:] &= ~(blank[:-1] & ~space[1:]) | head[1:]  # a blank belongs to what follows it
        start[:-1] |= space[:-1] & ~space[1:] & ~head[1:]  # and so stands apart from the spaces before it
        odd = self.odd[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # multiplication and division signs
        bad = np.unique(np.searchsorted(rows, np.flatnonzero(odd), "right") - 1)
        raw = None
        if self.special:
            raw = data.tobytes()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    bad = np.union1d(bad, np.searchsorted(rows, [at], "right") - 1)
                    at = raw.find(s, at + 1)
        for r in bad:
            a, b = int(rows[r]), int(rows[r + 1])
            start[a:b] = False
            ends = a + np.cumsum([0, *self.slow((raw or data.tobytes())[a:b].decode())])
            start[ends[:-1]] = True
        return np.append(np.flatnonzero(start), n)

    def slow(self, text: str) -> list[int]:
        """Byte lengths of the pieces of a text with other letters, apostrophes or special tokens."""
        parts = [text]
        for s in (s.decode() for s in self.special):
            parts = [y for x in parts for y in ([x] if x in (s, "") else [z for w in x.split(s) for z in (s, w)][1:])]
        out = []
        for p in parts:
            out += [len(p.encode())] if p.encode() in self.special else [len(x.encode()) for x in self.pattern.findall(p)]
        return out

    def ids(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, little-endian 32-bit, and the len+1 places where rows begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(rows), np.int64)
        cuts = self.cut(data, rows)
        codes, words = encoded(data, cuts)
        if self.known.held > REMEMBERED:
            self.known = self.memory()
        each = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        begin = np.cumsum(size) - size
        lens = size[codes]
        ends = np.cumsum(lens)
        take = np.repeat(begin[codes] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
        return flat[take], np.append(0, ends)[np.searchsorted(cuts, rows)]


@lru_cache(1)
def tokens_by(path: str) -> Tokens:
    """A worker's own, for all its tasks."""
    made = Tokens(path)
    release()
    return made


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    group: int = GROUP,
) -> DataFrame:
    """One row for each piece of a document: see SCHEMA; ids holds the piece's ids as little-endian 32-bit values."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = tokens_by(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        number = 0
        out: list[list] = [[] for _ in range(7)]
        rest: list[tuple] = []
        held = 0

        def add(*row) -> None:
            nonlocal held
            held += len(row[3])
            for c, v in zip(out, row, strict=True):
                c.append(v)

        def packed() -> None:
            nonlocal number
            for w in windows_of([len(r[2]) // 4 for r in rest], capacity):
                at = 0
                for i in w:
                    doc, start, ids, total = rest[i]
                    add(doc, start, len(ids) // 4, ids, total, base + number, at)
                    at += len(ids) // 4
                number += 1
            rest.clear()

        def flushed() -> pa.RecordBatch:
            nonlocal held
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(out)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            for c in out:
                c.clear()
            held = 0
            return made

        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                ids, rows = tokens.ids(*text_bytes(part.column(1)))
                for doc, a, b in zip(part.column(0).to_pylist(), rows[:-1], rows[1:], strict=True):
                    own = ids[a:b].tobytes() + end
                    total, at = len(own) // 4, 0
                    while total - at >= capacity:
                        add(doc, at, capacity, own[4 * at : 4 * (at + capacity)], total, base + number, 0)
                        at += capacity
                        number += 1
                        if held > 1 << 22:
                            yield flushed()
                    if at < total:
                        rest.append((doc, at, own[4 * at :], total))
                    if len(rest) >= group:
                        packed()
                if held > 1 << 22:
                    yield flushed()
        packed()
        if out[0]:
            yield flushed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
