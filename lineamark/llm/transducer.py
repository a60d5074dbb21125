"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

From the merge list alone, lookaheads() computes for each token how many symbols from its begin decide it, whatever
follows them. Every word goes through a transducer that holds a window of symbols: the window's merges are done, tokens
whose lookahead lies within the window are stable and leave, and more symbols come in. The rest of a word is merged as
if it stood alone, since no merge crosses a token's edge. So a window has at most BLOCK symbols and the largest
lookahead, however long the word. Text comes in runs of bounded length; a word may go on from run to run. Words that
recur in a batch pass the transducer once and are remembered, within a number of bytes.

A null text is the empty text: no ids, the empty string. Texts of white space alone have no ids either. Special
tokens in a text become their ids, as the library does by default. Ids of rows may be null; other columns are ignored.
"""

from __future__ import annotations

import bisect
import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.llm.shared import small_batches
from lineamark.llm.spans import LOWER, encoded, lean, pieces, release, text_bytes

#: Bytes of words, ids and texts that a worker remembers, about; longer words aren't remembered.
REMEMBERED, LONG = 48_000_000, 256
#: Characters of text that are normalised and cut at a time; symbols between two passes of merges.
RUN, BLOCK = 1 << 16, 48


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    own = set(shown)
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def lookaheads(merges: list[tuple[str, str]], length) -> dict[str, int]:
    """For each token, how many symbols from its begin decide it, whatever follows them.

    A symbol formed or waiting at the right edge of a token can be lost to a neighbour only by a merge of lower
    rank; the neighbour must itself be formed before, which asks the same of what follows it. reach(x, t) bounds
    this for symbol x up to rank t; ranks fall along the chain, so rules are taken in rising rank.
    """
    formed = {a + b: (k, b) for k, (a, b) in enumerate(merges)}
    ranks: dict[str, list[int]] = {}  # for each left part: ranks of its rules, and the largest reach of these up to there
    reaches: dict[str, list[int]] = {}

    def reach(x: str, t: int) -> int:
        most, s = 0, x
        while True:
            if s in ranks and (i := bisect.bisect_left(ranks[s], t)):
                most = max(most, reaches[s][i - 1])
            if s not in formed:
                return length(x) + most
            k, s = formed[s]
            t = min(t, k)

    for k, (a, b) in enumerate(merges):
        r = reach(b, k)
        if a in ranks:
            r = max(r, reaches[a][-1])
        ranks.setdefault(a, []).append(k)
        reaches.setdefault(a, []).append(r)
    return {x: reach(x, len(merges)) for x in {*formed, *ranks}}


class Transducer:
    """Tokens of one word: feed() takes its next bytes and gives the tokens that are stable, close() gives the others."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.window, self.last = encoder, [], b""

    def feed(self, part: bytes) -> Iterator[str]:
        """The last byte is held back: it alone may bear the word's end."""
        part = self.last + part
        self.last = part[-1:]
        window, alphabet = self.window, self.encoder.alphabet
        for at in range(0, len(part) - 1, BLOCK):
            window += [alphabet[b] for b in part[at : min(at + BLOCK, len(part) - 1)]]
            if len(window) >= BLOCK:
                yield from self.stable()

    def stable(self) -> Iterator[str]:
        at, window, reach = 0, self.window, self.encoder.reach
        for t in self.encoder.merged(window[:]):
            if at + reach.get(t, 1) > len(window):
                break
            yield t
            at += len(t)
        del window[:at]

    def close(self) -> Iterator[str]:
        if self.last:
            self.window.append(self.encoder.alphabet[self.last[0]] + self.encoder.end)
            yield from self.encoder.merged(self.window)
        self.window, self.last = [], b""


@lru_cache(1)
def composing() -> frozenset[str]:
    """Characters that canonical composition may join with what stands before them."""
    seconds = {chr(int(d[1], 16)) for c in range(0x110000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<"}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def safe_cut(text: str, at: int) -> int:
    """The first place from at on where both sides can be put in normal form apart."""
    while at < len(text) and not text[at].isascii() and (unicodedata.combining(text[at]) or text[at] in composing()):
        at += 1
    return at


class Encoder:
    """Ids of words by a tokenizers file of BPE with word ends, byte-level, lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.vocab = self.vocab | self.special
        self.token = {i: t for t, i in self.vocab.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        end = self.end
        self.reach = lookaheads(merges, lambda x: len(x.removesuffix(end)) if end else len(x))
        self.space = regex.compile(r"\s+")
        # The classes of the pattern's pieces that may go on in the next run of text.
        self.going = {k: regex.compile(c) for k, c in (("letters", r"\p{L}+"), ("signs", r"[^\s\p{L}\p{N}]+"))}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges of a window, lowest rank first, leftmost first."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
        return symbols

    def word(self, word: bytes) -> list[int]:
        """Ids of a piece of the pattern, already normalised."""
        t = Transducer(self)
        return [self.vocab[x] for some in (t.feed(word), t.close()) for x in some if x in self.vocab]

    def tokens(self, text: str) -> Iterator[str]:
        """Tokens of a text without special tokens, each as soon as it is stable."""
        word, kind, held = Transducer(self), "", ""
        for run in self.runs(text):
            run, at = held + run, 0
            # an apostrophe near the end may begin a contraction
            cut = next((len(run) - k for k in (2, 1) if run[-k : len(run) - k + 1] == "'"), len(run))
            run, held = run[:cut], run[cut:]
            if kind and (m := self.going[kind].match(run)):
                yield from word.feed(m.group().encode())
                at = m.end()
            if kind and at < len(run):
                yield from word.close()
                kind = ""
            for m in self.pattern.finditer(run, at):
                yield from word.feed(m.group().encode())
                kind = next((k for k, p in self.going.items() if m.end() == len(run) and p.fullmatch(m.group())), "")
                if not kind:
                    yield from word.close()
        if held:
            if kind and (m := self.going[kind].match(held)):
                yield from word.feed(m.group().encode())
                held = held[m.end() :]
            yield from word.close()
            for m in self.pattern.finditer(held):
                yield from word.feed(m.group().encode())
                yield from word.close()
        yield from word.close()

    def runs(self, text: str) -> Iterator[str]:
        """The text in runs of about RUN characters, in normal form: composed, blanks for white space, small letters."""
        at = 0
        while at < len(text):
            stop = safe_cut(text, min(len(text), at + RUN))
            run = self.space.sub(" ", unicodedata.normalize("NFC", text[at:stop]))
            yield run.lower() if run.isascii() else "".join(c.lower() for c in run)  # each alone: no rule that looks at neighbours
            at = stop

    def stream(self, text: str | None) -> Iterator[int]:
        """Ids of a text, special tokens included, in the memory of one run and one window."""
        text, at = text or "", 0
        for s, t in sorted((m, t) for t in self.special for m in _places(text, t)):
            if s >= at:
                yield from (self.vocab[x] for x in self.tokens(text[at:s]) if x in self.vocab)
                yield self.special[t]
                at = s + len(t)
        yield from (self.vocab[x] for x in self.tokens(text[at:] if at else text) if x in self.vocab)

    def ids(self, text: str | None) -> list[int]:
        return list(self.stream(text))


def _places(text: str, t: str) -> Iterator[int]:
    at = text.find(t)
    while at >= 0:
        yield at
        at = text.find(t, at + 1)


class Decoder:
    """Text from ids, a few at a time: feed(ids) gives the text that is certain, close() what is left.

    With a byte-level decoder in the file, tokens are bytes and an incremental UTF-8 machine makes text of them,
    U+FFFD for what is no UTF-8. Without one, tokens are text, joined by spaces. Unknown ids are left out.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.token = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def raw(self, token: str) -> bytes:
        try:
            return bytes(self.byte[c] for c in token)
        except KeyError:
            return token.encode()

    def feed(self, ids: Iterable[int]) -> str:
        if not self.bytes:
            text = " ".join([t for t in map(self.token.get, ids) if t is not None])
            text, self.first = text if self.first or not text else " " + text, self.first and not text
            return text
        out = []
        for t in map(self.token.get, ids):
            if t is not None:
                out.append(self.machine.decode(self.raw(t)))
        return "".join(out)

    def close(self) -> str:
        self.first = True
        if not self.bytes:
            return ""
        rest = self.machine.decode(b"", True)
        self.machine.reset()
        return rest


class Texts:
    """ids and decoded text of whole batches; words that were seen are remembered, within a bound."""

    #: Byte classes for ASCII and the two-byte letters from U+00C0 on.
    LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 4

    def __init__(self, path: str) -> None:
        self.encoder, self.decoder = Encoder(path), Decoder(path)
        kind = np.full(256, self.OTHER, np.uint8)
        for a, b in ((65, 91), (97, 123), (0x80, 0x100)):
            kind[a:b] = self.LETTER
        kind[48:58] = self.DIGIT
        kind[9:14] = kind[32] = self.SPACE
        self.kind = kind
        odd = np.zeros(256, bool)
        odd[0x27] = odd[0xC2] = True
        odd[0xC4:0x100] = True
        self.odd = odd
        self.known: dict[bytes, tuple[str, str, int]] = {}
        self.held = 0

    def made(self, ids: list[int]) -> tuple[str, str, int]:
        """Ids and decoded text of a piece, each token followed by a space."""
        text = self.decoder.feed(ids) + self.decoder.close()
        return "".join(f"{i} " for i in ids), text + " " if ids and not self.decoder.bytes else text, len(ids)

    def __call__(self, col: pa.Array) -> tuple[list[int], list[str], list[str]]:
        data, rows = text_bytes(col)
        n = len(data)
        if not n:
            return [0] * len(col), [""] * len(col), [""] * len(col)
        odd = self.odd[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        slow = set(np.unique(np.searchsorted(rows, np.flatnonzero(odd), "right") - 1).tolist())
        raw = data.tobytes()
        for t in self.encoder.special:
            slow |= {int(np.searchsorted(rows, a, "right")) - 1 for a in _places(raw, t.encode())}
        low = LOWER[data]
        upper = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] < 0x9F)) + 1
        low[upper] += 32
        kind = self.kind[low]
        start = np.zeros(n + 1, bool)
        start[rows] = True
        start = start[:n]
        start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        cuts = np.append(np.flatnonzero(start), n)
        codes, words = encoded(low, cuts)
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        each = []
        for w in words:
            k = self.known.get(w)
            if k is None:
                if self.kind[w[0]] == self.SPACE:
                    k = ("", "", 0)
                else:
                    try:
                        w.decode()
                        k = self.made(self.encoder.word(w))
                    except UnicodeDecodeError:  # of a row that goes the other way
                        k = ("", "", 0)
                if len(w) <= LONG:
                    self.known[w] = k
                    self.held += 300 + len(w) + len(k[0]) + len(k[1])
            each.append(k)
        ids, texts, sizes = zip(*each, strict=True)
        take = pa.array(codes)
        at = np.searchsorted(cuts, rows)
        count = np.append(0, np.cumsum(np.array(sizes, np.int64)[codes]))[at]

        def joined(values) -> tuple[bytes, np.ndarray]:
            laid = pa.array(values, pa.large_string()).take(take)
            b, o = text_bytes(laid)
            return b.tobytes(), o[at]

        (ib, io), (tb, to) = joined(ids), joined(texts)
        cut = 0 if self.decoder.bytes else 1
        out_n, out_i, out_t = [], [], []
        for r in range(len(col)):
            if r in slow:
                own = self.encoder.ids(raw[rows[r] : rows[r + 1]].decode())
                i, t, k = self.made(own)
                out_n.append(k)
                out_i.append(i[:-1])
                out_t.append(t[: len(t) - cut])
            else:
                out_n.append(int(count[r + 1] - count[r]))
                out_i.append(ib[io[r] : max(io[r], io[r + 1] - 1)].decode())
                out_t.append(tb[to[r] : max(to[r], to[r + 1] - cut)].decode())
        return out_n, out_i, out_t


@lru_cache(1)
def texts_by(path: str) -> Texts:
    """A worker's own, for all its tasks."""
    made = Texts(path)
    release()
    return made


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space), decoded (the text that these ids decode to)."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = texts_by(tokenizer)
        for batch in batches:
            for part in pieces(batch, 1):
                n, ids, decoded = texts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
