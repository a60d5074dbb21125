"""The queries of this package: with SQL against DuckDB, others against plain Python, all on small tables with odd rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

from lineamark.llm import langid, pii, quality_model, quality_rules, sharding, warc
from lineamark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    mine, theirs, differ = compare(QUERIES[name](spark, SF), SQL[name], SF)
    assert not differ and mine == theirs


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, repeats; and one of empty tables."""
    folders = []
    for name, keep in (("odd", True), ("none", False)):
        at = tmp_path_factory.mktemp(name)
        text = "The river runs past the old mill. Mr. John Smith wrote to a@corp.io about it.\nOne line more of words here."
        docs = [
            (None, "some text without id", "en", "s"),
            (1, None, None, None),
            (2, "", "en", "s"),
            (3, text, "en", "s"),
            (3, text, "en", "s"),
            (4, text + " end", "", None),
            (5, "word " * 60_000, "de", "s"),
            (6, "日本 語 " * 50, "ja", "s"),
            (7, "a" * 300_000, None, "s"),
        ]
        labels = [(3, 1), (3, 0), (4, None), (5, 0), (None, 1), (99, 1)]
        vectors = [
            (0, [0.5, 0.25], 1),
            (20, [0.5, 0.25], 1),
            (20, None, None),
            (None, [1.0, 1.0], 1),
            (7, [float("nan"), 1.0], 2),
            (8, [0.1, None], 2),
        ]
        pages = [
            (1, "http://a", "<p>x</p>", 200),
            (1, "http://a", "<p>x</p>", 200),
            (2, None, "<p>x</p>", None),
            (3, "u", None, 0),
            (4, "u", "", 0),
            (None, "u", "<p>x</p>", 0),
        ]
        for table, rows, schema in (
            ("documents", docs, [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]),
            ("labels", labels, [("doc_id", pa.int64()), ("quality", pa.int64())]),
            ("embeddings", vectors, [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int64())]),
            ("pages", pages, [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("status", pa.int64())]),
        ):
            rows = rows if keep else []
            pq.write_table(
                pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema]),
                f"{at}/{table}.parquet",
            )
        folders.append(str(at))
    return folders


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd[0]).collect()
    n = {"op2_top_k": 2, "op9_warc": 6}.get(name, 9)
    assert len(rows) == n if name != "op1_pack" else len({r["doc_id"] for r in rows}) == 8
    assert QUERIES[name](spark, odd[1]).count() == 0


def test_quality_is_held_out(spark):
    """Accuracy on rows that are not learned from; labels that repeat and that are null."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, sf).collect()}
    assert all(r["held_out"] == out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    test = [i for i in got if out(i) and labels.get(i) is not None]
    assert np.mean([(got[i]["score"] >= 0.5) == (labels[i] == 1) for i in test]) > 0.9
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 7 + 1), "x") for i in range(200)], "doc_id long, text string, score string")
    marks = spark.createDataFrame(
        [(i, i % 2) for i in range(100)] * 2 + [(i, None) for i in range(100, 200)] + [(0, 1), (1, 0)],
        "doc_id long, quality long",
    )
    twice = quality_model.learn(docs, marks)
    once = quality_model.learn(docs, spark.createDataFrame([(i, 0 if i == 1 else i % 2) for i in range(100)], "doc_id long, quality long"))
    assert all(np.array_equal(twice[k], once[k]) for k in twice)
    assert {r["score"] for r in quality_model.score(docs, quality_model.learn(docs, marks.limit(0))).collect()} == {0.5}


def test_trees_against_a_plain_walk():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(500, 4)), r.integers(0, 2, 500).astype(float)
    m = quality_model.grow(x, y, trees=12)

    def walk(row):
        total = m["base"]
        for at in m["roots"]:
            while m["left"][at] != at:
                at = m["left"][at] if row[m["feature"][at]] <= m["threshold"][at] else m["right"][at]
            total += m["value"][at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(quality_model.predict(m, x), [walk(v) for v in x])


def test_languages_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, sf).collect()}
    assert set(got) == set(langs) and all(r["held_out"] == out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in got if out(i) and langs[i]]) > 0.95


def test_table_is_refilled():
    """The lookup table against turns taken with plain sets."""
    shards, size = tuple(f"s{k}" for k in range(7)), 251
    order = []
    for s in shards:
        start, skip = sharding.hashed(s, "offset") % size, sharding.hashed(s, "skip") % (size - 1) + 1
        order.append([(start + i * skip) % size for i in range(size)])
        assert sorted(order[-1]) == list(range(size))
    owner, turn = {}, 0
    while len(owner) < size:
        slot = next(x for x in order[turn % 7] if x not in owner)
        owner[slot] = turn % 7
        turn += 1
    assert sharding.lookup_table(shards, size) == [owner[x] for x in range(size)]


def test_archives_of_the_query(spark):
    """Digests, sizes and revisits from the pages alone; and again where equal payloads aren't broadcast."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    first = {}
    rows = sorted((r["page_id"], (r["html"] or "").encode()) for r in pages.collect())
    for i, b in rows:
        first.setdefault(b, i)
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in rows}
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op9_warc"](spark, SF).collect()}
    assert got == want
    folder = warc.new_path(spark, "test-archives")
    again = warc.read(spark, folder, warc.write(pages, folder, told=0)).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in again} == want


def naive_language(model, text):
    """The network, a position at a time: label and score of a text."""
    w, h = {k: v.astype(np.float64) for k, v in model["w"].items()}, langid.HIDDEN
    data = [langid.CLEAN[b] for b in text.encode()]
    total, n = np.zeros(len(model["labels"])), 0

    def states(d, codes):
        s, all_s = np.zeros(h), []
        for c in codes:
            a = w[d + "x"][c] + w[d + "b"]
            z, r = (1 / (1 + np.exp(-(a[k * h : k * h + h] + s @ w[d + "u"][:, k * h : k * h + h]))) for k in (0, 1))
            new = np.tanh(a[2 * h :] + (r * s) @ w[d + "u"][:, 2 * h :])
            s = s + z * (new - s)
            all_s.append(s)
        return all_s

    for a in range(0, len(data), langid.SEGMENT):
        part = data[a : a + langid.SEGMENT]
        codes = part + [32] * (langid.SEGMENT - len(part))
        for c, f, b in zip(part, states("f", codes), states("b", codes[::-1])[::-1], strict=False):
            if c != 32:
                o = f @ w["out"][:h] + b @ w["out"][h:] + w["bias"]
                total += o - o.max() - np.log(np.exp(o - o.max()).sum())
                n += 1
    p = np.exp((m := total / max(1, n) * langid.SHARPNESS) - m.max())
    p /= p.sum()
    return model["labels"][int(p.argmax())], float(p.max())


def test_pipeline_against_plain_python(spark):
    from test_llm import brute_components
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.learn(docs)
    found = {i: naive_language(model, r["text"]) if any(c.isalpha() for c in r["text"] or "") else ("und", 0.0) for i, r in rows.items()}
    known = {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5}
    # quality rules: base rules, then lines of more than so many distinct texts of their source
    lines = {
        i: [
            " ".join(w.lower() for w in x.split()) for x in re.sub("[\x1c-\x1f\x85\xa0]", "_", rows[i]["text"]).split("\n") if x.split()
        ] for i in known
    }
    having = collections.defaultdict(set)
    for i in known:
        for x in lines[i]:
            having[rows[i]["source"], x].add(tuple(lines[i]))
    good = set()
    for i in known:
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"])
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        twice = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        left = len(w) - sum(len(x.split()) for x in lines[i] if len(having[rows[i]["source"], x]) > quality_rules.LINE_LIMIT)
        if len(w) >= 20 and 100 * len(twice) <= 30 * len(w) and left >= 5 and left >= 0.2 * len(w):
            good.add(i)
    links = brute_components([(i, rows[i]["text"]) for i in sorted(good)], 5, 80)
    kept = {i for i in good if links[i][1] == i}
    made = pii.Surrogates(pii.KEY)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(pii.surrogated(rows[i]["text"], made)[0], add_special_tokens=False).ids, 1] for i in kept}
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == kept and 100 < len(kept) < len(rows)
    for i, some in pieces.items():
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            ids = want[i][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want[i]) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r["length"]
        assert at == len(want[i])
    assert all(sum(n for _, n in s) <= 2048 for s in seqs.values())
