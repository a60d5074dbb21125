"""Matching by anchors and nearly contained fragments against plain Python, where the SQL covers a smaller job."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lineamark.operators import anchors as A
from lineamark.operators import contain as C
from lineamark.operators import fingerprint as P
from lineamark.operators import match as M
from lineamark.operators import verdicts as V
from lineamark.plans import queries as Q


def words(t):
    return [w for w in re.sub("[^a-zA-Z0-9]+", " ", t or "").lower().split() if len(w) > 1]


def zones(t):
    found = P.Anchors().of(words(t))
    return [{f["shingle"] for f in found if f["zone"] == z} for z in P.ZONES]


def compared(suspect, evidence, short):
    """Matched zones and score, or None."""
    j = [1.0 if not x and not y else len(x & y) / len(x | y) for x, y in zip(suspect, evidence, strict=True)]
    n = sum(v >= 0.4 for v in j)
    return (n, round(sum(j) / 3, 6)) if n >= (1 if short else 2) else None


def anchors_of(df):
    return A.anchor_sets(P.anchor_keys(df, "doc_id", "text"), P.anchors(df, "doc_id", "text").select(F.col("doc_id").alias("key"), "zone", "shingle"))


def test_anchor_pairs(spark):
    rng = random.Random(3)
    long = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)) for _ in range(3)]
    texts = [
        *long,
        " ".join(long[0].split()[:390]),
        " ".join(long[1].split()[-395:]),
        " ".join(long[2].split()[:450]),
        None,
        "",
        "a bc de",
        "some few words are here now",
        long[0],
    ]
    sets = anchors_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    of = {r["key"]: r["class"] for r in A.anchor_classes(sets).collect()}
    assert of == {**{i: i for i in range(10)}, 7: 6, 8: 6, 10: 0}
    met = {(r["a"], r["b"]): (r["matched_zones"], round(r["score"], 6)) for r in A.anchor_pairs(sets, sets).collect()}
    z = [zones(t) for t in texts]
    want = {(i, j): c for i in range(len(texts)) for j in range(len(texts)) if (c := compared(z[i], z[j], len(words(texts[j])) < 400))}
    assert want == {(i, j): met[of[i], of[j]] for i in of for j in of if (of[i], of[j]) in met} and (0, 3) in met and (3, 0) not in met


def test_touched_fragments(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)) for _ in range(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    touched = ["".join("#" if i % 50 == 7 else c for i, c in enumerate(t)) for t in texts]
    s = spark.createDataFrame([*enumerate(touched), (9, "unrelated words")], "suspect_id long, text string")
    f = Q.fragments_of(d)
    rolled = V.fragment_summary(C.nearly_contained(f.select("fragment_id", "fragment"), s), f).collect()
    assert sorted((r["suspect_id"], r["artifact_id"], r["matched"], r["defensibility"]) for r in rolled) == [(i, i, 3, "high") for i in range(3)]
    hashes = P.simhash(s, "suspect_id", "text"), P.simhash(d, "doc_id", "text").withColumnRenamed("doc_id", "artifact_id")
    got = {r["suspect_id"]: (r["artifact_id"], r["tier"], r["confidence"]) for r in V.cascade(s, Q.evidence_of(d), f, *hashes).collect()}
    assert {k: got[k] for k in range(3)} == {k: (k, "fragments", 0.999) for k in range(3)} and got[9][1] != "fragments"


def test_bands_of_simhashes():
    """Any two values within k bits share a key, whatever bits differ."""
    rng = random.Random(6)
    for k in (0, 1, 3, 7, 8, 10, 15, 25):
        n = k + 1 if k < 8 else 4
        edges = [64 * i // n for i in range(n + 1)]
        keys = lambda v, side: {(i, v >> a & (1 << b - a) - 1 ^ m) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for m in M.flips(b - a, (k // n + 1 - side) // 2)}
        for _ in range(20 if k < 16 else 2):
            v = rng.getrandbits(64)
            w = v ^ sum(1 << i for i in rng.sample(range(64), k))
            assert keys(v, 0) & keys(w, 1), k


def test_fingerprints_of_odd_texts(spark):
    texts = [None, "", "--", "İstanbul ẞ Σ ΑΣ K", "one", "x" * 3000 + " y", "a b " * 700_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words_in = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    mins = {r["doc_id"]: list(r["minhash"]) for r in P.minhash(d, "doc_id", "text").collect()}
    sims = {r["doc_id"]: r["simhash"] for r in P.simhash(d, "doc_id", "text").collect()}
    for i, w in enumerate(words_in):
        assert mins[i] == [min(((a * int(hashlib.md5(t.encode()).hexdigest()[:8], 16) + b) % P.PRIME for t in set(w)), default=0) for a, b in zip(*P.hash_family(128), strict=True)]
        sums = [0] * 64
        for t in w if i < 6 else []:
            h = int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
            sums = [s + (1 if h >> b & 1 else -1) for b, s in enumerate(sums)]
        assert i == 6 or sims[i] % 2**64 == sum(1 << b for b, s in enumerate(sums) if s > 0)
