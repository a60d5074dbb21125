"""Cases in which an operator once did less than its whole job."""

import collections
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lineamark.llm import langid, pii, quality_rules, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_lines_in_blocks(spark):
    block = [f"shared line number {k} of the block" for k in range(20)]
    texts = ["\n".join([*block, f"own{i} words of page {i}"]) for i in range(100)]  # one block in unlike pages
    texts += ["\n".join([*block[:2], f"Rare{i % 30} line", *block[2 : 2 + i % 2]]) for i in range(60)]
    texts += ["copied words in one line\nand in one more of them"] * 60
    want = collections.defaultdict(set)
    lower = [tuple(t.lower().split("\n")) for t in texts]
    for t in lower:
        for line in t:
            want[line].add(t)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["removed_words"] for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: sum(len(x.split()) for x in t if len(want[x]) > quality_rules.LINE_LIMIT) for i, t in enumerate(lower)}
    assert got[0] == 140 and got[len(texts) - 1] == 0


def test_language_after_a_header(spark):
    """What tells the languages apart begins after 3000 characters that they share."""
    bodies = {"x": "the river and the water are in there ", "y": "wo ist das haus und wer kauft zucker "}
    body = F.when(F.col("id") % 2 == 0, F.repeat(F.lit(bodies["x"]), 300)).otherwise(F.repeat(F.lit(bodies["y"]), 300))
    docs = spark.range(1200).select(
        F.col("id").alias("doc_id"),
        F.concat(F.repeat(F.lit("same licence "), 231), body).alias("text"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("lang"),
    )
    model = langid.learn(docs)
    labels, scores = langid.Predictor(model)(pa.array([b * 20 for b in bodies.values()]))
    assert labels == ["x", "y"] and min(scores) > 0.9
    short = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "é").otherwise("zz"))
    assert langid.Predictor(langid.learn(short))(pa.array(["é", "zz"]))[0] == ["x", "y"]


def test_secrets_without_digits():
    made = pii.Surrogates("k")
    for secret in ("sk-" + "abcdefghij" * 2, "ghp_" + "Abcdefghij" * 3, "AKIA" + "ABCDEFGHIJKLMNOP"):
        out, log = pii.surrogated(f"the key {secret} is here", made)
        assert secret not in out and [e["kind"] for e in log] == ["secret"]


def test_names_without_title():
    made = pii.Surrogates("k")
    text = "Smith came. Mr. John Smith met Mrs. Zorka Brown; Smith's hat, JOHN and Zorka Brown. The smith saw Smithson and The brown dog."
    out, log = pii.surrogated(text, made)
    part = [out[e["begin"] : e["end"]] for e in log]
    given, family = part[1].split()
    zorka, brown = part[2].split()
    assert part == [family, f"{given} {family}", f"{zorka} {brown}", family, given.upper(), f"{zorka} {brown}"]
    assert given in pii.GIVEN["latin", "m"] and zorka.endswith("a") and out.endswith("The smith saw Smithson and The brown dog.")
    assert pii.surrogated("Mr. Zorka Brown", made)[0].split()[1] == zorka[:-1] + "o"
    assert "Brown" not in pii.surrogated("Mr. Zorka Brown and Mr. Zorka Li Brown Zorka Brown Li", made)[0]
    every = [made.name(f"{g},|{w} Li") for g in "mf" for w in ("Ann", "Zorka", "Annea", "Pau", "Ab", "Ác", "Кра", "Νίκ")]
    assert len(set(every)) == len(every)


def test_names_that_collide(monkeypatch):
    monkeypatch.setattr(pii.Surrogates, "name", lambda self, text: "One")
    out, log = pii.surrogated("Mr. Smith and Mr. Brown, Smith, Brown", pii.Surrogates("k"))
    part = [out[e["begin"] : e["end"]] for e in log]
    assert part[0] == part[2] != part[1] == part[3]
    kept = pii.Surrogates.email
    monkeypatch.setattr(pii.Surrogates, "email", lambda self, text: kept(self, text) if "#" in self.key else "one@x.example")
    out, log = pii.surrogated("a@b.com c@d.org a@b.com C@d.org", pii.Surrogates("k"))
    part = [out[e["begin"] : e["end"]].lower() for e in log]
    assert part[0] == part[2] != part[1] == part[3]


def test_mail_domains_stay_apart():
    made = pii.Surrogates("k")
    domains = [
        "foo.com",
        "foo.com.example",
        "foo.com.x.example",
        "foo.com.x.x.example",
        "x.example",
        "x.x.example",
        "y.example",
        "example.com",
        "foo.example.com",
        "foo.test",
        "foo.x.test",
        "FOO.com",
    ]
    text = " ".join(f"a@{d} a-b@{d} ab@{d}" for d in domains)
    out, log = pii.surrogated(text, made)
    part = [out[e["begin"] : e["end"]].lower() for e in log]
    assert len(part) == 3 * len(domains) and len(set(part)) == 3 * (len(domains) - 1)
    assert all(re.search(r"(^|[.@])(example\.com|example|test)$", p) for p in part) and ".@" not in out and "@." not in out


def test_long_runs_take_linear_time():
    began = time.time()
    made = pii.Surrogates("k")
    for run in ("a" * 1_000_000, "a@" * 200_000, "a." * 300_000, "@" + "a" * 500_000, "Mr " * 200_000, "1" * 500_000, "token " * 100_000):
        pii.surrogated(run + " a@corp.io", made)
    assert time.time() - began < 20
    begun = time.time()
    assert "a@corp.io" not in pii.surrogated("a" * 1_000_000 + " a@corp.io", made)[0] and time.time() - begun < 1


def test_cards_and_phones_are_one_to_one():
    made = pii.Surrogates("k")
    sums = lambda t: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(t)))) % 10
    cards = [c for n in range(300) for d in range(10) if sums(c := f"4{n:011d}{d}") == 0]
    new = [made.card(c) for c in cards]
    assert len(set(new)) == len(cards) == 300 and all(sums(c) == 0 and c[0] == "4" for c in new)
    numbers = [f"{a}-{b}-{n:04d}" for a in ("017", "212") for b in ("555", "556", "017") for n in range(200)]
    new = [made.phone(x) for x in numbers]
    assert len(set(new)) == len(numbers) and all((x[4:7] == "555") == (y[4:7] == "555") for x, y in zip(numbers, new, strict=True))


def test_names_begin_with_a_capital():
    made = pii.Surrogates("k")
    for text, n in (("господин сказал вчера вечером", 0), ("госпожа Анна сказала вчера", 1), ("Herr Ärger ärgert", 1), ("Mr. smith", 0)):
        out, log = pii.surrogated(text, made)
        assert len(log) == n and out.split()[-1] == (text.split()[-1])


def test_private_data_in_odd_tables(spark):
    kind = "doc_id long, text string, Entities long, entities_ string"
    rows = [(None, "mail a@b.com", 1, "x"), (1, None, 2, "y"), (1, "", 3, "z"), (1, "a@b.com " * 20_000, 4, "z")]
    out = pii.replace(spark.createDataFrame(rows, kind)).collect()
    assert len(out) == 4 and pii.replace(spark.createDataFrame([], kind)).count() == 0
    name = pii.replace(spark.createDataFrame(rows, kind)).columns[-1]
    assert name == "entities__" and sorted(len(r[name] or []) for r in out) == [0, 0, 1, 20_000]


def test_languages_without_labels(spark):
    kind = "doc_id long, text string, lang string, score long"
    docs = spark.createDataFrame([(1, "some text", None, 5), (1, "some text", "", 5), (None, None, "en", 5), (2, "", "en", 5)], kind)
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert [r["lang_pred"] for r in got] == ["und"] * 4 and {r["score_"] for r in got} == {0.0} and {r["score"] for r in got} == {5}
    assert langid.accepted(docs, langid.learn(docs)).count() == 0
    none = spark.createDataFrame([], kind)
    assert langid.identify(none, langid.learn(none)).count() == 0
    one = spark.createDataFrame([(i, "some text", "en", 0) for i in range(5)], kind)
    assert {r["lang_pred"] for r in langid.identify(one, langid.learn(one)).collect()} == {"en"}


def test_recurrent_gradients_against_differences():
    """Backpropagation through time against finite differences, in double precision."""
    r = np.random.default_rng(1)
    net = langid.Network(3, 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, y, mask = r.integers(97, 103, (6, 4)).astype(np.uint8), r.integers(0, 3, 4), np.ones((6, 4))

    def loss(w):
        other = langid.Network(3, 4)
        other.w = w
        return -float(other.labels(codes)[y, :, np.arange(4)].sum() / mask.sum())

    seen: dict = {"t": 0}
    start = {k: v.copy() for k, v in net.w.items()}
    net.step(codes, y, mask.astype(np.float32), seen, 0.0)
    for k, v in start.items():
        grad = seen[k][0] / 0.1  # the first moment after one step
        for _ in range(6):
            at = tuple(int(r.integers(0, s)) for s in v.shape)
            if k[-1:] == "x" and len(k) == 2:
                at = (int(codes[r.integers(0, 6), r.integers(0, 4)]), at[1])
            up, down = ({n: w.copy() for n, w in start.items()} for _ in range(2))
            up[k][at] += 1e-2
            down[k][at] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - grad[at]) < 2e-3, (k, at)


def test_samples_by_hash(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"), F.col("id").alias("i"))
    want = sorted((r["h"], r["i"]) for r in keys.collect())
    for n in (1, 7, 100, 400, 6000):
        assert [tuple(r) for r in shared.least_hashed(keys, n).collect()] == want[:n]
    one = keys.select(F.lit(2**62).alias("h"), "i")  # all hashes above the edge
    assert [r["i"] for r in shared.least_hashed(one, 3).collect()] == [0, 1, 2]
