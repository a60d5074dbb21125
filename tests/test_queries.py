"""Every query with SQL against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare

from lineamark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    mine, theirs, differ = compare(QUERIES[name](spark, SF), SQL[name], SF)
    assert not differ and mine == theirs


def test_fuzzy_fragments_against_all_windows(spark):
    from lineamark.operators.contain import nearly_contained

    base = "".join(f"word{i} is here " for i in range(12))
    edits = {n: base[:5] + "#" * n + base[5 + n :] for n in (0, 5, len(base) // 10 - 1, len(base) // 10 + 2)}

    def brute(f, t):
        best = max(
            ((sum(a == b for a, b in zip(f, t[i : i + len(f)], strict=False)) / len(f), -i) for i in range(len(t) - len(f) + 1)),
            default=(0, 0),
        )
        return (-best[1], best[0]) if best[0] > 0.9 else None

    f = spark.createDataFrame([(1, base)], "fragment_id long, fragment string")
    s = spark.createDataFrame([(n, "before " + t) for n, t in edits.items()], "suspect_id long, text string")
    got = {r["suspect_id"]: (r["position"], r["score"]) for r in nearly_contained(f, s).collect()}
    assert got == {n: brute(base, "before " + t) for n, t in edits.items() if brute(base, "before " + t)}


def test_fuzzy_fragments_of_touched_words(spark):
    import random

    from lineamark.operators.contain import NEAR, nearly_contained

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    frags = [" ".join(word() for _ in range(40))[:201], "q" * 40, "ab", "x", "", None, "abcdefghijk", "no inner"]

    def touched(t, k):
        out = list(t)
        for i in rng.sample(range(len(t)), min(k, len(t))):
            out[i] = "#"
        return "".join(out)

    every = "".join("#" if i % 10 == 5 and i < 200 else c for i, c in enumerate(frags[0]))  # a character in each ten
    texts = [
        "",
        None,
        "q" * 90,
        "zz " + every + " zz",
        "no in",
        "an abcdefghiXk",
        "no inner no inner",
    ] + [word() + touched(f, k) + word() for f in frags if f for k in (0, 1, 2, len(f) // 10 + 1)]

    def brute(f, t):
        found = [(sum(x == y for x, y in zip(f, t[i : i + len(f)], strict=True)) / len(f), -i) for i in range(len(t) - len(f) + 1)] if f and t else []
        return max(((v, i) for v, i in found if v > NEAR), default=None)

    f = spark.createDataFrame(list(enumerate(frags)), "fragment_id long, fragment string")
    s = spark.createDataFrame(list(enumerate(texts)), "suspect_id long, text string")
    got = {(r["fragment_id"], r["suspect_id"]): (r["score"], -r["position"]) for r in nearly_contained(f, s).collect()}
    assert got == {(i, j): b for i, x in enumerate(frags) for j, y in enumerate(texts) if (b := brute(x, y))}


def test_contained_without_inner_words(spark):
    from lineamark.operators.contain import contained

    frags = ["two words", "one", "é", "a giant of words here", "  ", "averyveryverylongsingleword"]
    texts = ["two words one", "xtwo wordsy", "é", "", None, "one  averyveryverylongsingleword é", "say a giant of words here"]
    f = spark.createDataFrame(list(enumerate(frags)), "fragment_id long, fragment string")
    s = spark.createDataFrame(list(enumerate(texts)), "suspect_id long, text string")
    got = {(r["fragment_id"], r["suspect_id"]): r["position"] for r in contained(f, s).collect()}
    assert got == {(i, j): y.find(x) for i, x in enumerate(frags) for j, y in enumerate(texts) if y and x in y}
    assert "CartesianProduct" not in contained(f, s)._jdf.queryExecution().toString()


def test_marks_come_off(spark):
    from pyspark.sql import functions as F

    from lineamark.functions.text import marked, tag_id, unmarked

    df = spark.createDataFrame([("Para one.\n\nPara two.",), ("one line",)], "t string")
    t, tag, url = F.col("t"), F.lit("wmk-1"), F.lit("https://v.example/1")
    for style, whole in (("footer", True), ("header", False), ("inline", None)):
        for r in df.select("t", marked(t, tag, url, style).alias("m")).select(
            "t",
            tag_id(F.col("m")).alias("i"),
            unmarked(F.col("m")).alias("u"),
        ).collect():
            assert r["i"] == "wmk-1"
            assert whole is None or (r["u"] == r["t"]) == whole  # a header's second line keeps it from matching


def test_store_keeps_latest(spark, tmp_path):
    from lineamark.sources.store import EvidenceStore

    store = EvidenceStore(spark, str(tmp_path / "store"))
    kind = "artifact_id long, model_id string, model_version string, watermark_id string"
    store.append(spark.createDataFrame([(1, "m", "v1", "w1"), (2, "n", "v1", "w2")], kind), 1)
    store.append(spark.createDataFrame([(1, "m", "v2", "w1")], kind), 2)
    assert [(r["artifact_id"], r["model_version"]) for r in store.rows().orderBy("artifact_id").collect()] == [(1, "v2"), (2, "v1")]
    assert store.by_model("m", "v1").count() == 0 and store.by_watermark("w2").first()["artifact_id"] == 2
    assert [r["model_id"] for r in store.models().collect()] == ["m", "n"]


def test_two_stage_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from lineamark.streaming.tasks import two_stage

    src = str(tmp_path / "src")
    spark.range(5).write.parquet(src)
    one, later = two_stage(
        spark.readStream.schema("id long").parquet(src),
        lambda d: d.withColumn("marked", F.lit(True)),
        lambda d: d.withColumn("more", F.col("id") * 2),
        str(tmp_path / "a"),
        str(tmp_path / "b"),
        str(tmp_path / "c"),
    )
    one.awaitTermination(60)
    later().awaitTermination(60)
    assert sorted(r["more"] for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [0, 2, 4, 6, 8]


def test_entry_without_llm(tmp_path):
    """The library in a copied tree without the operators for training data, their tests and the pipeline."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "lineamark", tmp_path / "lineamark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; import lineamark.plans.queries; print(len(e.queries()), len(e.oracle_sql()), *(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), str(len(SQL)), *out[2:]] and out[2:] == [q for q in QUERIES if q.startswith("op")]
