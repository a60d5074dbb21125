"""Sources, sinks, streams, session functions, envelopes and zipped rows on small tables."""

import datetime
import hashlib
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineamark.functions import binary as B
from lineamark.functions import media as W
from lineamark.functions import text as T
from lineamark.functions.register import register
from lineamark.operators import envelope as S
from lineamark.operators import evidence as E
from lineamark.operators import fingerprint as P
from lineamark.plans import records as R
from lineamark.sources import store
from lineamark.sources.tables import EventTable, FragmentStore
from lineamark.streaming import tasks as K

SF = "/root/testdata/sf0.001"


def test_json_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"artifact_id": 1, "model_id": "m"}\n{"artifact_id": 2, "model')
    rows = store.read_json(spark, str(tmp_path / "in"), "artifact_id long, model_id string")
    assert [tuple(r) for r in rows.collect()] == [(1, "m")]
    store.write_json(rows, str(tmp_path / "out"))
    assert store.read_json(spark, str(tmp_path / "out"), "artifact_id long, model_id string").count() == 1
    (tmp_path / "files").mkdir()
    for k, text in enumerate(('{\n "artifact_id": 3\n}', "[broken", "")):
        (tmp_path / "files" / f"{k}.json").write_text(text)
    assert [r["artifact_id"] for r in store.read_json(spark, str(tmp_path / "files"), "artifact_id long", True).collect()] == [3]


def test_store_reads_pruned(spark, tmp_path):
    s = store.EvidenceStore(spark, str(tmp_path / "store"))
    kind = "artifact_id long, model_id string, model_version string, watermark_id string, _r long"
    s.append(spark.createDataFrame([(1, "m", "v1", "w1", 5), (2, "n", "v1", "w2", 6), (4, "m", "v1", "w4", 0), (5, "m", "v1", "w5", 0)], kind), 1)
    s.append(spark.createDataFrame([(1, "n", "v2", "w1", 7), (3, "m", "v1", "w3", 8)], kind), 2)
    assert [(r["artifact_id"], r["_r"]) for r in s.rows().orderBy("artifact_id").collect()] == [(1, 7), (2, 6), (3, 8), (4, 0), (5, 0)]
    assert sorted(r["artifact_id"] for r in s.by_model("m").collect()) == [3, 4, 5]  # artifact 1 is n's by now
    assert [r["artifact_id"] for r in s.by_model("m", "v1", 2).collect()] == [3, 4]
    assert s.get(1).first()["model_id"] == "n" and s.get(9).count() == 0
    assert "PartitionFilters: [isnotnull(model_id" in s.by_model("m")._jdf.queryExecution().toString()
    ties = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "artifact_id long, model_id string, ingested long")
    assert store.latest(ties).collect() == store.latest(ties.orderBy(F.desc("model_id"))).collect()
    left = s.delete(spark.createDataFrame([(2,)], "artifact_id long"), str(tmp_path / "left"))
    assert sorted(r["artifact_id"] for r in left.rows().collect()) == [1, 3, 4, 5]


def test_event_table(spark):
    spark.sql("drop table if exists lineamark_events")
    t, kind = EventTable(spark, "lineamark_events"), "artifact_id long, model_id string, model_version string"
    t.put(spark.createDataFrame([(1, "m", "v1"), (2, "m", "v2"), (3, "n", "v1")], kind), 1)
    t.put(spark.createDataFrame([(1, "m", "v3")], kind), 2)
    assert tuple(t.get(1, kind).first()) == (1, "m", "v3") and t.get(7, kind).count() == 0
    assert [r["artifact_id"] for r in t.by_model("m", kind).orderBy("artifact_id").collect()] == [1, 2]
    assert [r["artifact_id"] for r in t.by_model("m", kind, "v2", 1).collect()] == [2]
    spark.sql("drop table lineamark_events")


def test_fragment_store(spark, tmp_path):
    s, kind = FragmentStore(spark, str(tmp_path / "fragments")), "fragment_id string, data binary"
    s.put(spark.createDataFrame([("a/1", bytearray(b"one")), ("a/2", bytearray(b"two")), ("b/1", bytearray(b"three"))], kind), 1)
    s.put(spark.createDataFrame([("a/1", bytearray(b"new"))], kind), 2)
    assert bytes(s.get("a/1").first()["data"]) == b"new" and s.get("c").count() == 0
    s.delete(spark.createDataFrame([("a/2",)], "fragment_id string"), 3)
    assert s.get("a/2").count() == 0 and [r[0] for r in s.ids("a/").collect()] == ["a/1"] and s.ids().count() == 2


def test_session_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "some words in a text " * 30), (2, None)], "k long, t string").createOrReplaceTempView("some_texts")
    got = {r["k"]: r for r in spark.sql("select k, simhash(t) as s, minhash(t) as m, char_entropy(t) as e from some_texts").collect()}
    text = "some words in a text " * 30
    assert got[1]["s"] == P.simhash_kernel()(text) and got[1]["m"] == P.minhash_kernel()(text) and got[1]["e"] == P.char_entropy(text)
    assert got[2]["s"] == 0 and got[2]["e"] == 0 and set(got[2]["m"]) == {0}
    assert spark.sql("select f.* from some_texts, lateral fragments_of(t) f").count() == len(P.fragments_of(text))


def test_task_states(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    kind = "artifact_id string, ts timestamp, event_id long, outcome string, priority long"
    batches = [
        [("a", at(0), 1, "queued"), ("b", at(0), 2, "queued"), ("c", at(1), 3, "ok")],
        [("a", at(5), 4, "started"), ("a", at(6), 5, "error"), ("b", at(5), 6, "error"), ("b", at(6), 7, "error"), ("b", at(7), 8, "error"), ("b", at(8), 9, "error")],
        [("z", at(300), 10, "queued")],
        [("z", at(301), 11, "ok")],
    ]
    src = tmp_path / "events"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, 0) for r in rows], kind).coalesce(1).write.parquet(f"{src}/part={i}")
    stream = spark.readStream.schema(f"{kind}, part int").option("maxFilesPerTrigger", 1).parquet(str(src))
    seen = []
    q = K.task_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
        lambda df, n: seen.extend((r["artifact_id"], r["status"], r["attempts"]) for r in df.collect())
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(seen[:3]) == {("a", "pending", 0), ("b", "pending", 0), ("c", "completed", 0)}
    assert set(seen[3:5]) == {("a", "retry", 1), ("b", "failed", 4)} and ("z", "completed", 0) in seen
    assert {x for x in seen if x[1] == "expired"} == {("a", "expired", 1), ("b", "expired", 4), ("c", "expired", 0)}


def test_priority_order(spark):
    tasks = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "artifact_id string, priority long")
    assert [r["artifact_id"] for r in K.ordered(tasks).collect()] == ["c", "a", "b"]


def test_receipts_against_python(spark):
    """Canonical JSON as Python's json writes it, also for text that must be escaped."""
    rows = [("plain",), ('quote " and \\ back',), ("new\nline\ttab",), ("日本 é",), (None,)]
    d = spark.createDataFrame(rows, "b string").withColumn("n", F.lit(0.95))
    for r in d.select(
        "b",
        E.canonical(E.alphabetical(b=F.col("b"), a=F.lit(1), c=E.alphabetical(z=F.col("n"), y=F.lit(None).cast("string")))).alias("j"),
    ).collect():
        assert r["j"] == json.dumps({"b": r["b"], "a": 1, "c": {"z": 0.95, "y": None}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for r in R._records(spark, SF).limit(20).collect():
        e = r["evidence"].asDict(recursive=True)
        e.pop("fragment_set")
        assert r["receipt"] == hashlib.sha256(json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_zipped(spark):
    left, right = spark.range(1000).repartition(7), spark.range(2000, 3000).withColumnRenamed("id", "other").repartition(3)
    got = {r["id"]: (r["place"], r["other"]) for r in E.zipped(left, right, ["id"], ["other"]).collect()}
    assert got == {i: (i, 2000 + i) for i in range(1000)}
    with pytest.raises(ValueError):
        E.zipped(left, right.limit(5), ["id"], ["other"])
    assert E.zipped(left.limit(0), right.limit(0), ["id"], ["other"]).count() == 0


def test_trailers_against_bytes(spark):
    def block(j: bytes) -> bytes:
        return B.MAGIC + B.MARKER + len(j).to_bytes(4, "little") + j + B.MAGIC

    good = block(b'{"watermark_id":"w"}')
    cases = [
        b"",
        b"x",
        good,
        b"data" + good,
        b"data" + block(b'{"a":1}'),
        b"a" + good + b"b" + block(b'{"watermark_id":"v"}'),
        b"data" + good[:-1],
        b"\xff\x00" + good,
        b"data" + block(b"{broken"),
        b"x" * 30 + B.MAGIC,
        b"d" + B.MAGIC + B.MARKER + b"\xff\xff\xff\x7f" + b"{}" + B.MAGIC,
        b"d" + block(b"{}"),
    ]
    d = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i long, d binary")
    got = {
        r["i"]: r for r in d.select(
            "i",
            B.trailer_json(F.col("d")).alias("j"),
            B.trailer_id(F.col("d")).alias("w"),
            B.untagged(F.col("d")).alias("u"),
        ).collect()
    }
    assert [got[i]["w"] for i in range(len(cases))] == [None, None, "w", "w", None, "v", None, "w", None, None, None, None]
    assert [bytes(got[i]["u"]) for i in range(len(cases))] == [
        b"",
        b"x",
        b"",
        b"data",
        b"data",
        b"a" + good + b"b",
        cases[6],
        b"\xff\x00",
        cases[8],
        cases[9],
        cases[10],
        cases[11],
    ]


def test_sound(spark):
    r = np.random.default_rng(0)
    files = [None, b"no sound", b""]
    for width, channels in ((1, 1), (2, 1), (2, 2), (4, 1), (3, 1)):
        f = io.BytesIO()
        with wave.open(f, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(8000)
            w.writeframes(r.bytes(8000 * width * channels))
        files.append(f.getvalue())
    d = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "k long, d binary")
    rows = W.wav_segments(d, "k", "d", 3, 200).collect()
    assert sorted({x["k"] for x in rows}) == [3, 4, 5, 6, 7] and len(rows) == 15
    assert {x["start_ms"] for x in rows} == {250, 500, 750} and all(0 <= x["entropy"] <= 1 and 0 <= x["flatness"] <= 1 for x in rows)
    assert all(x["centroid"] == 4000 and x["entropy"] == 0.5 for x in rows if x["k"] == 7)
    with wave.open(io.BytesIO(files[4])) as w:
        w.setpos(2000)
        assert [x["sha"] for x in rows if x["k"] == 4 and x["position"] == 2000] == [hashlib.sha256(w.readframes(1600)).hexdigest()]


def test_envelopes_and_contexts(spark):
    d = spark.createDataFrame([("m", None), (None, "v")], "model_id string, model_version string")
    context = S.Context.from_environment({"AI_MODEL_ID": "x", "AI_MODEL_VERSION": "1", "USERNAME": "ann"})
    assert sorted(tuple(r) for r in S.resolved(d, context).collect()) == [("m", "1", "user:ann"), ("x", "v", "user:ann")]
    with pytest.raises(ValueError):
        S.resolved(d)
    with pytest.raises(ValueError):
        S.Context.from_environment({})
    with pytest.raises(TypeError):
        S.envelope(F.lit("h"), F.lit("t"), F.lit("s"))
    e = spark.range(1).select(
        F.to_json(S.placeholder(F.lit("t"))).alias("p"),
        S.covers(S.envelope(F.lit("h"), F.lit("t"), F.lit("s"), F.lit("k")), F.lit("h")).alias("c"),
        S.covers(S.envelope(F.lit("h"), F.lit("t")), F.lit("h")).alias("u"),
    ).first()
    assert json.loads(e["p"])["payload_hash"] == "0" * 64 and e["c"] and not e["u"]


def test_odd_texts_of_functions(spark):
    d = spark.createDataFrame(
        [(None,), ("",), ("AI Provenance Tag: wmk-1\nVerify: https://v/1\n---\n\nbody",), ("x [AI Generated: w-2] y",)],
        "t string",
    )
    t = F.col("t")
    assert [tuple(r) for r in d.select(T.tag_id(t), T.tag_url(t), T.normalized(t)).collect()][:2] == [(None, None, None), (None, None, "")]
    assert [r[0] for r in d.select(T.tag_id(t)).collect()][2:] == ["wmk-1", "w-2"]
