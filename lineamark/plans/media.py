"""Queries over sound, media ladders, signature envelopes and verification steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineamark.functions import media as W
from lineamark.functions import text as T
from lineamark.operators import envelope as S
from lineamark.operators import fingerprint as P
from lineamark.operators import verdicts as V
from lineamark.plans.queries import EVIDENCE_SQL, FRAGMENTS_SQL, TOUCHED_SQL, docs_of, evidence_of, fragments_of, fuzzy_sql, norm_sql, query, simhash_sql, table, touched_of

RATE, LENGTH = 8000, 100


@query(f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, CAST(trunc(strlen(text)::DOUBLE / {RATE} * 1000) AS BIGINT) AS whole FROM documents WHERE strlen(text) > 0),
s AS (SELECT doc_id, h, n, whole, k, CAST(trunc(whole * (k + 1)::DOUBLE / 4) AS BIGINT) AS start_ms FROM (SELECT *, unnest(range(0, 3)) AS k FROM d)),
p AS (SELECT *, CAST(trunc(start_ms::DOUBLE / 1000 * {RATE}) AS BIGINT) AS position FROM s)
SELECT doc_id, 'audio_segment_' || k || '_' || start_ms AS segment_id, start_ms, position, least({LENGTH}, whole - start_ms) AS duration_ms, sha256(unhex(substr(h, 2 * position + 1, 2 * {LENGTH * RATE // 1000}))) AS sha FROM p WHERE position < n""")
def wav_segments(spark, sf_dir):
    """Segments of texts taken as sound: their bytes are the samples of a WAV file."""
    d = docs_of(spark, sf_dir).select("doc_id", W.wav(F.col("text").cast("binary"), RATE).alias("data"))
    return W.wav_segments(d, "doc_id", "data", 3, LENGTH).select("doc_id", "segment_id", "start_ms", "position", "duration_ms", "sha")


SIGNALS_SQL = "sig AS (SELECT page_id, page_id % 7 = 0 AS a, page_id % 7 = 1 AS b, page_id % 7 = 2 AS t, page_id % 7 IN (2, 3) AS p, md5(html) AS x, CASE WHEN page_id % 7 = 4 THEN md5(html) WHEN page_id % 7 = 5 THEN substr(md5(html), 1, 26) || 'zzzzzz' ELSE reverse(md5(html)) END AS y FROM pages WHERE html IS NOT NULL)"
ALIKE_SQL = "alike AS (SELECT *, (SELECT 1 - count(*) FILTER (substr(x, i, 1) <> substr(y, i, 1))::DOUBLE / 32 FROM range(1, 33) r(i)) AS s FROM sig)"


@query(f"WITH {SIGNALS_SQL}, {ALIKE_SQL} SELECT page_id, round(CAST(CASE WHEN a THEN 1.0 WHEN b THEN 0.99 WHEN t THEN 0.9 WHEN s = 1 THEN 0.85 WHEN s >= 0.7 THEN 0.7 + (s - 0.7) * 0.5 ELSE 0.0 END AS DOUBLE), 6) AS audio, CAST(CASE WHEN a THEN 1.0 WHEN b THEN 0.99 WHEN t THEN 0.9 WHEN s = 1 THEN 0.85 WHEN p THEN 0.4 ELSE 0.0 END AS DOUBLE) AS video, CAST(CASE WHEN a THEN 1.0 WHEN b THEN 0.95 ELSE 0.0 END AS DOUBLE) AS pdf FROM alike")
def media_ladders(spark, sf_dir):
    """Verdicts on media from their stored signals: hashes, tags, perceptual hashes."""
    k, x = F.pmod(F.col("page_id"), F.lit(7)), F.md5("html")
    y = F.when(k == 4, x).when(k == 5, F.concat(F.substring(x, 1, 26), F.lit("zzzzzz"))).otherwise(F.reverse(x))
    s = table(spark, sf_dir, "pages").where("html is not null").select(
        "page_id",
        (k == 0).alias("a"),
        (k == 1).alias("b"),
        (k == 2).alias("t"),
        k.isin(2, 3).alias("p"),
        W.digit_similarity(x, y).alias("s"),
    )
    a, b, t, p, s_ = (F.col(c) for c in "abtps")
    return s.select(
        "page_id",
        F.round(W.audio_confidence(a, b, t, s_), 6).alias("audio"),
        W.video_confidence(a, b, t, s_ == 1, p).alias("video"),
        W.pdf_confidence(a, b).alias("pdf"),
    )


@query("""SELECT doc_id, '{"payload_hash":"' || sha256(text) || '","hash_algorithm":"SHA-256","signature_value":"' || CASE WHEN doc_id % 3 = 0 THEN upper(md5(text)) ELSE 'unsigned' END || '","signature_encoding":"hex","signed_at":"2024-01-02T00:00:00+00:00","metadata":{"signature_algorithm":"Ed25519","key_id":"' || CASE WHEN doc_id % 3 = 0 THEN 'key-' || source ELSE 'none' END || '","canonicalization_version":"RFC8785-like/1.0","key_backend":"kms","verification_method":"verify/v1"}}' AS envelope, doc_id % 3 = 0 AS signed FROM documents""")
def signature_envelopes(spark, sf_dir):
    k = F.col("doc_id") % 3 == 0
    signature, key = F.when(k, F.upper(F.md5("text"))).otherwise(S.UNSIGNED), F.when(k, F.concat(F.lit("key-"), "source")).otherwise(S.NO_KEY)
    e = S.envelope(T.sha(F.col("text")), F.lit("2024-01-02T00:00:00+00:00"), signature, key, "kms", "hex", method="verify/v1")
    d = docs_of(spark, sf_dir).select("doc_id", "text", e.alias("e"))
    return d.select("doc_id", F.to_json("e").alias("envelope"), S.covers(F.col("e"), T.sha(F.col("text"))).alias("signed"))


STEPS_SQL = f"""{TOUCHED_SQL}, {EVIDENCE_SQL}, {FRAGMENTS_SQL}, {simhash_sql('sh', 'touched', 'suspect_id')}, {simhash_sql('eh', 'documents', 'doc_id')},
own_f AS (SELECT doc_id || '_' || location AS fragment_id, doc_id AS artifact_id, fragment FROM frags), {fuzzy_sql('own_f', 'touched')},
found AS (SELECT suspect_id, count(*) AS matched FROM near JOIN own_f USING (fragment_id) WHERE suspect_id = artifact_id GROUP BY suspect_id),
total AS (SELECT artifact_id, count(*) AS total FROM own_f GROUP BY ALL),
sig AS (SELECT s.suspect_id, CASE WHEN sha256(s.text) = hash_after OR sha256(s.text) = hash_before THEN 1.0 WHEN sha256({norm_sql('s.text')}) IN (norm_after, norm_before) THEN 0.95 ELSE 0.0 END AS c1,
 coalesce(matched, 0) AS matched, coalesce(total, 0) AS total, bit_count(xor(sh.simhash, eh.simhash)) AS d FROM touched s JOIN evidence e ON e.artifact_id = s.suspect_id JOIN sh ON sh.suspect_id = s.suspect_id JOIN eh ON eh.doc_id = s.suspect_id LEFT JOIN found ON found.suspect_id = s.suspect_id LEFT JOIN total ON total.artifact_id = s.suspect_id),
st AS (SELECT *, CASE WHEN matched >= 2 THEN 0.999 WHEN matched = 1 THEN 0.95 ELSE 0.0 END AS c2, CASE WHEN d <= 10 THEN 0.95 WHEN d <= 15 THEN 0.85 WHEN d <= 25 THEN 0.7 ELSE 0.0 END AS c3 FROM sig)"""


@query(f"""WITH {STEPS_SQL} SELECT suspect_id, CASE WHEN c1 > 0 THEN 'exact_hash' WHEN c2 > 0 THEN 'fragments' WHEN c3 > 0 THEN 'similarity' ELSE 'no_match' END AS final_tier, c1 + c2 + c3 > 0 AS authentic, CAST(CASE WHEN c1 > 0 THEN c1 WHEN c2 > 0 THEN c2 ELSE c3 END AS DOUBLE) AS confidence, CAST(c1 AS DOUBLE) AS exact_confidence,
CAST(c2 AS DOUBLE) AS fragment_confidence, CASE WHEN total = 0 THEN 'No forensic fragments available' ELSE matched || ' of ' || total || ' fragments matched' END AS fragment_details, CAST(c3 AS DOUBLE) AS similarity_confidence, CASE WHEN d > 25 THEN 'SimHash distance too large: ' || d || ' (threshold: 25)' ELSE 'SimHash similarity: distance=' || d END AS similarity_details FROM st""")
def verify_steps(spark, sf_dir):
    """All tiers of each suspect against the artifact of its own id, whether or not an earlier one matches."""
    d = docs_of(spark, sf_dir)
    s = touched_of(d)
    hashes = P.simhash(d, "doc_id", "text").withColumnRenamed("doc_id", "artifact_id")
    rows = V.steps(s, evidence_of(d), fragments_of(d), P.simhash(s, "suspect_id", "text"), hashes)
    step = lambda i: F.col("steps")[i]
    return rows.select(
        "suspect_id",
        "final_tier",
        "authentic",
        "confidence",
        step(0)["confidence"].alias("exact_confidence"),
        step(1)["confidence"].alias("fragment_confidence"),
        step(1)["details"].alias("fragment_details"),
        step(2)["confidence"].alias("similarity_confidence"),
        F.regexp_replace(step(2)["details"], ", similarity=.*", "").alias("similarity_details"),
    )


@query(f"WITH {STEPS_SQL} SELECT suspect_id, 'Artifact ID: ' || suspect_id || chr(10) || 'Result: ' || CASE WHEN c1 + c2 + c3 > 0 THEN 'AUTHENTIC' ELSE 'NOT AUTHENTIC' END || chr(10) || 'Final Tier: ' || CASE WHEN c1 > 0 THEN 'EXACT_HASH' WHEN c2 > 0 THEN 'FRAGMENTS' WHEN c3 > 0 THEN 'SIMILARITY' ELSE 'NO_MATCH' END AS head FROM st")
def verify_report(spark, sf_dir):
    """The first lines of each suspect's report."""
    d = docs_of(spark, sf_dir)
    s = touched_of(d)
    hashes = P.simhash(d, "doc_id", "text").withColumnRenamed("doc_id", "artifact_id")
    rows = V.steps(s, evidence_of(d), fragments_of(d), P.simhash(s, "suspect_id", "text"), hashes)
    return rows.select("suspect_id", F.substring_index(V.report(), "\nOverall", 1).alias("head"))
