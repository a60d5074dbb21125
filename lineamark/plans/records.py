"""Queries over evidence records, their validation, binary trailers, blocks, signatures of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.functions import binary as B
from lineamark.functions import text as T
from lineamark.functions import validate as L
from lineamark.operators import evidence as E
from lineamark.operators import fingerprint as P
from lineamark.plans.queries import ANCHORS_SQL, FOOTER_SQL, FRAGMENTS_SQL, MINHASH_SQL, STOP_SQL, TAG_SQL, URL, URL_SQL, anchors_sql, docs_of, norm_sql, query, simhash_sql, table, url_of
from lineamark.streaming import tasks as K

CREATED = "2024-01-02T00:00:00+00:00"
EMPTY_ROW = "CASE WHEN {0} IS NULL THEN 'null' ELSE '\"' || {0} || '\"' END"


def json_sql(fields: dict[str, str]) -> str:
    """Canonical JSON of an object: fields hold SQL that gives JSON text."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(fields.items())) + " || '}'"


def text_sql(value: str) -> str:
    return f"coalesce('\"' || {value} || '\"', 'null')"


def record_sql(c: dict[str, str], style: str = "footer") -> str:
    """Canonical JSON of a record, from SQL of its parts (see evidence_records)."""
    t, lit = text_sql, lambda v: f"'\"{v}\"'"
    print_of = lambda algorithm, value, role, confidence: json_sql({"algorithm": lit(algorithm), "value": t(value), "role": lit(role), "confidence": f"'{confidence}'"})
    prints = f"'[' || {print_of('simhash', c['sim_before'], 'exact_content_before_watermark', 'null')} || ',' || {print_of('simhash', c['sim_after'], 'exact_content_after_watermark', 'null')} || ',' || {print_of('distinctive_anchor_v1', c['anchor_hash'], 'forensic_anchor_before_watermark', '0.95')} || ']'"
    hashes = {
        "content_hash_before_watermark": t(c["before"]),
        "content_hash_after_watermark": t(c["after"]),
        "canonical_receipt_hash": "'null'",
        "normalized_hash_before": t(c["norm_before"]),
        "normalized_hash_after": t(c["norm_after"]),
        "perceptual_hash_before": "'null'",
        "perceptual_hash_after": "'null'",
        "simhash_before": t(c["sim_before"]),
        "simhash_after": t(c["sim_after"]),
    }
    mark = {
        "watermark_id": t(c["tag"]),
        "watermark_type": lit("visible"),
        "tag_text": t(f"'AI Provenance Tag: ' || {c['tag']}"),
        "verification_url": t(c["url"]),
        "qr_payload": "'null'",
        "embed_method": lit(f"{style}_append_v1"),
        "removal_resistance": lit("low"),
        "location": lit(style),
    }
    meta = {
        "distribution_state": lit("watermarked"),
        "artifact_format_version": lit("1.0"),
        "watermark_style": lit(style),
        "text_length_before": c["length_before"],
        "text_length_after": c["length_after"],
    }
    return json_sql({
        "artifact_id": t(c["artifact_id"]), "artifact_type": lit("text"), "mime_type": lit("text/plain"), "created_at": lit(CREATED), "model_id": t(c["model"]), "model_version": t(c["version"]), "actor_id": t(c["actor"]), "prompt_hash": t(c["prompt_hash"]),
        "output_hash_raw": t(c["before"]), "output_hash_distributed": t(c["after"]), "watermark": json_sql(mark), "hashes": json_sql(hashes), "fingerprints": prints, "metadata": json_sql(meta), "prior_receipt_hash": "'null'",
    })


def uuid_sql(salt: str, key: str) -> str:
    h = f"md5('{salt}' || {key})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def hex_sql(simhash: str) -> str:
    return f"printf('%016x', {simhash})"


def anchor_hash(df: DataFrame, key: str) -> DataFrame:
    """key, anchor_hash: of the anchors' text in their order."""
    found = P.anchors(df, key, "text").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("zone", "rank", "shingle"))).alias("a"))
    return found.select(key, T.sha(F.array_join(F.transform("a", lambda x: F.concat(x["zone"], F.lit(":"), x["shingle"])), "|")).alias("anchor_hash"))


def simhashes(df: DataFrame, key: str, marked) -> DataFrame:
    """key, before, after: SimHash as hex of texts and of marked texts."""
    before, after = P.simhash(df, key, "text"), P.simhash(df.select(key, marked.alias("text")), key, "text")
    return before.select(key, E.hex_of(F.col("simhash")).alias("before")).join(after.select(key, E.hex_of(F.col("simhash")).alias("after")), key)


def fragment_sets(df: DataFrame, key: str) -> DataFrame:
    """key, fragments: fragment_id and entropy of each, in the order of the ids."""
    index = F.when(F.col("location") == "beginning", 0).when(F.col("location") == "middle", 1).otherwise(2)
    each = P.fragments(df, key, "text").select(
        key,
        F.concat(F.lit("frag_"), index.cast("string"), F.lit("_"), F.col("location")).alias("fragment_id"),
        "entropy",
    )
    return each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("fragment_id", "entropy"))).alias("fragments"))


RECORD = record_sql(
    {
        "artifact_id": "aid",
        "tag": "tag",
        "url": "url",
        "model": "source",
        "version": "lang",
        "actor": "'user:' || (doc_id % 10)",
        "before": "b",
        "after": "a",
        "norm_before": "nb",
        "norm_after": "na",
        "prompt_hash": "ph",
        "sim_before": "sb",
        "sim_after": "sa",
        "anchor_hash": "ah",
        "length_before": "length(text)",
        "length_after": "length(m)",
    }
)
RECORDS_SQL = f"""marked AS (SELECT doc_id, text AS raw, {FOOTER_SQL} AS text FROM documents), {simhash_sql('s0', 'documents', 'doc_id')}, {simhash_sql('s1', 'marked', 'doc_id')}, {ANCHORS_SQL},
ahash AS (SELECT k, sha256(string_agg(zone || ':' || shingle, '|' ORDER BY zone, rank)) AS ah FROM anc GROUP BY k),
parts AS (SELECT d.doc_id AS doc_id, source, lang, d.text AS text, x.text AS m, {uuid_sql('artifact:', 'd.doc_id')} AS aid, {TAG_SQL.replace('doc_id', 'd.doc_id')} AS tag, {URL_SQL.replace('doc_id', 'd.doc_id')} AS url, sha256(d.text) AS b, sha256(x.text) AS a, sha256({norm_sql('d.text')}) AS nb, sha256({norm_sql('x.text')}) AS na,
 sha256('Write text ' || d.doc_id) AS ph, {hex_sql('s0.simhash')} AS sb, {hex_sql('s1.simhash')} AS sa, ah FROM documents d JOIN marked x ON x.doc_id = d.doc_id JOIN s0 ON s0.doc_id = d.doc_id JOIN s1 ON s1.doc_id = d.doc_id LEFT JOIN ahash ON ahash.k = d.doc_id)"""


def _records(spark, sf_dir) -> DataFrame:
    d = docs_of(spark, sf_dir)
    key = F.col("doc_id")
    marked = T.marked(F.col("text"), T.watermark_id(key), url_of())
    return E.evidence_records(
        d,
        simhashes(d, "doc_id", marked),
        anchor_hash(d, "doc_id"),
        fragment_sets(d, "doc_id"),
        "doc_id",
        "text",
        T.uuid_of(key, "artifact:"),
        F.concat(F.lit("Write text "), key.cast("string")),
        url_of(),
        F.col("source"),
        F.col("lang"),
        F.concat(F.lit("user:"), F.pmod(key, F.lit(10)).cast("string")),
        F.lit(CREATED),
    )


@query(f"WITH {RECORDS_SQL}, {FRAGMENTS_SQL}, fc AS (SELECT doc_id, count(*) AS n FROM frags GROUP BY doc_id) SELECT doc_id, aid AS artifact_id, tag AS watermark_id, a AS output_hash_distributed, sb AS simhash_before, sa AS simhash_after, ah AS anchor_hash, coalesce(n, 0) AS fragment_count, sha256({RECORD}) AS receipt FROM parts LEFT JOIN fc USING (doc_id)")
def evidence_rows(spark, sf_dir):
    """Whole evidence records; the receipt covers all their fields."""
    e = F.col("evidence")
    return _records(spark, sf_dir).select(
        "doc_id",
        e["artifact_id"].alias("artifact_id"),
        e["watermark"]["watermark_id"].alias("watermark_id"),
        e["output_hash_distributed"].alias("output_hash_distributed"),
        e["hashes"]["simhash_before"].alias("simhash_before"),
        e["hashes"]["simhash_after"].alias("simhash_after"),
        e["fingerprints"][2]["value"].alias("anchor_hash"),
        F.coalesce(e["fragment_set"]["fragment_count"], F.lit(0)).cast("long").alias("fragment_count"),
        "receipt",
    )


@query(f"WITH {RECORDS_SQL} SELECT doc_id, sha256({RECORD}) AS receipt, lag(sha256({RECORD})) OVER (PARTITION BY source, lang, doc_id // 100 ORDER BY doc_id) AS prior_receipt FROM parts")
def receipt_chain(spark, sf_dir):
    """Each record's receipt and that of the record before it, in runs of a model's artifacts."""
    r = _records(spark, sf_dir).select(
        "doc_id",
        F.col("evidence.model_id").alias("model"),
        F.col("evidence.model_version").alias("version"),
        F.floor(F.col("doc_id") / 100).alias("run"),
        "receipt",
    )
    return K.previous(
        r.withColumn("chain", F.concat_ws("/", "model", "version", "run")),
        "chain",
        ["doc_id"],
        "receipt",
    ).select("doc_id", "receipt", "prior_receipt")


# --- validation of whole records

#: How records are spoiled, by doc_id: an id that is no UUID, a foreign date, an empty and a short hash, a wrong tag, bad fragments.
SPOILED_SQL = f"""spoiled AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'art-' || doc_id ELSE {uuid_sql('artifact:', 'doc_id')} END AS aid,
 CASE doc_id % 6 WHEN 0 THEN '2024-13-01' WHEN 1 THEN '' ELSE '{CREATED}' END AS created, CASE WHEN doc_id % 4 = 0 THEN '' ELSE sha256('Write text ' || doc_id) END AS ph, CASE WHEN doc_id % 9 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS b, CASE WHEN doc_id % 10 = 3 THEN '' ELSE sha256({FOOTER_SQL}) END AS a,
 CASE WHEN doc_id % 7 = 2 THEN 'wmk-6ba7b810-9dad-11d1-80b4-00c04fd430c8' WHEN doc_id % 7 = 3 THEN 'mark' ELSE {TAG_SQL} END AS tag, CASE WHEN doc_id % 2 = 0 THEN 'signed' ELSE '' END AS signature FROM documents),
fragset AS (SELECT doc_id, list({{'id': CASE WHEN doc_id % 3 = 0 AND location = 'end' THEN 'text_frag_end_1' ELSE 'frag_' || CASE location WHEN 'beginning' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END || '_' || location END, 'e': CASE WHEN doc_id % 8 = 1 THEN 2.0 ELSE 0.5 END}} ORDER BY location) AS f FROM frags GROUP BY doc_id),
fragcount AS (SELECT doc_id, f, CASE WHEN doc_id % 11 = 0 THEN 5 ELSE len(f) END AS declared, CASE WHEN doc_id % 13 = 0 THEN 1.5 ELSE 0.6 END AS threshold FROM fragset)"""
HASH_ERR = "CASE WHEN {0} = '' THEN 'hash cannot be empty' WHEN length({0}) <> 64 THEN 'SHA-256 hash must be 64 characters, got ' || length({0}) WHEN NOT regexp_matches({0}, '^[0-9a-f]{{64}}$') THEN 'SHA-256 hash must be lowercase hex' END"
ID_ERR = f"CASE WHEN aid = '' THEN 'artifact_id cannot be empty' WHEN NOT regexp_matches(aid, '(?i){T.UUID4}') THEN 'artifact_id must be valid UUID v4' END"
TAG_ERR = f"CASE WHEN tag = '' THEN 'watermark_id cannot be empty' WHEN NOT starts_with(tag, 'wmk-') THEN 'watermark_id must start with ''wmk-''' WHEN NOT regexp_matches(substr(tag, 5), '(?i){T.UUID}') THEN 'watermark_id must be wmk-{{valid-uuid}}' END"
TIME_ERR = "CASE WHEN created = '' THEN 'timestamp cannot be empty' WHEN TRY_CAST(created AS TIMESTAMPTZ) IS NULL THEN 'Invalid ISO 8601 timestamp' END"
FRAG_ERRS = """list_concat(list_filter([CASE WHEN declared <> len(f) THEN 'fragment_count mismatch: declared ' || declared || ', actual ' || len(f) END, CASE WHEN threshold > 1 THEN 'min_entropy_threshold must be 0.0-1.0, got ' || threshold END], lambda x: x IS NOT NULL),
 flatten(list_transform(f, lambda x: list_filter(['fragment ' || x.id || ': ' || CASE WHEN NOT starts_with(x.id, 'frag_') THEN 'fragment_id must start with ''frag_''' WHEN NOT regexp_matches(x.id, '(?i)^frag_\\d+_[a-z_]+$') THEN 'fragment_id must follow pattern: frag_{index}_{location}' END, 'fragment ' || x.id || ': ' || CASE WHEN x.e > 1 THEN 'entropy_score must be between 0.0 and 1.0, got ' || x.e END], lambda y: y IS NOT NULL))))""".replace("\\\\", "\\")
JUDGED_SQL = f"""{FRAGMENTS_SQL}, {SPOILED_SQL}, judged AS (SELECT s.*, f IS NOT NULL AS has_fragments, {ID_ERR} AS id_err, {TIME_ERR} AS time_err, {TAG_ERR} AS tag_err,
 list_concat(list_filter(['artifact_id: ' || {ID_ERR}, 'created_at: ' || {TIME_ERR}, 'prompt_hash: ' || {HASH_ERR.format('ph')}, 'output_hash_raw: ' || {HASH_ERR.format('b')}, 'output_hash_distributed: ' || {HASH_ERR.format('a')}, 'hashes.content_hash_before_watermark: ' || {HASH_ERR.format('b')}, 'hashes.content_hash_after_watermark: ' || {HASH_ERR.format('a')}, 'watermark.watermark_id: ' || {TAG_ERR}], lambda x: x IS NOT NULL),
 CASE WHEN f IS NULL THEN [] ELSE {FRAG_ERRS} END) AS errors FROM spoiled s LEFT JOIN fragcount USING (doc_id))"""


def _spoiled(spark, sf_dir) -> DataFrame:
    """doc_id, source, evidence, signature: records with faults by doc_id."""
    d, k, t = docs_of(spark, sf_dir), F.col("doc_id"), F.col("text")
    tag = T.watermark_id(k)
    index = F.when(F.col("location") == "beginning", "0").when(F.col("location") == "middle", "1").otherwise("2")
    own = F.when(
        (k % 3 == 0) & (F.col("location") == "end"),
        "text_frag_end_1",
    ).otherwise(F.concat(F.lit("frag_"), index, F.lit("_"), F.col("location")))
    each = P.fragments(d, "doc_id", "text").select(
        "doc_id",
        "location",
        own.alias("fragment_id"),
        F.when(k % 8 == 1, 2.0).otherwise(0.5).alias("entropy"),
    )
    sets = each.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("location", "fragment_id", "entropy"))),
            lambda x: F.struct(x["fragment_id"].alias("fragment_id"), x["entropy"].alias("entropy")),
        ).alias("fragments")
    )
    sets = sets.select(
        "doc_id",
        F.struct(
            F.when(k % 11 == 0, 5).otherwise(F.size("fragments")).alias("fragment_count"),
            F.when(k % 13 == 0, 1.5).otherwise(0.6).alias("min_entropy_threshold"),
            "fragments",
        ).alias("fragment_set"),
    )
    raw = F.when(k % 9 == 0, F.upper(T.sha(t))).otherwise(T.sha(t))
    after = F.when(k % 10 == 3, "").otherwise(T.sha(T.marked(t, tag, url_of())))
    rows = d.select(
        "doc_id", "source", F.when(k % 5 == 0, F.concat(F.lit("art-"), k.cast("string"))).otherwise(T.uuid_of(k, "artifact:")).alias("artifact_id"), F.when(k % 6 == 0, "2024-13-01").when(k % 6 == 1, "").otherwise(CREATED).alias("created_at"),
        F.when(k % 4 == 0, "").otherwise(T.sha(F.concat(F.lit("Write text "), k.cast("string")))).alias("prompt_hash"), raw.alias("b"), after.alias("a"),
        F.when(k % 7 == 2, "wmk-6ba7b810-9dad-11d1-80b4-00c04fd430c8").when(k % 7 == 3, "mark").otherwise(tag).alias("tag"), F.when(k % 2 == 0, "signed").otherwise("").alias("signature"),
    ).join(sets, "doc_id", "left")
    record = F.struct(
        "artifact_id",
        "created_at",
        "prompt_hash",
        F.col("b").alias("output_hash_raw"),
        F.col("a").alias("output_hash_distributed"),
        F.struct(F.col("b").alias("content_hash_before_watermark"), F.col("a").alias("content_hash_after_watermark")).alias("hashes"),
        F.struct(F.col("tag").alias("watermark_id")).alias("watermark"),
        "fragment_set",
    )
    return rows.select("doc_id", "source", record.alias("evidence"), "signature")


@query(f"WITH {JUDGED_SQL} SELECT doc_id, aid AS artifact_id, len(errors) = 0 AS is_compliant, CAST(len(errors) AS BIGINT) AS error_count, array_to_string(errors, '; ') AS errors, id_err IS NULL AS artifact_id_format, tag_err IS NULL AS watermark_id_format, time_err IS NULL AS timestamp_format, b <> '' AND a <> '' AS dual_state_hashes_present, has_fragments AS forensic_fragments_present, signature <> '' AS signature_present FROM judged")
def compliance_report(spark, sf_dir):
    """All errors of each record and the six checks."""
    r = _spoiled(spark, sf_dir).select("doc_id", L.compliance(F.col("evidence"), F.col("signature")).alias("r"))
    return r.select(
        "doc_id",
        "r.artifact_id",
        "r.is_compliant",
        F.col("r.error_count").cast("long").alias("error_count"),
        F.array_join("r.errors", "; ").alias("errors"),
        "r.checks.*",
    )


@query(f"WITH {JUDGED_SQL} SELECT source, count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid, CAST(sum(len(errors)) AS BIGINT) AS errors FROM judged GROUP BY source")
def validation_batch(spark, sf_dir):
    n = F.size(L.evidence_errors(F.col("evidence")))
    each = _spoiled(spark, sf_dir).select("source", n.alias("e"))
    return each.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("e") == 0).alias("valid"),
        F.count_if(F.col("e") > 0).alias("invalid"),
        F.sum("e").alias("errors"),
    )


@query(f"WITH {JUDGED_SQL} SELECT aid AS artifact_id, string_agg(array_to_string(errors, '; '), ' / ' ORDER BY doc_id) AS errors FROM judged WHERE len(errors) > 0 GROUP BY aid")
def validation_errors(spark, sf_dir):
    """The map from ids to errors, as a table: only of records that have some."""
    each = _spoiled(spark, sf_dir).select(
        "doc_id",
        F.col("evidence.artifact_id").alias("artifact_id"),
        L.evidence_errors(F.col("evidence")).alias("e"),
    ).where(F.size("e") > 0)
    return each.groupBy("artifact_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.array_join("e", "; ").alias("t")))), lambda x: x["t"]),
            " / ",
        ).alias("errors")
    )


@query(f"WITH {FRAGMENTS_SQL}, {SPOILED_SQL} SELECT doc_id, array_to_string({FRAG_ERRS}, '; ') AS errors FROM fragcount")
def validate_fragments(spark, sf_dir):
    s = F.col("evidence.fragment_set")
    sets = _spoiled(spark, sf_dir).where(s.isNotNull())
    return sets.select(
        "doc_id",
        F.array_join(L.fragment_set_errors(s["fragment_count"], s["min_entropy_threshold"], s["fragments"]), "; ").alias("errors"),
    )


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'mark' ELSE {TAG_SQL} END AS tag, CASE doc_id % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'qr_code' ELSE 'ink' END AS kind, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'low' WHEN 3 THEN 'high' ELSE 'none' END AS r FROM documents) SELECT doc_id, array_to_string(list_filter(['watermark_id: ' || {TAG_ERR}, CASE WHEN kind = 'ink' THEN 'watermark_type must be WatermarkType enum' END, CASE WHEN r = 'none' THEN 'removal_resistance must be one of [''low'', ''medium'', ''high''], got none' END], lambda x: x IS NOT NULL), '; ') AS errors FROM t")
def validate_descriptors(spark, sf_dir):
    k = F.col("doc_id")
    tag = F.when(k % 4 == 1, "mark").otherwise(T.watermark_id(k))
    kind = F.when(k % 3 == 0, "visible").when(k % 3 == 1, "qr_code").otherwise("ink")
    resistance = F.when(k % 5 == 0, None).when(k % 5 == 1, "").when(k % 5 == 2, "low").when(k % 5 == 3, "high").otherwise("none")
    return docs_of(spark, sf_dir).select("doc_id", tag.alias("tag"), kind.alias("kind"), resistance.alias("r")).select(
        "doc_id",
        F.array_join(L.descriptor_errors(F.col("tag"), F.col("kind"), F.col("r")), "; ").alias("errors"),
    )


@query(r"SELECT event_id, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN NULL ELSE 'confidence must be between 0.0 and 1.0' END AS confidence_error, CASE event_id % 4 WHEN 1 THEN 'timestamp cannot be empty' WHEN 2 THEN 'Invalid ISO 8601 timestamp' END AS timestamp_error FROM events")
def validate_scores(spark, sf_dir):
    """Scores out of range and dates that are none; the number in the message is left out, as engines write it differently."""
    k = F.col("event_id")
    at = F.when(
        k % 4 == 0,
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ).when(k % 4 == 1, "").when(k % 4 == 2, "2024-02-30T00:00:00").otherwise("2024-02-29")
    score = T.unit_error(F.col("value") / 100, "confidence")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.regexp_replace(score, ", got .*", "").alias("confidence_error"),
        T.timestamp_error(at).alias("timestamp_error"),
    )


# --- binary trailers

HEX_MAGIC, HEX_MARKER = B.MAGIC.hex().upper(), B.MARKER.hex().upper()
TRAILER_SQL = f"""raw AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h, '{{"watermark_id":"wmk-' || page_id || '","model_id":"model-' || (page_id % 7) || '","timestamp":"{CREATED}","version":"{B.VERSION}"' || CASE WHEN page_id % 3 = 0 THEN '' ELSE ',"verification_url":"{URL}' || page_id || '"' END || '}}' AS j FROM pages),
sized AS (SELECT *, hex(encode(j)) AS jh, printf('%08X', CAST(strlen(j) AS BIGINT)) AS n FROM raw),
tag AS (SELECT page_id, h, j, h || '{HEX_MAGIC}{HEX_MARKER}' || substr(n, 7, 2) || substr(n, 5, 2) || substr(n, 3, 2) || substr(n, 1, 2) || jh || '{HEX_MAGIC}' AS t FROM sized)"""


def _pages(spark, sf_dir) -> DataFrame:
    """page_id, data, tagged."""
    k = F.col("page_id")
    json = B.metadata(
        F.concat(F.lit("wmk-"), k.cast("string")),
        F.concat(F.lit("model-"), F.pmod(k, F.lit(7)).cast("string")),
        F.lit(CREATED),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(URL), k.cast("string"))),
    )
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("data"), json.alias("json"))
    return p.select("page_id", "data", B.tagged(F.col("data"), F.col("json")).alias("tagged"))


@query(f"WITH {TRAILER_SQL} SELECT page_id, sha256(unhex(t)) AS tagged_sha, CAST(length(t) // 2 AS BIGINT) AS size_bytes, j AS json, 'wmk-' || page_id AS watermark_id, sha256(unhex(h)) AS plain_sha FROM tag")
def binary_tag(spark, sf_dir):
    """Put a trailer behind each page, read it and take it off again."""
    t = F.col("tagged")
    return _pages(spark, sf_dir).select(
        "page_id",
        T.sha(t).alias("tagged_sha"),
        F.octet_length(t).cast("long").alias("size_bytes"),
        B.trailer_json(t).alias("json"),
        B.trailer_id(t).alias("watermark_id"),
        T.sha(B.untagged(t)).alias("plain_sha"),
    )


@query(f"""WITH {TRAILER_SQL}, sus AS (SELECT page_id, h, t, CASE page_id % 6 WHEN 0 THEN t WHEN 1 THEN h WHEN 2 THEN '23' || t WHEN 3 THEN t || '00' WHEN 4 THEN substr(t, 1, length(t) - 14) || '{HEX_MAGIC}' ELSE '' END AS s FROM tag),
e AS (SELECT page_id, s, CASE page_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.99 WHEN 2 THEN 0.9 ELSE 0.0 END AS c FROM sus)
SELECT page_id, CAST(CASE WHEN page_id % 6 = 5 AND EXISTS (SELECT 1 FROM raw r WHERE r.page_id = e.page_id AND r.h = '') THEN 0.99 ELSE c END AS DOUBLE) AS confidence, page_id % 6 IN (0, 2) AS has_trailer FROM e""")
def binary_verify(spark, sf_dir):
    """Marked pages, plain, changed, cut and broken ones against their artifact."""
    k, t = F.pmod(F.col("page_id"), F.lit(6)), F.col("tagged")
    cut = F.concat(F.substring(t, F.lit(1), F.octet_length(t) - 7), F.lit(bytearray(B.MAGIC)))
    suspect = F.when(k == 0, t).when(k == 1, F.col("data")).when(k == 2, F.concat(F.lit(bytearray(b"#")), t)).when(
        k == 3,
        F.concat(t, F.lit(bytearray(b"\x00"))),
    ).when(k == 4, cut).otherwise(F.lit(bytearray(b"")))
    s = _pages(spark, sf_dir).select("page_id", suspect.alias("s"), T.sha(t).alias("after"), T.sha(F.col("data")).alias("before"))
    own = F.concat(F.lit("wmk-"), F.col("page_id").cast("string"))
    return s.select(
        "page_id",
        B.confidence(F.col("s"), F.col("after"), F.col("before"), own).alias("confidence"),
        B.trailer_id(F.col("s")).isNotNull().alias("has_trailer"),
    )


# --- blocks, entropy, signatures, frequency

BLOCKS_SQL = """blk AS (SELECT doc_id, i AS place, substr(text, 64 * i + 1, 64) AS b FROM (SELECT doc_id, text, unnest(range(0, length(text) // 64)) AS i FROM documents)),
blk_c AS (SELECT doc_id, place, c, count(*) AS n FROM (SELECT doc_id, place, unnest(string_split(lower(b), '')) AS c FROM blk) GROUP BY ALL),
blk_e AS (SELECT doc_id, place, round(least(1.0, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 8), 9) AS e FROM blk_c GROUP BY ALL),
top AS (SELECT doc_id, place, e, b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, place) AS r FROM blk_e WHERE e >= 0.5) JOIN blk USING (doc_id, place) WHERE r <= 4)"""


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(place AS BIGINT) AS place, round(e, 6) AS entropy, sha256(b) AS sha FROM top")
def blocks_topk(spark, sf_dir):
    """The four blocks of most entropy of each text."""
    return P.top_blocks(docs_of(spark, sf_dir), "doc_id", "text").withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {BLOCKS_SQL}, h AS (SELECT DISTINCT doc_id, sha256(b) AS sha FROM top), held AS (SELECT sha, min(doc_id) AS artifact_id, count(*) AS artifacts FROM h WHERE doc_id % 2 = 0 GROUP BY sha) SELECT doc_id AS suspect_id, artifact_id, count(*) AS matched FROM h JOIN held USING (sha) WHERE doc_id % 2 = 1 GROUP BY ALL")
def block_matches(spark, sf_dir):
    """Suspects (odd ids) whose blocks are, by hash, blocks of artifacts (even ids); a block's artifacts by the least."""
    h = P.top_blocks(docs_of(spark, sf_dir), "doc_id", "text").select("doc_id", "sha").distinct()
    held = h.where("doc_id % 2 = 0").groupBy("sha").agg(F.min("doc_id").alias("artifact_id"))
    return h.where("doc_id % 2 = 1").join(held, "sha").groupBy(F.col("doc_id").alias("suspect_id"), "artifact_id").agg(F.count("*").alias("matched"))


@query(f"WITH {FRAGMENTS_SQL} SELECT doc_id, count(*) AS fragments, round(avg(entropy), 6) AS mean_entropy, CAST(sum(offset_end - offset_start) AS BIGINT) AS covered FROM frags GROUP BY doc_id")
def fragment_entropy(spark, sf_dir):
    f = P.fragments(docs_of(spark, sf_dir), "doc_id", "text")
    return f.groupBy("doc_id").agg(
        F.count("*").alias("fragments"),
        F.round(F.avg("entropy"), 6).alias("mean_entropy"),
        F.sum(F.col("offset_end") - F.col("offset_start")).alias("covered"),
    )


@query(f"WITH {MINHASH_SQL}, sig AS (SELECT doc_id, [{', '.join(f'CAST(coalesce(m{i}, 0) AS BIGINT)' for i in range(128))}] AS s FROM documents LEFT JOIN mh USING (doc_id)), head AS (SELECT s, min(doc_id) AS k FROM sig GROUP BY s), sc AS (SELECT x.k AS a, y.k AS b, list_sum(list_transform(list_zip(x.s, y.s), lambda z: CAST(z[1] = z[2] AS INTEGER))) AS equal FROM head x JOIN head y ON x.k < y.k) SELECT a, b, CAST(equal AS BIGINT) AS equal FROM sc WHERE 100 * equal >= 80 * 128")
def minhash_pairs(spark, sf_dir):
    """Classes of equal signatures that agree in 80 % of their values at least."""
    h = P.minhash(docs_of(spark, sf_dir), "doc_id", "text").withColumnRenamed("doc_id", "key")
    return P.minhash_pairs(h, h).where("a < b").withColumn("equal", F.col("equal").cast("long"))


@query(f"WITH {anchors_sql('anc', 'documents', 'doc_id')}, df AS (SELECT shingle, count(DISTINCT k) AS df FROM anc_s WHERE len(string_split(shingle, ' ')) = 5 GROUP BY shingle), total AS (SELECT count(*) AS n FROM documents), weighed AS (SELECT k, zone, shingle, round(coalesce(ln((n + 1.0) / (df + 1)), e) * e * (1 - len(list_filter(string_split(shingle, ' '), lambda x: list_contains({STOP_SQL}, x)))::DOUBLE / len(string_split(shingle, ' '))), 9) AS score FROM anc_s JOIN anc_e USING (shingle) LEFT JOIN df USING (shingle), total), ranked AS (SELECT *, row_number() OVER (PARTITION BY k, zone ORDER BY score DESC, shingle) AS r FROM weighed) SELECT k AS doc_id, zone, CAST(r AS BIGINT) AS rank, shingle, round(score, 6) AS score FROM ranked WHERE r <= 10")
def anchors_by_frequency(spark, sf_dir):
    """Anchors weighed by a table of document frequencies of five-word shingles, by entropy where it lacks them."""
    d = docs_of(spark, sf_dir)
    zones = P.zone_hash_frequency(d, "doc_id", "text")
    return P.anchors_by_frequency(d, "doc_id", "text", zones, d.count(), sizes=[P.SHORTEST], absent=1).select(
        "doc_id",
        "zone",
        F.col("rank").cast("long").alias("rank"),
        "shingle",
        F.round("score", 6).alias("score"),
    )


@query("SELECT x.place AS place, x.event_id AS event_id, y.user_id AS user_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) x JOIN (SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS place FROM events) y USING (place)")
def zip_by_place(spark, sf_dir):
    """Artifacts and prompts by their place in two orders."""
    e = table(spark, sf_dir, "events")
    return E.zipped(
        e.select("event_id"),
        e.select("user_id", F.col("event_id").alias("other")),
        ["event_id"],
        ["user_id", "other"],
    ).select("place", "event_id", "user_id")
