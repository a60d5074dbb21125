"""Queries over the driver's tables by name, and the SQL that gives the same rows.

documents are artifacts; their marked forms are evidence; suspects are made from documents by doc_id modulo 8: marked,
unchanged, respaced, header-marked, with a word put before, the first half of it, unrelated, empty.
source plays the model, lang its version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineamark.functions import text as T
from lineamark.operators import anchors as A
from lineamark.operators import contain as C
from lineamark.operators import fingerprint as P
from lineamark.operators import match as M
from lineamark.operators import verdicts as V
from lineamark.sources import store as S
from lineamark.streaming import tasks as K
from lineamark.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
URL = "https://verify.example/"
NOW = "2024-01-02 00:00:00"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def url_of(key="doc_id"):
    return F.concat(F.lit(URL), F.col(key).cast("string"))


def suspects_of(docs: DataFrame) -> DataFrame:
    t, tag, k = F.col("text"), T.watermark_id(F.col("doc_id")), F.pmod(F.col("doc_id"), F.lit(8))
    kinds = [
        T.marked(t, tag, url_of()),
        t,
        F.concat(F.lit("  "), F.replace(t, F.lit(" "), F.lit("  "))),
        T.marked(t, tag, url_of(), "header"),
        F.concat(F.lit("edited "), t),
        F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int")),
        F.concat(F.lit("Unrelated words "), F.md5(F.col("doc_id").cast("string"))),
        F.lit(""),
    ]
    out = F.when(k == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], 1):
        out = out.when(k == i, kind)
    return docs.select(F.col("doc_id").alias("suspect_id"), out.alias("text"))


def evidence_of(docs: DataFrame) -> DataFrame:
    return M.evidence_of(docs, "doc_id", "text", url_of())


def fragments_of(docs: DataFrame) -> DataFrame:
    f = P.fragments(docs, "doc_id", "text")
    return f.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), "location").alias("fragment_id"),
        F.col("doc_id").alias("artifact_id"),
        "fragment",
    )


# --- SQL building blocks


def norm_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace(lower({t}), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def drop_sql(t: str, patterns) -> str:
    for p in patterns:
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    return strip_sql(t)


TAG_SQL = "'wmk-' || substr(md5('watermark:' || doc_id), 1, 8) || '-' || substr(md5('watermark:' || doc_id), 9, 4) || '-4' || substr(md5('watermark:' || doc_id), 14, 3) || '-a' || substr(md5('watermark:' || doc_id), 18, 3) || '-' || substr(md5('watermark:' || doc_id), 21, 12)"
URL_SQL = f"'{URL}' || doc_id"
NL = "chr(10)"
FOOTER_SQL = f"text || {NL} || {NL} || '---' || {NL} || 'AI Provenance Tag: ' || {TAG_SQL} || {NL} || 'Verify: ' || {URL_SQL} || {NL} || '{T.CREDIT}' || {NL}"
HEADER_SQL = f"'AI Provenance Tag: ' || {TAG_SQL} || {NL} || 'Verify: ' || {URL_SQL} || {NL} || '---' || {NL} || {NL} || text"
INLINE_SQL = f"CASE WHEN strpos(text, {NL} || {NL}) > 0 THEN substr(text, 1, strpos(text, {NL} || {NL}) + 1) || ' [AI Generated: ' || {TAG_SQL} || ']' || substr(text, strpos(text, {NL} || {NL}) + 2) ELSE {FOOTER_SQL} END"
DROP_TAG_SQL = ("(?sm)\\n+---+\\n+AI Provenance Tag:.*$", "(?m)^AI Provenance Tag:.*?\\n+---+\\n+", "\\s*\\[AI Generated:.*?\\]")
DROP_COMMON_SQL = ("(?sm)\\n+---+\\n+AI Provenance.*$", "(?m)^AI Provenance.*\\n+---+\\n+", "\\[AI Generated:.*?\\]", "Verify:\\s*https?://[^\\s]+")
SUSPECTS_SQL = f"suspects AS (SELECT doc_id AS suspect_id, CASE doc_id % 8 WHEN 0 THEN {FOOTER_SQL} WHEN 1 THEN text WHEN 2 THEN '  ' || replace(text, ' ', '  ') WHEN 3 THEN {HEADER_SQL} WHEN 4 THEN 'edited ' || text WHEN 5 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) WHEN 6 THEN 'Unrelated words ' || md5(CAST(doc_id AS VARCHAR)) ELSE '' END AS text FROM documents)"
EVIDENCE_SQL = f"evidence AS (SELECT doc_id AS artifact_id, {TAG_SQL} AS watermark_id, sha256(text) AS hash_before, sha256({FOOTER_SQL}) AS hash_after, sha256({norm_sql('text')}) AS norm_before, sha256({norm_sql(FOOTER_SQL)}) AS norm_after FROM documents)"
EXACT_SQL = f"""exact AS (SELECT suspect_id, m.artifact_id AS artifact_id, m.how AS how, m.confidence AS confidence FROM (
  SELECT suspect_id, min({{'place': place, 'artifact_id': artifact_id, 'how': how, 'confidence': confidence}}) AS m FROM (
    SELECT suspect_id, sha256(text) AS raw, sha256({norm_sql('text')}) AS norm FROM suspects) s JOIN (
    SELECT artifact_id, hash_after AS h, 'raw' AS f, 'after' AS how, 0 AS place, CAST(1.0 AS DOUBLE) AS confidence FROM evidence UNION ALL SELECT artifact_id, hash_before, 'raw', 'before', 1, 1.0 FROM evidence
    UNION ALL SELECT artifact_id, norm_after, 'norm', 'normalized', 2, 0.95 FROM evidence UNION ALL SELECT artifact_id, norm_before, 'norm', 'normalized', 3, 0.95 FROM evidence) e
  ON (e.f = 'raw' AND e.h = s.raw) OR (e.f = 'norm' AND e.h = s.norm) GROUP BY suspect_id))"""


def simhash_sql(name: str, source: str, key: str) -> str:
    bits = " + ".join(
        f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {'-' if b == 63 else ''}{2**b}::HUGEINT ELSE 0::HUGEINT END" for b in range(64)
    )
    return f"""{name}_t AS (SELECT {key} AS k, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM {source})),
{name} AS (SELECT {key}, CAST(coalesce(v, 0) AS BIGINT) AS simhash FROM {source} LEFT JOIN (SELECT k, {bits} AS v FROM {name}_t GROUP BY k) x ON x.k = {source}.{key})"""


FRAGMENTS_SQL = """frag_r AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
frag_w AS (SELECT doc_id, text, n, location, unnest(range(a, b, greatest(1, (b - a) // 10))) AS p FROM (
  SELECT doc_id, text, n, 'beginning' AS location, 0 AS a, greatest(200, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS b FROM frag_r
  UNION ALL SELECT doc_id, text, n, 'middle', CAST(floor(n * 0.25::DOUBLE) AS BIGINT), least(n - 200, CAST(floor(n * 0.25::DOUBLE) AS BIGINT) + CAST(floor(n * 0.5::DOUBLE) AS BIGINT)) FROM frag_r
  UNION ALL SELECT doc_id, text, n, 'end', greatest(0, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) - 200), n - 200 FROM frag_r) WHERE a < b),
frag_c AS (SELECT doc_id, location, p, c, count(*) AS k FROM (SELECT doc_id, location, p, unnest(string_split(lower(substr(text, p + 1, 201)), '')) AS c FROM frag_w WHERE length(substr(text, p + 1, 201)) >= 160) GROUP BY ALL),
frag_e AS (SELECT doc_id, location, p, round(least(1.0, (log2(sum(k)) - sum(k * log2(k)) / sum(k)) / 8), 9) AS e FROM frag_c GROUP BY ALL),
frag_b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, location ORDER BY e DESC, p) AS r FROM frag_e),
frags AS (SELECT b.doc_id AS doc_id, location, p AS offset_start, least(p + 200, n) AS offset_end, substr(text, p + 1, 201) AS fragment, e AS entropy FROM frag_b b JOIN frag_r USING (doc_id) WHERE r = 1 AND e >= 0.4)"""
TOKENS_SQL = "list_filter(string_split(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g')), '^ +| +$', '', 'g'), ' '), lambda w: length(w) > 1)"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "]"


def anchors_sql(name: str, source: str, key: str) -> str:
    """CTEs of the anchors of a table: {name} (key, zone, shingle, score, rank)."""
    return f"""{name}_t AS (SELECT {key} AS k, {TOKENS_SQL} AS w FROM {source}),
{name}_z AS (SELECT k, 'beginning' AS zone, list_slice(w, 1, 400) AS w FROM {name}_t UNION ALL
  SELECT k, 'middle', CASE WHEN len(w) < 400 THEN w ELSE list_slice(w, (len(w) - 400) // 2 + 1, (len(w) - 400) // 2 + 400) END FROM {name}_t UNION ALL
  SELECT k, 'end', CASE WHEN len(w) < 400 THEN w ELSE list_slice(w, len(w) - 399, len(w)) END FROM {name}_t),
{name}_p AS (SELECT k, zone, w, s.unnest AS s FROM {name}_z, unnest(range(5, 11)) s),
{name}_s AS (SELECT DISTINCT k, zone, array_to_string(list_slice(w, i, i + s - 1), ' ') AS shingle FROM (SELECT k, zone, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM {name}_p WHERE len(w) >= s)),
{name}_d AS (SELECT DISTINCT shingle FROM {name}_s),
{name}_c AS (SELECT shingle, c, count(*) AS n FROM (SELECT shingle, unnest(string_split(shingle, '')) AS c FROM {name}_d) GROUP BY ALL),
{name}_e AS (SELECT shingle, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM {name}_c GROUP BY shingle),
{name}_v AS (SELECT shingle, round(e * e * (1 - len(list_filter(string_split(shingle, ' '), lambda x: list_contains({STOP_SQL}, x)))::DOUBLE / len(string_split(shingle, ' '))), 9) AS score FROM {name}_e),
{name}_r AS (SELECT k, zone, shingle, score, row_number() OVER (PARTITION BY k, zone ORDER BY score DESC, shingle) AS rank FROM {name}_s JOIN {name}_v USING (shingle)),
{name} AS (SELECT * FROM {name}_r WHERE rank <= 10),
{name}_sets AS (SELECT k, len(w) < 400 AS short, coalesce(bg, []) AS bg, coalesce(mid, []) AS mid, coalesce(en, []) AS en FROM {name}_t LEFT JOIN (SELECT k,
  list_sort(coalesce(list(shingle) FILTER (zone = 'beginning'), [])) AS bg, list_sort(coalesce(list(shingle) FILTER (zone = 'middle'), [])) AS mid, list_sort(coalesce(list(shingle) FILTER (zone = 'end'), [])) AS en FROM {name} GROUP BY k) x USING (k))"""


def jaccard_sql(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


def scored_sql(x: str, y: str) -> str:
    """Columns zones and score of two rows of sets."""
    each = [jaccard_sql(f"{x}.{z}", f"{y}.{z}") for z in ("bg", "mid", "en")]
    return f"{' + '.join(f'CAST(({e}) >= 0.4 AS INTEGER)' for e in each)} AS zones, (({each[0]}) + ({each[1]}) + ({each[2]})) / 3 AS score"


def fuzzy_sql(fragments: str, suspects: str) -> str:
    """CTE near (fragment_id, suspect_id, position, score): best windows. Candidates by two unchanged blocks at one shift."""
    return f"""near_f AS (SELECT fragment_id, fragment, length(fragment) AS n, least(CAST(ceil(length(fragment) / 10.0) AS BIGINT) + 1, length(fragment)) AS m FROM {fragments} WHERE length(fragment) > 0),
near_b AS (SELECT fragment_id, n * b // m AS place, n // m AS q, substr(fragment, n * b // m + 1, n // m) AS g FROM (SELECT *, unnest(range(0, m)) AS b FROM near_f)),
near_g AS (SELECT suspect_id, q, p, substr(text, p + 1, q) AS g FROM (SELECT suspect_id, text, q, unnest(range(0, length(text) - q + 1)) AS p FROM {suspects}, (SELECT DISTINCT q FROM near_b))),
near_m AS (SELECT fragment_id, suspect_id, p - place AS shift FROM near_b JOIN near_g USING (q, g) WHERE p >= place GROUP BY ALL HAVING count(*) >= 2),
near_s AS (SELECT fragment_id, suspect_id, shift, list_sum(list_transform(list_zip(string_split(fragment, ''), string_split(substr(text, shift + 1, n), '')), lambda z: CAST(coalesce(z[1] = z[2], false) AS INTEGER)))::DOUBLE / n AS score
  FROM near_m JOIN near_f USING (fragment_id) JOIN {suspects} USING (suspect_id) WHERE shift + n <= length(text)),
near AS (SELECT fragment_id, suspect_id, arg_max(shift, {{'s': score, 'b': -shift}}) AS position, max(score) AS score FROM near_s WHERE score > 0.9 GROUP BY ALL)"""


# --- hashes, tags, profiles


@query(f"SELECT doc_id, sha256(text) AS sha, sha256({norm_sql('text')}) AS norm_sha, sha256({norm_sql(drop_sql('text', DROP_COMMON_SQL))}) AS stripped_sha FROM documents")
def hashes(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select(
        "doc_id",
        T.sha(t).alias("sha"),
        T.normalized_sha(t).alias("norm_sha"),
        T.stripped_sha(t).alias("stripped_sha"),
    )


def _mark(style: str):
    def f(spark, sf_dir):
        return docs_of(spark, sf_dir).select("doc_id", T.marked(F.col("text"), T.watermark_id(F.col("doc_id")), url_of(), style).alias("marked"))

    f.__name__ = f"mark_{style}"
    return f


for _style, _sql in (("footer", FOOTER_SQL), ("header", HEADER_SQL), ("inline", INLINE_SQL)):
    query(f"SELECT doc_id, {_sql} AS marked FROM documents")(_mark(_style))


@query(f"WITH {SUSPECTS_SQL} SELECT suspect_id, coalesce(nullif(regexp_extract(text, 'AI Provenance Tag:\\s*([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(text, '\\[AI Generated:\\s*([a-zA-Z0-9_-]+)', 1), '')) AS tag, nullif(regexp_extract(text, 'Verify:\\s*(https?://[^\\s\\n]+)', 1), '') AS url, sha256({drop_sql('text', DROP_TAG_SQL)}) AS clean_sha FROM suspects")
def extract_and_strip(spark, sf_dir):
    t = F.col("text")
    return suspects_of(docs_of(spark, sf_dir)).select(
        "suspect_id",
        T.tag_id(t).alias("tag"),
        T.tag_url(t).alias("url"),
        T.sha(T.unmarked(t)).alias("clean_sha"),
    )


TAG_FOUND_SQL = "coalesce(nullif(regexp_extract(text, 'AI Provenance Tag:\\s*([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(text, '\\[AI Generated:\\s*([a-zA-Z0-9_-]+)', 1), ''))"
PHRASE_SQL = [f"CASE WHEN contains(lower(text), '{p.lower().replace(chr(39), chr(39) * 2)}') THEN '{p.replace(chr(39), chr(39) * 2)}' END" for p in T.PHRASE_LIST]


@query(f"""WITH {SUSPECTS_SQL}, odd AS (SELECT suspect_id, CASE suspect_id % 5 WHEN 1 THEN '--- Tag REMOVED --- ' || text WHEN 2 THEN text || ' [was stripped here]' WHEN 3 THEN 'As an ai, i cannot. ' || text ELSE text END AS text FROM suspects)
SELECT suspect_id, length(text) AS text_length, {TAG_FOUND_SQL} IS NOT NULL AS has_watermark, {TAG_FOUND_SQL} AS watermark_id, regexp_matches(text, '(?i)---.*removed.*---') AS says_removed, regexp_matches(text, '(?i)\\[.*stripped.*\\]') AS says_stripped, array_to_string(list_filter([{', '.join(PHRASE_SQL)}], lambda x: x IS NOT NULL), '; ') AS phrases FROM odd""")
def suspect_profile(spark, sf_dir):
    """What a suspect says of itself: its length, tag, traces of a removed tag, phrases of generated text."""
    k, t = F.pmod(F.col("suspect_id"), F.lit(5)), F.col("text")
    odd = F.when(k == 1, F.concat(F.lit("--- Tag REMOVED --- "), t)).when(k == 2, F.concat(t, F.lit(" [was stripped here]")))
    odd = odd.when(k == 3, F.concat(F.lit("As an ai, i cannot. "), t)).otherwise(t)
    s = suspects_of(docs_of(spark, sf_dir)).withColumn("text", odd)
    return s.select(
        "suspect_id",
        F.length(t).cast("long").alias("text_length"),
        T.tag_id(t).isNotNull().alias("has_watermark"),
        T.tag_id(t).alias("watermark_id"),
        t.rlike(T.MARKERS["removed"]).alias("says_removed"),
        t.rlike(T.MARKERS["stripped"]).alias("says_stripped"),
        F.array_join(T.phrases(t), "; ").alias("phrases"),
    )


UUID_RE, ANY_UUID_RE = T.UUID4, T.UUID
IDS_SQL = f"ids AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'art-' || doc_id ELSE substr({TAG_SQL}, 5) END AS a, CASE WHEN doc_id % 7 = 0 THEN substr({TAG_SQL}, 5) WHEN doc_id % 7 = 1 THEN 'wmk-x' WHEN doc_id % 7 = 2 THEN 'wmk-6ba7b810-9dad-11d1-80b4-00c04fd430c8' ELSE {TAG_SQL} END AS w, CASE doc_id % 3 WHEN 0 THEN 'text_frag_end_1' WHEN 1 THEN 'frag_1_end' ELSE 'frag_end' END AS f, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN upper(sha256(text)) ELSE sha256(text) END AS h FROM documents)"
ERRORS_SQL = f"""errs AS (SELECT doc_id, source,
 CASE WHEN a = '' THEN 'artifact_id cannot be empty' WHEN NOT regexp_matches(a, '(?i){UUID_RE}') THEN 'artifact_id must be valid UUID v4' END AS artifact_error,
 CASE WHEN w = '' THEN 'watermark_id cannot be empty' WHEN NOT starts_with(w, 'wmk-') THEN 'watermark_id must start with ''wmk-''' WHEN NOT regexp_matches(substr(w, 5), '(?i){ANY_UUID_RE}') THEN 'watermark_id must be wmk-{{valid-uuid}}' END AS watermark_error,
 CASE WHEN f = '' THEN 'fragment_id cannot be empty' WHEN NOT starts_with(f, 'frag_') THEN 'fragment_id must start with ''frag_''' WHEN NOT regexp_matches(f, '(?i)^frag_\\d+_[a-z_]+$') THEN 'fragment_id must follow pattern: frag_{{index}}_{{location}}' END AS fragment_error,
 CASE WHEN h = '' THEN 'hash cannot be empty' WHEN length(h) <> 64 THEN 'SHA-256 hash must be 64 characters, got ' || length(h) WHEN NOT regexp_matches(h, '^[0-9a-f]{{64}}$') THEN 'SHA-256 hash must be lowercase hex' END AS hash_error FROM ids)"""


def _errors(spark, sf_dir) -> DataFrame:
    d, tag = F.col("doc_id"), T.watermark_id(F.col("doc_id"))
    plain = F.substring(tag, 5, 100)
    a = F.when(d % 5 == 0, F.concat(F.lit("art-"), d.cast("string"))).otherwise(plain)
    w = F.when(d % 7 == 0, plain).when(d % 7 == 1, "wmk-x").when(d % 7 == 2, "wmk-6ba7b810-9dad-11d1-80b4-00c04fd430c8").otherwise(tag)
    f = F.when(d % 3 == 0, "text_frag_end_1").when(d % 3 == 1, "frag_1_end").otherwise("frag_end")
    h = F.when(d % 4 == 0, "").when(d % 4 == 1, "abc").when(d % 4 == 2, F.upper(T.sha(F.col("text")))).otherwise(T.sha(F.col("text")))
    ids = docs_of(spark, sf_dir).select("doc_id", "source", a.alias("a"), w.alias("w"), f.alias("f"), h.alias("h"))
    c = F.col
    return ids.select(
        "doc_id",
        "source",
        T.artifact_id_error(c("a")).alias("artifact_error"),
        T.watermark_id_error(c("w")).alias("watermark_error"),
        T.fragment_id_error(c("f")).alias("fragment_error"),
        T.sha_error(c("h")).alias("hash_error"),
    )


@query(f"WITH {IDS_SQL}, {ERRORS_SQL} SELECT doc_id, artifact_error, watermark_error, fragment_error, hash_error FROM errs")
def validate_ids(spark, sf_dir):
    return _errors(spark, sf_dir).drop("source")


#: Bytes put before pages, by page_id modulo their number; after them short and odd inputs that stand alone.
HEADS = [
    "89504E470D0A1A0A",
    "FFD8FF",
    "25504446",
    "494433",
    "504B0304",
    "0000001066747970",
    "474946383761",
    "474946383961",
    "5249464600000000574542505650",
    "524946460000000057415645666D",
    "664C6143",
    "FFFB",
    "FFF3",
    "7F454C46",
    "4D5A90",
    "1F8B08",
    "52617221",
    "FFFE",
    "",
    "7B",
    "5B",
    "0A207B",
]
ALONE = ["7B2261223A20317D", "5B312C20325D", "7B2261223A", "", "7F45", "4D", "52494646", "00000010667479", "205B5D0A"]
SNIFF_SQL = f"""raw AS (SELECT page_id, CASE {" ".join(f"WHEN page_id % {len(HEADS) + len(ALONE)} = {i} THEN '{h}' || hex(encode(coalesce(html, '')))" for i, h in enumerate(HEADS))} {" ".join(f"WHEN page_id % {len(HEADS) + len(ALONE)} = {len(HEADS) + i} THEN '{h}'" for i, h in enumerate(ALONE))} END AS h FROM pages),
sized AS (SELECT page_id, h, length(h) // 2 AS n, TRY(decode(unhex(substr(h, 1, {2 * T.SAMPLE})))) AS t FROM raw),
texts AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM sized)"""


@query(f"""WITH {SNIFF_SQL} SELECT page_id, n AS size_bytes, CASE WHEN h LIKE '89504E470D0A1A0A%' OR h LIKE 'FFD8FF%' OR (h LIKE '52494646%' AND n > 12 AND contains(substr(h, 17, 16), '57454250')) OR h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'image' WHEN h LIKE '25504446%' THEN 'pdf' WHEN n > 8 AND substr(h, 9, 8) = '66747970' THEN 'video'
 WHEN (h LIKE '52494646%' AND n > 12 AND contains(substr(h, 17, 16), '57415645')) OR h LIKE '494433%' OR h LIKE 'FFFB%' OR h LIKE 'FFF3%' OR h LIKE '664C6143%' THEN 'audio' WHEN s LIKE '{{%' AND (n <= {T.SAMPLE} AND json_valid(s) OR n > {T.SAMPLE} AND contains(substr(s, 1, {T.NEAR_HEAD}), '}}')) OR s LIKE '[%' AND (n <= {T.SAMPLE} AND json_valid(s) OR n > {T.SAMPLE} AND contains(substr(s, 1, {T.NEAR_HEAD}), ']')) THEN 'json' ELSE 'binary' END AS artifact_type,
 CASE WHEN n < 4 THEN 'unknown' WHEN h LIKE '7F454C46%' THEN 'ELF' WHEN h LIKE '4D5A%' THEN 'PE executable' WHEN h LIKE '89504E47%' THEN 'PNG' WHEN h LIKE 'FFD8FF%' THEN 'JPEG image' WHEN h LIKE '25504446%' THEN 'PDF document' WHEN h LIKE '504B0304%' THEN 'ZIP' WHEN h LIKE '1F8B%' THEN 'GZIP compressed' WHEN h LIKE '52617221%' THEN 'RAR archive' ELSE 'unknown' END AS file_type FROM texts""")
def sniff_type(spark, sf_dir):
    k, html = F.pmod(F.col("page_id"), F.lit(len(HEADS) + len(ALONE))), F.coalesce("html", F.lit("")).cast("binary")
    data = F.lit(None).cast("binary")
    for i, head in enumerate(HEADS):
        data = F.when(k == i, F.concat(F.unhex(F.lit(head)), html)).otherwise(data)
    for i, whole in enumerate(ALONE):
        data = F.when(k == len(HEADS) + i, F.unhex(F.lit(whole))).otherwise(data)
    return table(spark, sf_dir, "pages").select("page_id", data.alias("data")).select(
        "page_id",
        F.octet_length("data").cast("long").alias("size_bytes"),
        T.artifact_type(F.col("data")).alias("artifact_type"),
        T.file_type(F.col("data")).alias("file_type"),
    )


# --- fingerprints


@query(f"WITH {simhash_sql('s', 'documents', 'doc_id')} SELECT doc_id, simhash FROM s")
def simhash(spark, sf_dir):
    return P.simhash(docs_of(spark, sf_dir), "doc_id", "text")


@query(f"WITH {simhash_sql('s', 'documents', 'doc_id')} SELECT source, bit_xor(simhash) AS digest, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY source")
def simhash_xor(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return P.simhash(d, "doc_id", "text").join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.bit_xor("simhash").alias("digest"),
        F.count("*").alias("n"),
    )


def _near_sql(k: int) -> str:
    return f"WITH {simhash_sql('s', 'documents', 'doc_id')}, v AS (SELECT DISTINCT simhash FROM s) SELECT x.simhash AS a, y.simhash AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS BIGINT) AS distance FROM v x JOIN v y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= {k}"


def _near(k: int):
    def f(spark, sf_dir):
        h = P.simhash(docs_of(spark, sf_dir), "doc_id", "text")
        return M.near_simhashes(h, h, k, half=True).select("a", "b", F.col("distance").cast("long").alias("distance"))

    f.__name__ = f"simhash_pairs_{k}"
    return f


for _k in (3, 10):
    query(_near_sql(_k))(_near(_k))

_FACTORS, _SUMMANDS = P.hash_family(128)
MINHASH_SQL = f"""mh_t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM documents),
mh_h AS (SELECT t, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT t FROM mh_t)),
mh AS (SELECT doc_id, {", ".join(f"min(({a} * h + {b}) % {P.PRIME}) AS m{i}" for i, (a, b) in enumerate(zip(_FACTORS, _SUMMANDS, strict=True)))} FROM mh_t JOIN mh_h USING (t) GROUP BY doc_id)"""


@query(f"WITH {MINHASH_SQL} SELECT doc_id, {', '.join(f'CAST(coalesce(m{i}, 0) AS BIGINT) AS m{i}' for i in range(128))} FROM documents LEFT JOIN mh USING (doc_id)")
def minhash(spark, sf_dir):
    return P.minhash(docs_of(spark, sf_dir), "doc_id", "text").select("doc_id", *(F.col("minhash")[i].alias(f"m{i}") for i in range(128)))


@query("WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents WHERE length(text) >= 10) GROUP BY ALL), e AS (SELECT doc_id, least(1.0, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 8) AS e FROM c GROUP BY doc_id) SELECT doc_id, round(coalesce(e, 0.0), 6) AS entropy FROM documents LEFT JOIN e USING (doc_id)")
def text_entropy(spark, sf_dir):
    return P.text_entropy(docs_of(spark, sf_dir), "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {FRAGMENTS_SQL} SELECT doc_id, location, CAST(offset_start AS BIGINT) AS offset_start, CAST(offset_end AS BIGINT) AS offset_end, sha256(fragment) AS sha, round(entropy, 6) AS entropy FROM frags")
def fragments_select(spark, sf_dir):
    return P.fragments(docs_of(spark, sf_dir), "doc_id", "text").select(
        "doc_id",
        "location",
        F.col("offset_start").cast("long").alias("offset_start"),
        F.col("offset_end").cast("long").alias("offset_end"),
        "sha",
        F.round("entropy", 6).alias("entropy"),
    )


@query(f"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) SELECT shingle, count(*) AS df FROM (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)) GROUP BY shingle")
def shingle_df(spark, sf_dir):
    return P.document_frequency(docs_of(spark, sf_dir), "doc_id", "text")


ANCHORS_SQL = anchors_sql("anc", "documents", "doc_id")


@query(f"WITH {ANCHORS_SQL} SELECT k AS doc_id, zone, CAST(rank AS BIGINT) AS rank, shingle, round(score, 6) AS score FROM anc")
def anchors_topk(spark, sf_dir):
    return P.anchors(docs_of(spark, sf_dir), "doc_id", "text").select(
        "doc_id",
        "zone",
        F.col("rank").cast("long").alias("rank"),
        "shingle",
        F.round("score", 6).alias("score"),
    )


def _sets(df: DataFrame, key: str) -> DataFrame:
    """anchor_sets() of a table's texts."""
    return A.anchor_sets(P.anchor_keys(df, key, "text"), P.anchors(df, key, "text").select(F.col(key).alias("key"), "zone", "shingle"))


CLASSES_SQL = f"{ANCHORS_SQL}, cls AS (SELECT k, short, bg, mid, en, min(k) OVER (PARTITION BY short, bg, mid, en) AS class FROM anc_sets)"


@query(f"WITH {CLASSES_SQL} SELECT k AS key, class FROM cls")
def anchor_members(spark, sf_dir):
    """The class of each text: those with the same anchors."""
    return A.anchor_classes(_sets(docs_of(spark, sf_dir), "doc_id"))


@query(f"""WITH {CLASSES_SQL}, h AS (SELECT * FROM cls WHERE k = class),
met AS (SELECT DISTINCT x.k AS a, y.k AS b FROM anc x JOIN anc y USING (zone, shingle) UNION SELECT x.k, y.k FROM h x, h y WHERE len(x.bg) + len(y.bg) = 0),
sc AS (SELECT a, b, y.short AS short, {scored_sql('x', 'y')} FROM met JOIN h x ON x.k = a JOIN h y ON y.k = b)
SELECT a, b, CAST(zones AS BIGINT) AS matched_zones, round(score, 6) AS score FROM sc WHERE zones >= CASE WHEN short THEN 1 ELSE 2 END""")
def anchor_pairs(spark, sf_dir):
    """Pairs of classes; b is the evidence, of which one zone is enough where it is short."""
    sets = written(_sets(docs_of(spark, sf_dir), "doc_id"), "anchor-sets")
    return A.anchor_pairs(sets, sets).withColumn("score", F.round("score", 6))


# --- matching and verdicts


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fragment_id"), F.col("text").alias("fragment"))


@query("SELECT item_id AS fragment_id, doc_id AS suspect_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS position FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0")
def fragment_contains(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.col("doc_id").alias("suspect_id"), "text")
    return C.contained(_passages(spark, sf_dir), d).withColumn("position", F.col("position").cast("long"))


@query(f"WITH passages AS (SELECT item_id AS fragment_id, text AS fragment FROM benchmark), readers AS (SELECT doc_id AS suspect_id, text FROM documents), {fuzzy_sql('passages', 'readers')} SELECT fragment_id, suspect_id, CAST(position AS BIGINT) AS position, round(score, 9) AS score, round(CASE WHEN score = 1 THEN 1 ELSE 0.8 * score END, 9) AS confidence FROM near")
def fragment_fuzzy(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.col("doc_id").alias("suspect_id"), "text")
    return V.fragment_matches(_passages(spark, sf_dir), d).withColumns({"score": F.round("score", 9), "confidence": F.round("confidence", 9)})


# texts with a character changed in every fifty
TOUCHED_SQL = f"{SUSPECTS_SQL}, touched AS (SELECT suspect_id, CASE WHEN suspect_id % 8 IN (4, 5) THEN regexp_replace(text, '(.{{49}}).', '\\1#', 'gs') ELSE text END AS text FROM suspects)"


def touched_of(docs: DataFrame) -> DataFrame:
    """Suspects, of which two kinds have a character changed in every fifty."""
    return suspects_of(docs).withColumn(
        "text",
        F.when(F.pmod(F.col("suspect_id"), F.lit(8)).isin(4, 5), F.regexp_replace("text", r"(?s)(.{49}).", "$1#")).otherwise(F.col("text")),
    )


HEADS_SQL = f"{FRAGMENTS_SQL}, fset AS (SELECT doc_id, list_sort(list(fragment)) AS fs FROM frags GROUP BY doc_id), fhead AS (SELECT fs, min(doc_id) AS doc_id FROM fset GROUP BY fs), heads AS (SELECT f.doc_id || '_' || location AS fragment_id, f.doc_id AS artifact_id, fragment FROM frags f JOIN fhead USING (doc_id))"


@query(f"WITH {TOUCHED_SQL}, {HEADS_SQL}, {fuzzy_sql('heads', 'touched')}, hits AS (SELECT suspect_id, artifact_id, count(*) AS matched FROM near JOIN heads USING (fragment_id) GROUP BY ALL), total AS (SELECT artifact_id, count(*) AS total FROM heads GROUP BY ALL) SELECT suspect_id, artifact_id, matched, total, CAST(CASE WHEN matched >= 2 THEN 0.99 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN matched >= 2 THEN 'high' ELSE 'medium' END AS defensibility FROM hits JOIN total USING (artifact_id)")
def fragment_rollup(spark, sf_dir):
    """Fragments found in each suspect, exactly or nearly, by artifact; artifacts with the same fragments by the least."""
    d = docs_of(spark, sf_dir)
    f = written(V.one_for_each_set(fragments_of(d)), "fragments")
    return V.fragment_summary(C.nearly_contained(f.select("fragment_id", "fragment"), touched_of(d)), f)


@query(f"WITH {SUSPECTS_SQL}, {EVIDENCE_SQL}, {EXACT_SQL} SELECT * FROM exact")
def verify_tier1(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return M.exact_matches(suspects_of(d), evidence_of(d))


FLAT_SQL = f"""{SUSPECTS_SQL}, {EVIDENCE_SQL}, {simhash_sql('sh', 'suspects', 'suspect_id')}, {simhash_sql('eh', 'documents', 'doc_id')}, {ANCHORS_SQL}, {anchors_sql('sus', 'suspects', 'suspect_id')},
own AS (SELECT y.k, y.short AS short, {scored_sql('x', 'y')} FROM sus_sets x JOIN anc_sets y ON x.k = y.k), own_score AS (SELECT k, score FROM own WHERE zones >= CASE WHEN short THEN 1 ELSE 2 END),
j AS (SELECT s.suspect_id, sha256(s.text) = hash_after AS a, sha256(s.text) = hash_before AS b, sha256({norm_sql('s.text')}) = norm_before AS nb, sha256({norm_sql('s.text')}) IN (norm_before, norm_after) AS n, bit_count(xor(sh.simhash, eh.simhash)) AS d,
 coalesce(nullif(regexp_extract(s.text, 'AI Provenance Tag:\\s*([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(s.text, '\\[AI Generated:\\s*([a-zA-Z0-9_-]+)', 1), '')) AS tag, watermark_id, score
 FROM suspects s JOIN evidence e ON e.artifact_id = s.suspect_id JOIN sh ON sh.suspect_id = s.suspect_id JOIN eh ON eh.doc_id = s.suspect_id LEFT JOIN own_score ON own_score.k = s.suspect_id)"""


@query(f"""WITH {FLAT_SQL} SELECT suspect_id, a AS match_after, b AS match_before, n AS match_normalized, CAST(d AS BIGINT) AS distance, tag IS NOT NULL AS watermark_present, coalesce(tag = watermark_id, false) AS tag_intact, b AND NOT a AS likely_removed,
NOT a AND NOT b AND (nb OR d <= 10 AND 1 - d::DOUBLE / 64 > 0.8) AS content_modified, a OR b OR n OR (d <= 10 AND 1 - d::DOUBLE / 64 > 0.9) AS authentic,
round(CAST(CASE WHEN a THEN 1.0 WHEN b THEN 0.95 WHEN n THEN 0.9 WHEN score > 0 THEN 0.85 * score WHEN d <= 10 THEN 1 - d::DOUBLE / 64 ELSE 0.0 END AS DOUBLE), 6) AS confidence FROM j""")
def verify_flat(spark, sf_dir):
    """Each suspect against the evidence of the same row id: the ladder of all signals."""
    d = docs_of(spark, sf_dir)
    s = suspects_of(d)
    e = evidence_of(d).join(
        P.simhash(d, "doc_id", "text").select(F.col("doc_id").alias("artifact_id"), F.col("simhash").alias("theirs")),
        "artifact_id",
    )
    t, c = F.col("text"), F.col
    mine = s.select(
        "suspect_id",
        T.sha(t).alias("raw"),
        T.normalized_sha(t).alias("norm"),
        T.tag_id(t).alias("tag"),
    ).join(P.simhash(s, "suspect_id", "text"), "suspect_id")
    scores = A.own_anchor_scores(_sets(s, "suspect_id"), _sets(d, "doc_id")).withColumnRenamed("key", "suspect_id")
    j = mine.join(e, c("suspect_id") == c("artifact_id")).join(scores, "suspect_id", "left")
    j = j.select(
        "suspect_id",
        (c("raw") == c("hash_after")).alias("match_after"),
        (c("raw") == c("hash_before")).alias("match_before"),
        (c("norm") == c("norm_before")).alias("norm_match"),
        c("norm").isin(c("norm_before"), c("norm_after")).alias("match_normalized"),
        T.hamming(c("simhash"), c("theirs")).cast("long").alias("distance"),
        c("tag").isNotNull().alias("watermark_present"),
        F.coalesce(c("tag") == c("watermark_id"), F.lit(False)).alias("tag_intact"),
        "anchor_score",
    )
    a, b, n, similar = c("match_after"), c("match_before"), c("match_normalized"), V.similarity(c("distance"))
    out = j.withColumns(
        {
            "likely_removed": b & ~a,
            "content_modified": V.content_modified(a, b, c("norm_match"), similar),
            "authentic": V.is_authentic(a, b, n, similar),
            "confidence": F.round(V.flat_confidence(a, b, n, c("anchor_score"), similar), 6),
        }
    )
    return out.drop("anchor_score", "norm_match")


MANY_SQL = f"""{SUSPECTS_SQL}, {EVIDENCE_SQL}, {simhash_sql('sh', 'suspects', 'suspect_id')}, {simhash_sql('eh', 'documents', 'doc_id')}, {ANCHORS_SQL}, {anchors_sql('sus', 'suspects', 'suspect_id')},
keyed AS (SELECT artifact_id, hash_after AS h, 'raw' AS f, 'after' AS how, 0 AS rung, CAST(1 AS DOUBLE) AS conf FROM evidence UNION ALL SELECT artifact_id, hash_before, 'raw', 'before', 1, 0.95 FROM evidence
 UNION ALL SELECT artifact_id, norm_after, 'norm', 'normalized', 2, 0.9 FROM evidence UNION ALL SELECT artifact_id, norm_before, 'norm', 'normalized', 2, 0.9 FROM evidence),
keys AS (SELECT f, h, how, rung, conf, min(artifact_id) AS artifact_id FROM keyed GROUP BY ALL),
texts AS (SELECT suspect_id, sha256(text) AS raw, sha256({norm_sql('text')}) AS norm FROM suspects),
hits AS (SELECT suspect_id, artifact_id, how, rung, conf, CAST(NULL AS DOUBLE) AS alike FROM texts JOIN keys ON (f = 'raw' AND h = raw) OR (f = 'norm' AND h = norm)),
ek AS (SELECT k, short, bg, mid, en, simhash, min(k) OVER (PARTITION BY short, bg, mid, en, simhash) AS head FROM anc_sets JOIN eh ON eh.doc_id = k),
heads AS (SELECT * FROM ek WHERE k = head),
sk AS (SELECT k, short, bg, mid, en, simhash, min(k) OVER (PARTITION BY short, bg, mid, en, simhash) AS head FROM sus_sets JOIN sh ON sh.suspect_id = k),
shead AS (SELECT * FROM sk WHERE k = head),
met AS (SELECT x.head AS a, y.head AS b FROM shead x, heads y WHERE bit_count(xor(x.simhash, y.simhash)) <= 10 UNION SELECT DISTINCT x.k, y.k FROM sus x JOIN anc y USING (zone, shingle) WHERE x.k IN (SELECT k FROM shead) AND y.k IN (SELECT k FROM heads) UNION SELECT x.k, y.k FROM shead x, heads y WHERE len(x.bg) + len(y.bg) = 0),
signals AS (SELECT a, b, y.short AS short, bit_count(xor(x.simhash, y.simhash)) AS d, {scored_sql('x', 'y')} FROM met JOIN shead x ON x.k = a JOIN heads y ON y.k = b),
laddered AS (SELECT a, b, CASE WHEN d <= 10 THEN 1 - d::DOUBLE / 64 END AS alike, CASE WHEN zones >= CASE WHEN short THEN 1 ELSE 2 END AND score > 0 THEN 0.85 * score END AS by_anchors FROM signals),
told AS (SELECT sk.k AS suspect_id, b AS artifact_id, CASE WHEN by_anchors IS NOT NULL THEN 'anchors' ELSE 'similarity' END AS how, 3 AS rung, coalesce(by_anchors, alike) AS conf, alike FROM laddered JOIN sk ON sk.head = a WHERE coalesce(by_anchors, alike) >= 0.8),
best AS (SELECT suspect_id, artifact_id, arg_min({{'how': how, 'conf': conf}}, rung) AS m, max(alike) AS alike FROM (SELECT * FROM hits UNION ALL SELECT * FROM told) GROUP BY ALL)"""


@query(f"WITH {MANY_SQL} SELECT suspect_id, artifact_id, m.how AS how, round(m.conf, 6) AS confidence, m.how IN ('after', 'before', 'normalized') OR coalesce(alike > 0.9, false) AS authentic FROM best")
def verify_many(spark, sf_dir):
    """Each suspect against all evidence, results of confidence 0.8 at least, best first."""
    d = docs_of(spark, sf_dir)
    s = suspects_of(d)
    return V.many_by_signals(s, evidence_of(d), P.signals(s, "suspect_id", "text"), P.signals(d, "doc_id", "text"), digits=6)


CASCADE_SQL = f"""{TOUCHED_SQL}, {EVIDENCE_SQL}, {EXACT_SQL.replace("FROM suspects)", "FROM touched)")}, {HEADS_SQL}, {simhash_sql('sh', 'touched', 'suspect_id')}, {simhash_sql('eh', 'documents', 'doc_id')},
later AS (SELECT * FROM touched WHERE suspect_id NOT IN (SELECT suspect_id FROM exact)), {fuzzy_sql('heads', 'later')},
two_h AS (SELECT suspect_id, artifact_id, count(*) AS matched FROM near JOIN heads USING (fragment_id) GROUP BY ALL),
two AS (SELECT suspect_id, artifact_id, 'fragments' AS tier, CAST(CASE WHEN matched >= 2 THEN 0.999 ELSE 0.95 END AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY suspect_id ORDER BY matched DESC, artifact_id) AS r FROM two_h) WHERE r = 1),
three_h AS (SELECT suspect_id, eh.doc_id AS artifact_id, bit_count(xor(sh.simhash, eh.simhash)) AS d FROM sh, eh WHERE suspect_id NOT IN (SELECT suspect_id FROM exact) AND suspect_id NOT IN (SELECT suspect_id FROM two) AND bit_count(xor(sh.simhash, eh.simhash)) <= 25),
three AS (SELECT suspect_id, artifact_id, 'similarity' AS tier, CAST(CASE WHEN d <= 10 THEN 0.95 WHEN d <= 15 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY suspect_id ORDER BY d, artifact_id) AS r FROM three_h) WHERE r = 1),
verdicts AS (SELECT suspect_id, artifact_id, 'exact_hash' AS tier, confidence FROM exact UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL
 SELECT suspect_id, NULL, 'no_match', CAST(0 AS DOUBLE) FROM touched WHERE suspect_id NOT IN (SELECT suspect_id FROM exact UNION ALL SELECT suspect_id FROM two UNION ALL SELECT suspect_id FROM three))"""


@query(f"WITH {CASCADE_SQL} SELECT * FROM verdicts")
def verify_cascade(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    s = touched_of(d)
    return V.cascade(
        s,
        evidence_of(d),
        fragments_of(d),
        P.simhash(s, "suspect_id", "text"),
        P.simhash(d, "doc_id", "text").withColumnRenamed("doc_id", "artifact_id"),
    )


@query(f"WITH {CASCADE_SQL} SELECT tier, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(confidence), 6) AS mean_confidence FROM verdicts GROUP BY tier")
def tier_stats(spark, sf_dir):
    return V.tier_statistics(verify_cascade(spark, sf_dir))


@query(f"WITH {SUSPECTS_SQL}, {EVIDENCE_SQL}, g AS (SELECT suspect_id, coalesce(nullif(regexp_extract(text, 'AI Provenance Tag:\\s*([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(text, '\\[AI Generated:\\s*([a-zA-Z0-9_-]+)', 1), '')) AS watermark_id FROM suspects) SELECT suspect_id, watermark_id, artifact_id FROM g LEFT JOIN evidence USING (watermark_id) WHERE watermark_id IS NOT NULL")
def verify_tags(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return M.tag_matches(suspects_of(d), evidence_of(d))


# --- store, chains, tasks, signals


def _rows(spark, sf_dir) -> DataFrame:
    d = docs_of(spark, sf_dir).select(
        F.col("doc_id").alias("artifact_id"),
        F.col("source").alias("model_id"),
        F.col("lang").alias("model_version"),
        T.watermark_id(F.col("doc_id")).alias("watermark_id"),
    )
    again = d.where("artifact_id % 10 = 0").withColumn("model_version", F.lit("v2"))
    return d.withColumn("ingested", F.lit(1)).unionByName(again.withColumn("ingested", F.lit(2)))


ROWS_SQL = f"stored AS (SELECT doc_id AS artifact_id, source AS model_id, CASE WHEN doc_id % 10 = 0 THEN 'v2' ELSE lang END AS model_version, {TAG_SQL} AS watermark_id FROM documents)"


@query(f"WITH {ROWS_SQL} SELECT * FROM stored")
def store_latest(spark, sf_dir):
    return S.latest(_rows(spark, sf_dir)).drop("ingested")


@query(f"WITH {ROWS_SQL} SELECT * FROM stored WHERE model_id = 'src3' AND model_version = 'en'")
def store_by_model(spark, sf_dir):
    return S.by_model(S.latest(_rows(spark, sf_dir)), "src3", "en").drop("ingested")


@query(f"WITH {ROWS_SQL} SELECT model_id, count(*) AS n FROM stored GROUP BY model_id")
def store_counts(spark, sf_dir):
    return S.latest(_rows(spark, sf_dir)).groupBy("model_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source AS model_id FROM documents")
def store_models(spark, sf_dir):
    return _rows(spark, sf_dir).select("model_id").distinct()


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def whole_responses(spark, sf_dir):
    return K.responses(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


STATUS_SQL = "ev AS (SELECT user_id AS artifact_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'started' WHEN 2 THEN 'ok' ELSE 'error' END AS outcome FROM events), st AS (SELECT artifact_id, arg_max(outcome, {'ts': ts, 'e': event_id}) AS o, max(ts) AS at_ts, count(*) FILTER (outcome = 'error') AS attempts FROM ev GROUP BY artifact_id), status AS (SELECT artifact_id, CASE WHEN o = 'queued' THEN 'pending' WHEN o = 'started' THEN 'processing' WHEN o = 'ok' THEN 'completed' WHEN attempts > 3 THEN 'failed' ELSE 'retry' END AS status, attempts, at_ts FROM st)"


def _status(spark, sf_dir) -> DataFrame:
    k = F.pmod(F.col("event_id"), F.lit(5))
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artifact_id"),
        "ts",
        "event_id",
        F.when(k == 0, "queued").when(k == 1, "started").when(k == 2, "ok").otherwise("error").alias("outcome"),
    )
    return K.status(e)


@query(f"WITH {STATUS_SQL} SELECT artifact_id, status, attempts FROM status")
def task_status(spark, sf_dir):
    return _status(spark, sf_dir).drop("at")


@query(f"WITH {STATUS_SQL}, m AS (SELECT max(ts) AS now FROM events) SELECT artifact_id, status FROM status, m WHERE epoch(date_trunc('second', at_ts)) + CASE status WHEN 'pending' THEN 7200 WHEN 'completed' THEN 600 ELSE 3600 END >= epoch(date_trunc('second', now))")
def unexpired_tasks(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    s = _status(spark, sf_dir).join(F.broadcast(now))  # one row
    return K.unexpired(s, F.col("now")).select("artifact_id", "status")


@query("SELECT outcome, count(*) AS total, count(*) FILTER (value > 0) AS positive FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END AS outcome, value FROM events) GROUP BY outcome")
def batch_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "failure").otherwise("success").alias("outcome"), "value")
    return e.groupBy("outcome").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 0).alias("positive"))


BEAT, CUT = "event_id % 2 = 0", "event_id % 2 = 1"


@query(f"SELECT beat_id, cut_id FROM (SELECT b.event_id AS beat_id, c.event_id AS cut_id, row_number() OVER (PARTITION BY b.event_id ORDER BY c.ts, c.event_id) AS r FROM events b JOIN events c ON b.user_id = c.user_id AND abs(epoch_us(b.ts) - epoch_us(c.ts)) <= 3600000000 WHERE b.{BEAT} AND c.{CUT}) WHERE r = 1")
def band_sync(spark, sf_dir):
    """Each beat with the first cut of its user within an hour: an equi-join on hours, then the exact band."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = 3_600_000_000
    b = e.where(BEAT).select(
        F.col("event_id").alias("beat_id"),
        "user_id",
        F.col("t").alias("bt"),
        F.explode(F.array(*(F.floor(F.col("t") / hour) + k for k in (-1, 0, 1)))).alias("h"),
    )
    c = e.where(CUT).select(F.col("event_id").alias("cut_id"), "user_id", F.col("t").alias("ct"), F.floor(F.col("t") / hour).alias("h"))
    near = b.join(c, ["user_id", "h"]).where(F.abs(F.col("bt") - F.col("ct")) <= hour)
    return near.groupBy("beat_id").agg(F.min(F.struct("ct", "cut_id")).alias("m")).select("beat_id", F.col("m.cut_id").alias("cut_id"))


@query("SELECT event_id, user_id, round(value - prior, 6) AS change FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events) WHERE abs(value - prior) > 50")
def change_detect(spark, sf_dir):
    e = K.previous(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return e.where("abs(value - prior_value) > 50").select("event_id", "user_id", F.round(F.col("value") - F.col("prior_value"), 6).alias("change"))


@query("SELECT user_id, round(1 - least(1.0, stddev_pop(gap) / avg(gap)), 6) AS regularity, count(gap) AS beats FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::DOUBLE / 1000000 AS gap FROM events) GROUP BY user_id HAVING avg(gap) > 0")
def rhythm_regularity(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = table(spark, sf_dir, "events").select(
        "user_id",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6).alias("gap"),
    )
    a = g.groupBy("user_id").agg(F.stddev_pop("gap").alias("s"), F.avg("gap").alias("m"), F.count("gap").alias("beats")).where("m > 0")
    return a.select("user_id", F.round(1 - F.least(F.lit(1.0), F.col("s") / F.col("m")), 6).alias("regularity"), "beats")


@query("SELECT vec_id, next_id, round(list_cosine_similarity(e, n), 5) AS similarity FROM (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE next_id IS NOT NULL")
def consecutive_similarity(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.lead("vec_id").over(w).alias("next_id"),
        F.lead("embedding").over(w).alias("n"),
    )
    return e.where("next_id is not null").select("vec_id", "next_id", F.round(T.cosine(F.col("embedding"), F.col("n")), 5).alias("similarity"))


@query("SELECT source, sha256(string_agg(h, '|' ORDER BY h)) AS digest FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def order_free_digest(spark, sf_dir):
    return P.order_free_digest(docs_of(spark, sf_dir).select("source", T.sha(F.col("text")).alias("h")), "source", "h")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def model_rollup(spark, sf_dir):
    return docs_of(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("n"))
