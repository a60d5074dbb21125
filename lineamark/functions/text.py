"""Column functions: hashes, normal form, provenance tags, validators, type sniffing, similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CREDIT = "Generated with provenance tracking"
# The tag's wording and the patterns that find and delete it.
TAG, VERIFY, INLINE = "AI Provenance Tag: ", "Verify: ", " [AI Generated: "
FIND_TAG, FIND_INLINE, FIND_URL = r"(?U)AI Provenance Tag:\s*([a-zA-Z0-9_-]+)", r"(?U)\[AI Generated:\s*([a-zA-Z0-9_-]+)", r"(?U)Verify:\s*(https?://[^\s\n]+)"
DROP_TAG = (r"(?smd)\n+---+\n+AI Provenance Tag:.*$", r"(?md)^AI Provenance Tag:.*?\n+---+\n+", r"(?Ud)\s*\[AI Generated:.*?\]")
DROP_COMMON = (r"(?smd)\n+---+\n+AI Provenance.*$", r"(?md)^AI Provenance.*\n+---+\n+", r"(?d)\[AI Generated:.*?\]", r"(?U)Verify:\s*https?://[^\s]+")
# What the patterns above begin with.
HEADS = ("AI Provenance", "[AI Generated:", "Verify:")
# The forms of ids.
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
# What says that a tag was taken off; phrases of generated text.
MARKERS = {"removed": r"(?i)(?d)---.*removed.*---", "stripped": r"(?i)(?d)\[.*stripped.*\]"}
PHRASE_LIST = ["As an AI", "I'm sorry, but", "I cannot", "I don't have the ability", "based on the provided information"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """Lower case, ends stripped, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def normalized_sha(text: Column) -> Column:
    return sha(normalized(text))


def uuid_of(key: Column, salt: str) -> Column:
    """A UUID of version 4's shape that is a function of the key, so repeated tasks agree."""
    h = F.md5(F.concat(F.lit(salt), key.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def watermark_id(key: Column) -> Column:
    return F.concat(F.lit("wmk-"), uuid_of(key, "watermark:"))


def marked(text: Column, tag: Column, url: Column, style: str = "footer", credit: str = CREDIT) -> Column:
    """Text with a tag: footer, header, or inline after the first paragraph (a footer where there is none)."""
    footer = F.concat(text, F.lit(f"\n\n---\n{TAG}"), tag, F.lit(f"\n{VERIFY}"), url, F.lit(f"\n{credit}\n"))
    if style == "footer":
        return footer
    if style == "header":
        return F.concat(F.lit(TAG), tag, F.lit(f"\n{VERIFY}"), url, F.lit("\n---\n\n"), text)
    if style == "inline":
        at = F.locate("\n\n", text)
        return F.when(
            at > 0,
            F.concat(F.substring(text, F.lit(1), at + 1), F.lit(INLINE), tag, F.lit("]"), F.substring(text, at + 2, F.length(text))),
        ).otherwise(footer)
    raise ValueError(f"unknown style {style}")


def found(text: Column, pattern: str, head: str) -> Column:
    """The pattern's first group. Only texts that hold head, with which it begins, are searched by it."""
    return F.when(F.contains(text, F.lit(head)), F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def tag_id(text: Column) -> Column:
    return F.coalesce(found(text, FIND_TAG, TAG[:-1]), found(text, FIND_INLINE, INLINE[1:-1]))


def tag_url(text: Column) -> Column:
    return found(text, FIND_URL, VERIFY[:-1])


def without(text: Column, patterns: tuple[str, ...]) -> Column:
    """The text without what the patterns match, in their order, its ends stripped. All of them need one of HEADS."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    marked = F.contains(text, F.lit(HEADS[0]))
    for h in HEADS[1:]:
        marked = marked | F.contains(text, F.lit(h))
    return stripped(F.when(marked, out).otherwise(text))


def unmarked(text: Column) -> Column:
    return without(text, DROP_TAG)


def phrases(text: Column) -> Column:
    """The phrases of PHRASE_LIST that the text has, whatever their case, in the list's order."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in PHRASE_LIST)), lambda p: p.isNotNull())


def stripped_sha(text: Column) -> Column:
    return normalized_sha(without(text, DROP_COMMON))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# The wording of errors.
def artifact_id_error(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", "artifact_id cannot be empty").when(~x.rlike("(?i)" + UUID4), "artifact_id must be valid UUID v4")


def watermark_id_error(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", "watermark_id cannot be empty").when(~x.startswith("wmk-"), "watermark_id must start with 'wmk-'").when(
        ~F.substring(x, F.lit(5), F.length(x)).rlike("(?i)" + UUID),
        "watermark_id must be wmk-{valid-uuid}",
    )


def fragment_id_error(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", "fragment_id cannot be empty").when(~x.startswith("frag_"), "fragment_id must start with 'frag_'").when(
        ~x.rlike(r"(?i)^frag_\d+_[a-z_]+$"),
        "fragment_id must follow pattern: frag_{index}_{location}",
    )


def sha_error(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", "hash cannot be empty").when(
        F.length(x) != 64,
        F.concat(F.lit("SHA-256 hash must be 64 characters, got "), F.length(x).cast("string")),
    ).when(~x.rlike("^[0-9a-f]{64}$"), "SHA-256 hash must be lowercase hex")


def timestamp_error(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", "timestamp cannot be empty").when(F.try_to_timestamp(x).isNull(), "Invalid ISO 8601 timestamp")


def unit_error(x: Column, name: str) -> Column:
    """Of confidence or entropy scores: between 0 and 1."""
    return F.when(x.isNull(), f"{name} must be numeric").when(
        ~x.between(0, 1),
        F.concat(F.lit(f"{name} must be between 0.0 and 1.0, got "), x.cast("string")),
    )


def starts(data: Column, *heads: bytes) -> Column:
    return F.greatest(
        *(F.substring(data, 1, len(h)) == F.lit(bytearray(h)) for h in heads)
    ) if len(heads) > 1 else F.substring(data, 1, len(heads[0])) == F.lit(bytearray(heads[0]))


#: How many bytes are looked at for JSON, and how many characters of a longer one.
SAMPLE, NEAR_HEAD = 8192, 1024


def artifact_type(data: Column) -> Column:
    """Of bytes: magic bytes in a fixed order; JSON by its first SAMPLE bytes; all else is binary. (A string is text.)"""
    has = lambda w: F.instr(F.decode(F.substring(data, 9, 8), "ISO-8859-1"), w) > 0
    riff = starts(data, b"RIFF") & (F.octet_length(data) > 12)
    sample = F.substring(data, 1, SAMPLE).cast("string")
    text = stripped(F.when(F.is_valid_utf8(sample), sample))
    brace, head = F.substring(text, 1, 1), F.substring(text, 1, NEAR_HEAD)
    json = F.when(F.octet_length(data) <= SAMPLE, F.try_parse_json(text).isNotNull()).otherwise(
        ((brace == "{") & head.contains("}")) | ((brace == "[") & head.contains("]"))
    )
    return (
        F.when(starts(data, b"\x89PNG\r\n\x1a\n") | starts(data, b"\xff\xd8\xff") | (riff & has("WEBP")) | starts(data, b"GIF87a", b"GIF89a"), "image")
        .when(starts(data, b"%PDF"), "pdf")
        .when((F.octet_length(data) > 8) & (F.substring(data, 5, 4) == F.lit(bytearray(b"ftyp"))), "video")
        .when((riff & has("WAVE")) | starts(data, b"ID3", b"\xff\xfb", b"\xff\xf3") | starts(data, b"fLaC"), "audio")
        .when(brace.isin("{", "[") & json, "json")
        .otherwise("binary")
    )


def file_type(data: Column) -> Column:
    """Names of eight kinds of binary file."""
    kinds = [
        (b"\x7fELF", "ELF"),
        (b"MZ", "PE executable"),
        (b"\x89PNG", "PNG"),
        (b"\xff\xd8\xff", "JPEG image"),
        (b"%PDF", "PDF document"),
        (b"PK\x03\x04", "ZIP"),
        (b"\x1f\x8b", "GZIP compressed"),
        (b"Rar!", "RAR archive"),
    ]
    out = F.when(F.octet_length(data) < 4, "unknown")
    for head, name in kinds:
        out = out.when(starts(data, head), name)
    return out.otherwise("unknown")
