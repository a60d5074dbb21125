"""A provenance trailer behind any bytes, as column expressions: put on, read, asked for, taken off.

The trailer is magic, marker, length of the JSON (32 bits, little-endian), JSON, magic. Bytes are looked at as
ISO-8859-1 text, a character for each byte, so that all of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineamark.functions.text import sha

#: Format: the magic before and after, the marker. Give others to read trailers of another origin.
MAGIC, MARKER = b"LMRK\x00\x01", b"TAGS"
VERSION = "1.0"
#: Confidences of bytes that equal the marked ones, the plain ones, or bear the trailer of the artifact.
MARKED, PLAIN, TAGGED = 1.0, 0.99, 0.9


def length_bytes(n: Column) -> Column:
    """Four bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, a, 2) for a in (7, 5, 3, 1))))


def metadata(watermark_id: Column, model_id: Column, timestamp: Column, url: Column | None = None, **more: Column) -> Column:
    """The trailer's JSON; a null or empty url is left out."""
    named = [watermark_id.alias("watermark_id"), model_id.alias("model_id"), timestamp.alias("timestamp"), F.lit(VERSION).alias("version")]
    if url is not None:
        named.append(F.nullif(url, F.lit("")).alias("verification_url"))
    return F.to_json(F.struct(*named, *(c.alias(k) for k, c in more.items())))


def tagged(data: Column, json: Column, magic: bytes = MAGIC, marker: bytes = MARKER) -> Column:
    body = json.cast("binary")
    return F.concat(data, F.lit(bytearray(magic + marker)), length_bytes(F.octet_length(body)), body, F.lit(bytearray(magic)))


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def trailer_start(data: Column, magic: bytes = MAGIC, marker: bytes = MARKER) -> Column:
    """Bytes before the last magic and marker, where the data end with the magic; null without a trailer."""
    head = (magic + marker).decode("latin-1")
    n = F.octet_length(data)
    rest = _latin(F.substring(data, F.lit(1), n - len(magic)))
    back = F.locate(head[::-1], F.reverse(rest))
    ends = F.substring(data, n - len(magic) + 1, F.lit(len(magic))) == F.lit(bytearray(magic))
    return F.when((n >= 20) & ends & (back > 0), n - len(magic) - back + 1 - len(head))


def trailer_json(data: Column, magic: bytes = MAGIC, marker: bytes = MARKER) -> Column:
    """The trailer's JSON; null if there is none, if its length goes beyond the data, or if it can't be parsed."""
    at, n, head = trailer_start(data, magic, marker), F.octet_length(data), len(magic) + len(marker)
    h = F.hex(F.substring(data, at + head + 1, F.lit(4)))
    length = F.conv(F.concat(*(F.substring(h, a, 2) for a in (7, 5, 3, 1))), 16, 10).cast("long")
    text = F.substring(data, at + head + 5, length.cast("int"))
    fits = (at + head + 4 <= n - len(magic)) & (at + head + 4 + length <= n - len(magic))
    json = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
    return F.when(fits & F.try_parse_json(json).isNotNull(), json)


def trailer_id(data: Column, magic: bytes = MAGIC, marker: bytes = MARKER) -> Column:
    return F.get_json_object(trailer_json(data, magic, marker), "$.watermark_id")


def untagged(data: Column, magic: bytes = MAGIC, marker: bytes = MARKER) -> Column:
    """The bytes before the trailer; all of them where there is none (or an empty one)."""
    json = trailer_json(data, magic, marker)
    return F.when(json.isNotNull() & (json != "{}"), F.substring(data, F.lit(1), trailer_start(data, magic, marker))).otherwise(data)


def confidence(data: Column, hash_after: Column, hash_before: Column, watermark_id: Column) -> Column:
    """Of bytes against an artifact: its marked bytes, its plain ones, others with its trailer, none of these."""
    own = sha(data)
    return F.when(own == hash_after, MARKED).when(own == hash_before, PLAIN).when(trailer_id(data) == watermark_id, TAGGED).otherwise(0.0)
