"""Dictionary-compressed WARC archives: writer and reader.

An archive (.warc.zst) begins with a skippable frame that holds a Zstandard dictionary, built from records of this
very archive; each record follows as a frame of its own, so any record can be read alone. Payloads that are equal are
stored once: of the rows with an equal payload of at least min_bytes, that with the least id is the response, the
others are revisit records that refer to it. Each task writes archives of bounded size; a manifest names those of
tasks that succeeded, and only these are read, so a repeated task leaves no double records.

Payloads aren't shuffled to learn what they equal: only their hashes are, and the payloads that occur more than once
(hash and least id) are broadcast if they were counted to be at most TOLD. Only beyond that the rows go through a
shuffle, with payloads of very many rows kept out of it. All empty payloads have one least id, found by one sum.

A null html is the empty payload, which counts as equal to other empty ones when min_bytes is 0. A null url is left
out; control characters in urls are percent-encoded. Rows with a null id are responses without an id. Rows that repeat
the least id of an equal payload are all responses. An empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineamark.llm.shared import looked_up, new_path, written

#: Raw bytes of records in an archive, about; bytes of samples and of the dictionary.
ARCHIVE, SAMPLES, DICTIONARY = 1 << 24, 1 << 21, 1 << 16
LEVEL = 3
#: Payloads that occur more than once (about 40 bytes each) up to which they are broadcast.
TOLD = 1_000_000
#: Fixed values of the formats.
SKIPPABLE, DICT_MAGIC = 0x184D2A5D, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}|{payload_digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of refers_to, as bytes."""
    own = digest(payload)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, own)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{own}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url)))
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    head.append(("X-Payload-Length", str(len(payload))))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, own)), ("X-Refers-To-Page", str(refers_to))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """An archive of records: the dictionary's frame, then a frame for each record."""
    step = max(1, sum(map(len, records)) // SAMPLES)
    samples = records[::step]
    try:
        own = zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, samples)) // 8)), samples, level=level)
    except zstandard.ZstdError:  # too few or too short samples: the first record itself serves
        own = zstandard.ZstdCompressionDict(records[0][:DICTIONARY] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = own.as_bytes()
    c = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(c.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at at ends, found by its block headers."""
    flag = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * flag


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    view = memoryview(data)
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary's frame")
    raw = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICT_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    at = 8 + size
    while at < len(data):
        end = frame_end(view, at)
        yield d.decompress(view[at:end])
        at = end


def parsed(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, and the payload (what follows the HTTP head)."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def put(uri: str, data: bytes) -> None:
    """Write a file into a local or any other folder that pyarrow knows."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        system, path = fs.LocalFileSystem(), urlsplit(uri).path
    else:
        system, path = fs.FileSystem.from_uri(uri)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def referred(rows: DataFrame, min_bytes: int, told: int) -> DataFrame:
    """rows (page, url, html, sha, size) with refers: the least id of those with the same payload, where that is another."""
    fit = (F.col("size") >= min_bytes) & F.col("page").isNotNull()
    keys = rows.where(fit & (F.col("size") > 0)).groupBy("sha").agg(F.min("page").alias("least"), F.count("*").alias("n")).where("n > 1")
    twice = written(keys, "equal-payloads")
    empty = rows.where(fit & (F.col("size") == 0)).agg(F.min("page")).first()[0]
    if twice.count() <= told:
        found = rows.join(F.broadcast(twice.select("sha", "least")), "sha", "left")
    else:
        found = looked_up(rows, twice, ["sha"], "n", rows.select("page").count())
    least = F.when(F.col("size") == 0, F.lit(empty).cast("long")).otherwise(F.col("least"))
    return found.withColumn("refers", F.when(fit & (F.col("page") != least), least)).select("page", "url", "html", "refers")


def write(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE,
    told: int = TOLD,
) -> DataFrame:
    """Write all rows of pages into archives in folder; gives the manifest (path, records) as a written table."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html")})
    shas = referred(rows, min_bytes, told)
    spark = pages.sparkSession
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        held: list[bytes] = []
        size = number = 0

        def flushed() -> pa.RecordBatch:
            nonlocal size, number
            path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
            put(path, archive(held))
            out = pa.RecordBatch.from_pydict({"path": [path.rpartition("/")[2]], "records": pa.array([len(held)], pa.int64())})
            held.clear()
            size, number = 0, number + 1
            return out

        for batch in batches:
            for k in range(batch.num_rows):  # row by row: a whole batch as Python objects could be large
                page, url, html, refers = (batch.column(j)[k].as_py() for j in range(4))
                held.append(record(page, url, html.encode(), refers, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flushed()
        if held:
            yield flushed()

    return written(shas.mapInArrow(run, "path string, records long"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """All records of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                out: list[list] = [[] for _ in names]
                size = 0
                for rec in records(batch.column(1)[k].as_py()):
                    f, payload = parsed(rec)
                    own = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = f["WARC-Type"] == "response"
                    if response and (digest(payload) != own or len(payload) != int(f["X-Payload-Length"])):
                        raise ValueError(f"record {f['WARC-Record-ID']} was damaged")
                    row = [
                        int(f["X-Page-Id"]) if "X-Page-Id" in f else None,
                        f.get("WARC-Target-URI"),
                        int(f["X-Payload-Length"]),
                        own,
                        f["WARC-Type"],
                        None if response else int(f["X-Refers-To-Page"]),
                        payload if response else None,
                    ]
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    size += len(payload)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                        out, size = [[] for _ in names], 0
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return files.join(manifest.select("path").distinct(), "path", "left_semi").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "archives")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in SQL: an independent digest of each payload, in base32 by groups of 20 bits.
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {s}) & 31) + 1 AS INTEGER), 1)" for i in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM b
"""
