"""WARC records in ZIP-packaged web archives.

Writing: each task streams gzip members into stored ZIP entries (archive data
and a CDXJ-like index) in the shared folder; a manifest of the files of
successful tasks is what readers use. Reading: the central directory, with its
ZIP64 records, is parsed from the file's end, the index entry located, and each
record fetched by a range read of the stored archive entry; nothing is
extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm.common import fresh_path, materialize, partitions, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD = "archive string, offset long, length long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary"
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")), ("payload", pa.binary())])


def payload_digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record_bytes(record_id: str, kind: str, uri: str, digest: str, body: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP header block only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (body if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def central_directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Stored entries of a ZIP file: name -> (offset of its data, length). ``f`` is
    a random-access file. ZIP64 end records and extra fields are honoured."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = at(struct.unpack("<Q", locator[8:16])[0], 56)
        count, length, start = struct.unpack("<QQQ", record[32:56])
    out, p, cd = {}, 0, at(start, length)
    for _ in range(count):
        method, = struct.unpack("<H", cd[p + 10 : p + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", cd[p + 20 : p + 34])
        where, = struct.unpack("<I", cd[p + 42 : p + 46])
        name, extra = cd[p + 46 : p + 46 + n].decode(), cd[p + 46 + n : p + 46 + n + m]
        wide = [v for v in (plain, packed, where) if v == 0xFFFFFFFF]
        q = 0
        while wide and q + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                values = iter(struct.unpack(f"<{len(wide)}Q", extra[q + 4 : q + 4 + 8 * len(wide)]))
                plain, packed, where = (next(values) if v == 0xFFFFFFFF else v for v in (plain, packed, where))
            q += 4 + width
        if method == 0:
            ln, lm = struct.unpack("<HH", at(where + 26, 4))
            out[name] = (where + 30 + ln + lm, packed)
        p += 46 + n + m + k
    return out


def write_archives(records: DataFrame, folder: str, roll: int = 64 << 20) -> DataFrame:
    """Write rows (record_id, record_type, target_uri, refers_to, body) to archives
    of about ``roll`` bytes in ``folder``; returns the manifest (archive, records,
    bytes). File names are new for each attempt, and only a finished attempt's
    names reach the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        done: list[dict] = []
        rows = (r for b in batches for r in b.to_pylist())
        row = next(rows, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            index: list[str] = []
            with fs.open_output_stream(f"{path}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                at = 0
                with z.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < roll:
                        body = row["body"]
                        digest = payload_digest(body)
                        raw = gzip.compress(record_bytes(row["record_id"], row["record_type"], row["target_uri"], digest, body, row["refers_to"]), 6, mtime=0)
                        data.write(raw)
                        index.append(json.dumps({"offset": at, "length": len(raw), "digest": digest, "id": row["record_id"]}))
                        at += len(raw)
                        row = next(rows, None)
                with z.open(INDEX, "w", force_zip64=True) as lines:
                    lines.write("".join(x + "\n" for x in index).encode())
            done.append({"archive": f"{folder}/{name}", "records": len(index), "bytes": at})
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(records.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, block: int = 8 << 20) -> DataFrame:
    """Records of the archives listed in column ``archive``, by range reads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                size = fs.get_file_info(path).size
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    entries = central_directory(f, size)
                    (data, _), (start, length) = entries[DATA], entries[INDEX]
                    f.seek(start)
                    lines = io.BytesIO(f.read(length))
                    for line in lines:
                        spot = json.loads(line)
                        f.seek(data + spot["offset"])
                        h, body = parse_record(gzip.decompress(f.read(spot["length"])))
                        ref = h.get("warc-refers-to")
                        rows.append({
                            "archive": uri, "offset": spot["offset"], "length": spot["length"], "record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"],
                            "target_uri": h["warc-target-uri"], "refers_to": ref and ref.strip("<>"), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "payload": body,
                        })
                        held += len(body) + 300
                        if held > block:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    spark = manifest.sparkSession
    small_batches(spark)
    return manifest.select("archive").repartition(partitions(spark), "archive").mapInArrow(read, RECORD)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Records of pages. Of equal payloads of at least ``least`` bytes, the page
    with the largest id is the response and others revisit it (a page repeated
    with that id is a response too; a null id is least). Null html is empty, a null
    url is an empty target."""
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("__sha", F.sha1("body"))
    best = rows.where(F.octet_length("body") >= least).groupBy("__sha").agg(F.max("__id").alias("__best"))
    joined = rows.join(best, "__sha", "left")
    revisit = F.col("__best").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__best"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        name("__id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        # header fields end at a line break
        F.regexp_replace("target_uri", "[\\r\\n]+", "%0A").alias("target_uri"), F.when(revisit, name("__best")).alias("refers_to"), "body",
    )


def page_round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives and read every record back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to). A revisit's size is
    that of the response it refers to, found by the payload digest. No pages, no rows."""
    small_batches(spark, 500)
    manifest = write_archives(page_records(pages, least=least), fresh_path(spark, "wacz"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    back = read_archives(manifest).select(page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"), "payload_digest", F.octet_length("payload").cast("long").alias("__bytes"))
    back = materialize(back, "records")
    sizes = back.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("__bytes").alias("payload_bytes"))
    return back.join(sizes, "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
