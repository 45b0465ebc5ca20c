"""WARC archives: write, read back, resolve revisits, write deduplicated archives.

Records are written by Spark's text writer (one record a row, CRLF CRLF as separator, gzip files),
so files are committed atomically and land on any file system Spark knows. They are read with the
``binaryFile`` source and parsed by Content-Length, hence payloads may hold any bytes. A file holds
at most ``FILE_RECORDS`` records, so that it is read whole in bounded memory.

Null html is an empty payload; repeated page ids are separate records, and of equal (payload, id)
rows one stays a response; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import staged
from ledgerspark.session import staging_path

FILE_RECORDS = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = ("record_id string, page_id bigint, url string, record_type string, payload_digest string, "
            "payload_bytes bigint, content_check string, refers_to bigint, file string, at bigint")


def record_id(kind: str, page_id, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}-{page_id}-{n}')}>"


def make_record(fields: list[tuple[str, str]], payload: str) -> str:
    """Header block, empty line and payload; the writer adds the closing CRLF CRLF."""
    size = len(payload.encode("utf-8"))
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v != ""], f"Content-Length: {size}"]
    return CRLF.join(lines) + CRLF + CRLF + payload


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _line(value) -> str:
    return "" if value is None else str(value).replace("\r", " ").replace("\n", " ")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, offset) of every record of one archive file."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split(CRLF)[1:])
        size = int(head["Content-Length"])
        body = data[stop + 4:stop + 4 + size]
        if len(body) != size or data[stop + 4 + size:stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield head, body, at
        at = stop + 8 + size


def write_archive(records: DataFrame, path: str) -> None:
    """``records(value)`` as gzip archive files under ``path``."""
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _raw_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for b in batches:
        out = []
        for page, url, html in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
            n += 1
            body = html or ""
            raw = body.encode("utf-8")
            out.append(make_record([
                ("WARC-Type", "response"), ("WARC-Record-ID", record_id("raw", page, n)),
                ("WARC-Target-URI", _line(url)), ("X-Page-ID", _line(page)), ("Content-Type", "text/html; charset=utf-8"),
                ("WARC-Payload-Digest", "sha1:" + digest_of(raw))], body))
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})


def archive_pages(pages: DataFrame, path: str) -> str:
    """Write a response record for every page."""
    rows = pages.select("page_id", "url", "html")
    write_archive(rows.mapInArrow(_raw_records, "value string"), path)
    return path


def _read_headers(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _HEADERS.split(", ")] + ["payload"] * payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
             pa.string(), pa.int64()] + [pa.binary()] * payload
    packer = zstandard.ZstdCompressor(level=1)
    for b in batches:
        for file, content in zip(b["path"].to_pylist(), b["content"], strict=True):
            rows = []
            for h, body, at in parse(content.as_py()):
                page, ref = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                kind = h["WARC-Type"]
                size = int(h.get("X-Payload-Length", len(body)))
                digest = h["WARC-Payload-Digest"].split(":", 1)[1]
                if kind == "response" and digest != digest_of(body):
                    raise ValueError(f"{file}: payload digest of the record at {at} doesn't fit")
                rows.append((h["WARC-Record-ID"], int(page) if page is not None else None, h.get("WARC-Target-URI"),
                             kind, digest, size, hashlib.md5(body, usedforsecurity=False).hexdigest(),
                             int(ref) if ref is not None else None, file, at, *([packer.compress(body)] if payload else [])))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archive files: headers, file and offset, and if asked for the
    payload as a zstd frame (payloads are shuffled, so they travel compressed)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _read_headers(it, payload), _HEADERS + ", payload binary" * payload)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each record's type after dedup. Headers only are shuffled, by payload digest (with length
    and a second digest against collisions); of equal payloads of at least ``min_bytes`` the one
    with the smallest page id is the response, every other record revisits it."""
    key = ["payload_digest", "payload_bytes", "content_check"]
    order = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "file", "at", "url")
    firsts = (headers.groupBy(*key).agg(F.count("*").alias("n"), F.min(order).alias("o"))
              .where((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes)).drop("n"))
    mine = (F.col("o.file") == F.col("file")) & (F.col("o.at") == F.col("at"))
    revisit = F.col("o").isNotNull() & ~mine
    return headers.join(firsts, key, "left").select(
        "file", "at", "page_id", "url", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("o.page_id")).alias("refers_to"),
        F.when(revisit, F.col("o.file")).alias("refers_file"), F.when(revisit, F.col("o.at")).alias("refers_at"),
        F.when(revisit, F.col("o.url")).alias("refers_url"))


def _fresh_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for r in b.to_pylist():
            revisit = r["record_type"] == "revisit"
            fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", record_id(r["file"], r["page_id"], r["at"])),
                      ("WARC-Target-URI", _line(r["url"])), ("X-Page-ID", _line(r["page_id"])),
                      ("Content-Type", "text/html; charset=utf-8"),
                      ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]), ("X-Payload-Length", str(r["payload_bytes"]))]
            if revisit:
                fields += [("WARC-Profile", PROFILE),
                           ("WARC-Refers-To", record_id(r["refers_file"], r["refers_to"], r["refers_at"])),
                           ("WARC-Refers-To-Target-URI", _line(r["refers_url"])),
                           ("X-Refers-To-Page-ID", _line(r["refers_to"]))]
            out.append(make_record(fields, "" if revisit else unpacker.decompress(r["payload"]).decode("utf-8")))
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})


def write_deduplicated(spark: SparkSession, raw_path: str, resolved: DataFrame, path: str) -> str:
    """Archives with fresh headers: responses keep their payload, revisits carry headers only. The
    payloads meet their decisions by (file, offset)."""
    raw = read_archive(spark, raw_path, payload=True).select("file", "at", "payload")
    rows = resolved.join(raw, ["file", "at"])
    write_archive(rows.mapInArrow(_fresh_records, "value string"), path)
    return path


def dedup_pages(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Archive the pages, resolve revisits and write the deduplicated archive; its folder and its headers."""
    spark = pages.sparkSession
    raw = archive_pages(pages, staging_path(spark, "warc-raw"))
    headers = staged(read_archive(spark, raw), "warc-headers")
    out = write_deduplicated(spark, raw, resolve(headers, min_bytes), staging_path(spark, "warc-dedup"))
    return out, read_archive(spark, out)
