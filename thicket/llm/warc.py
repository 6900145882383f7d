"""WARC archives with dictionary compression.

Pages become WARC/1.1 records. Of the records with equal payloads (of at least `dedup_bytes` bytes) that with the
smallest page_id is a response, the others are revisits that refer to it by its record id and hold no payload.

An archive is a file of Zstandard frames: a skippable frame (magic 0x184D2A5D) with a dictionary trained on the
archive's own records, the warcinfo record, and then each record as a frame of its own, so that any record can be read
alone from its offset. Archives are written as rows of a table (archive, content) in the shared folder, which any
store that Spark writes to can hold; `export` puts them as .warc.zst files into a folder that all executors share.

Rows meet by payload digest only to take a minimum, which is pre-aggregated, and are joined back, so a payload that a
third of the pages share is split like any skewed join key.

Defined cases: a null html is an empty payload; a null page_id is never a response unless all its copies have none,
then each is; rows that repeat the smallest page_id are all responses; extra columns are dropped; an empty table
gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.llm._store import written
from thicket.session import ship

SKIPPABLE = 0x184D2A5D


@dataclass(frozen=True)
class WarcParams:
    dedup_bytes: int = 0
    archive_bytes: int = 16 << 20  # of payload in an archive
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 2 << 20  # of records that a dictionary is trained on, spread over the archive
    level: int = 6


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id, url: str, kind: str, digest: str, refers_to, payload: bytes) -> bytes:
    """One record; n_payload of a revisit is told in a header, as its block has none of it."""
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archive(records: list[bytes], p: WarcParams = WarcParams()) -> bytes:
    """Dictionary frame, warcinfo and one frame for each record."""
    every = max(1, sum(map(len, records)) // p.sample_bytes)
    samples = [r[: 64 << 10] for r in records[::every]]
    try:
        trained = zstandard.train_dictionary(p.dictionary_bytes, samples, level=p.level).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: their text itself is the dictionary
        trained = b"".join(samples)[-p.dictionary_bytes :]
    dictionary = zstandard.ZstdCompressionDict(trained)
    # the dictionary frame holds the dictionary, itself compressed without one
    packed = zstandard.ZstdCompressor(level=p.level).compress(trained)
    body = b"software: thicket\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    squeeze = zstandard.ZstdCompressor(level=p.level, dict_data=dictionary, write_checksum=True)
    return SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + b"".join(squeeze.compress(r) for r in [info, *records])


def read_archive(content: bytes):
    """The records of an archive, warcinfo first."""
    if int.from_bytes(content[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    size = int.from_bytes(content[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, fed = [], at
        while not d.eof and fed < len(content):
            parts.append(d.decompress(view[fed : fed + (64 << 10)]))
            fed += 64 << 10
        if not d.eof:
            raise ValueError("a record's frame is cut off")
        at = min(fed, len(content)) - len(d.unused_data)
        yield b"".join(parts)


def planned(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of every page."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).withColumn("long", F.octet_length("html") >= p.dedup_bytes)
    first = pages.where("long").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = pages.join(first, "sha", "left")
    revisit = F.col("long") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def archives(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """The written table (archive, content) of a crawl's archives."""
    ship(pages.sparkSession)

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for rows in W.slices(batch, 1 << 20, "html"):
                for r in rows.to_pylist():
                    payload = r["html"].encode()
                    url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                    held.append(encode_record(r["page_id"], url, r["record_type"], digest_of(payload), r["refers_to"], payload))
                    size += len(held[-1])
                    if size >= p.archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([write_archive(held, p)], pa.binary())], names=["archive", "content"])
                        k, held, size = k + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([write_archive(held, p)], pa.binary())], names=["archive", "content"])

    return written(planned(pages, p).mapInArrow(run, "archive bigint, content binary"), "warc", "none", {"parquet.block.size": str(16 << 20)})


def records(archived: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads archives: page_id, payload_bytes, payload_digest, record_type, refers_to (and the stored payload).
    The digest of a response is computed anew and must be the one in its header."""
    ship(archived.sparkSession)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = [[] for _ in range(6)]
                for data in read_archive(content.as_py()):
                    headers, payload = decode_record(data)
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
                    ident = [None if (v := headers.get(h, "<urn:page:none>")[10:-1]) == "none" else int(v) for h in ("WARC-Record-ID", "WARC-Refers-To")]
                    n = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    for c, v in zip(rows, (ident[0], n, digest, kind, ident[1], payload if payloads else None), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    out = archived.select("content").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")
    return out if payloads else out.drop("payload")


def export(archived: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a .warc.zst file into a folder that all executors mount; gives their paths and sizes."""
    import os

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                path = f"{folder}/part-{name:016x}.warc.zst"
                with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                    f.write(content.as_py())
                os.replace(f.name, path)  # a task that runs twice leaves one whole file
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([os.path.getsize(path)], pa.int64())], names=["path", "n_bytes"])

    return archived.mapInArrow(run, "path string, n_bytes bigint")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return records(archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, octet_length(encode(html)) as n, upper(sha1(html)) as x from p),
f as (select x, min(page_id) as first, count(*) as c from s group by x),
b as (select x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4)) & 31)::int, 1), '' order by k) as d from (select x, unnest(generate_series(0, 31)) as k from f) group by x)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when page_id = first or c = 1 or first is null then 'response' else 'revisit' end as record_type, case when page_id = first or c = 1 or first is null then null else first end as refers_to
from s join f using (x) join b using (x)
"""
