"""Web archives (WARC 1.1, a gzip member for each record), written in sorted shards.

Pages are range-sorted by id, and each range writes its own shard: files that start
with a warcinfo record and are rolled once their compressed size reaches a limit.
Headers, digests and record ids are made anew from the page, so contents depend on
the table alone. Files appear by renaming; the manifest, written last, lists each
with its size, checksum and records, and only listed files are read.

Pages with equal payloads are written once: the one with the largest id is the
response, the others are revisit records that refer to it and carry no payload. Which
is which is decided over ids and digests alone; only the decisions about revisits join
the one shuffle that carries payloads.

Defined results: null html is an empty payload. Null ids count as smaller than all
others; rows that share payload and the largest id, and all rows of a group whose ids
are all null, are responses. A null URL is written as ``urn:page:`` and the id. Rows
are never dropped, repeated or not. An empty table gives an empty manifest. Other
columns are ignored. A payload, however long, is held whole by the task that writes or
reads its record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.files import NewFile, batch, locate
from tidewatch.llm.runtime import scratch, ship, spill, table

ROLL_BYTES = 256 << 20
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, records bigint, bytes bigint, sha256 string, first_page bigint, last_page bigint"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _clean(url: str | None, page: int | None) -> str:
    """A header value without blanks or control characters."""
    if url is None:
        return f"urn:page:{'' if page is None else page}"
    return "".join(c if "!" <= c <= "~" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page: int | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{sha1.hex()}')}>"


def _member(kind: str, headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without time or name
    return z.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + z.flush()


def page_record(page: int | None, url: str | None, html: bytes, refers: tuple[int, str | None] | None, level: int = LEVEL) -> bytes:
    """The record of one page; ``refers``: id and URL of the response that a revisit refers to."""
    sha1 = hashlib.sha1(html).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    head = [("WARC-Record-ID", _record_id(page, sha1)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url, page)), ("WARC-Payload-Digest", f"sha1:{_base32(sha1)}"), ("Content-Type", "application/http;msgtype=response")]
    if page is not None:
        head.append(("X-Page-ID", str(page)))
    if refers is None:
        return _member("response", head, http + html, level)
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers[0], sha1)), ("WARC-Refers-To-Target-URI", _clean(refers[1], refers[0])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers[0]))]
    return _member("revisit", head, http, level)


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, roll: int, level: int) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    done: list[tuple] = []
    now: NewFile | None = None
    count, first, last = 0, None, None
    decided: dict[tuple, tuple] = {}
    at_id: object = ()

    def start() -> NewFile:
        name = f"shard-{shard:06d}-{len(done):05d}.warc.gz"
        f = NewFile(folder, name)
        info = b"format: WARC File Format 1.1\r\n"
        f.write(_member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, level))
        return f

    def close() -> None:
        nonlocal now, count
        now.commit()
        done.append((now.name, count, now.size, now.sum.hexdigest(), first, last))
        now, count = None, 0

    try:
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page, is_page, sha1, url, html, refers_to, refers_url = r
                if not is_page:  # the decision about an id and payload comes before its pages
                    decided, at_id = {sha1: (refers_to, refers_url)}, page
                    continue
                if page != at_id:
                    decided, at_id = {}, page
                html = html or b""
                if now is None:
                    now, first = start(), page
                now.write(page_record(page, url, html, decided.get(hashlib.sha1(html).hexdigest()) if decided else None, level))
                count, last = count + 1, page
                if now.size >= roll:
                    close()
        if now is not None:
            close()
    except BaseException:
        if now is not None:
            now.abort()
        raise
    yield batch({k: (list(v), t) for (k, t), v in zip((("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())), zip(*done, strict=True) if done else [()] * 6, strict=True)})


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, roll: int = ROLL_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archives and their manifest under ``folder``; the manifest is returned."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"))
    ids = rows.select("page_id", F.sha1("html").alias("sha1"), "url").where(F.octet_length("html") >= least_bytes)
    heads = spill(ids.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("head"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("head.page_id").isNotNull()).select("sha1", F.col("head.page_id").alias("refers_to"), F.col("head.url").alias("refers_url")))
    revisits = ids.drop("url").join(heads, "sha1").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))).distinct()
    none = F.lit(None)
    whole = rows.select("page_id", F.lit(True).alias("is_page"), none.cast("string").alias("sha1"), "url", "html", none.cast("bigint").alias("refers_to"), none.cast("string").alias("refers_url"))
    decisions = revisits.select("page_id", F.lit(False).alias("is_page"), "sha1", none.cast("string").alias("url"), none.cast("binary").alias("html"), "refers_to", "refers_url")
    every = whole.unionByName(decisions)
    # by payload too, so that pages without an id, however many, are shared out
    keyed = every.withColumn("k", F.coalesce("sha1", F.sha1("html"))).repartitionByRange("page_id", "k")
    dealt = keyed.sortWithinPartitions("page_id", "k", "is_page", "url").select(*every.columns)
    dealt.mapInArrow(lambda b: _write_batches(b, f"{folder}/files", roll, level), _MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    data = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    if parts:
                        raise ValueError("a gzip member is cut off")
                    return
            parts.append(z.decompress(data))
            data = z.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, with its block digest checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def _read_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
    for b in batches:
        for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, path = locate(f"{folder}/files/{name}")
            rows, seen = [], 0
            with store.open_input_stream(path, compression=None) as f:
                for member in _members(f):
                    h, block = parse(member)
                    if h["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
                    digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(stated["content-length"])
                    if h["warc-type"] == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"damaged payload {h['warc-record-id']}")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page-id")))
                    seen += 1
                    if len(rows) == 8192:
                        yield batch({k: (list(v), t) for (k, t), v in zip(kinds, zip(*rows, strict=True), strict=True)})
                        rows = []
            if seen != records:
                raise ValueError(f"{name} holds {seen} records, the manifest says {records}")
            if rows:
                yield batch({k: (list(v), t) for (k, t), v in zip(kinds, zip(*rows, strict=True), strict=True)})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each page record of the files in the manifest under ``folder``, digests verified."""
    ship(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return manifest.select("file", "records").repartition("file").mapInArrow(lambda b: _read_batches(b, folder), _READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder)
