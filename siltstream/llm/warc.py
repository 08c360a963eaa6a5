"""WARC archives with a two-level capture index (operator 1).

Tasks write archives of one gzip member for each record. The index has a line for each capture: the
reversed-host key of its URL, the page and where its record lies. Lines are sorted over range
partitions and packed into compressed blocks; a sparse directory holds each block's first key.
A look-up searches the directory in halves, reads one range of an index file, searches the block in
halves and leads to a range of an archive.

Files are written and read with pyarrow's file systems (local, S3, GCS; HDFS needs libhdfs on the
executors). A task attempt writes files under names of its own, and only rows of attempts that
succeeded name them, so lost executors and repeated attempts leave no wrong records.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.plans.shared import scratch, small, stage

#: Payloads of at least so many bytes may be revisits.
LEAST = 100
#: Bytes after which a task begins another archive; lines of a block; blocks that the directory may have.
ARCHIVE_BYTES, BLOCK_LINES, DIRECTORY_ROWS = 256_000_000, 1000, 100_000
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def surt(url: str | None) -> str:
    """The reversed-host key: ``com,example,www)/path?query``. Null is ''; what is no URL with a host is kept in lower case."""
    if not url:
        return ""
    url = re.sub(r"[\x00-\x20]", "", url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    if not re.fullmatch(r"[0-9.]+|.*:.*", host):
        host = ",".join(reversed(host.split(".")))
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host += f":{port}"
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _record(page, url, payload: bytes, kind: str, refers, date: str) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    ident = lambda k, p: f"<{uuid.uuid5(_SPACE, f'{k}:{p}').urn}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident(kind, page)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ident('response', refers)}"]
        lines += [f"X-Refers-To-Page-Id: {refers}"] if refers is not None else []
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit) of one gzip member; raises ValueError where the digest doesn't hold."""
    record = zlib.decompress(member, 31)
    end = record.index(b"\r\n\r\n")
    version, *lines = record[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = record[end + 4 : end + 4 + int(fields["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if fields["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {fields['WARC-Record-ID']}")
    return fields, payload


ENTRY = "key string, page_id bigint, file string, at bigint, size bigint"


def _write(folder: str, date: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, html, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "kind", "refers")), strict=True):
                if out is None or at > limit:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = _record(page, url, (html or "").encode(), kind, refers, date)
                out.write(member)
                rows.append((surt(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                yield _batch(rows)
        if out is not None:
            out.close()

    return run


_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def with_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, kind, refers): of equal payloads of LEAST bytes or more the smallest page_id is the response.

    Ties go to the smaller URL; of rows alike in page_id, URL and payload one is the response. A null
    page_id comes after all others, a null URL before.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    d = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    d = d.withColumn("digest", F.when(F.octet_length(html) >= LEAST, F.sha2(html, 256)))
    alike = d.where("digest is not null").groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("same"))
    first = F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", "url", "same")).alias("first")
    shared = alike.groupBy("digest").agg(first, F.sum("same").alias("n")).where("n > 1")
    shared = stage(shared.select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("refers"), F.col("first.url").alias("_url"), F.col("first.same").alias("_same")), "shared-payloads")
    d = d.join(small(shared), F.col("digest") == F.col("_digest"), "left")
    lead = F.col("_digest").isNull() | (F.col("page_id").eqNullSafe(F.col("refers")) & F.col("url").eqNullSafe(F.col("_url")))
    d = d.withColumn("_lead", lead)
    kind = lambda response: F.when(response, "response").otherwise("revisit").alias("kind")
    refers = lambda response: F.when(~response, F.col("refers")).alias("refers")
    names = ["page_id", "url", "html"]
    if not shared.where("_same > 1").limit(1).count():
        return d.select(*names, kind(F.col("_lead")), refers(F.col("_lead")))
    twice = F.col("_lead") & (F.coalesce("_same", F.lit(1)) > 1)
    one = d.where(~twice).select(*names, kind(F.col("_lead")), refers(F.col("_lead")))
    more = d.where(twice).groupBy(*names).agg(F.first("refers").alias("refers"), F.count(F.lit(1)).alias("n"))
    more = more.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return one.unionByName(more.select(*names, kind(F.col("i") == 1), refers(F.col("i") == 1)))


def write_warc(pages: DataFrame, folder: str, date: str = DATE, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below ``folder``; their captures (key, page_id, file, at, size), stored in the shared folder."""
    return stage(with_kinds(pages).mapInArrow(_write(folder, date, limit), ENTRY), "captures")


def _pack(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, out, at, held = f"index-{uuid.uuid4().hex}.gz", None, 0, []

        def block():
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode()) + packer.flush()
            out.write(data)
            row = _batch([(held[0][0], held[0][1], name, at, len(data))])
            at += len(data)
            held.clear()
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= lines:
                    yield block()
        if held:
            yield block()
        if out is not None:
            out.close()

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write index blocks below ``folder``; the directory: first key and page of each block, and where it is.

    Blocks have BLOCK_LINES lines, or more where the directory would exceed about DIRECTORY_ROWS rows.
    """
    n = captures.count()
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "at"]
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(_pack(folder, max(BLOCK_LINES, -(-n // DIRECTORY_ROWS))), ENTRY), "directory")


def _place(key: str, page) -> tuple:
    """Sorts as Spark does: text by UTF-8 bytes, null first."""
    return key.encode(), -(1 << 63) if page is None else page


class Index:
    """The directory in memory (its rows are bounded) and the last block that was read."""

    def __init__(self, directory: list[tuple], folder: str):
        self.rows = sorted(directory, key=lambda r: (*_place(r[0], r[1]), r[2], r[3]))
        self.first = [_place(r[0], r[1]) for r in self.rows]
        self.folder, self.fs, self.root = folder, None, ""
        self.held: tuple[int, list, list] = (-1, [], [])

    def __getstate__(self):
        return {"rows": self.rows, "first": self.first, "folder": self.folder, "fs": None, "root": "", "held": (-1, [], [])}

    def block(self, i: int) -> tuple[list, list]:
        if self.held[0] != i:
            if self.fs is None:
                self.fs, self.root = _open(self.folder)
            _, _, name, at, size = self.rows[i]
            with self.fs.open_input_file(f"{self.root}/{name}") as f:
                lines = [json.loads(x) for x in zlib.decompress(f.read_at(size, at), 31).decode().split("\n")]
            self.held = (i, lines, [_place(x[0], x[1]) for x in lines])
        return self.held[1:]

    def find(self, key: str, page=None, any_page: bool = False) -> Iterator[tuple]:
        """Captures of a key, and of one of its pages unless ``any_page``."""
        low = _place(key, None if any_page else page)
        high = (key.encode(), 1 << 63) if any_page else low
        i = max(0, bisect_left(self.first, low) - 1)
        while i < len(self.rows) and self.first[i] <= high:
            lines, places = self.block(i)
            for x in lines[bisect_left(places, low) : bisect_right(places, high)]:
                yield tuple(x)
            i += 1


def open_index(directory: DataFrame, folder: str) -> Index:
    """For look-ups on the driver or, broadcast, in tasks; the directory has at most about DIRECTORY_ROWS rows."""
    return Index([tuple(r) for r in directory.collect()], folder)


def look_up(index: Index, asked: DataFrame) -> DataFrame:
    """Captures of all rows (url, page_id) of ``asked``; rows alike are looked up once."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], ["key", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in shared.value.find(k, p)]
            if rows:
                yield _batch(rows)

    asked = asked.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keys, "key string, page_id bigint")
    asked = stage(asked.distinct(), "asked")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stage(asked.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, ENTRY), "found")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the captures; payload null for revisits."""
    spark = captures.sparkSession
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, file = None, None
        number = lambda x: None if x is None else int(x)
        for b in batches:
            rows = []
            for n, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                if n != name:
                    if file is not None:
                        file.close()
                    name, file = n, fs.open_input_file(f"{root}/{n}")
                h, payload = parse_record(file.read_at(size, at))
                kind = h["WARC-Type"]
                rows.append((number(h.get("X-Page-Id")), h.get("WARC-Target-URI"), payload if kind == "response" else None, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), kind, number(h.get("X-Refers-To-Page-Id"))))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if file is not None:
            file.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages written as WARC and read back through the index.

    One row per row of ``pages``. A null html is an empty payload, shorter payloads than 100 bytes are
    always responses. Null page_ids and URLs are captures like others; a revisit of a null page_id
    refers to null. Empty tables give an empty result.
    """
    spark = pages.sparkSession
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    directory = build_index(write_warc(pages, archives), index)
    found = look_up(open_index(directory, index), pages.select(pages["url"].alias("url"), pages["page_id"].alias("page_id")))
    return read_records(found, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
