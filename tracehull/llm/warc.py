"""WARC archives with a two-level capture index.

Writing: one gzip member a record, so any record can be read alone; equal payloads of
at least 100 bytes are stored once and later ones revisit the record of the least page
id. Index: captures are sorted by reversed-host key into compressed blocks, and a sparse
directory keeps each block's first key and place. Reading: binary search in the shards,
then in a shard's directory, one range read of a block, a binary search in the block,
one range read of the record.

Null html counts as empty (a response of 0 bytes), null or malformed URLs get the key
"-", a null page_id is kept and never serves as the response of others, rows that repeat
a page_id are captures of their own (all are responses if that id is the least of its
payload). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attempt_tag, fresh_dir, map_arrow, materialize, open_fs, require

#: Payloads below this many bytes are never deduplicated.
LEAST = 100
BLOCK = 256
LEVEL = 3
_SPACE = uuid.UUID("0b5c2b0e-2f7c-5f0e-9d56-6a1f5f3f7c11")


def url_key(url: str | None) -> str:
    """Host parts from the right, then path and query: ``org,example)/a?b``; case of the host, scheme, user and default port do not count."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "-"
    if not host:
        return "-"
    name = ",".join(reversed(host.split("."))) if not host.replace(".", "").isdigit() else host
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    key = f"{name}{shown}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: tuple[int, str | None] | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record, without compression; a revisit carries the headers alone and names its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {json.dumps(url)[1:-1]}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if response is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response[0])}", f"X-Refers-To-Page-ID: {response[0]}"]
        head += [f"WARC-Refers-To-Target-URI: {json.dumps(response[1])[1:-1]}"] if response[1] is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record; raises if its length or end is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs")
    return fields, rest[:n]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, to_id, to_url) of pages whose payload a page of lesser id has; no payload is shuffled."""
    narrow = pages.where((F.col("bytes") >= LEAST) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    first = narrow.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    shared = first.where(F.col("last") > F.col("first.page_id")).select(F.col("digest").alias("_d"), F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url"))
    found = narrow.join(shared, F.col("digest") == F.col("_d")).where("page_id > to_id")
    return found.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "to_id", "to_url").distinct()


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzip-member WARC files; one row a capture: key, page_id, file, offset, length."""
    require(pages, "page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    known = materialize(revisits(read), "revisits")
    joined = read.join(known, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "to_id", "to_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, out, offset = attempt_tag(), None, 0
        fs, base = open_fs(folder)
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for page_id, url, digest, to_id, to_url, html in zip(*columns, batch.column(2), strict=True):
                data = (html.as_py() or "").encode()
                member = gzip.compress(record(page_id, url, data, digest, None if to_id is None else (to_id, to_url)), LEVEL, mtime=0)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{tag}.warc.gz", compression=None, buffer_size=1 << 20)
                out.write(member)
                rows.append((url_key(url), page_id, f"{folder}/{tag}.warc.gz", offset, len(member)))
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(map_arrow(joined, write, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by key into compressed blocks with a sparse directory; one row a shard: shard, file, first_key, last_key, captures."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, out, offset, count, first, last = attempt_tag(), None, 0, 0, None, None
        fs, base = open_fs(folder)
        directory, lines, top = [], [], None

        def block() -> None:
            nonlocal offset, lines, top
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append(f"{top}\t{offset}\t{len(data)}\t{len(lines)}")
            offset += len(data)
            lines, top = [], None

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{tag}.blocks")
                    first = row[0]
                top, last = row[0] if top is None else top, row[0]
                lines.append("\t".join(["" if v is None else str(v) for v in row]))
                count += 1
                if len(lines) == BLOCK:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with fs.open_output_stream(f"{base}/{tag}.directory") as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"shard": [int(tag.split("-")[0])], "file": [f"{folder}/{tag}"], "first_key": [first], "last_key": [last], "captures": [count]})

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialize(map_arrow(ordered, write, "shard long, file string, first_key string, last_key string, captures long"), "shards")


class Index:
    """Look-ups in the shards of an index; a worker keeps the directory and block it used last."""

    def __init__(self, shards: list[tuple[str, str, str]]):
        #: (first_key, last_key, file), in order of keys
        self.shards = shards
        self.last_keys = [s[1] for s in shards]
        self.directory = functools.lru_cache(maxsize=4)(self._directory)
        self.block = functools.lru_cache(maxsize=4)(self._block)

    @staticmethod
    def _directory(file: str) -> tuple[list[str], list[tuple[int, int]]]:
        fs, base = open_fs(file)
        with fs.open_input_stream(f"{base}.directory") as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    @staticmethod
    def _block(file: str, offset: int, length: int) -> tuple[list[str], list[list[str]]]:
        fs, base = open_fs(file)
        with fs.open_input_file(f"{base}.blocks") as f:
            rows = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
        return [r[0] for r in rows], rows

    def find(self, key: str) -> Iterator[tuple[int | None, str, int, int]]:
        """Captures of ``key``: page_id, file, offset, length."""
        for at in range(bisect.bisect_left(self.last_keys, key), len(self.shards)):
            first, _, file = self.shards[at]
            if first > key:
                return
            tops, places = self.directory(file)
            for b in range(max(0, bisect.bisect_left(tops, key) - 1), len(tops)):
                if tops[b] > key:
                    break
                keys, rows = self.block(file, *places[b])
                for i in range(bisect.bisect_left(keys, key), len(keys)):
                    if keys[i] != key:
                        break
                    r = rows[i]
                    yield int(r[1]) if r[1] else None, r[2], int(r[3]), int(r[4])


def look_up(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """All captures of the distinct ``keys`` (key: string), read from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The list of shards, one entry a file, goes to the tasks; directories and blocks are read there.
    """
    listed = [(r["first_key"], r["last_key"], r["file"]) for r in shards.orderBy("shard").toLocalIterator()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(listed)
        handles: dict[str, object] = {}

        def record_at(file: str, offset: int, length: int) -> bytes:
            if file not in handles:
                if len(handles) >= 64:
                    handles.pop(next(iter(handles))).close()
                fs, base = open_fs(file)
                handles[file] = fs.open_input_file(base)
            return zlib.decompress(handles[file].read_at(length, offset), 31)

        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for page_id, file, offset, length in index.find(key):
                    fields, block = parse(record_at(file, offset, length))
                    if fields["x-page-id"] != ("" if page_id is None else str(page_id)):
                        raise ValueError("the index and the archive differ")
                    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError("damaged payload")
                    to = fields.get("x-refers-to-page-id")
                    rows.append((page_id, size, digest, fields["warc-type"], None if to is None else int(to)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives with their index in the shared folder, then read every page back through the index."""
    folder = fresh_dir(pages.sparkSession, "warc")
    captures = write_archive(pages, f"{folder}/archive")
    shards = write_index(captures, f"{folder}/index")
    return look_up(captures.select("key"), shards)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
