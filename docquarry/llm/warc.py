"""Operator 1: WARC archives with a two-level capture index.

Each page is a WARC record, a gzip member of its own; of pages with equal payloads all but the first are revisit records without the payload. The index
sorts captures by reversed-host URL key into compressed blocks. A sparse directory holds each block's first key, and a short list each
directory's; a look-up searches both and then the block by bisection and reads one range of the archive.

A null html is an empty payload, a null url the key ``-``; an empty table gives no archives and no rows. Payloads of any length are one record each, held
in memory one at a time. Other columns aren't read, whatever their names. Pages with equal payloads of ``MIN_REVISIT`` bytes or more revisit that with the smallest
page_id; a null page_id comes after all others. Rows repeated with their page_id and payload are alike, all response or all revisit.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, own, shared_dir, slices, table, written

#: Bytes from which equal payloads are revisited; lines of an index block; gzip level.
MIN_REVISIT, LINES, LEVEL = 0, 1024, 4
#: Bytes of archives that one task reads back.
READ = 4 << 20
#: Bytes of a list of repeated payloads up to which it is broadcast.
LIMIT = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_url = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*|\[[^\]]*\])(?::(\d*))?(.*)$", re.DOTALL)
_control = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """A URL with its host reversed, as ``org,example,www)/path?query``; other strings stay as they are."""
    if not url:
        return "-"
    url = _control.sub(lambda m: f"%{ord(m[0]):02X}", url)
    m = _url.match(url)
    if not m:
        return url
    host, port, rest = m[1].lower().rstrip("."), m[2], m[3].partition("#")[0]
    host = host if host.startswith("[") or re.fullmatch(r"[\d.]*", host) else ",".join(reversed(host.split(".")))
    return f"{host}{':' + port if port and port not in ('80', '443') else ''}){rest if rest.startswith('/') else '/' + rest}"


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {2**64 - 1 if page_id is None else page_id + 2**63:020d}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=1 << 127 if page_id is None else page_id + 2**63)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record[10:-1]).int
    return None if n >> 127 else n - 2**63


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """A record as bytes, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + _control.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """What a record says; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    n, digest, revisit = int(_fields(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != n or digest_of(payload) != digest):
        raise ValueError("a payload isn't what its record says")
    return {"page_id": page_of(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": page_of(warc["warc-refers-to"]) if revisit else None, "payload": payload}


_CAPTURES = "key string, file string, offset bigint, length bigint"


def _write(folder: str):
    """Writes a task's records into an archive of its own; a task that runs again writes another, and only the one whose rows are kept counts."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in slices(batches):
                rows = []
                for page, url, html, revisit, first in zip(*[c.to_pylist() for c in b.columns]):
                    payload = (html or "").encode()
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    body = packer.compress(record(url, page, payload, digest_of(payload), first, revisit)) + packer.flush()
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(body)
                    rows.append((capture_key(url, page), name, at, len(body)))
                    at += len(body)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def _with_roles(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, revisit and first: the page that a revisit refers to."""
    p = own(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sum"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    groups = p.where(F.col("size") >= min_revisit).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = written(groups, "repeated")
    both = join_unique(p, groups.drop("n"), "sum", groups.select("sum", "n"), p.count(), "left", limit=LIMIT)
    return both.select("page_id", "url", "html", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("revisit"), "first")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the pages' records into archives in ``folder``; (key, file, offset, length) of each."""
    return written(_with_roles(pages, min_revisit).mapInArrow(_write(folder), _CAPTURES), "captures")


_PARTS = "first string, name string"


def _blocks(folder: str, lines: int):
    """Writes a partition of sorted captures as compressed blocks and their directory; gives its first key."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at, held, directory = uuid.uuid4().hex, None, 0, [], []

        def flush():
            nonlocal out, at, held
            out = out or store.open_output_stream(f"{path}/{name}.blocks", compression=None)
            body = zlib.compress("\n".join(held).encode())
            out.write(body)
            directory.append((held[0].split("\t", 1)[0], at, len(body)))
            at, held = at + len(body), []

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                held.append("\t".join(map(str, row)))
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first", "name"])

    return run


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Writes the index into ``folder``; (first, name) of each of its parts, one for each task."""
    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.select("key", "file", "offset", "length").mapInArrow(_blocks(folder, lines), _PARTS), "parts")


class Index:
    """Look-ups in an index and its archives."""

    def __init__(self, parts: list[tuple[str, str]], index_folder: str, archive_folder: str):
        parts = sorted(parts)
        self.firsts, self.names = [p[0] for p in parts], [p[1] for p in parts]
        self.store, self.path = fs.FileSystem.from_uri(index_folder)
        self.archives, self.at = fs.FileSystem.from_uri(archive_folder)
        self.directory = lru_cache(8)(self._directory)
        self.block = lru_cache(8)(self._block)
        self.files: dict = {}

    def _directory(self, name: str) -> tuple[list, list]:
        with self.store.open_input_file(f"{self.path}/{name}.directory") as f:
            rows = json.loads(zlib.decompress(f.read()))
        return [r[0] for r in rows], rows

    def _block(self, name: str, at: int, size: int) -> list[list[str]]:
        with self.store.open_input_file(f"{self.path}/{name}.blocks") as f:
            lines = zlib.decompress(f.read_at(size, at)).decode().split("\n")
        return [x.split("\t") for x in lines]

    def captures(self, low: str, high: str) -> list[list[str]]:
        """The index's lines with low <= key < high."""
        out = []
        for p in range(max(0, bisect_left(self.firsts, low) - 1), bisect_left(self.firsts, high)):
            firsts, rows = self.directory(self.names[p])
            for k in range(max(0, bisect_left(firsts, low) - 1), bisect_left(firsts, high)):
                lines = self.block(self.names[p], *rows[k][1:])
                begin = bisect_left(lines, low, key=lambda x: x[0])
                while begin < len(lines) and lines[begin][0] < high:
                    out.append(lines[begin])
                    begin += 1
        return out

    def read(self, line: list[str]) -> dict:
        """The record that a line of the index points to."""
        _, file, offset, length = line
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.archives.open_input_file(f"{self.at}/{file}")
        return parse(zlib.decompress(self.files[file].read_at(int(length), int(offset)), 31))

    def url(self, url: str) -> list[dict]:
        """All records of a URL."""
        key = url_key(url)
        return [self.read(x) for x in self.captures(key + " ", key + "!")]


_ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], ["key"])


def look_up(keys: DataFrame, parts: DataFrame, index_folder: str, archive_folder: str, tasks: int = 1) -> DataFrame:
    """The records of captures with these keys. Keys are looked up in their order, so that those of one block follow each other, in so many tasks."""
    spark = keys.sparkSession
    names = spark.sparkContext.broadcast([(r.first, r.name) for r in parts.collect()])  # one row for each task that wrote the index
    columns = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches):
        index = Index(names.value, index_folder, archive_folder)
        for b in slices(batches, 1024):
            rows = [index.read(line) for key in b.column(0).to_pylist() for line in index.captures(key, key + "\0")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], columns)

    ordered = keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, _ROWS)


def archive_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives the pages, indexes the captures and reads every page back through the index."""
    spark = pages.sparkSession
    archives, index = shared_dir(spark, "warc"), shared_dir(spark, "warc-index")
    captures = write_archives(pages, archives, min_revisit)
    size = captures.agg(F.sum("length")).first()[0] or 0  # keys are short, what they point to isn't
    parts = write_index(captures, index)
    keys = own(pages, "url", "page_id").mapInArrow(_keys, "key string")
    return look_up(keys, parts, index, archives, max(1, -(-size // READ)))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
with h as (
    select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex, min(page_id) over (partition by coalesce(html, '')) as first from pages
), b as (
    select *, list_transform(range(0, 32), lambda i: ('0x' || substr(hex || '00', 1 + 2 * (5 * i // 8), 4))::integer >> (11 - 5 * i % 8) & 31) as digits from h
)
select page_id, payload_bytes, array_to_string(list_transform(digits, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k::integer + 1, 1)), '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, url from b
"""
