"""WARC archives with a two-level capture index.

Pages become gzip records of WARC files, one open file per task. Captures are sorted by their
reversed-host URL key and stored as compressed blocks of lines; a sparse directory keeps the first
key of every block. A lookup searches the directory by bisection, reads only the blocks that can
hold the key, and then only the byte ranges of the records found.

A task writes files under random names and returns their entries as rows. Only rows that Spark
commits count, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.files import new_folder, opened
from retail_lake.session import freeze

#: Smaller payloads are always stored in full.
REVISIT_FROM = 1_000
FILE_BYTES = 256 << 20
BLOCK_LINES = 256
READ_SPAN = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id long, file string, at long, size long"
DIRECTORY = "shard string, first_key string, last_key string, at long, size long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, payload binary"
)


def url_key(url: str | None) -> str:
    """``http://blog.example.com/a?b`` as ``com,example,blog)/a?b``; what is no URL stays as it is."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    tail = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){parts.path or '/'}{query}"


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _line(text: str) -> str:
    """A header value on one line."""
    return "%0A".join(text.splitlines())


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit holds the HTTP header alone, which keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A record as a row of RECORDS; length and digest of a response come from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    page_id = None if name == "-" else int(name)
    url = fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of page {page_id} does not match its digest")
        return page_id, len(payload), digest, "response", None, url, payload
    length = int(next(h for h in http.decode().split("\r\n") if h.startswith("Content-Length: ")).split(": ")[1])
    refers_to = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return page_id, length, fields["WARC-Payload-Digest"][5:], "revisit", refers_to, url, None


def with_revisits(pages: DataFrame, key: str, url: str, html: str, least: int = REVISIT_FROM) -> DataFrame:
    """Rows to write, with ``keeper``: the page that holds the payload of a revisit, else null.

    Payloads are equal if their SHA-1 is. Rows that repeat the keeper's id are responses too.
    """
    base = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    keepers = (
        base.filter(F.octet_length("html") >= least)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    joined = base.join(keepers, F.col("digest") == F.col("same"), "left")
    repeats = ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", "digest", F.when(repeats, F.col("kept")).alias("keeper"))


def write_archives(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``with_revisits`` below ``folder``; return the captures, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        out, name, at = None, "", 0
        for batch in batches:
            entries = []
            for page_id, url, html, digest, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    system.create_dir(path, recursive=True)
                    name, at = f"{uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                    at += out.write(raw := _member(info.encode())) or len(raw)
                kind = "response" if keeper is None else "revisit"
                raw = _member(record(kind, page_id, url, html.encode(), digest, keeper, date))
                out.write(raw)
                entries.append((url_key(url), page_id, name, at, len(raw)))
                at += len(raw)
            yield _captures(entries)
        if out is not None:
            out.close()

    return freeze(rows.mapInArrow(run, CAPTURES))


def _captures(entries: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = list(zip(*entries, strict=True)) if entries else [[]] * 5
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "page_id", "file", "at", "size"])


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the captures as sorted, compressed blocks; return the sparse directory, written once.

    Rows are ranged by key and page, so a host or URL with many captures spreads over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        shard, at, out, entries, block = f"{uuid4().hex}.cdx.gz", 0, None, [], []

        def close_block() -> None:
            nonlocal at, out, block
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{shard}", compression=None)
            raw = _member("\n".join(json.dumps(row) for row in block).encode())
            out.write(raw)
            entries.append((shard, block[0][0], block[-1][0], at, len(raw)))
            at += len(raw)
            block = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(row)
                if len(block) == lines:
                    close_block()
        if block:
            close_block()
        if out is not None:
            out.close()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = list(zip(*entries, strict=True)) if entries else [[]] * 5
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["shard", "first_key", "last_key", "at", "size"])

    ordered = captures.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions(
        "key", "page_id", "file", "at"
    )
    return freeze(ordered.mapInArrow(run, DIRECTORY))


def lookup(keys: DataFrame, key: str, directory: DataFrame, folder: str) -> DataFrame:
    """The captures of the distinct keys, as rows of CAPTURES."""
    # one row per file of the index, that is per range partition: small at any size of the data
    bounds = sorted(
        (r["low"], r["high"], r["shard"])
        for r in directory.groupBy("shard").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    )
    lows, highs, shards = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in batch.column(0).to_pylist():
                for i in range(bisect_left(highs, k), bisect_right(lows, k)):
                    found.append((k, shards[i]))
            columns = list(zip(*found, strict=True)) if found else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "shard"])

    def search(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        entries = []
        if wanted.num_rows and blocks.num_rows:
            blocks = blocks.sort_by("at")
            first, last = blocks.column("first_key").to_pylist(), blocks.column("last_key").to_pylist()
            at, size = blocks.column("at").to_pylist(), blocks.column("size").to_pylist()
            held: tuple[int, dict] = (-1, {})
            system, path = opened(folder)
            with system.open_input_file(f"{path}/{blocks.column('shard')[0]}") as file:
                for k in sorted(wanted.column("key").to_pylist()):
                    for i in range(bisect_left(last, k), bisect_right(first, k)):
                        if held[0] != i:
                            lines = zlib.decompress(file.read_at(size[i], at[i]), 31).decode().split("\n")
                            by_key: dict[str, list] = {}
                            for row in map(json.loads, lines):
                                by_key.setdefault(row[0], []).append(row)
                            held = (i, by_key)
                        entries += held[1].get(k, [])
        return pa.Table.from_batches([_captures(entries)])

    routed = keys.select(F.col(key).alias("key")).distinct().mapInArrow(route, "key string, shard string")
    return routed.groupBy("shard").cogroup(directory.groupBy("shard")).applyInArrow(search, CAPTURES)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at the captures' byte ranges; neighbours are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        held: tuple[str, object] = ("", None)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for batch in batches:
            rows, chunk = [], (0, b"")
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                if held[0] != name:
                    if held[1] is not None:
                        held[1].close()
                    held, chunk = (name, system.open_input_file(f"{path}/{name}")), (0, b"")
                if not chunk[0] <= at <= at + size <= chunk[0] + len(chunk[1]):
                    chunk = (at, held[1].read_at(max(size, READ_SPAN), at))
                start = at - chunk[0]
                rows.append(parse(zlib.decompress(chunk[1][start : start + size], 31)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    span = F.floor(F.col("at") / F.lit(32 << 20))
    return captures.repartition("file", span).sortWithinPartitions("file", "at").mapInArrow(run, RECORDS)


def url_keys(pages: DataFrame, url: str) -> DataFrame:
    """The distinct URL keys of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys], ["key"])

    return pages.select(F.col(url).cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, index them, look every URL up and read its records back.

    A null payload is empty, a null URL has the empty key, a null id stays null and never keeps a
    payload for others. Repeated rows give a record each. A table without rows gives none.
    """
    folder = new_folder(pages.sparkSession, "warc")
    captures = write_archives(with_revisits(pages, key, url, html), folder)
    directory = build_index(captures, folder)
    return read_records(lookup(url_keys(pages, url), "key", directory, folder), folder)
