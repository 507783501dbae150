"""WARC archives with a two-level capture index (operator 10).

Archives, index and directories are files under the shared folder. The index is sorted by
reversed-host keys and cut into compressed blocks; a sparse directory holds each block's
first key and place. A lookup bisects the directory, reads one block by range, bisects
its lines, and reads one record by range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import batch_of, stage, table
from shelfcast.sources.staging import stage_path

#: Archives that a task holds open.
OPEN_FILES = 16
# What a URI may hold besides letters and digits; a percent sign stands as it is.
URI_CHARS = "-._~:/?#[]@!$&'()*+,;=%"


@dataclass(frozen=True)
class WarcParams:
    """Smallest payload that is a revisit, index lines of a block, and shards of the index.

    Without ``shards`` there are as many as shuffle partitions. They bound what the driver
    holds, the first key of each, and are the tasks that read records back.
    """

    min_revisit_bytes: int = 0
    block_lines: int = 512
    shards: int | None = None
    date: str = "2000-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org/x?y`` becomes ``org,a,www)/x?y``; without a host, the text after ``)``."""
    text = url or ""
    _, mark, rest = text.partition("://")
    if not mark:
        return ")" + text
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:end].lower().rpartition("@")[2]
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + rest[end:]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Folder:
    """Files of a shared folder by name. Attempts of a task write names of their own, so a lost or doubled one does no harm."""

    def __init__(self, uri: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.held = {}

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int | None = None, length: int | None = None) -> bytes:
        """A file, or ``length`` bytes of it; the files of the last range reads stay open."""
        if offset is None:
            with self.fs.open_input_file(f"{self.root}/{name}") as file:
                return file.read()
        file = self.held.pop(name, None) or self.fs.open_input_file(f"{self.root}/{name}")
        self.held[name] = file
        if len(self.held) > OPEN_FILES:
            self.held.pop(next(iter(self.held))).close()
        file.seek(offset)
        return file.read(length)


def packed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def info(name: str, date: str) -> bytes:
    """The record that an archive begins with."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name)]
    return packed([*fields, ("Content-Type", "application/warc-fields")], b"software: shelfcast\r\nformat: WARC File Format 1.1\r\n")


def target(url: str | None) -> str:
    """A URI for the header: what may not stand there is percent-encoded; without a url, a name."""
    return quote(url, safe=URI_CHARS) if url else "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, date: str) -> bytes:
    """The record of a page, with an id of its own; a revisit has the HTTP header only.

    Page numbers have fields of their own, as a page_id may be repeated. The url as it was given
    is added where the header's URI is another.
    """
    revisit = refers_to is not None
    header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Target-URI", target(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Page-ID", json.dumps(page_id)),
    ]
    if target(url) != url:
        fields.append(("Page-URL", json.dumps(url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", json.dumps(refers_to))]
    return packed(fields, header if revisit else header + payload)


def parsed(member: bytes) -> dict:
    """Type, id, url, digest, payload size and payload (None for a revisit) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().lower().partition("content-length: ")[2].partition("\r\n")[0])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "type": fields["WARC-Type"], "page_id": json.loads(fields["Page-ID"]),
        "url": json.loads(fields["Page-URL"]) if "Page-URL" in fields else fields["WARC-Target-URI"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "size": size, "payload": None if revisit else payload,
        "refers_to": json.loads(fields["Refers-To-Page-ID"]) if revisit else None,
    }


CAPTURES = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, folder: str, params: WarcParams) -> DataFrame:
    """Writes a record per row to one archive for each task; returns the staged (key, file, offset, length).

    Digests are grouped with a minimum that combines before the shuffle, so a payload that
    a third of the pages share is one row for each task; the join back is split by AQE.
    """
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html", size.alias("size"), sha.alias("sha"))
    first = stage(rows.groupBy("sha", "size").agg(F.min("page_id").alias("first")), "payloads")
    named = rows.join(first, ["sha", "size"], "left").select(
        "page_id", "url", "html", F.when((F.col("size") >= params.min_revisit_bytes) & (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, sink = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            found = []
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if sink is None:
                    sink = Folder(folder).create(name)
                    first_record = info(name, params.date)
                    sink.write(first_record)
                    at = len(first_record)
                payload = (html or "").encode()
                member = record(page_id, url, payload, digest(payload), refers_to, params.date)
                sink.write(member)
                found.append((f"{surt(url)} {json.dumps(page_id)}", name, at, len(member)))
                at += len(member)
            yield batch_of(CAPTURES, found)
        if sink:
            sink.close()

    return stage(named.mapInArrow(write, "key string, file string, offset long, length long"), "captures")


BLOCKS = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("first", pa.string()), ("lines", pa.int64())])


def write_index(captures: DataFrame, folder: str, params: WarcParams) -> DataFrame:
    """Sorts the captures into shards of compressed blocks, each with a sparse directory; returns (shard, name, first, lines)."""
    shards = params.shards or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = captures.repartitionByRange(shards, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name, at, sink, lines, directory, count = f"shard-{shard:06d}-{uuid.uuid4().hex}", 0, None, [], [], 0

        def block():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            sink.write(data)
            directory.append((json.loads(lines[0])[0], at, len(data)))
            at, lines = at + len(data), []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sink = sink or Folder(folder).create(f"{name}.idx")
                lines.append(json.dumps(row))
                count += 1
                if len(lines) >= params.block_lines:
                    block()
        if sink:
            if lines:
                block()
            sink.close()
            with Folder(folder).create(f"{name}.dir") as file:
                file.write(json.dumps(directory).encode())
            yield batch_of(BLOCKS, [(shard, name, directory[0][0], count)])

    return stage(sorted_.mapInArrow(write, "shard int, name string, first string, lines long"), "shards")


class Shard:
    """One shard's directory, and the block read last."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name = folder, name
        self.directory = json.loads(folder.read(f"{name}.dir"))
        self.firsts = [d[0] for d in self.directory]
        self.block, self.held = -1, []

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture of ``key``; its lines may run over blocks."""
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.directory) and self.firsts[at] <= key:
            if at != self.block:
                _, offset, length = self.directory[at]
                data = zlib.decompress(self.folder.read(f"{self.name}.idx", offset, length))
                self.block, self.held = at, [json.loads(x) for x in data.split(b"\n")]
            i = bisect.bisect_left(self.held, [key])
            while i < len(self.held) and self.held[i][0] == key:
                yield tuple(self.held[i][1:])
                i += 1
            at += 1


READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.binary())]
)


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """The records of the distinct ``keys`` (key), read through the index: READ, one row for each record.

    The driver holds the first key of each shard. Keys go to the tasks of their shards in
    order, so a task reads each directory and block once. A payload is checked against its
    digest; ``html`` is null for a revisit.
    """
    held = sorted((r["first"].encode(), r["name"]) for r in shards.select("first", "name").collect())
    firsts, names = [f for f, _ in held], [n for _, n in held]

    def places(batches: Iterator[pa.RecordBatch], files: Folder) -> Iterator[tuple[str, int, int]]:
        opened = {}
        for b in batches:
            for key in b.column("key").to_pylist():
                # A key's captures may begin in the shard before the first that starts with it.
                at = max(0, bisect.bisect_left(firsts, key.encode()) - 1)
                while at < len(names) and firsts[at] <= key.encode():
                    if names[at] not in opened:
                        opened = {names[at]: Shard(files, names[at])}
                    yield from opened[names[at]].find(key)
                    at += 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, found, size = Folder(folder), [], 0
        # Some thousands at a time in the order of the archives, each of which is then opened once for many records.
        for some in batched(places(batches, files), 1 << 14):
            for file, offset, length in sorted(some):
                got = parsed(files.read(file, offset, length))
                payload = got["payload"]
                if payload is not None and (digest(payload) != got["digest"] or len(payload) != got["size"]):
                    raise ValueError(f"{file} at {offset}: the payload differs from its digest")
                found.append((got["page_id"], got["size"], got["digest"], got["type"], got["refers_to"], got["url"], payload))
                size += len(payload or b"")
                if size > 4 << 20 or len(found) >= 4096:
                    yield batch_of(READ, found)
                    found, size = [], 0
        yield batch_of(READ, found)

    # A number of tasks, as short keys stand for long records and would be coalesced.
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html binary"
    )


def archived(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives and an index and reads all of them back.

    Of equal payloads the one with the smallest page_id is the response and the others
    revisit it. A null html is an empty payload, a null url has an empty key. A page_id
    that is repeated with one payload gives responses, as none of them precedes the other;
    a null page_id is no revisit, and none refers to it. Other columns are ignored; an
    empty table gives no rows.
    """
    folder = stage_path(pages.sparkSession, "warc")
    captures = write_archives(pages.select("page_id", "url", "html"), folder, params)
    shards = write_index(captures, folder, params)
    return lookup(captures.select("key").distinct(), shards, folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM d
"""
