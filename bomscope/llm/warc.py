"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so that a record is one range of bytes.  Of equal payloads the
smallest page id is a `response`, the others are `revisit` records that refer to it.  Index: captures are
sorted by reversed-host key and page id and written in compressed blocks; a sparse directory holds the
first key of each block, in one small file per index file; the first key of each index file is all that
the driver holds.  A lookup searches these three levels by bisection and then reads one range of the
archive.

All files lie in the folder that driver and executors share.  A task names its files by chance and the
result of a finished task names its files, so files of lost tasks are never read.

Defined cases: a null html is an empty payload; a null url has the empty key.  A row whose page id is
null refers to the smallest id of its group, and is a response if the group has none.  Rows that repeat a
page id and payload are records of their own of the same type.  Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomscope.llm.common import staged, workspace

#: Bytes after which a task begins a new archive; index lines of one block.
ARCHIVE_BYTES, BLOCK_LINES = 1 << 28, 512
#: Archived bytes that one task reads back.
TASK_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"
NO_ID = -(1 << 63)


def sort_key(url: str | None) -> str:
    """`http://www.a.org:80/x?q` as `org,a,www:80)/x?q http`: one host's and one domain's pages lie together."""
    if not url:
        return ""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    name, colon, port = host.rpartition(":")
    if not colon or not port.isdigit():
        name, colon, port = host, "", ""
    return ",".join(reversed(name.lower().split("."))) + colon + port + ")" + path + " " + scheme.lower()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def read_record(member: bytes) -> dict:
    """A record's headers, its type, and the payload (None for a revisit); checks lengths and digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    return {"fields": fields, "type": fields["WARC-Type"], "payload": None if revisit else payload, "bytes": size, "digest": digest}


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], list(kinds))


CAPTURES = {"key": pa.string(), "page_id": pa.int64(), "archive": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Captures (key, page_id, archive, offset, length) of the records that this call has written."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    first = pages.groupBy("digest").agg(F.min("page_id").alias("first"))
    typed = pages.join(first, "digest", "left").select(
        "page_id", "url", "payload", "first", (~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, ref, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = write_record(page_id, url, payload, ref, revisit)
                out.write(member)
                rows.append((sort_key(url), page_id, name, at, len(member)))
                at += len(member)
            yield _table(rows, CAPTURES)
        if out is not None:
            out.close()

    captures = typed.mapInArrow(run, "key string, page_id long, archive string, offset long, length long")
    return staged(captures, "captures")


@dataclass
class Index:
    folder: str
    #: First (key, page id) of each index file and the name of its directory: as many as index files.
    tops: list[tuple[str, int]]
    names: list[str]


def _pack_keys(entries: list[tuple[str, int, int, int]]) -> bytes:
    """Directory: (first key, first id, offset, length) of each block."""
    out = [struct.pack("<I", len(entries))]
    for key, page_id, offset, length in entries:
        raw = key.encode()
        out.append(struct.pack("<IqqI", len(raw), page_id, offset, length) + raw)
    return zlib.compress(b"".join(out))


def _unpack_keys(raw: bytes) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    raw, at = zlib.decompress(raw), 4
    firsts, ranges = [], []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        n, page_id, offset, length = struct.unpack_from("<IqqI", raw, at)
        at += 24
        firsts.append((raw[at : at + n].decode(), page_id))
        ranges.append((offset, length))
        at += n
    return firsts, ranges


def build_index(captures: DataFrame, folder: str) -> Index:
    """Sorts captures into compressed blocks and writes a directory beside each index file."""
    ordered = captures.withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID)))
    ordered = ordered.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    kinds = {"key": pa.string(), "page_id": pa.int64(), "name": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, at, out, lines = uuid.uuid4().hex, 0, None, []
        directory: list[tuple[str, int, int, int]] = []

        def flush() -> None:
            nonlocal at, out, lines
            if out is None:
                out = store.open_output_stream(f"{base}/{name}.cdx", compression=None)
            block = zlib.compress("\n".join("\t".join(map(str, r)) for r in lines).encode())
            out.write(block)
            directory.append((lines[0][0], lines[0][1], at, len(block)))
            at, lines = at + len(block), []

        for batch in batches:
            for key, page_id, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append((key.replace("\t", "%09").replace("\n", "%0A"), page_id, archive, offset, length))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(_pack_keys(directory))
            yield _table([(directory[0][0], directory[0][1], name)], kinds)

    tops = sorted((r["key"], r["page_id"], r["name"]) for r in ordered.mapInArrow(run, "key string, page_id long, name string").collect())
    return Index(folder, [t[:2] for t in tops], [t[2] for t in tops])


class Reader:
    """Lookups of one task: the directory and the block that were read last stay at hand."""

    def __init__(self, index: Index, archives: str):
        self.index = index
        self.store, self.base = _store(index.folder)
        self.archives = _store(archives)[1]
        self.open = lru_cache(maxsize=64)(lambda path: self.store.open_input_file(path))
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=4)(self._block)

    def range(self, path: str, offset: int, length: int) -> bytes:
        return self.open(path).read_at(length, offset)

    def _directory(self, name: str):
        with self.store.open_input_file(f"{self.base}/{name}.dir") as f:
            return _unpack_keys(f.read())

    def _block(self, name: str, offset: int, length: int):
        lines = zlib.decompress(self.range(f"{self.base}/{name}.cdx", offset, length)).decode().split("\n")
        rows = [line.split("\t") for line in lines]
        return [(r[0], int(r[1])) for r in rows], [(r[2], int(r[3]), int(r[4])) for r in rows]

    def captures(self, key: str, page_id: int | None = None) -> Iterator[tuple[int, str, int, int]]:
        """Captures of a key, of one page only if its id is given."""
        key = key.replace("\t", "%09").replace("\n", "%0A")
        wanted = (key, NO_ID if page_id is None else page_id)
        k = max(0, bisect.bisect_left(self.index.tops, wanted) - 1)
        while k < len(self.index.tops) and self.index.tops[k][0] <= key:
            firsts, ranges = self.directory(self.index.names[k])
            b = max(0, bisect.bisect_left(firsts, wanted) - 1)
            while b < len(firsts) and firsts[b][0] <= key:
                keys, places = self.block(self.index.names[k], *ranges[b])
                i = bisect.bisect_left(keys, wanted)
                while i < len(keys) and keys[i][0] == key and (page_id is None or keys[i][1] == page_id):
                    yield keys[i][1], *places[i]
                    i += 1
                if i < len(keys):
                    return
                b += 1
            k += 1

    def record(self, archive: str, offset: int, length: int) -> dict:
        return read_record(self.range(f"{self.archives}/{archive}", offset, length))


def lookup(requests: DataFrame, index: Index, archives: str, tasks: int | None = None) -> DataFrame:
    """Records of the requested (key, page_id) pairs, with payloads.

    Requests are dealt in key order, so a task reads each of its blocks once.  They are small whatever the records
    weigh: `tasks` says among how many tasks to deal them.  A pair that is requested twice is answered once
    for each capture.
    """
    requests = requests.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).distinct()
    dealt = requests.repartitionByRange(tasks, "key", "page_id") if tasks else requests.repartitionByRange("key", "page_id")
    requests = dealt.sortWithinPartitions("key", "page_id")
    kinds = {
        "page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "record_type": pa.string(), "refers_to": pa.int64(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index, archives)
        for batch in batches:
            rows, size = [], 0
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                for found, archive, offset, length in reader.captures(key, page_id):
                    r = reader.record(archive, offset, length)
                    ref = r["fields"].get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((
                        None if found == NO_ID else found, r["payload"], r["bytes"], r["digest"], r["type"],
                        int(ref) if ref and ref != "none" else None,
                    ))
                    size += len(r["payload"] or b"")
                    if size > 16_000_000:
                        yield _table(rows, kinds)
                        rows, size = [], 0
            yield _table(rows, kinds)

    return requests.mapInArrow(
        run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def keys_of(pages: DataFrame) -> DataFrame:
    """(key, page_id) of every row."""
    kinds = {"key": pa.string(), "page_id": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table([(sort_key(u), i) for u, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], kinds)

    return pages.select(F.col("url").cast("string"), F.col("page_id").cast("long")).mapInArrow(run, "key string, page_id long")


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, index them, and read every record back through the index."""
    archives, index_folder = workspace(spark, "warc"), workspace(spark, "cdx")
    captures = write_archives(pages, archives)
    size = captures.agg(F.sum("length")).first()[0] or 0
    return lookup(keys_of(pages), build_index(captures, index_folder), archives, -(-size // TASK_BYTES) or 1)
