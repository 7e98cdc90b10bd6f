"""WARC archives: writing with revisit records, and a reader that salvages what it can.

Writing. Payloads are known by their SHA-1. Of records with equal payloads of at least `least_bytes`, the one with the smallest id
is a response and the others are revisits of it; smaller ones are all responses. Every task writes archives of its own below a
shared folder: one gzip member per record, a new file whenever one is full. A file gets its name only when it is whole, so a task
that is tried again replaces its files and leaves no halves.

Reading (salvage). Members are read one by one and checked: the gzip sum, the version line, the headers, Content-Length against what is there,
and the block digest. After a failed check the reader looks for the next place where a member (or, in plain archives, a version
line) begins and is valid, goes on there, and logs the bytes between as a quarantined gap. Files are read in pieces; memory is
bounded by one record.

Defined cases: a null payload is empty; a null id is written as an empty id and is never referred to while the group has another;
rows that share the smallest id of a payload are all responses; no rows give no files. Extra columns are not looked at. The hot
payload of a third of all rows is one line in partial sums, and its rows are spread by Spark's skew join.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import no_nulls

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 20
FULL = 64 << 20
RECORD_FIELDS = "id string, url string, type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: object, url: str, payload: bytes, digest: str, refers_to: object | None, revisit: bool) -> bytes:
    """One record; its block is an HTTP response, of a revisit without the body."""
    said = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = said if revisit else said + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives when the result is computed: one row per file (path, records, bytes)."""
    data = F.encode(no_nulls(F.col(payload)), "UTF-8")
    rows = pages.select(F.col(key).alias("id"), no_nulls(F.col(url)).alias("url"), data.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    groups = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    shared = groups.where("n > 1 and least is not null").select(F.col("sha").alias("same"), "least")
    known = F.col("size") >= least_bytes
    joined = rows.join(shared, (F.col("sha") == F.col("same")) & known, "left").select(
        "id", "url", "payload", "least", (F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))).alias("revisit")
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = _place(folder)
        system.create_dir(path, recursive=True)
        out, done, n, size = None, [], 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            name = f"{path}/part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            system.move(draft, name)
            done.append((name, n, size))
            out = None

        for batch in batches:
            for page_id, address, body, least, revisit in zip(*(c for c in batch.columns)):
                if out is None:
                    draft = f"{path}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}"
                    out, n, size = system.open_output_stream(draft, compression=None), 0, 0
                body = body.as_py()
                data = record(page_id.as_py(), address.as_py().replace("\r", "%0D").replace("\n", "%0A"), body, digest_of(body), least.as_py(), revisit.as_py())
                packed = member(data)
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= FULL:
                    close()
        if out is not None:
            close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"]
        )

    return joined.mapInArrow(written, "path string, records long, bytes long")


@dataclass
class Found:
    fields: dict[str, str]
    block: bytes


class Damaged(ValueError):
    pass


def parsed(data: bytes, begin: int = 0) -> tuple[Found, int]:
    """The record at begin, all checks passed, and where it ends."""
    if not data.startswith(b"WARC/1.", begin):
        raise Damaged("version line")
    head = data.find(b"\r\n\r\n", begin)
    if head < 0:
        raise Damaged("headers")
    fields = {}
    for line in data[begin:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Damaged("content length")
    end = head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = data[head + 4 : end]
    if fields.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
        raise Damaged("block digest")
    return Found(fields, block), end + 4


class Window:
    """Bytes of a stream from `at` on; what lies before is forgotten."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.over = stream, b"", 0, False

    def more(self) -> bool:
        piece = b"" if self.over else self.stream.read(PIECE)
        self.over = not piece
        self.data += piece
        return bool(piece)

    def forget(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _gzip_member(window: Window) -> tuple[bytes, int]:
    """Contents and packed length of the member at the window's start."""
    unpacker, fed, out = zlib.decompressobj(31), 0, []
    while not unpacker.eof:
        if fed == len(window.data) and not window.more():
            raise Damaged("member cut off")
        try:
            out.append(unpacker.decompress(window.data[fed:]))
        except zlib.error as error:
            raise Damaged(f"member: {error}") from None
        fed = len(window.data)
    return b"".join(out), fed - len(unpacker.unused_data)


def salvaged(stream) -> Iterator[tuple[str, int, int, Found | str]]:
    """("record", offset, length, Found) and ("gap", offset, length, why), in order; together they cover the stream."""
    window, gap, why = Window(stream), None, ""
    while window.data or window.more():
        try:
            while len(window.data) < len(GZIP) and window.more():
                pass
            if window.data.startswith(GZIP):
                contents, length = _gzip_member(window)
                found, end = parsed(contents)
                if end != len(contents):
                    raise Damaged("more than one record in a member")
            elif window.data.startswith(b"WARC/1."):
                while True:
                    try:
                        found, length = parsed(window.data)
                        break
                    except Damaged:
                        if not window.more():
                            raise
            else:
                raise Damaged("no record begins here")
        except Damaged as error:
            if gap is None:
                gap, why = window.at, str(error)
            # The next place that may be a beginning; it is checked like any other.
            while True:
                places = [p for p in (window.data.find(GZIP, 1), window.data.find(b"WARC/1.", 1)) if p > 0]
                if places:
                    window.forget(min(places))
                    break
                keep = min(6, len(window.data) - 1)
                window.forget(len(window.data) - keep)
                if not window.more():
                    window.forget(len(window.data))
                    break
            continue
        if gap is not None:
            yield "gap", gap, window.at - gap, why
            gap = None
        yield "record", window.at, length, found
        window.forget(length)
    if gap is not None:
        yield "gap", gap, window.at - gap, why


def _page(field: str) -> str | None:
    inside = field.removeprefix("<urn:page:").removesuffix(">")
    return inside or None


def read(files: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the archives in files (column path): path, offset, length, gap (why; null for records), and of records id,
    url, type, refers_to, payload_digest, payload_bytes (of the full payload), payload (null for revisits)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _place(folder)
        names = ["path", "offset", "length", "gap", "id", "url", "type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *(pa.string(),) * 6, pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for kind, offset, length, what in salvaged(stream):
                        if kind == "gap":
                            rows.append((path, offset, length, what, *(None,) * 7))
                        else:
                            f, (head, _, body) = what.fields, what.block.partition(b"\r\n\r\n")
                            size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                            revisit = f.get("warc-type") == "revisit"
                            digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                            if not revisit and digest != digest_of(body):
                                rows.append((path, offset, length, "payload digest", *(None,) * 7))
                                continue
                            refers = _page(f["warc-refers-to"]) if "warc-refers-to" in f else None
                            named = (_page(f.get("warc-record-id", "")), f.get("warc-target-uri"), f.get("warc-type"), refers, digest)
                            rows.append((path, offset, length, None, *named, size, None if revisit else body))
                            held += len(body)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # A task per archive: their names are so few bytes that Spark would put them all into one.
    dealt = files.select("path").repartition(max(files.count(), 1))
    return dealt.mapInArrow(opened, f"path string, offset long, length long, gap string, {RECORD_FIELDS}")
