"""WARC archives: writing, normalising monolithic gzip, and reading back by offset.

A monolithic archive is one gzip stream over all its records, which no reader can enter in the middle. The normaliser
inflates such a stream once, rewrites every record as a gzip member of its own, and writes a sidecar index of offsets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.store import BROADCAST_KEYS, materialize

#: A task starts another archive when one has so many bytes of records.
ARCHIVE_BYTES = 64 << 20
#: Payloads from this length on are stored once.
REVISIT_BYTES = 1000
_CHUNK = 1 << 20
_GZIP = 16 + zlib.MAX_WBITS
INDEX = "archive string, offset long, length long, record_id string, type string"
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())])
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)


class _Output:
    """A file that appears under its name only when whole: a task that is lost or runs twice leaves no half archive."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = _fs(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    return int(x) if (x := record_id.removeprefix("<urn:page:").removesuffix(">")) else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, its two closing line ends included. A revisit has no block; it names payload length and digest."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Length: {len(payload)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an inflated stream, holding one record at a time."""
    have = bytearray()
    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                if have:
                    raise ValueError("the archive ends inside a record")
                return
            have += piece
        head = parse_head(bytes(have[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(have) < size:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("the archive ends inside a record")
            have += piece
        yield head, bytes(have[:size])
        del have[:size]


def inflate(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces of bounded size, whether it has one member or many; it is read once."""
    fs, name = _fs(path)
    unzip = zlib.decompressobj(_GZIP)
    with fs.open_input_stream(name, compression=None) as f:
        rest = b""
        while rest or (rest := f.read(_CHUNK)):
            if piece := unzip.decompress(rest, _CHUNK):
                yield piece
            rest = unzip.unconsumed_tail
            if unzip.eof:
                rest, unzip = unzip.unused_data or f.read(_CHUNK), zlib.decompressobj(_GZIP)
    while piece := unzip.decompress(unzip.unconsumed_tail, _CHUNK):
        yield piece


def plan_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload digest and refers_to: of equal payloads of min_bytes or more, the largest page_id is the response.

    Equal means equal SHA-1 and length. Only digests are shuffled, summed up before the exchange; groups of one are dropped
    there, and the groups left are broadcast only if their counted rows are few.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", F.octet_length(html).alias("bytes"), F.sha1(html).alias("digest"))
    found = p.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = materialize(found.where("n > 1 and last is not null").drop("n"), "payloads")
    few = groups.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS // 8
    joined = p.join(F.broadcast(groups) if few else groups, ["digest", "bytes"], "left")
    return joined.select("page_id", "url", "html", "digest", F.expr("case when last <> page_id or page_id is null then last end").alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page records (see plan_revisits) to archives of one gzip stream each; returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = zipped = None
        size, made = 0, []
        for batch in batches:
            html = batch.column("html").cast(pa.binary()).to_pylist()
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for payload, page_id, url, digest, refers_to in zip(html, *cols, strict=True):
                if out is None:
                    made.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    out, zipped, size = _Output(made[-1]), zlib.compressobj(1, zlib.DEFLATED, _GZIP), 0
                data = build_record(page_id, url, payload or b"", digest, refers_to)
                out.write(zipped.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    out.write(zipped.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(zipped.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["archive"])

    return materialize(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string"), "archives")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites each archive with one gzip member a record, and beside it an index `<name>.idx` (a JSON line a record).

    Returns the index rows (see INDEX). Each archive is inflated once, a record at a time, in a task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                out, side, at, rows = _Output(name), _Output(f"{name}.idx"), 0, []
                for head, data in records(inflate(path)):
                    zipped = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                    member = zipped.compress(data) + zipped.flush()
                    out.write(member)
                    row = {"archive": name, "offset": at, "length": len(member), "record_id": head["warc-record-id"], "type": head["warc-type"]}
                    side.write((json.dumps({k: row[k] for k in ("offset", "length", "record_id", "type")}) + "\n").encode())
                    rows.append(row)
                    at += len(member)
                out.close()
                side.close()
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=_INDEX)

    spread = max(1, archives.count())
    return materialize(archives.repartition(spread).mapInArrow(run, INDEX), "index")


def read_by_offset(index: DataFrame) -> DataFrame:
    """Reads each indexed record by its offset: see RECORD. A response's payload is digested anew and held to its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["archive"] != name:
                    name = x["archive"]
                    fs, path = _fs(name)
                    file = fs.open_input_file(path)
                data = zlib.decompress(file.read_at(x["length"], x["offset"]), _GZIP)
                end = data.index(b"\r\n\r\n")
                head = parse_head(data[:end])
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if head["warc-type"] == "revisit":
                    size, refers_to = int(head["warc-payload-length"]), _page(head["warc-refers-to"])
                else:
                    payload = data[end + 4 : end + 4 + int(head["content-length"])]
                    size, refers_to = len(payload), None
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: the record at {x['offset']} isn't what was written")
                rows.append({"page_id": _page(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": refers_to})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return index.mapInArrow(run, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> archives in `folder`/warc, normalised from `folder`/monolithic; returns their index.

    Null html is an empty payload, a null url gives no target URI, extra columns are ignored. Rows with a null page_id get
    records of their own; as no id can name them, they refer to others but none refers to them. Repeated rows of the
    largest page_id are all responses. No pages: no archives. `folder` is one that driver and executors share.
    """
    index = normalise(write_monolithic(plan_revisits(pages, min_bytes), f"{folder}/monolithic"), f"{folder}/warc")
    fs, path = _fs(f"{folder}/monolithic")
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
    return index
