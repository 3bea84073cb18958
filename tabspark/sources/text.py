"""Delimited text: options, detection, a strict parser with exact error modes, reading and writing.

Two readers. The strict one keeps every cell as it is (ragged rows, quotes, errors with their places) and parses each file in
a task of its own, as quotes can only be followed from a file's beginning. The native one is Spark's, which splits large
files; it is lenient, and it fills or cuts ragged rows.
"""

from __future__ import annotations

import codecs
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import ParseError, UnsupportedFormat
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query, physical_names

# The delimiters that detection tries, in order; byte-order marks; extensions of compressed files.
DELIMITERS = (",", ";", "\t", "|")
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
COMPRESSED = {".gz": "gzip", ".gzip": "gzip", ".bz2": "bzip2", ".bzip2": "bzip2", ".zst": "zstd", ".zstd": "zstd"}
ENCODINGS = {"utf8": "utf-8", "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be", "iso-8859-1": "latin-1", "latin-1": "latin-1", "windows-1252": "cp1252", "cp1252": "cp1252"}
SAMPLE_BYTES, SAMPLE_LINES = 8192, 10


@dataclass(frozen=True)
class Options:
    """delimiter, header and encoding: None detects them. errors: strict (raise), skip (drop the row) or collect (keep both).

    fields: 0 takes any width, -1 the first row's, n that many. lazy_quotes takes quotes inside plain fields as text.
    """

    delimiter: str | None = None
    quote: str = '"'
    comment: str = ""
    header: bool | None = None
    encoding: str | None = None
    lazy_quotes: bool = False
    trim: bool = False
    errors: str = "strict"
    fields: int = 0
    skip_rows: int = 0
    crlf: bool = False
    bom: bool = False
    ignored: dict[str, object] = field(default_factory=dict)  # buffer sizes, parallelism and the like: Spark's own matter

    def __post_init__(self) -> None:
        if self.errors not in ("strict", "skip", "collect"):
            raise ValueError(f"errors is {self.errors!r}")
        if self.encoding is not None and self.encoding.lower() not in ENCODINGS:
            raise UnsupportedFormat(f"encoding {self.encoding}")


def sniff_encoding(data: bytes) -> tuple[str, int]:
    """The encoding that a byte-order mark names, and the mark's length; without one UTF-8."""
    return next(((name, len(mark)) for mark, name in MARKS if data.startswith(mark)), ("utf-8", 0))


def decode(data: bytes, encoding: str | None = None) -> str:
    """Text without its mark; bytes that mean nothing become the replacement character."""
    found, mark = sniff_encoding(data)
    name = ENCODINGS[encoding.lower()] if encoding else found
    return data[mark if found == name else 0 :].decode(name, "replace")


def encode(text: str, encoding: str = "utf-8", bom: bool = False) -> bytes:
    """Characters that the encoding lacks become ?."""
    name = ENCODINGS[(encoding or "utf-8").lower()]
    mark = next((m for m, n in MARKS if n == name), b"") if bom else b""
    return mark + text.encode(name, "replace")


def sniff_delimiter(text: str) -> str:
    """The candidate that most of the first lines have as often as the first line, then the one most frequent there."""
    lines = [x for x in text[:SAMPLE_BYTES].replace("\r\n", "\n").split("\n") if x.strip()][:SAMPLE_LINES]
    if not lines:
        return ","

    def outside(line: str, d: str) -> int:
        return sum(part.count(d) for part in line.split('"')[::2])

    counts = {d: [outside(x, d) for x in lines] for d in DELIMITERS}
    score = {d: 100 * sum(n == c[0] for n in c) + c[0] if c[0] else 0 for d, c in counts.items()}
    best = max(DELIMITERS, key=lambda d: score[d])
    return best if score[best] else ","


def sniff_header(rows: list[list[str]]) -> bool:
    """Two rows at least: the first without an empty cell or a number, the second with a number."""
    if len(rows) < 2 or not rows[0]:
        return False
    return all(c != "" and S.py_num(c) is None for c in rows[0]) and any(S.py_num(c) is not None for c in rows[1])


class Parser:
    """Records of delimited text, one after another, with places of errors."""

    def __init__(self, options: Options, delimiter: str) -> None:
        self.o, self.d = options, delimiter
        self.errors: list[ParseError] = []

    def rows(self, lines: Iterable[str]) -> Iterator[tuple[list[str], ParseError | None]]:
        """(cells, error) of each record of lines, which keep their ends; blank and comment lines are none.

        strict raises the first error, skip drops its record, collect gives the record with what could be read.
        """
        o, width, number, offset = self.o, max(0, self.o.fields), 0, 0
        source = iter(lines)
        for line in source:
            number += 1
            at, offset = offset, offset + len(line)
            if number <= o.skip_rows:
                continue
            body = line.rstrip("\n").removesuffix("\r")
            if not body or (o.comment and body.startswith(o.comment)):
                continue
            first, error = number, None
            if o.quote not in body:
                cells = body.split(self.d)
                if o.trim:
                    cells = [c.lstrip(" \t") for c in cells]
            else:
                cells, error, extra, length = self._quoted(line, source, number, at)
                number, offset = number + extra, offset + length
            if error is None and o.fields:
                width = width or len(cells)
                if len(cells) != width:
                    error = ParseError(f"{len(cells)} fields, not {width}", first, 0, at)
            if error is not None:
                self.errors.append(error)
                if o.errors == "strict":
                    raise error
                if o.errors == "skip":
                    continue
            yield cells, error

    def _quoted(self, text: str, source: Iterator[str], line: int, offset: int) -> tuple[list[str], ParseError | None, int, int]:
        """Cells of a record with quotes, its error, and how many further lines and characters it took."""
        q, d, lazy = self.o.quote, self.d, self.o.lazy_quotes
        cells, i, extra, more, begin, error = [], 0, 0, 0, 0, None
        while True:
            if self.o.trim:
                while text[i : i + 1] in (" ", "\t") and text[i : i + 1] != d:
                    i += 1
            if text[i : i + 1] != q:
                end = text.find(d, i)
                last = end < 0
                cell = text[i:].rstrip("\n").removesuffix("\r") if last else text[i:end]
                if q in cell and not lazy:
                    error = error or ParseError("a quote in a plain field", line + extra, i - begin + cell.index(q) + 1, offset + i + cell.index(q))
                cells.append(cell)
            else:
                i, cell = i + 1, []
                while True:
                    end = text.find(q, i)
                    if end < 0:
                        following = next(source, None)
                        if following is None:
                            cell.append(text[i:].rstrip("\n"))
                            if not lazy:
                                error = error or ParseError("a quote is never closed", line + extra, len(text) - begin, offset + len(text))
                            return [*cells, "".join(cell)], error, extra, more
                        begin = len(text)
                        text, extra, more = text + following, extra + 1, more + len(following)
                        continue
                    cell.append(text[i:end])
                    i = end + 1
                    if text[i : i + 1] == q:
                        cell.append(q)
                        i += 1
                    elif text[i : i + len(d)] == d or text[i:].strip("\r\n") == "":
                        break
                    else:
                        if not lazy:
                            error = error or ParseError("text after a closing quote", line + extra, i - begin + 1, offset + i)
                        cell.append(q)
                cells.append("".join(cell).replace("\r\n", "\n"))
                last = text[i : i + len(d)] != d
                end = i
            if last:
                return cells, error, extra, more
            i = end + len(d)


def parse(text: str, options: Options | None = None) -> tuple[list[list[str]], list[ParseError]]:
    """All rows of a text on the driver, and the errors collected."""
    o = options or Options()
    parser = Parser(o, o.delimiter or sniff_delimiter(text))
    return [cells for cells, _ in parser.rows(io.StringIO(text, newline=""))], parser.errors


def sample(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of the first file at a path, through Spark's file systems, decompressed."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(hadoop)
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    if found[0].isDirectory():
        found = sorted((x for x in fs.listStatus(found[0].getPath()) if not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getPath().getName())
        if not found:
            return b""
    first = found[0].getPath()
    stream = fs.open(first)
    try:
        kind = codec_of(first.getName())
        raw = bytes(stream.readNBytes(size * 8 if kind else size))
    finally:
        stream.close()
    return decompress_head(raw, kind)[:size] if kind else raw


def codec_of(path: str) -> str | None:
    lower = path.lower()
    return next((c for ext, c in COMPRESSED.items() if lower.endswith(ext)), None)


def decompress_head(data: bytes, kind: str) -> bytes:
    """What can be had from the beginning of a compressed file."""
    import bz2
    import zlib

    import zstandard

    if kind == "gzip":
        return zlib.decompressobj(16 + zlib.MAX_WBITS).decompress(data)
    if kind == "bzip2":
        try:
            return bz2.BZ2Decompressor().decompress(data)
        except EOFError:
            return b""
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def decompress(data: bytes, kind: str | None) -> bytes:
    import bz2
    import gzip

    import zstandard

    if kind is None:
        return data
    if kind == "zstd":
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
            return r.read()
    return gzip.decompress(data) if kind == "gzip" else bz2.decompress(data)


def read_cells(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """_file, _row, _cells, _error of every record, by the strict parser, each file in one task. Errors are raised if strict."""
    o = options
    out = pa.schema([("_file", pa.string()), ("_row", pa.int64()), ("_cells", pa.list_(pa.string())), ("_error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = decode(decompress(content, codec_of(name)), o.encoding)
                parser = Parser(o, o.delimiter or sniff_delimiter(text))
                rows: list[dict] = []
                for n, (cells, error) in enumerate(parser.rows(io.StringIO(text, newline=""))):
                    rows.append({"_file": name, "_row": n, "_cells": cells, "_error": str(error) if error else None})
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "_file string, _row long, _cells array<string>, _error string")


def open_csv(spark: SparkSession, path: str, options: Options | None = None, native: bool = False) -> Query:
    """A table of text cells. native=True takes Spark's own reader, which splits large files and takes no notice of errors.

    The delimiter, encoding and header are found in the first bytes of the first file, unless told.
    """
    o = options or Options()
    head = decode(sample(spark, path), o.encoding)
    o = replace(o, delimiter=o.delimiter or sniff_delimiter(head))
    found, _ = parse(head, replace(o, errors="collect", fields=0))
    header = sniff_header(found) if o.header is None else o.header
    if native:
        return _open_native(spark, path, o, header, found)
    cells = read_cells(spark, path, o)
    order = F.struct("_file", "_row")
    if header:
        first = cells.where("_row = 0").orderBy("_file").select("_cells").first()
        headers = list(first[0]) if first else []
        cells = cells.where("_row > 0")
    else:
        width = cells.agg(F.max(F.size("_cells"))).first()[0] or 0
        headers = [f"column{i + 1}" for i in range(width)]
    columns = physical_names(headers)
    made = cells.select(*[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], order.alias(ORDER), F.col("_cells").alias("_all_cells"), "_error")
    return Query(made, headers, columns)


def _native_shape(spark: SparkSession, path: str, o: Options, header: bool) -> tuple[bool, int]:
    """(whether a quoted cell may hold a line end, most cells of a record; 0 with a header), by a pass over all files.

    A line with an odd number of quotes begins or ends inside a quoted cell.
    """
    lines = spark.read.text(path).select("value")
    ascii_like = not o.encoding or not o.encoding.lower().startswith(("utf-16", "utf16", "utf-32", "utf32"))
    quoted_lines = not ascii_like or not lines.where((F.length("value") - F.length(F.replace("value", F.lit(o.quote), F.lit("")))) % 2 == 1).isEmpty()
    if header:
        return quoted_lines, 0
    if quoted_lines:
        return True, read_cells(spark, path, replace(o, errors="collect", fields=0)).agg(F.max(F.size("_cells"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 0
        for batch in batches:
            parser = Parser(replace(o, errors="collect", fields=0), o.delimiter)
            width = max(width, max((len(cells) for cells, _ in parser.rows(x + "\n" for x in batch.column(0).to_pylist())), default=0))
        yield pa.RecordBatch.from_pydict({"width": [width]}, schema=pa.schema([("width", pa.int32())]))

    return False, lines.mapInArrow(run, "width int").agg(F.max("width")).first()[0] or 0


def _open_native(spark: SparkSession, path: str, o: Options, header: bool, found: list[list[str]]) -> Query:
    quoted_lines, width = _native_shape(spark, path, o, header)
    headers = found[0] if header and found else [f"column{i + 1}" for i in range(width)]
    columns = physical_names(headers)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("sep", o.delimiter).option("quote", o.quote).option("escape", o.quote).option("header", header).option("nullValue", "\0").option("emptyValue", "").option("ignoreLeadingWhiteSpace", o.trim).option("enforceSchema", True)
    if o.comment:
        reader = reader.option("comment", o.comment)
    if o.encoding:
        reader = reader.option("encoding", o.encoding)
    df = reader.option("multiLine", quoted_lines).csv(path)
    df = df.withColumn(ORDER, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return Query(df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns], ORDER), headers, columns)


def open_text(spark: SparkSession, data: bytes | str, options: Options | None = None) -> Query:
    """A table from bytes or text at hand."""
    o = options or Options()
    text = data if isinstance(data, str) else decode(data, o.encoding)
    rows, errors = parse(text, o)
    header = sniff_header(rows) if o.header is None else o.header
    headers = rows[0] if header and rows else [f"column{i + 1}" for i in range(max(map(len, rows), default=0))]
    q = Query.from_rows(spark, rows[1:] if header else rows, headers)
    q.parse_errors = errors
    return q


def format_row(cells: Iterable[str], delimiter: str = ",", quote: str = '"') -> str:
    """Cells with a delimiter, quote or line end are quoted; quotes inside are doubled."""
    special = (delimiter, quote, "\r", "\n")
    return delimiter.join(quote + c.replace(quote, quote * 2) + quote if any(x in c for x in special) else c for c in cells)


def render_csv(q: Query, options: Options | None = None, header: bool = True) -> str:
    """The whole table as text, on the driver."""
    o = options or Options()
    end = "\r\n" if o.crlf else "\n"
    lines = [format_row(q.headers, o.delimiter or ",", o.quote)] if header else []
    lines += [format_row(r.values(), o.delimiter or ",", o.quote) for r in q.iterate()]
    return "".join(x + end for x in lines)


def write_csv(q: Query, path: str, options: Options | None = None, header: bool = True, compression: str | None = None) -> None:
    """A folder of part files, written in parallel and in order: each row is formatted by column expressions. Every part has
    the headers; a table without rows is one part with nothing else.

    gzip, bzip2 and plain are Spark's own; zstd has no encoder there and is refused here (see compress.save for one file).
    """
    o = options or Options()
    if q.err:
        raise q.err
    if compression == "zstd":
        raise UnsupportedFormat("zstd as part files")
    d, quote = o.delimiter or ",", o.quote
    cells = []
    for c in q._columns:
        t = S.text(F.col(f"`{c}`"), q.kind(c))
        special = t.contains(d) | t.contains(quote) | t.contains("\n") | t.contains("\r")
        cells.append(F.when(special, F.concat(F.lit(quote), F.replace(t, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(t))
    line = F.concat_ws(d, *cells) if cells else F.lit("")
    body = q.ordered().select(line.alias("value"))
    if header:  # each part that has rows begins with the headers, as readers of many files expect
        head = F.lit(("\ufeff" if o.bom else "") + format_row(q.headers, d, quote))
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        body = body.select(F.explode(F.when(first, F.array(head, "value")).otherwise(F.array("value"))).alias("value"))
    writer = body.write.mode("overwrite").option("lineSep", "\r\n" if o.crlf else "\n")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
    if header and q.df.isEmpty():
        from tabspark.sources.files import write_bytes

        data = encode(format_row(q.headers, d, quote) + ("\r\n" if o.crlf else "\n"), o.encoding or "utf-8", o.bom)
        write_bytes(q.df.sparkSession, f"{path}/part-00000-0-header.csv", data)  # sorts before all other parts


def save_csv(q: Query, path: str, options: Options | None = None, header: bool = True) -> None:
    """One file, streamed through the driver row by row."""
    from tabspark.sources.files import open_output

    o = options or Options()
    end = "\r\n" if o.crlf else "\n"
    with open_output(q.df.sparkSession, path) as out:
        out.write(encode("", o.encoding or "utf-8", o.bom))
        if header:
            out.write(encode(format_row(q.headers, o.delimiter or ",", o.quote) + end, o.encoding or "utf-8"))
        for r in q.iterate():
            out.write(encode(format_row(r.values(), o.delimiter or ",", o.quote) + end, o.encoding or "utf-8"))
