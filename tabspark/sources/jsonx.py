"""JSON arrays and lines of objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.errors import UnsupportedFormat
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query, physical_names
from tabspark.sources.files import open_output, read_bytes


def _cell(v: object) -> str:
    """A JSON value as a cell: null is empty, numbers keep their digits, nested values are JSON with sorted keys."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return str(v)
    text = json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


class _Digits(str):
    """A number's own digits."""


def _load(text: str) -> Iterator[dict]:
    """The objects of an array, or of values one after another."""
    decoder = json.JSONDecoder(parse_float=_Digits, parse_int=_Digits)
    i, n = 0, len(text)
    values = []
    while True:
        while i < n and text[i] in " \t\r\n":
            i += 1
        if i >= n:
            break
        v, i = decoder.raw_decode(text, i)
        values.append(v)
    for v in values[0] if len(values) == 1 and isinstance(values[0], list) else values:
        if not isinstance(v, dict):
            raise UnsupportedFormat("JSON values that aren't objects")
        yield v


def parse_json(text: str, field_names: list[str] | None = None) -> tuple[list[str], list[list[str]]]:
    """Headers (keys sorted within each record, in order of appearance) and rows."""
    records = list(_load(text))
    headers = field_names or list(dict.fromkeys(k for r in records for k in sorted(r)))
    return headers, [[_nested(r.get(h)) for h in headers] for r in records]


def _nested(v: object) -> str:
    return str(v) if isinstance(v, _Digits) else _cell(_plain(v))


def _plain(v: object) -> object:
    """Digits as numbers again, for nested values."""
    if isinstance(v, _Digits):
        return int(v) if v.lstrip("-").isdigit() else float(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def from_json(spark: SparkSession, path: str, field_names: list[str] | None = None) -> Query:
    """A file with an array of objects, exactly as its text has it; read on the driver."""
    headers, rows = parse_json(read_bytes(spark, path).decode("utf-8-sig"), field_names)
    return Query.from_rows(spark, rows, headers)


def from_ndjson(spark: SparkSession, path: str, field_names: list[str] | None = None) -> Query:
    """Lines of objects, parsed by the executors, split and of any number. Headers come from one pass over the keys.

    A line may hold several objects one after another, or an array of them, or none: each object is a row.
    """
    lines = spark.read.text(path)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = lines.select("value", order.alias(ORDER)).where(F.trim("value") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(line, at, r) for line, text in enumerate(batch.column(0).to_pylist()) for at, r in enumerate(_load(text))]
            cells = [[(k, _nested(v)) for k, v in sorted(r.items())] for _, _, r in found]
            place = batch.column(1).take(pa.array([line for line, _, _ in found], pa.int64()))
            order = pa.StructArray.from_arrays([place, pa.array([at for _, at, _ in found], pa.int32())], names=["line", "at"])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.map_(pa.string(), pa.string())), order], names=["cells", ORDER])

    schema = lines.schema
    made = lines.mapInArrow(run, f"cells map<string,string>, `{ORDER}` struct<line: {schema[ORDER].dataType.simpleString()}, at: int>")
    if field_names is None:
        keys = made.select(ORDER, F.posexplode(F.map_keys("cells")).alias("at", "key"))
        first = keys.groupBy("key").agg(F.min(F.struct(ORDER, "at")).alias("first"))
        field_names = [r.key for r in first.orderBy("first").select("key").collect()]
    columns = physical_names(field_names)
    cells = [F.coalesce(F.element_at("cells", h), F.lit("")).alias(c) for h, c in zip(field_names, columns, strict=True)]
    return Query(made.select(*cells, ORDER), field_names, columns)


def json_cell(c: Column, type_infer: bool = True, null_for_empty: bool = False) -> Column:
    """A cell as JSON text: integer, then float, then boolean, then string. NaN and infinities stay strings."""
    quoted = F.replace(F.replace(F.replace(F.to_json(F.struct(c.alias("v"))), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))
    out = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    if type_infer:
        whole = F.when(c.rlike(S.INTEGER), c).try_cast("long")
        n = S.num(c)
        finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
        out = F.when(whole.isNotNull(), whole.cast("string")).when(finite, S.fmt_float(n)).when(F.lower(c).isin("true", "false"), F.lower(c)).otherwise(out)
    return F.when(S.blank(c), F.lit("null") if null_for_empty else F.lit('""')).otherwise(out)


def json_lines(q: Query, type_infer: bool = True, null_for_empty: bool = False, field_names: list[str] | None = None) -> DataFrame:
    """value: each row as an object, keys in header order, in row order."""
    if q.err:
        raise q.err
    parts = []
    for h, c in zip(field_names or q.headers, q._columns, strict=False):
        parts.append(F.concat(F.lit(json.dumps(h, ensure_ascii=False) + ":"), json_cell(S.text(F.col(f"`{c}`"), q.kind(c)), type_infer, null_for_empty)))
    return q.ordered().select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def to_ndjson(q: Query, path: str, **options: object) -> None:
    """Lines of objects as part files, written in parallel."""
    json_lines(q, **options).write.mode("overwrite").text(path)


def to_json(q: Query, path: str, pretty: bool = False, **options: object) -> None:
    """One file with an array, streamed through the driver."""
    with open_output(q.df.sparkSession, path) as out:
        first = True
        for r in json_lines(q, **options).toLocalIterator():
            text = r.value
            if pretty:
                text = "\n".join("  " + x for x in json.dumps(json.loads(text, parse_float=float), indent=2, ensure_ascii=False).split("\n"))
            out.write((("[" if first else ",") + ("\n" if pretty else "") + text).encode("utf-8"))
            first = False
        out.write(b"[]\n" if first else (b"\n]\n" if pretty else b"]\n"))


def stream_ndjson(spark: SparkSession, path: str, field_names: list[str]) -> DataFrame:
    """A stream of lines of objects as text columns; the names must be told."""
    value = F.from_json("value", "map<string,string>")
    return spark.readStream.text(path).select(*[F.coalesce(F.element_at(value, h), F.lit("")).alias(h) for h in field_names])
