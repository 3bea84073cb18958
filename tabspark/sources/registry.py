"""Files by their extension: what a path is, reading it as a table, and converting it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabspark.errors import UnsupportedFormat
from tabspark.operators.query import Query
from tabspark.sources import jsonx, sheets, text
from tabspark.sources.files import open_output

_COMPRESSION = {"gz": "gzip", "bz2": "bzip2", "zst": "zstd"}


def load(spark: SparkSession, path: str, options: text.Options | None = None) -> Query:
    """Compressed files by what is inside, .ods, .xlsx, .json, .ndjson and .jsonl; anything else is delimited text."""
    lower = path.lower()
    if text.codec_of(lower):
        lower = lower.rpartition(".")[0]
    kind = lower.rpartition(".")[2]
    if kind in ("ods", "xlsx"):
        return sheets.read_sheet(spark, path)
    if kind == "json":
        return jsonx.from_json(spark, path)
    if kind in ("ndjson", "jsonl"):
        return jsonx.from_ndjson(spark, path)
    return text.open_csv(spark, path, options or text.Options(header=True))


def convert(spark: SparkSession, source: str, target: str, to: str) -> None:
    """One file as another: csv, ods, xlsx, json, ndjson, or delimited text compressed as gz, bz2 or zst."""
    q = load(spark, source)
    if to == "csv":
        text.save_csv(q, target)
    elif to in ("ods", "xlsx"):
        sheets.write_rows(spark, f"{target}" if target.lower().endswith(to) else f"{target}.{to}", [q.headers, *q.to_rows()])
    elif to == "json":
        jsonx.to_json(q, target, pretty=True)
    elif to == "ndjson":
        with open_output(spark, target) as out:
            for r in jsonx.json_lines(q).toLocalIterator():
                out.write((r.value + "\n").encode())
    elif to in _COMPRESSION:
        with open_output(spark, target, _COMPRESSION[to]) as out:
            out.write((text.format_row(q.headers) + "\n").encode())
            for r in q.iterate():
                out.write((text.format_row(r.values()) + "\n").encode())
    else:
        raise UnsupportedFormat(to)
