"""Streams: text, JSON lines and validation as Structured Streaming, row cursors, and windowed aggregates on event time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabspark.errors import FileClosed, NoHeader
from tabspark.functions import semantics as S
from tabspark.operators.query import Query, Row
from tabspark.operators.validate import Schema
from tabspark.sources.files import open_output
from tabspark.sources.text import Options, encode, format_row


def read_csv_stream(spark: SparkSession, path: str, headers: Sequence[str], options: Options | None = None, header: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """Files that appear in a folder as a stream of text columns; the header must be told, as a stream can't be sniffed."""
    o = options or Options()
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    reader = spark.readStream.schema(schema).option("sep", o.delimiter or ",").option("quote", o.quote).option("escape", o.quote).option("header", header).option("nullValue", "\0").option("emptyValue", "").option("ignoreLeadingWhiteSpace", o.trim)
    if o.comment:
        reader = reader.option("comment", o.comment)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path).na.fill("")


def write_csv_stream(stream: DataFrame, path: str, checkpoint: str, header: bool = True) -> StreamingQuery:
    """Appends a stream to a folder of text files; what is there is taken up once (availableNow)."""
    writer = stream.writeStream.format("csv").option("header", header).option("escape", '"').option("emptyValue", "").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def validate_stream(stream: DataFrame, schema: Schema) -> DataFrame:
    return schema.validate_stream(stream)


def rows_from_function(headers: Sequence[str], following: Callable[[], Sequence[object] | None], close: Callable[[], None] | None = None) -> Iterator[Row]:
    """Rows that a function gives until it gives None; close is called once, also if the reader stops early."""
    try:
        while (values := following()) is not None:
            yield Row(headers, [S.py_render(v) for v in values])
    finally:
        if close:
            close()


def iterate(q: Query) -> Iterator[tuple[int, Row]]:
    """Rows with their numbers, in order, a partition at a time on the driver."""
    yield from enumerate(q.iterate())


class StreamWriter:
    """Rows written one by one to a file of delimited text, compressed by its extension."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.o = options or Options()
        self._context = open_output(spark, path)
        self._out, self.headers, self._closed = self._context.__enter__(), None, False
        self._out.write(encode("", self.o.encoding or "utf-8", self.o.bom))

    def write_header(self, headers: Sequence[str]) -> None:
        if self.headers is None:
            self.headers = list(headers)
            self._line(self.headers)

    def write_row(self, *values: object) -> None:
        self._line([S.py_render(v) for v in values])

    def write_rows(self, rows: Iterable[Sequence[object]]) -> None:
        for r in rows:
            self.write_row(*r)

    def write_record(self, record: dict[str, object]) -> None:
        if self.headers is None:
            raise NoHeader("records need a header")
        self.write_row(*[record.get(h, "") for h in self.headers])

    def _line(self, cells: list[str]) -> None:
        if self._closed:
            raise FileClosed("the writer is closed")
        self._out.write(encode(format_row(cells, self.o.delimiter or ",", self.o.quote) + ("\r\n" if self.o.crlf else "\n"), self.o.encoding or "utf-8"))

    def flush(self) -> None:
        self._out.flush()

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self._context.__exit__(None, None, None)

    def __enter__(self) -> StreamWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def tumbling(events: DataFrame, ts: str, width: str, keys: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by windows of event time; in a stream, state goes once `late` has passed."""
    src = events.withWatermark(ts, late) if late else events
    grouped = src.groupBy(F.window(ts, width), *keys).agg(*[c.alias(a) for a, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *aggregates)


def sessions(events: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by sessions: runs of events of a key with gaps below `gap`."""
    src = events.withWatermark(ts, late) if late else events
    grouped = src.groupBy(F.session_window(ts, gap), *keys).agg(*[c.alias(a) for a, c in aggregates.items()])
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggregates)
