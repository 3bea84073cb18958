"""Cells, ranges, rows and columns by place: a table edited on Spark.

Edits are gathered and folded into one projection at the next read; rows have dense numbers, given once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import CellError, FileClosed, InvalidReference, MissingColumn, NoHeader, OutOfRange
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query, physical_names


def column_letters(n: int) -> str:
    """1 -> A, 26 -> Z, 27 -> AA."""
    if n < 1:
        raise InvalidReference(str(n))
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_ref(ref: str) -> tuple[int, int]:
    """A reference as (column, row), from 1."""
    m = re.fullmatch(r"([A-Za-z]+)([1-9][0-9]*)", ref.strip())
    if not m:
        raise InvalidReference(ref)
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return col, int(m[2])


def to_ref(col: int, row: int) -> str:
    if row < 1:
        raise InvalidReference(f"{col}, {row}")
    return f"{column_letters(col)}{row}"


def parse_range(ref: str) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of "A1:C5" or one cell, corners in any order."""
    a, _, b = ref.partition(":")
    (c1, r1), (c2, r2) = parse_ref(a), parse_ref(b or a)
    return min(c1, c2), min(r1, r2), max(c1, c2), max(r1, r2)


class Table:
    """An editable table of text cells with an optional header. Data rows count from 0; cell references count the header."""

    def __init__(self, spark: SparkSession, df: DataFrame | None = None, headers: Sequence[str] | None = None, width: int = 0, rows: int = 0, path: str = "") -> None:
        self.spark, self.headers, self.path = spark, list(headers) if headers is not None else None, path
        self.parse_errors: list[Exception] = []
        self._width, self._rows, self._closed = width, rows, False
        self._df = df if df is not None else spark.createDataFrame([], self._schema(width))
        self._edits: dict[tuple[int, int], str] = {}

    @staticmethod
    def _schema(width: int) -> T.StructType:
        return T.StructType([T.StructField(ORDER, T.LongType()), *(T.StructField(f"c{i}", T.StringType()) for i in range(width))])

    @classmethod
    def empty(cls, spark: SparkSession) -> Table:
        return cls(spark)

    @classmethod
    def from_query(cls, q: Query, path: str = "") -> Table:
        """Numbers the rows densely in their order, which takes a pass over them."""
        names = [f"c{i}" for i in range(len(q._columns))]
        rows = q.ordered().select(*[S.text(F.col(f"`{c}`"), q.kind(c)).alias(n) for c, n in zip(q._columns, names, strict=True)])
        numbered = rows.rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
        df = q.df.sparkSession.createDataFrame(numbered, cls._schema(len(names))).cache()
        return cls(q.df.sparkSession, df, q.headers, len(names), df.count(), path)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[Sequence[object]], headers: Sequence[str] | None = None) -> Table:
        t = cls(spark, headers=headers, width=len(headers or []))
        t.append_rows(rows)
        return t

    def query(self) -> Query:
        self._check()
        headers = self.headers if self.headers is not None else [f"column{i + 1}" for i in range(self._width)]
        headers = [*headers, *[""] * (self._width - len(headers))]
        columns = physical_names(headers)
        return Query(self._folded().select(*[F.coalesce(f"c{i}", F.lit("")).alias(c) for i, c in enumerate(columns)], ORDER), headers, columns)

    def _check(self) -> None:
        if self._closed:
            raise FileClosed("the table is closed")

    def close(self) -> None:
        self._check()
        self._closed = True

    # metadata

    @property
    def has_header(self) -> bool:
        return self.headers is not None

    def row_count(self) -> int:
        return 0 if self._closed else self._rows

    def col_count(self) -> int:
        return 0 if self._closed else max(self._width, len(self.headers or []))

    def dimension(self) -> str:
        rows = self.row_count() + self.has_header
        return f"A1:{to_ref(self.col_count(), rows)}" if rows and self.col_count() else ""

    # edits

    def _folded(self) -> DataFrame:
        """All pending edits as one projection."""
        if self._edits:
            by_col: dict[int, list[tuple[int, str]]] = {}
            for (row, col), v in self._edits.items():
                by_col.setdefault(col, []).append((row, v))
            cols = []
            for i in range(self._width):
                c = F.col(f"c{i}")
                if i in by_col:
                    new = F.create_map(*[x for row, v in by_col[i] for x in (F.lit(row).cast("long"), F.lit(v))])
                    c = F.coalesce(F.try_element_at(new, F.col(ORDER)), c)
                cols.append(c.alias(f"c{i}"))
            self._df, self._edits = self._df.select(ORDER, *cols), {}
        return self._df

    def _grow(self, width: int, rows: int) -> None:
        if width > self._width:
            self._folded()
            self._df = self._df.select("*", *[F.lit("").alias(f"c{i}") for i in range(self._width, width)])
            self._width = width
        if rows > self._rows:
            more = self.spark.range(self._rows, rows).select(F.col("id").alias(ORDER), *[F.lit("").alias(f"c{i}") for i in range(self._width)])
            self._df, self._rows = self._folded().union(more), rows

    def set(self, row: int, col: int, value: object) -> None:
        """Sets a cell by 0-based data row and column; the table grows to hold it."""
        self._check()
        if row < 0 or col < 0:
            raise OutOfRange(f"row {row}, column {col}")
        self._grow(col + 1, row + 1)
        self._edits[row, col] = S.py_render(value)

    def rows(self) -> list[list[str]]:
        return self.query().to_rows()

    def row(self, i: int) -> list[str]:
        self._check()
        if not 0 <= i < self._rows:
            raise OutOfRange(f"row {i}")
        r = self._folded().where(F.col(ORDER) == i).first()
        return [v or "" for v in r[1:]]

    def set_row(self, i: int, values: Sequence[object]) -> None:
        self._grow(len(values), i + 1)
        for col in range(self._width):
            self.set(i, col, values[col] if col < len(values) else "")

    def append_row(self, *values: object) -> None:
        self.append_rows([values])

    def append_rows(self, rows: Iterable[Sequence[object]]) -> None:
        self._check()
        new = [[S.py_render(v) for v in r] for r in rows]
        self._grow(max(map(len, new), default=0), self._rows)
        data = [(self._rows + n, *r, *[""] * (self._width - len(r))) for n, r in enumerate(new)]
        if data:
            self._df = self._folded().union(self.spark.createDataFrame(data, self._schema(self._width)))
            self._rows += len(data)

    def append_record(self, record: dict[str, object]) -> None:
        if self.headers is None:
            raise NoHeader("records need a header")
        self.append_row(*[record.get(h, "") for h in self.headers])

    def insert_row(self, at: int, values: Sequence[object]) -> None:
        self._check()
        if not 0 <= at <= self._rows:
            raise OutOfRange(f"row {at}")
        self._grow(len(values), self._rows)
        moved = self._folded().withColumn(ORDER, F.when(F.col(ORDER) >= at, F.col(ORDER) + 1).otherwise(F.col(ORDER)))
        row = (at, *map(S.py_render, values), *[""] * (self._width - len(values)))
        self._df, self._rows = moved.union(self.spark.createDataFrame([row], self._schema(self._width))), self._rows + 1

    def remove_row(self, at: int) -> None:
        self._check()
        if not 0 <= at < self._rows:
            raise OutOfRange(f"row {at}")
        kept = self._folded().where(F.col(ORDER) != at)
        self._df, self._rows = kept.withColumn(ORDER, F.when(F.col(ORDER) > at, F.col(ORDER) - 1).otherwise(F.col(ORDER))), self._rows - 1

    def clear_rows(self) -> None:
        self._check()
        self._df, self._rows, self._edits = self.spark.createDataFrame([], self._schema(self._width)), 0, {}

    def header_index(self, name: str) -> int:
        if self.headers is None:
            raise NoHeader("there is no header")
        if name not in self.headers:
            raise MissingColumn(name)
        return self.headers.index(name)

    def column(self, at: int | str) -> list[str]:
        self._check()
        i = self.header_index(at) if isinstance(at, str) else at
        if not 0 <= i < self.col_count():
            raise OutOfRange(f"column {i}")
        return [r[0] or "" for r in self._folded().orderBy(ORDER).select(f"c{i}").toLocalIterator()] if i < self._width else [""] * self._rows

    def set_column(self, at: int, values: Sequence[object]) -> None:
        """Sets a column from the top; rows beyond the values become empty."""
        self._check()
        self._grow(at + 1, len(values))
        new = self.spark.createDataFrame([(i, S.py_render(v)) for i, v in enumerate(values)], f"`{ORDER}` long, v string")
        joined = self._folded().join(new, ORDER, "left")
        self._df = joined.select(ORDER, *[F.coalesce("v", F.lit("")).alias(f"c{i}") if i == at else F.col(f"c{i}") for i in range(self._width)])

    def insert_column(self, at: int, name: str, values: Sequence[object]) -> None:
        self._check()
        if not 0 <= at <= self._width:
            raise OutOfRange(f"column {at}")
        df = self._folded()
        self._df = df.select(ORDER, *[(F.col(f"c{i if i < at else i - 1}") if i != at else F.lit("")).alias(f"c{i}") for i in range(self._width + 1)])
        self._width += 1
        if self.headers is not None:
            self.headers.insert(at, name)
        self.set_column(at, values)

    def append_column(self, name: str, values: Sequence[object]) -> None:
        self.insert_column(self._width, name, values)

    def remove_column(self, at: int | str) -> None:
        self._check()
        i = self.header_index(at) if isinstance(at, str) else at
        if not 0 <= i < self.col_count():
            raise OutOfRange(f"column {i}")
        if i < self._width:
            left = [j for j in range(self._width) if j != i]
            self._df = self._folded().select(ORDER, *[F.col(f"c{j}").alias(f"c{n}") for n, j in enumerate(left)])
            self._width -= 1
        if self.headers is not None and i < len(self.headers):
            self.headers.pop(i)

    def get_by_header(self, row: int, name: str) -> str:
        return self.row(row)[self.header_index(name)] if self.header_index(name) < self._width else ""

    def set_by_header(self, row: int, name: str, value: object) -> None:
        self.set(row, self.header_index(name), value)

    def record(self, row: int) -> dict[str, str]:
        return dict(zip(self.headers or [], self.row(row), strict=False))

    # cells by reference

    def _place(self, ref: str) -> tuple[int, int]:
        col, row = parse_ref(ref)
        return row - 1 - self.has_header, col - 1

    def get_cell(self, ref: str) -> str:
        """A cell's text; outside the table and in the header row it is empty."""
        row, col = self._place(ref)
        return self.row(row)[col] if 0 <= row < self._rows and col < self._width else ""

    def set_cell(self, ref: str, value: object) -> None:
        self.set(*self._place(ref), value)

    def get_int(self, ref: str) -> int:
        n = S.py_num(S.py_trim(v := self.get_cell(ref)))
        if n is None or n != n or abs(n) == float("inf"):
            raise CellError(ref, v, "int")
        return int(v) if re.fullmatch(r"\s*[+-]?\d+\s*", v) else int(n)

    def get_float(self, ref: str) -> float:
        if (n := S.py_num(S.py_trim(v := self.get_cell(ref)))) is None:
            raise CellError(ref, v, "float")
        return n

    def get_bool(self, ref: str) -> bool:
        v = self.get_cell(ref)
        if v not in S.TRUE and v not in S.FALSE:
            raise CellError(ref, v, "bool")
        return v in S.TRUE

    def get_date(self, ref: str) -> datetime:
        if (d := S.py_date(v := self.get_cell(ref))) is None:
            raise CellError(ref, v, "date")
        return d

    def save(self, path: str = "") -> None:
        """Writes one file of delimited text, by default where the table came from."""
        from tabspark.sources.text import save_csv

        if not (target := path or self.path):
            raise OutOfRange("the table has no path")
        save_csv(self.query(), target, header=self.has_header)
        self.path = target

    def cell_type(self, ref: str) -> str:
        return self.spark.createDataFrame([(self.get_cell(ref),)], "v string").select(S.cell_type(F.col("v"))).first()[0]

    def range(self, ref: str) -> Range:
        return Range(self, ref)


class Range:
    """A rectangle of cells. A bad reference sticks as `err`, and the range is empty."""

    def __init__(self, table: Table, ref: str) -> None:
        self.table, self.err = table, None
        try:
            self.left, self.top, self.right, self.bottom = parse_range(ref)
        except InvalidReference as e:
            self.err = e

    def dimensions(self) -> tuple[int, int]:
        """(rows, columns)"""
        return (0, 0) if self.err else (self.bottom - self.top + 1, self.right - self.left + 1)

    def values(self) -> list[list[str]]:
        if self.err:
            return []
        t, shift = self.table, 1 + self.table.has_header
        out = [[""] * (self.right - self.left + 1) for _ in range(self.bottom - self.top + 1)]
        cols = [i for i in range(self.left - 1, self.right) if i < t._width]
        if cols:
            for r in t._folded().where(F.col(ORDER).between(self.top - shift, self.bottom - shift)).select(ORDER, *[f"c{i}" for i in cols]).toLocalIterator():
                for i, v in zip(cols, r[1:], strict=True):
                    out[r[0] + shift - self.top][i - self.left + 1] = v or ""
        return out

    def for_each(self, fn: Callable[[str, str], None]) -> None:
        for i, row in enumerate(self.values()):
            for j, v in enumerate(row):
                fn(to_ref(self.left + j, self.top + i), v)

    def set_value(self, value: object) -> None:
        rows, cols = self.dimensions()
        self.set_values([[value] * cols] * rows)

    def set_values(self, values: Sequence[Sequence[object]]) -> None:
        """Sets cells from the top left; what is outside the range is left out."""
        if self.err:
            raise self.err
        rows, cols = self.dimensions()
        for i, row in enumerate(values[:rows]):
            for j, v in enumerate(row[:cols]):
                self.table.set_cell(to_ref(self.left + j, self.top + i), v)
