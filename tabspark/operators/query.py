"""The lazy, chainable query API over a table.

A Query is a DataFrame plus its headers. Steps only build the plan; names are checked at once, as the schema is known. An
error sticks: later steps do nothing, terminals return empty values, and `err` tells (or `strict=True` raises at once).

Rows have an order. A hidden column holds it, taken from the file's own row numbers where the source has such, else numbered
as they come. It is added by the first operation that asks for the order; others leave it out of the plan, and so of the scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime
from functools import cmp_to_key

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import MissingColumn, TabError
from tabspark.functions import semantics as S

ORDER = "_row_idx"


def physical_names(headers: Sequence[str]) -> list[str]:
    """Column names for headers: the header itself, unless it is empty, repeated (in any case) or can't be quoted."""
    seen = Counter(h.lower() for h in headers)
    return [h if h and seen[h.lower()] == 1 and "`" not in h and h != ORDER else f"_c{i}" for i, h in enumerate(headers)]


def scan_order(df: DataFrame) -> DataFrame:
    """Adds the order of rows: (file, row in it) for files with row numbers, else a number given by the scan."""
    try:
        files = len(df.inputFiles())
        place = F.struct("_metadata.file_path", "_metadata.row_index") if files > 1 else F.col("_metadata.row_index")
        return df.select("*", place.alias(ORDER))
    except AnalysisException:
        return df.withColumn(ORDER, F.monotonically_increasing_id())


class Row:
    """A row on the driver: values by header, with typed getters that give a zero value where the text doesn't fit."""

    def __init__(self, headers: Sequence[str], values: Sequence[str]) -> None:
        self.headers, self._values = list(headers), list(values)

    def get(self, name: str) -> str:
        at = [i for i, h in enumerate(self.headers) if h == name]
        return self.at(at[-1]) if at else ""

    __getitem__ = get

    def at(self, i: int) -> str:
        return self._values[i] if 0 <= i < len(self._values) else ""

    def values(self) -> list[str]:
        return list(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def record(self) -> dict[str, str]:
        return dict(zip(self.headers, self._values, strict=False))

    def str(self, name: str) -> str:
        return S.py_trim(self.get(name))

    def int(self, name: str) -> int:
        s = self.str(name)
        try:
            return int(s) if s.lstrip("+-").isdigit() and s.isascii() else 0
        except ValueError:
            return 0

    def float(self, name: str) -> float:
        return S.py_num(self.str(name)) or 0.0

    def bool(self, name: str) -> bool:
        return self.str(name) in S.TRUE

    def date(self, name: str) -> datetime | None:
        return S.py_date(self.str(name), S.ROW_DATES)


class Query:
    def __init__(self, df: DataFrame, headers: Sequence[str], columns: Sequence[str], err: Exception | None = None, strict: bool = False) -> None:
        self.df, self._headers, self._columns, self.err, self.strict = df, list(headers), list(columns), err, strict

    # sources

    @classmethod
    def from_df(cls, df: DataFrame, order: Sequence[str | Column] | None = None, strict: bool = False) -> Query:
        """A query over any DataFrame. order: columns that give the row order, if it isn't that of the files."""
        headers = df.columns
        columns = physical_names(headers)
        if order:
            keys = [F.col(o) if isinstance(o, str) else o for o in order]
            df = df.withColumn(ORDER, keys[0] if len(keys) == 1 else F.struct(*keys))
        if columns != headers:
            df = df.toDF(*columns, *([ORDER] if order else []))
        return cls(df, headers, columns, strict=strict)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[Sequence[object]], headers: Sequence[str], strict: bool = False) -> Query:
        columns = physical_names(headers)
        data = [[*(S.py_render(r[i]) if i < len(r) else "" for i in range(len(columns))), n] for n, r in enumerate(rows)]
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField(ORDER, T.LongType())])
        return cls(spark.createDataFrame(data, schema), headers, columns, strict=strict)

    @classmethod
    def from_iterator(cls, spark: SparkSession, rows: Iterable[Row], headers: Sequence[str], strict: bool = False) -> Query:
        """Drains an iterator of rows; if it fails, the error sticks."""
        found, err = [], None
        try:
            found = [r.values() for r in rows]
        except Exception as e:  # whatever the source raises is the query's error
            err = e
        q = cls.from_rows(spark, found, headers, strict)
        return q._fail(err) if err else q

    # state

    @property
    def headers(self) -> list[str]:
        return list(self._headers)

    def _with(self, df: DataFrame | None = None, headers: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> Query:
        return Query(self.df if df is None else df, self._headers if headers is None else headers, self._columns if columns is None else columns, self.err, self.strict)

    def _hidden(self) -> list[str]:
        return [ORDER] if ORDER in self.df.columns else []

    def with_order(self) -> Query:
        """The same with the hidden order as a column."""
        return self if self._hidden() else self._keep_order(scan_order(self.df))

    def settled(self, order: bool = True) -> Query:
        """Its order, if it is that of a sort, written into the hidden column: what follows may drop or change the keys.

        order=False: without adding the hidden column if nothing was sorted.
        """
        if self._keys:
            return self._with(self.ordered().withColumn(ORDER, F.monotonically_increasing_id()))
        return self.with_order() if order else self

    def _fail(self, err: Exception) -> Query:
        if self.strict:
            raise err
        q = self._with()
        q.err = err
        return q

    def column(self, name: str) -> str | None:
        """The physical column of a header; of several, the last."""
        at = [i for i, h in enumerate(self._headers) if h == name]
        return self._columns[at[-1]] if at else None

    def first_column(self, name: str) -> str | None:
        return self._columns[self._headers.index(name)] if name in self._headers else None

    def kind(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def cell(self, name: str) -> tuple[Column, T.DataType | None]:
        """A header's column and type; the empty text if there is no such header."""
        c = self.column(name)
        return (F.col(f"`{c}`"), self.kind(c)) if c is not None else (F.lit(""), None)

    def text(self, name: str) -> Column:
        return S.text(*self.cell(name))

    def _on(self, change: Callable[[], Query]) -> Query:
        if self.err:
            return self
        try:
            return change()
        except TabError as e:
            return self._fail(e)

    # filters

    def where(self, predicate: Column | Callable[..., object]) -> Query:
        """Keeps the rows for which a Column, or a function of a Row, is true.

        A function that returns a Column when given this query is used as that; any other is run on rows, in Arrow batches.
        """
        return self._on(lambda: self._keep_order(self.df.where(self._predicate(predicate))))

    def where_not(self, predicate: Column | Callable[..., object]) -> Query:
        return self._on(lambda: self._keep_order(self.df.where(~F.coalesce(self._predicate(predicate), F.lit(False)))))

    def where_eq(self, name: str, value: object) -> Query:
        return self._on(lambda: self._keep_order(self.df.where(self.equals(name, value))))

    def where_in(self, name: str, *values: object) -> Query:
        def change() -> Query:
            c, kind = self.cell(name)
            wanted = [v for v in values if v not in ("", None)]
            hit = c.isin(*wanted) if S.is_number(kind) and all(isinstance(v, int | float) for v in wanted) else S.text(c, kind).isin(*map(S.py_render, wanted))
            hit = hit if wanted else F.lit(False)
            return self._keep_order(self.df.where(hit | S.blank(c, kind) if len(wanted) < len(values) else hit))

        return self._on(change)

    def where_not_empty(self, name: str) -> Query:
        return self._on(lambda: self._keep_order(self.df.where(~S.blank(*self.cell(name)))))

    def equals(self, name: str, value: object) -> Column:
        """Textual equality; of a typed number with a number, numeric. Null instead of false where the cell is null, so that
        a plain comparison reaches the scan."""
        c, kind = self.cell(name)
        if value in ("", None):
            return S.blank(c, kind)
        if not S.is_text(kind):
            n = value if isinstance(value, int | float) else S.py_num(str(value))
            return c == S.literal(n, kind) if S.is_number(kind) and n is not None else S.text(c, kind) == S.py_render(value)
        return c == S.py_render(value)

    def _predicate(self, p: Column | Callable[..., object]) -> Column:
        return p if isinstance(p, Column) else self._call(p, T.BooleanType())

    def _call(self, fn: Callable[..., object], returns: T.DataType) -> Column:
        """A function of a Row as a column."""
        try:
            got = fn(self)
            if isinstance(got, Column):
                return got
        except Exception:  # a function of rows can't take a query
            pass
        headers, as_value = self._headers, bool if isinstance(returns, T.BooleanType) else S.py_render

        @F.pandas_udf(returns)
        def each(*cells: pd.Series) -> pd.Series:
            return pd.Series([as_value(fn(Row(headers, v))) for v in zip(*cells, strict=True)])

        return each(*[S.text(F.col(f"`{c}`"), self.kind(c)) for c in self._columns])

    # projections

    def select(self, *names: str) -> Query:
        """These columns, in this order; a name may come twice."""

        def change() -> Query:
            picked = [self.column(n) for n in names]
            if None in picked:
                raise MissingColumn(names[picked.index(None)])
            columns = physical_names(names)
            cols = [F.col(f"`{p}`").alias(c) for p, c in zip(picked, columns, strict=True)]
            q = self.settled(order=False)
            return self._with(q.df.select(*cols, *q._hidden()), names, columns)

        return self._on(change)

    def map(self, fn: Callable[[Row], Sequence[object]]) -> Query:
        """Each row's values anew, under the same headers; missing ones are empty, further ones are dropped."""

        def change() -> Query:
            headers, width = self._headers, len(self._columns)
            returns = T.ArrayType(T.StringType())

            @F.pandas_udf(returns)
            def each(*cells: pd.Series) -> pd.Series:
                return pd.Series([[S.py_render(x) for x in fn(Row(headers, v))] for v in zip(*cells, strict=True)])

            cells = [S.text(F.col(f"`{c}`"), self.kind(c)) for c in self._columns]
            q = self.settled(order=False)
            made = q.df.select(each(*cells).alias("_made"), *q._hidden())
            return self._with(made.select(*[F.coalesce(F.get("_made", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(self._columns[:width])], *q._hidden()))

        return self._on(change)

    def with_column(self, name: str, value: Column | Callable[..., object]) -> Query:
        """Appends a column, or replaces the one of this name."""

        def change() -> Query:
            col = value if isinstance(value, Column) else self._call(value, T.StringType())
            if (c := self.column(name)) is not None:
                return self._with(self.settled(order=False).df.withColumn(c, col))
            headers = [*self._headers, name]
            c = name if physical_names(headers)[-1] == name and name not in self._columns else f"_c{len(self._columns)}"
            return self._keep_order(self.df.withColumn(c, col), headers, [*self._columns, c])

        return self._on(change)

    def rename(self, old: str, new: str) -> Query:
        """Every header `old` becomes `new`; none is no error."""
        return self._on(lambda: self._keep_order(self.df, [new if h == old else h for h in self._headers]))

    def set_headers(self, *names: str) -> Query:
        """New headers by place; columns beyond them keep theirs."""
        return self._on(lambda: self._keep_order(self.df, [*names[: len(self._headers)], *self._headers[len(names) :]]))

    def clone(self) -> Query:
        return self._keep_order(self.df)

    # order

    def order_by(self, name: str, descending: bool = False) -> Query:
        """Stable: rows that compare equal keep their order, in either direction."""
        return self.order_by_keys([(name, descending)])

    def order_by_keys(self, keys: Sequence[tuple[str, bool]]) -> Query:
        def change() -> Query:
            for name, _ in keys:
                if self.column(name) is None:
                    raise MissingColumn(name)
            return self._sorted([k for name, desc in keys for k in S.sort_keys(*self.cell(name), desc)])

        return self._on(change)

    def order_by_key(self, key: Callable[[Query], Column] | Column, descending: bool = False) -> Query:
        """Sorts by a Column made of the query."""

        def change() -> Query:
            k = key if isinstance(key, Column) else key(self)
            return self._sorted([(k, descending)])

        return self._on(change)

    def order_by_fn(self, less: Callable[[Row, Row], bool]) -> Query:
        """Sorts by a comparison of rows, which only the driver can do: for small results."""

        def change() -> Query:
            rows = [Row(self._headers, r) for r in self.to_rows()]
            rows.sort(key=cmp_to_key(lambda a, b: -1 if less(a, b) else 1 if less(b, a) else 0))
            return Query.from_rows(self.df.sparkSession, [r.values() for r in rows], self._headers, self.strict)

        return self._on(change)

    def _sorted(self, keys: list[S.Key]) -> Query:
        """The order is a tuple of sort keys, so that what follows (limit, skip, last) sorts by them directly."""
        q = self.with_order()._with()
        q._keys = [*keys, *self._order()]
        return q

    _keys: list[S.Key] | None = None

    def _order(self) -> list[S.Key]:
        return self._keys or [(F.col(ORDER), False)]

    def _flipped(self) -> list[S.Key]:
        return [(k, not descending) for k, descending in self._order()]

    def ordered(self) -> DataFrame:
        return self.with_order().df.orderBy(*S.directed(self._order()))

    def limit(self, n: int) -> Query:
        return self._on(lambda: self._keep_order(self.ordered().limit(max(0, n))))

    def skip(self, n: int) -> Query:
        return self._on(lambda: self._keep_order(self.ordered().offset(max(0, n))))

    def tail(self, n: int) -> Query:
        return self._on(lambda: self._keep_order(self.with_order().df.orderBy(*S.directed(self._flipped())).limit(max(0, n))))

    def _keep_order(self, df: DataFrame, headers: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> Query:
        q = self._with(df, headers, columns)
        q._keys = self._keys
        return q

    def reverse(self) -> Query:
        def change() -> Query:
            q = self.with_order()._with()
            q._keys = self._flipped()
            return q

        return self._on(change)

    def first(self) -> tuple[Row | None, bool]:
        rows = [] if self.err else self.limit(1).to_rows()
        return (Row(self._headers, rows[0]), True) if rows else (None, False)

    def last(self) -> tuple[Row | None, bool]:
        return self.reverse().first()

    def distinct(self, *names: str) -> Query:
        """The first row of each key; of each whole row without names. Rows are compared as text."""

        def change() -> Query:
            for n in names:
                if self.column(n) is None:
                    raise MissingColumn(n)
            if names:
                keys = [self.text(n) for n in names]
            else:
                keys = [S.text(F.col(f"`{c}`"), self.kind(c)) for c in self._columns]
            # a minimum by order is summed up before the shuffle, where a window would sort every group
            firsts = F.struct(F.col(ORDER), *[F.col(f"`{c}`") for c in self._columns])
            least = self.settled().df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(firsts, F.col(ORDER)).alias("_first"))
            return self._with(least.select(*[F.col(f"_first.`{c}`").alias(c) for c in self._columns], F.col(f"_first.{ORDER}").alias(ORDER)))

        return self._on(change)

    # aggregates

    def count(self) -> int:
        return 0 if self.err else self.df.count()

    def aggregate(self, **what: tuple[str, str]) -> DataFrame:
        """One row of name=(function, column) aggregates: count, sum, avg, min, max."""
        return self.df.agg(*[self.agg_column(fn, name).alias(a) for a, (fn, name) in what.items()])

    def agg_column(self, fn: str, name: str) -> Column:
        """Aggregates of the numbers among the cells: 0 if there is none. count: cells that aren't empty; of *: rows."""
        if fn == "count":
            return F.count(F.lit(1)) if name == "*" else F.count(F.when(~S.blank(*self.cell(name)), 1))
        n = S.num(*self.cell(name))
        if fn in ("min", "max"):
            n = F.when(~F.isnan(n), n)
        return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](n), F.lit(0.0))

    def _number(self, fn: str, name: str) -> float:
        return 0.0 if self.err else self.df.agg(self.agg_column(fn, name)).first()[0]

    def sum(self, name: str) -> float:
        return self._number("sum", name)

    def avg(self, name: str) -> float:
        return self._number("avg", name)

    def min(self, name: str) -> float:
        return self._number("min", name)

    def max(self, name: str) -> float:
        return self._number("max", name)

    def count_by_df(self, name: str) -> DataFrame:
        return self.df.groupBy(self.text(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))

    def count_by(self, name: str) -> dict[str, int]:
        if self.err or self.column(name) is None:
            return {}
        return {r["value"]: r["count"] for r in self.count_by_df(name).collect()}

    def group_by(self, name: str) -> dict[str, Query]:
        """A query for each value, lazily filtered; the values are collected."""
        if self.err or self.column(name) is None:
            return {}
        values = [r[0] for r in self.df.select(self.text(name)).distinct().collect()]
        return {v: self._keep_order(self.df.where(self.text(name) == v)) for v in values}

    def reduce(self, start: object, fn: Callable[[object, Row], object]) -> object:
        """A fold over the rows in order, streamed through the driver."""
        if not self.err:
            for row in self.iterate():
                start = fn(start, row)
        return start

    # terminals

    def to_df(self, ordered: bool = False) -> DataFrame:
        """The rows under their headers, without the hidden order. Repeated headers are repeated columns."""
        if self.err:
            raise self.err
        df = (self.ordered() if ordered else self.df).select(*[F.col(f"`{c}`") for c in self._columns])
        return df if self._columns == self._headers else df.toDF(*self._headers)

    def as_text(self) -> Query:
        """Typed columns rendered as cell text, nulls as empty."""
        def change() -> Query:
            q = self.settled(order=False)
            return self._with(q.df.select(*[S.text(F.col(f"`{c}`"), self.kind(c)).alias(c) for c in self._columns], *q._hidden()))

        return self._on(change)

    def iterate(self) -> Iterator[Row]:
        if self.err:
            return
        for r in self.ordered().select(*[S.text(F.col(f"`{c}`"), self.kind(c)).alias(c) for c in self._columns]).toLocalIterator():
            yield Row(self._headers, list(r))

    def to_rows(self) -> list[list[str]]:
        return [r.values() for r in self.iterate()]

    def to_records(self) -> list[dict[str, str]]:
        return [r.record() for r in self.iterate()]

    def for_each(self, fn: Callable[[Row], None]) -> None:
        for r in self.iterate():
            fn(r)
