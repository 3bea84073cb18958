"""Joins, concatenation, union by key and three-way diff."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import MissingColumn
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query, Row, physical_names

#: A key: from a query to the columns that must be equal.
Key = Callable[[Query], list[Column]]


def on(name: str) -> Key:
    """Rows match if they have the same text (or typed value) in the first column of this name; empty matches empty."""
    return on_all(name)


def on_all(*names: str) -> Key:
    def key(q: Query) -> list[Column]:
        found = [q.first_column(n) for n in names]
        if None in found:
            raise MissingColumn(names[found.index(None)])
        return [S.text(F.col(f"`{c}`")) if S.is_text(q.kind(c)) else F.col(f"`{c}`") for c in found]

    return key


def on_function(fn: Callable[[Row], str]) -> Key:
    """A key worked out from each row, in Arrow batches."""

    def key(q: Query) -> list[Column]:
        headers = q.headers

        @F.pandas_udf(T.StringType())
        def each(*cells: pd.Series) -> pd.Series:
            return pd.Series([fn(Row(headers, v)) for v in zip(*cells, strict=True)])

        return [each(*[S.text(F.col(f"`{c}`"), q.kind(c)) for c in q._columns])]

    return key


def _keyed(q: Query, key: Key, tag: str) -> tuple[DataFrame, list[str]]:
    """The query with its key, and all columns renamed apart."""
    q = q.settled()
    keys = key(q)
    df = q.df.select(*[k.alias(f"{tag}k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(f"{tag}{i}") for i, c in enumerate(q._columns)], F.col(ORDER).alias(f"{tag}o"))
    return df, [f"{tag}k{i}" for i in range(len(keys))]


def _match(left: list[str], right: list[str], a: DataFrame, b: DataFrame) -> Column:
    """Equality of keys; a typed key and a text key are compared as text. Null keys are equal, as empty cells are."""
    out = F.lit(True)
    for x, y in zip(left, right, strict=True):
        kinds = a.schema[x].dataType, b.schema[y].dataType
        if S.is_text(kinds[0]) and S.is_text(kinds[1]):
            out = out & (F.col(x) == F.col(y))
        elif S.is_text(kinds[0]) or S.is_text(kinds[1]):
            out = out & (S.text(F.col(x), kinds[0]) == S.text(F.col(y), kinds[1]))
        else:
            out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def join(left: Query, right: Query, key: Key, how: str = "inner", right_key: Key | None = None) -> Query:
    """inner, left, right or full join. Columns of the same name become one: left's cell unless it is empty, else right's.

    Result order: left's rows in theirs, each one's matches in right's; then right's rows without a match. Spark picks the
    join strategy; nothing depends on which side is small. Missing text cells are empty, missing typed ones null.
    """
    if err := left.err or right.err:
        return left._fail(err)
    a, ka = _keyed(left, key, "a")
    b, kb = _keyed(right, right_key or key, "b")
    joined = a.join(b, _match(ka, kb, a, b), how)
    headers, cells = [], []
    for i, h in enumerate(left.headers):
        c, kind = F.col(f"a{i}"), a.schema[f"a{i}"].dataType
        if h in right.headers:
            j = right.headers.index(h)
            other, other_kind = F.col(f"b{j}"), b.schema[f"b{j}"].dataType
            if kind == other_kind and not S.is_text(kind):
                c = F.coalesce(c, other)
            else:
                c, kind = F.coalesce(F.nullif(S.text(c, kind), F.lit("")), S.text(other, other_kind)), T.StringType()
        headers.append(h)
        cells.append(F.coalesce(c, F.lit("")) if S.is_text(kind) else c)
    for j, h in enumerate(right.headers):
        if h not in left.headers:
            c = F.col(f"b{j}")
            headers.append(h)
            cells.append(F.coalesce(c, F.lit("")) if S.is_text(b.schema[f"b{j}"].dataType) else c)
    columns = physical_names(headers)
    order = F.struct(F.col("ao").isNull().alias("late"), F.col("ao").alias("l"), F.col("bo").alias("r"))
    return Query(joined.select(*[c.alias(n) for c, n in zip(cells, columns, strict=True)], order.alias(ORDER)), headers, columns, strict=left.strict)


def inner_join(left: Query, right: Query, key: Key) -> Query:
    return join(left, right, key, "inner")


def left_join(left: Query, right: Query, key: Key) -> Query:
    return join(left, right, key, "left")


def right_join(left: Query, right: Query, key: Key) -> Query:
    return join(left, right, key, "right")


def full_join(left: Query, right: Query, key: Key) -> Query:
    return join(left, right, key, "full")


def semi_join(left: Query, right: Query, key: Key) -> Query:
    """Left's rows that have a match."""
    return _one_sided(left, right, key, "left_semi")


def anti_join(left: Query, right: Query, key: Key) -> Query:
    """Left's rows that have none."""
    return _one_sided(left, right, key, "left_anti")


def _one_sided(left: Query, right: Query, key: Key, how: str) -> Query:
    if err := left.err or right.err:
        return left._fail(err)
    a, ka = _keyed(left, key, "a")
    b, kb = _keyed(right, key, "b")
    kept = a.join(b.select(*kb), _match(ka, kb, a, b), how)
    return left._with(kept.select(*[F.col(f"a{i}").alias(c) for i, c in enumerate(left._columns)], F.col("ao").alias(ORDER)))


def concat(*tables: Query) -> Query:
    """All rows under the first table's headers: columns that it lacks are dropped, those that others lack are empty.

    No tables give an empty one, of the active session.
    """
    if not tables:
        return Query.from_rows(SparkSession.active(), [], [])
    tables = tuple(t.settled() for t in tables)
    first = tables[0]
    if err := next((t.err for t in tables if t.err), None):
        return first._fail(err)
    if len({t.df.schema[ORDER].dataType.simpleString() for t in tables}) > 1:
        tables = tuple(t._with(t.ordered().withColumn(ORDER, F.monotonically_increasing_id())) for t in tables)
    parts = []
    for n, t in enumerate(tables):
        cells = []
        for h, c in zip(first.headers, first._columns, strict=True):
            own, kind = t.first_column(h), first.kind(c)
            if own is None:
                cells.append((F.lit("") if S.is_text(kind) else F.lit(None).cast(kind)).alias(c))
            elif t.kind(own) == kind:
                cells.append(F.col(f"`{own}`").alias(c))
            else:
                cells.append((S.text(F.col(f"`{own}`"), t.kind(own)) if S.is_text(kind) else F.col(f"`{own}`").cast(kind)).alias(c))
        parts.append(t.df.select(*cells, F.struct(F.lit(n).alias("table"), F.col(ORDER).alias("row")).alias(ORDER)))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return first._with(df)


def union_by(a: Query, b: Query, key: Key) -> Query:
    """Both tables' rows, the first of each key."""
    both = concat(a, b)
    if both.err:
        return both
    keys = key(both)
    row = F.struct(ORDER, *[F.col(f"`{c}`") for c in both._columns])
    first = both.df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.col(ORDER)).alias("_first"))
    return both._with(first.select(*[F.col(f"_first.`{c}`").alias(c) for c in both._columns], F.col(f"_first.{ORDER}").alias(ORDER)))


def diff(before: Query, after: Query, key: Key) -> DataFrame:
    """change (added, removed, modified), key, before, after (maps of cells), fields (changed names, sorted as in before).

    Of rows with one key the last counts. Columns that only `after` has are no change. One full join of one row per key.
    """
    for q in (before, after):
        if q.err:
            raise q.err

    def last(q: Query, tag: str) -> tuple[DataFrame, list[str]]:
        df, keys = _keyed(q.as_text(), key, tag)
        cells = F.struct(*[F.col(f"{tag}{i}").alias(f"v{i}") for i in range(len(q.headers))])
        return df.groupBy(*keys).agg(F.max_by(cells, F.col(f"{tag}o")).alias(tag)), keys

    a, ka = last(before, "a")
    b, kb = last(after, "b")
    joined = a.join(b, _match(ka, kb, a, b), "full")

    def cell(q: Query, tag: str, h: str) -> Column:
        return F.coalesce(F.col(f"{tag}.v{q.headers.index(h)}"), F.lit("")) if h in q.headers else F.lit("")

    changed = F.array_compact(F.array(*[F.when(cell(before, "a", h) != cell(after, "b", h), F.lit(h)) for h in dict.fromkeys(before.headers)]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "modified")

    def as_map(q: Query, tag: str) -> Column:
        names = list(dict.fromkeys(q.headers))
        return F.when(F.col(tag).isNotNull(), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[cell(q, tag, h) for h in names])))

    keys = F.array(*[F.coalesce(F.col(x), F.col(y)) for x, y in zip(ka, kb, strict=True)])
    fields = F.when(change == "modified", changed).otherwise(F.array().cast("array<string>"))
    out = joined.select(change.alias("change"), F.array_join(keys, "\x1f").alias("key"), as_map(before, "a").alias("before"), as_map(after, "b").alias("after"), fields.alias("fields"))
    return out.where("change is not null")


def intersect(a: Query, b: Query) -> Query:
    """Distinct rows that both have."""
    keys = on_all(*dict.fromkeys(a.headers))
    return semi_join(a, b, keys).distinct()


def except_(a: Query, b: Query) -> Query:
    """Distinct rows of a that b lacks."""
    return anti_join(a, b, on_all(*dict.fromkeys(a.headers))).distinct()


__all__ = ["Key", "anti_join", "concat", "diff", "except_", "full_join", "inner_join", "intersect", "join", "left_join", "on", "on_all", "on_function", "right_join", "semi_join", "union_by"]
