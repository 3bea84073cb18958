"""Typed records: dataclasses as schemas, tables of cells as rows of them, and back.

Field metadata: {"csv": "name"} or {"csv": Field(...)}. A dataclass field is read from columns of its own (flatten) or from
JSON in a cell; a dict[str, str] field marked `rest` takes all columns that no other field has.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import TabError
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query, physical_names
from tabspark.operators.validate import date_pattern


@dataclass(frozen=True)
class Field:
    """How a field is stored. layout: of dates; sep: of lists; codec: (text -> value, value -> text) of any other type."""

    name: str = ""
    skip: bool = False
    required: bool = False
    omit_empty: bool = False
    layout: str = ""
    sep: str = ""
    flatten: bool = False
    prefix: str | None = None
    json: bool = False
    rest: bool = False
    codec: tuple | None = None


@dataclass
class Leaf:
    path: tuple[str, ...]
    header: str
    kind: object
    field: Field


SCALARS = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(), datetime: T.TimestampType(), date: T.DateType()}


def _hints(cls: type) -> dict[str, object]:
    out = {}
    for name, hint in typing.get_type_hints(cls).items():
        if typing.get_origin(hint) in (typing.Union, types.UnionType):
            args = [a for a in typing.get_args(hint) if a is not type(None)]
            hint = args[0] if len(args) == 1 else hint
        out[name] = hint
    return out


def _field(f: dataclasses.Field) -> Field:
    given = f.metadata.get("csv", "")
    return Field(name=given) if isinstance(given, str) else given


def leaves(cls: type, path: tuple[str, ...] = (), before: str = "", above: tuple[type, ...] = ()) -> list[Leaf]:
    """Every stored field of a dataclass, nested ones under their columns' names."""
    if cls in above:
        raise TabError(f"{cls.__name__} contains itself")
    hints, out = _hints(cls), []
    for f in dataclasses.fields(cls):
        how, kind = _field(f), hints[f.name]
        if how.skip or how.name == "-":
            continue
        header = before + (how.name or f.name)
        if dataclasses.is_dataclass(kind) and not how.json and not how.codec:
            out += leaves(kind, (*path, f.name), before + how.prefix if how.prefix is not None else header + ".", (*above, cls))
        else:
            out.append(Leaf((*path, f.name), header, kind, how))
    if not path:
        rest = [x for x in out if x.field.rest]
        if len(rest) > 1:
            raise TabError("only one field takes the rest")
        if rest and rest[0].kind not in (dict, dict[str, str]):
            raise TabError("the rest is a dict[str, str]")
    return out


def spark_type(kind: object) -> T.DataType:
    if kind in SCALARS:
        return SCALARS[kind]
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is list:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict or kind is dict:
        return T.MapType(T.StringType(), T.StringType())
    if dataclasses.is_dataclass(kind):
        return T.StructType([T.StructField(f.name, spark_type(_hints(kind)[f.name])) for f in dataclasses.fields(kind)])
    return T.StringType()


def _decode(c: Column, kind: object, how: Field, header: str) -> Column:
    """A cell as a value: trimmed, empty is the type's zero, anything else must parse."""
    s = S.trim(c)
    empty = s == ""

    def parsed(value: Column, zero: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{header}: "), s, F.lit(" doesn't parse"))).cast(spark_type(kind))
        return F.when(empty, zero).when(value.isNotNull(), value).otherwise(wrong)

    if how.codec:
        read = how.codec[0]

        @F.pandas_udf(T.StringType())
        def decode(cells: pd.Series) -> pd.Series:
            return cells.map(read)

        return decode(s)
    if how.json:
        value = F.from_json(s, spark_type(kind))
        return F.when(empty, F.lit(None)).when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{header}: no JSON")).cast(spark_type(kind)))
    if kind is int:
        return parsed(F.when(s.rlike(S.INTEGER), s).try_cast("long"), F.lit(0).cast("long"))
    if kind is float:
        return parsed(S.num(s), F.lit(0.0))
    if kind is bool:
        return parsed(S.parse_bool(s), F.lit(False))
    if kind in (datetime, date):
        value = F.try_to_timestamp(s, F.lit(date_pattern(how.layout))) if how.layout else S.parse_date(s, S.RECORD_DATES)
        return parsed(value.cast(spark_type(kind)), F.lit(None).cast(spark_type(kind)))
    if typing.get_origin(kind) is list:
        parts = F.transform(F.split(s, _quote(how.sep or ",")), lambda x: _decode(x, typing.get_args(kind)[0], Field(), header))
        return F.when(empty, F.array().cast(spark_type(kind))).otherwise(parts)
    return s


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def _encode(c: Column, kind: object, how: Field) -> Column:
    if how.codec:
        write = how.codec[1]

        @F.pandas_udf(T.StringType())
        def encode(values: pd.Series) -> pd.Series:
            return values.map(write)

        return encode(c)
    if how.json:
        return F.to_json(c)
    if kind in (datetime, date) and how.layout:
        out = F.date_format(c, date_pattern(how.layout))
    elif kind in (datetime, date):
        out = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    elif typing.get_origin(kind) is list:
        out = F.array_join(F.transform(c, lambda x: _encode(x, typing.get_args(kind)[0], Field())), how.sep or ",")
    else:
        out = S.render(c, spark_type(kind))
    if how.omit_empty and kind in (int, float):
        out = F.when(c != 0, out)
    if how.omit_empty and kind is bool:
        out = F.when(c, out)
    return F.coalesce(out, F.lit(""))


def _put(tree: dict, path: tuple[str, ...], c: Column) -> None:
    for name in path[:-1]:
        tree = tree.setdefault(name, {})
    tree[path[-1]] = c


def _struct(tree: dict) -> list[Column]:
    return [(F.struct(*_struct(v)) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()]


def decode(q: Query, cls: type) -> DataFrame:
    """Typed rows of a table: a column for each field, structs for nested ones. The first cell that doesn't parse fails the
    job. A required field without its column is an error at once."""
    if q.err:
        raise q.err
    found = leaves(cls)
    used = {x.header for x in found if not x.field.rest}
    tree: dict = {}
    for x in found:
        if x.field.rest:
            others = [h for h in dict.fromkeys(q.headers) if h not in used]
            c = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*[q.text(h) for h in others])) if others else F.create_map().cast("map<string,string>")
        else:
            if x.field.required and x.header not in q.headers:
                raise TabError(f"required column {x.header} is missing")
            c = _decode(q.text(x.header), x.kind, x.field, x.header)
        _put(tree, x.path, c)
    return q.ordered().select(*_struct(tree))


def iterate(q: Query, cls: type) -> Iterator[object]:
    """One record at a time."""

    def build(kind: type, row: object) -> object:
        hints = _hints(kind)
        have = row.asDict()
        values = {k: build(hints[k], v) if dataclasses.is_dataclass(hints[k]) and v is not None else v for k, v in have.items()}
        return kind(**values)

    for row in decode(q, cls).toLocalIterator():
        yield build(cls, row)


def encode(df: DataFrame, cls: type, rest_keys: list[str] | None = None) -> Query:
    """Typed rows as a table of text. The rest's columns are its keys over all rows, sorted, unless told."""
    headers, cells = [], []
    found = leaves(cls)
    fixed = {x.header for x in found if not x.field.rest}
    for x in found:
        c = F.col(".".join(f"`{p}`" for p in x.path))
        if x.field.rest:
            keys = rest_keys if rest_keys is not None else sorted(r[0] for r in df.select(F.explode(F.map_keys(c))).distinct().collect())
            if both := fixed & set(keys):
                raise TabError(f"{sorted(both)} are fields and rest keys")
            headers += keys
            cells += [F.coalesce(F.try_element_at(c, F.lit(k)), F.lit("")) for k in keys]
        else:
            headers.append(x.header)
            cells.append(_encode(c, x.kind, x.field))
    columns = physical_names(headers)
    return Query(df.select(*[c.alias(n) for c, n in zip(cells, columns, strict=True)], F.monotonically_increasing_id().alias(ORDER)), headers, columns)


def encode_records(spark: SparkSession, records: list[object], cls: type, rest_keys: list[str] | None = None) -> Query:
    schema = T.StructType([T.StructField(f.name, spark_type(_hints(cls)[f.name])) for f in dataclasses.fields(cls)])
    rows = [dataclasses.astuple(r) for r in records]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("_n", T.LongType()), T.StructField("r", schema)]))
    return encode(df.orderBy("_n").select("r.*"), cls, rest_keys)
