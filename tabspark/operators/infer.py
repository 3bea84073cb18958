"""Column statistics and type inference, in one pass over a table."""

from __future__ import annotations

import keyword
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import semantics as S
from tabspark.operators.query import Query

SAMPLE = 1000


def _all(test: Column, c: Column) -> Column:
    """Whether all cells that aren't empty pass; true if there is none."""
    return F.coalesce(F.bool_and(F.when(~S.blank(c), F.coalesce(test, F.lit(False)))), F.lit(True))


def _is_int(c: Column) -> Column:
    return F.when(c.rlike(S.INTEGER), c).try_cast("long").isNotNull()


def stats(q: Query, approximate: bool = False) -> DataFrame:
    """column, type (int, float, bool, string), rows, empty, distinct (of cells that aren't empty), in column order."""
    if q.err:
        raise q.err
    aggs = []
    for i, c in enumerate(q._columns):
        t = S.text(F.col(f"`{c}`"), q.kind(c))
        kind = F.when(_all(_is_int(t), t), "int").when(_all(S.num(t).isNotNull(), t), "float").when(_all(F.lower(t).isin("true", "false"), t), "bool").otherwise("string")
        cell = F.when(~S.blank(t), t)
        aggs += [kind.alias(f"t{i}"), F.count(F.when(S.blank(t), 1)).alias(f"e{i}"), (F.approx_count_distinct(cell) if approximate else F.count_distinct(cell)).alias(f"d{i}")]
    one = q.df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    each = [F.struct(F.lit(i).alias("n"), F.lit(h).alias("column"), F.col(f"t{i}").alias("type"), F.col("rows"), F.col(f"e{i}").alias("empty"), F.col(f"d{i}").alias("distinct")) for i, h in enumerate(q.headers)]
    return one.select(F.explode(F.array(*each)).alias("s")).select("s.*").orderBy("n").drop("n")


def infer_types(q: Query, sample: int | None = SAMPLE) -> dict[str, str]:
    """int, float, bool, date or string for each column, from the first rows (all: sample=None); without cells: string."""
    src = q.limit(sample) if sample else q
    aggs = []
    for i, c in enumerate(src._columns):
        t = S.text(F.col(f"`{c}`"), src.kind(c))
        none = F.count(F.when(~S.blank(t), 1)) == 0
        tests = [("int", _is_int(t)), ("float", S.num(t).isNotNull()), ("bool", F.lower(t).isin("true", "false")), ("date", S.parse_date(t).isNotNull())]
        kind = F.when(none, "string")
        for name, test in tests:
            kind = kind.when(_all(test, t), name)
        aggs.append(kind.otherwise("string").alias(f"t{i}"))
    row = src.df.agg(*aggs).first()
    return dict(zip(src.headers, row, strict=True))


SPARK = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.TimestampType(), "string": T.StringType()}
PYTHON = {"int": "int", "float": "float", "bool": "bool", "date": "datetime", "string": "str"}


def struct_type(q: Query, sample: int | None = SAMPLE) -> T.StructType:
    return T.StructType([T.StructField(h, SPARK[k]) for h, k in infer_types(q, sample).items()])


def identifier(header: str) -> str:
    """A header as a field name: words joined by _, never a keyword or a digit first."""
    name = re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", header)).strip("_").lower() or "field"
    return f"f_{name}" if name[0].isdigit() or keyword.iskeyword(name) else name


def generate(q: Query, name: str = "Record", sample: int | None = SAMPLE) -> str:
    """Source of a dataclass that tabspark.operators.records can read the table into."""
    kinds = infer_types(q, sample)
    lines = ["from dataclasses import dataclass, field", *(["from datetime import datetime"] if "date" in kinds.values() else []), "", "", "@dataclass", f"class {name}:"]
    used: set[str] = set()
    for h, k in kinds.items():
        f = identifier(h)
        while f in used:
            f += "_"
        used.add(f)
        lines.append(f'    {f}: {PYTHON[k]} = field(default=None, metadata={{"csv": {h!r}}})')
    return "\n".join(lines) + "\n"
