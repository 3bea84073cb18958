"""Declarative validation: rules compiled to violation expressions, one pass for all rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import FieldError, TabError, ValidationError
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query

#: Layouts by reference time, longest first, to patterns.
LAYOUT = (("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "EEE"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"), ("MST", "z"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), (".000000000", ".SSSSSSSSS"), (".000000", ".SSSSSS"), (".000", ".SSS"))


def date_pattern(layout: str) -> str:
    """A layout written as the reference time (2006-01-02 15:04:05) as a Spark pattern."""
    out, i = "", 0
    while i < len(layout):
        for token, pattern in LAYOUT:
            if layout.startswith(token, i):
                out, i = out + pattern, i + len(token)
                break
        else:
            c = layout[i]
            out, i = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    """violated: whether a cell's text breaks the rule; error: what to say of it. message: the error of a cell's text (null:
    none), in place of both. number: whether a value of a numeric column breaks it, where that needs no text."""

    name: str
    violated: Callable[[Column], Column]
    error: str
    message: Callable[[Column], Column] | None = None
    number: Callable[[Column], Column] | None = None


def _typed(kind: str, fits: Callable[[Column], Column], number: Callable[[Column], Column] | None = None) -> Rule:
    return Rule(f"type:{kind}", lambda c: (c != "") & ~fits(c), f"not a valid {kind}", number=number)


def required() -> Rule:
    return Rule("required", lambda c: S.trim(c) == "", "value is required", number=lambda n: n.isNull())


def integer() -> Rule:
    return _typed("int", lambda c: F.when(c.rlike(S.INTEGER), c).try_cast("long").isNotNull())


def floating() -> Rule:
    return _typed("float", lambda c: S.num(c).isNotNull(), lambda n: F.lit(False))


def boolean() -> Rule:
    return _typed("bool", lambda c: c.isin(*S.TRUE, *S.FALSE))


def date(layout: str) -> Rule:
    pattern = date_pattern(layout)
    return _typed("date", lambda c: F.try_to_timestamp(c, F.lit(pattern)).isNotNull())


def string() -> Rule:
    return Rule("type:string", lambda c: F.lit(False), "")


def regex(pattern: str) -> Rule:
    return Rule("regex", lambda c: (c != "") & ~c.rlike(pattern), f"does not match {pattern}")


def in_range(least: float | None = None, most: float | None = None, name: str = "range") -> Rule:
    """Bounds included; text that is no number is a violation, NaN isn't."""

    def outside(n: Column) -> Column:
        low = F.lit(False) if least is None else n < float(least)
        high = F.lit(False) if most is None else n > float(most)
        return ~F.isnan(n) & (low | high)

    def violated(c: Column) -> Column:
        n = S.num(c)
        return (c != "") & (n.isNull() | outside(n))

    return Rule(name, violated, f"not a number from {least} to {most}", number=lambda n: n.isNotNull() & outside(n.cast("double")))


def minimum(v: float) -> Rule:
    return in_range(v, None, "min")


def maximum(v: float) -> Rule:
    return in_range(None, v, "max")


def min_len(n: int) -> Rule:
    return Rule("minlen", lambda c: F.char_length(c) < n, f"shorter than {n}")


def max_len(n: int) -> Rule:
    return Rule("maxlen", lambda c: F.char_length(c) > n, f"longer than {n}")


def one_of(*values: str) -> Rule:
    return Rule("oneof", lambda c: (c != "") & ~c.isin(*values), f"not one of {', '.join(values)}")


def custom(name: str, fn: Callable[[str], str | None]) -> Rule:
    """fn sees each cell, empty ones too, and returns what is wrong with it, if anything (or raises ValueError); that is the
    violation's error."""

    def check(v: str) -> str | None:
        try:
            found = fn(v)
        except ValueError as e:
            found = str(e) or f"fails {name}"
        return (found if isinstance(found, str) else f"fails {name}") if found else None

    @F.pandas_udf(T.StringType())
    def message(s: pd.Series) -> pd.Series:
        return s.map(check)

    return Rule(name, lambda c: message(c).isNotNull(), f"fails {name}", message)


class Schema:
    """Columns with their rules, in order."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, Rule]] = []

    def column(self, name: str, *rules: Rule) -> Schema:
        self.rules += [(name, r) for r in rules]
        return self

    @classmethod
    def from_json(cls, text: str) -> Schema:
        """{"columns": [{"name", "type", "required", "regex", "min", "max", "one_of"}]}, or the list alone."""
        data = json.loads(text)
        self = cls()
        types = {"int": integer, "float": floating, "bool": boolean, "string": string}
        for c in data["columns"] if isinstance(data, dict) else data:
            rules = [required()] if c.get("required") else []
            rules += [types[c["type"]]()] if c.get("type") in types else []
            rules += [regex(c["regex"])] if c.get("regex") else []
            low, high = c.get("min"), c.get("max")
            if low is not None and high is not None:
                rules.append(in_range(low, high))
            elif low is not None:
                rules.append(minimum(low))
            elif high is not None:
                rules.append(maximum(high))
            rules += [one_of(*c["one_of"])] if c.get("one_of") else []
            self.column(c["name"], *rules)
        return self

    def violations(self, df: DataFrame, cell: Callable[[str], Column], keep: Iterable[str] = (), number: Callable[[str], Column | None] = lambda name: None) -> DataFrame:
        """field, value, rule, error (and the columns kept) of every violation; df may be a stream. number: a numeric column."""
        if not self.rules:
            raise TabError("the schema has no rules")
        found = []
        for i, (name, r) in enumerate(self.rules):
            n, text = number(name), cell(name)
            hit = r.violated(text) if n is None or r.number is None else r.number(n)
            error = F.lit(r.error) if r.message is None else r.message(text)
            found.append(F.when(hit, F.struct(F.lit(i).alias("n"), F.lit(name).alias("field"), text.alias("value"), F.lit(r.name).alias("rule"), error.alias("error"))))
        return df.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*keep, "v.*")

    def validate(self, q: Query) -> DataFrame:
        """row (its order), field, value, rule, error of all violations; a column that q lacks is empty."""
        if q.err:
            raise q.err
        q = q.settled()
        number = lambda name: q.cell(name)[0] if S.is_number(q.cell(name)[1]) else None
        out = self.violations(q.df, q.text, [ORDER], number)
        return out.withColumnRenamed(ORDER, "row")

    def validate_list(self, q: Query) -> list[FieldError]:
        """Violations by row and rule, rows numbered from 0; for tables with few of them."""
        q = q.settled()
        places = q.df.select(ORDER).orderBy(ORDER)
        rows = self.validate(q).orderBy("row", "n").collect()
        if not rows:
            return []
        number = {r[0]: i for i, r in enumerate(places.toLocalIterator())}
        return [FieldError(number[r["row"]], r["field"], r["value"], r["rule"], r["error"]) for r in rows]

    def validate_or_raise(self, q: Query) -> None:
        if found := self.validate_list(q):
            raise ValidationError(found)

    def validate_stream(self, stream: DataFrame) -> DataFrame:
        """The same of a streaming DataFrame of text columns, stateless, for append mode."""
        have = set(stream.columns)
        return self.violations(stream, lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in have else F.lit(""), stream.columns)
