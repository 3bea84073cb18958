"""What cells mean: empty is null, numbers are recognised in text, comparison is numeric or textual by content.

Text columns have these rules. Typed columns keep their types: numbers compare as numbers, and null stands for empty.
Everything is a Column expression, so Catalyst sees through it.
"""

from __future__ import annotations

import math
import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The space characters that trimming removes, the number grammar, boolean words, and date layouts in order.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DECIMAL = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
HEX = r"0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
INFINITY = r"[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
NUMBER = rf"\A(?:[+-]?(?:{DECIMAL}|{HEX}|{INFINITY})|[nN][aA][nN])\z"
INTEGER = r"\A[+-]?[0-9]+\z"
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"
CELL_DATES = (RFC3339, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")
ROW_DATES = (RFC3339, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd")
RECORD_DATES = (RFC3339, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd")

Type = T.DataType | None
#: What to sort by, and whether it falls.
Key = tuple[Column, bool]


def is_text(kind: Type) -> bool:
    return kind is None or isinstance(kind, T.StringType)


def is_number(kind: Type) -> bool:
    return isinstance(kind, T.NumericType)


def text(c: Column, kind: Type = None) -> Column:
    """The cell's text; null is empty."""
    return F.coalesce(c if is_text(kind) else render(c, kind), F.lit(""))


def blank(c: Column, kind: Type = None) -> Column:
    return F.coalesce(c == "", F.lit(True)) if is_text(kind) else c.isNull()


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def num(c: Column, kind: Type = None) -> Column:
    """The number that the text is, or null: no spaces around, no type suffix, no overflow to infinity."""
    if is_number(kind):
        return c.cast("double")
    s = c if is_text(kind) else render(c, kind)
    value = F.when(s.rlike(NUMBER), s).try_cast("double")
    return F.when((F.abs(value) != float("inf")) | F.isnan(value) | s.rlike(rf"\A[+-]?{INFINITY}\z"), value)


def num_trim(c: Column, kind: Type = None) -> Column:
    return num(trim(c) if is_text(kind) else c, kind)


def as_int(c: Column, kind: Type = None) -> Column:
    """The trimmed decimal integer, or 0."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    s = trim(text(c, kind))
    return F.coalesce(F.when(s.rlike(INTEGER), s).try_cast("long"), F.lit(0).cast("long"))


def parse_bool(c: Column) -> Column:
    return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False)


def parse_date(c: Column, layouts: tuple[str, ...] = CELL_DATES) -> Column:
    """The timestamp by the first layout that fits (days before months)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in layouts])


def compare(a: Column, op: str, b: Column, a_num: Column, b_num: Column) -> Column:
    """a op b as numbers if both are, else as text, by bytes. NaN is in no order with anything."""
    ops = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    both = a_num.isNotNull() & b_num.isNotNull()
    return F.when(both, ~F.isnan(a_num) & ~F.isnan(b_num) & ops[op](a_num, b_num)).otherwise(ops[op](a, b))


def sort_keys(c: Column, kind: Type = None, descending: bool = False) -> list[Key]:
    """Sort keys of one total order: empty, then numbers by value, then other text by bytes."""
    if not is_text(kind):
        return [(c, descending)]
    n = num(c)
    rank = F.when(blank(c), 0).when(n.isNotNull(), 1).otherwise(2)
    return [(rank, descending), (n, descending), (F.when(n.isNull(), c), descending)]


def directed(keys: list[Key]) -> list[Column]:
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k, descending in keys]


def like(c: Column, pattern: str) -> Column:
    """% any run, _ one character, neither of them a line end; the whole text, by case."""
    parts = {"%": r"[^\n]*", "_": r"[^\n]"}
    return c.rlike(r"\A" + "".join(parts.get(x) or re.sub(r"([^\w])", r"\\\1", x) for x in pattern) + r"\z")


def fmt_float(v: Column) -> Column:
    """The shortest decimal text of a double, never with an exponent; whole numbers without a point."""
    s = v.cast("string")
    part = lambda i: F.regexp_extract(s, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
    e = part(4).try_cast("int")
    fraction = F.regexp_replace(part(3), "0+$", "")
    big = F.when(F.length(fraction) <= e, F.concat(part(2), F.rpad(fraction, e, F.lit("0")))).otherwise(F.concat(part(2), F.substring(fraction, F.lit(1), e), F.lit("."), F.substring(fraction, e + 1, F.lit(400))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), part(2), fraction)
    plain = F.regexp_replace(s, r"\.0$", "")
    return (
        F.when(F.isnan(v), "NaN")
        .when(v == float("inf"), "+Inf")
        .when(v == float("-inf"), "-Inf")
        .when(e.isNull(), plain)
        .otherwise(F.concat(part(1), F.when(e >= 0, big).otherwise(small)))
    )


def render(c: Column, kind: Type) -> Column:
    """A typed column as cell text; null stays null."""
    if is_text(kind):
        return c
    if isinstance(kind, T.DoubleType | T.FloatType):
        return fmt_float(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c)
    return c.cast("string")


def cell_type(c: Column) -> Column:
    """empty, int, float, bool, date or string: what a cell's text is, the first that fits."""
    return (
        F.when(blank(c), "empty")
        .when(F.when(c.rlike(INTEGER), c).try_cast("long").isNotNull(), "int")
        .when(num(c).isNotNull(), "float")
        .when(F.lower(c).isin("true", "false"), "bool")
        .when(parse_date(c).isNotNull(), "date")
        .otherwise("string")
    )


# The same on the driver, for literals and single cells.

_NUMBER = re.compile(NUMBER.replace(r"\z", r"\Z"))
_TRIM = "\t\n\x0b\x0c\r \x85\xa0                　"


def py_trim(s: str) -> str:
    return s.strip(_TRIM)


def py_num(s: str) -> float | None:
    if not _NUMBER.match(s):
        return None
    value = float.fromhex(s) if "x" in s.lower() else float(s)
    return None if math.isinf(value) and "inf" not in s.lower() else value


_PY_DATES = {RFC3339: None, "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd": "%Y-%m-%d", "dd/MM/yyyy": "%d/%m/%Y", "MM/dd/yyyy": "%m/%d/%Y", "yyyy/MM/dd": "%Y/%m/%d"}


def py_date(s: str, layouts: tuple[str, ...] = CELL_DATES) -> datetime | None:
    """The time by the first layout that fits."""
    for layout in layouts:
        try:
            form = _PY_DATES[layout]
            if form is None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", s):
                continue
            return datetime.fromisoformat(s) if form is None else datetime.strptime(s, form)
        except ValueError:
            continue
    return None


def literal(n: float, kind: Type) -> float | int:
    """A number as a literal of a column's own kind, so that the column needn't be cast."""
    return int(n) if isinstance(kind, T.IntegralType) and math.isfinite(n) and n == int(n) and abs(n) < 2**53 else n


def py_float(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    s = format(Decimal(repr(v)), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


def py_render(v: object) -> str:
    """The cell text of a Python value."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return py_float(v)
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S") + (v.strftime("%z") or "Z")
    if isinstance(v, date):
        return v.isoformat() + "T00:00:00Z"
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    return str(v)
