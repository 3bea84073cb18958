"""A one-table SQL subset, compiled to DataFrame operations.

    SELECT * | item, ...   [FROM name] [WHERE condition] [GROUP BY name, ...] [ORDER BY name [ASC|DESC], ...] [LIMIT n]
    item: name | COUNT(*) | COUNT|SUM|AVG|MIN|MAX (name), each with an optional AS alias
    condition: comparisons with = == != <> < > <= >=, [NOT] LIKE, IS [NOT] NULL; NOT, AND, OR and parentheses

= and != compare text (numbers where a column is typed as one); the others compare numbers if both sides are, else text.
Empty is null, and conditions are true or false. By default each key of ORDER BY sorts the result of the one before it, so
the last one leads; standard_order=True makes the first one lead, as elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import MissingColumn, SqlError
from tabspark.functions import semantics as S
from tabspark.operators.query import ORDER, Query, physical_names

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
KEYWORDS = ("SELECT", "FROM", "WHERE", "GROUP", "ORDER", "BY", "LIMIT", "AND", "OR", "NOT", "LIKE", "IS", "NULL", "AS", "ASC", "DESC", "IN", *AGGREGATES)
_TOKEN = re.compile(r"""\s*(?:(?P<number>-?(?:\d+(?:\.\d*)?|\.\d+))|(?P<string>'[^']*'|"[^"]*")|(?P<name>[^\W\d][\w.]*)|(?P<op><=|>=|==|!=|<>|[=<>(),*;]))""")


@dataclass
class Token:
    kind: str  # number, string, name, keyword, op or end
    text: str


@dataclass
class Value:
    """A column (by name), or a literal."""

    text: str
    column: bool = False


@dataclass
class Condition:
    op: str  # and, or, not, like, null, or a comparison
    parts: list[Condition | Value] = field(default_factory=list)


@dataclass
class Item:
    name: str
    alias: str = ""
    function: str = ""

    @property
    def header(self) -> str:
        return self.alias or (f"{self.function}({self.name})" if self.function else self.name)


@dataclass
class Statement:
    items: list[Item]
    table: str = ""
    where: Condition | None = None
    group: list[str] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip().removesuffix(";").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected {text[at:].strip()[:10]!r} at {at}")
        kind, word = m.lastgroup, m[m.lastgroup]
        if kind == "name" and word.upper() in KEYWORDS:
            kind, word = "keyword", word.upper()
        out.append(Token(kind, word[1:-1] if kind == "string" else word))
        at = m.end()
    return [*out, Token("end", "")]


class _Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, *texts: str) -> bool:
        """Takes the next token if it is one of these keywords or operators."""
        if self.now.kind in ("keyword", "op") and self.now.text in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SqlError(f"expected {text}, found {self.now.text or 'the end'!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise SqlError(f"expected a name, found {self.now.text or 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def names(self) -> list[str]:
        found = [self.name()]
        while self.take(","):
            found.append(self.name())
        return found

    def statement(self) -> Statement:
        self.need("SELECT")
        s = Statement([self.item()])
        while self.take(","):
            s.items.append(self.item())
        if len(s.items) > 1 and any(i.name == "*" and not i.function for i in s.items):
            raise SqlError("* stands alone")
        if self.take("FROM"):
            s.table = self.name()
        if self.take("WHERE"):
            s.where = self.either()
        if self.take("GROUP"):
            self.need("BY")
            s.group = self.names()
        if self.take("ORDER"):
            self.need("BY")
            while True:
                name = self.name()
                s.order.append((name, self.take("DESC") or (self.take("ASC") and False)))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            if self.now.kind != "number" or not re.fullmatch(r"-?\d+", self.now.text):
                raise SqlError("LIMIT takes a whole number")
            s.limit = max(0, int(self.now.text))
            self.at += 1
        if self.now.kind != "end":
            raise SqlError(f"unexpected {self.now.text!r}")
        return s

    def item(self) -> Item:
        if self.take("*"):
            return Item("*")
        if self.now.kind == "keyword" and self.now.text in AGGREGATES:
            function = self.now.text
            self.at += 1
            self.need("(")
            name = "*" if self.take("*") else self.name()
            if name == "*" and function != "COUNT":
                raise SqlError(f"{function}(*) has no meaning")
            self.need(")")
            item = Item(name, function=function)
        else:
            item = Item(self.name())
        if self.take("AS"):
            item.alias = self.name()
        return item

    def either(self) -> Condition:
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Condition("or", parts)

    def both(self) -> Condition:
        parts = [self.negation()]
        while self.take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Condition("and", parts)

    def negation(self) -> Condition:
        return Condition("not", [self.negation()]) if self.take("NOT") else self.comparison()

    def comparison(self) -> Condition:
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        left = self.value()
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            null = Condition("null", [left])
            return Condition("not", [null]) if negated else null
        negated = self.take("NOT")
        if self.take("LIKE"):
            like = Condition("like", [left, self.value()])
            return Condition("not", [like]) if negated else like
        if negated:
            raise SqlError("expected LIKE after NOT")
        for op in ("=", "==", "!=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return Condition({"==": "=", "<>": "!="}.get(op, op), [left, self.value()])
        raise SqlError(f"{left.text!r} alone is no condition")

    def value(self) -> Value:
        t = self.now
        if t.kind == "name":
            self.at += 1
            return Value(t.text, column=True)
        if t.kind in ("number", "string"):
            self.at += 1
            return Value(t.text)
        if self.take("NULL"):
            return Value("")
        raise SqlError(f"expected a value, found {t.text or 'the end'!r}")


def parse(text: str) -> Statement:
    return _Parser(tokenize(text)).statement()


def condition(q: Query, c: Condition) -> Column:
    """A condition as a Column, for a filter: null counts as false, and what stands under NOT is never null.

    Literals are folded here; comparisons of a column with a literal stay plain, so that they reach the scan.
    """
    if c.op in ("and", "or"):
        out = condition(q, c.parts[0])
        for p in c.parts[1:]:
            out = out & condition(q, p) if c.op == "and" else out | condition(q, p)
        return out
    if c.op == "not":
        return ~F.coalesce(condition(q, c.parts[0]), F.lit(False))
    left = c.parts[0]
    if c.op == "null":
        if not left.column:
            return F.lit(S.py_trim(left.text) == "")
        cell, kind = q.cell(left.text)
        return S.trim(S.text(cell)) == "" if S.is_text(kind) else cell.isNull()
    right = c.parts[1]
    if c.op == "like":
        if right.column:
            raise SqlError("LIKE takes a literal pattern")
        return S.like(_text(q, left), right.text)
    if c.op in ("=", "!="):
        if left.column and not right.column:
            equal = q.equals(left.text, right.text)
        elif right.column and not left.column:
            equal = q.equals(right.text, left.text)
        elif left.column:
            (a, ka), (b, kb) = q.cell(left.text), q.cell(right.text)
            equal = a.eqNullSafe(b) if S.is_number(ka) and S.is_number(kb) else S.text(a, ka) == S.text(b, kb)
        else:
            equal = F.lit(left.text == right.text)
        return equal if c.op == "=" else ~F.coalesce(equal, F.lit(False))
    for value, other, op in ((left, right, c.op), (right, left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}[c.op])):
        if value.column and not other.column and S.is_number(q.cell(value.text)[1]) and (n := S.py_num(S.py_trim(other.text))) is not None:
            cell, kind = q.cell(value.text)  # reaches the scan as a filter
            n = S.literal(n, kind)
            plain = {"<": cell < n, ">": cell > n, "<=": cell <= n, ">=": cell >= n}[op]
            return plain & ~F.isnan(cell) if isinstance(kind, T.DoubleType | T.FloatType) and op in (">", ">=") else plain
    return S.compare(_text(q, left), c.op, _text(q, right), _number(q, left), _number(q, right))


def _text(q: Query, v: Value) -> Column:
    return q.text(v.text) if v.column else F.lit(v.text)


def _number(q: Query, v: Value) -> Column:
    return S.num_trim(*q.cell(v.text)) if v.column else F.lit(S.py_num(S.py_trim(v.text))).cast("double")


def run(q: Query, text: str, standard_order: bool = False) -> Query:
    """The result of a statement over q, under its headers."""
    s = parse(text)
    if q.err:
        return q
    if s.where:
        q = q.where(condition(q, s.where))
    order = s.order if standard_order else s.order[::-1]
    if s.group or any(i.function for i in s.items):
        return _limited(_aggregate(q, s), order, s.limit)
    aliases = {i.alias: i.name for i in s.items if i.alias}
    q = _limited(q, [(aliases.get(n, n) if q.column(n) is None else n, d) for n, d in order], s.limit)
    if s.items[0].name == "*":
        return q
    return _project(q, s)


def _project(q: Query, s: Statement) -> Query:
    """The items under their headers, with the keys that the rows were sorted by hidden beside them."""
    if q.err:
        return q
    picked = [q.column(i.name) for i in s.items]
    if None in picked:
        return q._fail(MissingColumn(s.items[picked.index(None)].name))
    headers = [i.header for i in s.items]
    columns = physical_names(headers)
    sorted_by = q._keys or []
    df = q.df.select(*[F.col(f"`{p}`").alias(c) for p, c in zip(picked, columns, strict=True)], *q._hidden(), *[k.alias(f"_k{n}") for n, (k, _) in enumerate(sorted_by)])
    out = Query(df, headers, columns, strict=q.strict)
    out._keys = [(F.col(f"_k{n}"), d) for n, (_, d) in enumerate(sorted_by)] or None
    return out


def _limited(q: Query, order: list[tuple[str, bool]], limit: int | None) -> Query:
    if order:
        q = q.order_by_keys(order)
    return q if limit is None else q.limit(limit)


def _aggregate(q: Query, s: Statement) -> Query:
    """Groups by the first columns of these names; a column outside any function has its group's first value."""
    if q.err:
        return q
    q = q.settled(order=any(not i.function and i.name not in s.group for i in s.items))
    keys = []
    for i, name in enumerate(s.group):
        c = q.first_column(name)
        keys.append((F.lit("") if c is None else F.col(f"`{c}`") if not S.is_text(q.kind(c)) else S.text(F.col(f"`{c}`"))).alias(f"_g{i}"))
    if len(s.group) == 1 and q.first_column(s.group[0]) is None:
        q = q.where(F.lit(False))
    aggs, headers, keyed = [], [], {}
    for i in s.items:
        if i.function:
            aggs.append(q.agg_column(i.function.lower(), i.name))
        elif i.name == "*":
            row = F.array_join(F.array(*[S.text(F.col(f"`{c}`"), q.kind(c)) for c in q._columns]), ",")
            aggs.append(F.coalesce(F.min_by(row, F.col(ORDER)), F.lit("")))
        else:
            c = q.column(i.name)
            if c is None:
                return q._fail(MissingColumn(i.name))
            if i.name in s.group and q.first_column(i.name) == c:
                keyed[len(headers)] = f"_g{s.group.index(i.name)}"  # the key itself: an aggregate of text would need a sort
                headers.append(i.header)
                continue
            first = F.min_by(F.col(f"`{c}`"), F.col(ORDER))
            aggs.append(F.coalesce(first, F.lit("")) if S.is_text(q.kind(c)) else first)
        headers.append(i.header)
    columns = physical_names(headers)
    named = [a.alias(c) for a, c in zip(aggs, (c for n, c in enumerate(columns) if n not in keyed), strict=True)]
    if keys:
        df = q.df.groupBy(*keys).agg(*named) if named else q.df.select(*keys).distinct()
        order = F.struct(*[F.col(f"_g{i}") for i in range(len(keys))])
    else:
        df, order = q.df.agg(*named), F.lit(0)
    out = [F.col(keyed[n]).alias(c) if n in keyed else F.col(f"`{c}`") for n, c in enumerate(columns)]
    return Query(df.select(*out, order.alias(ORDER)), headers, columns, strict=q.strict)
