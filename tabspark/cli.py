"""python -m tabspark COMMAND: tables from files, results as text on the standard output."""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabspark.errors import TabError
from tabspark.functions import semantics as S
from tabspark.operators import infer, merge
from tabspark.operators.query import Query
from tabspark.operators.validate import Schema
from tabspark.plans import sql
from tabspark.sources.files import read_bytes
from tabspark.sources.registry import convert, load
from tabspark.sources.text import format_row

# A condition's operators, in the order in which they are looked for.
OPERATORS = ("<=", ">=", "==", "!=", "<", ">", "contains", "starts", "regex")


def filter_rows(q: Query, condition: str) -> Query:
    """COLUMN OPERATOR VALUE. By a number < > <= >= compare numbers, cells that are none as 0; by anything else they compare
    text, as == and != always do."""
    for op in OPERATORS:
        left, found, right = condition.partition(f" {op} " if op.isalpha() else op)
        if found:
            break
    else:
        raise TabError(f"no operator in {condition!r}; there are {' '.join(OPERATORS)}")
    name, value = left.strip(), right.strip().strip("\"'")
    if op in ("==", "!="):
        hit = q.text(name) == value
        return q.where(hit if op == "==" else ~hit)
    if op == "contains":
        return q.where(q.text(name).contains(value))
    if op == "starts":
        return q.where(q.text(name).startswith(value))
    if op == "regex":
        re.compile(value)
        return q.where(q.text(name).rlike(value))
    v = S.py_num(value)
    n, v = (q.text(name), value) if v is None else (F.coalesce(S.num_trim(*q.cell(name)), F.lit(0.0)), v)
    return q.where({"<": n < v, ">": n > v, "<=": n <= v, ">=": n >= v}[op])


def _print(q: Query) -> None:
    if q.err:
        raise q.err
    print(format_row(q.headers))
    for r in q.iterate():
        print(format_row(r.values()))


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabspark")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, files: int = 1) -> None:
        c = commands.add_parser(name)
        for flags, more in options:
            c.add_argument(*flags, **more)
        for i in range(files):
            c.add_argument(f"file{i or ''}")

    n = (("-n",), {"type": int, "default": 10})
    column = (("-c",), {"required": True, "dest": "columns"})
    command("head", n)
    command("tail", n)
    command("select", column)
    command("filter", (("-w",), {"required": True, "dest": "where"}))
    command("sort", column, (("-desc", "--desc"), {"action": "store_true", "dest": "desc"}))
    command("stats")
    command("join", (("-on",), {"required": True, "dest": "on"}), (("-mode",), {"default": "inner", "dest": "mode", "choices": ["inner", "left", "right", "full"]}), files=2)
    command("diff", (("-on",), {"required": True, "dest": "on"}), files=2)
    command("validate", (("-schema",), {"required": True, "dest": "schema"}))
    command("convert", (("-to",), {"required": True, "dest": "to"}), files=2)
    command("gen-struct", (("-name",), {"default": "Record", "dest": "name"}), (("-n",), {"type": int, "default": infer.SAMPLE}))
    command("sql", (("-q",), {"dest": "query", "required": True}))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args[:1] == ["sql"] and "-q" not in args and len(args) == 3:
        args = ["sql", "-q", args[1], args[2]]  # the query may come first
    a = _arguments().parse_args(args)
    if spark is None:
        from tabspark.session import get_session

        spark = get_session()
        spark.sparkContext.setLogLevel("ERROR")
    try:
        return _run(a, spark)
    except (TabError, FileNotFoundError) as e:
        print(f"tabspark: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.command == "sql":
        sql.parse(a.query)  # a wrong query is told before the file is read
    if a.command == "convert":
        convert(spark, a.file, a.file1, a.to)
        return 0
    q = load(spark, a.file)
    if a.command == "head":
        _print(q.limit(a.n))
    elif a.command == "tail":
        _print(q.tail(a.n))
    elif a.command == "select":
        _print(q.select(*[c.strip() for c in a.columns.split(",")]))
    elif a.command == "filter":
        _print(filter_rows(q, a.where))
    elif a.command == "sort":
        _print(q.order_by(a.columns.strip(), a.desc))
    elif a.command == "sql":
        _print(sql.run(q, a.query))
    elif a.command == "stats":
        rows = infer.stats(q).collect()
        print(f"rows: {rows[0]['rows'] if rows else 0}\ncolumns: {len(q.headers)}")
        for r in rows:
            print(f"{r.column}: {r.type}, {r.empty} empty, {r['distinct']} distinct")
    elif a.command == "join":
        _print(merge.join(q, load(spark, a.file1), merge.on(a.on), a.mode))
    elif a.command == "diff":
        changes = merge.diff(q, load(spark, a.file1), merge.on(a.on)).orderBy("change", "key").collect()
        for change in ("added", "removed", "modified"):
            own = [r for r in changes if r.change == change]
            print(f"{change}: {len(own)}")
            for r in own:
                print(f"  {r.key}" + (f": {', '.join(r.fields)}" if r.fields else ""))
    elif a.command == "validate":
        found = Schema.from_json(read_bytes(spark, a.schema).decode()).validate_list(q)
        for e in found:
            print(f"row {e.row}, {e.field}: {e.error} ({e.rule}): {e.value!r}")
        print(f"{len(found)} violations")
        return int(bool(found))
    else:
        print(infer.generate(q, a.name, a.n), end="")
    return 0
