"""The fluent API, SQL, merge and validation on small literal tables, with whole results."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabspark.errors import MissingColumn, SqlError, ValidationError
from tabspark.functions import semantics as S
from tabspark.operators import infer, merge
from tabspark.operators import validate as V
from tabspark.operators.query import Query
from tabspark.plans import sql

PEOPLE = [("1", "Alice", "30", "Paris"), ("2", "Bob", "25", "Berlin"), ("3", "Charlie", "35", "Paris"), ("4", "Diana", "28", "Madrid"), ("5", "Eve", "42", "Berlin")]


@pytest.fixture
def people(spark):
    return Query.from_rows(spark, PEOPLE, ["id", "name", "age", "city"])


def names(q):
    return [r["name"] for r in q.to_records()]


def test_filters(people):
    assert names(people.where_eq("city", "Paris")) == ["Alice", "Charlie"]
    assert names(people.where_in("name", "Eve", "Bob")) == ["Bob", "Eve"]
    assert names(people.where(lambda r: r.int("age") > 29)) == ["Alice", "Charlie", "Eve"]
    assert names(people.where_not(F.col("age") > "29")) == ["Bob", "Diana"]
    assert people.where_not_empty("name").count() == 5
    assert people.where_eq("none", "").count() == 5


def test_order_limit_distinct(people):
    assert names(people.order_by("age", descending=True).limit(2)) == ["Eve", "Charlie"]
    assert names(people.skip(1).limit(2)) == ["Bob", "Charlie"]
    assert names(people.reverse()) == ["Eve", "Diana", "Charlie", "Bob", "Alice"]
    assert names(people.tail(2).clone()) == ["Diana", "Eve"]
    assert people.first()[0]["name"] == "Alice" and people.last()[0]["name"] == "Eve"
    assert names(people.distinct("city")) == ["Alice", "Bob", "Diana"]
    assert names(people.order_by("age").distinct("city")) == ["Bob", "Diana", "Alice"]
    assert people.order_by("age").select("name").to_rows() == [["Bob"], ["Diana"], ["Alice"], ["Charlie"], ["Eve"]]
    assert names(people.limit(-3)) == []
    assert names(people.order_by_fn(lambda a, b: a.int("age") > b.int("age"))) == ["Eve", "Charlie", "Alice", "Diana", "Bob"]


def test_mixed_column_has_one_total_order(spark):
    q = Query.from_rows(spark, [["abc"], ["10"], [""], ["9"], ["-5"], ["Zed"], ["2.5"]], ["v"])
    up = [r[0] for r in q.order_by("v").to_rows()]
    assert up == ["", "-5", "2.5", "9", "10", "Zed", "abc"]
    assert [r[0] for r in q.order_by("v", descending=True).to_rows()] == up[::-1]


def test_projection(people):
    assert people.select("city", "id").limit(1).to_rows() == [["Paris", "1"]]
    assert people.select("id", "id").limit(1).to_rows() == [["1", "1"]]
    assert people.rename("id", "key").headers[0] == "key"
    assert people.with_column("old", lambda r: r.int("age") >= 30).select("old").to_rows()[:2] == [["true"], ["false"]]
    assert people.with_column("up", F.upper("name")).first()[0]["up"] == "ALICE"
    assert people.map(lambda r: [r["id"], r["name"][::-1]]).first()[0].values() == ["1", "ecilA", "", ""]


def test_rows_on_the_driver(spark):
    q = Query.from_rows(spark, [[" 7 ", "1.5x", "T", "2024-02-03 04:05:06"], ["3.9", "2", "no", "30/02/2024"]], ["i", "f", "b", "d"]).set_headers("n")
    a, b = q.iterate()
    assert (a.int("n"), a.float("f"), a.bool("b"), a.date("d")) == (7, 0.0, True, datetime(2024, 2, 3, 4, 5, 6))
    assert (b.int("n"), b.float("f"), b.bool("b"), b.date("d"), b.get("none"), b.at(9)) == (0, 2.0, False, None, "", "")
    assert S.py_date("2024-02-03T04:05:06Z").tzinfo is not None


def test_errors_stick(people):
    q = people.select("nope").limit(3)
    assert isinstance(q.err, MissingColumn) and q.count() == 0 and q.to_rows() == []
    people.strict = True
    with pytest.raises(MissingColumn):
        people.order_by("nope")


def test_aggregates(people, spark):
    assert (people.count(), people.sum("age"), people.avg("age"), people.min("age"), people.max("age")) == (5, 160.0, 32.0, 25.0, 42.0)
    assert people.count_by("city") == {"Paris": 2, "Berlin": 2, "Madrid": 1}
    assert {k: v.count() for k, v in people.group_by("city").items()} == {"Paris": 2, "Berlin": 2, "Madrid": 1}
    assert people.reduce("", lambda a, r: a + r["id"]) == "12345"
    dirty = Query.from_rows(spark, [["1"], ["x"], [""], [" 5 "], ["1e400"], ["2.5"]], ["v"])
    assert (dirty.sum("v"), dirty.avg("v"), dirty.min("v")) == (3.5, 1.75, 1.0)
    assert dirty.sum("none") == 0.0


@pytest.mark.parametrize(
    "query, rows",
    [
        ("SELECT name FROM t WHERE age >= 30", [["Alice"], ["Charlie"], ["Eve"]]),
        ("SELECT name WHERE age >= 28 AND city = 'Paris'", [["Alice"], ["Charlie"]]),
        ("SELECT name FROM t WHERE city = 'Paris' OR city = \"Madrid\"", [["Alice"], ["Charlie"], ["Diana"]]),
        ("SELECT name FROM t ORDER BY age DESC LIMIT 1", [["Eve"]]),
        ("SELECT COUNT(*) FROM t", [["5"]]),
        ("SELECT AVG(age) AS a, MIN(age), MAX(age) FROM t", [["32", "25", "42"]]),
        ("SELECT city, COUNT(*) AS n FROM t GROUP BY city", [["Berlin", "2"], ["Madrid", "1"], ["Paris", "2"]]),
        ("SELECT city, name, SUM(age) FROM t GROUP BY city ORDER BY city DESC", [["Paris", "Alice", "65"], ["Madrid", "Diana", "28"], ["Berlin", "Bob", "67"]]),
        ("SELECT name FROM t WHERE name LIKE 'A%'", [["Alice"]]),
        ("SELECT name FROM t WHERE name LIKE '_v_'", [["Eve"]]),
        ("SELECT name FROM t WHERE NOT city = 'Paris'", [["Bob"], ["Diana"], ["Eve"]]),
        ("SELECT name FROM t WHERE age = 30.0", []),
        ("SELECT name FROM t WHERE age <= 25.0", [["Bob"]]),
        ("SELECT name FROM t ORDER BY city, age LIMIT 2", [["Bob"], ["Diana"]]),
        ("SELECT SUM(age), city FROM t WHERE age > 100", [["0", ""]]),
        ("SELECT name FROM t LIMIT -5", []),
        ("SELECT * FROM t WHERE id == 2;", [["2", "Bob", "25", "Berlin"]]),
    ],
)
def test_sql(people, query, rows):
    assert sql.run(people, query).to_rows() == rows


def test_sql_standard_order_and_headers(people):
    assert sql.run(people, "SELECT name FROM t ORDER BY city, age LIMIT 2", standard_order=True).to_rows() == [["Bob"], ["Eve"]]
    assert sql.run(people, "SELECT name AS n, COUNT(age) FROM t").headers == ["n", "COUNT(age)"]
    assert sql.run(people, "SELECT name AS a, city AS name FROM t LIMIT 1").to_records() == [{"a": "Alice", "name": "Paris"}]


def test_sql_null(spark):
    q = Query.from_rows(spark, [["1", "a@b"], ["2", ""], ["3", " "]], ["id", "email"])
    assert sql.run(q, "SELECT id FROM t WHERE email IS NULL").to_rows() == [["2"], ["3"]]
    assert sql.run(q, "SELECT id FROM t WHERE email IS NOT NULL").to_rows() == [["1"]]


@pytest.mark.parametrize("bad", ["", "SELECT", "SELECT a FROM t WHERE a", "SELECT SUM(*) FROM t", "SELECT *, a FROM t", "SELECT a LIMIT 1.5", "SELECT a FROM t HAVING 1", "SELECT a FROM t WHERE a = 'x", "SELECT a b FROM t"])
def test_sql_rejects(bad):
    with pytest.raises(SqlError):
        sql.parse(bad)


def test_joins(spark):
    users = Query.from_rows(spark, [["1", "Ann"], ["2", "Bo"], ["3", "Cy"]], ["id", "name"])
    orders = Query.from_rows(spark, [["2", "5"], ["1", "7"], ["1", "8"], ["4", "9"]], ["id", "amount"])
    assert merge.inner_join(users, orders, merge.on("id")).to_rows() == [["1", "Ann", "7"], ["1", "Ann", "8"], ["2", "Bo", "5"]]
    assert merge.left_join(users, orders, merge.on("id")).to_rows()[-1] == ["3", "Cy", ""]
    assert merge.right_join(users, orders, merge.on("id")).to_rows()[-1] == ["4", "", "9"]
    assert merge.full_join(users, orders, merge.on("id")).to_rows() == [["1", "Ann", "7"], ["1", "Ann", "8"], ["2", "Bo", "5"], ["3", "Cy", ""], ["4", "", "9"]]
    assert merge.semi_join(users, orders, merge.on("id")).to_rows() == [["1", "Ann"], ["2", "Bo"]]
    assert merge.anti_join(users, orders, merge.on("id")).to_rows() == [["3", "Cy"]]
    assert merge.inner_join(users, orders, merge.on_function(lambda r: r["id"] * 2)).count() == 3
    with pytest.raises(MissingColumn):
        merge.inner_join(users, orders, merge.on("name"))


def test_join_fills_shared_columns_and_matches_empty_keys(spark):
    a = Query.from_rows(spark, [["", "x", ""], ["1", "", "p"]], ["k", "v", "w"])
    b = Query.from_rows(spark, [["", "y"], ["1", "z"]], ["k", "v"])
    assert merge.inner_join(a, b, merge.on("k")).to_rows() == [["", "x", ""], ["1", "z", "p"]]


def test_concat_union_diff(spark):
    a = Query.from_rows(spark, [["1", "Alice"], ["2", "Bob"]], ["id", "name"])
    b = Query.from_rows(spark, [["Bobby", "2", "x"], ["Cy", "3", "y"]], ["name", "id", "more"])
    assert merge.concat(a, b).to_rows() == [["1", "Alice"], ["2", "Bob"], ["2", "Bobby"], ["3", "Cy"]]
    assert merge.union_by(a, b, merge.on("id")).to_rows() == [["1", "Alice"], ["2", "Bob"], ["3", "Cy"]]
    got = {r.key: (r.change, r.fields) for r in merge.diff(a, b, merge.on("id")).collect()}
    assert got == {"1": ("removed", []), "2": ("modified", ["name"]), "3": ("added", [])}
    assert merge.intersect(a, b.select("id", "name")).count() == 0
    assert merge.except_(a, a.limit(1)).to_rows() == [["2", "Bob"]]


def test_validation(spark):
    q = Query.from_rows(spark, [["1", "a@b.c", "30", "admin"], ["2", "bad", "-5", "user"], ["3", "c@d.e", "200", "hacker"], ["4", "e@f.g", "20", "user"], ["", "", "50", "user"]], ["id", "email", "age", "role"])
    schema = V.Schema().column("id", V.required(), V.integer()).column("email", V.regex(r"^[^@]+@[^@]+\.\w+$")).column("age", V.in_range(0, 150)).column("role", V.one_of("admin", "user"))
    found = schema.validate_list(q)
    assert [(e.row, e.field, e.rule) for e in found] == [(1, "email", "regex"), (1, "age", "range"), (2, "age", "range"), (2, "role", "oneof"), (4, "id", "required")]
    with pytest.raises(ValidationError):
        schema.validate_or_raise(q)
    lengths = Query.from_rows(spark, [["ab"], ["abcdefg"], ["abcdefghijk"], [""]], ["name"])
    assert [e.row for e in V.Schema().column("name", V.min_len(3), V.max_len(10)).validate_list(lengths)] == [0, 2, 3]
    custom = V.Schema().column("name", V.custom("even", lambda v: "odd" if len(v) % 2 else None))
    assert [(e.row, e.error) for e in custom.validate_list(lengths)] == [(1, "odd"), (2, "odd")]
    parsed = V.Schema.from_json('{"columns": [{"name": "age", "type": "int", "min": 0, "max": 100, "required": true}]}')
    assert [(e.row, e.rule) for e in parsed.validate_list(q)] == [(1, "range"), (2, "range")]
    assert V.date_pattern("2006-01-02T15:04:05") == "yyyy-MM-dd'T'HH:mm:ss"


def test_stats_and_inference(spark):
    q = Query.from_rows(spark, [["1", "1.5", "true", "2024-01-02", "x", ""], ["2", "2", "FALSE", "2024-02-03", "", ""]], ["i", "f", "b", "d", "s", "e"])
    assert [tuple(r) for r in infer.stats(q).collect()] == [("i", "int", 2, 0, 2), ("f", "float", 2, 0, 2), ("b", "bool", 2, 0, 2), ("d", "string", 2, 0, 2), ("s", "string", 2, 1, 1), ("e", "int", 2, 2, 0)]
    assert infer.infer_types(q) == {"i": "int", "f": "float", "b": "bool", "d": "date", "s": "string", "e": "string"}
    assert "i: int" in infer.generate(q) and "d: datetime" in infer.generate(q)


NUMBERS = ["1", "-1.5", "+.5", "1.", "1e3", "1e400", "1e-400", "inf", "-Infinity", "NaN", "+nan", "0x1p-2", "0x10", " 1", "1 ", "1d", "1f", "1_000", "", "abc", "12\n", ".", "e5", "--1"]


def test_numbers_agree_with_the_plain_rule(spark):
    df = spark.createDataFrame([(s,) for s in NUMBERS], "s string")
    got = [r[0] for r in df.select(S.num(F.col("s"))).collect()]
    want = [S.py_num(s) for s in NUMBERS]
    assert [g if g is None or not math.isnan(g) else "nan" for g in got] == [w if w is None or not math.isnan(w) else "nan" for w in want]
    assert want[:7] == [1.0, -1.5, 0.5, 1.0, 1000.0, None, 0.0]


def test_floats_render_without_exponents(spark):
    values = [1.0, 1.5, -2.25, 12345678.5, 1e-7, 1e22, 1.2345e-5, 123456789012.0, 0.1, -1e-10, 1.0e7, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(S.fmt_float(F.col("v"))).collect()] == [S.py_float(v) for v in values]


def test_typed_columns_compare_as_numbers_and_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 1.5d AS v").write.parquet(path)
    q = sql.run(Query.from_df(spark.read.parquet(path)), "SELECT id FROM t WHERE v >= 30.0 AND id = 25")
    assert q.to_rows() == [["25"]]
    plan = q.df._jdf.queryExecution().optimizedPlan().toString()
    assert "(v#" in plan and ">= 30.0)" in plan and "= 25)" in plan and "cast(" not in plan
    assert "GreaterThanOrEqual(v,30.0)" in q.df._jdf.queryExecution().executedPlan().toString()
