"""The engine's operators as named queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark import streaming
from tabspark.functions import semantics as S
from tabspark.operators import infer, merge, records
from tabspark.operators import validate as V
from tabspark.operators.query import Query
from tabspark.plans import sql
from tabspark.sources import jsonx, text
from tabspark.sources.text import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    """Registers a query under its function's name."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, order: str | None = None) -> Query:
    """order: the key that gives the stored order, where the order of rows counts."""
    return Query.from_df(spark.read.parquet(f"{sf_dir}/{name}.parquet"), [order] if order else None)


def folder(spark: SparkSession) -> str:
    """A new folder for files that are written and read again, where the cluster shares one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base.rstrip('/')}/tabspark-files-{uuid.uuid4().hex}"
    return "file://" + tempfile.mkdtemp(prefix="tabspark-files-")


# projections


@query("SELECT c_mktsegment, c_name FROM customer")
def select_cols(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", "c_name").to_df()


@query("SELECT o_orderkey AS k, o_custkey FROM orders")
def select_rename(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").rename("o_orderkey", "k").to_df()


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def sql_projection_alias(spark, d):
    return sql.run(table(spark, d, "orders"), "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders").to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def with_column(spark, d):
    q = table(spark, d, "lineitem").with_column("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "net").to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, lower(n_name) AS n_name, '' AS n_regionkey FROM nation")
def map_rows(spark, d):
    return table(spark, d, "nation").map(lambda r: [r["n_nationkey"], r["n_name"].lower()]).to_df()


# filters


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30")
def where_num(spark, d):
    return sql.run(table(spark, d, "lineitem"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30").to_df()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_eq(spark, d):
    return table(spark, d, "customer").where_eq("c_mktsegment", "BUILDING").select("c_custkey").to_df()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_in(spark, d):
    return table(spark, d, "customer").where_in("c_mktsegment", "BUILDING", "MACHINERY").select("c_custkey").to_df()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> ''")
def where_not_empty(spark, d):
    return table(spark, d, "customer").where_not_empty("c_mktsegment").select("c_custkey").to_df()


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def where_not(spark, d):
    return table(spark, d, "orders").where_not(F.col("o_orderstatus") == "F").select("o_orderkey").to_df()


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000")
def where_lambda(spark, d):
    return table(spark, d, "supplier").where(lambda r: r.float("s_acctbal") > 1000).select("s_suppkey").to_df()


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%d _idget%'")
def sql_like(spark, d):
    return sql.run(table(spark, d, "part"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%d _idget%'").to_df()


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT o_totalprice < 100000 AND o_orderpriority <> '5-LOW'")
def sql_bool_expr(spark, d):
    return sql.run(table(spark, d, "orders"), "SELECT o_orderkey FROM t WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT o_totalprice < 100000 AND o_orderpriority <> '5-LOW'").to_df()


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, 'y' AS seen FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey WHERE trim(coalesce(seen, '')) = ''")
def sql_is_null(spark, d):
    seen = table(spark, d, "orders").where_eq("o_orderpriority", "1-URGENT").distinct("o_custkey").select("o_custkey").rename("o_custkey", "c_custkey").with_column("seen", F.lit("y"))
    both = merge.left_join(table(spark, d, "customer"), seen, merge.on("c_custkey"))
    return sql.run(both, "SELECT c_custkey FROM t WHERE seen IS NULL").to_df()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) = '7' OR o_custkey <= 5")
def sql_text_eq_vs_num_cmp(spark, d):
    return sql.run(table(spark, d, "orders").as_text(), "SELECT o_orderkey FROM t WHERE o_custkey = '7' OR o_custkey = '7.0' OR o_custkey <= 5.0").to_df()


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'ECON') AND starts_with(p_brand, 'Brand#1') OR regexp_matches(p_name, '^[a-l]+ ')")
def filter_text(spark, d):
    hit = F.col("p_type").contains("ECON") & F.col("p_brand").startswith("Brand#1") | F.col("p_name").rlike("^[a-l]+ ")
    return table(spark, d, "part").where(hit).select("p_partkey").to_df()


# joins


def _named(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name").rename("c_custkey", "custkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey").rename("o_custkey", "custkey")
    return customers, orders


_JOIN = "SELECT {key} AS custkey, coalesce(c_name, '') AS c_name, o_orderkey FROM customer {how} JOIN orders ON c_custkey = o_custkey"


@query(_JOIN.format(key="c_custkey", how="INNER"))
def inner_join(spark, d):
    return merge.inner_join(*_named(spark, d), merge.on("custkey")).to_df()


@query(_JOIN.format(key="c_custkey", how="LEFT"))
def left_join(spark, d):
    return merge.left_join(*_named(spark, d), merge.on("custkey")).to_df()


@query(_JOIN.format(key="o_custkey", how="RIGHT"))
def right_join(spark, d):
    return merge.right_join(*_named(spark, d), merge.on("custkey")).to_df()


@query(_JOIN.format(key="coalesce(c_custkey, o_custkey)", how="FULL"))
def full_join(spark, d):
    return merge.full_join(*_named(spark, d), merge.on("custkey")).to_df()


@query(
    "WITH c AS (SELECT c_nationkey AS k, c_acctbal > 0 AS pos, count(*) AS customers FROM customer GROUP BY 1, 2), s AS (SELECT s_nationkey AS k, s_acctbal > 0 AS pos, count(*) AS suppliers FROM supplier GROUP BY 1, 2) "
    "SELECT c.k, c.pos, customers, suppliers FROM c JOIN s ON c.k = s.k AND c.pos = s.pos"
)
def join_composite(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("k"), (F.col("c_acctbal") > 0).alias("pos")).agg(F.count(F.lit(1)).alias("customers"))
    s = spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("k"), (F.col("s_acctbal") > 0).alias("pos")).agg(F.count(F.lit(1)).alias("suppliers"))
    return merge.inner_join(Query.from_df(c, ["k"]), Query.from_df(s, ["k"]), merge.on_all("k", "pos")).to_df()


@query(
    "SELECT a.p_partkey, coalesce(nullif(CASE WHEN a.p_partkey % 2 = 0 THEN a.p_name ELSE '' END, ''), b.p_name, '') AS p_name, b.p_size FROM part a JOIN part b ON a.p_partkey = b.p_partkey"
)
def join_coalesce_shared(spark, d):
    part = table(spark, d, "part")
    half = part.with_column("p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("")).select("p_partkey", "p_name")
    return merge.inner_join(half, part.select("p_partkey", "p_name", "p_size"), merge.on("p_partkey")).to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    orders = table(spark, d, "orders").select("o_custkey").rename("o_custkey", "c_custkey")
    return merge.semi_join(table(spark, d, "customer").select("c_custkey"), orders, merge.on("c_custkey")).to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    orders = table(spark, d, "orders").where_eq("o_orderpriority", "1-URGENT").select("o_custkey").rename("o_custkey", "c_custkey")
    return merge.anti_join(table(spark, d, "customer").select("c_custkey"), orders, merge.on("c_custkey")).to_df()


# aggregates


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 4) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem")
def agg_global(spark, d):
    q = table(spark, d, "lineitem")
    out = q.aggregate(n=("count", "*"), total=("sum", "l_extendedprice"), mean=("avg", "l_quantity"), low=("min", "l_discount"), high=("max", "l_tax"))
    return out.select("n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "low", "high")


_DIRTY = "CASE WHEN event_id % 5 = 0 THEN 'word' WHEN event_id % 7 = 0 THEN '' ELSE json_extract_string(props, '$.k') END"


@query(f"SELECT coalesce(sum(TRY_CAST({_DIRTY} AS DOUBLE)), 0) AS s, coalesce(min(TRY_CAST({_DIRTY} AS DOUBLE)), 0) AS lo, coalesce(max(TRY_CAST({_DIRTY} AS DOUBLE)), 0) AS hi, 0.0::DOUBLE AS none FROM events")
def agg_skip_unparsable(spark, d):
    return _dirty(spark, d).aggregate(s=("sum", "v"), lo=("min", "v"), hi=("max", "v"), none=("sum", "absent"))


def _dirty(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").with_column("v", F.when(F.col("event_id") % 5 == 0, "word").when(F.col("event_id") % 7 == 0, "").otherwise(k))


@query(f"SELECT count(nullif({_DIRTY}, '')) AS n, count(*) AS rows FROM events")
def count_nonempty(spark, d):
    return _dirty(spark, d).aggregate(n=("count", "v"), rows=("count", "*"))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def count_by(spark, d):
    return table(spark, d, "orders").count_by_df("o_orderpriority")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_multi(spark, d):
    out = sql.run(table(spark, d, "lineitem"), "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, COUNT(*) AS n FROM t GROUP BY l_returnflag, l_linestatus").to_df()
    return out.withColumn("q", F.round("q", 2))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY 1")
def group_first_row(spark, d):
    q = table(spark, d, "orders", "o_orderkey")
    return sql.run(q, "SELECT o_custkey, o_totalprice AS first_price, o_orderstatus AS first_status FROM t GROUP BY o_custkey").to_df()


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), (o_orderstatus), ())")
def group_cube(spark, d):
    return table(spark, d, "orders").to_df().cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders")
def reduce_fold(spark, d):
    total = table(spark, d, "orders", "o_orderkey").reduce(0.0, lambda a, r: a + r.float("o_orderkey"))
    return spark.createDataFrame([(total,)], "total double")


def _kind(c: str) -> str:
    """SQL for the type of a column's texts."""
    t = f"nullif(CAST({c} AS VARCHAR), '')"
    tests = (("int", f"regexp_full_match({t}, '[+-]?[0-9]+') AND TRY_CAST({t} AS BIGINT) IS NOT NULL"), ("float", f"TRY_CAST({t} AS DOUBLE) IS NOT NULL"), ("bool", f"lower({t}) IN ('true', 'false')"))
    return "CASE " + " ".join(f"WHEN coalesce(bool_and({test}) FILTER ({t} IS NOT NULL), true) THEN '{kind}'" for kind, test in tests) + " ELSE 'string' END"


_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_kind(c)} AS \"type\", count(*) AS rows, count(*) FILTER (coalesce(CAST({c} AS VARCHAR), '') = '') AS empty, count(DISTINCT nullif(CAST({c} AS VARCHAR), '')) AS \"distinct\" FROM part"
        for c in _PART
    )
)
def col_stats(spark, d):
    return infer.stats(table(spark, d, "part"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, {_kind(c)} AS kind FROM part" for c in _PART))
def infer_types(spark, d):
    kinds = infer.infer_types(table(spark, d, "part").as_text(), None)
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


# order, limits, duplicates


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit(spark, d):
    return table(spark, d, "orders", "o_orderkey").order_by("o_totalprice", descending=True).limit(10).select("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey, o_orderpriority LIMIT 20")
def sql_order_two_keys(spark, d):
    return sql.run(table(spark, d, "orders"), "SELECT o_orderkey, o_orderpriority FROM t ORDER BY o_orderpriority, o_orderkey LIMIT 20").to_df()


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20")
def sql_order_standard(spark, d):
    return sql.run(table(spark, d, "orders"), "SELECT o_orderkey, o_orderpriority FROM t ORDER BY o_orderpriority, o_orderkey LIMIT 20", standard_order=True).to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def skip_limit(spark, d):
    return table(spark, d, "orders", "o_orderkey").skip(100).limit(50).select("o_orderkey").to_df()


@query("SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def distinct_cols(spark, d):
    return table(spark, d, "part", "p_partkey").distinct("p_brand", "p_type").select("p_brand", "p_type").to_df()


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def distinct_first(spark, d):
    return table(spark, d, "part", "p_partkey").distinct("p_brand").select("p_brand", "p_partkey").to_df()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().to_df()


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def tail_rows(spark, d):
    return table(spark, d, "events", "event_id").tail(10).select("event_id", "event_type").to_df()


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 3")
def reverse_first(spark, d):
    return table(spark, d, "events", "event_id").reverse().limit(3).select("event_id").to_df()


# set operations and diff


def _halves(spark, d):
    q = table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = q.where(F.col("o_orderkey") % 3 < 2)
    b = q.where(F.col("o_orderkey") % 3 > 0).with_column("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(0.0))
    return a, b.select("o_totalprice", "o_orderstatus", "o_orderkey")


_HALVES = "WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 < 2), b AS (SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS o_totalprice FROM orders WHERE o_orderkey % 3 > 0) "


@query(_HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b")
def concat(spark, d):
    return merge.concat(*_halves(spark, d)).to_df()


@query(_HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def union_by(spark, d):
    return merge.union_by(*_halves(spark, d), merge.on("o_orderkey")).to_df()


def _diff(spark, d, change: str) -> DataFrame:
    return merge.diff(*_halves(spark, d), merge.on("o_orderkey")).where(F.col("change") == change)


@query(_HALVES + "SELECT CAST(o_orderkey AS VARCHAR) AS key FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def diff_added(spark, d):
    return _diff(spark, d, "added").select("key")


@query(_HALVES + "SELECT CAST(o_orderkey AS VARCHAR) AS key FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def diff_removed(spark, d):
    return _diff(spark, d, "removed").select("key")


@query(_HALVES + "SELECT CAST(a.o_orderkey AS VARCHAR) AS key, 'o_totalprice' AS fields FROM a JOIN b USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice")
def diff_modified(spark, d):
    return _diff(spark, d, "modified").select("key", F.array_join("fields", ",").alias("fields"))


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    c, s = table(spark, d, "customer").select("c_nationkey").rename("c_nationkey", "nationkey"), table(spark, d, "supplier").select("s_nationkey").rename("s_nationkey", "nationkey")
    return merge.intersect(c, s).to_df()


# validation


@query(
    "SELECT 'required' AS rule, count(*) AS n FROM customer WHERE trim(c_name) = '' HAVING count(*) > 0 UNION ALL SELECT 'range', count(*) FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000 "
    "UNION ALL SELECT 'oneof', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'regex', count(*) FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') "
    "UNION ALL SELECT 'maxlen', count(*) FROM customer WHERE length(c_mktsegment) > 8"
)
def validate_rules(spark, d):
    schema = V.Schema().column("c_name", V.required(), V.regex("[02468]$")).column("c_acctbal", V.floating(), V.in_range(0, 5000)).column("c_mktsegment", V.one_of("BUILDING", "MACHINERY"), V.max_len(8))
    return schema.validate(table(spark, d, "customer")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# files


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def json_roundtrip(spark, d):
    path = f"{folder(spark)}/nation"
    jsonx.to_ndjson(table(spark, d, "nation"), path)
    return jsonx.from_ndjson(spark, path).select("n_nationkey", "n_name", "n_regionkey").to_df()


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_roundtrip(spark, d):
    path = f"{folder(spark)}/documents"
    text.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), path, header=False)
    q = text.open_csv(spark, f"{path}/part-*", Options(delimiter=",", header=False))
    return q.rename("column1", "doc_id").rename("column2", "text").rename("column3", "lang").to_df()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def csv_native_scan(spark, d):
    path = f"{folder(spark)}/orders"
    text.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, header=False)
    q = text.open_csv(spark, path, Options(delimiter=",", header=False), native=True)
    return q.rename("column1", "o_orderkey").rename("column2", "o_orderpriority").to_df()


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, reader FROM lineitem, (VALUES ('strict'), ('native')) t(reader)")
def csv_header_parts(spark, d):
    path = f"{folder(spark)}/lineitem"
    text.write_csv(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), path)
    both = [text.open_csv(spark, path, Options(header=True), native=native).to_df().withColumn("reader", F.lit(name)) for name, native in (("strict", False), ("native", True))]
    return both[0].unionByName(both[1])


@query("SELECT CASE WHEN r_regionkey % 2 = 0 THEN concat(r_name, chr(10), 'x') ELSE r_name END AS r_name FROM region UNION ALL SELECT p_name FROM part")
def csv_late_line_end(spark, d):
    """Quoted line ends behind the first bytes of a file, read natively."""
    path = f"{folder(spark)}/late"
    parts = table(spark, d, "part", "p_partkey").select("p_name").rename("p_name", "r_name")
    regions = table(spark, d, "region", "r_regionkey").with_column("r_name", F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit("\nx"))).otherwise(F.col("r_name"))).select("r_name")
    text.write_csv(merge.concat(parts, regions), path)
    return text.open_csv(spark, path, Options(delimiter=",", header=True), native=True).to_df()


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_rows(spark, d):
    c, s = table(spark, d, "customer").select("c_nationkey").rename("c_nationkey", "nationkey"), table(spark, d, "supplier").where(F.col("s_acctbal") > 5000).select("s_nationkey").rename("s_nationkey", "nationkey")
    return merge.except_(c, s).to_df()


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'F'")
def sql_agg_global(spark, d):
    out = sql.run(table(spark, d, "orders"), "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, MAX(o_totalprice) AS high FROM t WHERE o_orderstatus = 'F'").to_df()
    return out.withColumn("total", F.round("total", 2))


@query("SELECT c_custkey FROM customer WHERE c_name < 'Customer#5' AND c_acctbal >= 100")
def filter_text_order(spark, d):
    from tabspark.cli import filter_rows

    return filter_rows(filter_rows(table(spark, d, "customer"), "c_name < Customer#5"), "c_acctbal >= 100").select("c_custkey").to_df()


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def gzip_roundtrip(spark, d):
    path = f"{folder(spark)}/region.csv.gz"
    text.save_csv(table(spark, d, "region"), path)
    return text.open_csv(spark, path, Options(header=True)).to_df()


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def sheet_roundtrip(spark, d):
    from tabspark.sources import sheets

    path = f"{folder(spark)}/region.xlsx"
    sheets.write_sheet(table(spark, d, "region"), path)
    return sheets.read_sheet(spark, path).to_df()


# typed records


@dataclass
class _Part:
    p_partkey: int = 0
    words: list[str] = field(default_factory=list, metadata={"csv": records.Field(name="p_name", sep=" ")})


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[1] AS first FROM part")
def records_array(spark, d):
    return records.decode(table(spark, d, "part"), _Part).select("p_partkey", F.size("words").cast("long").alias("n"), F.get("words", F.lit(0)).alias("first"))


@dataclass
class _Money:
    acctbal: float = 0.0
    mktsegment: str = ""


@dataclass
class _Customer:
    c_custkey: int = 0
    money: _Money = field(default_factory=_Money, metadata={"csv": records.Field(prefix="c_")})
    rest: dict[str, str] = field(default_factory=dict, metadata={"csv": records.Field(rest=True)})


@query("SELECT c_custkey, c_acctbal AS bal, c_mktsegment AS seg FROM customer")
def records_flatten(spark, d):
    return records.decode(table(spark, d, "customer"), _Customer).select("c_custkey", F.col("money.acctbal").alias("bal"), F.col("money.mktsegment").alias("seg"))


@query("SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def records_rest(spark, d):
    return records.decode(table(spark, d, "customer"), _Customer).select("c_custkey", F.element_at("rest", "c_name").alias("name"), F.element_at("rest", "c_nationkey").alias("nation"))


@dataclass
class _Key:
    k: int = 0


@dataclass
class _Event:
    event_id: int = 0
    props: _Key = field(default_factory=_Key, metadata={"csv": records.Field(json=True)})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_cell(spark, d):
    return records.decode(table(spark, d, "events"), _Event).select("event_id", F.col("props.k").alias("k"))


def _layout(c: Column, key: str) -> Column:
    return F.expr(f"CASE {key} % 4 WHEN 0 THEN date_format({c}, 'yyyy-MM-dd') WHEN 1 THEN date_format({c}, 'dd/MM/yyyy') WHEN 2 THEN date_format({c}, 'yyyy/MM/dd') ELSE 'nonsense' END")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN date_trunc('day', o_orderdate) END AS day FROM orders")
def date_parse(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", _layout("o_orderdate", "o_orderkey").alias("t"))
    return df.select("o_orderkey", S.parse_date(F.col("t")).cast("timestamp_ntz").alias("day"))


@query("SELECT CASE WHEN c = 0 THEN 'int' WHEN c = 1 THEN 'float' WHEN c = 2 THEN 'bool' WHEN c = 3 THEN 'date' WHEN c = 4 THEN 'empty' ELSE 'string' END AS kind, count(*) AS n FROM (SELECT event_id % 6 AS c FROM events) GROUP BY 1")
def cell_types(spark, d):
    c = F.expr("CASE event_id % 6 WHEN 0 THEN cast(event_id as string) WHEN 1 THEN concat(event_id, '.5') WHEN 2 THEN 'True' WHEN 3 THEN '2024-02-03' WHEN 4 THEN '' ELSE 'x y' END")
    df = spark.read.parquet(f"{d}/events.parquet").select(c.alias("c"))
    return df.select(S.cell_type(F.col("c")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS \"B\", CAST(n_regionkey AS VARCHAR) AS \"C\" FROM nation WHERE n_nationkey BETWEEN 4 AND 8")
def range_slice(spark, d):
    from tabspark.operators.cells import Table

    t = Table.from_query(table(spark, d, "nation", "n_nationkey"))
    return spark.createDataFrame(t.range("B6:C10").values(), "B string, C string")


# streams


@query("SELECT 'oneof' AS rule, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'")
def stream_validate(spark, d):
    base = folder(spark)
    text.write_csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), f"{base}/in", header=False)
    stream = streaming.read_csv_stream(spark, f"{base}/in", ["c_custkey", "c_mktsegment"], header=False)
    found = streaming.validate_stream(stream, V.Schema().column("c_custkey", V.integer()).column("c_mktsegment", V.one_of("BUILDING")))
    run = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    out = streaming.tumbling(spark.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), v=F.sum("value"))
    return out.withColumn("v", F.round("v", 2)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) "
    "SELECT user_id, count(*) AS n, min(ts) AS session_start FROM g GROUP BY user_id, k"
)
def window_sessions(spark, d):
    out = streaming.sessions(spark.read.parquet(f"{d}/events.parquet"), "ts", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
    return out.select("user_id", "n", F.col("session_start").cast("timestamp_ntz").alias("session_start"))


# the flagship: revenue by nation


@query(
    "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10"
)
def revenue_by_nation(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice").rename("o_custkey", "custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").rename("c_custkey", "custkey").rename("c_nationkey", "nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name").rename("n_nationkey", "nationkey")
    both = merge.inner_join(merge.inner_join(orders, customers, merge.on("custkey")), nations, merge.on("nationkey"))
    out = sql.run(both, "SELECT n_name, COUNT(*) AS orders, SUM(o_totalprice) AS revenue FROM t GROUP BY n_name ORDER BY n_name, revenue DESC LIMIT 10").to_df()
    return out.withColumn("revenue", F.round("revenue", 2))
