"""The engine's query set: each query beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .operators import aggregate, cross_product, except_rows, filter_rows, grouping_sets, hash_join, intersect_rows, mark_join, project, range_join, running_sum, sample_rows, single_join, top_k, union_rows, window
from .sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def rows() -> Column:
    """count(*)"""
    return F.count(F.lit(1))


def query(sql: str, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key], SQL[key] = f, sql
        return f

    return add


# Scans, projections and filters


@query("SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem")
def scan_project(spark, d):
    return scan(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 10 AND l_discount <= 0.05")
def filter_conj(spark, d):
    return filter_rows(scan(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_discount"), c("l_quantity") > 10, c("l_discount") <= 0.05)


@query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber > 3")
def filter_greater_int(spark, d):
    return aggregate(filter_rows(scan(spark, d, "lineitem", "l_linenumber"), c("l_linenumber") > 3), n=rows())


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size_class,
          coalesce(nullif(o_orderstatus, 'F'), 'closed') AS status FROM orders
          WHERE (o_orderstatus IN ('F', 'O') OR o_totalprice BETWEEN 1000 AND 50000) AND NOT o_orderpriority LIKE '5%' AND o_custkey IS NOT NULL AND o_orderstatus IS DISTINCT FROM 'P'""")
def filter_or_case(spark, d):
    o = scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o = filter_rows(o, c("o_orderstatus").isin("F", "O") | c("o_totalprice").between(1000, 50000), ~c("o_orderpriority").like("5%"), c("o_custkey").isNotNull(), ~c("o_orderstatus").eqNullSafe("P"))
    size = F.when(c("o_totalprice") > 200000, "big").when(c("o_totalprice") > 100000, "mid").otherwise("small")
    return project(o, o_orderkey="o_orderkey", size_class=size, status=F.coalesce(F.nullif(c("o_orderstatus"), F.lit("F")), F.lit("closed")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(y * 2 + 1, 6) AS z FROM (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem) q")
def proj_chain(spark, d):
    q = project(scan(spark, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_partkey="l_partkey", l_suppkey="l_suppkey", y=fn.multiply("l_extendedprice", 1 - c("l_discount")))
    return project(q, l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_partkey="l_partkey", l_suppkey="l_suppkey", z=F.round(c("y") * 2 + 1, 6))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sin(l_extendedprice) + cos(l_quantity) + sqrt(l_tax) + ln(abs(l_extendedprice) + 1) + exp(l_extendedprice / 100000), 9) AS v FROM lineitem""")
def proj_heavy_math(spark, d):
    p = c("l_extendedprice")
    v = fn.sin(p) + fn.cos("l_quantity") + fn.sqrt("l_tax") + fn.ln(fn.absolute(p) + 1) + fn.exp(fn.divide(p, F.lit(100000.0)))
    return project(scan(spark, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_partkey="l_partkey", l_suppkey="l_suppkey", v=F.round(v, 9))


@query("SELECT l_quantity * l_tax AS a, l_quantity + l_discount AS b, sqrt(l_extendedprice) AS r, l_quantity - l_tax AS s FROM lineitem")
def proj_wide(spark, d):
    li = scan(spark, d, "lineitem", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    return project(li, a=fn.multiply("l_quantity", "l_tax"), b=fn.add("l_quantity", "l_discount"), r=fn.sqrt("l_extendedprice"), s=fn.subtract("l_quantity", "l_tax"))


@query("SELECT count(*) AS n, CAST(sum(one) AS BIGINT) AS s FROM (SELECT 1 AS one FROM lineitem) q")
def const_proj(spark, d):
    return aggregate(project(scan(spark, d, "lineitem"), one=F.lit(1)), n=rows(), s=F.sum("one"))


@query("SELECT count(*) AS n FROM (SELECT 1 AS one FROM lineitem LIMIT 10) q")
def const_proj_limit(spark, d):
    return aggregate(project(scan(spark, d, "lineitem"), one=F.lit(1)).limit(10), n=rows())


@query("SELECT count(*) AS n, round(sum(x), 2) AS s FROM (SELECT l_quantity * 1.5 AS x FROM lineitem WHERE l_linenumber > 3) q")
def filter_project_agg(spark, d):
    li = filter_rows(scan(spark, d, "lineitem", "l_quantity", "l_linenumber"), c("l_linenumber") > 3)
    return aggregate(project(li, x=c("l_quantity") * 1.5), n=rows(), s=F.round(F.sum("x"), 2))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > l_linenumber AS gt, l_quantity = 10 AS eq, l_discount <> 0.05 AS ne, l_tax <= l_discount AS le FROM lineitem")
def fn_compare(spark, d):
    keys = {k: k for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}
    return project(scan(spark, d, "lineitem"), keys, gt=fn.compare(">", "l_quantity", "l_linenumber"), eq=fn.compare("=", "l_quantity", F.lit(10)), ne=fn.compare("<>", "l_discount", F.lit(0.05)), le=fn.compare("<=", "l_tax", "l_discount"))


# Scalar functions: one query each, over part (a unique key and a double).  Ulp-level noise is rounded on both sides.

_X, _Q = "p_retailprice", "p_size"
_FUNCTIONS: dict[str, tuple[str, Callable[[], Column]]] = {
    "add": ("p_retailprice + p_size", lambda: fn.add(_X, _Q)),
    "subtract": ("p_retailprice - p_size", lambda: fn.subtract(_X, _Q)),
    "multiply": ("p_retailprice * p_size", lambda: fn.multiply(_X, _Q)),
    "divide": ("p_retailprice / p_size", lambda: fn.divide(_X, _Q)),
    "divide_by_zero": ("p_retailprice / (p_size - p_size)::DOUBLE", lambda: fn.divide(_X, (c(_Q) - c(_Q)).cast("double"))),
    "negate": ("-p_retailprice", lambda: fn.negate(_X)),
    "modulo_int": ("p_size % 7", lambda: fn.modulo(_Q, F.lit(7))),
    "modulo_double": ("round(p_retailprice % 7.5::DOUBLE, 6)", lambda: F.round(fn.modulo(_X, F.lit(7.5), floating=True), 6)),
    "abs": ("abs(p_size - 25)", lambda: fn.absolute(c(_Q) - 25)),
    "sqrt": ("sqrt(p_retailprice)", lambda: fn.sqrt(_X)),
    "exp": ("round(exp(p_size / 10.0::DOUBLE), 6)", lambda: F.round(fn.exp(fn.divide(_Q, F.lit(10.0))), 6)),
    "ln": ("round(ln(p_retailprice), 9)", lambda: F.round(fn.ln(_X), 9)),
    "log10": ("round(log10(p_retailprice), 9)", lambda: F.round(fn.log10(_X), 9)),
    "log": ("round(log(p_retailprice), 9)", lambda: F.round(fn.log(_X), 9)),
    "log2": ("round(log2(p_retailprice), 9)", lambda: F.round(fn.log2(_X), 9)),
    "sin": ("round(sin(p_retailprice), 9)", lambda: F.round(fn.sin(_X), 9)),
    "cos": ("round(cos(p_retailprice), 9)", lambda: F.round(fn.cos(_X), 9)),
    "tan": ("round(tan(p_size / 40.0::DOUBLE), 9)", lambda: F.round(fn.tan(fn.divide(_Q, F.lit(40.0))), 9)),
    "asin": ("round(asin(p_size / 60.0::DOUBLE), 9)", lambda: F.round(fn.asin(fn.divide(_Q, F.lit(60.0))), 9)),
    "acos": ("round(acos(p_size / 60.0::DOUBLE), 9)", lambda: F.round(fn.acos(fn.divide(_Q, F.lit(60.0))), 9)),
    "atan": ("round(atan(p_retailprice), 9)", lambda: F.round(fn.atan(_X), 9)),
    "atan2": ("round(atan2(p_retailprice, p_size), 9)", lambda: F.round(fn.atan2(_X, _Q), 9)),
    "floor": ("floor(p_retailprice)::DOUBLE", lambda: fn.floor(_X)),
    "ceil": ("ceil(p_retailprice)::DOUBLE", lambda: fn.ceil(_X)),
    "radians": ("radians(p_retailprice)", lambda: fn.radians(_X)),
    "degrees": ("degrees(p_retailprice)", lambda: fn.degrees(_X)),
    "pow": ("round(pow(p_retailprice, 0.75), 6)", lambda: F.round(fn.power(_X, F.lit(0.75)), 6)),
    "relaxed": ("round(sin(p_retailprice::FLOAT::DOUBLE), 4)", lambda: F.round(fn.relaxed(fn.sin, _X), 4)),
    "cast_widen": ("p_size::DOUBLE", lambda: fn.cast(_Q, "double")),
    "cast_bigint": ("p_size::BIGINT", lambda: fn.cast(_Q, "bigint")),
    "cast_narrow": ("p_size::SMALLINT", lambda: fn.cast(_Q, "smallint", "int")),
    "cast_float": ("p_size::FLOAT", lambda: fn.cast(_Q, "float")),
    "cast_bool": ("(p_size % 2)::BOOLEAN", lambda: fn.cast(c(_Q) % 2, "boolean")),
    "cast_round": ("((p_size + 0.5::DOUBLE))::INTEGER", lambda: fn.cast(c(_Q) + F.lit(0.5), "int", "double")),
    "strings": ("upper(substr(p_name, 1, 5)) || '-' || lower(p_brand) || length(p_type)", lambda: F.concat(F.upper(F.substring("p_name", 1, 5)), F.lit("-"), F.lower("p_brand"), F.length("p_type").cast("string"))),
    "regex": ("regexp_replace(p_type, '[aeiouAEIOU]', '*', 'g')", lambda: F.regexp_replace("p_type", "[aeiouAEIOU]", "*")),
    "bitwise": ("(p_size & 12) | 1", lambda: c(_Q).bitwiseAND(F.lit(12)).bitwiseOR(F.lit(1))),
    "greatest": ("greatest(p_size, 20) - least(p_size, 10)", lambda: F.greatest(c(_Q), F.lit(20)) - F.least(c(_Q), F.lit(10))),
    "sign": ("sign(p_size - 25)::INTEGER", lambda: F.signum(c(_Q) - 25).cast("int")),
    "cbrt": ("round(cbrt(p_retailprice), 9)", lambda: F.round(F.cbrt(_X), 9)),
}


def _scalar(name: str, sql: str, column) -> None:
    @query(f"SELECT p_partkey, {sql} AS v FROM part", name=f"fn_{name}")
    def run(spark, d):
        return project(scan(spark, d, "part"), p_partkey="p_partkey", v=column())


for _name, (_sql, _column) in _FUNCTIONS.items():
    _scalar(_name, _sql, _column)


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS first FROM orders")
def fn_dates(spark, d):
    return project(scan(spark, d, "orders"), o_orderkey="o_orderkey", y=F.year("o_orderdate"), m=F.month("o_orderdate"), first=F.date_trunc("month", c("o_orderdate")))


@query("SELECT event_id, length(props)::BIGINT AS n, event_type || ':' || user_id AS tag FROM events")
def fn_event_tags(spark, d):
    return project(scan(spark, d, "events"), event_id="event_id", n=F.length("props").cast("long"), tag=F.concat("event_type", F.lit(":"), c("user_id").cast("string")))


# Aggregates


@query("SELECT count(*) AS n, count(l_tax) AS n_tax, min(l_linenumber) AS lo, max(l_partkey) AS hi, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem")
def agg_global(spark, d):
    return aggregate(scan(spark, d, "lineitem"), n=rows(), n_tax=F.count("l_tax"), lo=F.min("l_linenumber"), hi=F.max("l_partkey"), q=F.round(F.sum("l_quantity"), 2), p=F.round(F.avg("l_extendedprice"), 4))


@query("SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS a FROM lineitem GROUP BY l_linenumber")
def groupby_int_key(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_linenumber"], n=rows(), q=F.round(F.sum("l_quantity"), 2), a=F.round(F.avg("l_discount"), 6))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, d):
    li = filter_rows(scan(spark, d, "lineitem"), c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return aggregate(li, ["l_returnflag", "l_linestatus"], sum_qty=F.round(F.sum("l_quantity"), 2), sum_price=F.round(F.sum("l_extendedprice"), 2), sum_disc=F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2), avg_qty=F.round(F.avg("l_quantity"), 4), n=rows())


@query("SELECT l_linenumber, l_suppkey, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY l_linenumber, l_suppkey")
def groupby_multi_key(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_linenumber", "l_suppkey"], n=rows(), lo=F.min("l_orderkey"), hi=F.max("l_orderkey"))


@query("SELECT l_quantity > 25 AS big, count(*) AS n FROM lineitem GROUP BY 1")
def groupby_bool_key(spark, d):
    return aggregate(scan(spark, d, "lineitem"), [(c("l_quantity") > 25).alias("big")], n=rows())


@query("SELECT l_orderkey % 10 AS k, count(*) AS n, round(sum(l_tax), 2) AS t FROM lineitem GROUP BY 1")
def groupby_computed_key(spark, d):
    return aggregate(scan(spark, d, "lineitem"), [(c("l_orderkey") % 10).alias("k")], n=rows(), t=F.round(F.sum("l_tax"), 2))


@query("SELECT l_discount, count(*) AS n FROM lineitem GROUP BY l_discount")
def groupby_float_key(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_discount"], n=rows())


@query("SELECT l_linenumber::SMALLINT AS k, count(*) AS n, min(l_linenumber::SMALLINT) AS lo FROM lineitem WHERE l_quantity > 20 GROUP BY 1")
def groupby_smallint_key(spark, d):
    li = project(filter_rows(scan(spark, d, "lineitem"), c("l_quantity") > 20), k=fn.cast("l_linenumber", "smallint"))
    return aggregate(li, ["k"], n=rows(), lo=F.min("k"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey")
def groupby_high_cardinality(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_orderkey"], n=rows(), q=F.round(F.sum("l_quantity"), 2))


@query("SELECT count(*) AS g, CAST(sum(c) AS BIGINT) AS t, round(sum(s), 2) AS u FROM (SELECT l_partkey, count(*) AS c, sum(l_quantity) AS s FROM lineitem GROUP BY l_partkey) q")
def groupby_count_sum(spark, d):
    return aggregate(aggregate(scan(spark, d, "lineitem"), ["l_partkey"], c=rows(), s=F.sum("l_quantity")), g=rows(), t=F.sum("c"), u=F.round(F.sum("s"), 2))


@query("SELECT CAST(sum(mn) AS BIGINT) AS a, CAST(sum(mx) AS BIGINT) AS b FROM (SELECT l_partkey, min(l_linenumber) AS mn, max(l_linenumber) AS mx FROM lineitem GROUP BY l_partkey) q")
def groupby_min_max(spark, d):
    return aggregate(aggregate(scan(spark, d, "lineitem"), ["l_partkey"], mn=F.min("l_linenumber"), mx=F.max("l_linenumber")), a=F.sum("mn"), b=F.sum("mx"))


@query("SELECT count(*) AS n, round(max(a), 6) AS mx, round(min(a), 6) AS mn, max(c) AS mc FROM (SELECT l_suppkey, avg(l_quantity) AS a, count(*) AS c FROM lineitem GROUP BY l_suppkey) q")
def groupby_avg_count(spark, d):
    return aggregate(aggregate(scan(spark, d, "lineitem"), ["l_suppkey"], a=F.avg("l_quantity"), c=rows()), n=rows(), mx=F.round(F.max("a"), 6), mn=F.round(F.min("a"), 6), mc=F.max("c"))


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a FROM part GROUP BY p_brand")
def sum_avg_int(spark, d):
    return aggregate(scan(spark, d, "part"), ["p_brand"], s=F.sum("p_size"), a=F.avg("p_size"))


@query("SELECT CAST(sum(k + 1) AS BIGINT) AS s FROM (SELECT l_linenumber AS k FROM lineitem) q")
def sum_expression(spark, d):
    return aggregate(scan(spark, d, "lineitem", "l_linenumber"), s=F.sum(c("l_linenumber") + 1))


@query("SELECT CAST(sum(x::BIGINT) AS BIGINT) AS s, round(avg(x::DOUBLE), 6) AS a FROM (SELECT (l_quantity * 100)::DECIMAL(18, 0) AS x FROM lineitem) q")
def decimal_agg(spark, d):
    x = project(scan(spark, d, "lineitem", "l_quantity"), x=(c("l_quantity") * 100).cast("decimal(18,0)"))
    return aggregate(x, s=F.sum(c("x").cast("long")), a=F.round(F.avg(c("x").cast("double")), 6))


@query("SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
def minmax_double(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_returnflag"], lo=F.min("l_extendedprice"), hi=F.max("l_extendedprice"))


@query("SELECT round(sum(l_quantity::FLOAT::DOUBLE), 2) AS s FROM lineitem")
def sum_float(spark, d):
    return aggregate(scan(spark, d, "lineitem", "l_quantity"), s=F.round(F.sum(c("l_quantity").cast("float").cast("double")), 2))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
def groupby_empty(spark, d):
    return aggregate(filter_rows(scan(spark, d, "lineitem"), c("l_quantity") < 0), ["l_returnflag"], n=rows())


@query("SELECT count(*) AS n, sum(l_quantity) AS s, min(l_linenumber) AS lo FROM lineitem WHERE l_quantity < 0")
def agg_empty(spark, d):
    return aggregate(filter_rows(scan(spark, d, "lineitem"), c("l_quantity") < 0), n=rows(), s=F.sum("l_quantity"), lo=F.min("l_linenumber"))


@query("SELECT nullif(l_linenumber, 3) AS k, count(*) AS n, count(nullif(l_suppkey, 5)) AS m, max(nullif(l_suppkey, 100)) AS hi FROM lineitem GROUP BY 1")
def agg_nullable(spark, d):
    return aggregate(scan(spark, d, "lineitem"), [F.nullif(c("l_linenumber"), F.lit(3)).alias("k")], n=rows(), m=F.count(F.nullif(c("l_suppkey"), F.lit(5))), hi=F.max(F.nullif(c("l_suppkey"), F.lit(100))))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS nd, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sd FROM lineitem GROUP BY l_returnflag")
def distinct_agg(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_returnflag"], nd=F.countDistinct("l_suppkey"), sd=F.sum_distinct("l_linenumber"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_quantity) FILTER (WHERE l_tax > 0.04), 2) AS s FROM lineitem GROUP BY l_returnflag")
def filter_agg(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_returnflag"], n=F.expr("count(*) FILTER (WHERE l_quantity > 25)"), s=F.round(F.expr("sum(l_quantity) FILTER (WHERE l_tax > 0.04D)"), 2))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def ordered_agg(spark, d):
    return aggregate(scan(spark, d, "nation"), ["n_regionkey"], names=F.concat_ws(",", F.sort_array(F.collect_list("n_name"))))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT p_brand, round(stddev(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 4) AS vp, median(p_size)::DOUBLE AS med, round(corr(p_size, p_retailprice), 6) AS r FROM part GROUP BY p_brand")
def stats_agg(spark, d):
    return aggregate(scan(spark, d, "part"), ["p_brand"], sd=F.round(F.stddev("p_retailprice"), 6), vp=F.round(F.var_pop("p_retailprice"), 4), med=F.median("p_size"), r=F.round(F.corr("p_size", "p_retailprice"), 6))


_CN = "customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"


def _customers(spark, d):
    return hash_join(scan(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), scan(spark, d, "nation"), [("c_nationkey", "n_nationkey")])


@query(f"SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM {_CN} GROUP BY ROLLUP (n_name, c_mktsegment)")
def rollup(spark, d):
    return _customers(spark, d).rollup("n_name", "c_mktsegment").agg(rows().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("s"))


@query(f"SELECT n_regionkey, c_mktsegment, CAST(grouping(n_regionkey) AS INTEGER) AS g, count(*) AS n FROM {_CN} GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube(spark, d):
    return _customers(spark, d).cube("n_regionkey", "c_mktsegment").agg(F.grouping("n_regionkey").cast("int").alias("g"), rows().alias("n"))


@query(f"SELECT n_regionkey, c_mktsegment, count(*) AS n FROM {_CN} GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment), ())", name="grouping_sets")
def grouping_sets_query(spark, d):
    return grouping_sets(_customers(spark, d), [["n_regionkey"], ["c_mktsegment"], []], ["n_regionkey", "c_mktsegment"], n=rows())


# Joins


@query("SELECT count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS sc, round(sum(o_totalprice), 2) AS so FROM orders JOIN customer ON o_custkey = c_custkey")
def join_1_1(spark, d):
    j = hash_join(scan(spark, d, "orders", "o_custkey", "o_totalprice"), scan(spark, d, "customer", "c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
    return aggregate(j, n=rows(), sc=F.sum("c_nationkey"), so=F.round(F.sum("o_totalprice"), 2))


@query("SELECT count(*) AS n, round(sum(aq), 2) AS sa, round(sum(bq), 2) AS sb FROM (SELECT l_partkey AS ak, l_quantity AS aq FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT l_partkey AS bk, l_quantity AS bq FROM lineitem WHERE l_linenumber = 2) b ON ak = bk")
def join_m_n(spark, d):
    li = scan(spark, d, "lineitem", "l_partkey", "l_quantity", "l_linenumber")
    a = project(filter_rows(li, c("l_linenumber") == 1), ak="l_partkey", aq="l_quantity")
    b = project(filter_rows(li, c("l_linenumber") == 2), bk="l_partkey", bq="l_quantity")
    return aggregate(hash_join(a, b, [("ak", "bk")]), n=rows(), sa=F.round(F.sum("aq"), 2), sb=F.round(F.sum("bq"), 2))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_acctbal < 1000")
def join_filter(spark, d):
    o = filter_rows(scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), c("o_totalprice") > 100000)
    cu = filter_rows(scan(spark, d, "customer", "c_custkey", "c_name", "c_acctbal"), c("c_acctbal") < 1000)
    return hash_join(o, cu, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_star(spark, d):
    j = hash_join(scan(spark, d, "orders", "o_custkey", "o_totalprice"), scan(spark, d, "customer", "c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
    j = hash_join(j, scan(spark, d, "nation"), [("c_nationkey", "n_nationkey")])
    j = hash_join(j, scan(spark, d, "region"), [("n_regionkey", "r_regionkey")])
    return aggregate(j, ["r_name"], n=rows(), s=F.round(F.sum("o_totalprice"), 2))


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey")
def join_3way(spark, d):
    j = hash_join(scan(spark, d, "orders", "o_orderkey", "o_custkey"), scan(spark, d, "customer", "c_custkey"), [("o_custkey", "c_custkey")])
    return aggregate(hash_join(scan(spark, d, "lineitem", "l_orderkey", "l_quantity"), j, [("l_orderkey", "o_orderkey")]), n=rows(), s=F.round(F.sum("l_quantity"), 2))


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey + 100000000")
def join_nomatch(spark, d):
    o, cu = scan(spark, d, "orders", "o_custkey"), scan(spark, d, "customer", "c_custkey")
    return aggregate(hash_join(o, cu, o["o_custkey"] == cu["c_custkey"] + 100000000), n=rows())


@query("SELECT count(*) AS n, CAST(sum(a.c_nationkey) AS BIGINT) AS s FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey")
def join_self(spark, d):
    cu = scan(spark, d, "customer", "c_custkey", "c_nationkey")
    return aggregate(hash_join(cu.alias("a"), cu.alias("b"), c("a.c_custkey") == c("b.c_custkey")), n=rows(), s=F.sum("a.c_nationkey"))


@query("SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_custkey = b.c_nationkey + 1")
def join_computed_key(spark, d):
    cu = scan(spark, d, "customer", "c_custkey", "c_nationkey")
    return aggregate(hash_join(cu.alias("a"), cu.alias("b"), c("a.c_custkey") == c("b.c_nationkey") + 1), n=rows())


@query("SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey")
def join_composite(spark, d):
    li = scan(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    j = hash_join(li.alias("a"), li.alias("b"), (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_linenumber") == c("b.l_linenumber")))
    return aggregate(j, ["a.l_orderkey"], n=rows())


@query("SELECT count(*) AS n FROM (SELECT DISTINCT p_retailprice AS x FROM part) a JOIN (SELECT DISTINCT p_size::DOUBLE AS y FROM part) b ON x = y + 900")
def join_float_key(spark, d):
    p = scan(spark, d, "part", "p_retailprice", "p_size")
    a, b = project(p, x="p_retailprice").distinct(), project(p, y=c("p_size").cast("double")).distinct()
    return aggregate(hash_join(a, b, a["x"] == b["y"] + 900), n=rows())


@query("SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey::BIGINT")
def join_mixed_width(spark, d):
    s, n = scan(spark, d, "supplier"), project(scan(spark, d, "nation"), k=c("n_nationkey").cast("long"))
    return aggregate(hash_join(s, n, [("s_nationkey", "k")]), n=rows())


def _outer(how: str, sql: str) -> None:
    @query(f"SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_acctbal > 0) x {sql} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') y ON c_custkey = o_custkey", name=f"join_{how}")
    def run(spark, d):
        cu = filter_rows(scan(spark, d, "customer", "c_custkey", "c_acctbal"), c("c_acctbal") > 0)
        o = filter_rows(scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), c("o_orderstatus") == "F")
        return hash_join(cu, o, [("c_custkey", "o_custkey")], how).select("c_custkey", "o_orderkey", "o_totalprice")


for _how, _word in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL OUTER")):
    _outer(_how, _word)


def _existence(how: str, word: str) -> None:
    @query(f"SELECT c_custkey, c_name FROM customer WHERE {word} EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", name=f"join_{how}")
    def run(spark, d):
        o = filter_rows(scan(spark, d, "orders", "o_custkey", "o_totalprice"), c("o_totalprice") > 150000)
        return hash_join(scan(spark, d, "customer", "c_custkey", "c_name"), o, [("c_custkey", "o_custkey")], f"left_{how}")


for _how, _word in (("semi", ""), ("anti", "NOT")):
    _existence(_how, _word)


@query("SELECT count(*) AS n FROM supplier, nation WHERE s_acctbal * n_nationkey > 20000")
def join_theta(spark, d):
    s, n = scan(spark, d, "supplier", "s_acctbal"), scan(spark, d, "nation", "n_nationkey")
    return aggregate(hash_join(s, n, s["s_acctbal"] * n["n_nationkey"] > 20000), n=rows())


@query("SELECT event_id, n FROM (SELECT e.event_id, count(*) AS n FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts GROUP BY e.event_id) q")
def join_range(spark, d):
    e = scan(spark, d, "events", "event_id", "user_id", "ts")
    before = project(e, f_user="user_id", f_ts="ts")
    return aggregate(range_join(e, before, [("user_id", "f_user")], "ts", "f_ts", 3600), ["event_id"], n=rows())


@query("SELECT e.event_id, f.event_id AS prior FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) f ON e.user_id = f.user_id AND e.event_id > f.event_id")
def join_asof(spark, d):
    e = scan(spark, d, "events", "event_id", "user_id", "event_type")
    first = e.agg(F.min("event_type").alias("first"))
    w = window(["user_id"], ["event_id"], rows=(Window.unboundedPreceding, -1))
    marked = e.join(F.broadcast(first), e["event_type"] == first["first"], "left")
    prior = F.last(F.when(c("first").isNotNull(), c("event_id")), ignorenulls=True).over(w)
    return filter_rows(project(marked, event_id="event_id", prior=prior), c("prior").isNotNull())


@query("SELECT min(x) AS mn, max(x) AS mx, count(*) AS n FROM (SELECT round(sin(s_acctbal) + cos(p_retailprice), 9) AS x FROM supplier, part) q")
def cross_math(spark, d):
    # No pair is made: adding and rounding keep order, so the extremes of all sums are the sums of both sides' extremes, nulls left out and
    # NaN above all numbers (sine and cosine are never infinite), and there are as many pairs as the product of the numbers of rows.
    a = project(scan(spark, d, "supplier", "s_acctbal"), a=fn.sin("s_acctbal"))
    b = project(scan(spark, d, "part", "p_retailprice"), b=fn.cos("p_retailprice"))
    a, b = (aggregate(side, **{f"{x}_mn": F.min(x), f"{x}_mx": F.max(x), f"{x}_n": rows()}) for side, x in ((a, "a"), (b, "b")))
    return project(cross_product(a, b), mn=F.round(c("a_mn") + c("b_mn"), 9), mx=F.round(c("a_mx") + c("b_mx"), 9), n=c("a_n") * c("b_n"))


@query("SELECT n_name, r_name, n_nationkey + r_regionkey AS k FROM nation, region")
def cross_project(spark, d):
    return project(cross_product(scan(spark, d, "nation"), scan(spark, d, "region")), n_name="n_name", r_name="r_name", k=fn.add("n_nationkey", "r_regionkey"))


@query("SELECT s_nationkey, count(*) AS n, max(n_nationkey) AS hi FROM supplier, nation GROUP BY s_nationkey")
def cross_agg(spark, d):
    return aggregate(cross_product(scan(spark, d, "supplier"), scan(spark, d, "nation")), ["s_nationkey"], n=rows(), hi=F.max("n_nationkey"))


@query("SELECT count(*) AS n, min(a.n_nationkey * b.n_nationkey) AS mn, max(a.n_nationkey * b.n_nationkey) AS mx FROM nation a, nation b")
def cross_self(spark, d):
    n = scan(spark, d, "nation", "n_nationkey")
    k = c("a.n_nationkey") * c("b.n_nationkey")
    return aggregate(cross_product(n.alias("a"), n.alias("b")), n=rows(), mn=F.min(k), mx=F.max(k))


@query("SELECT count(*) AS n FROM nation, region WHERE r_regionkey < 0")
def cross_empty(spark, d):
    return aggregate(cross_product(scan(spark, d, "nation"), filter_rows(scan(spark, d, "region"), c("r_regionkey") < 0)), n=rows())


# Windows


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS running_sum FROM events", name="running_sum")
def running_sum_query(spark, d):
    out = running_sum(scan(spark, d, "events", "event_id", "value"), "value", ["event_id"])
    return project(out, event_id="event_id", running_sum=F.round("running_sum", 2))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS s FROM events")
def running_sum_by_user(spark, d):
    out = running_sum(scan(spark, d, "events", "event_id", "user_id", "value"), "value", ["event_id"], ["user_id"], name="s")
    return project(out, event_id="event_id", s=F.round("s", 2))


@query("""SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), v AS (PARTITION BY user_id ORDER BY event_type)""")
def window_rank(spark, d):
    w, v = window(["user_id"], ["event_id"]), window(["user_id"], ["event_type"])
    big = lambda x: x.cast("long")
    return project(scan(spark, d, "events"), event_id="event_id", rn=big(F.row_number().over(w)), rk=big(F.rank().over(v)), dr=big(F.dense_rank().over(v)), nt=big(F.ntile(4).over(w)), pr=F.round(F.percent_rank().over(v), 9), cd=F.round(F.cume_dist().over(v), 9))


@query("""SELECT event_id, lag(value) OVER w AS lg, lead(value, 2, -1.0::DOUBLE) OVER w AS ld, first_value(event_id) OVER w AS fv, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
          nth_value(event_id, 2) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_lag(spark, d):
    w = window(["user_id"], ["event_id"])
    whole = window(["user_id"], ["event_id"], rows=(Window.unboundedPreceding, Window.unboundedFollowing))
    return project(scan(spark, d, "events"), event_id="event_id", lg=F.lag("value").over(w), ld=F.lead("value", 2, -1.0).over(w), fv=F.first("event_id").over(w), lv=F.last("event_id").over(whole), nv=F.nth_value("event_id", 2).over(w))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS m, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM events""")
def window_frame(spark, d):
    last, near = window(["user_id"], ["event_id"], rows=(-3, 0)), window(["user_id"], ["event_id"], value_range=(-500, 500))
    return project(scan(spark, d, "events"), event_id="event_id", m=F.round(F.avg("value").over(last), 6), n=rows().over(near))


@query("SELECT o_orderkey, round(o_totalprice / s, 9) AS share FROM (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders) q")
def window_project(spark, d):
    o = scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("s", F.sum("o_totalprice").over(window(["o_custkey"])))
    return project(o, o_orderkey="o_orderkey", share=F.round(fn.divide("o_totalprice", "s"), 9))


# Order, limits, sets, subqueries


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", name="topk")
def topk_query(spark, d):
    return top_k(scan(spark, d, "orders", "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def order_limit_offset(spark, d):
    return top_k(scan(spark, d, "customer", "c_custkey", "c_name"), ["c_custkey"], 10, offset=20)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) q WHERE r <= 3")
def topk_per_group(spark, d):
    e = scan(spark, d, "events", "user_id", "event_id", "value").withColumn("r", F.row_number().over(window(["user_id"], [F.desc("value"), "event_id"])))
    return filter_rows(e, c("r") <= 3).select("user_id", "event_id")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def order_by(spark, d):
    return scan(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


def _keys(spark, d):
    return project(scan(spark, d, "customer"), k="c_nationkey"), project(filter_rows(scan(spark, d, "supplier"), c("s_acctbal") > 5000), k="s_nationkey")


_CK, _SK = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


@query(f"{_CK} UNION ALL {_SK}")
def union_all(spark, d):
    return union_rows(*_keys(spark, d))


@query(f"{_CK} UNION {_SK}")
def union_distinct(spark, d):
    return union_rows(*_keys(spark, d), distinct=True)


@query(f"{_CK} INTERSECT {_SK}")
def intersect(spark, d):
    return intersect_rows(*_keys(spark, d))


@query(f"{_CK} INTERSECT ALL {_SK}")
def intersect_all(spark, d):
    return intersect_rows(*_keys(spark, d), keep_all=True)


@query(f"{_CK} EXCEPT {_SK}", name="except")
def except_query(spark, d):
    return except_rows(*_keys(spark, d))


@query(f"{_CK} EXCEPT ALL {_SK}")
def except_all(spark, d):
    return except_rows(*_keys(spark, d), keep_all=True)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5")
def scalar_sub(spark, d):
    o = scan(spark, d, "orders", "o_orderkey", "o_totalprice")
    mean = aggregate(o, mean=F.avg("o_totalprice"))
    return o.join(F.broadcast(mean), c("o_totalprice") > c("mean") * 1.5).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")
def correlated_sub(spark, d):
    li = scan(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    mean = project(aggregate(li, ["l_partkey"], mean=F.avg("l_quantity")), pk="l_partkey", mean="mean")
    return hash_join(li, mean, [("l_partkey", "pk")]).where(c("l_quantity") < c("mean") * 0.4).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS s FROM (WITH RECURSIVE t(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM t WHERE i < 50) SELECT i FROM t) q")
def recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE t(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM t WHERE i < 50) SELECT count(*) AS n, sum(i) AS s FROM t")


@query("SELECT v.k, n_name FROM (VALUES (1), (3), (7)) v(k) JOIN nation ON n_nationkey = k")
def values_join(spark, d):
    v = spark.createDataFrame([(1,), (3,), (7,)], "k int")
    return hash_join(v, scan(spark, d, "nation", "n_nationkey", "n_name"), [("k", "n_nationkey")]).select("k", "n_name")


@query("SELECT CAST(sum(range) AS BIGINT) AS s, count(*) AS n FROM range(1000)")
def table_function_range(spark, d):
    return aggregate(spark.range(1000), s=F.sum("id"), n=rows())


@query("SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) q")
def pushdown_count(spark, d):
    return aggregate(filter_rows(scan(spark, d, "lineitem", "l_orderkey", "l_quantity"), c("l_quantity") > 45), n=rows())


@query("SELECT min(k) AS a, max(k) AS b, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) q")
def pushdown_mixed(spark, d):
    q = project(filter_rows(scan(spark, d, "lineitem", "l_orderkey", "l_quantity"), c("l_quantity") > 45), k="l_orderkey")
    return aggregate(q, a=F.min("k"), b=F.max("k"), n=rows(), s=F.sum("k"))


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_quantity = 1 AND l_discount >= 0.1")
def highly_selective(spark, d):
    return aggregate(filter_rows(scan(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_discount"), c("l_quantity") == 1, c("l_discount") >= 0.1), n=rows(), s=F.sum("l_orderkey"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
          WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""")
def local_supplier_volume(spark, d):
    n = hash_join(scan(spark, d, "nation"), filter_rows(scan(spark, d, "region"), c("r_name") == "ASIA"), [("n_regionkey", "r_regionkey")])
    s = hash_join(scan(spark, d, "supplier", "s_suppkey", "s_nationkey"), n, [("s_nationkey", "n_nationkey")])
    li = hash_join(scan(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), s, [("l_suppkey", "s_suppkey")])
    o = hash_join(scan(spark, d, "orders", "o_orderkey", "o_custkey"), scan(spark, d, "customer", "c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
    j = hash_join(li, o, (li["l_orderkey"] == o["o_orderkey"]) & (li["s_nationkey"] == o["c_nationkey"]))
    return aggregate(j, ["n_name"], revenue=F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2))


@query("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O', 'F') GROUP BY l_returnflag)")
def pivot(spark, d):
    return scan(spark, d, "lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().fillna(0)


# Null-aware and single-row joins, sampling, nested values, other aggregates


_RATES = "(SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier WHERE s_acctbal > {least}) q"


def _suppliers(spark, d, least):
    s = filter_rows(scan(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), c("s_acctbal") > least)
    return project(s, k=F.when(c("s_suppkey") % 7 != 0, c("s_nationkey")))


@query(f"SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT k FROM {_RATES.format(least=0)} WHERE k IS NOT NULL AND k < 9)")
def not_in(spark, d):
    right = filter_rows(_suppliers(spark, d, 0), c("k").isNotNull(), c("k") < 9)
    return filter_rows(mark_join(scan(spark, d, "customer", "c_custkey", "c_nationkey"), right, "c_nationkey", "k"), ~c("mark")).select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT k FROM {_RATES.format(least=0)})")
def not_in_with_nulls(spark, d):
    return filter_rows(mark_join(scan(spark, d, "customer", "c_custkey", "c_nationkey"), _suppliers(spark, d, 0), "c_nationkey", "k"), ~c("mark")).select("c_custkey")


@query(f"SELECT n_nationkey, nullif(n_nationkey, 3) IN (SELECT k FROM {_RATES.format(least=5000)}) AS mark FROM nation")
def mark_values(spark, d):
    n = project(scan(spark, d, "nation"), n_nationkey="n_nationkey", key=F.nullif(c("n_nationkey"), F.lit(3)))
    return mark_join(n, _suppliers(spark, d, 5000), "key", "k").select("n_nationkey", "mark")


@query("SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS name FROM orders")
def single_value(spark, d):
    cu = filter_rows(scan(spark, d, "customer", "c_custkey", "c_name", "c_acctbal"), c("c_acctbal") > 0)
    return single_join(scan(spark, d, "orders", "o_orderkey", "o_custkey"), cu, "o_custkey", "c_custkey", "c_name", "name").select("o_orderkey", "name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE md5(l_orderkey::VARCHAR) < '19999999'")
def sample_by_hash(spark, d):
    return sample_rows(scan(spark, d, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", 0.1)


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS q90, quantile_disc(l_linenumber, 0.25) AS q25, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order FROM lineitem GROUP BY l_returnflag")
def quantiles(spark, d):
    li = scan(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_linenumber", "l_orderkey")
    return aggregate(li, ["l_returnflag"], q90=F.round(F.percentile("l_quantity", 0.9), 6), q25=F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_linenumber)").cast("int"), last_order=F.max_by("l_orderkey", c("l_orderkey") * 10 + c("l_linenumber")))


@query("SELECT l_returnflag, bool_and(l_tax < 0.08) AS low, bool_or(l_discount > 0.09) AS high, CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS taxed, round(skewness(l_quantity), 4) AS skew FROM lineitem GROUP BY l_returnflag")
def bool_agg(spark, d):
    li = scan(spark, d, "lineitem", "l_returnflag", "l_tax", "l_discount", "l_quantity")
    n = F.count(F.lit(1))
    # Fisher's skewness with the sample's correction, as SQL has it.
    skew = F.skewness("l_quantity") * F.sqrt(n * (n - 1).cast("double")) / (n - 2)
    return aggregate(li, ["l_returnflag"], low=F.bool_and(c("l_tax") < 0.08), high=F.bool_or(c("l_discount") > 0.09), taxed=F.sum((c("l_tax") > 0.04).cast("int")), skew=F.round(skew, 4))


@query("SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT length(n_name))), ',') AS sizes, CAST(list_sum(list(n_nationkey)) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def list_agg(spark, d):
    n = scan(spark, d, "nation", "n_regionkey", "n_nationkey", "n_name")
    total = F.aggregate(F.collect_list("n_nationkey"), F.lit(0).cast("long"), lambda a, x: a + x)
    return aggregate(n, ["n_regionkey"], sizes=F.concat_ws(",", F.sort_array(F.collect_set(F.length("n_name"))).cast("array<string>")), total=total)


@query("SELECT l_orderkey, l_linenumber, list_contains([l_linenumber, 3], 3) AS has, list_max([l_linenumber, 2]) AS hi, len(list_filter([1, 2, l_linenumber], lambda x: x > 1)) AS kept, array_to_string(list_sort([l_linenumber, 2, 5]), '-') AS sorted FROM lineitem")
def fn_arrays(spark, d):
    n = c("l_linenumber")
    return project(scan(spark, d, "lineitem", "l_orderkey", "l_linenumber"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", has=F.array_contains(F.array(n, F.lit(3)), 3), hi=F.array_max(F.array(n, F.lit(2))),
                   kept=F.size(F.filter(F.array(F.lit(1), F.lit(2), n), lambda x: x > 1)).cast("long"), sorted=F.concat_ws("-", F.sort_array(F.array(n, F.lit(2), F.lit(5))).cast("array<string>")))


@query("""SELECT event_id, CAST(json_extract_string('{"a": {"b": ' || user_id || '}}', '$.a.b') AS BIGINT) AS v, json_extract_string('{"x": ["p", "q"]}', '$.x[1]') AS w FROM events""")
def fn_json(spark, d):
    made = F.concat(F.lit('{"a": {"b": '), c("user_id").cast("string"), F.lit("}}"))
    return project(scan(spark, d, "events", "event_id", "user_id"), event_id="event_id", v=F.get_json_object(made, "$.a.b").cast("long"), w=F.get_json_object(F.lit('{"x": ["p", "q"]}'), "$.x[1]"))


@query("SELECT n_nationkey, map_extract_value(MAP {'key': n_nationkey, 'region': n_regionkey}, 'region') AS r, cardinality(MAP {'a': 1, 'b': n_nationkey}) AS n FROM nation")
def fn_maps(spark, d):
    m = F.create_map(F.lit("key"), c("n_nationkey"), F.lit("region"), c("n_regionkey"))
    two = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), c("n_nationkey"))
    return project(scan(spark, d, "nation"), n_nationkey="n_nationkey", r=F.element_at(m, "region"), n=F.size(two).cast("long"))


@query("SELECT l_returnflag, isnan(max(x)) AS top_is_nan, min(x) AS lo, count(*) FILTER (WHERE isnan(x)) AS nans FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE l_quantity::DOUBLE END AS x FROM lineitem) q GROUP BY l_returnflag")
def nan_extremes(spark, d):
    x = F.when(c("l_linenumber") == 7, F.lit(float("nan"))).otherwise(c("l_quantity").cast("double"))
    q = project(scan(spark, d, "lineitem", "l_returnflag", "l_linenumber", "l_quantity"), l_returnflag="l_returnflag", x=x)
    return aggregate(q, ["l_returnflag"], top_is_nan=F.isnan(F.max("x")), lo=F.min("x"), nans=F.count_if(F.isnan("x")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE x = 0) AS zeros FROM (SELECT DISTINCT CASE WHEN n_nationkey = 1 THEN -0.0::DOUBLE WHEN n_nationkey = 2 THEN 0.0::DOUBLE WHEN n_nationkey < 5 THEN 'NaN'::DOUBLE ELSE 1.5 END AS x FROM nation) q")
def float_key_extremes(spark, d):
    k = c("n_nationkey")
    x = F.when(k == 1, F.lit(-0.0)).when(k == 2, F.lit(0.0)).when(k < 5, F.lit(float("nan"))).otherwise(F.lit(1.5))
    return aggregate(project(scan(spark, d, "nation", "n_nationkey"), x=x).distinct(), n=rows(), zeros=F.count_if(c("x") == 0))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def csv_rows(spark, d):
    line = F.concat_ws(",", c("n_nationkey").cast("string"), F.concat(F.lit('"'), c("n_name"), F.lit('"')))
    parsed = project(scan(spark, d, "nation"), r=F.from_csv(line, "k int, name string"))
    return project(parsed, k=c("r.k"), name=c("r.name"))


@query("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice / 1000) AS thousands, round(l_linenumber * 10.0, -1)::BIGINT AS tens, least(l_tax, l_discount) AS low FROM lineitem")
def fn_round(spark, d):
    li = scan(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_discount")
    x = c("l_extendedprice") / 1000
    toward = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")
    return project(li, l_orderkey="l_orderkey", l_linenumber="l_linenumber", thousands=toward, tens=F.round(c("l_linenumber") * 10.0, -1).cast("long"), low=F.least("l_tax", "l_discount"))
