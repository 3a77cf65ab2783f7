"""A query for each panel operator over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, strings
from ..operators import fill, merge, portfolio, regression, transform
from . import sql as sql_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


ASOF_SIDES = """
WITH l AS (SELECT o_orderkey, o_custkey % 97 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT l_suppkey % 97 AS k, CAST(l_shipdate AS DATE) AS shipped, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY 1, 2)
"""


def _asof_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    right = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 97).alias("k"), F.col("l_shipdate").cast("date").alias("shipped")).agg(F.sum("l_quantity").alias("qty"))
    return left, rounded(right, "qty")


@query(ASOF_SIDES + "SELECT l.o_orderkey, l.k, l.d, r.shipped, r.qty FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d >= r.shipped")
def asof_latest(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return merge.left_merge_latest(left, right, "k", "d", "shipped")


@query(ASOF_SIDES + """SELECT o_orderkey, k, d, CASE WHEN shipped >= d - 2 THEN shipped END AS shipped, CASE WHEN shipped >= d - 2 THEN qty END AS qty
FROM (SELECT l.o_orderkey, l.k, l.d, r.shipped, r.qty FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d >= r.shipped)""")
def asof_latest_within_offset(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return merge.left_merge_latest(left, right, "k", "d", "shipped", max_offset=2)


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEYS = LINE.split(", ")


@query(f"""SELECT {LINE}, round(sum(l_quantity) OVER w, 4) AS l_quantity_sum, round(avg(l_quantity) OVER w, 4) AS l_quantity_mean, round(stddev_samp(l_quantity) OVER w, 4) AS l_quantity_std,
round(var_samp(l_quantity) OVER w, 4) AS l_quantity_var, min(l_quantity) OVER w AS l_quantity_min, max(l_quantity) OVER w AS l_quantity_max, count(l_quantity) OVER w AS l_quantity_count,
round(median(l_quantity) OVER w, 4) AS l_quantity_median, round(quantile_cont(l_quantity, 0.25) OVER w, 4) AS l_quantity_quantile FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def groupby_merge_aggregates(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_quantity")
    df = merge.groupby_merge(df, "l_suppkey", ["sum", "mean", "std", "var", "min", "max", "count", "median"], subset="l_quantity")
    df = merge.groupby_merge(df, "l_suppkey", "quantile", 0.25, subset="l_quantity").drop("l_quantity")
    return rounded(df, *(f"l_quantity_{f}" for f in ("sum", "mean", "std", "var", "median", "quantile")))


@query("""WITH f AS (SELECT user_id, first(value ORDER BY ts) AS a, last(value ORDER BY ts) AS b, count(DISTINCT event_type) AS n, count(*) AS s, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, round(skewness(value), 4) AS skew
FROM events GROUP BY user_id) SELECT event_id, user_id, a AS value_first, b AS value_last, CAST(n AS INTEGER) AS event_type_nunique, s AS value_size, sem AS value_sem, skew AS value_skew FROM events JOIN f USING (user_id)""")
def groupby_merge_ordered(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    df = merge.groupby_merge(df, "user_id", ["first", "last", "size", "sem", "skew"], subset="value", orderby="ts")
    df = merge.groupby_merge(df, "user_id", "nunique", subset="event_type")
    df = rounded(df, "value_sem", digits=6)
    return rounded(df, "value_skew").drop("ts", "event_type", "value")


@query("SELECT event_id, user_id, value, round(value - min(value) OVER (PARTITION BY user_id), 2) AS value_transform FROM events")
def groupby_merge_transform(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rounded(merge.groupby_merge(df, "user_id", "transform", lambda s: s - s.min(), subset="value"), "value_transform", digits=2)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS group_index FROM events")
def groupby_index(spark, sf_dir):
    return merge.groupby_index(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "group_index")


@query("SELECT c_custkey, c_mktsegment, length(c_mktsegment) AS segment_length FROM customer")
def apply_to_unique(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return merge.apply_func_to_unique_and_merge(df, "c_mktsegment", lambda s: s.str.len(), "segment_length", "long")


@query("""WITH t AS (SELECT o_orderkey, o_orderpriority, least(o_totalprice, quantile_cont(o_totalprice, 0.95) OVER (PARTITION BY o_orderpriority)) AS x FROM orders)
SELECT o_orderkey, o_orderpriority, round(greatest(x, quantile_cont(x, 0.05) OVER (PARTITION BY o_orderpriority)), 4) AS o_totalprice FROM t""")
def winsorize_by_group(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(transform.winsorize(df, 0.05, "o_totalprice", "o_orderpriority"), "o_totalprice")


@query("""WITH q AS (SELECT quantile_cont(s_acctbal, 0.9) AS t FROM supplier), t AS (SELECT s_suppkey, least(s_acctbal, t) AS x FROM supplier, q)
SELECT s_suppkey, round(greatest(x, (SELECT quantile_cont(x, 0.2) FROM t)), 4) AS s_acctbal FROM t""")
def winsorize_whole(spark, sf_dir):
    return rounded(transform.winsorize(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), (0.2, 0.1), "s_acctbal"), "s_acctbal")


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS l_extendedprice_wavg,
round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount_wavg, CAST(count(l_tax) AS DOUBLE) AS l_tax_count, CAST(count(l_tax) AS DOUBLE) AS l_tax_count_wavg FROM lineitem GROUP BY 1, 2""")
def weighted_averages(spark, sf_dir):
    df = transform.averages(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"], "l_quantity", "l_tax")
    return rounded(rounded(df, "l_extendedprice", "l_extendedprice_wavg"), "l_discount", "l_discount_wavg", digits=6)


@query("""WITH d AS (SELECT DISTINCT user_id, ts, value FROM events) SELECT event_id, user_id, ts, value, round(c, 4) AS value_change
FROM events JOIN (SELECT user_id, ts, value, value - lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS c FROM d) USING (user_id, ts, value)""")
def var_change(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(transform.var_change_by_groups(df, "value", "user_id", "ts", 2), "value_change")


@query("""WITH e AS (SELECT event_id, user_id, ts, value / 1e6 AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS p FROM events),
w AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE 1 + (p > 2)::INT + (p > 5)::INT END AS win FROM e)
SELECT event_id, user_id, round(r, 9) AS r, round(product(1 + r) OVER (PARTITION BY user_id, win ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 9) AS cum_r FROM w""")
def cumulate_between(spark, sf_dir):
    """Values in millionths keep the products near one."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") / 1e6).alias("r"))
    return rounded(transform.cumulate(df, "r", "between", "ts", "user_id", [1, 3, 6], grossify=True), "r", "cum_r", digits=9).drop("ts")


@query("""WITH e AS (SELECT event_id, user_id, ts, 1 + value / 1e6 AS r FROM events)
SELECT event_id, user_id, round(product(r) OVER (PARTITION BY user_id, ts = (SELECT min(ts) FROM events) ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) AS r FROM e""")
def cumulate_first(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (1 + F.col("value") / 1e6).alias("r"))
    return rounded(transform.cumulate(df, "r", "first", "ts", "user_id", replace=True), "r", digits=9).drop("ts")


PORT = """WITH c AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS x, list_transform([0.2, 0.4, 0.6, 0.8], lambda q: 0.0) AS z,
[quantile_cont(o_totalprice, 0.2) OVER w, quantile_cont(o_totalprice, 0.4) OVER w, quantile_cont(o_totalprice, 0.6) OVER w, quantile_cont(o_totalprice, 0.8) OVER w] AS cuts FROM orders WINDOW w AS ({w}))
SELECT o_orderkey, o_orderpriority, CAST(1 + len(list_filter(cuts, lambda v: x {op} v)) AS INTEGER) AS portfolio FROM c"""


@query(PORT.format(w="PARTITION BY o_orderpriority", op=">"))
def portfolio_by_group(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return portfolio.portfolio(df, "o_totalprice", 5, byvars="o_orderpriority").drop("o_totalprice")


@query(PORT.format(w="", op=">="))
def portfolio_whole(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return portfolio.portfolio(df, "o_totalprice", 5).drop("o_totalprice")


@query("SELECT p_partkey, CAST(1 + (p_size >= 10)::INT + (p_size >= 25)::INT + (p_size >= 40)::INT AS INTEGER) AS bucket FROM part")
def portfolio_cutoffs(spark, sf_dir):
    return portfolio.portfolio(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", cutoffs=[10, 25, 40], portvar="bucket").drop("p_size")


@query("""WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.3) AS a, quantile_cont(o_totalprice, 0.7) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, CASE WHEN a IS NULL THEN 0 ELSE CAST(1 + (o_totalprice > a)::INT + (o_totalprice > b)::INT AS INTEGER) END AS portfolio FROM orders LEFT JOIN m USING (o_orderpriority)""")
def portfolio_other_breakpoints(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    marks = df.filter("o_orderstatus = 'F'")
    percent = portfolio.portfolio(df, "o_totalprice", 10, byvars="o_orderpriority", cutdf=marks, portvar="portfolio")
    return percent.withColumn("portfolio", F.when(F.col("portfolio") > 7, 3).when(F.col("portfolio") > 3, 2).when(F.col("portfolio") > 0, 1).otherwise(0)).select("o_orderkey", "portfolio")


PORT_AVG = """WITH c AS (SELECT l_returnflag, l_discount, l_quantity, l_extendedprice AS x, quantile_cont(l_extendedprice, 0.25) OVER w AS a, quantile_cont(l_extendedprice, 0.5) OVER w AS b, quantile_cont(l_extendedprice, 0.75) OVER w AS c
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)), p AS (SELECT *, CAST(1 + (x > a)::INT + (x > b)::INT + (x > c)::INT AS INTEGER) AS portfolio FROM c),
g AS (SELECT portfolio, l_returnflag, avg(l_discount) AS l_discount, sum(l_discount * l_quantity) / sum(l_quantity) AS l_discount_wavg FROM p GROUP BY 1, 2)
"""


def _port_averages(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_quantity", "l_extendedprice")
    return portfolio.portfolio_averages(df, "l_extendedprice", "l_discount", 4, "l_returnflag", wtvar="l_quantity", avgonly=True)


@query(PORT_AVG + "SELECT portfolio, l_returnflag, round(l_discount, 6) AS l_discount, round(l_discount_wavg, 6) AS l_discount_wavg FROM g")
def portfolio_averages(spark, sf_dir):
    return rounded(_port_averages(spark, sf_dir), "l_discount", "l_discount_wavg", digits=6)


@query(PORT_AVG + "SELECT l_returnflag, round(t.l_discount - b.l_discount, 6) AS l_discount, round(t.l_discount_wavg - b.l_discount_wavg, 6) AS l_discount_wavg FROM (SELECT * FROM g WHERE portfolio = 4) t FULL JOIN (SELECT * FROM g WHERE portfolio = 1) b USING (l_returnflag)")
def long_short(spark, sf_dir):
    found = portfolio.long_short_portfolio(_port_averages(spark, sf_dir), "portfolio", "l_returnflag", ["l_discount", "l_discount_wavg"])
    return rounded(found, "l_discount", "l_discount_wavg", digits=6)


ALL_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_custkey, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 4) AS \"spent{p}\"" for p in ALL_PRIORITIES) + " FROM orders GROUP BY 1")
def long_to_wide(spark, sf_dir):
    df = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 4).alias("spent"))
    return transform.long_to_wide(df, "o_custkey", "spent", "o_orderpriority", columns=ALL_PRIORITIES)


HOLES = "WITH h AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events)\n"


def _holes(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return df.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))


FILLED = HOLES + """, f AS (SELECT user_id, first(event_type ORDER BY ts) FILTER (event_type IS NOT NULL) AS t, avg(value) AS v FROM h GROUP BY 1)
SELECT event_id, user_id, coalesce(event_type, t) AS event_type, round(coalesce(value, v), 4) AS value FROM h JOIN f USING (user_id)"""


@query(FILLED)
def fill_by_groups(spark, sf_dir):
    return rounded(fill.fillna_by_groups(_holes(spark, sf_dir), "user_id", ["event_id", "ts"], orderby="ts"), "value").drop("ts")


@query(f"SELECT * FROM ({FILLED}) JOIN (SELECT min_by(event_id, ts) AS event_id FROM events GROUP BY user_id) USING (event_id)")
def fill_and_keep_one(spark, sf_dir):
    return rounded(fill.fillna_by_groups_and_keep_one_per_group(_holes(spark, sf_dir), "user_id", ["event_id", "ts"], orderby="ts"), "value").drop("ts")


DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _daily(spark, sf_dir):
    return rounded(read(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("total")), "total")


@query(f"""WITH d AS ({DAILY})
SELECT user_id, day, last_value(total IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS total FROM (SELECT u.user_id, x.day, d.total
FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN (SELECT DISTINCT day FROM d) x LEFT JOIN d ON d.user_id = u.user_id AND d.day = x.day)""")
def add_missing_rows(spark, sf_dir):
    return fill.add_missing_group_rows(_daily(spark, sf_dir), "user_id", "day", fill_limit=3)


@query(f"WITH d AS ({DAILY}) SELECT u.user_id, x.day, coalesce(d.total, 0) AS total FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN (SELECT DISTINCT day FROM d) x LEFT JOIN d ON d.user_id = u.user_id AND d.day = x.day")
def fill_excluded(spark, sf_dir):
    return fill.fill_excluded_rows(_daily(spark, sf_dir), ["user_id", "day"], "total", 0)


@query(HOLES + "SELECT event_id, user_id, event_type, value FROM h WHERE event_type IS NOT NULL OR value IS NOT NULL")
def drop_missing_rows(spark, sf_dir):
    return fill.drop_missing_group_rows(_holes(spark, sf_dir).drop("ts"), ["event_id", "user_id"])


@query("SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity), 4) AS const, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef_l_quantity FROM lineitem GROUP BY 1")
def regression_with_constant(spark, sf_dir):
    return rounded(regression.reg_by(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_suppkey"), "const", "coef_l_quantity")


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity ** 2) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax ** 2) AS c, sum(l_quantity * l_extendedprice) AS p, sum(l_tax * l_extendedprice) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((p * c - q * b) / (a * c - b * b), 4) AS coef_l_quantity, round((q * a - p * b) / (a * c - b * b), 2) AS coef_l_tax FROM m""")
def regression_without_constant(spark, sf_dir):
    df = regression.reg_by(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], "l_returnflag", cons=False)
    return rounded(rounded(df, "coef_l_quantity"), "coef_l_tax", digits=2)


@query("""WITH g AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT l_suppkey, n, (l_quantity - m) AS z, (l_extendedprice - a - b * l_quantity) AS r FROM lineitem JOIN g USING (l_suppkey))
SELECT l_suppkey, round(sqrt(n / (n - 2.0) * sum(z * z * r * r) / sum(z * z) ** 2), 4) AS stderr_l_quantity FROM e GROUP BY l_suppkey, n""")
def regression_robust_errors(spark, sf_dir):
    df = regression.reg_by(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_suppkey", stderr=True)
    return rounded(df.select("l_suppkey", "stderr_l_quantity"), "stderr_l_quantity")


@query("""WITH c AS (SELECT printf('%.2f', corr(l_extendedprice, l_quantity)) AS a, printf('%.2f', corr(l_tax, l_quantity)) AS b, printf('%.2f', corr(l_tax, l_extendedprice)) AS d FROM lineitem)
SELECT 'l_quantity' AS variable, '1.00' AS l_quantity, '' AS l_extendedprice, '' AS l_tax UNION ALL SELECT 'l_extendedprice', a, '1.00', '' FROM c UNION ALL SELECT 'l_tax', b, d, '1.00' FROM c""")
def correlations(spark, sf_dir):
    return transform.formatted_corr_df(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("""SELECT o_orderkey, o_orderdate, CAST(s AS INTEGER) AS "Shift", o_orderdate + to_months(s) AS "Shift Date" FROM orders, (SELECT unnest([12, 24, -1]) AS s)""")
def expand_time_months(spark, sf_dir):
    return dates.expand_time(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), datevar="o_orderdate", time=[12, 24, -1])


OPEN = """WITH days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2023-12-01', DATE '2024-03-15', INTERVAL 1 DAY) t(d)),
o AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM days WHERE isodow(day) < 6 AND day NOT IN (DATE '2023-12-25', DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19'))
"""


@query(OPEN + """, e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), a AS (SELECT e.day, max(o.n) AS n0, max(o.day) = e.day AS is_open FROM (SELECT DISTINCT day FROM e) e JOIN o ON o.day <= e.day GROUP BY e.day)
SELECT e.event_id, e.day, CAST(s AS INTEGER) AS "Shift", CAST(o.day AS TIMESTAMP) AS "Shift Date" FROM e JOIN a USING (day), (SELECT unnest([-2, -1, 0, 1, 2]) AS s) JOIN o ON o.n = n0 + s + CASE WHEN s > 0 OR is_open THEN 0 ELSE 1 END""")
def expand_time_trading_days(spark, sf_dir):
    days = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return dates.expand_time(days, True, "day", "d", [-2, 2])


@query(OPEN + """SELECT event_id, CAST(ts AS DATE) AS day, CAST(o.day AS TIMESTAMP) AS "Daily Date" FROM events JOIN o ON date_trunc('month', o.day) = date_trunc('month', ts)""")
def expand_months_trading_days(spark, sf_dir):
    return dates.expand_months(read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day")), "day")


@query("SELECT o_orderkey, TIMESTAMP '1960-01-01' + to_days(CAST(o_orderkey % 20000 AS INTEGER)) AS d FROM orders")
def sas_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.convert_sas_date(F.col("o_orderkey") % 20000).cast("timestamp_ntz").alias("d"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
def year_and_month(spark, sf_dir):
    return dates.year_month_from_date(read(spark, sf_dir, "orders"), "o_orderdate", "y", "m").select("o_orderkey", "y", "m")


@query("SELECT c_custkey, ['Texas', 'Ohio', 'XX', 'New York'][c_custkey % 4 + 1] AS state FROM customer")
def state_names(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("TX", "OH", "XX", "NY"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("state"))
    return strings.state_abbrev(df, "state")


@query(HOLES + "SELECT event_id, CAST(user_id AS VARCHAR) || '_' || coalesce(event_type, 'nan') AS k FROM h")
def joined_strings(spark, sf_dir):
    return _holes(spark, sf_dir).select("event_id", strings.join_col_strings(["user_id", "event_type"]).alias("k"))


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.05")
def rows_by_condition(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return transform.select_rows_by_condition_on_columns(df, ["l_discount", "l_tax"], "> 0.05", "and")


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def sql_join(spark, sf_dir):
    tables = [read(spark, sf_dir, t) for t in ("customer", "nation", "orders")]
    return sql_plan.sql(tables, "select n_name, count(*) as n, round(sum(o_totalprice), 2) as spent from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def sql_set_operations(spark, sf_dir):
    frames = {t: read(spark, sf_dir, t) for t in ("customer", "supplier", "nation")}
    return sql_plan.sql(frames, "(select c_nationkey as k from customer where c_acctbal > 5000 intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 0")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sql_top_orders(spark, sf_dir):
    return sql_plan.sql([read(spark, sf_dir, "orders")], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def sql_anti_join(spark, sf_dir):
    frames = {"customer": read(spark, sf_dir, "customer"), "orders": read(spark, sf_dir, "orders")}
    return sql_plan.sql(frames, "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)")


@query("""WITH d AS (SELECT o_custkey, o_orderpriority, o_orderstatus, round(sum(o_totalprice), 4) AS spent FROM orders GROUP BY ALL)
SELECT o_custkey, """ + ", ".join(f"max(spent) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '{p}') AS \"_{s}_{p}\"" for s in ("F", "O", "P") for p in ALL_PRIORITIES) + " FROM d GROUP BY 1")
def long_to_wide_several_columns(spark, sf_dir):
    df = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 4).alias("spent"))
    return transform.long_to_wide(df, "o_custkey", "spent", ["o_orderstatus", "o_orderpriority"], True, [f"_{s}_{p}" for s in ("F", "O", "P") for p in ALL_PRIORITIES])


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus) - 1 AS n FROM d)
SELECT l_suppkey, """ + ", ".join(f"max(l_linestatus) FILTER (n = {k}) AS l_linestatus{k}" for k in range(6)) + " FROM r GROUP BY 1")
def long_to_wide_by_position(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")  # its repeated rows count once
    wide = transform.long_to_wide(df, "l_suppkey", "l_linestatus", columns=range(6), orderby=["l_returnflag", "l_linestatus"])
    return wide.drop("l_returnflag").distinct()


@query(f"""WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, min(l_linenumber) AS l_linenumber_mode FROM c
JOIN (SELECT l_suppkey, max(n) AS n FROM c GROUP BY 1) USING (l_suppkey, n) GROUP BY 1), g AS (SELECT l_suppkey, round(product(1 + l_tax / 1e6), 9) AS x_prod, bool_or(l_discount > 0) AS b_any, bool_and(l_discount > 0) AS b_all FROM lineitem GROUP BY 1)
SELECT {LINE}, x_prod, l_linenumber_mode, b_any, b_all FROM lineitem JOIN m USING (l_suppkey) JOIN g USING (l_suppkey)""")
def groupby_merge_others(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*LINE_KEYS, (1 + F.col("l_tax") / 1e6).alias("x"), (F.col("l_discount") > 0).alias("b"))
    df = merge.groupby_merge(merge.groupby_merge(df, "l_suppkey", "prod", subset="x"), "l_suppkey", ["any", "all"], subset="b")
    return rounded(merge.groupby_merge(df, "l_suppkey", "mode", subset="l_linenumber").drop("x", "b"), "x_prod", digits=9)


@query("SELECT event_id, user_id, round(nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS value_nth FROM events")
def groupby_merge_nth(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(merge.groupby_merge(df, "user_id", "nth", 2, subset="value", orderby="ts"), "value_nth").drop("ts", "value")


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id), 4) AS value FROM events")
def groupby_merge_replace(spark, sf_dir):
    return rounded(merge.groupby_merge(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "mean", subset="value", replace=True), "value")


@query("SELECT event_id, user_id, round(max(value) OVER w - min(value) OVER w, 4) AS value_agg FROM events WINDOW w AS (PARTITION BY user_id)")
def groupby_merge_function(spark, sf_dir):
    df = merge.groupby_merge(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "agg", lambda s: s.max() - s.min(), subset="value")
    return rounded(df, "value_agg").drop("value")


@query("SELECT c_custkey, length(c_mktsegment) AS n, upper(c_mktsegment) = c_mktsegment AS is_upper FROM customer")
def apply_to_unique_two_results(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    found = merge.apply_func_to_unique_and_merge(df, "c_mktsegment", lambda s: s.to_frame().assign(n=s.str.len(), u=s.str.isupper())[["n", "u"]], ["n", "is_upper"], ["long", "boolean"])
    return found.drop("c_mktsegment")


@query("""SELECT o_orderkey, o_orderdate, CAST(2 AS INTEGER) AS "Shift", o_orderdate + to_years(2) AS "Shift Date" FROM orders""")
def expand_time_years(spark, sf_dir):
    return dates.expand_time(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), datevar="o_orderdate", freq="a", time=2)


@query(OPEN.replace(", DATE '2024-01-15', DATE '2024-02-19'", "") + """SELECT event_id, CAST(ts AS DATE) AS day, CAST(o.day AS TIMESTAMP) AS "Daily Date" FROM events JOIN o ON date_trunc('month', o.day) = date_trunc('month', ts)""")
def expand_months_own_holidays(spark, sf_dir):
    import datetime as dt

    df = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return dates.expand_months(df, "day", holidays=[dt.date(2023, 12, 25), dt.date(2024, 1, 1)])


@query("""SELECT c_custkey, c_nationkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS c_acctbal_mean, round(quantile_cont(c_acctbal, 0.25) OVER (PARTITION BY c_nationkey), 4) AS q FROM customer""")
def groupby_merge_quartile(spark, sf_dir):
    df = merge.groupby_merge(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "mean", subset="c_acctbal")
    df = merge.groupby_merge(df, "c_nationkey", "quantile", 0.25, subset="c_acctbal").withColumnRenamed("c_acctbal_quantile", "q")
    return rounded(df, "c_acctbal_mean", "q").drop("c_acctbal")


@query("""SELECT o_orderkey, CAST(1 + (o_totalprice > a)::INT + (o_totalprice > b)::INT AS INTEGER) AS portfolio FROM orders JOIN
(SELECT o_orderpriority, quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.85) AS b FROM orders GROUP BY 1) USING (o_orderpriority)""")
def portfolio_quantile_cutoffs(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return portfolio.portfolio(df, "o_totalprice", quant_cutoffs=[0.1, 0.85], byvars="o_orderpriority").select("o_orderkey", "portfolio")


@query("""WITH g AS (SELECT l_suppkey, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT """ + LINE + """, round(a, 4) AS const, round(b, 4) AS coef_l_quantity FROM lineitem JOIN g USING (l_suppkey)""")
def regression_merged(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_extendedprice", "l_quantity")
    df = regression.reg_by(df, "l_extendedprice", "l_quantity", "l_suppkey", merge=True)
    return rounded(df, "const", "coef_l_quantity").drop("l_extendedprice", "l_quantity")


@query("SELECT n_regionkey AS r, c_mktsegment AS s, count(*) AS n, grouping(n_regionkey) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def sql_cube(spark, sf_dir):
    frames = {t: read(spark, sf_dir, t) for t in ("customer", "nation")}
    return sql_plan.sql(frames, "select n_regionkey as r, c_mktsegment as s, count(*) as n, cast(grouping(n_regionkey) as bigint) as g from customer join nation on c_nationkey = n_nationkey group by cube (n_regionkey, c_mktsegment)")


@query("""SELECT c_custkey AS k FROM customer SEMI JOIN orders ON o_custkey = c_custkey UNION SELECT s_suppkey FROM supplier UNION ALL SELECT a.r_regionkey * 10 + b.r_regionkey FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey""")
def sql_semi_cross_union(spark, sf_dir):
    frames = {t: read(spark, sf_dir, t) for t in ("customer", "orders", "supplier", "region")}
    return sql_plan.sql(frames, "select c_custkey as k from customer left semi join orders on o_custkey = c_custkey union select s_suppkey from supplier union all select a.r_regionkey * 10 + b.r_regionkey from region a cross join region b where a.r_regionkey < b.r_regionkey")


@query("""WITH e AS (SELECT event_id, ts, 1 + value / 1e7 AS r, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events),
w AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE 1 + (p > 20)::INT + (p > 3000)::INT END AS win FROM e)
SELECT event_id, round(r, 9) AS r, round(product(r) OVER (PARTITION BY win ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 7) AS cum_r FROM w""")
def cumulate_whole_table(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "ts", (1 + F.col("value") / 1e7).alias("r"))
    return rounded(rounded(transform.cumulate(df, "r", "between", "ts", time=[1, 21, 3001]), "r", digits=9), "cum_r", digits=7).drop("ts")


PADDED = f"""WITH d AS ({DAILY}), f AS (SELECT u.user_id, x.day, d.total FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN (SELECT DISTINCT day FROM d) x LEFT JOIN d ON d.user_id = u.user_id AND d.day = x.day)
"""


@query(PADDED + "SELECT user_id, day, first_value(total IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS total FROM f")
def add_missing_rows_backwards(spark, sf_dir):
    return fill.add_missing_group_rows(_daily(spark, sf_dir), "user_id", "day", "bfill", 2)


@query(PADDED + "SELECT * FROM f")
def add_missing_rows_unfilled(spark, sf_dir):
    return fill.add_missing_group_rows(_daily(spark, sf_dir), "user_id", "day", None)


@query(f"""WITH d AS ({DAILY}) SELECT u.user_id, x.day, coalesce(d.total, 0) AS total FROM (SELECT DISTINCT user_id FROM d) u
CROSS JOIN (SELECT CAST(t AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) s(t)) x LEFT JOIN d ON d.user_id = u.user_id AND d.day = x.day""")
def fill_excluded_given_days(spark, sf_dir):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-10')) as day")
    return fill.fill_excluded_rows(_daily(spark, sf_dir), ["user_id", days], "total", 0)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS group_index FROM events")
def groupby_index_descending(spark, sf_dir):
    return merge.groupby_index(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ascending=False).select("event_id", "user_id", "group_index")


@query("SELECT c_custkey, ['TX', 'OH', 'Nowhere', 'NY'][c_custkey % 4 + 1] AS state FROM customer")
def state_abbreviations(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("Texas", "Ohio", "Nowhere", "New York"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("state"))
    return strings.state_abbrev(df, "state", toabbrev=True)


@query(PORT_AVG.replace("GROUP BY 1, 2)", "GROUP BY 1, 2), h AS (SELECT portfolio, avg(l_discount) AS d FROM p GROUP BY 1)") + "SELECT round((SELECT d FROM h WHERE portfolio = 4) - (SELECT d FROM h WHERE portfolio = 1), 6) AS l_discount")
def long_short_whole(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_quantity", "l_extendedprice")
    _, rows = portfolio.portfolio_averages(df, "l_extendedprice", "l_discount", 4, "l_returnflag")
    return rounded(portfolio.long_short_portfolio(transform.averages(rows, "l_discount", "portfolio"), "portfolio", retvars="l_discount"), "l_discount", digits=6)
