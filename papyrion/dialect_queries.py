"""Queries that exercise the dialect over the star-schema tables, and the SQL they are checked with.

Each entry is a batch of dialect text whose last statement gives the rows, and equivalent SQL for the
same tables (None where SQL cannot say it). All read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrion.engine import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _engine(spark: SparkSession, folder: str, text: str) -> Engine:
    engine = Engine(spark)
    lowered = text.lower()
    engine.register_folder(folder, [t for t in TABLES if t in lowered])
    return engine


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _engine(spark, folder, text).sql(text)

    return run


FLAGSHIP = """
SELECT TOP 10 n.n_name AS nation, Count(*) AS orders, Sum(o.o_totalprice) AS revenue
FROM orders AS o
INNER JOIN customer AS c ON c.c_custkey = o.o_custkey
INNER JOIN nation AS n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F' GROUP BY n.n_name ORDER BY Sum(o.o_totalprice) DESC
"""

_BY_NATION = "FROM customer AS c INNER JOIN nation AS n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name"
_SQL_BY_NATION = "FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name"


def _aggregate(call: str, sql: str | None) -> tuple[str, str | None]:
    return f"SELECT n.n_name AS nation, {call} AS value {_BY_NATION}", sql and f"SELECT n.n_name AS nation, {sql} AS value {_SQL_BY_NATION}"


#: name -> (dialect text, SQL or None)
BATCHES: dict[str, tuple[str, str | None]] = {
    # scans and projections
    "flagship": (FLAGSHIP.replace("Sum(o.o_totalprice) AS", "Round(Sum(o.o_totalprice), 2) AS"), "SELECT n_name AS nation, count(*) AS orders, round_even(sum(o_totalprice)::DECIMAL(38,6), 2)::DOUBLE AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY sum(o_totalprice) DESC LIMIT 10"),
    "scan_full": ("SELECT * FROM customer", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer"),
    "select_star_sorted": ("SELECT * FROM nation AS n INNER JOIN region AS r ON r.r_regionkey = n.n_regionkey", 'SELECT n_name AS "n.n_name", n_nationkey AS "n.n_nationkey", n_regionkey AS "n.n_regionkey", r_name AS "r.r_name", r_regionkey AS "r.r_regionkey" FROM nation JOIN region ON r_regionkey = n_regionkey'),
    "select_alias_star": ("SELECT r.* FROM nation AS n INNER JOIN region AS r ON r.r_regionkey = n.n_regionkey", 'SELECT r_name AS "r.r_name", r_regionkey AS "r.r_regionkey" FROM nation JOIN region ON r_regionkey = n_regionkey'),
    "select_expr_alias": ("SELECT p_partkey, p_retailprice * 2 - p_size AS doubled, p_brand AS 'the brand' FROM part", "SELECT p_partkey, p_retailprice * 2 - p_size AS doubled, p_brand AS \"the brand\" FROM part"),
    "select_unnamed": ("SELECT n_nationkey + 1, n_name, n_nationkey * 2 FROM nation", 'SELECT (n_nationkey + 1)::DOUBLE AS "Expression0", n_name, (n_nationkey * 2)::DOUBLE AS "Expression1" FROM nation'),
    "unknown_column_null": ("SELECT r_name, no_such_field FROM region", "SELECT r_name, NULL::VARCHAR AS no_such_field FROM region"),
    # fixed values: constant expressions whose results are pinned
    "single_constants": ("SELECT 10 + 10 + 'Text' AS a, 'Text' + 10 + 10 AS b, 10 + 10 + (11 ^ 3) + 10 + '->' AS c, 11 ^ (2 + 1) + 'ten' + (Length('A10CharStr') * 10 + 2) AS d, value FROM Single", "SELECT '20Text' AS a, 'Text20' AS b, '2810->' AS c, '8ten102' AS d, NULL::VARCHAR AS value"),
    "declared_variable": ("DECLARE @least = 7000 SELECT c_custkey FROM customer WHERE c_acctbal > @least", "SELECT c_custkey FROM customer WHERE c_acctbal > 7000"),
    # predicates
    "where_eq_ci": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "where_neq_nullsafe": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'f'", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IS DISTINCT FROM 'f'"),
    "where_gt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45"),
    "where_lt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice < 2000", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice < 2000"),
    "where_gte": ("SELECT p_partkey FROM part WHERE p_size >= 40", "SELECT p_partkey FROM part WHERE p_size >= 40"),
    "where_lte": ("SELECT s_suppkey FROM supplier WHERE s_acctbal <= 100", "SELECT s_suppkey FROM supplier WHERE s_acctbal <= 100"),
    "where_like_prefix": ("SELECT n_name FROM nation WHERE n_name LIKE 'nation_1%'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'"),
    "where_like_suffix": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%EL'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%el'"),
    "where_not_like": ("SELECT p_partkey FROM part WHERE p_brand NOT LIKE '%#1%'", "SELECT p_partkey FROM part WHERE p_brand NOT ILIKE '%#1%'"),
    "where_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN '10:20'", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
    "where_between_ansi": ("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1995-03-31'", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'"),
    "where_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN '10:20'", "SELECT p_partkey FROM part WHERE NOT p_size BETWEEN 10 AND 20"),
    "where_nested_and_or": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_orderpriority LIKE '1%')) OR (o_orderstatus = 'P' AND o_totalprice < 50000)", "SELECT o_orderkey FROM orders WHERE (lower(o_orderstatus) = 'f' AND (o_totalprice > 300000 OR o_orderpriority ILIKE '1%')) OR (lower(o_orderstatus) = 'p' AND o_totalprice < 50000)"),
    "where_null_flag": ("SELECT c_custkey FROM customer WHERE IsNull(c_name) = false AND IsBetween(c_nationkey, 3, 5) = true", "SELECT c_custkey FROM customer WHERE c_name IS NOT NULL AND c_nationkey BETWEEN 3 AND 5"),
    # joins
    "join_inner": ("SELECT c.c_name, n.n_name FROM customer AS c INNER JOIN nation AS n ON n.n_nationkey = c.c_nationkey", "SELECT c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "join_inner_multi_key": ("SELECT a.l_orderkey, a.l_linenumber, b.l_extendedprice FROM lineitem AS a INNER JOIN lineitem AS b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber", "SELECT a.l_orderkey, a.l_linenumber, b.l_extendedprice FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber"),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer AS c OUTER JOIN orders AS o ON o.o_custkey = c.c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "join_left_anti_idiom": ("SELECT c.c_custkey FROM customer AS c OUTER JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE IsNull(o.o_orderkey) = true", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_theta": ("SELECT a.n_name AS low, b.n_name AS high FROM nation AS a INNER JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "join_self": ("SELECT a.s_name AS a, b.s_name AS b FROM supplier AS a INNER JOIN supplier AS b ON b.s_nationkey = a.s_nationkey WHERE a.s_suppkey != b.s_suppkey", "SELECT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey WHERE a.s_suppkey <> b.s_suppkey"),
    "join_five_way": ("SELECT r.r_name AS region, c.c_mktsegment AS segment, Count(0) AS items, Round(Avg(l.l_quantity), 4) AS quantity FROM lineitem AS l INNER JOIN orders AS o ON o.o_orderkey = l.l_orderkey INNER JOIN customer AS c ON c.c_custkey = o.o_custkey INNER JOIN nation AS n ON n.n_nationkey = c.c_nationkey INNER JOIN region AS r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, c.c_mktsegment ORDER BY Avg(l.l_quantity / 60) ASC", "SELECT r_name AS region, c_mktsegment AS segment, count(*) AS items, round_even(avg(l_quantity)::DECIMAL(38,12), 4)::DOUBLE AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, c_mktsegment"),
    # aggregates
    "agg_count": _aggregate("Count(c.c_custkey)", "count(c_custkey)"),
    "agg_count_distinct_ci": _aggregate("CountDistinct(c.c_mktsegment)", "count(DISTINCT lower(c_mktsegment))"),
    "agg_count_distinct_cs": _aggregate("CountDistinct(c.c_mktsegment, true)", "count(DISTINCT c_mktsegment)"),
    "agg_sum": _aggregate("Round(Sum(c.c_acctbal), 2)", "round_even(sum(c_acctbal)::DECIMAL(38,6), 2)::DOUBLE"),
    "agg_avg": _aggregate("Round(Avg(c.c_acctbal), 4)", "round_even(avg(c_acctbal)::DECIMAL(38,12), 4)::DOUBLE"),
    "agg_mean": _aggregate("Round(Mean(c.c_acctbal / 2), 4)", "round_even(avg(c_acctbal / 2)::DECIMAL(38,12), 4)::DOUBLE"),
    "agg_min": _aggregate("Min(c.c_acctbal)", "min(c_acctbal)"),
    "agg_max": _aggregate("Max(c.c_acctbal)", "max(c_acctbal)"),
    "agg_min_string": _aggregate("MinString(c.c_name)", "min(c_name)"),
    "agg_max_string": _aggregate("MaxString(c.c_name)", "max(c_name)"),
    "agg_median": _aggregate("Median(c.c_acctbal)", "median(c_acctbal)"),
    "agg_mode": ("SELECT l_returnflag AS flag, Mode(l_linenumber) AS value FROM lineitem GROUP BY l_returnflag", "SELECT flag, min(l_linenumber)::DOUBLE AS value FROM (SELECT l_returnflag AS flag, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1 GROUP BY flag"),
    "agg_variance": _aggregate("Round(Variance(c.c_nationkey + c.c_acctbal / 1000), 4)", "round_even(var_pop(c_nationkey + c_acctbal / 1000)::DECIMAL(38,12), 4)::DOUBLE"),
    "agg_geometric_mean": ("SELECT p_brand AS brand, Round(GeometricMean(p_retailprice), 4) AS value FROM part GROUP BY p_brand", "SELECT p_brand AS brand, round_even(exp(avg(ln(p_retailprice)))::DECIMAL(38,12), 4)::DOUBLE AS value FROM part GROUP BY p_brand"),
    "agg_sha1": _aggregate("Sha1Agg(c.c_name)", "sha1(string_agg(c_name, '' ORDER BY c_name))"),
    "agg_sha256": _aggregate("Sha256Agg(c.c_name)", "sha256(string_agg(c_name, '' ORDER BY c_name))"),
    "agg_sha512": _aggregate("Sha512Agg(c.c_name)", None),
    "agg_global": ("SELECT Count(*) AS n, Min(l_quantity) AS low, Max(l_quantity) AS high FROM lineitem", "SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem"),
    "agg_global_empty": ("SELECT Count(*) AS n FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0"),
    "group_by_expr": ("SELECT ToUpper(Left(c_mktsegment, 2)) AS part, Count(0) AS n FROM customer GROUP BY ToUpper(Left(c_mktsegment, 2))", "SELECT upper(left(c_mktsegment, 2)) AS part, count(*) AS n FROM customer GROUP BY 1"),
    "scalar_over_agg": ("SELECT o_orderpriority, FormatNumeric(Round(Avg(o_totalprice)), 'n2') AS average, Count(0) * 2 + 1 AS twice FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, format('{:,.2f}', round_even(avg(o_totalprice)::DECIMAL(38,12), 0)::DOUBLE) AS average, (count(*) * 2 + 1)::DOUBLE AS twice FROM orders GROUP BY o_orderpriority"),
    "order_by_agg": ("SELECT TOP 5 o_custkey, Count(0) AS n FROM orders GROUP BY o_custkey ORDER BY Count(0) DESC, o_custkey", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 5"),
    # order, limits, distinct
    "order_multi": ("SELECT TOP 50 c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY lower(c_mktsegment) DESC, c_acctbal, c_custkey LIMIT 50"),
    "top_n": ("SELECT TOP 25 p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25"),
    "top_offset": ("SELECT TOP 20 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 30", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30"),
    "offset_past_end": ("SELECT r_name FROM region ORDER BY r_name OFFSET 100", "SELECT r_name FROM region WHERE false"),
    "distinct_pre_top": ("SELECT DISTINCT TOP 3 c_mktsegment FROM customer ORDER BY c_mktsegment", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 3"),
    "distinct_post_top": ("SELECT TOP 40 DISTINCT o_orderstatus FROM orders ORDER BY o_orderkey", "SELECT DISTINCT o_orderstatus FROM (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 40)"),
    "distinct_ci": ("SELECT DISTINCT IIF(IsGreater(c_acctbal, 0), ToUpper(c_mktsegment), ToLower(c_mktsegment)) AS segment FROM customer", "SELECT min(s) AS segment FROM (SELECT CASE WHEN c_acctbal > 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS s FROM customer) GROUP BY lower(s)"),
    # scalar functions
    "fn_string": ("SELECT p_partkey, ToUpper(p_name) AS a, ToLower(p_brand) AS b, Length(p_name) AS c, Left(p_name, 3) AS d, Right(p_name, 3) AS e, Concat(p_brand, '-', p_size, null) AS f, Trim(p_brand, 'B#4') AS g, Trim('  x ') AS h FROM part", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, length(p_name)::INTEGER AS c, left(p_name, 3) AS d, right(p_name, 3) AS e, concat(p_brand, '-', p_size) AS f, trim(p_brand, 'B#4') AS g, 'x' AS h FROM part"),
    "fn_to_proper": ("SELECT n_nationkey, ToProper(Concat('the ', n_name, ' of')) AS proper FROM nation", "SELECT n_nationkey, list_aggregate(list_transform(string_split('the ' || n_name || ' of', ' '), lambda w: CASE WHEN length(w) > 1 AND upper(w) = w AND lower(w) <> w THEN w ELSE upper(w[1]) || lower(w[2:]) END), 'string_agg', ' ') AS proper FROM nation"),
    "fn_substring_index": ("SELECT p_partkey, SubString(p_type, 2, 4) AS a, IndexOf('E', p_type) AS b, LastIndexOf('e', p_type) AS c, IndexOf('no such', p_type) AS d FROM part", "SELECT p_partkey, substr(p_type, 3, 4) AS a, (strpos(lower(p_type), 'e') - 1)::INTEGER AS b, (CASE WHEN strpos(reverse(lower(p_type)), 'e') = 0 THEN -1 ELSE length(p_type) - strpos(reverse(lower(p_type)), 'e') END)::INTEGER AS c, -1 AS d FROM part"),
    "fn_math": ("SELECT c_custkey, Abs(c_acctbal) AS a, Ceil(c_acctbal) AS b, Floor(c_acctbal) AS c, Pow(c_nationkey, 2) AS d, ToNumeric('12.5') AS e, c_nationkey % 7 AS f, 7 / 2 AS g FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, pow(c_nationkey, 2) AS d, 12.5::DOUBLE AS e, (c_nationkey % 7)::DOUBLE AS f, 3.5::DOUBLE AS g FROM customer"),
    "fn_round_bankers": ("SELECT p_partkey, Round(p_size / 2) AS a, Round(p_retailprice, 1) AS b FROM part", "SELECT p_partkey, round_even((p_size / 2)::DECIMAL(38,12), 0)::DOUBLE AS a, round_even(p_retailprice::DECIMAL(38,12), 1)::DOUBLE AS b FROM part"),
    "fn_date_add": ("SELECT o_orderkey, DateAdd(o_orderdate, 'Month', 1) AS a, DateAdd(o_orderdate, 'day', -10) AS b, DateAdd(o_orderdate, 'qq', 2) AS c, DateAdd(o_orderdate, 'hh', 36) AS d, DateAdd(o_orderdate, 'year', 1) AS e, DateAdd(o_orderdate, 'ww', 1) AS f FROM orders", "SELECT o_orderkey, date_trunc('second', o_orderdate + INTERVAL 1 MONTH) AS a, date_trunc('second', o_orderdate - INTERVAL 10 DAY) AS b, date_trunc('second', o_orderdate + INTERVAL 6 MONTH) AS c, date_trunc('second', o_orderdate + INTERVAL 36 HOUR) AS d, date_trunc('second', o_orderdate + INTERVAL 1 YEAR) AS e, date_trunc('second', o_orderdate + INTERVAL 7 DAY) AS f FROM orders"),
    "fn_date_diff": ("SELECT l_orderkey, l_linenumber, DateDiff(o.o_orderdate, l.l_shipdate, 'day') AS days, DateDiff(o.o_orderdate, l.l_shipdate, 'month') AS months, DateDiff(o.o_orderdate, l.l_shipdate, 'weekday') AS working, DateDiff(o.o_orderdate, l.l_shipdate, 'minute') AS minutes FROM lineitem AS l INNER JOIN orders AS o ON o.o_orderkey = l.l_orderkey", "SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10 AS days, ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) - CASE WHEN day(l_shipdate) < day(o_orderdate) THEN 1 ELSE 0 END)::DOUBLE AS months, (SELECT count(*) FROM range(least(o_orderdate, l_shipdate)::DATE, greatest(o_orderdate, l_shipdate)::DATE + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)::DOUBLE AS working, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6e7 AS minutes FROM lineitem JOIN orders ON o_orderkey = l_orderkey"),
    "fn_to_string": ("SELECT c_custkey, ToString(c_custkey * 2) AS a, ToString(c_nationkey / 4) AS b FROM customer", "SELECT c_custkey, (c_custkey * 2)::VARCHAR AS a, regexp_replace((c_nationkey / 4)::VARCHAR, '\\.0$', '') AS b FROM customer"),
    "fn_date_units": ("SELECT o_orderkey, DateAdd(o_orderdate, 'dayofyear', 3) AS a, DateAdd(o_orderdate, 'minute', 90) AS b, DateAdd(o_orderdate, 'second', -5) AS c, DateAdd(o_orderdate, 'ms', 4500) AS d, DateAdd(o_orderdate, 'quarter', -1) AS e, DateDiff(o_orderdate, '2005-12-31', 'dayofyear') AS f, DateDiff(o_orderdate, '2005-12-31', 'year') AS g, DateDiff(o_orderdate, '2005-12-31', 'week') AS h, DateDiff(o_orderdate, '2005-12-31', 'hour') AS i, DateDiff(o_orderdate, '2005-12-31', 'second') AS j, DateDiff(o_orderdate, '2005-12-31', 'millisecond') AS k FROM orders", "SELECT o_orderkey, date_trunc('second', o_orderdate + INTERVAL 3 DAY)::TIMESTAMP AS a, date_trunc('second', o_orderdate + INTERVAL 90 MINUTE)::TIMESTAMP AS b, date_trunc('second', o_orderdate - INTERVAL 5 SECOND)::TIMESTAMP AS c, date_trunc('second', o_orderdate + INTERVAL 4500 MILLISECOND)::TIMESTAMP AS d, date_trunc('second', o_orderdate - INTERVAL 3 MONTH)::TIMESTAMP AS e, date_diff('day', o_orderdate::DATE, DATE '2005-12-31')::DOUBLE AS f, date_sub('year', o_orderdate::TIMESTAMP, TIMESTAMP '2005-12-31')::DOUBLE AS g, (epoch_us(TIMESTAMP '2005-12-31') - epoch_us(o_orderdate)) / 6.048e11 AS h, (epoch_us(TIMESTAMP '2005-12-31') - epoch_us(o_orderdate)) / 3.6e9 AS i, (epoch_us(TIMESTAMP '2005-12-31') - epoch_us(o_orderdate)) / 1e6 AS j, (epoch_us(TIMESTAMP '2005-12-31') - epoch_us(o_orderdate)) / 1e3 AS k FROM orders"),
    "fn_format_datetime": ("SELECT o_orderkey, FormatDateTime(o_orderdate, 'yyyy/MM/dd hh:mm:ss.fff tt') AS a, FormatDateTime(o_orderdate, 'yyyy-MM') AS b FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %I:%M:%S.%g %p') AS a, strftime(o_orderdate, '%Y-%m') AS b FROM orders"),
    "fn_format_numeric": ("SELECT c_custkey, FormatNumeric(c_nationkey * 1000 + 0.25, 'n1') AS a, FormatNumeric(c_nationkey, 'f3') AS b, FormatNumeric(c_custkey, 'n0') AS c FROM customer", "SELECT c_custkey, format('{:,.1f}', (c_nationkey * 1000 + 0.3)::DOUBLE) AS a, format('{:.3f}', c_nationkey::DOUBLE) AS b, format('{:,}', c_custkey) AS c FROM customer"),
    "fn_null_handling": ("SELECT o_orderkey, NullIf(o_orderstatus, IsEqual(o_orderstatus, 'F')) AS a, IfNull(NullIf(o_orderstatus, IsEqual(o_orderstatus, 'F')), 'none') AS b, Coalesce(null, o_orderpriority) AS c, NullIfNumeric(o_totalprice, IsGreater(o_totalprice, 1000)) AS d, IfNullNumeric(null, 20) + 10 AS e, IIF(IsLess(o_totalprice, 100000), 'small', 'large') AS f, NullIf('x', true) + 'y' AS g FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS a, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS b, o_orderpriority AS c, CASE WHEN NOT o_totalprice > 1000 THEN o_totalprice END AS d, 30::DOUBLE AS e, CASE WHEN o_totalprice < 100000 THEN 'small' ELSE 'large' END AS f, NULL::VARCHAR AS g FROM orders"),
    "fn_predicates": ("SELECT p_partkey, IsBetween(p_size, 10, 20) AS a, IsNotBetween(p_size, 10, 20) AS b, IsEqual(p_brand, 'Brand#11') AS c, IsNotEqual(p_brand, 'Brand#11') AS d, IsGreater(p_size, 25) AS e, IsGreaterOrEqual(p_size, 25) AS f, IsLess(p_size, 25) AS g, IsLessOrEqual(p_size, 25) AS h, IsLike(p_type, '%e%') AS i, IsNotLike(p_type, '%e%') AS j, IsNull(p_type) AS k, IsDouble('1.5') AS l, IsString(p_brand) AS m, IsInteger('x') AS n FROM part", "SELECT p_partkey, (p_size BETWEEN 10 AND 20)::INTEGER AS a, (NOT p_size BETWEEN 10 AND 20)::INTEGER AS b, (p_brand = 'Brand#11')::INTEGER AS c, (p_brand <> 'Brand#11')::INTEGER AS d, (p_size > 25)::INTEGER AS e, (p_size >= 25)::INTEGER AS f, (p_size < 25)::INTEGER AS g, (p_size <= 25)::INTEGER AS h, (p_type ILIKE '%e%')::INTEGER AS i, (p_type NOT ILIKE '%e%')::INTEGER AS j, 0 AS k, 1 AS l, 1 AS m, 1 AS n FROM part"),
    "fn_hash": ("SELECT n_nationkey, Sha1(n_name) AS a, Sha256(n_name) AS b FROM nation", "SELECT n_nationkey, sha1(n_name) AS a, sha256(n_name) AS b FROM nation"),
    "fn_sha512": ("SELECT n_nationkey, Sha512(n_name) AS a FROM nation", None),
    "fn_checksum": ("SELECT p_partkey, Checksum(p_name) AS sum FROM part", "SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: (s + xor(s, b)) % 65536)::INTEGER AS sum FROM part"),
    "fn_identity": ("SELECT r_regionkey, DocumentID('r') AS a, DocumentPage('r') AS b, DocumentUID('r') AS c, Length(Guid()) AS d FROM region", "SELECT r_regionkey, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, 36 AS d FROM region"),
    "fn_now": ("SELECT Length(DateTime()) AS a, Length(DateTimeUTC('yyyy/MM/dd hh:mm:ss tt')) AS b FROM Single", "SELECT 23 AS a, 22 AS b"),
    "expr_concat_numeric_run": ("SELECT n_nationkey, n_name + n_nationkey + 10 + ':' + (n_nationkey * 2) + 1 AS text FROM nation", "SELECT n_nationkey, n_name || (n_nationkey + 10) || ':' || (n_nationkey * 2) || 1 AS text FROM nation"),
    "expr_bitwise_xor": ("SELECT p_partkey, p_partkey ^ p_size AS a, p_partkey & 7 AS b, p_partkey | 8 AS c FROM part", "SELECT p_partkey, xor(p_partkey, p_size)::DOUBLE AS a, (p_partkey & 7)::DOUBLE AS b, (p_partkey | 8)::DOUBLE AS c FROM part"),
    # changes of data
    "insert_values": ("INSERT INTO T:Rows (Id, Name) VALUES (1, 'Jane'), (2, 'John' + ' ' + 'Doe'), (3, Sha1('x')) SELECT * FROM T:Rows", "SELECT * FROM (VALUES (1, 'Jane'), (2, 'John Doe'), (3, sha1('x'))) t(\"Id\", \"Name\")"),
    "insert_ragged": ("INSERT INTO T:Rows (First: 'John', Last: 'Doe'), (First: 'Fred', Middle: 'Dean', Last: 'Doe') SELECT * FROM T:Rows", "SELECT * FROM (VALUES ('John', 'Doe', NULL), ('Fred', 'Doe', 'Dean')) t(\"First\", \"Last\", \"Middle\")"),
    "insert_select": ("INSERT INTO nation (n_nationkey, n_name) SELECT r_regionkey + 100, r_name FROM region SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region"),
    "select_into": ("SELECT c_custkey, c_name INTO #rich FROM customer WHERE c_acctbal > 5000 SELECT r.c_custkey, r.c_name FROM #rich AS r", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000"),
    "update_where": ("UPDATE customer SET c_acctbal = c_acctbal + 1, flagged = 'yes' WHERE c_mktsegment = 'BUILDING' SELECT c_custkey, c_acctbal, flagged FROM customer", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN lower(c_mktsegment) = 'building' THEN 'yes' END AS flagged FROM customer"),
    "update_join": ("UPDATE c SET c_name = n.n_name FROM nation AS n INNER JOIN customer AS c ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "delete_where": ("DELETE FROM orders WHERE o_orderstatus = 'F' SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IS DISTINCT FROM 'f'"),
    "delete_join": ("DELETE o FROM customer AS c INNER JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0 SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "transaction_rollback": ("BEGIN TRANSACTION DELETE FROM region WHERE r_regionkey > 1 ROLLBACK TRANSACTION SELECT r_name FROM region", "SELECT r_name FROM region"),
    # maintenance
    "analyze_schema": ("ANALYZE SCHEMA nation", "SELECT count(*) AS documents, ceil(count(*) / 100)::BIGINT AS pages, 100 AS page_size, min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length FROM (SELECT length(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR)::INTEGER AS n FROM nation)"),
    "analyze_index": ("CREATE INDEX ix_nation(c_nationkey) ON customer ANALYZE INDEX ix_nation ON customer", "SELECT count(*) AS keys, sum(n)::BIGINT AS rows, min(n) AS min_rows, max(n) AS max_rows, avg(n) AS avg_rows, 100 - avg(n) / sum(n) * 100 AS selectivity FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)"),
    "list_documents": ("LIST DOCUMENTS region SIZE 5", "SELECT r_regionkey, r_name FROM region"),
    "list_schemas": ("LIST SCHEMAS :", "SELECT 'Single' AS \"Name\", 'Single' AS \"Path\""),
    "sample": ("SAMPLE customer SIZE 20", None),
}


def unique_key_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that would break a unique key over part of lineitem's fields."""
    from papyrion.plans.changes import duplicates
    from papyrion.sources.catalog import Index

    frame = _engine(spark, folder, "lineitem").catalog.frame("lineitem")
    return duplicates(frame, Index("uk", ("l_orderkey", "l_suppkey"), True)).toDF("orderkey", "suppkey", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(text) for name, (text, _) in BATCHES.items()} | {"unique_key_violations": unique_key_violations}
SQL: dict[str, str] = {name: sql for name, (_, sql) in BATCHES.items() if sql} | {
    "unique_key_violations": "SELECT l_orderkey::VARCHAR AS orderkey, l_suppkey::VARCHAR AS suppkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1"
}
