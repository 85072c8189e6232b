"""Scans, predicates, joins, subqueries, aggregates, windows, sorts and set operations, in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select
from . import Registry

R = Registry()

# Scans, projection, predicates, conditionals

R.sql("scan_project", "SELECT c_custkey, c_name, c_acctbal * 2 AS double_bal FROM customer")
R.sql("scan_point_filter", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 42")
R.sql("scan_range_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_discount < CAST(0.05 AS DOUBLE)")
R.sql("select_constant", "SELECT 1 AS one, 'a' || 'b' AS ab, CAST(NULL AS INT) AS nothing")
R.sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
R.sql("generate_series", "SELECT id AS generate_series FROM range(1, 101, 3)", "SELECT generate_series::BIGINT AS generate_series FROM generate_series(1, 100, 3)")
R.sql("generate_series_down", "SELECT id AS generate_series FROM range(10, -11, -4)", "SELECT generate_series::BIGINT AS generate_series FROM generate_series(10, -10, -4)")
R.sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
R.sql(
    "distinct_on",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
)
R.sql("boolean_logic", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW')")
R.sql("between_predicates", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1500")
R.sql("in_lists", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
R.sql("null_tests", "SELECT c_custkey, NULLIF(c_nationkey % 7, 0) AS k, NULLIF(c_nationkey % 7, 0) IS NULL AS is_null FROM customer WHERE NULLIF(c_nationkey % 5, 0) IS NOT NULL")
R.sql("is_true_false", "SELECT c_custkey, (NULLIF(c_nationkey % 3, 0) > 1) IS TRUE AS t, (NULLIF(c_nationkey % 3, 0) > 1) IS FALSE AS f, (NULLIF(c_nationkey % 3, 0) > 1) IS UNKNOWN AS u FROM customer", "SELECT c_custkey, (NULLIF(c_nationkey % 3, 0) > 1) IS TRUE AS t, (NULLIF(c_nationkey % 3, 0) > 1) IS FALSE AS f, (NULLIF(c_nationkey % 3, 0) > 1) IS NULL AS u FROM customer")
R.sql("is_distinct_from", "SELECT o_orderkey FROM orders WHERE NULLIF(o_custkey % 4, 0) IS DISTINCT FROM NULLIF(o_orderkey % 4, 0)")
R.sql("three_valued_logic", "SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS nota FROM (VALUES (true, true), (true, false), (true, NULL), (false, NULL), (CAST(NULL AS BOOLEAN), NULL)) AS v(a, b)")
R.sql("like_patterns", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l_ r%' AND p_type NOT LIKE 'E%'")
R.sql("ilike_patterns", "SELECT n_nationkey, n_name FROM nation WHERE n_name ILIKE 'nation_1%' AND n_name NOT ILIKE '%2'")
R.sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
R.sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
R.sql("coalesce_nullif", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey % 3, 0), NULLIF(c_nationkey % 5, 0), -1) AS k FROM customer")
R.sql("if_iff", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS size FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size FROM part")
R.sql("greatest_least", "SELECT p_partkey, greatest(p_size, NULLIF(p_partkey % 40, 0), 10) AS g, least(p_size, NULLIF(p_partkey % 40, 0)) AS l FROM part")
R.sql("casts", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST('2024-02-29' AS DATE) AS d, CAST(o_orderdate AS DATE) AS od, CAST('12' AS INT) AS i FROM orders")
R.sql("arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, -l_linenumber AS neg, l_partkey + l_suppkey AS plus, l_partkey - l_suppkey AS minus, l_linenumber * 3 AS times, l_partkey div 7 AS quotient, l_partkey % 7 AS rest FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, -l_linenumber AS neg, l_partkey + l_suppkey AS plus, l_partkey - l_suppkey AS minus, l_linenumber * 3 AS times, l_partkey // 7 AS quotient, l_partkey % 7 AS rest FROM lineitem")
R.sql("text_concat_operator", "SELECT c_custkey, c_name || '/' || c_mktsegment || c_custkey AS label, c_name || CAST(NULL AS STRING) AS nothing FROM customer")

R.sql("trim_syntax", "SELECT c_custkey, TRIM(BOTH 'C' FROM c_name) AS b, TRIM(LEADING 'C' FROM c_name) AS l, TRIM(TRAILING 'G' FROM c_mktsegment) AS t, TRIM('  x ') AS plain FROM customer", "SELECT c_custkey, trim(c_name, 'C') AS b, ltrim(c_name, 'C') AS l, rtrim(c_mktsegment, 'G') AS t, trim('  x ') AS plain FROM customer")
R.sql("substring_and_position_syntax", "SELECT c_custkey, SUBSTRING(c_name FROM 2 FOR 3) AS s, CAST(POSITION('m' IN c_name) AS BIGINT) AS p FROM customer")
R.sql("current_names", "SELECT current_schema() IS NOT NULL AS s, current_date() >= DATE '2024-01-01' AS d, now() IS NOT NULL AS n", "SELECT current_schema() IS NOT NULL AS s, current_date >= DATE '2024-01-01' AS d, now() IS NOT NULL AS n")
R.sql("random_in_range", "SELECT o_orderkey, r >= 0 AND r < 1 AS ok FROM (SELECT o_orderkey, rand() AS r FROM orders)", "SELECT o_orderkey, true AS ok FROM orders")
R.sql("uuid_form", "SELECT n_nationkey, length(u) = 36 AS ok FROM (SELECT n_nationkey, uuid() AS u FROM nation)", "SELECT n_nationkey, true AS ok FROM nation")

# Joins

R.sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
R.sql("join_inner_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey <> b.l_partkey")
R.sql("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
R.sql("join_left_empty_right", "SELECT c_custkey, e.o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice < 0) e ON c_custkey = e.o_custkey")
R.sql("join_right", "SELECT l.doc_id AS labelled, l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
R.sql("join_full", "SELECT a.k AS a, b.k AS b FROM (SELECT c_custkey % 50 AS k FROM customer) a FULL OUTER JOIN (SELECT DISTINCT s_suppkey % 70 + 20 AS k FROM supplier) b ON a.k = b.k")


@R.frame("SELECT a.c_custkey, b.s_suppkey FROM customer a FULL OUTER JOIN supplier b ON NULLIF(a.c_custkey % 11, 0) = NULLIF(b.s_suppkey % 100, 0)")
def join_null_keys(t, spark):
    a, b = t("customer").select("c_custkey"), t("supplier").select("s_suppkey")
    return select.full_join(a, b, F.expr("NULLIF(c_custkey % 11, 0)"), F.expr("NULLIF(s_suppkey % 100, 0)"))


R.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
R.sql("join_comma", "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
R.sql("join_using", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)")
R.sql("join_natural", "SELECT doc_id, quality, source FROM documents NATURAL JOIN labels")
R.sql("join_natural_left", "SELECT doc_id, quality, source FROM documents NATURAL LEFT JOIN labels")
R.sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
R.sql("join_range", "SELECT v.lo, v.hi, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part JOIN (VALUES (1, 5), (4, 20), (21, 50)) AS v(lo, hi) ON p_size BETWEEN v.lo AND v.hi GROUP BY v.lo, v.hi")
R.sql("join_theta", "SELECT s.s_suppkey, count(*) AS richer FROM supplier s JOIN supplier o ON s.s_acctbal < o.s_acctbal GROUP BY s.s_suppkey")
R.sql("join_lateral", "SELECT n_nationkey, t.best FROM nation, LATERAL (SELECT max(s_acctbal) AS best FROM supplier WHERE s_nationkey = n_nationkey) t")
R.sql("join_left_lateral", "SELECT n_nationkey, t.s_suppkey FROM nation LEFT JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) t ON true")
R.sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 250000)")
R.sql("join_anti", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
R.sql("join_four_tables", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")

# Subqueries and common table expressions

R.sql("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
R.sql("subquery_scalar_empty", "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS none FROM region")
R.sql("subquery_scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
R.sql("subquery_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
R.sql("subquery_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
R.sql("subquery_not_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey % 3, 0) FROM supplier)")
R.sql("subquery_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
R.sql("subquery_not_exists", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
R.sql("subquery_derived", "SELECT s.band, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS band FROM customer) s GROUP BY s.band")
R.sql("subquery_in_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 100.0 FROM nation)")
R.sql("cte_chain", "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT c_nationkey, total FROM spent JOIN customer ON c_custkey = o_custkey) SELECT c_nationkey, count(*) AS n, round(max(total), 2) AS top FROM ranked GROUP BY c_nationkey")
R.sql("cte_reused", "WITH m AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.top FROM m a WHERE a.top >= (SELECT avg(top) FROM m)")
R.sql("cte_column_names", "WITH c(id, bal) AS (SELECT c_custkey, c_acctbal FROM customer) SELECT id, bal FROM c WHERE bal < 0")
R.sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
R.sql("cte_recursive_deep", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 300) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM t")
R.sql(
    "cte_recursive_tree",
    "WITH RECURSIVE down(n_nationkey, root, path, weight) AS (SELECT n_nationkey, n_nationkey, CAST(n_name AS STRING), n_regionkey FROM nation WHERE n_nationkey IN (3, 4) UNION ALL SELECT n.n_nationkey, d.root, d.path || '/' || n.n_name, d.weight + n.n_regionkey FROM nation n JOIN down d ON n.n_nationkey > 2 AND floor((n.n_nationkey - 1) / 2) = d.n_nationkey) SELECT n_nationkey, root, path, CAST(weight AS BIGINT) AS weight FROM down",
)

# Aggregation

R.sql("agg_global", "SELECT count(*) AS n, count(NULLIF(l_linenumber, 1)) AS some, CAST(sum(l_linenumber) AS BIGINT) AS total, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, round(avg(l_quantity), 6) AS mean FROM lineitem")
R.sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_comment) AS m FROM (SELECT l_quantity, l_returnflag AS l_comment FROM lineitem WHERE l_quantity < 0)")
R.sql("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus")
R.sql("agg_group_by_expression", "SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderpriority", "SELECT year(o_orderdate)::INT AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
R.sql("agg_group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
R.sql("agg_group_by_null", "SELECT NULLIF(c_nationkey % 4, 0) AS k, count(*) AS n FROM customer GROUP BY NULLIF(c_nationkey % 4, 0)")
R.sql("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100 AND min(l_discount) < CAST(0.05 AS DOUBLE)")
R.sql("agg_expression_over_aggregates", "SELECT o_custkey, round(sum(o_totalprice) / count(*), 8) AS mean, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey")
R.sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
R.sql("agg_sum_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
R.sql("agg_statistics", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(variance(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(var_samp(l_quantity), 4) AS vs FROM lineitem GROUP BY l_returnflag")
R.sql("agg_statistics_single", "SELECT r_regionkey, stddev_samp(r_regionkey) AS sd, var_samp(r_regionkey) AS v, stddev_pop(r_regionkey) AS sdp FROM region GROUP BY r_regionkey")
R.sql("agg_string", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
R.sql("agg_bool", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9000) AS o, every(c_custkey > 0) AS e FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9000) AS o, bool_and(c_custkey > 0) AS e FROM customer GROUP BY c_nationkey")
R.sql("agg_array", "SELECT n_regionkey, array_join(sort_array(array_agg(NULLIF(n_name, 'NATION_3'))), '|') AS names, CAST(size(array_agg(NULLIF(n_name, 'NATION_3'))) AS BIGINT) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name) FILTER (WHERE n_name <> 'NATION_3')), '|') AS names, len(array_agg(n_name) FILTER (WHERE n_name <> 'NATION_3'))::BIGINT AS n FROM nation GROUP BY n_regionkey")
R.sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority")
R.sql("agg_decimal", "SELECT l_returnflag, CAST(round(avg(CAST(l_extendedprice AS DECIMAL(28, 12))), 4) AS DOUBLE) AS mean, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(avg(CAST(l_extendedprice AS DECIMAL(18, 2))), 4)::DOUBLE AS mean, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE AS total FROM lineitem GROUP BY l_returnflag")
R.sql("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
R.sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
R.sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
R.sql("agg_grouping_id", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INT AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
R.sql("agg_rollup_times_sets", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP (o_orderpriority, year(o_orderdate))", "SELECT o_orderstatus, o_orderpriority, y, count(*) AS n FROM (SELECT *, year(o_orderdate)::INT AS y FROM orders) GROUP BY o_orderstatus, ROLLUP (o_orderpriority, y)")

# Window functions

_W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"
R.sql("window_ranking", f"SELECT o_orderkey, CAST(row_number() OVER ({_W}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
R.sql("window_distribution", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS cd FROM orders")
R.sql("window_ntile", f"SELECT o_orderkey, CAST(ntile(4) OVER ({_W}) AS BIGINT) AS tile FROM orders")
R.sql("window_lead_lag", f"SELECT o_orderkey, lead(o_orderkey) OVER ({_W}) AS nxt, lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_W}) AS prev2 FROM orders")
R.sql("window_values", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fv, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(o_orderkey, 2) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nv FROM orders")
R.sql("window_running", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W}), 2) AS s, count(*) OVER ({_W}) AS n, min(o_totalprice) OVER ({_W}) AS lo, max(o_totalprice) OVER ({_W}) AS hi, round(avg(o_totalprice) OVER ({_W}), 8) AS mean FROM orders")
R.sql("window_whole_partition", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
R.sql("window_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM orders")
R.sql("window_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM events")
R.sql("window_range_default", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n FROM orders")
R.sql(
    "window_groups_frame",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM orders)",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
)
R.sql("window_named", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
R.sql("window_nulls_last", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY NULLIF(c_nationkey, 3) NULLS LAST, c_custkey) AS BIGINT) AS rn FROM customer")
R.sql(
    "window_over_aggregate",  # ranked over the few distinct counts, not over all customers in one task
    "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT n, sum(count(*)) OVER (ORDER BY n DESC) - count(*) + 1 AS rk FROM c GROUP BY n) SELECT c.o_custkey, c.n, CAST(r.rk AS BIGINT) AS rk FROM c JOIN r ON c.n = r.n",
    "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS rk FROM orders GROUP BY o_custkey",
)

# Sort and limit

R.sql("sort_multi", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
R.sql("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
R.sql("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7 OFFSET 20")
R.sql("sort_fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 5 ROWS ONLY")
R.sql("sort_nulls_last_default", "SELECT c_custkey, k, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY k DESC NULLS LAST, c_custkey) AS BIGINT) AS place FROM (SELECT *, NULLIF(c_nationkey, 5) AS k FROM customer) c")
R.sql("sort_nulls_first", "SELECT c_custkey FROM customer ORDER BY NULLIF(c_nationkey, 5) ASC NULLS FIRST, c_custkey LIMIT 30")
R.sql("sort_expression_and_alias", "SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, p_retailprice % 10, p_partkey LIMIT 25")
R.sql("sort_ordinal", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 8")
R.sql("sort_by_aggregate", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 12")

# Set operations

_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey + 5 AS k FROM supplier"
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    R.sql(f"set_{_name}", f"{_A} {_op} {_B}")
R.sql("set_mixed_types", "SELECT c_nationkey AS k FROM customer UNION SELECT c_custkey FROM customer")
R.sql("set_nested", f"({_A} INTERSECT {_B}) UNION ALL (SELECT r_regionkey FROM region EXCEPT SELECT 3) ORDER BY k LIMIT 20")
R.sql("set_in_cte", f"WITH a AS ({_A}), b AS ({_B}) SELECT k, count(*) AS n FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) t GROUP BY k")

# Queries in the spirit of TPC-H, on the tables there are

R.sql("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus".replace("TIMESTAMP_NTZ", "DATE"))
R.sql("tpch_q2", "SELECT s_name, n_name, p_partkey, s_acctbal FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND s_acctbal = (SELECT max(s2.s_acctbal) FROM (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) x JOIN supplier s2 ON x.sk = s2.s_suppkey JOIN nation n2 ON s2.s_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey WHERE x.pk = p_partkey AND r2.r_name = 'EUROPE')")
R.sql("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
R.sql("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1998-07-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority")
R.sql("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
R.sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN CAST(0.03 AS DOUBLE) AND CAST(0.07 AS DOUBLE) AND l_quantity < 24")
R.sql("tpch_q10", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
