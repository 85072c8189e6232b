"""Scalar functions, data modification, sources and the SQL front end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import dml, select
from ..operators.constraints import Constraints
from ..session import named, register
from ..sources import sequences, tables
from ..sql import Engine
from ..streaming import windowed_counts
from . import Registry

R = Registry()


def pg(name: str, text: str, oracle: str) -> None:
    """A query in the front end's dialect."""

    def run(spark, sf_dir):
        register(spark, sf_dir, named(text))
        return Engine(spark).execute(text)

    run.__name__ = name
    R.queries[name] = run
    R.oracles[name] = oracle


# String functions

_SPLIT = "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name)::BIGINT AS n, trim('  ' || c_name || ' ') AS t, ltrim('xx' || c_name, 'x') AS lt, rtrim(c_mktsegment || 'yy', 'y') AS rt, substring(c_name, 3, 4) AS s, replace(c_name, 'a', '__') AS r FROM customer"


@R.frame(_SPLIT)
def fn_string_basics(t, spark):
    c = t("customer")
    name = F.col("c_name")
    return c.select(
        "c_custkey", F.upper(name).alias("u"), F.lower(name).alias("l"), fn.length(name).alias("n"), fn.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("t"), fn.ltrim(F.concat(F.lit("xx"), name), "x").alias("lt"),
        fn.rtrim(F.concat("c_mktsegment", F.lit("yy")), "y").alias("rt"), fn.substring(name, 3, 4).alias("s"), F.replace(name, F.lit("a"), F.lit("__")).alias("r"),
    )


@R.frame("SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 9) AS none, starts_with(p_name, 'b') AS st, ends_with(p_name, 't') AS en, strpos(p_name, 'o')::BIGINT AS at, reverse(p_name) AS rev, repeat(p_type, 2) AS rep, lpad(p_type, 10, '*') AS lp, rpad(p_type, 4, '-') AS rp FROM part")
def fn_string_search(t, spark):
    name = F.col("p_name")
    return t("part").select(
        "p_partkey", fn.split_part(name, " ", 1).alias("a"), fn.split_part(name, " ", 9).alias("none"), fn.starts_with(name, "b").alias("st"), fn.ends_with(name, "t").alias("en"), fn.strpos(name, "o").alias("at"),
        F.reverse(name).alias("rev"), F.repeat("p_type", F.lit(2)).alias("rep"), fn.lpad(F.col("p_type"), 10, "*").alias("lp"), fn.rpad(F.col("p_type"), 4, "-").alias("rp"),
    )


@R.frame("SELECT c_custkey, concat(c_name, NULLIF(c_mktsegment, 'BUILDING'), c_custkey) AS c, concat_ws('-', c_name, NULLIF(c_mktsegment, 'BUILDING')) AS cw, left(c_name, 3) AS l, left(c_name, -2) AS ln, right(c_name, 3) AS r, right(c_name, -2) AS rn, lower(to_hex(c_custkey)) AS h, md5(c_name) AS m, lower(hex(c_name)) AS enc FROM customer")
def fn_string_build(t, spark):
    name, other = F.col("c_name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t("customer").select(
        "c_custkey", fn.concat(name, other, F.col("c_custkey")).alias("c"), fn.concat_ws("-", name, other).alias("cw"), fn.left(name, 3).alias("l"), fn.left(name, -2).alias("ln"), fn.right(name, 3).alias("r"), fn.right(name, -2).alias("rn"),
        fn.to_hex(F.col("c_custkey")).alias("h"), F.md5(name.cast("binary")).alias("m"), fn.encode(name, "hex").alias("enc"),
    )


# Mathematical functions

_X = "(c_acctbal)"


@R.frame(
    f"SELECT c_custkey, abs{_X} AS a, ceil{_X}::DOUBLE AS ce, floor{_X}::DOUBLE AS fl, round(c_acctbal, 1) AS r, trunc(c_acctbal)::DOUBLE AS t, sign{_X}::DOUBLE AS s, mod(c_custkey, 7) AS m, floor((c_custkey - 700) / 7)::BIGINT AS fd, ((c_custkey - 700) // 7)::BIGINT AS d FROM customer"
)
def fn_math_rounding(t, spark):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    return t("customer").select(
        k, F.abs(x).alias("a"), fn.ceil(x).alias("ce"), fn.floor(x).alias("fl"), F.round(x, 1).alias("r"), fn.trunc(x).alias("t"), fn.sign(x).alias("s"), fn.mod(k, 7).alias("m"), fn.floor_div(k - 700, 7).alias("fd"), fn.int_div(k - 700, 7).alias("d"),
    )


@R.frame(
    "SELECT p_partkey, round(sqrt(p_size), 9) AS sq, round(power(p_size, 1.5::DOUBLE), 6) AS pw, round(exp(p_size / 50.0::DOUBLE), 9) AS e, round(ln(p_size), 9) AS ln, round(log10(p_size), 9) AS lg, round(log2(p_size), 9) AS l2, round(ln(p_size) / ln(3), 9) AS l3, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd, round(sin(p_size), 9) AS si, round(cos(p_size), 9) AS co, round(tan(p_size), 6) AS ta, round(atan(p_size), 9) AS at, round(atan2(p_size, 3), 9) AS a2, round(asin(p_size / 100.0::DOUBLE), 9) AS asn, round(acos(p_size / 100.0::DOUBLE), 9) AS acs, round(pi(), 9) AS pi FROM part"
)
def fn_math_transcendental(t, spark):
    x = F.col("p_size").cast("double")
    r = lambda c, n, d=9: F.round(c, d).alias(n)
    return t("part").select(
        "p_partkey", r(F.sqrt(x), "sq"), r(F.pow(x, F.lit(1.5)), "pw", 6), r(F.exp(x / 50), "e"), r(F.ln(x), "ln"), r(fn.log(x), "lg"), r(F.log2(x), "l2"), r(fn.log(3, x), "l3"), r(F.degrees(x), "dg", 6), r(F.radians(x), "rd"),
        r(F.sin(x), "si"), r(F.cos(x), "co"), r(F.tan(x), "ta", 6), r(F.atan(x), "at"), r(F.atan2(x, F.lit(3.0)), "a2"), r(F.asin(x / 100), "asn"), r(F.acos(x / 100), "acs"), r(F.pi(), "pi"),
    )


# Date and time functions


@R.frame(
    "SELECT event_id, " + ", ".join(f"date_trunc('{u}', ts)::TIMESTAMP AS d_{u}" for u in ("minute", "hour", "day", "week", "month", "quarter", "year", "decade"))
    + ", make_timestamp((year(ts) - 1) // 100 * 100 + 1, 1, 1, 0, 0, 0) AS d_century FROM events"
)
def fn_date_trunc(t, spark):
    units = ("minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century")
    return t("events").select("event_id", *[fn.date_trunc(u, F.col("ts")).alias(f"d_{u}") for u in units])


_FIELDS = ("year", "quarter", "month", "week", "day", "doy", "dow", "hour", "minute", "decade", "century")


@R.frame("SELECT o_orderkey, " + ", ".join(f"date_part('{f}', o_orderdate)::DOUBLE AS f_{f}" for f in _FIELDS) + " FROM orders")
def fn_date_part(t, spark):
    return t("orders").select("o_orderkey", *[fn.date_part(f, F.col("o_orderdate")).alias(f"f_{f}") for f in _FIELDS])


@R.frame("SELECT event_id, round(epoch(ts), 6) AS e, floor(date_part('second', ts))::BIGINT AS s, date_diff('second', TIMESTAMP '2024-01-01', ts) // 86400 AS age FROM events")
def fn_date_epoch_age(t, spark):
    ts = F.col("ts")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t("events").select("event_id", F.round(fn.epoch(ts), 6).alias("e"), F.floor(fn.date_part("second", ts)).alias("s"), fn.age_days(ts, start).alias("age"))


# Arrays and JSON


@R.frame(
    "SELECT p_partkey, a[1] AS one, a[9] AS none, len(a)::BIGINT AS n, array_to_string(list_append(a, 'z'), '|') AS app, array_to_string(list_prepend('y', a), '|') AS pre, array_to_string(list_concat(a, ['q']), ',') AS cat FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)"
)
def fn_arrays(t, spark):
    a = F.col("a")
    return t("part").select("p_partkey", fn.string_to_array(F.col("p_name"), " ").alias("a")).select(
        "p_partkey", fn.subscript(a, 1).alias("one"), fn.subscript(a, 9).alias("none"), fn.array_length(a).alias("n"), fn.array_to_string(fn.array_append(a, "z"), "|").alias("app"),
        fn.array_to_string(fn.array_prepend("y", a), "|").alias("pre"), fn.array_to_string(fn.array_cat(a, F.array(F.lit("q")))).alias("cat"),
    )


@R.frame("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def fn_unnest(t, spark):
    return t("part").select("p_partkey", fn.unnest(fn.string_to_array(F.col("p_name"), " ")).alias("word"))


@R.frame("SELECT event_id, (props->>'$.k') AS txt, (props->'$.k')::VARCHAR AS j, json_extract(props, '$.zz')::VARCHAR AS none FROM events")
def fn_json_access(t, spark):
    p = F.col("props")
    return t("events").select("event_id", fn.json_get_text(p, "k").alias("txt"), fn.json_get(p, "k").alias("j"), fn.json_get(p, "zz").alias("none"))


@R.frame("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","none":null}' AS o, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, 2::BIGINT AS n, 'object' AS kind, 'string' AS kind2 FROM nation""")
def fn_json_build(t, spark):
    built = fn.json_build_object("none", F.lit(None).cast("string"), "name", F.col("n_name"), "key", F.col("n_nationkey"))
    pair = fn.json_build_array(F.col("n_nationkey"), F.col("n_regionkey"))
    return t("nation").select("n_nationkey", built.alias("o"), pair.alias("a"), fn.json_array_length(pair).alias("n"), fn.json_typeof(built).alias("kind"), fn.json_typeof(fn.to_json(F.col("n_name"))).alias("kind2"))


# DataFrame operators


@R.frame("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def df_distinct_on(t, spark):
    return select.distinct_on(t("customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@R.frame("SELECT * FROM documents NATURAL JOIN labels")
def df_natural_join(t, spark):
    return select.natural_join(t("documents"), t("labels"))


@R.frame("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY NULLIF(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS place FROM customer")
def df_sort_nulls_last(t, spark):
    keys = Window.partitionBy("c_mktsegment").orderBy(select.ordering(F.nullif(F.col("c_nationkey"), F.lit(3)), True), select.ordering("c_custkey"))
    return t("customer").select("c_custkey", F.row_number().over(keys).cast("long").alias("place"))


@R.frame("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM orders")
def df_groups_frame(t, spark):
    return select.groups_frame(t("orders"), ["o_custkey"], "o_orderpriority", -1, 1, F.max("o_totalprice"), "top").select("o_orderkey", "top")


@R.frame("WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey < 5 UNION SELECT r.b, (r.b * 3 + 1) % 25 FROM r) SELECT a, b FROM r")
def df_recursive_union(t, spark):
    base = t("nation").where("n_nationkey < 5").selectExpr("n_nationkey AS a", "(n_nationkey * 3 + 1) % 25 AS b")
    return select.recursive(base, lambda new: new.selectExpr("b", "(b * 3 + 1) % 25"))


@R.frame("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal, s_suppkey) * 2 + 98 AS id FROM supplier")
def df_sequence_numbers(t, spark):
    return sequences.number_rows(t("supplier"), "id", sequences.Sequence(100, 2), ["s_acctbal", "s_suppkey"]).select("s_suppkey", "s_name", "id")


@R.frame("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS id FROM region")
def df_union_by_name(t, spark):
    named = t("nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return named.unionByName(t("region").selectExpr("r_name AS name", "r_regionkey AS id"))


@R.frame("SELECT p_partkey, p_name, p_retailprice + 1 AS price, NULL::VARCHAR AS note, p_size::BIGINT AS p_size FROM part")
def ddl_alter_columns(t, spark):
    changed = tables.add_column(t("part").withColumn("p_retailprice", F.col("p_retailprice") + 1), "note", "string")
    changed = tables.rename_column(tables.drop_column(tables.drop_column(changed, "p_brand"), "p_type"), "p_retailprice", "price")
    return tables.change_type(changed, "p_size", "bigint")


# Data modification: the new tables


@R.frame("SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, r_name, -1 FROM region")
def dml_insert(t, spark):
    return dml.insert(t("nation"), t("region").select(F.col("r_regionkey") + 100, "r_name"), ["n_nationkey", "n_name"], {"n_regionkey": -1})


@R.frame("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(t, spark):
    return dml.update(t("customer"), {"c_name": F.col("c_mktsegment"), "c_mktsegment": F.col("c_name"), "c_acctbal": F.col("c_acctbal") * 2}, F.col("c_acctbal") < 0)


@R.frame("SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_nationkey = 7")
def dml_update_returning(t, spark):
    return dml.updated_rows(t("supplier"), {"s_acctbal": F.col("s_acctbal") + 1}, F.col("s_nationkey") == 7)


@R.frame("SELECT d.doc_id, d.lang, CASE WHEN l.quality IS NULL THEN d.n_chars ELSE l.quality END AS n_chars FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def dml_update_from(t, spark):
    return dml.update_from(t("documents"), t("labels"), ["doc_id"], {"n_chars": "quality"}).select("doc_id", "lang", "n_chars")


@R.frame("SELECT * FROM orders WHERE NOT coalesce(NULLIF(o_custkey % 5, 0) = 2, false)")
def dml_delete(t, spark):
    return dml.delete(t("orders"), F.nullif(F.col("o_custkey") % 5, F.lit(0)) == 2)


@R.frame("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dml_delete_using(t, spark):
    return dml.delete_using(t("orders"), t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey")


_NEW = "SELECT n_nationkey + 20 AS n_nationkey, 'NEW' AS n_name, n_regionkey FROM nation"


@R.frame(f"SELECT * FROM nation UNION ALL SELECT * FROM ({_NEW}) x WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def dml_upsert_nothing(t, spark):
    n = t("nation")
    return dml.upsert(n, n.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("NEW").alias("n_name"), "n_regionkey"), ["n_nationkey"])


@R.frame(f"SELECT n.n_nationkey, CASE WHEN x.n_nationkey IS NULL THEN n.n_name ELSE n.n_name || '/' || x.n_name END AS n_name, n.n_regionkey FROM nation n LEFT JOIN ({_NEW}) x USING (n_nationkey) UNION ALL SELECT * FROM ({_NEW}) x WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def dml_upsert_update(t, spark):
    n = t("nation")
    new = n.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("NEW").alias("n_name"), "n_regionkey")
    return dml.upsert(n, new, ["n_nationkey"], {"n_name": F.concat("n_name", F.lit("/"), F.col("excluded.n_name"))})


@R.frame("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(t, spark):
    return Constraints().repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@R.frame("SELECT * FROM customer WHERE NOT (NULLIF(c_nationkey % 4, 0) < 3)")
def constraint_check(t, spark):
    return Constraints().failing_rows(t("customer"), F.nullif(F.col("c_nationkey") % 4, F.lit(0)) < 3)


@R.frame("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def constraint_foreign_key(t, spark):
    return Constraints().orphans(t("documents").select("doc_id", "source"), ["doc_id"], t("labels"), ["doc_id"])


# Catalogue, streams


@R.frame()
def catalog_columns(t, spark):
    from ..sources import catalog

    t("nation").createOrReplaceTempView("nation")
    return catalog.columns(spark).where("table_name = 'nation'")


@R.frame("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(t, spark):
    return windowed_counts(t("events"))


# The SQL front end

pg("pg_operators", "SELECT event_id, props->>'k' AS k, (props->>'k')::INT8 + 1 AS k1, strpos(props, 'k') AS at, to_hex(user_id) AS h FROM events WHERE event_type ILIKE 'CL%'", "SELECT event_id, props->>'$.k' AS k, (props->>'$.k')::BIGINT + 1 AS k1, strpos(props, 'k')::BIGINT AS at, lower(to_hex(user_id)) AS h FROM events WHERE event_type ILIKE 'CL%'")
pg("pg_generate_series", "SELECT generate_series * 2 AS twice FROM generate_series(3, 30, 3)", "SELECT generate_series * 2 AS twice FROM generate_series(3, 30, 3)")
pg("pg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
pg("pg_fetch_and_nulls", "SELECT c_custkey, k, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY k, c_custkey) AS BIGINT) AS place FROM (SELECT *, NULLIF(c_nationkey, 0) AS k FROM customer) c", "SELECT c_custkey, k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k NULLS LAST, c_custkey) AS place FROM (SELECT *, NULLIF(c_nationkey, 0) AS k FROM customer) c")
pg("pg_fetch_first", "SELECT c_custkey, NULLIF(c_nationkey, 0) AS k FROM customer ORDER BY NULLIF(c_nationkey, 0) DESC, c_custkey FETCH FIRST 12 ROWS ONLY", "SELECT c_custkey, NULLIF(c_nationkey, 0) AS k FROM customer ORDER BY NULLIF(c_nationkey, 0) DESC NULLS LAST, c_custkey FETCH FIRST 12 ROWS ONLY")
pg("pg_extract", "SELECT o_orderkey, EXTRACT(dow FROM o_orderdate) AS d, date_part('decade', o_orderdate) AS dec, date_trunc('century', o_orderdate) AS cen, date_trunc('month', o_orderdate) AS mon FROM orders", "SELECT o_orderkey, date_part('dow', o_orderdate)::DOUBLE AS d, date_part('decade', o_orderdate)::DOUBLE AS dec, make_timestamp((year(o_orderdate) - 1) // 100 * 100 + 1, 1, 1, 0, 0, 0) AS cen, date_trunc('month', o_orderdate)::TIMESTAMP AS mon FROM orders")
pg("pg_functions", "SELECT c_custkey, left(c_name, -1) AS l, right(c_name, 2) AS r, ltrim(c_name, 'Cc') AS lt, concat(c_name, NULL, 'x') AS c, log(c_custkey + 1) > 2 AS big, (ARRAY[c_nationkey, 7])[2] AS seven, iff(c_acctbal > 0, 'plus', 'minus') AS s FROM customer", "SELECT c_custkey, left(c_name, -1) AS l, right(c_name, 2) AS r, ltrim(c_name, 'Cc') AS lt, concat(c_name, NULL, 'x') AS c, log10(c_custkey + 1) > 2 AS big, ([c_nationkey, 7])[2] AS seven, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s FROM customer")


def pg_sql_function(spark, sf_dir):
    register(spark, sf_dir, ["lineitem"])
    engine = Engine(spark)
    engine.execute("CREATE OR REPLACE FUNCTION with_tax(price FLOAT8, tax FLOAT8) RETURNS FLOAT8 LANGUAGE sql AS $$ SELECT $1 * (1 + $2) $$")
    return engine.execute("SELECT l_orderkey, l_linenumber, l_partkey, with_tax(l_extendedprice, l_tax) AS price FROM lineitem")


def pg_prepared(spark, sf_dir):
    register(spark, sf_dir, ["supplier"])
    engine = Engine(spark)
    engine.execute("PREPARE q AS SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = $1 OR s_acctbal > $2")
    return engine.execute("EXECUTE q(3, 9000)")


R.queries |= {"pg_sql_function": pg_sql_function, "pg_prepared": pg_prepared}
R.oracles |= {
    "pg_sql_function": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 + l_tax) AS price FROM lineitem",
    "pg_prepared": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 3 OR s_acctbal > 9000",
}


def script(name: str, statements: list[str], oracle: str) -> None:
    """Statements on tables of their own: {a}, {b} and {c} stand for names that no other run has, {path} for a folder.  The last one gives the result."""

    def run(spark, sf_dir):
        engine = Engine(spark)
        register(spark, sf_dir, named(" ".join(statements)))
        mark = uuid.uuid4().hex[:8]
        dml.cut(spark.range(1))  # so that there is a checkpoint folder
        names = {k: f"{k}_{mark}" for k in "abc"} | {"path": f"{spark.sparkContext.getCheckpointDir()}/copied-{mark}"}
        for text in statements[:-1]:
            engine.execute(text.format(**names))
        out = dml.cut(engine.execute(statements[-1].format(**names)))
        for k in "cba":
            spark.sql(f"DROP TABLE IF EXISTS {names[k]}")
        spark.sql(f"DROP TABLE IF EXISTS sequence_{names['a']}")
        return out

    run.__name__ = name
    R.queries[name] = run
    R.oracles[name] = oracle


_OWN = "CREATE TABLE {a} (k INT PRIMARY KEY, name TEXT NOT NULL, region INT, n INT DEFAULT 1)"
_FILL = "INSERT INTO {a} (k, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation"
script(
    "pg_create_and_insert",
    ["CREATE TABLE {a} (id SERIAL PRIMARY KEY, name VARCHAR(25) NOT NULL, region INT DEFAULT 7 CHECK (region >= 0), UNIQUE (name))", "INSERT INTO {a} (name, region) SELECT n_name, n_regionkey FROM nation", "INSERT INTO {a} (name) VALUES ('late'), ('later')", "SELECT id, name, region FROM {a}"],
    "SELECT row_number() OVER (ORDER BY n_name)::INT AS id, n_name AS name, n_regionkey::INT AS region FROM nation UNION ALL SELECT * FROM (VALUES (26, 'late', 7), (27, 'later', 7)) v",
)
script(
    "pg_on_conflict",
    [_OWN, _FILL, "INSERT INTO {a} VALUES (3, 'three', 0, 5), (99, 'new', 1, 1) ON CONFLICT (k) DO UPDATE SET n = {a}.n + EXCLUDED.n, name = EXCLUDED.name", "INSERT INTO {a} VALUES (4, 'ignored', 0, 9), (98, 'kept', 2, DEFAULT) ON CONFLICT DO NOTHING", "SELECT k, name, n FROM {a}"],
    "SELECT n_nationkey::INT AS k, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN 6 ELSE 1 END AS n FROM nation UNION ALL SELECT * FROM (VALUES (99, 'new', 1), (98, 'kept', 1)) v",
)
script("pg_insert_returning", [_OWN, "INSERT INTO {a} (k, name) SELECT r_regionkey, r_name FROM region RETURNING k, lower(name) AS name, n"], "SELECT r_regionkey::INT AS k, lower(r_name) AS name, 1 AS n FROM region")
script(
    "pg_update_from",
    [_OWN, _FILL, "UPDATE {a} AS x SET name = r.r_name || x.name, n = x.n + x.k FROM region r WHERE x.region = r.r_regionkey AND r.r_name LIKE 'A%'", "SELECT k, name, n FROM {a}"],
    "SELECT n_nationkey::INT AS k, CASE WHEN r_name LIKE 'A%' THEN r_name || n_name ELSE n_name END AS name, CASE WHEN r_name LIKE 'A%' THEN 1 + n_nationkey ELSE 1 END::INT AS n FROM nation JOIN region ON n_regionkey = r_regionkey",
)
script("pg_delete_using", [_OWN, _FILL, "DELETE FROM {a} USING region r WHERE {a}.region = r.r_regionkey AND r.r_name LIKE 'A%' RETURNING k, name"], "SELECT n_nationkey::INT AS k, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
script(
    "pg_update_subquery",
    [_OWN, _FILL, "UPDATE {a} SET n = (SELECT max(s_nationkey) FROM supplier WHERE s_suppkey > 3) + k WHERE region IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)", "SELECT k, n FROM {a}"],
    "SELECT n_nationkey::INT AS k, CASE WHEN n_regionkey < 2 THEN (SELECT max(s_nationkey) FROM supplier WHERE s_suppkey > 3) + n_nationkey ELSE 1 END::INT AS n FROM nation",
)
script(
    "pg_copy",
    ["COPY (SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) FROM nation) TO '{path}' WITH (FORMAT csv, HEADER, DELIMITER '|')", _OWN, "COPY {a} (k, name, region) FROM '{path}' WITH (FORMAT csv, HEADER, DELIMITER '|')", "SELECT k, name, region, n FROM {a}"],
    "SELECT n_nationkey::INT AS k, n_name AS name, NULLIF(n_regionkey, 2)::INT AS region, 1 AS n FROM nation",
)
script("pg_sequences", ["CREATE SEQUENCE {a} START WITH 10 INCREMENT BY 5", "SELECT nextval('{a}')", "SELECT setval('{a}', 100)", "SELECT nextval('{a}') AS x, nextval('{a}') AS y, currval('{a}') AS z"], "SELECT 105::BIGINT AS x, 110::BIGINT AS y, 110::BIGINT AS z")
script(
    "pg_alter_table",
    [_OWN, _FILL, "ALTER TABLE {a} ADD COLUMN note TEXT DEFAULT 'none'", "ALTER TABLE {a} DROP COLUMN region", "ALTER TABLE {a} RENAME COLUMN name TO title", "ALTER TABLE {a} ALTER COLUMN n TYPE BIGINT", "ALTER TABLE {a} ADD CONSTRAINT small CHECK (k < 1000)", "INSERT INTO {a} (k, title) VALUES (500, 'more')", "SELECT * FROM {a}"],
    "SELECT n_nationkey::INT AS k, n_name AS title, 1::BIGINT AS n, 'none' AS note FROM nation UNION ALL SELECT 500, 'more', 1, 'none'",
)
script(
    "pg_foreign_keys",
    ["CREATE TABLE {a} (id INT PRIMARY KEY)", "INSERT INTO {a} SELECT r_regionkey FROM region", "CREATE TABLE {b} (k INT, region INT REFERENCES {a} (id) ON DELETE CASCADE ON UPDATE CASCADE)", "CREATE TABLE {c} (k INT, region INT DEFAULT 4, FOREIGN KEY (region) REFERENCES {a} (id) ON DELETE SET DEFAULT ON UPDATE SET NULL)",
     "INSERT INTO {b} SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO {c} SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM {a} WHERE id = 1", "UPDATE {a} SET id = 20 WHERE id = 2", "SELECT 'b' AS t, k, region FROM {b} UNION ALL SELECT 'c', k, region FROM {c}"],
    "SELECT 'b' AS t, n_nationkey::INT AS k, CASE n_regionkey WHEN 2 THEN 20 ELSE n_regionkey END::INT AS region FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'c', n_nationkey::INT, CASE n_regionkey WHEN 1 THEN 4 WHEN 2 THEN NULL ELSE n_regionkey END::INT FROM nation",
)
script(
    "pg_constraint_views",
    ["CREATE TABLE {a} (x INT, y INT, PRIMARY KEY (x, y), UNIQUE (y))", "CREATE TABLE {b} (u INT REFERENCES {a} (y) ON DELETE CASCADE, w INT CONSTRAINT positive CHECK (w > 0))",
     "SELECT c.constraint_type AS kind, replace(c.constraint_name, '{b}', 'b') = c.constraint_name AS of_a, k.column_name AS col, k.ordinal_position AS place FROM information_schema.table_constraints c LEFT JOIN information_schema.key_column_usage k ON c.constraint_name = k.constraint_name WHERE c.table_name IN ('{a}', '{b}')"],
    "SELECT * FROM (VALUES ('PRIMARY KEY', true, 'x', 1), ('PRIMARY KEY', true, 'y', 2), ('UNIQUE', true, 'y', 1), ('FOREIGN KEY', false, 'u', 1), ('CHECK', false, NULL, NULL)) v(kind, of_a, col, place)",
)
script(
    "pg_catalog_views",
    [_OWN, "SELECT a.attname AS col, t.typname AS kind, a.attnum AS place FROM pg_catalog.pg_class c JOIN pg_catalog.pg_attribute a ON a.attrelid = c.oid JOIN pg_catalog.pg_type t ON a.atttypid = t.oid JOIN pg_catalog.pg_tables s ON s.tablename = c.relname WHERE c.relname = '{a}'"],
    "SELECT * FROM (VALUES ('k', 'integer', 1), ('name', 'text', 2), ('region', 'integer', 3), ('n', 'integer', 4)) v(col, kind, place)",
)
pg("pg_recursive_union", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey < 5 UNION SELECT r.b, (r.b * 3 + 1) % 25 FROM r) SELECT a, b FROM r WHERE a <> 7", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey < 5 UNION SELECT r.b, (r.b * 3 + 1) % 25 FROM r) SELECT a, b FROM r WHERE a <> 7")
pg("pg_union_by_name", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS id FROM region", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS id FROM region")
pg(
    "pg_more_functions",
    "SELECT c_custkey, substring(c_name, -1, 4) AS s, split_part(c_name, '#', 0) AS none, trim(' \t' || c_name || '\t ') AS t, encode(c_name, 'hex') AS h, bool('t') AS b, text(c_custkey) AS x, int8(c_nationkey) AS i, to_number('12.5') AS n, array_lower(ARRAY[c_custkey], 1) AS lo, json_extract_path_text('{\"a\": {\"b\": 3}}', 'a', 'b') AS j FROM customer",
    "SELECT c_custkey, left(c_name, 4) AS s, '' AS none, c_name AS t, lower(hex(c_name)) AS h, true AS b, c_custkey::VARCHAR AS x, c_nationkey::BIGINT AS i, 12.5::DOUBLE AS n, 1 AS lo, '3' AS j FROM customer",
)
pg(
    "pg_dates",
    "SELECT o_orderkey, to_date('2024-02-29') AS d, to_timestamp('2024-02-29 10:11:12')::TIMESTAMP AS ts, date_part('millennium', o_orderdate) AS mil, EXTRACT(microseconds FROM TIMESTAMP_NTZ '2024-02-29 10:11:12.5') AS us FROM orders",
    "SELECT o_orderkey, DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 10:11:12' AS ts, floor((year(o_orderdate) - 1) / 1000) + 1 AS mil, 12500000::DOUBLE AS us FROM orders",
)
