"""Edge cases on inline rows: NULLs, ties, empty inputs and errors."""

import pytest
from pyspark.errors import ArithmeticException, PySparkException
from pyspark.sql import functions as F

from larkspur import functions as fn
from larkspur.operators import dml, select
from larkspur.operators.constraints import Constraints, ConstraintViolation
from larkspur.session import configure
from larkspur.sources import catalog, files, sequences, tables
from larkspur.sql import Engine, NotSupported, translate
from larkspur.streaming import windowed_counts


@pytest.fixture(scope="module")
def t(spark):
    configure(spark)
    return spark.createDataFrame([(1, 10, "x"), (2, None, "y"), (3, 30, None), (4, None, None)], "id int, a int, b string")


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_update_sees_old_rows(t):
    assert values(dml.update(t.select("id", "a"), {"id": F.col("a"), "a": F.col("id")}, F.col("a") > 10)) == [(1, 10), (2, None), (30, 3), (4, None)]
    with pytest.raises(ValueError):
        dml.update(t, {"nothing": 1})


def test_delete_keeps_unknown(t):
    assert values(dml.delete(t, F.col("a") > 10).select("id")) == [(1,), (2,), (4,)]
    assert dml.delete(t).count() == 0
    assert values(dml.deleted_rows(t, F.col("a") > 10).select("id")) == [(3,)]


def test_insert_defaults_and_arity(spark, t):
    out = dml.insert(t, spark.range(7, 8), ["id"], {"b": "new"})
    assert (7, None, "new") in values(out)
    with pytest.raises(ValueError):
        dml.insert(t, spark.range(1), ["id", "a"])


def test_upsert(spark, t):
    new = spark.createDataFrame([(1, 5, "z"), (1, 4, "z"), (9, 9, "n"), (None, 0, "free")], "id int, a int, b string")
    assert values(dml.upsert(t, new, ["id"]).select("id", "a")) == [(1, 10), (2, None), (3, 30), (4, None), (9, 9), (None, 0)]
    out = dml.upsert(t, new, ["id"], {"a": F.col("a") + F.col("excluded.a")})
    assert (1, 14, "x") in values(out) and out.count() == 6


def test_cascade(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "cid int, pid int")
    kept, out = dml.delete_cascade(parent, F.col("id") == 1, {"c": (child, "pid", "cascade"), "n": (child, "pid", "set null")}, "id")
    assert values(kept) == [(2,)] and values(out["c"]) == [(11, 2), (12, None)] and values(out["n"]) == [(10, None), (11, 2), (12, None)]
    with pytest.raises(ValueError):
        dml.delete_cascade(parent, F.col("id") == 1, {"c": (child, "pid", "restrict")}, "id")


def test_constraints(spark, t):
    ok = Constraints(not_null=["id"], unique=[["id"], ["a"]], checks={"positive": F.col("a") > 0}, foreign=[(["a"], spark.createDataFrame([(10,), (30,)], "k int"), ["k"])])
    dml.checked(t, ok)
    for bad, state in (
        (Constraints(not_null=["a"]), "23502"), (Constraints(unique=[["b"]]), "23505"), (Constraints(checks={"c": F.col("a") < 20}), "23514"), (Constraints(foreign=[(["a"], spark.createDataFrame([(10,)], "k int"), ["k"])]), "23503"),
    ):
        with pytest.raises(ConstraintViolation) as e:
            dml.checked(t.union(t.where("id = 1")), bad)
        assert e.value.getSqlState() == state


def test_ansi_errors(spark, t):
    for expr in ("a / 0", "CAST(2147483647 AS INT) + id", "CAST('x' AS INT)"):
        with pytest.raises(PySparkException):
            t.selectExpr(expr).collect()
    with pytest.raises(ArithmeticException) as e:
        t.selectExpr("id % 0").collect()
    assert e.value.getSqlState() == "22012"


def test_strings(spark):
    s = F.lit("héllo wörld")
    assert one(spark, fn.length(s)) == 11 and one(spark, fn.left(s, -6)) == "héllo" and one(spark, fn.right(s, -6)) == "wörld" and one(spark, fn.left(s, -99)) == ""
    assert one(spark, fn.substring(s, -3, 2)) == "hé" and one(spark, fn.trim(F.lit("\t  x \n"))) == "x"
    assert [one(spark, fn.split_part(F.lit("a,b,c"), ",", n)) for n in (1, 3, 4, 0, -1)] == ["a", "c", "", "", ""]
    assert one(spark, fn.concat(F.lit("a"), None, F.lit(1))) == "a1" and one(spark, fn.strpos(s, "zz")) == 0
    assert one(spark, fn.encode(F.lit("hi"), "base64")) == "aGk=" and one(spark, fn.to_hex(F.lit(255))) == "ff"
    assert [one(spark, fn.text_to_bool(F.lit(x))) for x in (" On", "f", None)] == [True, False, None]
    with pytest.raises(PySparkException):
        one(spark, fn.text_to_bool(F.lit("maybe")))


def test_math_and_times(spark):
    assert [one(spark, fn.trunc(F.lit(x), 1)) for x in (2.78, -2.78, 0.0)] == [2.7, -2.7, 0.0]
    assert one(spark, fn.mod(F.lit(-7), 3)) == -1 and one(spark, fn.int_div(F.lit(-7), 2)) == -3 and one(spark, fn.floor_div(F.lit(-7), 2)) == -4
    assert one(spark, fn.log(F.lit(1000.0))) == pytest.approx(3) and one(spark, fn.log(2, F.lit(8.0))) == pytest.approx(3)
    day = F.lit("1931-08-05 13:14:15.5").cast("timestamp_ntz")
    parts = {"dow": 3, "isodow": 3, "week": 32, "decade": 193, "century": 20, "second": 15.5, "milliseconds": 15500, "epoch": -1212057944.5, "doy": 217}
    assert {k: one(spark, fn.date_part(k, day)) for k in parts} == parts
    assert str(one(spark, fn.date_trunc("century", day))) == "1901-01-01 00:00:00" and one(spark, fn.date_trunc("nonsense", day)) == one(spark, day)
    assert one(spark, fn.age_days(F.lit("2024-03-01 00:00:00"), F.lit("2024-02-28 12:00:00"))) == 1


def test_arrays_and_json(spark):
    a = F.array(F.lit(1), F.lit(None), F.lit(3))
    assert one(spark, fn.subscript(a, 4)) is None and one(spark, fn.array_to_string(a, "-")) == "1-3" and one(spark, fn.string_to_array(F.lit("a.b"), ".")) == ["a", "b"]
    assert one(spark, fn.generate_series(5, 1, -2)) == [5, 3, 1] and one(spark, fn.generate_series(5, 1)) == []
    with pytest.raises(ValueError):
        fn.generate_series(1, 2, 0)
    j = F.lit('{"a": {"b": [1, "x"]}, "n": null}')
    assert one(spark, fn.json_extract_path(j, "a", "b", 1)) == '"x"' and one(spark, fn.json_extract_path_text(j, "a", "b", 1)) == "x" and one(spark, fn.json_get(j, "n")) is None
    kinds = {"{}": "object", "[]": "array", '"s"': "string", "1.5": "number", "true": "boolean", "null": "null", "{": None}
    assert {k: one(spark, fn.json_typeof(F.lit(k))) for k in kinds} == kinds
    assert one(spark, fn.json_object(F.array(F.lit("k")), F.array(F.lit("v")))) == '{"k":"v"}'


def test_nulls_order_and_recursion(t):
    assert [r.id for r in select.sort(t, "a", "id").collect()] == [1, 3, 2, 4]
    assert [r.id for r in select.sort(t, ("a", True), "id").collect()] == [3, 1, 2, 4]
    assert [r.id for r in select.sort(t, ("a", True, True), "id").collect()] == [2, 4, 3, 1]
    found = select.recursive(t.select("id").where("id = 1"), lambda n: n.selectExpr("(id * 2) % 7"))
    assert values(found) == [(1,), (2,), (4,)]
    with pytest.raises(RecursionError):
        select.recursive(t.select("id").where("id = 1"), lambda n: n.selectExpr("id + 1"), limit=4)


def test_not_in_null(spark):
    assert spark.sql("SELECT * FROM VALUES (1), (2) AS a(v) WHERE v NOT IN (SELECT * FROM VALUES (3), (NULL))").count() == 0


def test_not_in_is_dealt_over_tasks(spark):
    from larkspur.plans import catalogue
    from larkspur.session import spread_not_in

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["subquery_not_in"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "LeftAnti" in plan
    spark.sql("SELECT * FROM VALUES (1), (2), (NULL) AS v(x)").createOrReplaceTempView("some_x")
    for name, held in (("plain", "(2), (5)"), ("with_null", "(2), (NULL)"), ("none", "(1)")):
        spark.sql(f"SELECT * FROM VALUES {held} AS v(x)").where("x > 0 OR x IS NULL" if name != "none" else "false").createOrReplaceTempView(f"ys_{name}")
        text = f"SELECT x FROM some_x WHERE x NOT IN (SELECT NULLIF(x, 5) FROM ys_{name}) AND coalesce(x, 0) < 9"
        assert spread_not_in(text) != text and values(spark.sql(spread_not_in(text))) == values(spark.sql(text))


def test_full_join_of_few_keys_is_dealt_over_tasks(spark):
    from larkspur.plans import catalogue

    a, b = spark.range(3000).select(F.col("id").alias("x")), spark.range(700).select(F.col("id").alias("y"))
    keys = F.expr("CASE WHEN x < 2000 THEN 1 WHEN x < 2990 THEN x % 7 END"), F.expr("CASE WHEN y < 300 THEN 1 WHEN y < 690 THEN y END")
    got = select.full_join(a, b, *keys, rows=50_000)
    want = a.join(b, keys[0] == keys[1], "full")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sizes = [r["count"] for r in got.where("x < 2000 AND y < 300").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600_000 and len(sizes) > 1 and max(sizes) < 450_000
    plan = catalogue.queries()["join_null_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan


def test_csv_round_trip(spark, t, tmp_path):
    odd = t.union(spark.createDataFrame([(5, 1, 'q"u,o\nte'), (6, 2, "")], t.schema))
    files.copy_to(odd, str(tmp_path / "out"), single_file=True)
    back = spark.read.schema(t.schema).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(str(tmp_path / "out"))
    assert values(back) == values(odd.replace('', None, subset=['b']))  # an empty field reads as NULL, quoted or not
    (tmp_path / "in.txt").write_text("1|2|x\n2||\\N\n")
    assert [tuple(r)[:2] for r in files.copy_from(spark, str(tmp_path / "in.txt"), t.schema, "|").collect()] == [(1, 2), (2, None)]
    (tmp_path / "bad.txt").write_text("one|2|x\n")
    with pytest.raises(PySparkException):
        files.copy_from(spark, str(tmp_path / "bad.txt"), t.schema, "|").collect()
    assert files.to_arrow(t).num_rows == 4


def test_sequences(spark):
    s = sequences.Sequence()
    with pytest.raises(ValueError):
        s.currval()
    assert [s.nextval(), s.nextval(), s.currval()] == [1, 2, 2]
    s.setval(10)
    assert s.nextval() == 11
    s.setval(10, False)
    got = sequences.number_rows(spark.range(50).withColumn("k", -F.col("id")), "n", s, ["k"]).orderBy("n").collect()
    assert [(r.id, r.n) for r in got] == [(49 - i, 10 + i) for i in range(50)] and s.nextval() == 60
    assert sequences.number_rows(spark.range(0), "n", s, ["id"]).count() == 0


def test_engine_tables(spark, t):
    e = Engine(spark)
    spark.sql("DROP TABLE IF EXISTS own_t")
    tables.create(spark, "own_t", t)
    tables.create(spark, "own_t", t, if_not_exists=True)
    assert values(e.execute("UPDATE own_t SET a = id * 2, b = 'new' WHERE a IS NULL RETURNING id, a")) == [(2, 4), (4, 8)]
    assert values(e.execute("DELETE FROM own_t WHERE a > 9 RETURNING id")) == [(1,), (3,)]
    assert values(e.execute("SELECT id, a, b FROM own_t")) == [(2, 4, "new"), (4, 8, "new")]
    e.execute("INSERT INTO own_t VALUES (7, 7, 'seven')")
    assert "own_t" in [r.table_name for r in e.execute("SELECT table_name FROM information_schema.tables").collect()]
    assert [r.data_type for r in e.execute("SELECT data_type FROM information_schema.columns WHERE table_name = 'own_t' ORDER BY ordinal_position").collect()] == ["integer", "integer", "text"]
    assert catalog.schemata(spark).count() >= 1
    assert any("own_t" in r.plan for r in e.execute("EXPLAIN SELECT id FROM own_t WHERE id = 7").collect())
    e.execute("PREPARE p AS SELECT id FROM own_t WHERE id = $1")
    assert values(e.execute("EXECUTE p(7)")) == [(7,)]
    e.execute("DEALLOCATE p")
    with pytest.raises(KeyError):
        e.execute("EXECUTE p(7)")
    with pytest.raises(PySparkException) as err:
        e.execute("SELECT nothing FROM own_t").collect()
    assert err.value.getSqlState() == "42703"
    e.execute("CREATE FUNCTION plus1(a INT) RETURNS INT LANGUAGE sql RETURN a + 1")
    assert values(e.execute("SELECT plus1(id) FROM own_t WHERE id = 7")) == [(8,)]
    e.execute("DROP FUNCTION IF EXISTS plus1")
    spark.sql("DROP TABLE own_t")


def test_declared_constraints(spark):
    e = Engine(spark)
    for name in ("own_child", "own_parent"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    e.execute("CREATE TABLE own_parent (id INT PRIMARY KEY, x DOUBLE PRECISION DEFAULT (1 + 1), CONSTRAINT low CHECK (x < 100))")
    e.execute("CREATE TABLE IF NOT EXISTS own_parent (id INT)")
    e.execute("CREATE TABLE own_child (k BIGSERIAL, pid INT REFERENCES own_parent ON DELETE RESTRICT, note TEXT UNIQUE)")
    e.execute("INSERT INTO own_parent (id) VALUES (1), (2)")
    e.execute("INSERT INTO own_child (pid, note) VALUES (1, 'a'), (NULL, NULL), (NULL, NULL)")
    assert values(e.execute("SELECT id, x FROM own_parent")) == [(1, 2.0), (2, 2.0)] and e.execute("SELECT * FROM own_child").count() == 3
    for text, state in (
        ("INSERT INTO own_parent (id) VALUES (2)", "23505"), ("INSERT INTO own_parent (id) VALUES (NULL)", "23502"), ("INSERT INTO own_parent VALUES (5, 100)", "23514"), ("INSERT INTO own_child (pid) VALUES (9)", "23503"),
        ("UPDATE own_parent SET x = 100 WHERE id = 1", "23514"), ("DELETE FROM own_parent WHERE id = 1", "23503"), ("UPDATE own_parent SET id = 1", "23505"), ("INSERT INTO own_child (note) VALUES ('a')", "23505"),
        ("ALTER TABLE own_parent ADD CHECK (id > 1)", "23514"),
    ):
        with pytest.raises(ConstraintViolation) as err:
            e.execute(text)
        assert err.value.getSqlState() == state
    e.execute("DELETE FROM own_parent AS p WHERE p.id = 2")
    e.execute("ALTER TABLE own_parent DROP CONSTRAINT low")
    e.execute("UPDATE own_parent SET x = DEFAULT WHERE id = 1")
    e.execute("UPDATE own_parent SET x = 100 + (SELECT count(*) FROM own_child WHERE k > 0)")
    assert values(e.execute("SELECT * FROM own_parent")) == [(1, 103.0)]
    assert [r.k for r in e.execute("SELECT k FROM own_child ORDER BY k").collect()] == [1, 2, 3]
    for name in ("own_child", "own_parent"):
        e.execute(f"DROP TABLE {name}")


def test_statements_without_a_counterpart(spark):
    e = Engine(spark)
    assert e.execute("BEGIN").first()[0] == "BEGIN" and e.execute("SHOW timezone").first()[0] == "UTC"
    for text in ("ROLLBACK", "SAVEPOINT a", "ROLLBACK TO a"):
        with pytest.raises(NotSupported):
            e.execute(text)
    spark.sql("DROP TABLE IF EXISTS own_s")
    e.execute("CREATE TABLE own_s AS SELECT generate_series AS n FROM generate_series(1, 9)")
    assert e.execute("ANALYZE own_s").first()[0] == "ANALYZE" and e.execute("EXPLAIN ANALYZE SELECT n FROM own_s").count() > 1
    assert values(e.execute("SELECT 'information_schema.tables' AS t")) == [("information_schema.tables",)]
    e.execute("DROP TABLE own_s")


def test_translate_leaves_text_alone():
    assert translate("SELECT 'strpos(a, b) -> ::TEXT ORDER BY x' AS s") == "SELECT 'strpos(a, b) -> ::TEXT ORDER BY x' AS s"
    assert translate('SELECT "Odd Name" FROM t ORDER BY a, b DESC NULLS FIRST LIMIT 2') == "SELECT `Odd Name` FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST LIMIT 2"


def test_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(rows.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert values(spark.table("counts")) == values(windowed_counts(rows))
