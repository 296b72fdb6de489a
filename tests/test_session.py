from __future__ import annotations

import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle import cli, statements
from brindle.activity import ActivityLog
from brindle.session import Session, Settings
from brindle.sources import TableId, batches, json_rows, read_csv, string_rows, write_table


@pytest.fixture
def session(spark):
    with Session(spark) as s:
        yield s


def test_split_and_classify():
    assert statements.split("SELECT ';' AS a; -- x;y\nSELECT 1 /* ; */;;") == ["SELECT ';' AS a", "-- x;y\nSELECT 1 /* ; */"]
    assert statements.split(" -- nothing\n ; ") == []
    assert statements.classify("INSERT INTO a.b VALUES (1)").table == "a.b"
    assert statements.classify("update t set x = 1").verb == "update"
    assert statements.classify("delete from `t` where x").table == "`t`"
    assert statements.classify("DROP TABLE t").table is None
    assert statements.classify("CREATE TEMP VIEW v AS SELECT 1") is None
    assert statements.classify("SELECT 'insert into t'") is None
    change = statements.row_change("UPDATE t SET a = concat('x', 'where, y'), b = 2 WHERE a = 'q'")
    assert change.assignments == {"a": "concat('x', 'where, y')", "b": "2"} and change.condition == "a = 'q'"


def test_isolation(spark):
    with Session(spark) as a, Session(spark) as b:
        a.sql("CREATE TABLE t USING parquet AS SELECT 1 AS x")
        a.sql("CREATE TEMP VIEW v AS SELECT 2 AS y")
        assert a.query("SELECT x FROM t").rows == [["1"]]
        assert "TABLE_OR_VIEW_NOT_FOUND" in b.query("SELECT x FROM t").error
        assert "TABLE_OR_VIEW_NOT_FOUND" in b.query("SELECT y FROM v").error


def test_query_result_and_stats(session):
    r = session.query("SELECT id, CAST(NULL AS INT) AS n, id > 1 AS big FROM range(5) ORDER BY id", max_rows=3)
    assert r.columns == ["id", "n", "big"] and r.types == ["bigint", "int", "boolean"]
    assert r.rows == [["0", "NULL", "false"], ["1", "NULL", "false"], ["2", "NULL", "true"]] and r.truncated
    assert r.stats.wall_us > 0 and r.stats.input_rows == 5 and r.stats.worthwhile_plans == 0
    dense = session.query("SELECT max(v) AS m FROM (SELECT sin(id) + cos(id) + exp(id / 1e7) AS v FROM range(300000))")
    assert dense.ok and dense.stats.worthwhile_plans == 1 and dense.stats.input_rows == 300000
    with Session(session.spark, accelerated=False) as plain:
        assert plain.query("SELECT max(sin(id)) AS m FROM range(300000)").stats.worthwhile_plans == 0


def test_cache_follows_writes_and_identity(session, spark):
    session.sql("CREATE TABLE w USING parquet AS SELECT id, CAST(id % 97 AS DOUBLE) AS a, CAST(id % 13 AS DOUBLE) AS b FROM range(3000)")
    total = lambda: session.table("w", "a", "b").agg(F.sum("a")).first()[0]
    first = total()
    assert total() == first and session.cache.hits == 1
    session.sql("INSERT INTO w VALUES (3000, 1000.0, 1.0)")
    assert not session.cache.entries and total() == first + 1000
    assert session.sql("DELETE FROM w WHERE id = 3000").first()[0] == 1
    assert total() == first
    assert session.sql("UPDATE w SET a = a + 1, b = 0 WHERE id < 10").first()[0] == 10
    assert total() == first + 10 and session.table("w", "b").where("id < 10" if False else "b = 0").count() >= 10
    with Session(spark) as other:
        other.sql("CREATE TABLE w USING parquet AS SELECT 5.0D AS a")
        assert other.table("w", "a").first()[0] == 5.0
        assert TableId.parse("w", other.spark) != TableId.parse("w", session.spark)
    session.sql("DROP TABLE w")
    assert not session.cache.entries


def test_early_limit_does_not_fill_cache(session):
    session.sql("CREATE TABLE q USING parquet AS SELECT id FROM range(1000)")
    assert len(session.table("q", "id", populate=False).limit(3).collect()) == 3
    assert not session.cache.entries
    assert session.table("q", "id").limit(3).count() == 3  # filled from the whole table
    assert next(iter(session.cache.entries.values())).rows == 1000


def test_settings(session):
    session.sql("SET engine.fast_math = true")
    assert session.settings.fast_math and session.notes
    session.sql("SET engine.min_rows = 5")
    assert session.settings.min_rows == 5
    for name, value in (("memory_fraction", 2), ("strict_fp", "maybe"), ("min_rows", -1)):
        with pytest.raises(ValueError):
            Settings().set(name, value)
    with pytest.raises(KeyError):
        Settings().set("nope", 1)


def test_queries_read_kept_tables_until_they_change(session):
    session.sql("CREATE TABLE kept USING parquet AS SELECT id, id % 5 AS k FROM range(1000)")
    ask = lambda: session.query("SELECT k, sum(id) AS s FROM kept WHERE id > 10 GROUP BY k ORDER BY k")
    first = ask()
    assert first.ok and first.stats.scan_us >= 0 and not session.cache.entries
    again = ask()
    assert len(session.cache.entries) == 1 and again.rows == first.rows
    hits = session.cache.hits
    plan = session.sql("SELECT max(id) FROM kept")._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and ask().rows == first.rows and session.cache.hits == hits + 1
    session.sql("INSERT INTO kept VALUES (2000, 0)")
    assert not session.cache.entries and int(ask().rows[0][1]) == int(first.rows[0][1]) + 2000
    session.sql("SET engine.cache_tables = false")
    ask()
    assert not session.cache.entries
    session.sql("SET engine.cache_tables = true")
    session.sql("DROP TABLE kept")


def test_precision_settings_act(session):
    x = session.spark.sql("SELECT 0.1D AS x")
    exact, narrow = x.select(session.function("sin", "x")).first()[0], None
    session.sql("SET engine.relaxed_precision = true")
    narrow = x.select(session.function("sin", "x"), session.function("sqrt", "x")).first()
    assert narrow[0] != exact and abs(narrow[0] - exact) < 1e-7 and narrow[1] == 0.1**0.5
    session.sql("SET engine.relaxed_precision = false")
    session.sql("SET engine.strict_fp = true")
    with pytest.raises(ValueError):
        session.function("sin", "x")
    session.sql("SET engine.strict_fp = false")
    big = session.spark.range(200).select(F.sin("id"))
    assert any("below 100000" in r for r in session.advise(big).reasons)
    session.settings.min_rows = 100
    assert not any("below" in r for r in session.advise(big).reasons)
    session.settings.min_rows = 100_000


def test_changes_survive_a_crash_between_renames(session):
    session.sql("CREATE TABLE c USING parquet AS SELECT id FROM range(7)")
    session.sql(f"ALTER TABLE {session.schema}.c RENAME TO {session.schema}.c__old_0123abcd")
    session.sql(f"CREATE TABLE {session.schema}.c__new_0123abcd USING parquet AS SELECT id FROM range(3)")
    session.recover()
    assert session.spark.table("c").count() == 7
    assert [t.name for t in session.spark.catalog.listTables(session.schema) if t.name.startswith("c")] == ["c"]
    session.sql("DROP TABLE c")


def test_user_functions_take_batches(session):
    def twice(s: pd.Series) -> pd.Series:
        return s * 2

    session.register_function("twice", twice, "long")
    assert [r.rows for r in [session.query("SELECT sum(twice(id)) AS s FROM range(10)")]] == [[["90"]]]


def test_log_rotates_and_filters(tmp_path):
    log = ActivityLog(str(tmp_path / "a.jsonl"), "info", cap_bytes=2000)
    for i in range(100):
        log.write("info", "x", i=i)
        log.write("debug", "hidden")
    rows = log.read()
    assert rows[-1]["i"] == 99 and 5 < len(rows) < 100 and all(r["event"] == "x" for r in rows)
    ActivityLog(None).write("error", "nothing")
    ActivityLog("/nonexistent/dir/file").write("error", "nothing")


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(NULL AS INT) AS c, DATE '2020-01-02' AS d, true AS e, CAST(1.5 AS DECIMAL(4,2)) AS a")
    rows = df.collect()
    assert json.loads(json_rows(rows, df.columns)) == [{"a": 1, "b": "x", "c": None, "d": "2020-01-02", "e": True, "a_1": 1.5}]
    assert string_rows(spark.range(3), 5) == ([["0"], ["1"], ["2"]], False)
    with pytest.raises(ValueError):
        string_rows(df, -1)
    write_table(spark.range(4).selectExpr("id", "id % 2 AS k"), str(tmp_path / "csv"), "csv")
    assert read_csv(spark, str(tmp_path / "csv"), "id long, k long").count() == 4
    write_table(spark.range(4).selectExpr("id", "id % 2 AS k"), str(tmp_path / "p"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 1").count() == 2


def test_batches_keep_order_and_sizes(spark):
    df = spark.range(0, 1000, 1, 3)
    got = list(batches(df, 300))
    assert [len(b) for b in got] == [300, 300, 300, 100]
    assert [r.id for b in got for r in b] == list(range(1000))
    assert list(batches(df.where("id < 0"))) == [] and len(next(batches(df, 0))) == 1


def run_cli(*args, text=""):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(list(args), io.StringIO(text), out, err)
    return code, out.getvalue(), err.getvalue()


def test_cli(spark, sf_dir, tmp_path):
    code, out, _ = run_cli(sf_dir, "-json", "-c", "SELECT count(*) AS n FROM nation; SELECT n_name FROM nation ORDER BY 1", "--max-rows", "2")
    assert code == 0 and [json.loads(x) for x in out.splitlines()][0] == [{"n": 25}] and len(json.loads(out.splitlines()[1])) == 2
    code, _, err = run_cli("-c", "SELECT nope FROM nothing")
    assert code == 1 and err.startswith("Error:")
    f = tmp_path / "q.sql"
    f.write_text("SELECT 1 AS one")
    code, out, err = run_cli("-f", str(f), "--trace")
    assert code == 0 and "one" in out and "wall:" in err and "advice:" in err
    assert "cores" in run_cli("--probe")[1]


def test_serve_ends_every_reply(spark):
    _, out, _ = run_cli("--serve", "-json", text="SELECT 1 AS a;\n--END--\nSELECT broken\nFROM nowhere\n--END--\nSELECT 2 AS b\n--END--\n")
    blocks = out.split("--DONE--\n")
    assert len(blocks) == 4 and json.loads(blocks[0]) == [{"a": 1}] and "Error" in blocks[1] and json.loads(blocks[2]) == [{"b": 2}]
