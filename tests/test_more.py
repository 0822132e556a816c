"""Streaming, buckets, the command line, the registered queries, and random queries against DuckDB."""

import math
import os
import subprocess
import sys

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logstrata import Database, Options, types
from logstrata.functions.buckets import with_time_buckets
from logstrata.operators.select import select
from logstrata.plans.parser import parse
from logstrata.streaming.ingest import rollup, stream_into

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stream_into_a_table(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).select(F.col("id").alias("ts"), F.concat(F.lit("s"), F.col("id") % 3).alias("service")).write.parquet(source)
    with Database.open(str(tmp_path / "db"), Options(), spark) as db:
        db.execute_sql("CREATE TABLE logs (ts TIMESTAMP, service TEXT)")
        stream = spark.readStream.schema("ts long, service string").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            stream_into(db, "logs", stream, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert db.execute_one("SELECT service, COUNT(*) AS n FROM logs GROUP BY service ORDER BY service").rows() == [("s0", 34), ("s1", 33), ("s2", 33)]


def test_rollup(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0, 600_000, 1000).select(F.col("id").alias("ts"), (F.col("id") / 1000).alias("v")).coalesce(1).write.parquet(source)
    out = rollup(spark.readStream.schema("ts long, v double").parquet(source), "ts", "1 minute", "0 seconds", [], {"n": F.count(F.lit(1)), "top": F.max("v")})
    query = out.writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = sorted(tuple(r) for r in spark.sql("SELECT * FROM rolled").collect())
    assert rows[0] == (0, 60, 59.0) and len(rows) >= 9


def test_buckets(spark):
    df = with_time_buckets(spark.createDataFrame([(-1,), (0,), (59_999,), (86_400_001,)], "ts long"))
    assert [tuple(r) for r in df.collect()] == [(-1, -60_000, -86_400_000), (0, 0, 0), (59_999, 0, 0), (86_400_001, 86_400_000, 86_400_000)]


def test_values():
    assert types.compare(1, 1.5) == -1 and types.compare("é", "z") == 1 and types.compare(None, 1) is None and types.compare(True, 1) is None
    assert types.compare(math.nan, math.nan) == 0 and types.compare(math.nan, math.inf) == 1
    assert [types.display(v) for v in (None, True, 2.0, 0.5, "x")] == ["NULL", "true", "2", "0.5", "x"]


def test_command_line(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    run = lambda *args: subprocess.run([sys.executable, "-m", "logstrata", *args], capture_output=True, text=True, env=env, cwd=tmp_path, timeout=300)
    done = run("exec", str(tmp_path / "db"), "CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, NULL), (2, 'x'); SELECT a, b FROM t ORDER BY a DESC", "--query-threads", "2")
    assert done.stdout.splitlines() == ["a | b", "2 | x", "1 | NULL"], done.stderr[-2000:]
    assert "JOIN clauses" in run("exec", str(tmp_path / "db"), "SELECT * FROM a JOIN b ON a.x = b.x").stderr


def test_registered_queries_match(spark, sf_dir):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    from logstrata.plans import catalogue
    from logstrata.sources import stored

    shown = lambda rows: sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert entry.entry(spark).count() > 0
    for name in [*catalogue.TEXTS, *stored.QUERIES]:
        df = entry.queries()[name](spark, sf_dir)
        theirs = con.execute(entry.oracle_sql()[name])
        order = [d[0] for d in theirs.description]
        assert sorted(order) == sorted(df.columns), name
        assert shown(df.select(*[f"`{c}`" for c in order]).collect()) == shown(theirs.fetchall()), name


_COLUMNS = {"i": st.integers(-3, 3), "f": st.sampled_from([-1.5, 0.0, 0.5, 2.0]), "s": st.sampled_from(["", "a", "b", "B"])}


@st.composite
def _queries(draw):
    parts = []
    for _ in range(draw(st.integers(1, 3))):
        column = draw(st.sampled_from(sorted(_COLUMNS)))
        value = draw(_COLUMNS[column])
        text = f"'{value}'" if column == "s" else str(value)
        kind = draw(st.sampled_from(["compare", "null", "in"]))
        if kind == "compare":
            parts.append(f"{column} {draw(st.sampled_from(['=', '<>', '<', '<=', '>', '>=']))} {text}")
        elif kind == "null":
            parts.append(f"{column} IS {draw(st.sampled_from(['', 'NOT ']))}NULL")
        else:
            parts.append(f"{column} {draw(st.sampled_from(['', 'NOT ']))}IN ({text})")
    where = parts[0]
    for p in parts[1:]:
        where = f"({where}) {draw(st.sampled_from(['AND', 'OR']))} {p}"
    if draw(st.booleans()):
        return f"SELECT s, COUNT(*) AS n, COUNT(i) AS m, MIN(i) AS lo, MAX(f) AS hi FROM t WHERE {where} GROUP BY s"
    return f"SELECT i, s, f FROM t WHERE {where}"


@pytest.fixture(scope="module")
def random_table(spark):
    rows = [(i % 7 - 3 if i % 5 else None, [-1.5, 0.0, 0.5, 2.0][i % 4] if i % 6 else None, ["", "a", "b", "B"][i * 3 % 4] if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, f double, s string").coalesce(1).cache()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, f DOUBLE, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return df, con


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sql=_queries())
def test_random_queries(random_table, sql):
    df, con = random_table
    ours = sorted(map(str, (tuple(r) for r in select(parse(sql)[0], df).collect())))
    assert ours == sorted(map(str, con.execute(sql).fetchall())), sql


@pytest.mark.parametrize("missing", ["logstrata.llm", "sentencepiece", "xxhash"])
def test_without_the_llm_subpackage(tmp_path, missing):
    """The rest imports where the subpackage and the pipeline are missing, or a library that only they need."""
    for name in ("logstrata", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name)
    code = (
        "import sys, importlib.abc\n"
        "class Missing(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name.startswith({missing!r}) or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Missing())\n"
        "import __spark_entry__ as e\n"
        "assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); assert len(e.queries()) > 50\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
