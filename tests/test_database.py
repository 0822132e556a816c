import json
import math
import os
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from logstrata import BatchBuilder, ColumnDef, Database, EngineError, Options, Schema
from logstrata.functions.arithmetic import evaluate
from logstrata.plans.parser import parse
from logstrata.sources import workload


@pytest.fixture
def db(spark, tmp_path):
    with Database.open(str(tmp_path / "db"), Options(row_group_size=2), spark) as found:
        yield found


def rows(db, sql):
    return db.execute_one(sql).rows()


LOGS = """CREATE TABLE logs (ts TIMESTAMP, level TEXT, service TEXT, status INT, duration REAL);
INSERT INTO logs VALUES (100, 'error', 'api', 503, 12.5), (101, 'info', 'web', 200, 3), (102, 'error', 'web', 500, 8.0)"""


def test_rows_survive_a_reopening(spark, db):
    db.execute_sql(LOGS)
    db.close()
    with Database.open(db.path, Options(), spark) as again:
        assert rows(again, "SELECT service, COUNT(*) AS n FROM logs WHERE level = 'error' AND ts >= 100 GROUP BY service ORDER BY service") == [("api", 1), ("web", 1)]


def test_groups_merge_across_files_and_projection_order_holds(db):
    db.execute_sql(LOGS)
    assert rows(db, "SELECT AVG(duration) AS d, service FROM logs GROUP BY service ORDER BY service") == [(12.5, "api"), (5.5, "web")]


def test_arithmetic_in_rows(db):
    db.execute_sql("CREATE TABLE p (name TEXT, price REAL, n INT); INSERT INTO p VALUES ('a', 10, 5), ('b', 7.5, 0), ('c', NULL, -7)")
    assert rows(db, "SELECT name, price * n AS total, n / 2 AS half, n % 3 AS rest, 7 / n AS inv, name * 2 AS none, -n AS neg FROM p ORDER BY name") == [
        ("a", 50.0, 2, 2, 1, None, -5),
        ("b", 0.0, 0, 0, None, None, 0),
        ("c", None, -3, -1, -1, None, 7),
    ]


def test_arithmetic_edges(db):
    least, most = -(1 << 63), (1 << 63) - 1
    db.create_table(Schema("e", (ColumnDef("i", "INT"), ColumnDef("f", "REAL"))))
    db.insert_rows("e", [(least, -0.0), (most, math.inf), (-1, math.nan), (0, 0.0)])
    got = rows(db, "SELECT i + 1 AS a, -i AS b, i / -1 AS c, i % -1 AS d, 1.0 / f AS g, f % 0.0 AS h FROM e ORDER BY a")
    assert got[0][:4] == (least + 1, None, None, None) and got[0][4] == -math.inf and math.isnan(got[0][5])
    assert got[-1][:4] == (None, -most, -most, 0) and got[-1][4] == 0.0
    assert got[2][4] == math.inf


def test_nulls_are_kept_apart(db):
    db.execute_sql("CREATE TABLE n (k TEXT, i INT, b BOOL); INSERT INTO n VALUES (NULL, NULL, NULL), ('', 0, FALSE), ('x', 1, TRUE), (NULL, 2, NULL), ('', NULL, FALSE)")
    assert sorted(rows(db, "SELECT k, COUNT(*) AS n, COUNT(i) AS m, SUM(i) AS s FROM n GROUP BY k"), key=str) == sorted([(None, 2, 1, 2.0), ("", 2, 1, 0.0), ("x", 1, 1, 1.0)], key=str)
    assert rows(db, "SELECT COUNT(*) FROM n WHERE i <> 1") == [(2,)]
    assert rows(db, "SELECT i FROM n WHERE i = NULL") == []
    assert rows(db, "SELECT COUNT(*) FROM n WHERE b < TRUE") == [(0,)]
    assert rows(db, "SELECT i FROM n ORDER BY i DESC LIMIT -1") == [(2,), (1,), (0,), (None,), (None,)]


def test_empty_aggregates(spark, db, tmp_path):
    db.execute_sql("CREATE TABLE z (i INT, t TEXT)")
    assert rows(db, "SELECT COUNT(*), SUM(i), MIN(i), AVG(i), MAX(t) FROM z") == [(0, 0.0, None, None, None)]
    assert rows(db, "SELECT t, SUM(i) FROM z GROUP BY t") == []
    with Database.open(str(tmp_path / "strict"), Options(strict_empty_aggregates=True), spark) as strict:
        strict.execute_sql("CREATE TABLE z (i INT)")
        with pytest.raises(Exception, match="aggregate had no values"):
            rows(strict, "SELECT MIN(i) FROM z")


def test_columnar_batches(db):
    db.execute_sql("CREATE TABLE c (ts TIMESTAMP, s TEXT, i INT, f REAL, b BOOL)")
    db.insert_row("c", (1, "a", 1, 1, None))
    batch = BatchBuilder().timestamps([2, 3, 4]).strings(["b", None, "d"]).int64([2, None, 4]).float64([0.5, 1.5, None]).bools([True, False, None]).build()
    assert db.insert_columnar_batch("c", batch) == 3
    assert rows(db, "SELECT ts, s, i, f, b FROM c ORDER BY ts") == [(1, "a", 1, 1.0, None), (2, "b", 2, 0.5, True), (3, None, None, 1.5, False), (4, "d", 4, None, None)]
    for bad, message in (
        (BatchBuilder().int64([1]).build(), "column count mismatch"),
        (BatchBuilder().timestamps([1]).strings(["x"]).strings(["x"]).float64([1.0]).bools([True]).build(), "column type mismatch for i"),
    ):
        with pytest.raises(EngineError, match=message):
            db.insert_columnar_batch("c", bad)
    with pytest.raises(EngineError, match="column length mismatch"):
        BatchBuilder().int64([1]).int64([1, 2]).build()


def test_nulls_over_several_files_of_one_call(db):
    """NULLs of one file must not show up in the next."""
    db.execute_sql("CREATE TABLE w (i INT, v TEXT)")
    db.insert_rows("w", [(i, None if i < 4 else f"v{i}") for i in range(12)])
    db.insert_columnar_batch("w", {"i": list(range(12, 18)), "v": pa.array([None] * 2 + ["x"] * 4)})
    assert rows(db, "SELECT COUNT(*) FROM w WHERE v IS NULL") == [(6,)]
    assert rows(db, "SELECT i FROM w WHERE v IS NULL ORDER BY i") == [(i,) for i in (0, 1, 2, 3, 12, 13)]


def test_insertion_checks(db):
    db.execute_sql("CREATE TABLE k (i INT, f REAL, ts TIMESTAMP)")
    for row, message in (((1, 2.0), "row width mismatch"), ((1.5, 1.0, 1), "type mismatch"), ((1, 1.0, "x"), "type mismatch"), ((True, 1.0, 1), "type mismatch")):
        with pytest.raises(EngineError, match=message):
            db.insert_rows("k", [(0, 0.0, 0), row])
    assert rows(db, "SELECT COUNT(*) FROM k") == [(0,)]  # nothing of a refused call is taken
    assert db.insert_rows_iter("k", ((i, i, i) for i in range(5))) == 5


def test_names_change_and_stay(spark, db):
    db.execute_sql(LOGS + "; ALTER TABLE logs RENAME TO events; ALTER TABLE events RENAME COLUMN service TO source; CREATE TABLE other (x INT)")
    db.close()
    with Database.open(db.path, Options(), spark) as again:
        assert rows(again, "SHOW TABLES") == [("events",), ("other",)]
        assert rows(again, "SELECT source, COUNT(*) AS n FROM events GROUP BY source ORDER BY source") == [("api", 1), ("web", 2)]
        assert rows(again, "DESCRIBE events") == [("ts", "TIMESTAMP"), ("level", "TEXT"), ("source", "TEXT"), ("status", "INT"), ("duration", "REAL")]
        again.execute_sql("DROP TABLE other; DROP TABLE IF EXISTS other; ALTER TABLE IF EXISTS none RENAME TO x; ALTER TABLE IF EXISTS none RENAME COLUMN a TO b; CREATE TABLE IF NOT EXISTS events (a INT)")
        for sql, message in (
            ("DROP TABLE other", "unknown table other"),
            ("CREATE TABLE events (a INT)", "table events already exists"),
            ("CREATE TABLE d (a INT, a TEXT)", "column a already exists"),
            ("ALTER TABLE events RENAME COLUMN nope TO x", "unknown column nope"),
            ("ALTER TABLE events RENAME COLUMN source TO level", "column level already exists"),
            ("SELECT nope FROM events", "unknown column nope"),
            ("SELECT Source FROM events", "unknown column Source"),
            ("SELECT source FROM events ORDER BY ts", "ORDER BY field ts not found in result set"),
            ("SELECT source, COUNT(*) FROM events", "must appear in GROUP BY"),
            ("SELECT ts + 1, COUNT(*) FROM events GROUP BY ts", "scalar expressions in aggregate queries"),
            ("SELECT * FROM events GROUP BY ts", "does not support GROUP BY"),
            ("SELECT SUM(source) FROM events", "SUM expects a numeric column"),
            ("SELECT ts FROM events WHERE status = 500.5", "type mismatch"),
            ("SELECT ts FROM events WHERE ts = 'x'", "type mismatch"),
        ):
            with pytest.raises(EngineError, match=message):
                again.execute_sql(sql)
        assert rows(again, "SELECT COUNT(*) FROM events WHERE duration >= 8") == [(2,)]


def test_waiting_rows_show_to_execute_only(spark, tmp_path):
    with Database.open(str(tmp_path / "db"), Options(), spark) as db:
        db.execute_sql("CREATE TABLE t (i INT)")
        db.insert_row("t", (1,))
        assert db.query("SELECT COUNT(*) FROM t")[0].rows() == [(0,)]
        assert rows(db, "SELECT COUNT(*) FROM t") == [(1,)]
        with pytest.raises(EngineError, match="unexpected write command in read path"):
            db.query("INSERT INTO t VALUES (2)")


def test_parse_errors_stop_all_and_run_errors_stop_the_rest(db):
    with pytest.raises(EngineError):
        db.execute_sql("CREATE TABLE t (i INT); SELEKT")
    assert rows(db, "SHOW TABLES") == []
    with pytest.raises(EngineError):
        db.execute_sql("CREATE TABLE t (i INT); INSERT INTO t VALUES ('x'); INSERT INTO t VALUES (1)")
    assert rows(db, "SELECT COUNT(*) FROM t") == [(0,)]


def test_order_of_ingestion_and_compaction(spark, tmp_path):
    with Database.open(str(tmp_path / "db"), Options(row_group_size=1000, preserve_order=True), spark) as db:
        db.execute_sql("CREATE TABLE t (i INT)")
        values = [(i * 7919 % 10007,) for i in range(10007)]
        db.insert_rows("t", values[:6000])
        db.insert_rows("t", values[6000:])
        assert rows(db, "SELECT i FROM t") == values
        assert rows(db, "SELECT * FROM t LIMIT 5") == values[:5]
        db.compact("t")
        assert rows(db, "SELECT i FROM t") == values


def test_ties_at_the_limit(db):
    db.execute_sql("CREATE TABLE t (k INT)")
    db.insert_rows("t", [(i % 64,) for i in range(64)] + [(1,), (2,), (2,)])
    got = rows(db, "SELECT k, COUNT(*) AS n FROM t GROUP BY k ORDER BY n DESC LIMIT 25")
    assert got[:2] == [(2, 3), (1, 2)] and len(got) == 25 and {n for _, n in got[2:]} == {1}


@pytest.mark.parametrize(("sql", "value"), [("2 + 3 * 4", 14), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7.0 / 2", 3.5), ("1.0 / 0.0", math.inf), ("'x'", "x"), ("NULL", None), ("TRUE", True)])
def test_evaluation(sql, value):
    assert evaluate(parse(f"SELECT {sql} AS v")[0].projections[0].expr) == value


@pytest.mark.parametrize(
    ("sql", "message"),
    [("1 / 0", "division by zero"), ("9223372036854775807 + 1", "integer overflow"), ("a + 1", "not valid without a table"), ("'x' + 1", "unsupported arithmetic"), ("-'x'", "cannot negate"), ("-9223372036854775807 - 2", "integer overflow")],
)
def test_evaluation_errors(db, sql, message):
    with pytest.raises(EngineError, match=message):
        db.execute_sql(f"SELECT {sql} AS v")


def test_eval_result(db):
    assert db.execute_one("SELECT 5 * (3 - 2) AS v, 'a' AS s").rows() == [(5, "a")]
    with pytest.raises(EngineError, match="needs a table"):
        db.execute_one("SELECT 1 WHERE 1 = 1")


def test_options():
    with pytest.raises(EngineError, match="query_threads must be greater than zero"):
        Options(query_threads=0)


def test_flush_at_intervals(spark, tmp_path):
    with Database.open(str(tmp_path / "db"), Options(auto_flush_interval=0.2), spark) as db:
        db.execute_sql("CREATE TABLE t (i INT)")
        db.insert_row("t", (1,))
        done = threading.Event()
        for _ in range(100):
            if db.query("SELECT COUNT(*) FROM t")[0].rows() == [(1,)]:
                break
            done.wait(0.1)
        else:
            pytest.fail("not flushed")


def test_frames_and_pushdown(spark, db):
    db.execute_sql(workload.CREATE)
    assert db.insert_frame("logs", workload.logs(spark, 5000)) == 5000
    assert rows(db, "SELECT COUNT(*) AS n, SUM(bytes) AS b FROM logs WHERE level = 'error' AND ts >= 1700000000") == [(295, float(sum(256 + i * 31 % 65536 for i in range(0, 5000, 17))))]
    plan = db.execute_one("SELECT service FROM logs WHERE ts >= 1700000100 AND level = 'error'").frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c0,1700000100)" in plan and "EqualTo(c1,error)" in plan
    assert "ReadSchema: struct<c0:bigint,c1:string,c2:string>" in plan


def test_a_foreign_catalog_is_refused(spark, tmp_path):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "catalog.json").write_text("{}")
    with pytest.raises(EngineError, match="invalid database header"):
        Database.open(str(tmp_path / "db"), Options(), spark)


def test_files_count_once_the_catalog_names_them(spark, db, monkeypatch):
    db.execute_sql(LOGS)
    frame = spark.createDataFrame([(200, "warn", "api", 1, 1.0)], "ts long, level string, service string, status long, duration double")
    db.flush_all()

    def fails():
        raise OSError("no space")

    with monkeypatch.context() as patch:  # the process ends between the write and the catalog
        patch.setattr(db.catalog, "save", fails)
        for insert in (lambda: db.insert_frame("logs", frame), lambda: db.insert_rows("logs", [(300 + i, "late", "x", 1, 1.0) for i in range(4)])):
            with pytest.raises(OSError):
                insert()
    with Database.open(db.path, Options(), spark) as again:
        assert rows(again, "SELECT COUNT(*) AS n FROM logs")[0][0] == 3
    # The rows of the second go on waiting, and are written once.
    assert rows(db, "SELECT ts FROM logs WHERE ts >= 200 ORDER BY ts") == [(300 + i,) for i in range(4)]


def test_a_second_handle_does_not_undo_the_first(spark, db):
    db.execute_sql("CREATE TABLE a (x INT)")
    other = Database(spark, db.path, Options())
    db.execute_sql("CREATE TABLE b (x INT)")
    with pytest.raises(EngineError, match="another handle"):
        other.execute_sql("CREATE TABLE c (x INT)")
    assert [r[0] for r in rows(Database(spark, db.path, Options()), "SHOW TABLES")] == ["a", "b"]


def test_stream_batches_are_told_by_number(spark, db):
    db.execute_sql("CREATE TABLE t (x INT)")
    frame = spark.range(3).withColumnRenamed("id", "x")
    assert db.insert_frame("t", frame, ("checkpoint", 0)) == 3
    with Database.open(db.path, Options(), spark) as again:  # after a restart, the batch is tried again
        assert again.insert_frame("t", frame, ("checkpoint", 0)) == 0
        assert again.insert_frame("t", frame.limit(0), ("checkpoint", 1)) == 0
        assert again.insert_frame("t", frame, ("checkpoint", 2)) == 3
        assert rows(again, "SELECT COUNT(*) AS n FROM t") == [(6,)]


def test_appends_do_not_read_what_is_stored(spark, db, monkeypatch):
    db.execute_sql("CREATE TABLE t (x INT)")
    monkeypatch.setattr(db.catalog, "read", lambda name: pytest.fail("read"))
    for _ in range(2):
        assert db.insert_frame("t", spark.range(5).withColumnRenamed("id", "x")) == 5
    monkeypatch.undo()
    assert db.catalog.table("t").rows > 5 and rows(db, "SELECT COUNT(*) AS n FROM t") == [(10,)]


def test_row_groups_are_as_asked_and_batches_written_side_by_side(spark, tmp_path, monkeypatch):
    from logstrata.sources import catalog

    monkeypatch.setattr(catalog, "FILE_ROWS", 30)
    with Database.open(str(tmp_path / "db"), Options(row_group_size=10, preserve_order=True), spark) as db:
        db.execute_sql("CREATE TABLE t (x INT, s TEXT)")
        n = 30 * (os.cpu_count() or 1) + 7
        db.insert_columnar_batch("t", {"x": list(range(n)), "s": [f"s{i % 3}" for i in range(n)]})
        files = sorted((tmp_path / "db" / db.catalog.table("t").folder).glob("part-*"))
        assert len(files) == len(db.catalog.table("t").parts) > 1 or (os.cpu_count() or 1) == 1
        groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
        assert set(groups) == {10} and sum(groups) == n // 10 * 10
        db.insert_rows("t", [(n + i, "tail") for i in range(2)])  # after columns that wait
        db.insert_columnar_batch("t", {"x": [n + 2], "s": ["last"]})
        assert rows(db, f"SELECT x FROM t LIMIT {n + 3}") == [(i,) for i in range(n + 3)]


def test_an_older_catalog_is_read(spark, db):
    db.execute_sql(LOGS)
    db.flush_all()
    found = json.loads(open(f"{db.path}/catalog.json").read())
    for table in found["tables"].values():
        table["files"] = len(table.pop("parts"))
        del table["batches"]
    with open(f"{db.path}/catalog.json", "w") as out:
        json.dump({"format": 1, "tables": found["tables"]}, out)
    for hidden in [f"{db.path}/.catalog.json.crc"]:
        if os.path.exists(hidden):
            os.remove(hidden)
    again = Database(spark, db.path, Options())
    assert rows(again, "SELECT COUNT(*) AS n FROM logs") == [(3,)]
    again.execute_sql("INSERT INTO logs VALUES (103, 'x', 'y', 1, 1.0)")
    assert rows(again, "SELECT COUNT(*) AS n FROM logs") == [(4,)]


def test_cached_columns_go_when_the_table_changes(spark, db):
    db.execute_sql(LOGS)
    db.cache("logs")
    cached = lambda: "InMemoryTableScan" in db.execute_one("SELECT ts FROM logs WHERE status > 300").frame._jdf.queryExecution().executedPlan().toString()
    assert cached() and rows(db, "SELECT COUNT(*) AS n FROM logs WHERE status > 300") == [(2,)]
    db.execute_sql("INSERT INTO logs VALUES (103, 'error', 'web', 500, 8.0)")
    assert rows(db, "SELECT COUNT(*) AS n FROM logs WHERE status > 300") == [(3,)] and not cached()
    db.cache("logs")
    db.execute_sql("ALTER TABLE logs RENAME TO l; ALTER TABLE l RENAME COLUMN status TO code")
    assert rows(db, "SELECT COUNT(*) AS n FROM l WHERE code > 300") == [(3,)]
    db.uncache("l")
    db.execute_sql("DROP TABLE l")


def test_zoned_timestamps_are_filtered_by_the_reader(spark, tmp_path):
    from logstrata.sources.external import query_parquet

    spark.sql("SELECT timestamp_micros(id * 1000000) AS zoned, CAST(timestamp_micros(id * 1000000) AS timestamp_ntz) AS plain, id FROM range(100)").write.parquet(str(tmp_path / "t.parquet"))
    for column in ("zoned", "plain"):
        df = query_parquet(spark, str(tmp_path), f"SELECT id, {column} FROM t WHERE {column} >= 90000000 AND {column} <> 95000000")
        assert f"GreaterThanOrEqual({column}," in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r[1] for r in df.collect()) == [i * 1_000_000 for i in range(90, 100) if i != 95]


@pytest.mark.parametrize("sync", [True, False])
def test_files_are_synced_as_asked(spark, tmp_path, monkeypatch, sync):
    calls = []
    monkeypatch.setattr(os, "fsync", calls.append)
    with Database.open(str(tmp_path / "db"), Options(row_group_size=2, sync_on_flush=sync), spark) as db:
        db.execute_sql("CREATE TABLE t (x INT); INSERT INTO t VALUES (1), (2), (3)")
        db.flush_all()
        assert len(calls) == (2 if sync else 0) and rows(db, "SELECT COUNT(*) AS n FROM t") == [(3,)]


def test_the_catalog_is_old_or_new(spark, db, monkeypatch):
    """A catalog is written beside the one that counts and then takes its place: a failure in between leaves the old one."""
    db.execute_sql("CREATE TABLE a (x INT)")
    before = db.catalog.files.read(db.catalog.path)
    replace = type(db.catalog.files).replace

    def stops(self, path, text):
        replace(self, path + ".elsewhere", text)
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(type(db.catalog.files), "replace", stops)
        with pytest.raises(OSError):
            db.execute_sql("CREATE TABLE b (x INT)")
    assert db.catalog.files.read(db.catalog.path) == before
    assert [r[0] for r in rows(Database(spark, db.path, Options()), "SHOW TABLES")] == ["a"]
