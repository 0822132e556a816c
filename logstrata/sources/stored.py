"""Registered queries that go through the engine's own tables: created, filled, renamed, described and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.database import Database, Options
from logstrata.functions.buckets import bucket
from logstrata.sources import workload


def _open(spark: SparkSession, **options) -> Database:
    """A new database in the folder that executors share, or a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tables-")
    return Database(spark, f"{base.rstrip('/')}/db-{uuid.uuid4().hex}", Options(**options))


def ddl_show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _open(spark)
    db.execute_sql("CREATE TABLE b (x INT); CREATE TABLE a (x INT); CREATE TABLE c (x INT); DROP TABLE c; ALTER TABLE b RENAME TO logs")
    return db.execute_one("SHOW TABLES").frame


def ddl_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _open(spark)
    db.execute_sql("CREATE TABLE IF NOT EXISTS t (ts DATETIME, level VARCHAR, n BIGINT, x DOUBLE PRECISION, ok BOOLEAN); ALTER TABLE t RENAME COLUMN n TO status")
    return db.execute_one("DESCRIBE t").frame


def ins_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by SQL, with NULLs, over several flushes and a reopening."""
    db = _open(spark, row_group_size=2)
    db.execute_sql("CREATE TABLE t (id INT, note TEXT, x REAL); INSERT INTO t VALUES (1, NULL, 1), (2, 'it''s', -2.5), (3, NULL, NULL); INSERT INTO t VALUES (4, '', 0.0)")
    db.flush_all()
    again = Database(spark, db.path, Options())
    return again.execute_one("SELECT id, note, x FROM t WHERE note IS NULL OR id >= 2 ORDER BY id").frame


def ins_frame_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table stored by the executors, then queried after a rename."""
    db = _open(spark)
    db.execute_sql("CREATE TABLE o (o_orderkey INT, o_orderstatus TEXT, o_totalprice REAL)")
    db.insert_frame("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    db.execute_sql("ALTER TABLE o RENAME COLUMN o_orderstatus TO status")
    return db.execute_one("SELECT status, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_orderkey) AS last FROM o GROUP BY status").frame


def ins_columnar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _open(spark, row_group_size=8)
    db.execute_sql("CREATE TABLE n (k INT, name TEXT)")
    db.insert_columnar_batch("n", spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")).toArrow())
    return db.execute_one("SELECT k, name FROM n WHERE k >= 3").frame


def bench_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's generated table of a million rows, grouped by service and level."""
    db = _open(spark)
    db.execute_sql(workload.CREATE)
    db.insert_frame("logs", workload.logs(spark, 1_000_000))
    return db.execute_one("SELECT service, level, COUNT(*) AS n, SUM(bytes) AS bytes, MAX(status) AS top FROM logs WHERE status >= 201 GROUP BY service, level").frame


def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the minute's beginning, which the dialect groups by."""
    db = _open(spark)
    db.execute_sql("CREATE TABLE e (minute_bucket TIMESTAMP, value REAL)")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    db.insert_frame("e", spark.read.parquet(f"{sf_dir}/events.parquet").select(bucket(micros, 60_000_000).alias("minute_bucket"), "value"))
    return db.execute_one("SELECT minute_bucket, COUNT(*) AS n, MAX(value) AS top FROM e GROUP BY minute_bucket").frame


_BOOLS = "CREATE TABLE t (id INT, ok BOOL); INSERT INTO t VALUES (1, TRUE), (2, FALSE), (3, NULL), (4, TRUE), (5, FALSE), (6, TRUE)"


def flt_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth values are equal or not; they have no order, so a comparison by it selects nothing, and NULL passes none."""
    db = _open(spark, row_group_size=2)
    db.execute_sql(_BOOLS)
    return db.execute_one("SELECT id, ok FROM t WHERE ok = TRUE OR ok <> TRUE AND id >= 5 OR ok < TRUE OR ok >= FALSE").frame


def agg_bool_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _open(spark, row_group_size=2)
    db.execute_sql(_BOOLS)
    return db.execute_one("SELECT ok, COUNT(*) AS n, MAX(id) AS last FROM t GROUP BY ok").frame


def agg_timestamp_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day, grouped by a stored table's timestamps."""
    db = _open(spark)
    db.execute_sql("CREATE TABLE e (day TIMESTAMP, user_id INT)")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    db.insert_frame("e", spark.read.parquet(f"{sf_dir}/events.parquet").select(bucket(micros, 86_400_000_000).alias("day"), "user_id"))
    return db.execute_one("SELECT day, COUNT(*) AS n, MIN(user_id) AS first FROM e GROUP BY day").frame


def ins_order_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ORDER BY, the first rows that match are those ingested first, across files, row groups and rows that wait."""
    db = _open(spark, row_group_size=1000, preserve_order=True)
    db.execute_sql("CREATE TABLE logs (id INT, service TEXT, status INT)")
    services = ["api", "worker", "auth", "billing"]
    batch = {"id": range(70_000), "service": [services[i % 4] for i in range(70_000)], "status": [503 if i % 3 == 0 else 200 for i in range(70_000)]}
    db.insert_columnar_batch("logs", {k: list(v) for k, v in batch.items()})
    db.insert_rows("logs", [(70_000 + i, "late", 503) for i in range(7)])
    return db.execute_one("SELECT id, service FROM logs WHERE status = 503 AND id >= 60000 LIMIT 3340").frame


def ins_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that wait are seen by statements, which flush them, and not by reads beside."""
    db = _open(spark, row_group_size=1000)
    db.execute_sql("CREATE TABLE t (ts TIMESTAMP, service TEXT); CREATE TABLE seen (reader TEXT, n INT)")
    db.insert_row("t", (1, "api"))
    waiting = db.query("SELECT COUNT(*) AS n FROM t")[0].rows()[0][0]
    flushed = db.execute_one("SELECT COUNT(*) AS n FROM t").rows()[0][0]
    after = db.query("SELECT COUNT(*) AS n FROM t")[0].rows()[0][0]
    db.insert_rows("seen", [("query", waiting), ("execute", flushed), ("query again", after)])
    return db.execute_one("SELECT reader, n FROM seen").frame


def ins_rename_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed tables and columns, a dropped table, and rows from several appends, as another handle finds them."""
    db = _open(spark, row_group_size=2)
    db.execute_sql("CREATE TABLE logs (ts TIMESTAMP, service TEXT, status INT); CREATE TABLE gone (id INT); INSERT INTO logs VALUES (1, 'api', 200), (2, 'web', 503), (3, 'api', 503)")
    db.execute_sql("ALTER TABLE logs RENAME TO app_logs; ALTER TABLE app_logs RENAME COLUMN service TO source; DROP TABLE gone")
    db.insert_frame("app_logs", spark.createDataFrame([(4, "web", 200)], "ts long, source string, status long"))
    db.flush_all()
    again = Database(spark, db.path, Options())
    return again.execute_one("SELECT source, COUNT(*) AS n, MAX(status) AS top FROM app_logs GROUP BY source").frame


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        ddl_show_tables, ddl_describe, ins_values, ins_frame_aggregate, ins_columnar_batch, bench_logs, time_buckets,
        flt_bool, agg_bool_key, agg_timestamp_key, ins_order_kept, ins_pending, ins_rename_reopen,
    )
}

ORACLE_SQL = {
    "ddl_show_tables": "SELECT unnest(['a', 'logs']) AS table_name",
    "ddl_describe": "SELECT * FROM (VALUES ('ts', 'TIMESTAMP'), ('level', 'TEXT'), ('status', 'INT'), ('x', 'REAL'), ('ok', 'BOOL')) AS t(column_name, data_type)",
    "ins_values": "SELECT id::BIGINT AS id, note, x::DOUBLE AS x FROM (VALUES (1, NULL, 1.0), (2, 'it''s', -2.5), (3, NULL, NULL), (4, '', 0.0)) AS t(id, note, x)",
    "ins_frame_aggregate": "SELECT o_orderstatus AS status, count(*) AS n, min(o_totalprice) AS lo, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "ins_columnar_batch": "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_nationkey >= 3",
    "bench_logs": """
SELECT service, level, count(*) AS n, sum(bytes)::DOUBLE AS bytes, max(status)::BIGINT AS top FROM (
    SELECT ['api', 'worker', 'auth', 'billing', 'search', 'ingest', 'cdn', 'edge'][i % 8 + 1] AS service,
           CASE WHEN i % 17 = 0 THEN 'error' WHEN i % 7 = 0 THEN 'warn' ELSE 'info' END AS level,
           CASE WHEN i % 17 = 0 THEN 500 + i % 8 ELSE 200 + i % 5 END AS status, 256 + (i * 31) % 65536 AS bytes
    FROM range(1000000) AS r(i)) WHERE status >= 201 GROUP BY service, level""",
    "flt_bool": "SELECT id::BIGINT AS id, ok FROM (VALUES (1, TRUE), (2, FALSE), (3, NULL), (4, TRUE), (5, FALSE), (6, TRUE)) AS t(id, ok) WHERE ok OR (NOT ok AND id >= 5)",
    "agg_bool_key": "SELECT ok, count(*) AS n, max(id)::BIGINT AS last FROM (VALUES (1, TRUE), (2, FALSE), (3, NULL), (4, TRUE), (5, FALSE), (6, TRUE)) AS t(id, ok) GROUP BY ok",
    "agg_timestamp_key": "SELECT epoch_us(ts) - epoch_us(ts) % 86400000000 AS day, count(*) AS n, min(user_id) AS first FROM events GROUP BY 1",
    "ins_order_kept": """
SELECT i AS id, CASE WHEN i >= 70000 THEN 'late' ELSE ['api', 'worker', 'auth', 'billing'][i % 4 + 1] END AS service
FROM range(60000, 70007) AS r(i) WHERE i % 3 = 0 OR i >= 70000 ORDER BY i LIMIT 3340""",
    "ins_pending": "SELECT * FROM (VALUES ('query', 0::BIGINT), ('execute', 1), ('query again', 1)) AS t(reader, n)",
    "ins_rename_reopen": "SELECT * FROM (VALUES ('api', 2::BIGINT, 503::BIGINT), ('web', 2, 503)) AS t(source, n, top)",
    "time_buckets": "SELECT epoch_us(ts) - epoch_us(ts) % 60000000 AS minute_bucket, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
}
