"""The benchmark's log table, as expressions over row numbers, and its six queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the benchmark.
SERVICES = ("api", "worker", "auth", "billing", "search", "ingest", "cdn", "edge")
HOSTS = ("host-a", "host-b", "host-c", "host-d", "host-e", "host-f", "host-g", "host-h", "host-i", "host-j", "host-k", "host-l", "host-m", "host-n", "host-o", "host-p")
MESSAGES = (
    "request completed", "request retried", "cache miss", "cache warm", "upstream timeout", "upstream reset", "auth failed", "auth refreshed",
    "job queued", "job started", "job finished", "rate limited", "disk spill", "checkpoint written", "connection reused", "connection opened",
)
CREATE = "CREATE TABLE logs (ts TIMESTAMP, level TEXT, service TEXT, host TEXT, request_id INT, status INT, duration REAL, bytes INT, message TEXT)"
QUERIES = {
    "q1_errors_by_service": "SELECT service, COUNT(*) AS errors FROM logs WHERE ts >= 1700500000 AND level = 'error' GROUP BY service ORDER BY errors DESC LIMIT 5",
    "q2_avg_duration_5xx": "SELECT host, AVG(duration) AS avg_ms FROM logs WHERE status >= 500 GROUP BY host ORDER BY avg_ms DESC LIMIT 10",
    "q3_slow_count": "SELECT COUNT(*) AS slow_requests FROM logs WHERE duration >= 700.0",
    "q4_projection": "SELECT ts, service, host, status FROM logs WHERE level = 'error' AND status >= 503 AND duration >= 700.0 ORDER BY ts DESC LIMIT 25",
    "q5_high_cardinality": "SELECT request_id, COUNT(*) AS total FROM logs WHERE status >= 500 GROUP BY request_id ORDER BY total DESC LIMIT 25",
    "q6_string_groups": "SELECT message, COUNT(*) AS total FROM logs WHERE bytes >= 4096 GROUP BY message ORDER BY total DESC LIMIT 10",
}


def _pick(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def logs(spark: SparkSession, rows: int) -> DataFrame:
    i = F.col("id")
    level = F.when(i % 17 == 0, "error").when(i % 7 == 0, "warn").otherwise("info")
    return spark.range(rows).select(
        (i + 1_700_000_000).alias("ts"),
        level.alias("level"),
        _pick(SERVICES, i).alias("service"),
        _pick(HOSTS, F.floor(i / 11)).alias("host"),
        i.alias("request_id"),
        F.when(i % 17 == 0, i % 8 + 500).otherwise(i % 5 + 200).alias("status"),
        (F.lit(4.0) + (i % 1000).cast("double") * F.lit(1.37)).alias("duration"),
        ((i * 31) % 65536 + 256).alias("bytes"),
        _pick(MESSAGES, F.floor(i / 97)).alias("message"),
    )
