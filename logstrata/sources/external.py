"""Parquet that others wrote, as tables of the data model: timestamps are read as whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.errors import EngineError
from logstrata.operators.select import INSTANT, quoted, select
from logstrata.plans import ir
from logstrata.plans.parser import parse
from logstrata.types import TIMESTAMP


def adapted(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds since the epoch; the stored ones stay as hidden columns for filters to be pushed down."""
    columns, instants = [], []
    for field in df.schema:
        column = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            columns.append(F.unix_micros(column.cast("timestamp")).alias(field.name, metadata={"sql_type": TIMESTAMP}))
            instants.append(column.alias(INSTANT + field.name))
        else:
            columns.append(column)
    return df.select(*columns, *instants)


def query_parquet(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The result of one SELECT over ``folder``/<table>.parquet."""
    from logstrata.operators.select import evaluate_row

    commands = parse(sql)
    if len(commands) != 1 or not isinstance(commands[0], (ir.Select, ir.Eval)):
        raise EngineError("exactly one SELECT is expected")
    plan = commands[0]
    if isinstance(plan, ir.Eval):
        return evaluate_row(spark, plan)
    return select(plan, adapted(spark.read.parquet(f"{folder}/{plan.table}.parquet")))
