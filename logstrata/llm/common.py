"""What the operators share: tables, scratch space in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: they bound a worker's memory when texts are long (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Text bytes that the vectorised kernels take at a time (a longer text is taken alone).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configure(spark: SparkSession) -> None:
    """Bounds the Arrow batches; nothing else of the session is changed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def broadcasts(spark: SparkSession, most: int) -> Iterator[None]:
    """Joins that run within broadcast no table of more than so many bytes by Spark's estimate, or none larger than the session allows."""
    least = str(min(most, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", least), setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", least):
        yield


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is made only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_TABLES: ContextVar[list[str] | None] = ContextVar("scratch tables of the running call", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables written within. What is returned lazily must have been stored by then.

    Each call has its own list; outside of any, tables stay in the shared folder for as long as that is kept.
    """
    mark = _TABLES.set([])
    try:
        yield
    finally:
        for path in _TABLES.get() or []:
            delete(spark, path)
        _TABLES.reset(mark)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the scratch tables written within; they go on belonging to the scope around, if there is one."""
    around, tables = _TABLES.get(), []
    mark = _TABLES.set(tables)
    try:
        yield tables
    finally:
        _TABLES.reset(mark)
        if around is not None:
            around += tables


_SCRATCH, _NAME = "logstrata_scratch", re.compile(r"[a-z]+-[0-9a-f]{32}")


def marked(df: DataFrame, tables: list[str]) -> DataFrame:
    """The DataFrame with the names of the scratch tables it is made of in its first column's metadata, which stored tables keep."""
    first = df.schema.fields[0]
    return df.withMetadata(first.name, {**first.metadata, _SCRATCH: [t.rsplit("/", 1)[1] for t in tables]})


def let_go(stored: DataFrame) -> None:
    """Deletes the scratch tables that a table was made of before it was stored. One that is still to be computed from them keeps them."""
    names = [n for f in stored.schema for n in f.metadata.get(_SCRATCH, ()) if _NAME.fullmatch(n)]
    if names and not any(n in file for file in stored.inputFiles() for n in names):
        for n in names:
            delete(stored.sparkSession, f"{shared_dir(stored.sparkSession)}/{n}")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts the lineage, outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns of neutral names, which no operator's own names can meet, and these by the old ones."""
    names = {c: f"carried_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select([F.col(n).alias(c) for c, n in names.items()])


def carried(carry: Sequence[str], outputs: Sequence[str]) -> list[str]:
    """The columns that pass through: one of an output's name gives way to it, in every operator."""
    taken = {o.lower() for o in outputs}
    return [c for c in dict.fromkeys(carry) if c.lower() not in taken]


def neutral(df: DataFrame, carry: Sequence[str], **own: str) -> tuple[DataFrame, list[Column]]:
    """The operator's own columns, and the carried ones under names that meet no others; and what gives these back their names."""
    held = {c: o for o, c in own.items()}
    names = {c: held.get(c, f"carried_{i}") for i, c in enumerate(carry)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    sent = df.select(*(quoted(c).alias(o) for o, c in own.items()), *(quoted(c).alias(n) for c, n in names.items() if n not in own))
    return sent, [F.col(n).alias(c) for c, n in names.items()]


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """UTF-8 bytes of a string column, without nulls, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array; the offsets start anywhere."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (single rows may be longer)."""
    _, at = raw(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield start, min(stop, len(column))
        start = stop


def map_rows(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that returns the columns for a batch; empty batches pass as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def to_spark(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)
