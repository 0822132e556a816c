"""Log and time-series tables on Spark: a small SQL dialect planned as DataFrames over Parquet."""

from importlib import import_module

_WHERE = {
    "logstrata.database": ("Database", "Options", "Result"),
    "logstrata.errors": ("EngineError",),
    "logstrata.sources.batches": ("BatchBuilder", "ColumnarBatch"),
    "logstrata.types": ("BOOL", "INT", "REAL", "TEXT", "TIMESTAMP", "ColumnDef", "Schema"),
}
__all__ = sorted(n for names in _WHERE.values() for n in names)


def __getattr__(name: str):
    """Names are found when asked for, so that workers import only what their functions need."""
    for module, names in _WHERE.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(name)
