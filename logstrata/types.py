"""Data types, values and schemas. Every column is nullable; a TIMESTAMP is a whole number in whatever unit the user stores."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from logstrata.errors import EngineError

INT, REAL, BOOL, TEXT, TIMESTAMP = "INT", "REAL", "BOOL", "TEXT", "TIMESTAMP"

#: The SQL names of each type.
SQL_NAMES = {
    INT: ("INT", "INTEGER", "BIGINT"),
    REAL: ("REAL", "FLOAT", "DOUBLE", "DOUBLE PRECISION"),
    BOOL: ("BOOL", "BOOLEAN"),
    TEXT: ("TEXT", "STRING", "VARCHAR", "CHAR", "JSON"),
    TIMESTAMP: ("TIMESTAMP", "DATETIME"),
}
_BY_NAME = {name: kind for kind, names in SQL_NAMES.items() for name in names}
_SPARK = {INT: T.LongType(), REAL: T.DoubleType(), BOOL: T.BooleanType(), TEXT: T.StringType(), TIMESTAMP: T.LongType()}
#: What holds a whole number, for the checks below.
WHOLE = (INT, TIMESTAMP)


def parse_type(name: str) -> str:
    kind = _BY_NAME.get(" ".join(name.upper().split()))
    if kind is None:
        raise EngineError(f"unsupported type: {name.upper()}")
    return kind


def spark_type(kind: str) -> T.DataType:
    return _SPARK[kind]


def kind_of(field: T.StructField) -> str | None:
    """The kind of a Spark column, None for what the data model lacks."""
    if (field.metadata or {}).get("sql_type") == TIMESTAMP:
        return TIMESTAMP
    data = field.dataType
    if isinstance(data, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT
    if isinstance(data, (T.DoubleType, T.FloatType)):
        return REAL
    if isinstance(data, T.BooleanType):
        return BOOL
    return TEXT if isinstance(data, T.StringType) else None


def value_kind(value: Any) -> str | None:
    """The kind of a Python value, None for NULL."""
    if value is None:
        return None
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT
    if isinstance(value, float):
        return REAL
    if isinstance(value, str):
        return TEXT
    raise EngineError(f"unsupported value: {value!r}")


def cast_for(kind: str, value: Any) -> Any:
    """A value as a column of this kind stores it. Only whole numbers widen; all else must match."""
    got = value_kind(value)
    if got is None or got == kind or (kind == TIMESTAMP and got == INT):
        if got == INT and not -(1 << 63) <= value < 1 << 63:
            raise EngineError(f"integer out of range: {value}")
        return value
    if kind == REAL and got == INT:
        return float(value)
    raise EngineError(f"type mismatch: expected {kind}, got {value!r}")


def compare(a: Any, b: Any) -> int | None:
    """-1, 0 or 1; None for NULL and for kinds that do not compare. NaN equals itself and is greatest; text goes by bytes."""
    ka, kb = value_kind(a), value_kind(b)
    if ka is None or kb is None:
        return None
    if ka == TEXT and kb == TEXT:
        a, b = a.encode(), b.encode()
    elif {ka, kb} <= {INT, REAL}:
        a, b = float(a) if ka != kb else a, float(b) if ka != kb else b
        if a != a or b != b:
            return (a != a) - (b != b)
    elif ka != kb:
        return None
    return (a > b) - (a < b)


def display(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.0f}" if value.is_integer() and abs(value) < 1e16 else repr(value)
    return str(value)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str


@dataclass(frozen=True)
class Schema:
    name: str
    columns: tuple[ColumnDef, ...]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, _SPARK[c.kind], True, {"sql_type": TIMESTAMP} if c.kind == TIMESTAMP else {}) for c in self.columns])
