"""Predicates as Catalyst expressions, with the dialect's strict typing of literals.

A comparison keeps the column bare on one side, so Parquet readers can push it down and skip row groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from logstrata.errors import EngineError
from logstrata.functions.arithmetic import literal
from logstrata.plans import ir
from logstrata.types import BOOL, cast_for


def _kind(kinds: dict[str, str | None], name: str) -> str:
    kind = kinds.get(name)
    if kind is None:
        raise EngineError(f"column {name} has a type that filters do not support" if name in kinds else f"unknown column {name}")
    return kind


def _constant(value: Any, instant: DataType | None) -> Column:
    """A literal, as a timestamp for a column that is stored as one (microseconds; folded by the optimizer)."""
    return F.timestamp_micros(literal(value)).cast(instant) if instant else literal(value)


def compile_filter(where: Any, kinds: dict[str, str | None], column: Callable[[str], Column], instants: dict[str, tuple[Column, DataType]] | None = None) -> Column:
    """``instants``: for whole-number times made from stored timestamps, the timestamps and their type, which readers can filter by."""
    if isinstance(where, ir.And):
        return reduce(lambda a, b: a & b, [compile_filter(p, kinds, column, instants) for p in where.parts])
    if isinstance(where, ir.Or):
        return reduce(lambda a, b: a | b, [compile_filter(p, kinds, column, instants) for p in where.parts])
    instant, made = (instants or {}).get(getattr(where, "column", ""), (None, None))
    if made:
        column = lambda _: instant
    if isinstance(where, ir.IsNull):
        if where.column not in kinds:
            raise EngineError(f"unknown column {where.column}")
        return column(where.column).isNotNull() if where.negated else column(where.column).isNull()
    kind = _kind(kinds, where.column)
    if isinstance(where, ir.InList):
        values = [_constant(cast_for(kind, v.value), made) for v in where.values]
        chosen = column(where.column).isin(values)
        return ~chosen if where.negated else chosen
    value, op = cast_for(kind, where.value.value), where.op
    if value is None or (kind == BOOL and op not in ("=", "<>")):
        return F.lit(False)  # no row compares with NULL, and truth values have no order
    left, right = column(where.column), _constant(value, made)
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def columns_of(where: Any) -> list[str]:
    if where is None:
        return []
    if isinstance(where, (ir.And, ir.Or)):
        return [c for p in where.parts for c in columns_of(p)]
    return [where.column]
