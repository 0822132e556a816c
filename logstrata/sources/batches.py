"""Columnar batches: typed columns of one length, kept as an Arrow table."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pyarrow as pa

from logstrata.errors import EngineError
from logstrata.types import BOOL, INT, REAL, TEXT, TIMESTAMP, Schema

_ARROW = {INT: pa.int64(), TIMESTAMP: pa.int64(), REAL: pa.float64(), BOOL: pa.bool_(), TEXT: pa.string()}


def arrow_type(kind: str) -> pa.DataType:
    return _ARROW[kind]


class ColumnarBatch:
    """Columns in order; ``kinds`` may hold TIMESTAMP, which Arrow's 64-bit integers do not tell."""

    def __init__(self, columns: list[pa.Array], kinds: list[str]):
        if len({len(c) for c in columns}) > 1:
            raise EngineError("column length mismatch in columnar batch")
        self.columns, self.kinds = columns, kinds

    @classmethod
    def of(cls, data: Any) -> ColumnarBatch:
        """From a batch, an Arrow table or record batch, a pandas DataFrame, or a dict of columns."""
        if isinstance(data, ColumnarBatch):
            return data
        if isinstance(data, dict):
            data = pa.table(data)
        elif not isinstance(data, (pa.Table, pa.RecordBatch)):
            data = pa.Table.from_pandas(data, preserve_index=False)
        columns, kinds = [], []
        for column in data.columns:
            kind = INT if pa.types.is_integer(column.type) else REAL if pa.types.is_floating(column.type) else BOOL if pa.types.is_boolean(column.type) else TEXT if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else None
            if kind is None:
                raise EngineError(f"unsupported type: {column.type}")
            columns.append(column.cast(_ARROW[kind]))
            kinds.append(kind)
        return cls(columns, kinds)

    def __len__(self) -> int:
        return len(self.columns[0]) if self.columns else 0

    def checked(self, schema: Schema) -> list[pa.Array]:
        """The columns, if they are those of the schema. A whole number serves as a time, nothing else converts."""
        if len(self.columns) != len(schema.columns):
            raise EngineError(f"column count mismatch: expected {len(schema.columns)}, got {len(self.columns)}")
        for column, kind in zip(schema.columns, self.kinds, strict=True):
            if kind != column.kind and {kind, column.kind} != {INT, TIMESTAMP}:
                raise EngineError(f"column type mismatch for {column.name}: expected {column.kind}, got {kind}")
        return self.columns


class BatchBuilder:
    """Column by column: ``BatchBuilder().timestamps(ts).strings(level).build()``."""

    def __init__(self) -> None:
        self._columns: list[pa.Array] = []
        self._kinds: list[str] = []

    def _add(self, values: Iterable, kind: str) -> BatchBuilder:
        self._columns.append(values.cast(_ARROW[kind]) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, _ARROW[kind]))
        self._kinds.append(kind)
        return self

    def int64(self, values: Iterable) -> BatchBuilder:
        return self._add(values, INT)

    def float64(self, values: Iterable) -> BatchBuilder:
        return self._add(values, REAL)

    def bools(self, values: Iterable) -> BatchBuilder:
        return self._add(values, BOOL)

    def strings(self, values: Iterable) -> BatchBuilder:
        return self._add(values, TEXT)

    def timestamps(self, values: Iterable) -> BatchBuilder:
        return self._add(values, TIMESTAMP)

    def build(self) -> ColumnarBatch:
        return ColumnarBatch(self._columns, self._kinds)
