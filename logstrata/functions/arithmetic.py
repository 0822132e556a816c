"""Arithmetic with the dialect's types, as Catalyst expressions.

Whole numbers: + - * / % in 64 bits, / truncates. Doubles: IEEE, so a division by zero is an infinity or NaN. Mixed operands become
doubles. In a row, whatever has no value (overflow, whole division by zero, operands that are not numbers) is NULL; ``evaluate``,
for statements without a table, raises instead.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from logstrata.errors import EngineError
from logstrata.plans import ir
from logstrata.types import INT, REAL, TIMESTAMP, WHOLE, value_kind

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def literal(value: Any) -> Column:
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long")
    return F.lit(value)


def _whole(op: str, a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    if op == "+":
        return F.try_add(a, b)
    if op == "-":
        return F.try_subtract(a, b)
    if op == "*":
        return F.try_multiply(a, b)
    zero = F.lit(0).cast("long")
    if op == "/":
        # Of divisions only the least number by -1 overflows, which the subtraction finds out.
        return F.when(b == 0, None).when(b == -1, F.try_subtract(zero, a)).otherwise(F.call_function("div", a, b))
    return F.when(b == 0, None).when(b == -1, F.when(a == F.lit(_LEAST), None).otherwise(zero)).otherwise(a % b)


def _real(op: str, a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(math.nan))).otherwise(a % b)


def compile_scalar(expr: Any, kinds: dict[str, str | None], column: Any) -> tuple[Column, str | None]:
    """A row expression and its kind (None: NULL for every row). ``column`` gives the Column of a name."""
    if isinstance(expr, ir.Literal):
        return literal(expr.value), value_kind(expr.value)
    if isinstance(expr, ir.ColumnRef):
        return column(expr.name), kinds[expr.name]
    if isinstance(expr, ir.Negate):
        inner, kind = compile_scalar(expr.operand, kinds, column)
        if kind in WHOLE:
            return F.try_subtract(F.lit(0).cast("long"), inner.cast("long")), INT
        if kind == REAL:
            return -inner, REAL
        return F.lit(None).cast("long"), None
    if isinstance(expr, ir.Binary):
        left, a = compile_scalar(expr.left, kinds, column)
        right, b = compile_scalar(expr.right, kinds, column)
        if a in WHOLE and b in WHOLE:
            return _whole(expr.op, left, right), INT
        if {a, b} <= {INT, TIMESTAMP, REAL} and a and b:
            return _real(expr.op, left, right), REAL
        return F.lit(None).cast("long"), None
    raise EngineError(f"unsupported expression: {getattr(expr, 'text', expr)}")


def columns_of(expr: Any) -> list[str]:
    if isinstance(expr, ir.ColumnRef):
        return [expr.name]
    if isinstance(expr, ir.Binary):
        return columns_of(expr.left) + columns_of(expr.right)
    return columns_of(expr.operand) if isinstance(expr, ir.Negate) else []


def _in_range(value: int) -> int:
    if not _LEAST <= value <= _MOST:
        raise EngineError("integer overflow")
    return value


def evaluate(expr: Any) -> Any:
    """The value of an expression without columns."""
    if isinstance(expr, ir.Literal):
        return expr.value
    if isinstance(expr, ir.ColumnRef):
        raise EngineError(f"column reference '{expr.name}' not valid without a table")
    if isinstance(expr, ir.Negate):
        value = evaluate(expr.operand)
        if value_kind(value) not in (INT, REAL):
            raise EngineError(f"cannot negate {value!r}")
        return -value if isinstance(value, float) else _in_range(-value)
    if not isinstance(expr, ir.Binary):
        raise EngineError(f"unsupported expression in SELECT: {getattr(expr, 'text', expr)}")
    a, b = evaluate(expr.left), evaluate(expr.right)
    kinds = {value_kind(a), value_kind(b)}
    if not kinds <= {INT, REAL}:
        raise EngineError(f"unsupported arithmetic between {a!r} and {b!r}")
    if kinds == {INT}:
        if expr.op in "/%":
            if b == 0:
                raise EngineError("division by zero")
            quotient = _in_range(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
            return quotient if expr.op == "/" else a - b * quotient
        return _in_range({"+": a + b, "-": a - b, "*": a * b}[expr.op])
    a, b = float(a), float(b)
    if expr.op == "%":
        return math.nan if b == 0 or math.isinf(a) or a != a or b != b else math.fmod(a, b)
    if expr.op == "/":
        if b == 0:
            return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1.0, b)
        return a / b
    return {"+": a + b, "-": a - b, "*": a * b}[expr.op]
