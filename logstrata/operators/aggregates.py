"""COUNT, SUM, AVG, MIN and MAX. Spark adds up within tasks before the one exchange, and spills beyond memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logstrata.errors import EngineError
from logstrata.plans import ir
from logstrata.types import BOOL, TEXT


def compile_aggregate(aggregate: ir.Aggregate, kinds: dict[str, str | None], column: Callable[[str], Column], strict: bool = False) -> Column:
    """``strict``: MIN, MAX and AVG over no values raise, where they otherwise are NULL. SUM is a double, 0.0 over no values."""
    name, of = aggregate.function, aggregate.column
    if of is None:
        return F.count(F.lit(1))
    if of not in kinds:
        raise EngineError(f"unknown column {of}")
    if name in ("SUM", "AVG") and kinds[of] in (BOOL, TEXT, None):
        raise EngineError(f"{name} expects a numeric column")
    value = column(of)
    if name == "COUNT":
        return F.count(value)
    if name == "SUM":
        return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))
    found = {"AVG": F.avg(value.cast("double")) if name == "AVG" else None, "MIN": F.min(value), "MAX": F.max(value)}[name]
    return F.coalesce(found, F.raise_error(F.lit("AVG had no rows" if name == "AVG" else "aggregate had no values"))) if strict else found
