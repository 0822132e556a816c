"""A Select plan over a DataFrame: filter, aggregate, project, order and limit, all left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.errors import EngineError
from logstrata.functions.arithmetic import columns_of, compile_scalar, evaluate
from logstrata.operators.aggregates import compile_aggregate
from logstrata.operators.filters import columns_of as filter_columns
from logstrata.operators.filters import compile_filter
from logstrata.plans import ir
from logstrata.types import kind_of, value_kind

#: Hidden columns begin so. SEQUENCE is the order of ingestion; INSTANT and a name, the timestamp that a whole-number time is made of.
HIDDEN = "__"
SEQUENCE = HIDDEN + "sequence"
INSTANT = HIDDEN + "instant_"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column(name: str) -> Column:
    return F.col(quoted(name))


def _check(plan: ir.Select, kinds: dict[str, str | None]) -> None:
    """What must hold before any row is read."""
    stars = [p for p in plan.projections if isinstance(p.expr, ir.Star)]
    if stars and len(plan.projections) > 1:
        raise EngineError(f"unknown column * in table {plan.table}")
    if stars and plan.group_by:
        raise EngineError("SELECT * does not support GROUP BY")
    named = [*filter_columns(plan.where), *plan.group_by]
    named += [c for p in plan.projections for c in columns_of(p.expr)]
    for name in named:
        if name not in kinds:
            raise EngineError(f"unknown column {name} in table {plan.table}")
    grouped = bool(plan.group_by) or any(isinstance(p.expr, ir.Aggregate) for p in plan.projections)
    for p in plan.projections if grouped else ():
        if isinstance(p.expr, ir.ColumnRef) and p.expr.name not in plan.group_by:
            raise EngineError(f"non-aggregated projection {p.expr.name} must appear in GROUP BY")
        if isinstance(p.expr, (ir.Binary, ir.Negate, ir.Literal)):
            raise EngineError("scalar expressions in aggregate queries are not yet supported")


def _ordered(df: DataFrame, plan: ir.Select, aliases: list[str], given: Callable[[int], Column]) -> DataFrame:
    terms = []
    for term in plan.order_by:
        if term.field not in aliases:
            raise EngineError(f"ORDER BY field {term.field} not found in result set")
        column = given(aliases.index(term.field))
        terms.append(column.desc_nulls_last() if term.descending else column.asc_nulls_last())
    return df.orderBy(*terms) if terms else df


def select(plan: ir.Select, df: DataFrame, preserve_order: bool = False, strict: bool = False) -> DataFrame:
    """The plan's result, lazily. ``preserve_order``: rows without ORDER BY come in the order of ingestion."""
    kinds = {f.name: kind_of(f) for f in df.schema if not f.name.startswith(HIDDEN)}
    _check(plan, kinds)
    if plan.where is not None:
        instants = {f.name.removeprefix(INSTANT): (_column(f.name), f.dataType) for f in df.schema if f.name.startswith(INSTANT)}
        df = df.filter(compile_filter(plan.where, kinds, _column, instants))
    projections = plan.projections
    if isinstance(projections[0].expr, ir.Star):
        projections = tuple(ir.Projection(ir.ColumnRef(c), c) for c in kinds)
    aliases = [p.alias for p in projections]
    # Results may have columns of one name, so columns go by number until the end.
    inner = [f"c{i}" for i in range(len(projections))]
    if plan.group_by or any(isinstance(p.expr, ir.Aggregate) for p in projections):
        keys = list(dict.fromkeys(plan.group_by))
        aggregates = [compile_aggregate(p.expr, kinds, _column, strict).alias(n) for p, n in zip(projections, inner, strict=True) if isinstance(p.expr, ir.Aggregate)]
        grouped = df.groupBy(*[_column(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else df
        if aggregates:
            out = grouped.agg(*aggregates)
        else:
            out = df.select(*[_column(k).alias(f"k{i}") for i, k in enumerate(keys)]).distinct()
        out = out.select(*[F.col(n) if isinstance(p.expr, ir.Aggregate) else F.col(f"k{keys.index(p.expr.name)}").alias(n) for p, n in zip(projections, inner, strict=True)])
    else:
        ordered = preserve_order and SEQUENCE in df.columns and not plan.order_by
        columns = [compile_scalar(p.expr, kinds, _column)[0].alias(n) for p, n in zip(projections, inner, strict=True)]
        out = df.select(*columns, *([F.col(SEQUENCE)] if ordered else []))
        if ordered:
            out = out.orderBy(SEQUENCE)
            if plan.limit is not None:
                out = out.limit(plan.limit)
            return out.drop(SEQUENCE).toDF(*aliases)
    out = _ordered(out, plan, aliases, lambda i: F.col(inner[i]))
    if plan.limit is not None:
        out = out.limit(plan.limit)
    return out.toDF(*aliases)


def evaluate_row(spark: SparkSession, plan: ir.Eval) -> DataFrame:
    """A SELECT without a table: one row, whose errors are raised."""
    values = [evaluate(p.expr) for p in plan.projections]
    types = {None: T.StringType(), "INT": T.LongType(), "REAL": T.DoubleType(), "BOOL": T.BooleanType(), "TEXT": T.StringType()}
    schema = T.StructType([T.StructField(f"c{i}", types[value_kind(v)]) for i, v in enumerate(values)])
    return spark.createDataFrame([tuple(values)], schema).toDF(*[p.alias for p in plan.projections])
