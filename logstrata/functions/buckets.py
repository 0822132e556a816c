"""Time buckets: the dialect has no date functions, so tables carry the beginnings of the periods that they are grouped by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds.
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def bucket(ts: Column, width: int) -> Column:
    """The beginning of the period of ``width`` units that a whole-number time lies in, also before the epoch."""
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def with_time_buckets(df: DataFrame, ts: str = "ts", **widths: int) -> DataFrame:
    """Adds a column for each name=width, minute_bucket and day_bucket (of milliseconds) if none is given."""
    widths = widths or {"minute_bucket": MINUTE, "day_bucket": DAY}
    return df.withColumns({name: bucket(F.col(ts), width) for name, width in widths.items()})
