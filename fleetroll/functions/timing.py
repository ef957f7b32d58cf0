"""Event time as exact integer microseconds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp column (with or without time zone)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def slot_start(us: Column, width: int) -> Column:
    """Start of the fixed-width time slot that holds ``us``; exact for times before the epoch too."""
    return us - F.pmod(us, F.lit(width))


def as_of_micros(events: DataFrame, as_of: datetime | Column | None, ts: str = "ts") -> Column:
    """The observation time; by default the latest event, as a scalar subquery rather than a driver round trip."""
    if as_of is None:
        return events.select(F.max(micros(ts))).scalar()
    return micros(as_of if isinstance(as_of, Column) else F.lit(as_of))
