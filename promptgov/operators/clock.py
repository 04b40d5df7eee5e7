"""Event time as whole microseconds, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(ts))
    return F.unix_micros(F.col(ts))

