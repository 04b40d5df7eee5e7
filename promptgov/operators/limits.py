"""Limits of a tenant's own: requests per minute, and a token bucket at its own rate.

A tenant's limits are its first entry's. A tenant without an entry falls under the first entry
without a tenant or, where there is none, under the first entry of all, which is everybody's by the
common bucket, too. A missing or zero number of requests means no limit of requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgov.operators.clock import micros
from promptgov.operators.ratelimit import token_bucket
from promptgov.operators.running import running_totals

MINUTE = 60_000_000
LIMITS = ["tokens_per_minute", "requests_per_minute"]


def with_limits(rows: DataFrame, rate_limits: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Add the tenant's `tokens_per_minute` and `requests_per_minute`; null is the empty tenant."""
    entry = F.struct(*LIMITS)
    name = F.coalesce("tenant", F.lit(""))
    own = rate_limits.groupBy(name.alias("__name")).agg(F.min_by(entry, "ordinal").alias("__own"))
    default = rate_limits.orderBy(name != "", "ordinal").select(*LIMITS).first()
    joined = rows.join(own, F.coalesce(tenant, F.lit("")) == F.col("__name"), "left")
    value = lambda c: F.when(F.col("__own").isNull(), F.lit(default[c] if default else None)).otherwise(
        F.col("__own")[c]).cast("int")
    return joined.select(*rows.columns, *[value(c).alias(c) for c in LIMITS])


def _over(count, limit):
    return F.coalesce((limit > 0) & (count > limit), F.lit(False))


def requests_per_minute(
    requests: DataFrame, rate_limits: DataFrame, *, tenant: str = "tenant", ts: str = "ts", order: str = "request_id",
) -> DataFrame:
    """order, tenant, minute, requests_per_minute, number, rpm_exceeded: the place of each request among
    those of its tenant in its whole minute, by (ts, order), and whether that is beyond the limit.

    A request beyond the limit counts like any other. One without a time has no minute, no number, and
    exceeds nothing.
    """
    us = micros(requests, ts)
    slim = requests.select(
        order, F.coalesce(tenant, F.lit("")).alias(tenant), F.coalesce(F.floor(us / MINUTE), F.lit(-1)).alias("__minute"),
        us.alias("__us"))
    counted = running_totals(slim, [tenant, "__minute"], ["__us", order], {"number": F.lit(1)}, "requests")
    timed = F.col("__us").isNotNull()
    limited = with_limits(counted.withColumn("number", F.when(timed, F.col("number"))), rate_limits, tenant)
    return limited.select(
        order, tenant, F.when(timed, F.timestamp_micros(F.col("__minute") * MINUTE)).alias("minute"),
        "requests_per_minute", "number", _over(F.col("number"), F.col("requests_per_minute")).alias("rpm_exceeded"))


def request_windows(requests: DataFrame, tenant: str = "tenant", ts: str = "ts") -> DataFrame:
    """tenant, minute, requests: counts in tumbling windows of a minute, on a table or a stream."""
    timed = requests.filter(F.col(ts).isNotNull()).select(
        F.coalesce(tenant, F.lit("")).alias("tenant"), F.window(ts, "1 minute").alias("w"))
    return timed.groupBy("tenant", "w").agg(F.count(F.lit(1)).alias("requests")).select(
        "tenant", F.col("w.start").alias("minute"), "requests")


def exceeded_windows(windows: DataFrame, rate_limits: DataFrame) -> DataFrame:
    """The minutes in which a tenant made more requests than it may, and how many more."""
    limited = with_limits(windows, rate_limits).filter(_over(F.col("requests"), F.col("requests_per_minute")))
    return limited.select(
        "tenant", "minute", "requests", "requests_per_minute", (F.col("requests") - F.col("requests_per_minute")).alias("over"))


def own_token_bucket(
    asks: DataFrame, rate_limits: DataFrame, *, burst_minutes: int = 2, tenant: str = "tenant", **columns,
) -> DataFrame:
    """The token bucket with each tenant's own rate, and `burst_minutes` times that as capacity.

    Adds `allowed` and `remaining`. Where there are no limits at all, everything is allowed.
    """
    limited = with_limits(asks, rate_limits, tenant)
    rate = F.col("tokens_per_minute").cast("long")
    decided = token_bucket(limited, rate, rate * burst_minutes, tenant=tenant, **columns)
    return decided.select(*asks.columns, "allowed", "remaining")
