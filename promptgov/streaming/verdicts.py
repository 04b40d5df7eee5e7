"""Verdicts of rails in time: a verdict counts if it comes within a time limit of its request.

A request whose time limit has passed without a verdict counts as an outage, whatever comes later. Of
several verdicts in time the earliest counts; of several at one instant a refusal wins, then the
one whose violations sort last. The same rule on a table and on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgov.operators.verdicts import verdict_violations

#: How long the gate waits for the rails.
TIME_LIMIT = "2 seconds"


def _matched(requests: DataFrame, verdicts: DataFrame, limit: str) -> DataFrame:
    """Each request with each of its verdicts in time, or with none."""
    side = verdicts.select(
        F.col("request_id").alias("__id"), F.col("ts").alias("__ts"), F.coalesce("allowed", F.lit(False)).alias("__allowed"),
        verdict_violations(F.coalesce("allowed", F.lit(False)), F.col("reasons")).alias("__violations"))
    in_time = ((F.col("request_id") == F.col("__id")) & (F.col("__ts") >= F.col("ts"))
               & (F.col("__ts") <= F.col("ts") + F.expr(f"INTERVAL {limit}")))
    return requests.join(side, in_time, "left")


def _settled(matched: DataFrame, keys: list, names: list[str]) -> DataFrame:
    """One row per request: `reached`, `rail_allowed`, `rail_violations`, by the verdict that counts."""
    instant = F.struct(
        (-F.unix_micros("__ts")).alias("first"), (~F.col("__allowed")).alias("refused"), F.col("__violations").alias("violations"))
    verdict = F.max(F.when(F.col("__ts").isNotNull(), instant)).alias("__verdict")
    one = matched.groupBy(*keys).agg(verdict, F.first(F.struct(*names)).alias("__request"))
    found = F.col("__verdict")
    return one.select(
        "__request.*", found.isNotNull().alias("reached"), (~found["refused"]).alias("rail_allowed"),
        found["violations"].alias("rail_violations"))


def verdicts_in_time(requests: DataFrame, verdicts: DataFrame, limit: str = TIME_LIMIT) -> DataFrame:
    """Add `reached`, `rail_allowed` and `rail_violations` to a table of requests with different request_ids.

    requests: request_id, ts and more; verdicts: request_id, ts, allowed, reasons.
    """
    return _settled(_matched(requests, verdicts, limit), ["request_id"], requests.columns)


def stream_verdicts_in_time(
    requests: DataFrame, verdicts: DataFrame, limit: str = TIME_LIMIT, late: str = "10 seconds",
) -> DataFrame:
    """The same on two streams, in append mode.

    Both sides carry a watermark of `late`: rows that come later than that do not count, and a
    request is settled once the watermarks have passed its time limit. Requests without an id or a time are
    left out. A source that falls quiet holds its watermark back; it should send a heartbeat now and then, a row
    with an id that no request has.
    """
    asked = requests.withWatermark("ts", late)
    given = verdicts.withWatermark("ts", late)
    matched = _matched(asked, given, limit).filter(F.col("request_id").isNotNull() & F.col("ts").isNotNull())
    return _settled(matched, ["request_id", F.window("ts", "1 second")], requests.columns)
