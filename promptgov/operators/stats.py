"""Counts over audit events. All are hash aggregations that combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.functions.text import tenant_label
from promptgov.operators.gate import MSG_PII, MSG_RATE

# Rules counted for events without violations.
RULE_PII = "pii_redaction"
RULE_RATE = "rate_limited"
RULE_OTHER = "unknown"


def audit_classify(events: DataFrame) -> DataFrame:
    """Add `class` (allowed, blocked or rate_limited) and the `rule` to count."""
    listed = F.coalesce(F.size("violations"), F.lit(0)) > 0
    blocked = F.col("action") == "blocked"
    limited = blocked & ~listed & (F.col("reason") == MSG_RATE)
    rule = (
        F.when(~blocked, F.lit(None).cast("string"))
        .when(listed, F.get("violations", F.lit(0))["Rule"])
        .when(F.col("reason") == MSG_PII, RULE_PII)
        .when(limited, RULE_RATE)
        .otherwise(RULE_OTHER)
    )
    kind = F.when(limited, "rate_limited").when(blocked, "blocked").otherwise("allowed")
    return events.withColumns({"class": kind, "rule": rule})


def counters() -> list[Column]:
    return [F.count_if(F.col("class") == c).alias(c) for c in ("allowed", "blocked", "rate_limited")]


def stats_totals(classified: DataFrame) -> DataFrame:
    """One row; the block rate leaves rate-limited requests out of its numerator."""
    totals = classified.agg(F.count(F.lit(1)).alias("total"), *counters())
    rate = F.when(F.col("total") > 0, F.col("blocked").cast("double") / F.col("total") * 100)
    return totals.select("*", F.coalesce(rate, F.lit(0.0)).alias("block_rate_percent"))


def stats_by_tenant(classified: DataFrame) -> DataFrame:
    return classified.groupBy(tenant_label(F.col("tenant")).alias("tenant")).agg(*counters())


def violation_counts(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("class") != "allowed").groupBy("rule").agg(
        F.count(F.lit(1)).alias("count"))



# -- the same reports from counts that can be added up --------------------------


def class_counts(classified: DataFrame) -> DataFrame:
    """tenant, class, rule, n: all that the reports need, with a row per combination that occurs."""
    return classified.groupBy(tenant_label(F.col("tenant")).alias("tenant"), "class", "rule").agg(
        F.count(F.lit(1)).alias("n"))


def _summed() -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(c)
            for c in ("allowed", "blocked", "rate_limited")]


def totals_of(counts: DataFrame) -> DataFrame:
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *_summed())
    rate = F.when(F.col("total") > 0, F.col("blocked").cast("double") / F.col("total") * 100)
    return totals.select("*", F.coalesce(rate, F.lit(0.0)).alias("block_rate_percent"))


def by_tenant_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tenant").agg(*_summed())


def by_rule_of(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("class") != "allowed").groupBy("rule").agg(F.sum("n").alias("count"))
