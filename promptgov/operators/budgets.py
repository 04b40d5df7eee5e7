"""Budgets: what tenants spend in a month, and when they cross their alert and their limit.

Money is counted exactly, in billionths of a dollar. A price holds from its `valid_from` to the next
one of its model; usage takes the price in force at its time. Usage without a price costs nothing and
is counted as unpriced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgov.operators.clock import micros
from promptgov.operators.policy_rules import budget_error
from promptgov.operators.running import asof_join, running_totals

NANOS = 1_000_000_000
MONEY = "decimal(28,0)"


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add `cost_nanos`, null where no price is in force.

    usage: model, ts, tokens; prices: model, valid_from, nanos_per_token.
    """
    known = asof_join(usage, prices, by="model", at="ts", since="valid_from", take=["nanos_per_token"], label="prices")
    cost = F.coalesce("tokens", F.lit(0)).cast("decimal(10,0)") * F.col("nanos_per_token").cast("decimal(18,0)")
    return known.withColumn("cost_nanos", cost.cast(MONEY)).drop("nanos_per_token")


def running_spend(usage: DataFrame, prices: DataFrame, order: str = "request_id") -> DataFrame:
    """order, tenant, ts, month, cost_nanos, spend_nanos: what the tenant has spent in the month, with this row.

    Rows take effect in the order (ts, order); a null tenant is the empty one; rows without a time
    belong to no month and are left out.
    """
    timed = usage.filter(F.col("ts").isNotNull()).select(
        order, F.coalesce("tenant", F.lit("")).alias("tenant"), "ts", "model", "tokens")
    costs = priced(timed, prices)
    costs = costs.select(
        order, "tenant", "ts", F.to_date(F.date_trunc("month", "ts")).alias("month"), micros(costs, "ts").alias("__us"), "cost_nanos")
    spent = F.coalesce("cost_nanos", F.lit(0)).cast(MONEY)
    return running_totals(costs, ["tenant", "month"], ["__us", order], {"spend_nanos": spent}, "spend").drop("__us")


def valid_budgets(budgets: DataFrame) -> DataFrame:
    """tenant, limit_nanos, alert_nanos: the first valid entry of each tenant; no alert where none is set."""
    error = budget_error(F.col("tenant"), F.col("monthly_limit_usd"), F.col("alert_at_percent"))
    first = budgets.filter(error.isNull()).groupBy("tenant").agg(
        F.min_by(F.struct("monthly_limit_usd", "alert_at_percent"), "ordinal").alias("b"))
    limit = F.round(F.col("b.monthly_limit_usd") * NANOS).cast(MONEY)
    alert = F.coalesce("b.alert_at_percent", F.lit(0))
    return first.select(
        "tenant", limit.alias("limit_nanos"),
        F.when(alert > 0, F.ceil(limit * alert.cast("decimal(3,0)") / F.lit(100)).cast(MONEY)).alias("alert_nanos"))


def spend_by_request(usage: DataFrame, budgets: DataFrame, prices: DataFrame, order: str = "request_id") -> DataFrame:
    """Each request with its tenant's spending up to it and the status that it then has.

    Status: `exceeded` beyond the limit, `alert` from the alert's share of it on, else `ok`; `no_budget` for
    tenants without one. Spending of exactly the limit does not exceed it.
    """
    spent = running_spend(usage, prices, order).join(valid_budgets(budgets), "tenant", "left")
    spend, limit = F.col("spend_nanos"), F.col("limit_nanos")
    return spent.withColumn("status", (
        F.when(limit.isNull(), "no_budget").when(spend > limit, "exceeded")
        .when(spend >= F.col("alert_nanos"), "alert").otherwise("ok")))


def budget_status(usage: DataFrame, budgets: DataFrame, prices: DataFrame, order: str = "request_id") -> DataFrame:
    """One row per tenant and month: spending, limit, status at the end, and the requests that first crossed the
    alert and the limit (null while not crossed).

    A crossing is the row whose running total is beyond the threshold while the one before was not; costs are
    never negative, so there is at most one, and only the crossing rows and sums leave a task.
    """
    rows = spend_by_request(usage, budgets, prices, order)
    spend, before = F.col("spend_nanos"), F.col("spend_nanos") - F.coalesce("cost_nanos", F.lit(0)).cast(MONEY)
    # A free row that comes when the threshold is already reached crosses nothing.
    alert = (spend >= F.col("alert_nanos")) & (before < F.col("alert_nanos"))
    limit = (spend > F.col("limit_nanos")) & (before <= F.col("limit_nanos"))
    status = rows.groupBy("tenant", "month").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("cost_nanos").isNull()).alias("unpriced"),
        F.max("spend_nanos").alias("spend_nanos"), F.max("limit_nanos").alias("limit_nanos"),
        F.max("alert_nanos").alias("alert_nanos"),
        F.min(F.when(alert, F.col(order))).alias("alert_request"), F.min(F.when(alert, F.col("ts"))).alias("alert_ts"),
        F.min(F.when(limit, F.col(order))).alias("exceeded_request"), F.min(F.when(limit, F.col("ts"))).alias("exceeded_ts"))
    return status.withColumn("status", (
        F.when(F.col("limit_nanos").isNull(), "no_budget").when(spend > F.col("limit_nanos"), "exceeded")
        .when(spend >= F.col("alert_nanos"), "alert").otherwise("ok")))
