"""Prompt length profile per tenant, and prompts that break with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptgov.operators.clock import micros
from promptgov.plans.lineage import in_chunks

# Thresholds and reasons.
Z_LIMIT = 3.0
SPIKE_FACTOR = 10
SPIKE_BYTES = 500
MSG_LONGER = "Prompt significantly longer than tenant's typical pattern"
MSG_SHORTER = "Prompt significantly shorter than tenant's typical pattern"
MSG_SPIKE = "Prompt length spike: 10x above mean"


def _spread(count: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation from exact integer sums."""
    mean = total.cast("double") / count.cast("double")
    variance = squares.cast("double") / count.cast("double") - mean * mean
    return mean, F.sqrt(F.abs(variance))


def _square(length: Column) -> Column:
    """A decimal: squares of long prompts soon add up to more than a BIGINT holds."""
    return (length * length).cast("decimal(19,0)")


def anomaly_columns(length: Column, count: Column, total: Column, squares: Column,
                    min_samples: int) -> list[Column]:
    """The verdict on a prompt, given the sums over its tenant's prompts up to it."""
    mean, deviation = _spread(count, total, squares)
    deviation = F.greatest(deviation, F.lit(1.0))
    score = F.abs(length.cast("double") - mean) / deviation
    known = count >= min_samples
    outlier = known & (score > Z_LIMIT)
    spike = (count > min_samples) & (length > mean * SPIKE_FACTOR) & (length > SPIKE_BYTES)
    reason = (
        F.when(spike, MSG_SPIKE)
        .when(outlier & (length > mean), MSG_LONGER)
        .when(outlier, MSG_SHORTER)
        .otherwise("")
    )
    zero = F.lit(0.0)
    return [
        (outlier | spike).alias("is_anomaly"),
        F.when(known, F.round(score * 100) / 100).otherwise(zero).alias("score"),
        reason.alias("reason"),
        length.cast("int").alias("prompt_length"),
        F.when(known, F.round(mean)).otherwise(zero).alias("mean_length"),
        F.when(known, F.round(deviation * 10) / 10).otherwise(zero).alias("std_dev"),
    ]


def prompt_anomaly(
    prompts: DataFrame, min_samples: int, *, tenant: str = "tenant", ts: str = "ts",
    order: str = "request_id", prompt: str = "prompt",
    before: DataFrame | None = None, with_totals: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """One row per prompt with its verdict, over the tenant's prompts up to and with it.

    The running sums are built in two levels: the prompts in order of tenant and time are
    cut into chunks of about equal size; the sums run within each chunk of a tenant, plus
    the totals of the tenant's chunks before. So no task sees a whole large tenant, and
    only the lengths are shuffled.

    `before` holds the sums of earlier prompts per tenant: tenant, n, total, squares. With `with_totals`
    those of the prompts given are returned as well, so that a history may be judged in parts.
    """
    length = F.coalesce(F.octet_length(prompt), F.lit(0)).cast("long")
    sized = prompts.select(
        order, F.coalesce(tenant, F.lit("")).alias(tenant), micros(prompts, ts).alias("__us"),
        length.alias("__length"),
    )
    sized = in_chunks(sized, [tenant, "__us", order], "lengths")

    so_far = (
        Window.partitionBy(tenant, "__chunk").orderBy("__us", order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = {
        "__n": F.count(F.lit(1)),
        "__sum": F.sum("__length"),
        "__squares": F.sum(_square(F.col("__length"))),
    }
    local = sized.select("*", *[total.over(so_far).alias(c) for c, total in sums.items()])
    # A row per tenant and chunk; most tenants have one chunk.
    totals = sized.groupBy(tenant, "__chunk").agg(*[total.alias(c) for c, total in sums.items()])
    chunks_before = (
        Window.partitionBy(tenant).orderBy("__chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        tenant, "__chunk",
        *[F.coalesce(F.sum(c).over(chunks_before), F.lit(0)).alias(f"{c}_before") for c in sums],
    )
    if before is not None:
        earlier = before.select(
            F.col("tenant").alias(tenant), F.col("n").alias("__n0"), F.col("total").alias("__sum0"), F.col("squares").alias("__squares0"))
        carried = carried.join(earlier, tenant, "left").select(
            tenant, "__chunk", *[(F.col(f"{c}_before") + F.coalesce(f"{c}0", F.lit(0))).alias(f"{c}_before") for c in sums])
    joined = local.join(carried, [tenant, "__chunk"])
    n, total, squares = (F.col(c) + F.col(f"{c}_before") for c in ("__n", "__sum", "__squares"))
    found = joined.select(
        order, tenant, n.alias("__n"), total.alias("__sum"), squares.alias("__squares"), "__length"
    ).select(order, tenant, *anomaly_columns(
        F.col("__length"), F.col("__n"), F.col("__sum"), F.col("__squares"), min_samples))
    if not with_totals:
        return found
    return found, totals.groupBy(F.col(tenant).alias("tenant")).agg(
        F.sum("__n").alias("n"), F.sum("__sum").alias("total"), F.sum("__squares").cast("decimal(38,0)").alias("squares"))


def tenant_profile(prompts: DataFrame, *, tenant: str = "tenant", prompt: str = "prompt") -> DataFrame:
    """Count, mean and deviation of the prompt lengths per tenant; a null tenant is the empty one."""
    length = F.coalesce(F.octet_length(prompt), F.lit(0)).cast("long")
    sums = prompts.groupBy(F.coalesce(tenant, F.lit("")).alias(tenant)).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(length).alias("__sum"),
        F.sum(_square(length)).alias("__squares"),
    )
    mean, deviation = _spread(F.col("count"), F.col("__sum"), F.col("__squares"))
    return sums.select(
        tenant, "count", F.round(mean).alias("mean_length"),
        (F.round(deviation * 10) / 10).alias("std_dev"))


def profiles_of(tenants: DataFrame, profile: DataFrame, *, tenant: str = "tenant") -> DataFrame:
    """The profile of each tenant asked for; zeros for the unknown."""
    return tenants.select(tenant).distinct().join(profile, tenant, "left").fillna(
        {"count": 0, "mean_length": 0.0, "std_dev": 0.0})
