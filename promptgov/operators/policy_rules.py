"""Checks of policy tables: one column per row type, one message per policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGETS = "ordinal int, tenant string, monthly_limit_usd double, alert_at_percent int"
RATE_LIMITS = "ordinal int, tenant string, tokens_per_minute int, requests_per_minute int"
ROUTING_RULES = "ordinal int, condition string, model string"
SECURITY = (
    "prompt_injection_protection boolean, pii_redaction boolean, blocked_patterns array<string>, "
    "max_prompt_tokens int, guardrails_endpoint string, guardrails_fail_closed boolean"
)

# The messages of failing rules.
MSG_NO_TENANT = "tenant name is required in budget"
MSG_LIMIT = "monthly_limit_usd must be positive for tenant "
MSG_ALERT = "alert_at_percent must be 0-100 for tenant "
MSG_RATE = "tokens_per_minute must be positive"
MSG_MAX_TOKENS = "max_prompt_tokens must be non-negative"


def _quoted(s: Column) -> Column:
    """In double quotes, with backslashes, quotes and line breaks escaped."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), s, F.lit('"'))


def budget_error(tenant: Column, monthly_limit_usd: Column, alert_at_percent: Column) -> Column:
    """The first failing message of a budget row, NULL when it is valid."""
    return (
        F.when(F.coalesce(tenant, F.lit("")) == "", MSG_NO_TENANT)
        .when(F.coalesce(monthly_limit_usd, F.lit(0.0)) <= 0, F.concat(F.lit(MSG_LIMIT), _quoted(tenant)))
        .when(~F.coalesce(alert_at_percent, F.lit(0)).between(0, 100),
              F.concat(F.lit(MSG_ALERT), _quoted(tenant)))
    )


def rate_limit_error(tokens_per_minute: Column) -> Column:
    return F.when(F.coalesce(tokens_per_minute, F.lit(0)) <= 0, MSG_RATE)


def max_tokens_error(max_prompt_tokens: Column) -> Column:
    return F.when(F.coalesce(max_prompt_tokens, F.lit(0)) < 0, MSG_MAX_TOKENS)


def validate_policies(budgets: DataFrame, rate_limits: DataFrame, security: DataFrame) -> DataFrame:
    """One row per policy of `security`: its first error in the order budgets, rate
    limits, security, or NULL. All three tables carry a `policy_id`.

    `min_by` combines on the map side, so a policy with very many rows is no hot spot.
    """

    def errors(df: DataFrame, part: int, ordinal: Column, message: Column) -> DataFrame:
        at = F.struct(F.lit(part).alias("part"), ordinal.cast("long").alias("ordinal"))
        return df.select("policy_id", at.alias("at"), message.alias("message"))

    found = (
        errors(budgets, 0, F.col("ordinal"),
               budget_error(F.col("tenant"), F.col("monthly_limit_usd"), F.col("alert_at_percent")))
        .unionByName(errors(rate_limits, 1, F.col("ordinal"),
                            rate_limit_error(F.col("tokens_per_minute"))))
        .unionByName(errors(security, 2, F.lit(0), max_tokens_error(F.col("max_prompt_tokens"))))
        .filter("message IS NOT NULL")
        .groupBy("policy_id")
        .agg(F.min_by("message", "at").alias("message"))
    )
    return (
        security.select("policy_id").distinct().join(found, "policy_id", "left")
        .select("policy_id", F.col("message").isNull().alias("valid"), "message")
    )
