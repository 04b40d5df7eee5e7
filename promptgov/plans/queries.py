"""The registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgov.functions import checks, output, pii, text
from promptgov.functions.denylist import table_violations
from promptgov.operators import anomaly, budgets, limits, policy_rules, ratelimit, routing, stats, verdicts
from promptgov.operators.clock import micros
from promptgov.operators.gate import Gate, audit_events, block_response
from promptgov.operators.replay import replay
from promptgov.plans import workloads as W
from promptgov.plans.lineage import task_count, work_dir
from promptgov.sources.audit import fan_out, parquet_sink, with_json
from promptgov.sources.policy import Policy, load_policy, load_versions
from promptgov.sources.requests import parse_requests
from promptgov.streaming.batches import (
    anomaly_batches, bucket_balances, bucket_batches, bucket_table, gate_batches, profile_table,
)
from promptgov.streaming.stats import add_counts, count_table, live_report
from promptgov.streaming.verdicts import stream_verdicts_in_time, verdicts_in_time
from promptgov.streaming.windows import stream_windows, window_table

Query = Callable[[SparkSession, str], DataFrame]


def on_prompts(column: Callable[[Column], Column], name: str, source=W.prompts) -> Query:
    return lambda spark, sf: source(spark, sf).select(
        "request_id", column(F.col("prompt")).alias(name))


def on_outputs(column: Callable[[Column], Column], name: str) -> Query:
    return lambda spark, sf: W.outputs(spark, sf).select(
        "kind", "id", column(F.col("output")).alias(name))


def listed(df: DataFrame, *key: str, position: bool = True) -> DataFrame:
    """One row per violation, numbered from 0 within its list."""
    fields = ["Rule", "Severity", "Message"] + (["Position"] if position else [])
    return df.select(*key, F.posexplode("violations").alias("ordinal", "v")).select(
        *key, "ordinal", *[F.col(f"v.{f}").alias(f.lower()) for f in fields])


def checked(**only) -> Query:
    """Violations under the policy, or under one with some checks only."""
    from dataclasses import replace

    policy = W.POLICY
    if only:
        off = {"prompt_injection_protection": False, "blocked_patterns": (), "max_prompt_tokens": 0}
        policy = replace(policy, **{**off, **only})
    return lambda spark, sf: listed(checks.check(W.prompts(spark, sf), policy), "request_id")


def check_deny_list(spark, sf):
    """Violations of a deny-list with thousands of entries."""
    prompts = W.prompts(spark, sf).select("request_id", "prompt")
    return table_violations(prompts, W.long_deny_list(spark, sf), "part", "i")


def normalize_input(spark, sf):
    df = text.normalize(W.outputs(spark, sf), "output", "normalized")
    return df.select("kind", "id", "normalized")


def is_clean(spark, sf):
    df = checks.check(W.prompts(spark, sf), W.POLICY)
    return df.select("request_id", checks.is_clean(F.col("violations")).alias("is_clean"))


def violation_position(spark, sf):
    df = checks.check(W.prompts(spark, sf), W.POLICY)
    found = df.select("request_id", F.filter(
        "violations", lambda v: v["Position"] >= 0)["Position"].alias("at")).filter(F.size("at") > 0)
    return found.select("request_id", F.array_min("at").alias("first_position"),
                        F.array_max("at").alias("last_position"))


def redact_output(spark, sf):
    df = W.outputs(spark, sf).select("kind", "id", pii.redact_output(F.col("output")).alias("r"))
    return df.select("kind", "id", "r.redacted", "r.changed")


def is_output_clean(spark, sf):
    return output.output_clean(W.outputs(spark, sf)).select("kind", "id", "is_clean")


def policy_tables(spark, sf):
    """Requests per tenant beside what a policy file says on the tenant."""
    policy = load_policy(spark, W.policy_file(spark))
    tables = policy.tables(spark)
    # One row per budget of a hand-written file, kept by the driver: safe to broadcast.
    budgets = F.broadcast(tables["budgets"].drop("ordinal"))
    rate = policy.bucket_rate
    used = W.read(spark, sf, "documents").groupBy(F.col("source").alias("tenant")).agg(
        F.count(F.lit(1)).alias("requests"))
    return used.join(budgets, "tenant", "left").withColumn("tokens_per_minute", F.lit(rate))


def tenant_labels(spark, sf):
    return W.sized_prompts(spark, sf).groupBy(text.tenant_label(F.col("tenant")).alias("tenant")).agg(
        F.count(F.lit(1)).alias("requests"))


def bucket(spark, sf, reset: Column | None = None) -> DataFrame:
    return ratelimit.token_bucket(W.asks(spark, sf), W.EVENT_RATE, W.EVENT_CAPACITY, reset=reset)


DECIDED = ("tenant", "request_id", "allowed", "remaining")


def bucket_remaining(spark, sf):
    tenants = W.asks(spark, sf).select("tenant").union(
        W.read(spark, sf, "documents").select(F.col("source").alias("tenant")))
    return ratelimit.bucket_remaining(bucket(spark, sf), tenants, W.EVENT_CAPACITY)


def rate_limit_gate(spark, sf):
    asks = W.sized_prompts(spark, sf).select(
        "request_id", "ts", "tenant", text.estimate_tokens(F.col("prompt")).alias("tokens"))
    decided = ratelimit.rate_limit_gate(asks, W.POLICY)
    return decided.select("request_id", "tenant", "allowed", "remaining")


def minutes(df: DataFrame, column: str) -> Column:
    """Whole minutes since 1970."""
    return F.floor(micros(df, column) / limits.MINUTE).alias(column)


def rpm_exceeded(spark, sf):
    found = limits.requests_per_minute(W.asks(spark, sf), W.rate_limits(spark))
    return found.withColumn("minute", minutes(found, "minute"))


def rpm_windows(spark, sf):
    windows = limits.exceeded_windows(limits.request_windows(W.asks(spark, sf)), W.rate_limits(spark))
    return windows.withColumn("minute", minutes(windows, "minute"))


def own_limit_gate(spark, sf):
    decided = limits.own_token_bucket(W.asks(spark, sf), W.rate_limits(spark), burst_minutes=W.EVENT_BURST)
    return decided.select(*DECIDED)


def spending(status: DataFrame, *times: str) -> DataFrame:
    """Money and times as whole numbers."""
    money = [c for c in status.columns if c.endswith("_nanos")]
    return status.withColumns({c: F.col(c).cast("long") for c in money} | {c: micros(status, c) for c in times})


def budget_status(spark, sf):
    status = budgets.budget_status(W.usage(spark, sf), W.budgets(spark, sf), W.prices(spark, sf))
    return spending(status, "alert_ts", "exceeded_ts").withColumn("month", F.col("month").cast("string"))


def running_spend(spark, sf):
    spent = budgets.spend_by_request(W.usage(spark, sf), W.budgets(spark, sf), W.prices(spark, sf))
    return spending(spent).select("request_id", "tenant", "cost_nanos", "spend_nanos", "status")


def route_model(spark, sf):
    prompts = W.sized_prompts(spark, sf).select(
        "request_id", text.estimate_tokens(F.col("prompt")).alias("prompt_tokens"))
    rules = Policy(routing_rules=W.ROUTES).tables(spark)["routing_rules"]
    return routing.route(prompts, rules)


def verdict_join(spark, sf):
    prompts = W.sized_prompts(spark, sf).select("request_id")
    joined = verdicts.join_verdicts(prompts, W.verdicts(spark, sf))
    return joined.select("request_id", "reached", "rail_allowed",
                         F.when(F.col("reached"), F.size("rail_violations")).alias("rail_violations"))


def verdict_violations(spark, sf):
    found = verdicts.verdict_violations(F.col("allowed"), F.col("reasons"))
    return listed(W.all_verdicts(spark, sf).select("request_id", found.alias("violations")), "request_id")


def verdict_outage(spark, sf):
    prompts = W.sized_prompts(spark, sf).select("request_id", "tenant")
    return verdicts.outages(prompts, W.verdicts(spark, sf), fail_closed=True)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return Gate(W.POLICY).decide(W.requests(spark, sf), W.verdicts(spark, sf))


def policy_replay(spark, sf):
    versions = load_versions(spark, W.policy_versions(spark))
    done = replay(W.requests(spark, sf), versions, W.verdicts(spark, sf))
    return done.select("request_id", "tenant", "outcome", "action", "reason", F.size("violations").alias("violations"), "policy_version")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return audit_events(decisions(spark, sf))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return stats.audit_classify(events(spark, sf))


def policy_check(table: str, message: Callable[[], Column]) -> Query:
    return lambda spark, sf: W.policy_tables(spark, sf)[table].select(
        "policy_id", "ordinal", message().alias("message"))


# -- streams: read the table as a stream, stop when all of it is done ---------


def table_stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """Micro-batches of bounded size, of a table that is one file or a folder of files."""
    schema = W.read(spark, sf, table).schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", 8 << 30)
    # A stream takes a folder or a pattern, but no file: the pattern matches the table alone, whichever it is.
    return stream.option("basePath", sf).parquet(f"{sf}/{table}.parque[t]")


@contextmanager
def few_partitions(spark: SparkSession):
    """State is kept per shuffle partition, so a local run should not have hundreds."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(task_count(spark)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(spark: SparkSession, writer, checkpoint: str) -> None:
    with few_partitions(spark):
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gated(spark: SparkSession, sf: str, label: str, sink) -> str:
    """Put all requests through the gate as a stream; `sink(folder)` takes the audit events of each micro-batch."""
    folder = work_dir(spark, label)
    deliver = sink(folder)
    requests = W.requests_from(table_stream(spark, sf, "documents"))
    writer = gate_batches(requests, W.POLICY, lambda batch, i: deliver(audit_events(batch), i),
                          bucket_table(f"{folder}/buckets"), W.verdicts(spark, sf))
    drain(spark, writer, f"{folder}/checkpoint")
    return folder


def sunk(spark: SparkSession, path: str) -> DataFrame:
    """What a parquet sink has taken."""
    return spark.read.parquet(path).drop("batch_id")


def stream_gate(spark, sf):
    json = lambda batch: with_json(batch).select("request_id", "json")
    folder = gated(spark, sf, "gate", lambda folder: parquet_sink(f"{folder}/rows", json))
    return sunk(spark, f"{folder}/rows")


def stream_bucket(spark, sf):
    folder = work_dir(spark, "bucket")
    asks = W.asks_from(table_stream(spark, sf, "events"))
    sink = parquet_sink(f"{folder}/rows", lambda batch: batch.select(*DECIDED))
    writer = bucket_batches(asks, W.EVENT_RATE, W.EVENT_CAPACITY, sink, bucket_table(f"{folder}/balances"))
    drain(spark, writer, f"{folder}/checkpoint")
    return sunk(spark, f"{folder}/rows")


def stream_remaining(spark, sf):
    """The balances that a live bucket has left, for all tenants of both tables."""
    folder = work_dir(spark, "remaining")
    table = bucket_table(f"{folder}/balances")
    asks = W.asks_from(table_stream(spark, sf, "events"))
    drain(spark, bucket_batches(asks, W.EVENT_RATE, W.EVENT_CAPACITY, lambda *_: None, table), f"{folder}/checkpoint")
    tenants = W.asks(spark, sf).select("tenant").union(
        W.read(spark, sf, "documents").select(F.col("source").alias("tenant")))
    return bucket_balances(table, tenants, W.EVENT_CAPACITY)


def stream_anomaly(spark, sf):
    folder = work_dir(spark, "anomaly")
    prompts = W.prompts_from(table_stream(spark, sf, "documents"))
    writer = anomaly_batches(prompts, W.MIN_SAMPLES, parquet_sink(f"{folder}/rows"), profile_table(f"{folder}/profiles"))
    drain(spark, writer, f"{folder}/checkpoint")
    return sunk(spark, f"{folder}/rows")


def stream_statistics(spark, sf):
    """Live counts beside the gate."""
    table = lambda folder: count_table(f"{folder}/counts")
    folder = gated(spark, sf, "stats", lambda folder: add_counts(table(folder)))
    return live_report(spark, table(folder), "stats_by_tenant")


def stream_rpm(spark, sf):
    """Minutes beyond the limit, kept up to date by the stream of windows."""
    folder = work_dir(spark, "rpm")
    table = window_table(f"{folder}/windows")
    drain(spark, stream_windows(W.asks_from(table_stream(spark, sf, "events")), table), f"{folder}/checkpoint")
    windows = limits.exceeded_windows(table.read(spark), W.rate_limits(spark))
    return windows.withColumn("minute", minutes(windows, "minute"))


def stream_verdicts(spark, sf):
    """Requests and verdicts as two streams; heartbeats behind the last rows let the watermark pass them."""
    folder = work_dir(spark, "verdicts")
    paths = {"requests": f"{folder}/requests", "verdicts": f"{folder}/verdicts"}
    tables = {"requests": W.timed_requests(spark, sf), "verdicts": W.timed_verdicts(spark, sf)}
    for name, table in tables.items():
        table.write.parquet(paths[name])
    joined = stream_verdicts_in_time(*(spark.readStream.schema(t.schema).parquet(paths[n]) for n, t in tables.items()))
    out = joined.withColumn("rail_violations", F.to_json("rail_violations"))
    run = lambda: drain(spark, out.writeStream.format("parquet").option("path", f"{folder}/rows"), f"{folder}/checkpoint")
    run()
    end = tables["requests"].agg(F.max("ts")).first()[0]
    for hours in (1, 2):
        for name, table in tables.items():
            beat = F.lit(end) + F.expr(f"INTERVAL {hours} HOUR")
            value = {"ts": beat, "request_id": F.lit(-hours).cast("long")}
            spark.range(1).select(*[value.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
                                    for f in table.schema]).write.mode("append").parquet(paths[name])
        run()
    done = spark.read.schema(out.schema).parquet(f"{folder}/rows").filter("request_id >= 0")
    return done.select("request_id", "reached", "rail_allowed", F.size(F.from_json(
        "rail_violations", joined.schema["rail_violations"].dataType)).alias("rail_violations"))


def verdicts_in_time_(spark, sf):
    found = verdicts_in_time(W.timed_requests(spark, sf), W.timed_verdicts(spark, sf))
    return found.select("request_id", "reached", "rail_allowed", F.size("rail_violations").alias("rail_violations"))


def audit_fanout(spark, sf):
    """Each event at two sinks: the log lines and the classes."""
    sinks = lambda folder: fan_out({
        "log": parquet_sink(f"{folder}/log", lambda b: with_json(b).select("request_id", "json")),
        "classes": parquet_sink(f"{folder}/classes",
                                lambda b: stats.audit_classify(b).select("request_id", "class", "rule")),
    })
    folder = gated(spark, sf, "fanout", sinks)
    return sunk(spark, f"{folder}/log").join(sunk(spark, f"{folder}/classes"), "request_id")


def queries() -> dict[str, Query]:
    sanitized = {
        "sanitize_scripts": output.remove_scripts,
        "sanitize_handlers": output.remove_handlers,
        "sanitize_output": output.sanitize_output,
    }
    redacted = {
        "redact_email": pii.redact_email,
        "redact_phone": pii.redact_phone,
        "redact_ssn": pii.redact_ssn,
        "redact_card": pii.redact_card,
        "redact_pii": pii.redact_pii,
    }
    return {
        "parse_requests": lambda spark, sf: parse_requests(W.requests(spark, sf)).select(
            "request_id", "valid", "model", "prompt"),
        "extract_prompt": lambda spark, sf: parse_requests(
            W.conversation_requests(spark, sf)).select(F.col("conv_id").alias("request_id"), "prompt"),
        "policy_tables": policy_tables,
        "estimate_tokens": on_prompts(text.estimate_tokens, "tokens", W.sized_prompts),
        "tenant_label": tenant_labels,
        "count_words": on_prompts(text.count_words, "words"),
        "norm_nfc": on_prompts(text.nfc, "normalized"),
        "norm_zero_width": on_prompts(text.strip_zero_width, "normalized"),
        "norm_whitespace": on_prompts(text.collapse_whitespace, "normalized"),
        "norm_html_entities": on_outputs(text.decode_entities, "normalized"),
        "norm_control": on_prompts(text.drop_control, "normalized"),
        "normalize_input": normalize_input,
        "check_blocked": checked(blocked_patterns=W.POLICY.blocked_patterns),
        "check_deny_list": check_deny_list,
        "check_injection": checked(prompt_injection_protection=True),
        "check_max_tokens": checked(max_prompt_tokens=W.POLICY.max_prompt_tokens),
        "check_prompt": checked(),
        "is_clean": is_clean,
        "violation_position": violation_position,
        **{name: on_outputs(function, "redacted") for name, function in redacted.items()},
        "contains_pii": on_outputs(pii.contains_pii, "has_pii"),
        "redact_output": redact_output,
        "scan_output": lambda spark, sf: listed(
            output.scan(W.outputs(spark, sf)), "kind", "id", position=False),
        "is_output_clean": is_output_clean,
        **{name: on_outputs(function, "sanitized") for name, function in sanitized.items()},
        "contains_secrets": on_outputs(output.contains_secrets, "has_secrets"),
        "mask_secrets": on_outputs(output.mask_secrets, "masked"),
        "token_bucket": lambda spark, sf: bucket(spark, sf).select(*DECIDED),
        "bucket_reset": lambda spark, sf: bucket(
            spark, sf, reset=F.col("request_id") % 211 == 0).select(*DECIDED),
        "bucket_remaining": bucket_remaining,
        "rate_limit_gate": rate_limit_gate,
        "rpm_exceeded": rpm_exceeded,
        "rpm_windows": rpm_windows,
        "own_limit_gate": own_limit_gate,
        "budget_status": budget_status,
        "running_spend": running_spend,
        "route_model": route_model,
        "prompt_anomaly": lambda spark, sf: anomaly.prompt_anomaly(W.sized_prompts(spark, sf), W.MIN_SAMPLES),
        "tenant_profile": lambda spark, sf: anomaly.tenant_profile(W.sized_prompts(spark, sf)),
        "verdict_join": verdict_join,
        "verdict_violations": verdict_violations,
        "verdict_outage": verdict_outage,
        "gate_decision": lambda spark, sf: decisions(spark, sf).withColumn(
            "violations", F.size("violations")).drop("ts"),
        "policy_replay": policy_replay,
        "block_response": lambda spark, sf: block_response(decisions(spark, sf)).select(
            "request_id", "outcome", "status", "error_message", "error_type", "error_code"),
        "audit_events": lambda spark, sf: listed(
            events(spark, sf), "request_id", "model", "tenant", "action", "reason"),
        "audit_json": lambda spark, sf: with_json(events(spark, sf)).select("request_id", "json"),
        "audit_classify": lambda spark, sf: classified(spark, sf).select("request_id", "class", "rule"),
        "stats_totals": lambda spark, sf: stats.stats_totals(classified(spark, sf)),
        "stats_by_tenant": lambda spark, sf: stats.stats_by_tenant(classified(spark, sf)),
        "violation_counts": lambda spark, sf: stats.violation_counts(classified(spark, sf)),
        "validate_budgets": policy_check("budgets", lambda: policy_rules.budget_error(
            F.col("tenant"), F.col("monthly_limit_usd"), F.col("alert_at_percent"))),
        "validate_rate_limits": policy_check("rate_limits", lambda: policy_rules.rate_limit_error(
            F.col("tokens_per_minute"))),
        "validate_policy": lambda spark, sf: policy_rules.validate_policies(**W.policy_tables(spark, sf)),
        "stream_gate": stream_gate,
        "stream_bucket": stream_bucket,
        "stream_anomaly": stream_anomaly,
        "stream_stats": stream_statistics,
        "stream_remaining": stream_remaining,
        "stream_rpm": stream_rpm,
        "verdicts_in_time": verdicts_in_time_,
        "stream_verdicts": stream_verdicts,
        "audit_fanout": audit_fanout,
    }
