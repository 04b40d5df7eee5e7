"""Routing: which model the rules of a policy send a prompt to.

A condition compares the prompt's tokens with whole numbers, several comparisons joined by `and` or
`&&`: `prompt_tokens >= 500 and prompt_tokens < 2000`. It comes down to one interval. An empty condition
holds always, a contradictory one never; a malformed one never holds and has an error. The
first rule in order that holds decides.

The rules of a policy become a table of stretches: sorted bounds, and for each the rule that decides
from there on. A prompt finds its stretch by binary search, so any number of rules costs a prompt
its logarithm.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the only thing a condition may ask for.
SUBJECT = "prompt_tokens"
COMPARISON = rf"^\s*{SUBJECT}\s*(<=|>=|==|=|<|>)\s*([0-9]{{1,18}})\s*$"
JOINED = r"(?i)\s+and\s+|&&"
MOST = (1 << 62) - 1
MSG_CONDITION = "condition must compare prompt_tokens with a whole number: "
STRETCHES = "policy_id {key}, bounds array<bigint>, ordinals array<bigint>, models array<string>"


def _terms(condition: Column) -> Column:
    return F.split(F.coalesce(condition, F.lit("")), JOINED)


def _empty(condition: Column) -> Column:
    return F.trim(F.coalesce(condition, F.lit(""))) == ""


def rule_error(condition: Column) -> Column:
    """Why a condition cannot be read, or NULL."""
    bad = F.filter(_terms(condition), lambda t: ~t.rlike(COMPARISON))
    return F.when(~_empty(condition) & (F.size(bad) > 0), F.concat(F.lit(MSG_CONDITION), F.get(bad, F.lit(0))))


def interval(condition: Column) -> Column:
    """STRUCT<low, high> of the token counts a condition holds for, both inclusive; NULL where it cannot be read."""
    def bound(low: bool):
        def of(term: Column) -> Column:
            op = F.regexp_extract(term, COMPARISON, 1)
            n = F.regexp_extract(term, COMPARISON, 2).try_cast("long")
            exact = op.isin("=", "==", ">=" if low else "<=")
            beyond = op == (">" if low else "<")
            return F.when(exact, n).when(beyond, n + (1 if low else -1)).otherwise(0 if low else MOST)
        return of

    terms = _terms(condition)
    low, high = F.array_max(F.transform(terms, bound(True))), F.array_min(F.transform(terms, bound(False)))
    always = F.struct(F.lit(0).cast("long").alias("low"), F.lit(MOST).alias("high"))
    return F.when(_empty(condition), always).when(
        rule_error(condition).isNull(), F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")))


def _sweep(rules: list[tuple[int, int, int, str]]) -> tuple[list[int], list[int | None], list[str | None]]:
    """(low, high, ordinal, model) -> bounds, and the first rule in order from each bound on."""
    starts = sorted(rules)
    ends = sorted({r[0] for r in rules} | {r[1] + 1 for r in rules})
    bounds, ordinals, models, active, at = [], [], [], [], 0
    for bound in ends:
        while at < len(starts) and starts[at][0] <= bound:
            low, high, ordinal, model = starts[at]
            heapq.heappush(active, (ordinal, model, high))
            at += 1
        while active and active[0][2] < bound:
            heapq.heappop(active)
        now = active[0][:2] if active else (None, None)
        if not bounds or (ordinals[-1], models[-1]) != now:
            bounds.append(bound)
            ordinals.append(now[0])
            models.append(now[1])
    return bounds, ordinals, models


def stretches(rules: DataFrame) -> DataFrame:
    """policy_id, bounds, ordinals, models: one row per policy that has rules which can hold.

    rules: policy_id, ordinal, condition, model. A group is the rules of one policy, a written list.
    """
    read = rules.select("policy_id", F.col("ordinal").cast("long").alias("ordinal"),
                        F.coalesce("model", F.lit("")).alias("model"), interval(F.col("condition")).alias("i"))
    read = read.select("policy_id", "ordinal", "model", "i.low", "i.high").filter("low <= high")
    key = read.schema["policy_id"].dataType.simpleString()

    def sweep(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("low", "high", "ordinal", "model")), strict=True))
        bounds, ordinals, models = _sweep(rows)
        return pa.table({
            "policy_id": table.column("policy_id")[:1], "bounds": pa.array([bounds], pa.list_(pa.int64())),
            "ordinals": pa.array([ordinals], pa.list_(pa.int64())), "models": pa.array([models], pa.list_(pa.string()))})

    return read.groupBy("policy_id").applyInArrow(sweep, STRETCHES.format(key=key))


def count_at_most(bounds: Column, x: Column) -> Column:
    """How many of the sorted bounds are not above x, by binary search."""
    steps = F.ceil(F.log2(F.size(bounds) + 1)).cast("int")
    begin = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.coalesce(F.get(bounds, middle) <= x, F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(right, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), begin, halve, lambda s: s["low"])


def _routed(rows: DataFrame, names: list[str], tokens: str, bounds: Column, ordinals: Column, models: Column) -> DataFrame:
    at = F.coalesce(count_at_most(bounds, F.coalesce(tokens, F.lit(0)).cast("long")), F.lit(0)) - 1
    found = rows.withColumn("__at", at)
    value = lambda c: F.when(F.col("__at") >= 0, F.get(c, F.col("__at")))
    return found.select(*names, value(ordinals).cast("int").alias("rule"), value(models).alias("model"))


def route_by_policy(requests: DataFrame, rules: DataFrame, *, policy: str = "policy_id", tokens: str = "prompt_tokens") -> DataFrame:
    """Add `rule` (its ordinal) and `model` by the rules of each row's own policy; nulls where no rule holds.

    Null tokens are none. The join is left to Spark, which knows how large the policies are.
    """
    found = stretches(rules).withColumnRenamed("policy_id", "__policy")
    names = requests.columns
    joined = requests.join(found, F.col(policy) == F.col("__policy"), "left")
    return _routed(joined, names, tokens, F.col("bounds"), F.col("ordinals"), F.col("models"))


def route(requests: DataFrame, rules: DataFrame, *, tokens: str = "prompt_tokens") -> DataFrame:
    """The same under one policy: its stretches are as small as its file and become part of the plan."""
    one = stretches(rules.withColumn("policy_id", F.lit(0))).first()
    none = F.lit(None)
    if one is None:
        return requests.withColumns({"rule": none.cast("int"), "model": none.cast("string")})
    array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    return _routed(requests, requests.columns, tokens, array(one.bounds, "long"), array(one.ordinals, "long"),
                   array(one.models, "string"))
