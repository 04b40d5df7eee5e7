"""Replays: past requests under the policies that were in force when they came.

A version holds from its `valid_from` to the next one's. A version that cannot be read or fails its
checks leaves the one before it in force, as it does in a live reload. As there, the bucket keeps the settings of the
first version, and only the checks follow the policy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgov.operators.gate import Gate
from promptgov.operators.ratelimit import rate_limit_gate
from promptgov.plans.lineage import cut_lineage
from promptgov.sources.policy import Policy


def replay(requests: DataFrame, versions: list[tuple[int, Policy]], verdicts: DataFrame | None = None) -> DataFrame:
    """Decisions as `Gate.decide` makes them, with `policy_version`: the number of the version in the list.

    versions: (valid_from in microseconds, policy) in order of time, with all that `load_versions` found valid.
    Requests before the first version, or without a time, fall under the first. Each version reads the requests of
    its own time, by a filter that reaches the scan; the bucket sees all of them in one order.
    """
    if not versions:
        raise ValueError("a replay needs a version")
    starts = [us for us, _ in versions]
    if starts != sorted(starts):
        raise ValueError("versions must be in order of time")
    at = lambda us: F.timestamp_micros(F.lit(us))

    def of(number: int):
        begun = F.lit(True) if number == 0 else F.col("ts") >= at(starts[number])
        ended = F.lit(True) if number + 1 == len(versions) else F.col("ts") < at(starts[number + 1])
        return begun & (ended | F.col("ts").isNull() if number == 0 else ended)

    gates = [Gate(policy) for _, policy in versions]
    scored = reduce(DataFrame.unionByName, [
        gate.score(requests.filter(of(i))).withColumn("policy_version", F.lit(i)) for i, gate in enumerate(gates)])
    limited = rate_limit_gate(cut_lineage(scored, "scored"), versions[0][1], checked=F.col("passed").isNull())
    if len(versions) > 1:
        limited = cut_lineage(limited, "limited")
    return reduce(DataFrame.unionByName, [
        gate.judge(limited.filter(F.col("policy_version") == i), verdicts).withColumn("policy_version", F.lit(i))
        for i, gate in enumerate(gates)])
