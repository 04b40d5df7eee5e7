"""The gate over a stream of requests, with audit events as its output."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptgov.functions.matching import VIOLATION
from promptgov.operators.gate import Gate, audit_events
from promptgov.sources.policy import Policy, load_policy
from promptgov.streaming.batches import gate_batches
from promptgov.streaming.keyed import KeyedTable
from promptgov.streaming.state import stream_token_bucket

log = logging.getLogger(__name__)


def _limited(rows: DataFrame, policy: Policy) -> DataFrame:
    if policy.bucket_rate is None:
        return rows.withColumns({"allowed": F.lit(True), "remaining": F.lit(None).cast("long")})
    return stream_token_bucket(
        rows, policy.bucket_rate, policy.bucket_capacity,
        exempt=(F.col("tenant") == "") | F.col("passed").isNotNull())


def stream_gate(requests: DataFrame, policy: Policy, verdicts: DataFrame | None = None) -> DataFrame:
    """Decisions on a stream, as `Gate.decide` makes them on a table; append mode.

    `verdicts` is a table; each micro-batch joins it as it is then.
    """
    gate = Gate(policy)
    # pandas carries the violations as text: they pass through the bucket untouched.
    scored = gate.score(requests).withColumn("violations", F.to_json("violations"))
    limited = _limited(scored, policy).withColumn(
        "violations", F.from_json("violations", f"array<{VIOLATION}>"))
    return gate.judge(limited, verdicts)


class PolicyWatcher:
    """The latest valid policy of a file.

    A change of time or size counts as a new version. A version that cannot be read or
    fails its checks is reported and leaves the policy before it in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.version = None
        self.reloads = 0
        self.policy = load_policy(spark, path)

    def current(self, spark: SparkSession) -> Policy:
        try:
            seen = (spark.read.format("binaryFile").load(self.path)
                    .select("modificationTime", "length").first())
            if seen is not None and tuple(seen) != self.version:
                self.policy = load_policy(spark, self.path)
                self.version = tuple(seen)
                self.reloads += 1
        except Exception as e:  # noqa: BLE001 - whatever is wrong, the old policy stays
            log.warning("policy not reloaded: %s", e)
        return self.policy


def reloading_gate(
    requests: DataFrame, watcher: PolicyWatcher, sink: Callable[[DataFrame, int], None], table: KeyedTable,
    verdicts: DataFrame | None = None,
) -> DataStreamWriter:
    """A gate whose checks follow the policy file; the bucket keeps its first settings.

    Each micro-batch is decided under the policy in force when it begins, and goes to `sink`; the balances
    lie in `table`. Prompts stay in the JVM.
    """
    spark = requests.sparkSession
    return gate_batches(requests, lambda: watcher.current(spark), sink, table, verdicts, pinned=watcher.policy)


def stream_audit(requests: DataFrame, policy: Policy, verdicts: DataFrame | None = None) -> DataFrame:
    return audit_events(stream_gate(requests, policy, verdicts))
