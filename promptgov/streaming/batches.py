"""The stateful operators on streams, a micro-batch at a time by the batch operators.

Each micro-batch is decided by the chunked functions of the batch operators, so a tenant with most of
its rows is spread over all tasks, and no task sorts more than its chunk. What tenants carry from one micro-batch to the
next lies in a `KeyedTable`. A micro-batch goes to the sink first and changes the table then; if it
comes again after a failure it starts from the same state, and sink and table overwrite what they had.

A micro-batch takes effect in the order (ts, order) after all micro-batches before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptgov.operators.anomaly import prompt_anomaly
from promptgov.operators.gate import Gate
from promptgov.operators.ratelimit import last_state, token_bucket
from promptgov.plans.lineage import cut_lineage
from promptgov.sources.policy import Policy
from promptgov.streaming.keyed import KeyedTable

Sink = Callable[[DataFrame, int], None]


def bucket_table(path: str, **options) -> KeyedTable:
    return KeyedTable(path, "tenant string, fill long, balance long", ["tenant"], **options)


def profile_table(path: str, **options) -> KeyedTable:
    return KeyedTable(path, "tenant string, n long, total long, squares decimal(38,0)", ["tenant"], add=True, **options)


def bucket_balances(table: KeyedTable, tenants: DataFrame, capacity: int) -> DataFrame:
    """tenant, remaining: what a live bucket has left, without a refill; the full capacity where none has asked."""
    known = table.read(tenants.sparkSession).select("tenant", "balance")
    return tenants.select("tenant").distinct().join(known, "tenant", "left").select(
        "tenant", F.coalesce("balance", F.lit(capacity).cast("long")).alias("remaining"))


def _decide(batch: DataFrame, batch_id: int, table: KeyedTable, rate, capacity, **columns) -> DataFrame:
    """The batch's rows with `allowed`, `remaining` and the refill `__fill_us`, written down."""
    state = table.read(batch.sparkSession, before=batch_id)
    return cut_lineage(token_bucket(batch, rate, capacity, state=state, fill="__fill_us", **columns), "decided")


def _keep(decided: DataFrame, batch_id: int, table: KeyedTable, **columns) -> None:
    names = {k: v for k, v in columns.items() if k in ("tenant", "ts", "order")}
    table.commit(last_state(decided, fill="__fill_us", **names), batch_id)


def bucket_batches(
    asks: DataFrame, rate: int | Column, capacity: int | Column, sink: Sink, table: KeyedTable, *,
    exempt: Column | None = None, **columns,
) -> DataStreamWriter:
    """Each micro-batch of asks with `allowed` and `remaining`, handed to `sink`."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        decided = _decide(cut_lineage(batch, "asks"), batch_id, table, rate, capacity, exempt=exempt, **columns)
        sink(decided.drop("__fill_us"), batch_id)
        _keep(decided, batch_id, table, **columns)

    return asks.writeStream.outputMode("append").foreachBatch(fold)


def gate_batches(
    requests: DataFrame, policy: Policy | Callable[[], Policy], sink: Sink, table: KeyedTable,
    verdicts: DataFrame | None = None, pinned: Policy | None = None,
) -> DataStreamWriter:
    """Each micro-batch of requests as `Gate.decide` decides it, handed to `sink`; texts stay in the JVM.

    `policy` may be a function that gives the policy in force for the micro-batch; the bucket then keeps the
    rate of the `pinned` one.
    """
    current = policy if callable(policy) else lambda: policy
    pinned = pinned or current()

    def decide(batch: DataFrame, batch_id: int) -> None:
        gate = Gate(current())
        scored = cut_lineage(gate.score(batch), "scored")
        if pinned.bucket_rate is None:
            free = scored.withColumns({"allowed": F.lit(True), "remaining": F.lit(None).cast("long")})
            sink(gate.judge(free, verdicts), batch_id)
            return
        exempt = (F.col("tenant") == "") | F.col("passed").isNotNull()
        decided = _decide(scored, batch_id, table, pinned.bucket_rate, pinned.bucket_capacity, exempt=exempt)
        sink(gate.judge(decided.drop("__fill_us"), verdicts), batch_id)
        _keep(decided, batch_id, table)

    return requests.writeStream.outputMode("append").foreachBatch(decide)


def anomaly_batches(
    prompts: DataFrame, min_samples: int, sink: Sink, table: KeyedTable, **columns,
) -> DataStreamWriter:
    """A verdict on each prompt of a micro-batch, by its tenant's prompts so far."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found, totals = prompt_anomaly(
            batch, min_samples, before=table.read(spark, before=batch_id), with_totals=True, **columns)
        sink(found, batch_id)
        table.commit(totals, batch_id)

    return prompts.writeStream.outputMode("append").foreachBatch(fold)
