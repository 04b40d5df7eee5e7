"""Audit events as JSON lines, and their delivery to several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that the JSON shows as escapes. Outside of strings JSON has
# none of them, so the whole text can be treated at once.
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", chr(0x2028): "\\u2028", chr(0x2029): "\\u2029"}


def audit_json(model: Column, tenant: Column, action: Column, reason: Column, violations: Column) -> Column:
    """One JSON object per event; an empty reason and an empty list are left out."""
    event = F.struct(
        model.alias("model"),
        tenant.alias("tenant"),
        action.alias("action"),
        F.nullif(reason, F.lit("")).alias("reason"),
        F.when(F.size(violations) > 0, violations).alias("violations"),
    )
    text = F.to_json(event)
    for char, escape in ESCAPED.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def with_json(events: DataFrame, into: str = "json") -> DataFrame:
    return events.withColumn(into, audit_json(*[
        F.col(c) for c in ("model", "tenant", "action", "reason", "violations")]))


def write_audit_log(events: DataFrame, path: str) -> None:
    """One JSON object per line."""
    with_json(events).select("json").write.mode("append").text(path)


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that hands each batch to every sink.

    A batch may come again after a failure, so a sink must treat the batch id as a key;
    `parquet_sink` does. The batch is kept in memory and on disk while the sinks read it.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return deliver


def parquet_sink(path: str, select: Callable[[DataFrame], DataFrame] | None = None):
    """Write each batch to its own folder, which a repeated batch overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = select(batch) if select else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
