"""Live counts over a stream of audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptgov.operators import stats
from promptgov.sources.audit import parquet_sink
from promptgov.streaming.keyed import KeyedTable

REPORTS = {
    "stats_totals": (stats.stats_totals, []),
    "stats_by_tenant": (stats.stats_by_tenant, ["tenant"]),
    "violation_counts": (stats.violation_counts, ["rule"]),
}


def stream_stats(events: DataFrame, report: str, path: str) -> DataStreamWriter:
    """Keep a report up to date: each micro-batch writes the rows that changed in it."""
    build, _ = REPORTS[report]
    counted = build(stats.audit_classify(events))
    return counted.writeStream.outputMode("update").foreachBatch(parquet_sink(path))


def latest(spark: SparkSession, report: str, path: str) -> DataFrame:
    """The report as of the last micro-batch: the newest row of each key."""
    _, key = REPORTS[report]
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in (*key, "batch_id")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch_id").alias("row"))
    return newest.select(*key, "row.*")


#: What each report is made of, from counts.
LIVE = {
    "stats_totals": stats.totals_of,
    "stats_by_tenant": stats.by_tenant_of,
    "violation_counts": stats.by_rule_of,
}


def count_table(path: str, **options) -> KeyedTable:
    return KeyedTable(path, "tenant string, class string, rule string, n long", ["tenant", "class", "rule"], add=True, **options)


def add_counts(table: KeyedTable):
    """A sink for audit events that adds each micro-batch to the counts, once however often it comes."""
    return lambda batch, batch_id: table.commit(stats.class_counts(stats.audit_classify(batch)), batch_id)


def live_report(spark: SparkSession, table: KeyedTable, report: str) -> DataFrame:
    """One of the reports as of the last micro-batch; it costs the combinations counted, not the history."""
    return LIVE[report](table.read(spark))
