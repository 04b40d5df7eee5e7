"""Requests per minute on a stream: event-time windows with a watermark, kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptgov.operators.clock import micros
from promptgov.operators.limits import request_windows
from promptgov.streaming.keyed import KeyedTable


def window_table(path: str, **options) -> KeyedTable:
    return KeyedTable(path, "tenant string, minute timestamp, requests long", ["tenant", "minute"], **options)


def stream_windows(requests: DataFrame, table: KeyedTable, late: str = "10 minutes", **columns) -> DataStreamWriter:
    """Count the requests per tenant and minute; each micro-batch writes the windows that changed in it.

    A request counts in its own minute however late it comes, as long as that minute ended no more than
    `late` before the latest time seen; later ones do not count any more. So the table also has the minutes that
    are not over yet, and the state only those that can still change.
    """
    ts = columns.get("ts", "ts")
    timed = requests.withColumn(ts, F.timestamp_micros(micros(requests, ts))).withWatermark(ts, late)
    counted = request_windows(timed, **columns)
    return counted.writeStream.outputMode("update").foreachBatch(table.commit)
