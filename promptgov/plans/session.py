"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Texts are large and regexes slow, so a task takes less input than Spark's default.
    "spark.sql.files.maxPartitionBytes": "64m",
    # Of members of one name in a request body, the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # One piece of bucket or profile state per tenant: keep it off the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "promptgov", **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword names use `__` for the dots of Spark's names."""
    builder = SparkSession.builder.appName(app)
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()

