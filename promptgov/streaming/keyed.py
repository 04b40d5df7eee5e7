"""A table by key that numbered batches change: the state of streams that fold by `foreachBatch`.

Every batch writes what it changed as a table of its own, named after the batch's number; one in
`compact_every` also writes the merged table up to it. Reading takes the newest merged table and the few
batches after it, so it costs the keys, not the history. A batch that comes again after a failure finds the
table as it was before that batch and overwrites what it wrote. What no repeated batch can need any more is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "__batch"


class KeyedTable:
    """Rows by `keys` in the folder `path`.

    With `add` the other columns are numbers that batches add to; without it a batch's row replaces
    the one before. `schema` is a DDL string of keys and other columns.
    """

    def __init__(self, path: str, schema: str, keys: list[str], *, add: bool = False, compact_every: int = 16):
        if compact_every < 1:
            raise ValueError("compact_every must be positive")
        self.path, self.schema, self.keys, self.add, self.compact_every = path, schema, keys, add, compact_every

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The table with all batches, or with those before the given one."""
        written = self._written(spark, before)
        merged = max((b for kind, b in written if kind == "merged"), default=-1)
        parts = [f"{self.path}/merged-{merged}"] if merged >= 0 else []
        parts += [f"{self.path}/changed-{b}" for kind, b in sorted(written) if kind == "changed" and b > merged]
        schema = f"{self.schema}, {BATCH} long"
        if not parts:
            return spark.createDataFrame([], schema).drop(BATCH)
        rows = spark.read.schema(schema).parquet(*parts)
        values = [c for c in rows.columns if c not in (*self.keys, BATCH)]
        if self.add:
            kinds = {f.name: f.dataType for f in rows.schema}
            return rows.groupBy(*self.keys).agg(*[F.sum(v).cast(kinds[v]).alias(v) for v in values])
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), BATCH).alias("__last"))
        return last.select(*self.keys, *[F.col("__last")[v].alias(v) for v in values])

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Put the rows that a batch changed, at most one per key, into the table."""
        spark = rows.sparkSession
        self._delete(spark, [w for w in self._written(spark, None) if w[0] == "merged" and w[1] >= batch])
        self._write(rows, "changed", batch)
        if (batch + 1) % self.compact_every == 0:
            self._write(self.read(spark, before=batch + 1), "merged", batch)
            self._delete_superseded(spark, batch)

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.withColumn(BATCH, F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{kind}-{batch}")

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _written(self, spark: SparkSession, before: int | None) -> list[tuple[str, int]]:
        """(kind, batch) of the tables that were written to the end."""
        path, files = self._files(spark)
        if not files.exists(path):
            return []
        found = []
        for entry in files.listStatus(path):
            kind, _, number = entry.getPath().getName().partition("-")
            done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if number.isdigit() and (before is None or int(number) < before) and files.exists(done):
                found.append((kind, int(number)))
        return found

    def _delete_superseded(self, spark: SparkSession, batch: int) -> None:
        """Only the newest batch can come again; it needs the merged table before it and what came after that."""
        written = self._written(spark, before=batch)
        merged = max((b for kind, b in written if kind == "merged"), default=-1)
        self._delete(spark, [(kind, b) for kind, b in written if b < merged or (kind == "changed" and b == merged)])

    def _delete(self, spark: SparkSession, written: list[tuple[str, int]]) -> None:
        _, files = self._files(spark)
        for kind, b in written:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{b}"), True)
