"""Small helpers that several operators of this package share."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.plans.lineage import cut_lineage, work_dir

__all__ = ["cut_lineage", "cut_and_free", "work_dir", "as_bytes", "map_rows", "bottom_sample", "seconds"]


#: Spark's setting that removes the shuffle files of a job when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_and_free(df: DataFrame, label: str) -> DataFrame:
    """`cut_lineage` whose shuffle files go when the table is written, as nothing reads them again.

    Otherwise they lie beside the table, as large as it, until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return cut_lineage(df, label)
    finally:
        conf.set(FREE_SHUFFLES, before)


def as_bytes(batch: pa.RecordBatch, name: str, step: int = 128) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, a few rows at a time, so that a batch is not held twice."""
    column = batch.column(name).cast(pa.binary())
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()


def map_rows(
    df: DataFrame, id_col: str, text_col: str, fields: list[T.StructField],
    function: Callable[[], Callable[[bytes | None], tuple]],
) -> DataFrame:
    """One output row per input row: the id as it is, and what `function()` makes of the text.

    `function` is called once per task and returns the function of one text. Other columns
    of `df` are not read, so their names cannot clash.
    """
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    id_type = source.schema["__id"].dataType
    types = [pa_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = function()
        for batch in batches:
            rows = [one(text) for text in as_bytes(batch, "__text")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), *arrays], names=[id_col, *[f.name for f in fields]])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, id_type), *fields]))


def pa_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, pa_type(f.dataType)) for f in kind.fields])
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
             T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.DoubleType: pa.float64()}
    return plain[type(kind)]


def bottom_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows, the same ones in every run: those whose key hashes lowest.

    Only hashes pass through the driver; repeated keys come in or stay out together.
    """
    spread = F.xxhash64(*keys)
    cut = df.select(spread.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("cut")).first()["cut"]
    return df.filter(spread <= F.lit(cut)) if cut is not None else df


def seconds(action: Callable[[], object]) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began
