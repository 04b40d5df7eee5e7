"""Running totals and as-of joins over rows in order, without a task per key.

The rows in order of key and time are cut into chunks of about equal size, which may cut through
a hot key, minute or instant. Each chunk works alone; what its first key brings along from the chunks
before comes from one row per key and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptgov.operators.clock import micros
from promptgov.plans.lineage import in_chunks


def _carried(per_chunk: DataFrame, keys: list[str], carry: dict[str, Column]) -> DataFrame:
    """What the chunks of a key before each of its chunks add up to, for keys that a cut goes through.

    A cut goes through one key, so there are no more such rows than chunks.
    """
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    several = per_chunk.withColumn("__chunks", F.count(F.lit(1)).over(whole)).filter("__chunks > 1")
    return several.select(*keys, "__chunk", *[c.over(before).alias(f"__before_{n}") for n, c in carry.items()])


def running_totals(rows: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column], label: str) -> DataFrame:
    """Add to each row the totals over its key's rows up to and with it, in the given order.

    `keys` are columns without nulls that begin the order. `totals` names sums: a value per row, summed.
    """
    rows = rows.withColumns({f"__{n}": value for n, value in totals.items()})
    rows = in_chunks(rows, [*keys, *order], label)
    so_far = Window.partitionBy("__chunk", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.sum(f"__{n}").over(so_far).alias(n) for n in totals])
    per_chunk = rows.groupBy(*keys, "__chunk").agg(*[F.sum(f"__{n}").alias(n) for n in totals])
    carried = _carried(per_chunk, keys, {n: F.sum(n) for n in totals})
    joined = local.join(F.broadcast(carried), [*keys, "__chunk"], "left")
    joined = joined.withColumns({n: F.col(n) + F.coalesce(f"__before_{n}", F.lit(0)) for n in totals})
    return joined.drop("__chunk", *[f"__{n}" for n in totals], *[f"__before_{n}" for n in totals])


def asof_join(
    rows: DataFrame, versions: DataFrame, *, by: str, at: str, since: str, take: list[str], label: str = "as-of",
) -> DataFrame:
    """Add the columns `take` of the version in force: of `versions` with the row's `by`, the one with the
    latest `since` not after the row's `at`; nulls where there is none.

    Of versions of one instant the one with the largest `take` counts. Rows without a key or a time get
    nulls, versions without either are none. Both sides go into one order, so neither is broadcast.
    """
    names = rows.columns
    version = F.struct(*[F.col(c) for c in take])
    left = rows.select(
        F.struct(*names).alias("__row"), F.col(by).alias("__by"), micros(rows, at).alias("__us"), F.lit(1).alias("__side"))
    right = versions.filter(F.col(by).isNotNull() & F.col(since).isNotNull()).groupBy(
        F.col(by).alias("__by"), micros(versions, since).alias("__us")).agg(F.max(version).alias("__version"))
    both = left.unionByName(right.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    both = in_chunks(both, ["__by", "__us", "__side"], label)
    so_far = Window.partitionBy("__chunk", "__by").orderBy("__us", "__side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("__own", F.last("__version", ignorenulls=True).over(so_far)).filter("__side = 1")
    ends = both.groupBy("__by", "__chunk").agg(
        F.max_by("__version", F.when(F.col("__side") == 0, F.col("__us"))).alias("__version"))
    carried = _carried(ends.filter("__by IS NOT NULL"), ["__by"], {"version": F.last("__version", ignorenulls=True)})
    joined = local.join(F.broadcast(carried), ["__by", "__chunk"], "left")
    known = F.when(F.col("__us").isNotNull(), F.coalesce("__own", "__before_version"))
    return joined.select("__row.*", known.alias("__known")).select(*names, *[F.col("__known")[c].alias(c) for c in take])
