"""State per tenant in a stream: the token bucket and the length profile.

Both fold a tenant's rows of one micro-batch in the order (ts, order) and keep a few
numbers until the next. The token bucket's step and the profile's verdict are the
functions the batch operators use.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from promptgov.operators.anomaly import anomaly_columns
from promptgov.operators.bucket_fold import MINUTE, NEVER, step
from promptgov.operators.clock import micros

NO_BUCKET = -1  # what an exempt row has left; becomes NULL


def _sorted(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A tenant's rows of this micro-batch, whose size the source's limits bound."""
    return pd.concat(list(pdfs), ignore_index=True).sort_values(["__us", "__order"], kind="stable")


def _nullable(df: DataFrame) -> list[T.StructField]:
    return [T.StructField(f.name, f.dataType) for f in df.schema]


def stream_token_bucket(
    asks: DataFrame, rate: int, capacity: int, *, tenant: str = "tenant", ts: str = "ts",
    order: str = "request_id", tokens: str = "tokens", exempt: Column | None = None,
    evict_idle: bool = False,
) -> DataFrame:
    """Add `allowed` and `remaining` to a stream of asks.

    A row older than the last refill gets none but may spend. Exempt rows, and rows without
    a time, keep no state and are spread over the tasks.

    With `evict_idle` the stream needs a watermark on `ts`; a tenant's state is dropped
    once the watermark shows that its bucket has filled up again. That changes no result
    for rows within the watermark.
    """
    exempt = (F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)) | F.col(ts).isNull()
    rows = asks.select(
        "*",
        exempt.alias("__exempt"),
        F.when(exempt, F.concat(F.lit("-"), F.pmod(F.xxhash64(order), F.lit(1 << 16)).cast("string")))
        .otherwise(F.concat(F.lit("+"), F.coalesce(tenant, F.lit("")))).alias("__key"),
        micros(asks, ts).alias("__us"),
        F.col(order).alias("__order"),
        F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("__ask"),
    )
    out = T.StructType(_nullable(asks) + [
        T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())])
    keep = asks.columns
    fill_minutes = -(-capacity // rate)

    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if key[0].startswith("-"):
            for pdf in pdfs:
                yield pdf[keep].assign(allowed=True, remaining=NO_BUCKET)
            return
        fill, balance = state.get if state.exists else (NEVER, capacity)
        pdf = _sorted(pdfs)
        allowed, remaining = [], []
        for us, ask in zip(pdf["__us"].tolist(), pdf["__ask"].tolist()):
            fill, balance, ok = step(fill, balance, us, ask, rate, capacity)
            allowed.append(ok)
            remaining.append(balance)
        full_at = fill + fill_minutes * MINUTE
        if evict_idle and full_at // 1000 <= state.getCurrentWatermarkMs():
            state.remove()
        else:
            state.update((fill, balance))
            if evict_idle:
                state.setTimeoutTimestamp(full_at // 1000 + 1)
        yield pdf[keep].assign(allowed=allowed, remaining=remaining)

    timeout = GroupStateTimeout.EventTimeTimeout if evict_idle else GroupStateTimeout.NoTimeout
    decided = rows.groupBy("__key").applyInPandasWithState(
        fold, out, "fill long, balance long", "append", timeout)
    return decided.withColumn("remaining", F.nullif("remaining", F.lit(NO_BUCKET)))


def stream_prompt_anomaly(
    prompts: DataFrame, min_samples: int, *, tenant: str = "tenant", ts: str = "ts",
    order: str = "request_id", prompt: str = "prompt",
) -> DataFrame:
    """One row per prompt with its verdict; only lengths leave the map side."""
    rows = prompts.select(
        F.coalesce(tenant, F.lit("")).alias("__key"),
        micros(prompts, ts).alias("__us"),
        F.col(order).alias("__order"),
        F.coalesce(F.octet_length(prompt), F.lit(0)).cast("long").alias("__length"),
    )
    out = T.StructType([
        T.StructField(order, prompts.schema[order].dataType), T.StructField(tenant, T.StringType()),
        T.StructField("__length", T.LongType()), T.StructField("__n", T.LongType()),
        T.StructField("__sum", T.LongType()), T.StructField("__squares", T.StringType()),
    ])

    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares = state.get if state.exists else (0, 0, "0")
        pdf = _sorted(pdfs)
        lengths = pdf["__length"].tolist()
        # Python integers: the squares may add up to more than 64 bits hold.
        totals = list(accumulate(lengths, initial=total))[1:]
        sums = list(accumulate((x * x for x in lengths), initial=int(squares)))[1:]
        counts = range(n + 1, n + 1 + len(lengths))
        state.update((n + len(lengths), totals[-1], str(sums[-1])))
        yield pd.DataFrame({
            order: pdf["__order"].to_numpy(), tenant: key[0], "__length": lengths,
            "__n": list(counts), "__sum": totals, "__squares": [str(x) for x in sums],
        })

    summed = rows.groupBy("__key").applyInPandasWithState(
        fold, out, "n long, total long, squares string", "append", GroupStateTimeout.NoTimeout)
    return summed.select(order, tenant, *anomaly_columns(
        F.col("__length"), F.col("__n"), F.col("__sum"), F.col("__squares").cast("decimal(38,0)"),
        min_samples))
