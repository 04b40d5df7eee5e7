"""Per-tenant token bucket.

A bucket starts full. An ask first refills it by `rate` for each whole minute since
the last refill (the fraction is lost), up to the capacity; it is allowed if it
finds enough tokens, and a denied ask spends nothing. So asks of one tenant depend
on each other, and no running sum gives the answer.

Yet no tenant is handled by one task. The asks in order of tenant and time are cut into
chunks of about equal size, and every step over the asks runs on all chunks in parallel:

1. Each chunk gives the last refill at its end as a function of the one before it.
2. These functions are applied in turn: the refill each chunk starts from.
3. Each chunk, its refills known now, gives the balance at its end as a function of
   the one before it.
4. These are applied in turn: the balance each chunk starts from.
5. Each chunk decides its asks.

Steps 1 to 4 are taken only for tenants that a cut goes through, at most one per cut. Steps
2 and 4 work on FAN functions at a time: neighbours are composed level by level, the top
level is applied, and its results go down again. So a task reads FAN functions of a tenant,
however many chunks the tenant has. The result is that of one pass over the asks in order.

A refill function has at most one piece per ask. A balance function has as many as the asks cut the
balances into, at most the capacity plus one: about 10,000 after 500 asks of mixed sizes that
did not fill the bucket, at any capacity from 100,000 to 200 million; one once it was full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.operators import bucket_fold as fold
from promptgov.operators.clock import micros
from promptgov.plans.lineage import cut_lineage, in_chunks, task_count

_TIME = ["__us", "__order"]
#: So many functions are composed or applied by one task.
FAN = 16


def token_bucket(
    asks: DataFrame,
    rate: int | Column,
    capacity: int | Column,
    *,
    tenant: str = "tenant",
    ts: str = "ts",
    order: str = "request_id",
    tokens: str = "tokens",
    reset: Column | None = None,
    exempt: Column | None = None,
    state: DataFrame | None = None,
    fill: str | None = None,
) -> DataFrame:
    """Add `allowed` and `remaining` (tokens left after the row) to every row.

    Rows take effect in the order (`ts`, `order`). Where `reset` is true the row
    empties the tenant's history instead of asking. Where `exempt` is true the row is
    allowed and touches no bucket; a row without a time has no place in the order and is
    exempt too. The input is computed twice, to sample it and to cut
    it into chunks, so pass a written table if it is costly.

    Rate and capacity may be columns that depend on the tenant alone; rows without a positive
    rate and a capacity then have no limit and are exempt.

    `state` holds what tenants start from, (tenant, fill, balance) as of earlier rows; the others
    start full. `fill` names a column to add for the last refill after the row, in microseconds. With
    both, a history may be decided in parts, and the rows of a part may be older than the last refill.
    """
    if not isinstance(rate, Column) and rate <= 0 or not isinstance(capacity, Column) and capacity < 0:
        raise ValueError("the rate must be positive and the capacity non-negative")
    keep = asks.columns
    rate, capacity = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (rate, capacity))
    exempt = (F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)) | F.col(ts).isNull()
    exempt = exempt | ~F.coalesce((rate > 0) & (capacity >= 0), F.lit(False))
    reset = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    rows = asks.select(
        *keep,
        F.when(~exempt, F.coalesce(tenant, F.lit(""))).alias("__tenant"),
        F.coalesce(micros(asks, ts), F.lit(fold.NEVER)).alias("__us"),
        F.col(order).alias("__order"),
        F.when(exempt, fold.EXEMPT).when(reset, fold.RESET).otherwise(fold.ASK).alias("__kind"),
        F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("__ask"),
        F.lit(fold.NEVER).alias("__since"),
        F.coalesce(rate, F.lit(0)).alias("__rate"), F.coalesce(capacity, F.lit(0)).alias("__capacity"),
    )
    if state is not None:
        rows = rows.unionByName(_set_rows(rows, state), allowMissingColumns=True)
    rows = in_chunks(rows, ["__tenant", *_TIME], "bucket")
    core = rows.filter(F.col("__kind") != fold.EXEMPT).select(
        "__tenant", "__chunk", *_TIME, "__kind", "__ask", "__since", "__rate", "__capacity")
    # At most one tenant per cut, so no more rows than there are tasks.
    core = core.join(F.broadcast(_cut_through(core)), "__tenant")

    refills = _by_chunk(core, fold.fill_maps(state is not None),
                        "__tenant string, __chunk long, __upto long, __fill long")
    starts = _in_turn(refills, fold.fill_compose, fold.fill_entries, "__fill",
                      "__tenant string, __chunk long, __fill long")

    balances = _by_chunk(_led_by(core, starts), fold.balance_maps,
                         "__tenant string, __chunk long, __fill long, __upto long, "
                         "__balance long, __slope long")
    starts = _in_turn(balances, fold.balance_compose, fold.balance_entries, "__balance",
                      "__tenant string, __chunk long, __fill long, __balance long")

    more = ["remaining"] if fill is None else ["remaining", fill]
    out = T.StructType(
        [T.StructField(f.name, f.dataType) for f in asks.schema] + [T.StructField("allowed", T.BooleanType())]
        + [T.StructField(name, T.LongType()) for name in more]
    )
    return _by_chunk(_led_by(rows, starts), fold.decide(keep, fill), out)


def _set_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """A row in front of each tenant's own that says what it starts from."""
    asking = rows.filter(F.col("__kind") != fold.EXEMPT).groupBy("__tenant").agg(
        F.first("__rate").alias("__rate"), F.first("__capacity").alias("__capacity"))
    known = state.select(
        F.col("tenant").alias("__tenant"), F.col("fill").alias("__since"), F.col("balance").alias("__ask"))
    return asking.join(known, "__tenant").select(
        "*", F.lit(fold.NEVER + 1).alias("__us"), F.lit(fold.SET).alias("__kind"))


def last_state(
    decided: DataFrame, *, tenant: str = "tenant", ts: str = "ts", order: str = "request_id", fill: str = "fill",
) -> DataFrame:
    """(tenant, fill, balance) after the rows of a bucket that was asked for `fill`."""
    last = decided.filter(F.col(fill).isNotNull()).groupBy(F.coalesce(tenant, F.lit("")).alias("tenant")).agg(
        F.max_by(F.struct(F.col(fill).alias("fill"), F.col("remaining").alias("balance")), F.struct(ts, order)).alias("last"))
    return last.select("tenant", "last.fill", "last.balance")


def _by_chunk(rows: DataFrame, function, schema) -> DataFrame:
    """One task per chunk, its rows in order, in batches that never hold a whole chunk."""
    placed = rows.repartitionById(task_count(rows.sparkSession), F.col("__chunk").cast("int"))
    return placed.sortWithinPartitions("__chunk", "__tenant", *_TIME).mapInArrow(function, schema)


def _cut_through(core: DataFrame) -> DataFrame:
    """The tenants with rows in several chunks: each is the first or last of those chunks."""
    ends = core.groupBy("__chunk").agg(F.min("__tenant").alias("low"), F.max("__tenant").alias("high"))
    ends = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("__tenant"))
    return cut_lineage(ends.groupBy("__tenant").count().filter("count > 1").select("__tenant"), "bucket-cuts")


def _in_turn(pieces: DataFrame, compose, entries, state: str, schema: str, fan: int = FAN) -> DataFrame:
    """Apply the chunks' functions per tenant in order: what each chunk starts from."""
    levels, width = [pieces], task_count(pieces.sparkSession)
    if width > fan:
        levels = [cut_lineage(pieces, "bucket-functions")]
    while width > fan:
        grouped = _grouped(levels[-1], F.floor(F.col("__chunk") / fan))
        levels.append(cut_lineage(grouped.mapInArrow(compose, pieces.schema), "bucket-functions"))
        width = -(-width // fan)
    starts = _grouped(levels.pop(), F.lit(0)).mapInArrow(entries, schema)
    for level in reversed(levels):
        zeros = {f.name: F.lit(0).cast("long") for f in pieces.schema if f.name not in ("__tenant", "__chunk", state)}
        lead = starts.select("__tenant", F.col("__chunk").alias("__group"), state).withColumns(
            {"__chunk": F.lit(fold.LEAD).cast("long"), **zeros})
        led = level.withColumn("__group", F.floor(F.col("__chunk") / fan)).unionByName(lead)
        starts = _grouped(led, F.col("__group")).mapInArrow(entries, schema)
    return starts


def _grouped(pieces: DataFrame, group: Column) -> DataFrame:
    """The pieces of each group of a tenant's chunks in order, a group in one task."""
    placed = pieces.withColumn("__group", group.cast("long")).repartition("__tenant", "__group")
    return placed.sortWithinPartitions("__tenant", "__group", "__chunk", "__upto")


def _led_by(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Put each chunk's starting state in front of its rows; the Python side wants no
    nulls in the columns of either."""
    state = [c for c in ("__fill", "__balance") if c in starts.columns]
    entries = starts.withColumns(
        {"__us": F.lit(fold.NEVER), "__kind": F.lit(fold.ENTRY),
         **{c: F.lit(0).cast("long") for c in ("__ask", "__since", "__rate", "__capacity")}})
    return rows.withColumns({c: F.lit(0).cast("long") for c in state}).unionByName(
        entries, allowMissingColumns=True)


def bucket_remaining(
    decided: DataFrame, tenants: DataFrame, capacity: int,
    *, tenant: str = "tenant", ts: str = "ts", order: str = "request_id",
) -> DataFrame:
    """Tokens left per tenant, without a refill; the full capacity where none has asked."""
    last = decided.filter("remaining IS NOT NULL").groupBy(tenant).agg(
        F.max_by("remaining", F.struct(ts, order)).alias("remaining"))
    return tenants.select(tenant).distinct().join(last, tenant, "left").select(
        tenant, F.coalesce("remaining", F.lit(capacity).cast("long")).alias("remaining"))


def rate_limit_gate(requests: DataFrame, policy, *, checked: Column | None = None, **columns) -> DataFrame:
    """The bucket as a policy sets it up: the first entry's rate for every tenant, twice
    that as capacity. Rows without a tenant, or where `checked` is false, are exempt."""
    named = F.coalesce(F.col(columns.get("tenant", "tenant")), F.lit("")) != ""
    subject = named if checked is None else named & checked
    if policy.bucket_rate is None:
        return requests.withColumn("allowed", F.lit(True)).withColumn(
            "remaining", F.lit(None).cast("long"))
    return token_bucket(requests, policy.bucket_rate, policy.bucket_capacity,
                        exempt=~subject, **columns)
