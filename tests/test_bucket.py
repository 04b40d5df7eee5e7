import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from promptgov.operators import bucket_fold as fold
from promptgov.operators.ratelimit import bucket_remaining, rate_limit_gate, token_bucket
from promptgov.sources.policy import Policy, RateLimit

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "tenant string, ts timestamp, request_id long, tokens int, reset boolean"


def asks(spark, rows):
    """(tenant, seconds, tokens) or (tenant, seconds, 'reset'), in order of arrival."""
    data = [
        (t, START + timedelta(seconds=s), i, 0 if a == "reset" else a, a == "reset")
        for i, (t, s, a) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def run(spark, rows, rate, capacity):
    out = token_bucket(asks(spark, rows), rate, capacity, reset=F.col("reset"))
    return [(r.allowed, r.remaining) for r in out.orderBy("request_id").collect()]


def one_by_one(rows, rate, capacity, start=(), limits=None):
    """The same in plain Python: one bucket per tenant, one row at a time.

    `start` has (tokens, seconds of the last refill) per tenant, `limits` (rate, capacity).
    """
    state, out = dict(start), {}
    for i, (tenant, seconds, ask) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        if limits:
            rate, capacity = limits[tenant]
        if ask == "reset":
            state.pop(tenant, None)
            out[i] = (None, capacity)
            continue
        tokens, filled = state.get(tenant, (capacity, seconds))
        minutes = int((seconds - filled) // 60)
        if minutes > 0:
            tokens, filled = min(capacity, tokens + minutes * rate), seconds
        allowed = ask <= tokens
        tokens -= ask if allowed else 0
        state[tenant], out[i] = (tokens, filled), (allowed, tokens)
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("rate, capacity, rows, want", [
    (1000, 5000, [("a", 0, 100), ("a", 1, 100)], [True, True]),
    (1000, 500, [("a", 0, 400), ("a", 1, 200)], [True, False]),
    (1000, 500, [("a", 0, 450), ("b", 1, 500), ("a", 2, 100)], [True, True, False]),
    (1000, 1000, [("a", 0, 900), ("a", 1, "reset"), ("a", 2, 1000)], [True, None, True]),
    (1000, 500, [("a", 0, 500), ("a", 1, 1), ("a", 2, 0)], [True, False, True]),
    # A refill needs a whole minute, and loses the fraction.
    (10, 20, [("a", 0, 20), ("a", 59, 1), ("a", 60, 10), ("a", 60, 1)], [True, False, True, False]),
    (10, 20, [("a", 0, 20), ("a", 119, 10), ("a", 120, 1), ("a", 178, 1), ("a", 179, 1)],
     [True, True, False, False, True]),
])
def test_cases(spark, rate, capacity, rows, want):
    assert [a for a, _ in run(spark, rows, rate, capacity)] == want


def test_random_histories(spark):
    rng = random.Random(11)
    for rate, capacity, span, most in [(1, 120, 7200, 100), (10, 20, 900, 12), (50, 100, 600, 30), (7, 7, 4000, 9)]:
        rows = [
            (rng.choice("aaaab"), rng.randrange(span * 4) / 4,
             "reset" if rng.random() < 0.01 else rng.randint(0, most))
            for _ in range(1500)
        ]
        assert run(spark, rows, rate, capacity) == one_by_one(rows, rate, capacity)


def test_one_hot_instant(spark):
    """One tenant and one instant hold most rows: chunks cut through both."""
    rng = random.Random(5)
    rows = [("hot", 60.0, rng.randint(0, 5)) for _ in range(3000)]
    rows += [(rng.choice("bc"), rng.randrange(3000), rng.randint(0, 60)) for _ in range(500)]
    df = token_bucket(asks(spark, rows), 50, 4000, reset=F.col("reset"))
    got = [(r.allowed, r.remaining) for r in df.orderBy("request_id").collect()]
    assert got == one_by_one(rows, 50, 4000)


def chunked(rows, size, rate, capacity, fan=3, start=(), limits=None):
    """All five steps on Arrow batches, with chunks of `size` rows, `fan` functions at a time."""
    import pyarrow as pa

    def in_turn(pieces, columns, compose, entries, state):
        def grouped(rows):
            named = [dict(zip(["__group", *columns], r)) for r in rows]
            named.sort(key=lambda r: (r["__tenant"], r["__group"], r["__chunk"], r["__upto"]))
            return [pa.RecordBatch.from_pylist(named)]

        levels = [pieces]
        while max(p[1] for p in levels[-1]) >= fan:
            levels.append(tuples(compose(grouped((p[1] // fan, *p) for p in levels[-1]))))
        starts = tuples(entries(grouped((0, *p) for p in levels.pop())))
        for level in reversed(levels):
            lead = [(s[1], s[0], fold.LEAD, *[0] * (state - 2), s[-1], *[0] * (len(columns) - state - 1)) for s in starts]
            starts = tuples(entries(grouped([(p[1] // fan, *p) for p in level] + lead)))
        return starts

    def batch(data, names):
        return [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*data)))))] if data else []

    def tuples(batches):
        return [tuple(r.values()) for b in batches for r in b.to_pylist()]

    ordered = sorted((t, int(s * 1e6), i, a) for i, (t, s, a) in enumerate(rows))
    of = limits or {t: (rate, capacity) for t, *_ in rows}
    asked = [(t, us, i, fold.RESET if a == "reset" else fold.ASK, 0 if a == "reset" else a, 0) for t, us, i, a in ordered]
    begun = [(t, fold.NEVER + 1, -1, fold.SET, left, int(since * 1e6)) for t, (left, since) in dict(start).items() if t in of]
    core = [(t, n // size, *row, *of[t]) for n, (t, *row) in enumerate(sorted(asked + begun))]
    names = ["__tenant", "__chunk", "__us", "__order", "__kind", "__ask", "__since", "__rate", "__capacity", "__fill", "__balance"]
    pieces = tuples(fold.fill_maps(bool(start))(batch(core, names[:9])))
    columns = ["__tenant", "__chunk", "__upto", "__fill"]
    fills = in_turn(pieces, columns, fold.fill_compose, fold.fill_entries, 3)
    led = sorted([r + (0,) for r in core] + [(t, c, fold.NEVER, -1, fold.ENTRY, 0, 0, 0, 0, f) for t, c, f in fills])
    pieces = tuples(fold.balance_maps(batch(led, names[:10])))
    columns = ["__tenant", "__chunk", "__fill", "__upto", "__balance", "__slope"]
    entries = in_turn(pieces, columns, fold.balance_compose, fold.balance_entries, 4)
    led = sorted([r + (0, 0) for r in core] + [(t, c, fold.NEVER, -1, fold.ENTRY, 0, 0, 0, 0, f, b) for t, c, f, b in entries])
    done = tuples(fold.decide(["__order"], None)(batch(led, names)))
    return [(a, r) for _, a, r in sorted(done)]


def test_steps_with_chunks_of_any_size():
    rng = random.Random(2)
    for _ in range(400):
        rate = rng.choice([1, 3, 10, 50])
        capacity = rng.choice([rate * 2, rate, rate * 5, 120, 0, 7])
        span, grain = rng.choice([100, 600, 7200]), rng.choice([1, 4, 1_000_000])
        most = rng.choice([2, capacity + 2, rate * 2 + 3])
        rows = [
            (rng.choice("ab"), rng.randrange(span * grain) / grain,
             "reset" if rng.random() < 0.02 else rng.randint(0, most))
            for _ in range(rng.randint(1, 120))
        ]
        assert chunked(rows, rng.choice([1, 2, 7, 40]), rate, capacity) == one_by_one(rows, rate, capacity)


def test_steps_with_limits_and_states_of_their_own():
    """Tenants start from a balance, and from a refill that may be later than their first rows."""
    rng = random.Random(12)
    for _ in range(400):
        limits = {t: (rng.choice([1, 3, 10, 50]), rng.choice([5, 20, 120])) for t in "abc"}
        span = rng.choice([100, 600, 7200])
        rows = [(rng.choice("aaabc"), rng.randrange(span), "reset" if rng.random() < 0.02 else rng.randint(0, 30))
                for _ in range(rng.randint(1, 120))]
        start = {t: (rng.randint(0, limits[t][1]), rng.randrange(-300, span)) for t in "ab" if any(r[0] == t for r in rows)}
        got = chunked(rows, rng.choice([1, 2, 7, 40]), 0, 0, start=start, limits=limits)
        assert got == one_by_one(rows, 0, 0, start, limits)


def test_limits_by_column(spark):
    rng = random.Random(13)
    limits = {"a": (5, 60), "b": (50, 100), "c": (1, 3)}
    rows = [(rng.choice("aaaaabc"), rng.randrange(4000), rng.randint(0, 40)) for _ in range(900)]
    of = spark.createDataFrame([(t, *x) for t, x in limits.items()] + [("d", None, None)], "tenant string, rate int, capacity int")
    some = asks(spark, rows + [("d", 5, 9), ("e", 6, 9)]).join(of, "tenant", "left")
    got = token_bucket(some, F.col("rate"), F.col("capacity")).orderBy("request_id").collect()
    assert [(r.allowed, r.remaining) for r in got[:900]] == one_by_one(rows, 0, 0, limits=limits)
    assert [(r.allowed, r.remaining) for r in got[900:]] == [(True, None)] * 2


def test_a_history_in_parts(spark):
    """State carried from part to part gives what one run gives; rows of a part may be late."""
    from promptgov.operators.ratelimit import last_state

    rng = random.Random(14)
    rows = sorted(((rng.choice("aaab"), rng.randrange(3000), rng.randint(0, 60)) for _ in range(600)), key=lambda r: r[1])
    state, got = spark.createDataFrame([], "tenant string, fill long, balance long"), []
    for part in range(3):
        some = asks(spark, rows).filter((F.col("request_id") >= 200 * part) & (F.col("request_id") < 200 * part + 200))
        decided = token_bucket(some, 20, 150, state=state, fill="fill").collect()
        got += [(r.request_id, r.allowed, r.remaining) for r in decided]
        done = spark.createDataFrame(decided, "tenant string, ts timestamp, request_id long, tokens int, reset boolean, "
                                     "allowed boolean, remaining long, fill long")
        last = last_state(done)
        state = last.unionByName(state.join(last, "tenant", "left_anti"))
    assert [(a, r) for _, a, r in sorted(got)] == one_by_one(rows, 20, 150)


def test_remaining(spark):
    decided = token_bucket(asks(spark, [("a", 0, 300), ("b", 0, 1), ("b", 5, "reset"), ("c", 0, 2000)]),
                           1000, 1000, reset=F.col("reset"))
    tenants = spark.createDataFrame([("a",), ("b",), ("c",), ("new",)], "tenant string")
    got = {r.tenant: r.remaining for r in bucket_remaining(decided, tenants, 1000).collect()}
    assert got == {"a": 700, "b": 1000, "c": 1000, "new": 1000}


def test_policy_wiring(spark):
    policy = Policy(rate_limits=(RateLimit("x", 100, 0), RateLimit("b", 1, 0)))
    rows = [("a", 0, 200), ("b", 0, 200), ("a", 1, 1), ("", 1, 999), (None, 1, 999)]
    got = rate_limit_gate(asks(spark, rows), policy).orderBy("request_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True]
    assert [r.tenant for r in got] == ["a", "b", "a", "", None]
    free = rate_limit_gate(asks(spark, rows), Policy()).collect()
    assert all(r.allowed and r.remaining is None for r in free)


def test_bad_settings(spark):
    with pytest.raises(ValueError):
        token_bucket(asks(spark, [("a", 0, 1)]), 0, 10)


def test_rows_without_a_time_are_exempt(spark):
    rows = asks(spark, [("a", 0, 60), ("a", 1, 60), ("a", 2, 60), ("b", 3, 10)])
    untimed = F.col("request_id").isin(1, 3)
    rows = rows.withColumn("ts", F.when(~untimed, F.col("ts")))
    out = token_bucket(rows, 10, 100).orderBy("request_id").collect()
    assert [(r.allowed, r.remaining) for r in out] == [(True, 40), (True, None), (False, 40), (True, None)]


def test_work_does_not_grow_with_the_capacity():
    """500 asks of up to a twentieth of the rate: images stay few, pieces far below the capacity."""
    for rate in (1_500, 50_000, 1_000_000, 100_000_000):
        rng = random.Random(1)
        chunk = fold._BalanceChunk(0, rate, 2 * rate)
        for i in range(500):
            chunk.ask(2_500 * i, rng.randint(1, rate // 20))
        assert len(chunk.lows) < 1_000 and len(chunk.pieces()) < 25_000


def test_large_capacities():
    """A hot tenant with asks at the rates of large policies, chunks shorter than a minute."""
    rng = random.Random(4)
    for rate in (50_000, 1_000_000):
        rows = [("hot", i / 400, rng.randint(1, rate // 20)) for i in range(2_500)]
        assert chunked(rows, 500, rate, 2 * rate) == one_by_one(rows, rate, 2 * rate)


def test_many_levels_on_spark(spark, monkeypatch):
    from promptgov.operators import ratelimit

    in_turn = ratelimit._in_turn
    monkeypatch.setattr(ratelimit, "_in_turn", lambda *a: in_turn(*a, fan=2))
    rng = random.Random(9)
    rows = [(rng.choice("hhhhhab"), rng.randrange(8000) / 4, rng.randint(0, 90)) for _ in range(1500)]
    assert run(spark, rows, 50, 400) == one_by_one(rows, 50, 400)


def test_only_tenants_on_a_cut_are_composed(spark):
    from promptgov.operators.ratelimit import _cut_through

    rows = [(0, "a"), (0, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "d"), (3, "d"), (4, "e"), (4, "f"), (4, "g")]
    core = spark.createDataFrame(rows, "__chunk long, __tenant string")
    assert [r[0] for r in _cut_through(core).collect()] == ["b"]
