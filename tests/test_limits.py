"""Limits of a tenant's own, budgets, routing, and what they are built from, against plain versions."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from promptgov.operators import budgets, limits, routing
from promptgov.operators.policy_rules import BUDGETS, RATE_LIMITS, ROUTING_RULES
from promptgov.operators.running import asof_join, running_totals

START = datetime(2024, 1, 31, 23, 0, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


# -- running totals and as-of joins -------------------------------------------


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaaaab"), rng.randrange(50), i, rng.randint(-3, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, i long, x long").repartition(5)
    got = running_totals(df, ["k"], ["t", "i"], {"total": F.col("x"), "n": F.lit(1)}, "test")
    assert got.columns == ["k", "t", "i", "x", "total", "n"]
    so_far, expected = {}, []
    for k, t, i, x in sorted(rows):
        total, n = so_far.get(k, (0, 0))
        so_far[k] = (total + x, n + 1)
        expected.append((k, t, i, x, *so_far[k]))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("hot", [0.2, 0.95])
def test_asof_join(spark, hot):
    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
    rows = [(i, key(), at(rng.randrange(900)) if rng.random() < 0.95 else None) for i in range(600)]
    versions = [(rng.choice(["hot", "hot", "a", "b", None]), at(rng.randrange(-50, 900)) if rng.random() < 0.95 else None,
                 rng.randrange(5), f"v{i}") for i in range(80)]
    left = spark.createDataFrame(rows, "i long, k string, ts timestamp").repartition(4)
    right = spark.createDataFrame(versions, "k string, since timestamp, n int, name string")
    got = asof_join(left, right, by="k", at="ts", since="since", take=["n", "name"])
    expected = []
    for i, k, ts in rows:
        known = [(s, n, name) for kk, s, n, name in versions if k and ts and s and kk == k and s <= ts]
        expected.append((i, *(max(known)[1:] if known else (None, None))))
    assert sorted((r.i, r.n, r.name) for r in got.collect()) == sorted(expected)
    assert asof_join(left.filter("false"), right, by="k", at="ts", since="since", take=["n"]).count() == 0
    assert {r.n for r in asof_join(left, right.filter("false"), by="k", at="ts", since="since", take=["n"]).collect()} == {None}


# -- requests per minute ------------------------------------------------------

LIMITED = [(0, "a", 10, 3), (1, "b", 5, 0), (2, None, 7, 2), (3, "a", 99, 99), (4, "", 1, 1)]


def requests(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", "", None]), at(rng.randrange(600)) if i % 20 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "request_id long, tenant string, ts timestamp").repartition(4)


def limit_of(tenant):
    return {"a": 3, "b": 0}.get(tenant or "", 2)


def test_requests_per_minute(spark):
    rows, df = requests(spark)
    table = spark.createDataFrame(LIMITED, RATE_LIMITS)
    got = {r.request_id: r for r in limits.requests_per_minute(df, table).collect()}
    seen = {}
    for i, tenant, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        minute = (tenant or "", ts.replace(second=0))
        seen[minute] = seen.get(minute, 0) + 1
        limit = limit_of(tenant)
        assert (got[i].number, got[i].requests_per_minute) == (seen[minute], limit)
        assert got[i].rpm_exceeded == (0 < limit < seen[minute])
    for i, _, ts in rows:
        if ts is None:
            assert (got[i].number, got[i].minute, got[i].rpm_exceeded) == (None, None, False)
    windows = limits.exceeded_windows(limits.request_windows(df), table).collect()
    expected = {(t, m.replace(tzinfo=None), n, limit_of(t), n - limit_of(t)) for (t, m), n in seen.items() if 0 < limit_of(t) < n}
    assert {tuple(r) for r in windows} == expected and len(windows) == len(expected) > 10


def test_unknown_tenants(spark):
    of = lambda table: {r.tenant: (r.tokens_per_minute, r.requests_per_minute) for r in limits.with_limits(
        spark.createDataFrame([("a",), ("x",)], "tenant string"), spark.createDataFrame(table, RATE_LIMITS)).collect()}
    assert of(LIMITED) == {"a": (10, 3), "x": (7, 2)}
    assert of(LIMITED[:2]) == {"a": (10, 3), "x": (10, 3)}  # the first entry is everybody's
    assert of([]) == {"a": (None, None), "x": (None, None)}


def test_own_bucket(spark):
    rows = [(0, "a", at(0), 20), (1, "a", at(1), 1), (2, "b", at(2), 11), (3, "b", at(3), 10), (4, "z", at(4), 14), (5, None, at(4), 14),
            (6, "z", at(5), 1), (7, "a", at(60), 10)]
    df = spark.createDataFrame(rows, "request_id long, tenant string, ts timestamp, tokens int")
    got = limits.own_token_bucket(df, spark.createDataFrame(LIMITED, RATE_LIMITS))
    assert got.columns == [*df.columns, "allowed", "remaining"]
    assert [(r.allowed, r.remaining) for r in got.orderBy("request_id").collect()] == [
        (True, 0), (False, 0), (False, 10), (True, 0), (True, 0), (True, 0), (False, 0), (True, 0)]
    free = limits.own_token_bucket(df, spark.createDataFrame([], RATE_LIMITS)).collect()
    assert all(r.allowed and r.remaining is None for r in free)


# -- budgets ------------------------------------------------------------------


def test_budgets(spark):
    rng = random.Random(4)
    usage = [(i, rng.choice(["hot"] * 6 + ["b", "c", "d", None]), at(rng.randrange(7200)) if i % 25 else None, rng.choice(["m", "n", "free"]),
              rng.choice([0, 1, 7, 20, None])) for i in range(800)]
    prices = [("m", at(-5), 3), ("m", at(3000), 5), ("n", at(1000), 100), ("n", at(1000), 90)]
    entries = [(0, "hot", 2e-6, 50), (1, "b", 1e-7, 0), (2, "c", -1.0, 10), (3, "hot", 9e-9, 1), (4, "d", 1e-6, 100), (5, "", 5e-7, 33)]
    spend, first, total, unpriced, n = {}, {}, {}, {}, {}
    cap = {"hot": (2000, 1000), "b": (100, None), "d": (1000, 1000)}  # the entry without a tenant is not valid
    for i, tenant, ts, model, tokens in sorted((u for u in usage if u[2]), key=lambda u: (u[2], u[0])):
        known = [(s, p) for m, s, p in prices if m == model and s <= ts]
        key = (tenant or "", ts.date().replace(day=1))
        spend[key] = spend.get(key, 0) + (max(known)[1] if known else 0) * (tokens or 0)
        n[key] = n.get(key, 0) + 1
        unpriced[key] = unpriced.get(key, 0) + (not known)
        limit, alert = cap.get(key[0], (None, None))
        if alert is not None and spend[key] >= alert:
            first.setdefault((key, "alert"), i)
        if limit is not None and spend[key] > limit:
            first.setdefault((key, "exceeded"), i)
        total[i] = spend[key]
    df = spark.createDataFrame(usage, "request_id long, tenant string, ts timestamp, model string, tokens int").repartition(4)
    of = spark.createDataFrame(entries, BUDGETS), spark.createDataFrame(prices, "model string, valid_from timestamp, nanos_per_token long")
    running = budgets.spend_by_request(df, *of).collect()
    assert {r.request_id: int(r.spend_nanos) for r in running} == total
    got = budgets.budget_status(df, *of).collect()
    assert len(got) == len(spend) and {k[1].month for k in spend} == {1, 2}
    for r in got:
        key = (r.tenant, r.month)
        limit, alert = cap.get(r.tenant, (None, None))
        state = ("no_budget" if limit is None else "exceeded" if spend[key] > limit
                 else "alert" if alert is not None and spend[key] >= alert else "ok")
        assert (int(r.spend_nanos), r.requests, r.unpriced, r.status) == (spend[key], n[key], unpriced[key], state)
        assert (r.alert_request, r.exceeded_request) == (first.get((key, "alert")), first.get((key, "exceeded")))
    assert {r.status for r in got} >= {"exceeded", "no_budget"}


def test_crossings_name_the_first_request_in_time(spark):
    usage = [(9, "a", at(1), "m", 6), (3, "a", at(2), "m", 6), (1, "a", at(3), "m", 6), (2, "a", at(3), "m", 0)]
    df = spark.createDataFrame(usage, "request_id long, tenant string, ts timestamp, model string, tokens int")
    got = budgets.budget_status(df, spark.createDataFrame([(0, "a", 12e-9, 50)], BUDGETS), spark.createDataFrame(
        [("m", at(0), 1)], "model string, valid_from timestamp, nanos_per_token long")).first()
    assert (got.alert_request, got.exceeded_request, got.status) == (9, 1, "exceeded")


# -- routing ------------------------------------------------------------------

CONDITIONS = [
    ("prompt_tokens < 2000", (0, 1999)), ("prompt_tokens >= 2000", (2000, routing.MOST)), ("  prompt_tokens<=7 ", (0, 7)),
    ("prompt_tokens > 5 and prompt_tokens < 9", (6, 8)), ("prompt_tokens > 5 && prompt_tokens == 7", (7, 7)), ("", (0, routing.MOST)),
    (None, (0, routing.MOST)), ("prompt_tokens < 0", (0, -1)), ("prompt_tokens = 3 AND prompt_tokens = 4", (4, 3))]
MALFORMED = ["prompt_tokens", "tokens < 5", "prompt_tokens < -5", "prompt_tokens < 5 or prompt_tokens > 9", "prompt_tokens < 5 and",
             "prompt_tokens < 1e3", "5 > prompt_tokens", "prompt_tokens < 99999999999999999999", "prompt_tokens << 5"]


def test_conditions(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CONDITIONS)], "i int, c string")
    got = df.select("i", routing.interval(F.col("c")).alias("v"), routing.rule_error(F.col("c")).alias("e")).orderBy("i").collect()
    assert [tuple(r.v) for r in got] == [v for _, v in CONDITIONS] and not any(r.e for r in got)
    bad = spark.createDataFrame([(c,) for c in MALFORMED], "c string").select(
        routing.interval(F.col("c")).alias("v"), routing.rule_error(F.col("c")).alias("e")).collect()
    assert all(r.v is None and r.e.startswith(routing.MSG_CONDITION) for r in bad)


def plain_route(rules, tokens):
    for ordinal, condition, model in sorted(rules):
        if condition in MALFORMED:
            continue
        test = re.sub("(?i)&&", " and ", condition or "True").replace("prompt_tokens", str(tokens)).replace(" = ", " == ").strip().lower()
        if eval(test.replace("true", "True")):  # noqa: S307
            return ordinal, model
    return None, None


def random_rules(rng, n):
    one = lambda: f"prompt_tokens {rng.choice(['<', '<=', '>', '>=', '==', '='])} {rng.randrange(60)}"
    made = [rng.choice([one(), f"{one()} and {one()}", f"{one()} && {one()} AND {one()}", rng.choice(MALFORMED)]) for _ in range(n)]
    return [(i, c, f"m{i % 7}") for i, c in enumerate(made)]


def test_routes(spark):
    rng = random.Random(5)
    for n in (1, 2, 30):
        rules = random_rules(rng, n)
        df = spark.createDataFrame([(t,) for t in range(70)], "prompt_tokens int")
        got = routing.route(df, spark.createDataFrame(rules, ROUTING_RULES)).collect()
        assert {r.prompt_tokens: (r.rule, r.model) for r in got} == {t: plain_route(rules, t) for t in range(70)}
    none = routing.route(df, spark.createDataFrame([], ROUTING_RULES)).collect()
    assert {(r.rule, r.model) for r in none} == {(None, None)}
    unknown = spark.createDataFrame([(None,)], "prompt_tokens int")
    assert routing.route(unknown, spark.createDataFrame([(0, "prompt_tokens < 1", "m")], ROUTING_RULES)).first().model == "m"


def test_routes_by_policy(spark):
    rng = random.Random(6)
    rules = {p: random_rules(rng, 12) for p in range(5)}
    table = spark.createDataFrame([(p, *r) for p, rs in rules.items() for r in rs], f"policy_id int, {ROUTING_RULES}")
    df = spark.createDataFrame([(p, t) for p in [*range(6), None] for t in range(0, 66, 5)], "policy_id int, prompt_tokens long")
    got = routing.route_by_policy(df, table).collect()
    assert len(got) == 7 * 14
    for r in got:
        assert (r.rule, r.model) == plain_route(rules.get(r.policy_id, []), r.prompt_tokens)


def test_many_rules_need_few_steps(spark):
    """The plan does not grow with the rules of a policy table."""
    rules = [(0, i, f"prompt_tokens == {i}", f"m{i}") for i in range(3000)]
    table = spark.createDataFrame(rules, f"policy_id int, {ROUTING_RULES}")
    df = spark.range(0, 3000, 7).select(F.lit(0).alias("policy_id"), F.col("id").alias("prompt_tokens"))
    got = routing.route_by_policy(df, table).collect()
    assert all(r.model == f"m{r.prompt_tokens}" for r in got)
    assert len(got) == 429
