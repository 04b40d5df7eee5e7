import math
import random
from datetime import datetime, timedelta, timezone

from promptgov.operators import anomaly as A

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def observe(spark, rows, min_samples=5):
    data = [(i, t, START + timedelta(seconds=i), p) for i, (t, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "request_id long, tenant string, ts timestamp, prompt string")
    return df, A.prompt_anomaly(df, min_samples).orderBy("request_id").collect()


def test_learning_period(spark):
    _, got = observe(spark, [("a", "What is the weather today?")] * 9, 10)
    assert not any(r.is_anomaly for r in got)
    assert {(r.prompt_length, r.mean_length, r.std_dev, r.score) for r in got} == {(26, 0.0, 0.0, 0.0)}


def test_spike_and_normal(spark):
    long = "This is a very long prompt that deviates significantly. " * 100
    _, got = observe(spark, [("a", "Hello")] * 20 + [("a", long), ("a", "How are")])
    assert got[20].is_anomaly and got[20].score >= 3 and got[20].reason == A.MSG_SPIKE
    assert not got[21].is_anomaly and got[21].reason == ""


def test_longer_and_shorter(spark):
    _, got = observe(spark, [("a", "x" * 100)] * 20 + [("a", "x" * 140)])
    assert got[20].is_anomaly and got[20].reason == A.MSG_LONGER
    _, got = observe(spark, [("a", "x" * 100)] * 20 + [("a", "x" * 60)])
    assert got[20].is_anomaly and got[20].reason == A.MSG_SHORTER


def test_tenants_apart(spark):
    long = "Long prompt content here. " * 20
    _, got = observe(spark, [("a", "Hi")] * 20 + [("b", long)] * 20 + [("a", long), ("b", long)])
    assert got[40].is_anomaly and not got[41].is_anomaly


def test_random_against_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), "é" * rng.choice([3, 10, 11, 400, 2000])) for _ in range(800)]
    _, got = observe(spark, rows)
    sums = {}
    for (tenant, prompt), r in zip(rows, got):
        length = len(prompt.encode())
        n, total, squares = (x + y for x, y in zip(sums.get(tenant, (0, 0, 0)), (1, length, length * length)))
        sums[tenant] = n, total, squares
        if n < 5:
            assert (r.is_anomaly, r.score) == (False, 0.0)
            continue
        mean = total / n
        dev = max(1.0, math.sqrt(abs(squares / n - mean * mean)))
        z = abs(length - mean) / dev
        spike = n > 5 and length > mean * 10 and length > 500
        assert r.is_anomaly == (z > 3 or spike)
        assert math.isclose(r.score, math.floor(z * 100 + 0.5) / 100, abs_tol=1e-9)
        assert r.mean_length == math.floor(mean + 0.5)


def test_profiles(spark):
    df, _ = observe(spark, [("a", "Hello world")] * 10 + [("b", "x"), ("b", "xxx")])
    tenants = spark.createDataFrame([("a",), ("b",), ("unknown",)], "tenant string")
    got = {r.tenant: (r["count"], r.mean_length, r.std_dev)
           for r in A.profiles_of(tenants, A.tenant_profile(df)).collect()}
    assert got == {"a": (10, 11.0, 0.0), "b": (2, 2.0, 1.0), "unknown": (0, 0.0, 0.0)}


def test_huge_lengths_do_not_overflow(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(10_000_000,)] * 3, "n long").select(A._square(F.col("n")).alias("s"))
    assert int(rows.agg(F.sum("s") * 1_000_000).first()[0]) == 3 * 10**20
