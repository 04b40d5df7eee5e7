"""What has to hold of plans and of the spread of work, whatever the data."""

import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from promptgov.functions import checks
from promptgov.operators.gate import Gate
from promptgov.plans import queries, workloads as W
from promptgov.plans.lineage import in_chunks

PYTHON = re.compile("Python|InArrow|InPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


STREAMS = {n for n in queries.queries() if n.startswith("stream_")} | {"audit_fanout"}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - STREAMS))
def test_no_cross_join_and_narrow_scans(spark, name):
    text = plan(queries.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", text):
        assert "lang" not in schema and "n_chars" not in schema and "url" not in schema


@pytest.mark.parametrize("name", [
    "normalize_input", "check_prompt", "redact_pii", "contains_pii", "scan_output", "sanitize_output",
    "mask_secrets", "parse_requests", "norm_nfc", "count_words"])
def test_text_work_stays_in_the_jvm(spark, name):
    assert not PYTHON.search(plan(queries.queries()[name](spark, DATA)))


def test_checks_need_no_shuffle(spark):
    requests = W.requests_from(W.read(spark, DATA, "documents"))
    assert "Exchange" not in plan(Gate(W.POLICY).score(requests))


def test_filter_on_violations_is_not_a_second_check(spark):
    prompts = W.prompts_from(W.read(spark, DATA, "documents"))
    text = plan(checks.check(prompts, W.POLICY).filter(F.size("violations") > 0))
    assert text.count("disregard[") == 2  # once in the match, once in the offset


def test_text_is_not_shuffled_by_the_bucket(spark):
    decided = Gate(W.POLICY).decide(W.requests_from(W.read(spark, DATA, "documents")))
    for line in plan(decided).splitlines():
        if "Exchange" in line:
            assert "prompt" not in line and "body" not in line


def test_lengths_are_shuffled_once(spark):
    """Rows move once for the running sums; the chunk totals are summed before they move."""
    from promptgov.operators.anomaly import prompt_anomaly

    text = plan(prompt_anomaly(W.prompts_from(W.read(spark, DATA, "documents")), 5))
    assert text.count("RoundRobin") + text.count("rangepartitioning") == 0
    scans = text.split("FileScan")
    assert len(scans) == 3 and text.count("partial_sum") == 2


def test_chunks_cut_through_a_hot_instant(spark):
    ts = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("tenant"),
        F.lit(ts).alias("ts"), "id")
    sizes = [r["count"] for r in in_chunks(df, ["tenant", "ts", "id"], "test").groupBy("__chunk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 40_000 / 4
