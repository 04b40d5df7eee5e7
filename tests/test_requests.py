import json

import pytest
from pyspark.sql import functions as F

from promptgov.sources.requests import MAX_BODY_BYTES, parse_requests, requests_from_turns

CHAT = '{"model":"m","messages":[{"role":"user","content":"a"},{"role":"system","content":"s"},{"role":"user","content":"b"}]}'


def parse(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    return [(r.valid, r.model, r.prompt) for r in parse_requests(df).orderBy("i").collect()]


@pytest.mark.parametrize("body, model, prompt", [
    (CHAT, "m", "a\nb\n"),
    (" \n{} ", "", ""),
    ("null", "", ""),
    ('{"model":null,"messages":null}', "", ""),
    ('{"messages":[null,{},{"role":"user"},{"role":"User","content":"x"}]}', "", "\n"),
    ('{"Model":"q","MESSAGES":[{"Role":"user","CONTENT":"zz"}]}', "q", "zz\n"),
    ('{"me\\u017f\\u017fage\\u017f":[{"role":"user","content":"long s"}]}', "", "long s\n"),
    ('{"model":"a","model":"b","messages":[{"role":"user","content":"x","content":"y"}]}', "b", "y\n"),
    ('{"model":"\\u0041\\u00e9","other":[1,{"a":[]}],"n":1e400}', "Aé", ""),
])
def test_accepted(spark, body, model, prompt):
    assert parse(spark, body) == [(True, model, prompt)]


@pytest.mark.parametrize("body", [
    None, "", "not json", "[]", '"text"', "12", "true", "{} x", "{}]", "{},{}", "{}{}", "{'model':'x'}",
    '{"model":5}', '{"model":["m"]}', '{"model":NaN}', '{"model":"a\tb"}', "﻿{}", '{"a":01}', '{"a":1',
    '{"messages":{"role":"user"}}', '{"messages":"x"}', '{"messages":["user"]}', '{"messages":[[]]}',
    '{"messages":[{"role":1}]}', '{"messages":[{"role":"user","content":["x"]}]}',
    '{"messages":[{"role":"user","content":{"text":"x"}}]}',
])
def test_refused(spark, body):
    assert parse(spark, body) == [(False, None, None)]


def test_long_body_is_parsed_whole(spark):
    df = spark.range(1).select(
        F.concat(F.lit('{"model":"'), F.repeat(F.lit("x"), MAX_BODY_BYTES), F.lit('"}')).alias("body"))
    found = parse_requests(df).select("valid", F.length("model").alias("n")).first()
    assert (found.valid, found.n) == (True, MAX_BODY_BYTES)


def test_long_conversation_gives_its_whole_prompt(spark):
    turns = spark.range(11).select(
        F.lit(1).alias("conv"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.repeat(F.lit("y"), 1 << 20).alias("text"))
    found = parse_requests(requests_from_turns(turns, "conv", "turn")).select("valid", F.length("prompt").alias("n"))
    assert tuple(found.first()) == (True, 11 * ((1 << 20) + 1))


def test_turns(spark):
    turns = spark.createDataFrame(
        [(1, 2, "user", "c"), (1, 0, "user", "a \"q\""), (1, 1, "assistant", "b"), (2, 0, "user", "x" * 50),
         (2, 1, "user", "y" * 60), (3, 0, "system", None)],
        "conv int, turn int, role string, text string")
    made = {r.conv: r for r in requests_from_turns(turns, "conv", "turn", model="m", max_body_bytes=100).collect()}
    assert json.loads(made[1].body)["messages"][0] == {"role": "user", "content": 'a "q"'}
    assert (made[2].body, made[2].body_bytes) == (None, 110)
    df = requests_from_turns(turns, "conv", "turn", model="m", max_body_bytes=100)
    got = {r.conv: (r.valid, r.model, r.prompt) for r in parse_requests(df).collect()}
    assert got == {1: (True, "m", 'a "q"\nc\n'), 2: (False, None, None), 3: (True, "m", "")}
