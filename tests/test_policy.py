import dataclasses
import re

import pytest

from promptgov import Policy, load_policy
from promptgov.sources.policy import Budget, RateLimit, RoutingRule

FULL = """
rateLimits:
  - {tenant: kitchen, tokens_per_minute: 1700, requests_per_minute: 40}
routing:
  rules:
    - {if: prompt_tokens < 700, model: brief}
security: {blocked_patterns: [open the vault, erase disk], max_prompt_tokens: 900,
           prompt_injection_protection: yes, guardrails_fail_closed: yes}
budgets:
  - {tenant: kitchen, monthly_limit_usd: 1250, alert_at_percent: 65}
  - {tenant: cellar, monthly_limit_usd: 410.5}
"""


def test_load_yaml_and_json(spark, tmp_path):
    (tmp_path / "policy.yaml").write_text(FULL)
    policy = load_policy(spark, str(tmp_path / "policy.yaml"))
    assert policy == Policy(
        budgets=(Budget("kitchen", 1250.0, 65), Budget("cellar", 410.5, 0)),
        rate_limits=(RateLimit("kitchen", 1700, 40),),
        routing_rules=(RoutingRule("prompt_tokens < 700", "brief"),),
        prompt_injection_protection=True, blocked_patterns=("open the vault", "erase disk"),
        max_prompt_tokens=900, guardrails_fail_closed=True)
    assert (policy.bucket_rate, policy.bucket_capacity) == (1700, 3400)
    (tmp_path / "policy.json").write_text('{"security": {"pii_redaction": true}}')
    assert load_policy(spark, str(tmp_path / "policy.json")) == Policy(pii_redaction=True)
    tables = policy.tables(spark)
    assert [tuple(r) for r in tables["budgets"].collect()] == [
        (0, "kitchen", 1250.0, 65), (1, "cellar", 410.5, 0)]
    assert tables["security"].first().blocked_patterns == ["open the vault", "erase disk"]
    assert [tuple(r) for r in tables["routing_rules"].collect()] == [(0, "prompt_tokens < 700", "brief")]


@pytest.mark.parametrize("change, message", [
    ({}, None),
    ({"budgets": (Budget("", 7.5),)}, "tenant name is required in budget"),
    ({"budgets": (Budget('te"st', 0),)}, 'monthly_limit_usd must be positive for tenant "te\\"st"'),
    ({"budgets": (Budget("attic", -0.5),)}, 'monthly_limit_usd must be positive for tenant "attic"'),
    ({"budgets": (Budget("attic", 3, 101),)}, 'alert_at_percent must be 0-100 for tenant "attic"'),
    ({"budgets": (Budget("attic", 3, 100), Budget("b", 1, -1))}, 'alert_at_percent must be 0-100 for tenant "b"'),
    ({"rate_limits": (RateLimit("", 0),)}, "tokens_per_minute must be positive"),
    ({"rate_limits": (RateLimit("attic", 1, 0),)}, None),
    ({"max_prompt_tokens": -1}, "max_prompt_tokens must be non-negative"),
    ({"max_prompt_tokens": -1, "rate_limits": (RateLimit("", 0),), "budgets": (Budget("x", 0),)},
     'monthly_limit_usd must be positive for tenant "x"'),
])
def test_validate(spark, change, message):
    assert dataclasses.replace(Policy(), **change).error(spark) == message


def test_bad_file(spark, tmp_path):
    (tmp_path / "bad.yaml").write_text("rateLimits: [{tokens_per_minute: 0}]")
    with pytest.raises(ValueError, match="tokens_per_minute must be positive"):
        load_policy(spark, str(tmp_path / "bad.yaml"))


@pytest.mark.parametrize("doc, field", [
    ({"security": {"pii_redaction": "false"}}, "security.pii_redaction"),
    ({"security": {"max_prompt_tokens": 12.9}}, "security.max_prompt_tokens"),
    ({"security": {"max_prompt_tokens": True}}, "security.max_prompt_tokens"),
    ({"security": {"blocked_patterns": "one"}}, "security.blocked_patterns"),
    ({"security": {"blocked_patterns": ["one", 2]}}, "security.blocked_patterns[1]"),
    ({"rateLimits": [{"tokens_per_minute": "50"}]}, "rateLimits[0].tokens_per_minute"),
    ({"budgets": [{"tenant": 5}]}, "budgets[0].tenant"),
    ({"budgets": ["x"]}, "budgets[0]"),
    ({"routing": []}, "routing"),
    ([1], "policy"),
])
def test_wrong_types_are_refused(doc, field):
    with pytest.raises(ValueError, match=re.escape(f"{field} must be")):
        Policy.from_dict(doc)


def test_null_members_are_defaults():
    doc = {"security": None, "budgets": [None, {"tenant": None, "monthly_limit_usd": 3}], "rateLimits": None}
    assert Policy.from_dict(doc) == Policy(budgets=(Budget(), Budget("", 3.0, 0)))
    assert Policy.from_dict({"security": {"max_prompt_tokens": 9.0}}) == Policy(max_prompt_tokens=9)


def test_error_names_the_file(spark, tmp_path):
    (tmp_path / "odd.json").write_text('{"security": {"pii_redaction": "no"}}')
    with pytest.raises(ValueError, match=r"odd\.json: security\.pii_redaction must be"):
        load_policy(spark, str(tmp_path / "odd.json"))
