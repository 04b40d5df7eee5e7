"""The policy file: load, check, and show as tables.

A policy is a small hand-written file, so the driver reads it; what it says is then
built into column expressions or shown as small tables for joins.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgov.operators import policy_rules as rules

log = logging.getLogger(__name__)


def _typed(value, kind: type, field: str):
    """The value if it is of the kind; the kind's empty value for None."""
    if value is None:
        return kind()
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is float and number:
        return float(value)
    if kind is int and number and float(value).is_integer():
        return int(value)
    if kind is not int and isinstance(value, kind):
        return value
    names = {dict: "a mapping", list: "a list", str: "a text", bool: "true or false", int: "a whole number", float: "a number"}
    raise ValueError(f"{field} must be {names[kind]}, not {value!r}")


def _member(row: dict, name: str, kind: type, at: str = ""):
    return _typed(row.get(name), kind, f"{at}.{name}" if at else name)


def _entries(doc: dict, name: str, at: str = "") -> list[tuple[str, dict]]:
    """The mappings of a list with the place of each."""
    path = f"{at}.{name}" if at else name
    return [(f"{path}[{i}]", _typed(row, dict, f"{path}[{i}]")) for i, row in enumerate(_member(doc, name, list, at))]


@dataclass(frozen=True)
class Budget:
    tenant: str = ""
    monthly_limit_usd: float = 0.0
    alert_at_percent: int = 0


@dataclass(frozen=True)
class RateLimit:
    tenant: str = ""
    tokens_per_minute: int = 0
    requests_per_minute: int = 0


@dataclass(frozen=True)
class RoutingRule:
    condition: str = ""
    model: str = ""


@dataclass(frozen=True)
class Policy:
    """One policy; the defaults switch every check off."""

    budgets: tuple[Budget, ...] = ()
    rate_limits: tuple[RateLimit, ...] = ()
    routing_rules: tuple[RoutingRule, ...] = ()
    prompt_injection_protection: bool = False
    pii_redaction: bool = False
    blocked_patterns: tuple[str, ...] = field(default=())
    max_prompt_tokens: int = 0
    guardrails_endpoint: str = ""
    guardrails_fail_closed: bool = False

    @property
    def bucket_rate(self) -> int | None:
        """Tokens per minute for every tenant: the first entry decides."""
        return self.rate_limits[0].tokens_per_minute if self.rate_limits else None

    @property
    def bucket_capacity(self) -> int | None:
        return None if self.bucket_rate is None else 2 * self.bucket_rate

    @classmethod
    def from_dict(cls, doc: dict | None) -> Policy:
        """A policy from parsed YAML or JSON; a value of another type raises a ValueError with its field.

        Missing and null members mean their defaults, unknown members are ignored. A whole
        number may be written as 9.0.
        """
        doc = _typed(doc, dict, "policy")
        security = _member(doc, "security", dict)
        routing = _member(doc, "routing", dict)
        whole = lambda row, name, at: _member(row, name, int, at)
        text = lambda row, name, at: _member(row, name, str, at)
        flag = lambda name: _member(security, name, bool, "security")
        patterns = _member(security, "blocked_patterns", list, "security")
        return cls(
            budgets=tuple(
                Budget(text(b, "tenant", at), _member(b, "monthly_limit_usd", float, at), whole(b, "alert_at_percent", at))
                for at, b in _entries(doc, "budgets")),
            rate_limits=tuple(
                RateLimit(text(r, "tenant", at), whole(r, "tokens_per_minute", at), whole(r, "requests_per_minute", at))
                for at, r in _entries(doc, "rateLimits")),
            routing_rules=tuple(
                RoutingRule(text(r, "if", at), text(r, "model", at)) for at, r in _entries(routing, "rules", "routing")),
            prompt_injection_protection=flag("prompt_injection_protection"),
            pii_redaction=flag("pii_redaction"),
            blocked_patterns=tuple(_typed(p, str, f"security.blocked_patterns[{i}]") for i, p in enumerate(patterns)),
            max_prompt_tokens=whole(security, "max_prompt_tokens", "security"),
            guardrails_endpoint=text(security, "guardrails_endpoint", "security"),
            guardrails_fail_closed=flag("guardrails_fail_closed"),
        )

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The policy as four small tables, with `ordinal` for the order in the file."""
        budgets = [(i, b.tenant, float(b.monthly_limit_usd), b.alert_at_percent)
                   for i, b in enumerate(self.budgets)]
        limits = [(i, r.tenant, r.tokens_per_minute, r.requests_per_minute)
                  for i, r in enumerate(self.rate_limits)]
        routes = [(i, r.condition, r.model) for i, r in enumerate(self.routing_rules)]
        security = [(
            self.prompt_injection_protection, self.pii_redaction, list(self.blocked_patterns),
            self.max_prompt_tokens, self.guardrails_endpoint, self.guardrails_fail_closed,
        )]
        return {
            "budgets": spark.createDataFrame(budgets, rules.BUDGETS),
            "rate_limits": spark.createDataFrame(limits, rules.RATE_LIMITS),
            "routing_rules": spark.createDataFrame(routes, rules.ROUTING_RULES),
            "security": spark.createDataFrame(security, rules.SECURITY),
        }

    def error(self, spark: SparkSession) -> str | None:
        """The first failing rule's message, or None for a valid policy."""
        found = rules.validate_policies(
            **{
                name: table.withColumn("policy_id", F.lit(0))
                for name, table in self.tables(spark).items()
                if name != "routing_rules"
            }
        )
        return found.first()["message"]


def parse_policy(text: str, path: str = "") -> Policy:
    """JSON when the name says so, else YAML."""
    if path.endswith(".json"):
        return Policy.from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is needed to read a YAML policy; a .json file works too") from e
    return Policy.from_dict(yaml.safe_load(text))


def load_policy(spark: SparkSession, path: str) -> Policy:
    """Read, parse and check a policy file on any file system Spark can reach."""
    text = spark.read.text(path, wholetext=True).first()
    try:
        policy = parse_policy(text["value"] if text else "", PurePosixPath(path).name)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    message = policy.error(spark)
    if message is not None:
        raise ValueError(f"{path}: {message}")
    return policy


def load_versions(spark: SparkSession, versions: DataFrame, path: str = ".json") -> list[tuple[int, Policy]]:
    """(valid_from in microseconds, policy) for each valid version, in order of time.

    versions: valid_from, text; a row per version of a hand-written file, which the driver keeps. Of versions of one
    instant the last text counts. `path` tells by its ending what the texts are. A version that is not valid is reported
    and left out, so that the one before it stays in force; the first one must be valid.
    """
    found: list[tuple[int, Policy]] = []
    rows = versions.groupBy(F.unix_micros("valid_from").alias("us")).agg(F.max("text").alias("text"))
    for row in sorted(rows.collect(), key=lambda r: r.us):
        try:
            policy = parse_policy(row.text or "", path)
            message = policy.error(spark)
        except ValueError as e:
            message = str(e)
        if message is None:
            found.append((row.us, policy))
        elif not found:
            raise ValueError(f"the first policy version is not valid: {message}")
        else:
            log.warning("policy version of %s left out: %s", row.us, message)
    return found
