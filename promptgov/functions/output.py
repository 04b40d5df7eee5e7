"""Checks and clean-up of model responses, and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.functions import patterns as P
from promptgov.functions.matching import (
    any_true,
    hit,
    needles_in,
    pinned,
    present,
    violation,
    with_needles,
)
from promptgov.functions.pii import contains_pii, redact_pii
from promptgov.functions.text import as_text


def _flat(groups) -> tuple[str, ...]:
    return tuple(sorted({n for group in groups for n in group}))


def leaks_prompt(s: Column, has) -> Column:
    return hit(s, has, P.any_of(P.LEAKAGE_PATTERNS), _flat(P.LEAKAGE_NEEDLES))


def dangerous_hits(s: Column, has) -> dict[str, Column]:
    return {
        rule: hit(s, has, P.java_test(pattern), needles)
        for (rule, pattern), needles in zip(P.DANGEROUS_PATTERNS, P.DANGEROUS_NEEDLES)
    }


def output_violations(s: Column, has) -> Column:
    """Rule order: PII, leakage, then the dangerous content rules as listed."""
    candidates = [
        F.when(contains_pii(s), violation("output_pii", "critical", P.MSG_OUTPUT_PII)),
        F.when(leaks_prompt(s, has), violation("prompt_leakage", "warning", P.MSG_LEAKAGE)),
    ]
    for rule, found in dangerous_hits(s, has).items():
        candidates.append(F.when(found, violation(rule, "warning", P.MSG_DANGEROUS + rule)))
    return present(candidates)


def _staged(df: DataFrame, text: str):
    staged = df.withColumn("__raw", as_text(F.col(text)))
    return with_needles(staged, "__raw", _flat(P.LEAKAGE_NEEDLES) + _flat(P.DANGEROUS_NEEDLES))


def scan(df: DataFrame, text: str = "output", into: str = "violations") -> DataFrame:
    """Add the violations of a response, which is checked as it is; map-only."""
    kept = [c for c in df.columns if c != into]
    staged, has = _staged(df, text)
    return pinned(staged, kept, output_violations(F.col("__raw"), has), into)


def output_clean(df: DataFrame, text: str = "output", into: str = "is_clean") -> DataFrame:
    """Add whether a response has no violation; map-only."""
    kept = [c for c in df.columns if c != into]
    staged, has = _staged(df, text)
    raw = F.col("__raw")
    dirty = any_true([contains_pii(raw), leaks_prompt(raw, has), *dangerous_hits(raw, has).values()])
    return pinned(staged, kept, ~dirty, into)


def _scripts(s: Column) -> Column:
    closed, rest = (F.regexp_extract(s, P.SCRIPT_PARTS, group) for group in (1, 2))
    return F.concat(F.regexp_replace(closed, P.SCRIPT_FINDER, "$1" + P.SCRIPT_BLOCK[1]), rest)


def _has_scripts(s: Column) -> Column:
    return s.contains("</") & s.rlike("(?iu)</script>")


def _handlers(s: Column) -> Column:
    return F.regexp_replace(s, P.HANDLER_FINDER, P.EVENT_HANDLER[1])


def remove_scripts(s: Column) -> Column:
    return F.when(_has_scripts(s), _scripts(s)).otherwise(s)


def remove_handlers(s: Column) -> Column:
    return F.when(s.contains("="), _handlers(s)).otherwise(s)


def sanitize_output(s: Column) -> Column:
    """Redact, then remove scripts, then event handlers.

    The tests look at the input only: no step adds what they look for.
    """
    scripts, handlers, redacted = _has_scripts(s), s.contains("="), redact_pii(s)
    return (
        F.when(scripts & handlers, _handlers(_scripts(redacted)))
        .when(scripts, _scripts(redacted))
        .when(handlers, _handlers(redacted))
        .otherwise(redacted)
    )


def contains_secrets(s: Column) -> Column:
    """Every secret needs one of a few literals; one combined regex does the rest."""
    combined = P.any_of(p for p, _ in P.SECRET_PATTERNS)
    return hit(s, needles_in(F.lower(s)), combined, _flat(P.SECRET_NEEDLES))


def mask_secrets(s: Column) -> Column:
    masked = s
    for pattern, replacement in P.SECRET_PATTERNS:
        masked = F.regexp_replace(masked, P.to_java(pattern), replacement)
    return F.when(contains_secrets(s), masked).otherwise(s)
