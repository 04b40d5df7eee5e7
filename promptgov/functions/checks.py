"""Checks of prompts against a security policy."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.functions import patterns as P
from promptgov.functions.denylist import FEW, deny_violations
from promptgov.functions.matching import (
    VIOLATION,
    hit,
    match_offset,
    pinned,
    present,
    violation,
    with_needles,
)
from promptgov.functions.text import estimate_tokens, normalize

NO_VIOLATIONS = f"CAST(array() AS array<{VIOLATION}>)"

Has = Callable[[str], Column]


def blocked_needles(text: str) -> tuple[str, ...]:
    """The longest stretch of a deny-list entry that lower() maps like `(?i)` does:
    ASCII without the letter s."""
    stretch = max(re.split(r"[^\x00-\x7f]+|[sS]", text), key=len).lower()
    return (stretch,) if stretch else ()


def blocked_violations(norm: Column, has: Has, blocked_patterns) -> list[Column]:
    """One nullable violation per deny-list entry, matched as a literal text."""
    out = []
    for text in blocked_patterns:
        java = "(?iu)" + P.quote_meta(text)
        found = violation(
            "blocked_pattern",
            "critical",
            f"{P.MSG_BLOCKED}(?i){P.quote_meta(text)}",
            match_offset(norm, java) if text else F.lit(0),
        )
        out.append(F.when(hit(norm, has, java, blocked_needles(text)), found) if text else found)
    return out


def injection_violations(norm: Column, has: Has) -> list[Column]:
    """One nullable violation per injection pattern."""
    out = []
    for pattern, needles in zip(P.INJECTION_PATTERNS, P.INJECTION_NEEDLES):
        found = violation(
            "prompt_injection", "critical", P.MSG_INJECTION, match_offset(norm, P.to_java(pattern))
        )
        out.append(F.when(hit(norm, has, P.java_test(pattern), needles), found))
    return out


def max_token_violation(norm: Column, max_prompt_tokens: int) -> Column:
    found = violation("max_tokens", "warning", P.MSG_MAX_TOKENS, F.lit(-1))
    return F.when(estimate_tokens(norm) > max_prompt_tokens, found)


def _few(policy) -> tuple[str, ...]:
    """The entries of a deny-list that is short enough for a regex each."""
    return policy.blocked_patterns if len(policy.blocked_patterns) <= FEW else ()


def needles_of(policy) -> list[str]:
    needles = [n for text in _few(policy) for n in blocked_needles(text)]
    if policy.prompt_injection_protection:
        needles += [n for group in P.INJECTION_NEEDLES for n in group]
    return needles


def violations_of(norm: Column, has: Has, policy) -> Column:
    """All violations of a normalised prompt; only checks the policy enables are built."""
    candidates = blocked_violations(norm, has, _few(policy))
    if policy.prompt_injection_protection:
        candidates += injection_violations(norm, has)
    if policy.max_prompt_tokens > 0:
        candidates.append(max_token_violation(norm, policy.max_prompt_tokens))
    if not candidates:
        return F.expr(NO_VIOLATIONS)
    return present(candidates).cast(f"array<{VIOLATION}>")


def check(df: DataFrame, policy, prompt: str = "prompt", into: str = "violations") -> DataFrame:
    """Normalise the prompt and add its violations; map-only."""
    kept = [c for c in df.columns if c != into]
    staged = normalize(df, prompt, "__norm")
    few = _few(policy) == policy.blocked_patterns
    if not few:
        staged = staged.withColumn("__denied", deny_violations(F.col("__norm"), policy.blocked_patterns, df.sparkSession))
    flagged, has = with_needles(staged, "__norm", needles_of(policy))
    found = violations_of(F.col("__norm"), has, policy)
    return pinned(flagged, kept, found if few else F.concat("__denied", found), into)


def is_clean(violations: Column) -> Column:
    return F.size(violations) == 0
