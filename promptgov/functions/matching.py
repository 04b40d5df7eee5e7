"""Regex matching behind literal tests, and violations built from matches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "struct<Rule:string,Severity:string,Message:string,Position:int>"


def any_true(conditions) -> Column:
    return reduce(or_, conditions)


def needles_in(low: Column) -> Callable[[str], Column]:
    """The literal test itself; `low` is the text in lower case."""
    return lambda needle: low.contains(needle)


def hit(s: Column, has: Callable[[str], Column], java_pattern: str, needles) -> Column:
    """Whether the pattern matches `s`, which must hold one of the needles.

    `contains` scans the bytes as they are, while `rlike` decodes the whole text
    to a Java string, so the regex is tried only where a needle occurs.
    """
    matches = s.rlike(java_pattern)
    return any_true(has(n) for n in needles) & matches if needles else matches


def match_offset(s: Column, java_pattern: str) -> Column:
    """Byte offset of the leftmost match; call it only where there is one."""
    return F.octet_length(F.regexp_extract(s, rf"\A((?s:.*?))(?:{java_pattern})", 1))


def violation(rule: str, severity: str, message: str, position: Column | None = None) -> Column:
    fields = [
        F.lit(rule).alias("Rule"),
        F.lit(severity).alias("Severity"),
        F.lit(message).alias("Message"),
    ]
    if position is not None:
        fields.append(position.cast("int").alias("Position"))
    return F.struct(*fields)


def present(candidates: list[Column]) -> Column:
    """The non-null candidates, in order."""
    return F.array_compact(F.array(*candidates))


def pinned(df: DataFrame, kept: list[str], value: Column, into: str) -> DataFrame:
    """The columns `kept` and the value, which is computed once per row.

    A filter on a computed column is otherwise pushed below the projection, as a copy of
    the whole expression with all that it is built from. The filter does not get past a
    generator, and one over a single element changes nothing else.
    """
    return df.select(*[F.col(c) for c in kept], F.explode(F.array(value)).alias(into))


def with_needles(df: DataFrame, text: str, needles) -> tuple[DataFrame, Callable[[str], Column]]:
    """Add a flag per needle, and the lookup from needle to flag.

    The flags are a projection of their own: the patterns share them, and the text in
    lower case goes no further.
    """
    names = {n: f"__has_{i}" for i, n in enumerate(dict.fromkeys(needles))}
    lowered = df.withColumn("__low", F.lower(F.col(text)))
    flagged = lowered.select(
        *[F.col(c) for c in df.columns],
        *[F.col("__low").contains(n).alias(name) for n, name in names.items()],
    )
    return flagged, lambda needle: F.col(names[needle])
