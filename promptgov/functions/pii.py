"""Personal data: detection and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptgov.functions import patterns as P

# The phone, SSN and card patterns all begin with these digits.
_DIGITS = "[0-9]{3}[-.]?[0-9]"
_NUMBERS = (P.PII_PHONE, P.PII_SSN, P.PII_CARD)


def _replace(s: Column, rule: tuple[str, str]) -> Column:
    pattern, marker = rule
    return F.regexp_replace(s, P.to_java(pattern), marker)


def _emails(s: Column) -> Column:
    return F.regexp_replace(s, P.EMAIL_FINDER, "$1" + P.PII_EMAIL[1])


def redact_email(s: Column) -> Column:
    return F.when(s.contains("@"), _emails(s)).otherwise(s)


def redact_phone(s: Column) -> Column:
    return _replace(s, P.PII_PHONE)


def redact_ssn(s: Column) -> Column:
    return _replace(s, P.PII_SSN)


def redact_card(s: Column) -> Column:
    return _replace(s, P.PII_CARD)


def _numbers(s: Column) -> Column:
    for rule in _NUMBERS:
        s = _replace(s, rule)
    return s


def redact_pii(s: Column) -> Column:
    """Redact e-mail, phone, SSN and card, in this order.

    The tests look at the input only: a marker holds neither `@` nor digits, so a
    replacement cannot make room for a match of a later rule.
    """
    email, numbers = s.contains("@"), s.rlike(_DIGITS)
    return (
        F.when(email & numbers, _numbers(_emails(s)))
        .when(email, _emails(s))
        .when(numbers, _numbers(s))
        .otherwise(s)
    )


def contains_pii(s: Column) -> Column:
    """Whether redaction would leave a marker, including one already in the text."""
    return (
        s.contains(P.PII_MARKER)
        | (s.contains("@") & s.rlike(P.EMAIL_FINDER))
        | (s.rlike(_DIGITS) & s.rlike(P.any_of(p for p, _ in _NUMBERS)))
    )


def redact_output(s: Column) -> Column:
    redacted = redact_pii(s)
    return F.struct(redacted.alias("redacted"), (redacted != s).alias("changed"))
