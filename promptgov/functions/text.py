"""Text normalisation and size measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.functions.patterns import HTML_ENTITIES, UNICODE_SPACE, ZERO_WIDTH

# A superset of the characters that NFC can change, alone or next to another:
# combining marks, characters unknown to the running JVM, conjoining jamo, and
# the blocks that hold singletons and composition exclusions. Text without any
# of them is already in NFC. A test checks the set against every code point.
NFC_SUSPECT = (
    r"[\x{300}-\x{10FFFF}&&[\p{M}\p{Cn}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}"
    r"\x{A33}-\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{FB9}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}"
    r"\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}"
    r"\x{FB1D}-\x{FB4F}\x{11000}-\x{16FFF}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]]"
)
# Control characters one by one: Java tests listed Latin-1 characters in one step, but
# each range on its own. Tab, newline, form feed and return count as whitespace.
_CONTROL = "".join(rf"\x{c:02X}" for c in (*range(9), 11, *range(14, 32), *range(127, 160)))
# Each class starts with a test that ordinary characters fail at once.
_ZERO_WIDTH_CLASS = f"[\\x{{AD}}-\\x{{FEFF}}&&[{ZERO_WIDTH}]]"
_ODD = rf"[[^ -~]&&[{_CONTROL}{_ZERO_WIDTH_CLASS}{NFC_SUSPECT}]]"

# `(?i)s` also matches this character, which lower() keeps.
LONG_S = chr(0x17F)


def as_text(s: Column) -> Column:
    """A missing text counts as empty."""
    return F.coalesce(s, F.lit(""))


def nfc(s: Column) -> Column:
    """Unicode NFC, by the ICU library that ships with Spark.

    Only texts holding a character NFC might touch are handed over; the test runs
    on the byte and character counts first, so plain ASCII is never decoded.
    """
    suspect = (F.octet_length(s) > F.char_length(s)) & s.rlike(NFC_SUSPECT)
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), s, F.lit(False)
    )
    return F.when(suspect, composed).otherwise(s)


def strip_zero_width(s: Column) -> Column:
    return F.regexp_replace(s, _ZERO_WIDTH_CLASS, "")


def collapse_whitespace(s: Column) -> Column:
    """Turn each ASCII whitespace run into one space, then trim Unicode spaces."""
    return F.btrim(_one_space(_spaces(s)), F.lit(UNICODE_SPACE))


def _spaces(s: Column) -> Column:
    """Other whitespace to spaces; the regex only for what is rare in prompts."""
    rare = s.contains("\t") | s.contains("\r") | s.contains("\f")
    return F.when(rare, F.regexp_replace(s, r"[\t\n\f\r]", " ")).otherwise(
        F.replace(s, F.lit("\n"), F.lit(" ")))


def _one_space(s: Column) -> Column:
    return F.when(s.contains("  "), F.regexp_replace(s, "  +", " ")).otherwise(s)


def decode_entities(s: Column) -> Column:
    """Decode the known entities, as written and upper-cased, in table order."""
    decoded = s
    for entity, char in HTML_ENTITIES:
        for spelling in dict.fromkeys((entity, entity.upper())):
            decoded = F.replace(decoded, F.lit(spelling), F.lit(char))
    return F.when(s.contains("&"), decoded).otherwise(s)


def drop_control(s: Column) -> Column:
    spaced = F.regexp_replace(s, r"[\n\t\r]", " ")
    return F.regexp_replace(spaced, rf"[{_CONTROL}\f]", "")


def normalize(df: DataFrame, text: str, into: str) -> DataFrame:
    """All normalisation steps. Each step is a projection, so none runs twice.

    One scan tells whether a text has any character that NFC, the removal of zero-width
    or that of control characters could touch; few texts do.
    """
    s = F.col(into)
    odd = F.col("__odd")
    return (
        df.withColumn(into, as_text(F.col(text)))
        .withColumn("__odd", s.rlike(_ODD))
        .withColumn(into, F.when(odd, nfc(s)).otherwise(s))
        .withColumn(into, F.when(odd, strip_zero_width(s)).otherwise(s))
        .withColumn(into, _spaces(s))
        .withColumn(into, F.btrim(_one_space(s), F.lit(UNICODE_SPACE)))
        .withColumn(into, decode_entities(s))
        .withColumn(into, F.when(odd, drop_control(s)).otherwise(s))
        .drop("__odd")
    )


def estimate_tokens(s: Column) -> Column:
    """Four bytes count as one token, rounded down."""
    return F.shiftright(F.octet_length(s), 2)


def count_words(s: Column) -> Column:
    """Runs of characters other than space, newline and tab."""
    trimmed = F.btrim(s, F.lit(" \n\t"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \n\t]+")))


def tenant_label(tenant: Column) -> Column:
    return F.coalesce(F.nullif(tenant, F.lit("")), F.lit("_anonymous"))
