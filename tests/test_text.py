import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from promptgov.functions import text as T


def normalize(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r.n for r in T.normalize(df, "s", "n").orderBy("i").collect()]


@pytest.mark.parametrize("raw, want", [
    ("ha\u200brbour li\u200cghts a\u200dt sea", "harbour lights at sea"),
    ("harbour \t\t lights\n \r at  sea", "harbour lights at sea"),
    ("&lt;tide&gt; &amp; &apos;wind&#39;", "<tide> & 'wind'"),
    ("\ufeffharbour", "harbour"),
    ("har\u00adbour\u00ad", "harbour"),
    ("How tall is a tide?", "How tall is a tide?"),
    ("tide\x00and\x01wind", "tideandwind"),
    ("a \x01 b", "a  b"),  # the control character goes after runs were collapsed
    ("&LT;&#X3C;&#x3c;&amp;lt;", "<<&#x3c;&lt;"),
    ("\u3000\x85 x\x0by \u2028", "xy"),
    ("a\x0c\x0c b\r\nc", "a b c"),
    ("cafe\u0301 &quot;q&quot;", "café \"q\""),
    ("\u180ex\u2060", "x"),
    (None, ""),
])
def test_normalize(spark, raw, want):
    assert normalize(spark, [raw]) == [want]


def plain_steps(s):
    """The steps one by one, in plain Python."""
    s = unicodedata.normalize("NFC", s)
    for c in T.ZERO_WIDTH:
        s = s.replace(c, "")
    out, blank = [], False
    for c in s:
        if c in "\t\n\f\r ":
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append(c)
            blank = False
    s = "".join(out).strip(T.UNICODE_SPACE)
    for entity, char in T.HTML_ENTITIES:
        s = s.replace(entity, char).replace(entity.upper(), char)
    s = "".join(" " if c in "\n\t\r" else c for c in s)
    return "".join(c for c in s if unicodedata.category(c) != "Cc")


def test_normalize_random(spark):
    rng = random.Random(3)
    alphabet = list(" \t\n\r\f\x0b\x00\x1b\x7f\x85\xa0ab&") + [
        "  ", "&lt;", "&AMP;", "\u0301", "e", "ᄒ", "ᅡ", "\u200b", "\u3000", "é", "\u212b", "\U0001d15e"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(2000)]
    assert normalize(spark, texts) == [plain_steps(t) for t in texts]


def test_nfc_suspects_cover_all_code_points(spark):
    """Whatever NFC may change is handed over: a missed character would stay as it is."""
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in points:
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    suspects = [chr(c) for c in points
                if unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)) or c in second]
    assert len(suspects) > 2000
    df = spark.createDataFrame([(s,) for s in suspects], "s string")
    assert df.filter(~F.col("s").rlike(T.NFC_SUSPECT) | ~F.col("s").rlike(T._ODD)).count() == 0
    got = df.select("s", T.nfc(F.concat(F.lit("e"), F.col("s"))).alias("n")).collect()
    assert [r for r in got if r.n != unicodedata.normalize("NFC", "e" + r.s)] == []


def test_counts(column):
    words = ["tide turns", "  tide  turns  ", "sea", "", "tide\nturns\tslowly", "a\rb", " \n"]
    assert column(T.count_words, words) == [2, 2, 1, 0, 3, 1, 0]
    assert column(T.estimate_tokens, ["", "abc", "abcd", "éé", "1234567"]) == [0, 0, 1, 1, 1]
    assert column(T.tenant_label, ["", None, "a"]) == ["_anonymous", "_anonymous", "a"]
