"""Detection patterns and their translation to Java regex syntax.

The patterns are written in RE2 syntax, where `\\b`, `\\s` and `\\d` are ASCII,
`.` excludes only the newline, and `(?i)` folds Unicode. Spark runs Java regexes,
which differ on each of these points; `to_java` closes the gap.
"""

from __future__ import annotations

import re
from functools import lru_cache

# --------------------------------------------------------------------------
# Patterns, replacements, rules and texts that decide results.
# --------------------------------------------------------------------------

INJECTION_PATTERNS = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    r"(?i)ignore\s+(all\s+)?above\s+instructions",
    r"(?i)disregard\s+(all\s+)?previous",
    r"(?i)forget\s+(all\s+)?(your\s+)?instructions",
    r"(?i)you\s+are\s+now\s+(a|an)\s+",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)system\s*prompt\s*:",
    r"(?i)reveal\s+(your\s+)?(system\s+)?prompt",
    r"(?i)print\s+(your\s+)?(system\s+)?prompt",
    r"(?i)show\s+(me\s+)?(your\s+)?(system\s+)?prompt",
    r"(?i)\bDAN\b.*\bjailbreak\b",
    r"(?i)do\s+anything\s+now",
    r"(?i)act\s+as\s+if\s+you\s+have\s+no\s+restrictions",
)

PII_EMAIL = (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]")
PII_PHONE = (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE_REDACTED]")
PII_SSN = (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]")
PII_CARD = (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CC_REDACTED]")
PII_MARKER = "_REDACTED]"

LEAKAGE_PATTERNS = (
    r"(?i)my\s+(system\s+)?instructions?\s+(are|say|tell)",
    r"(?i)i\s+was\s+(told|instructed|programmed)\s+to",
    r"(?i)my\s+initial\s+prompt",
    r"(?i)here\s+(is|are)\s+my\s+instructions?",
)

DANGEROUS_PATTERNS = (
    ("dangerous_command", r"(?i)(sudo|chmod\s+777|rm\s+-rf\s+/)"),
    ("sql_injection", r"(?i)(DROP\s+TABLE|DELETE\s+FROM|TRUNCATE)"),
    ("xss_content", r"(?i)(<script|javascript:|on\w+\s*=)"),
)

SCRIPT_BLOCK = (r"(?i)<script[^>]*>[\s\S]*?</script>", "[SCRIPT_REMOVED]")
EVENT_HANDLER = (r"""(?i)\s+on\w+\s*=\s*["'][^"']*["']""", "")

SECRET_PATTERNS = (
    (r"(?i)(api[_-]?key|apikey)\s*[=:]\s*\S+", "$1=[REDACTED]"),
    (r"(?i)(secret|password|passwd|pwd)\s*[=:]\s*\S+", "$1=[REDACTED]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9\-._~+/]+=*", "$1[REDACTED]"),
    (r"(?i)ghp_[A-Za-z0-9]{36}", "[GITHUB_TOKEN_REDACTED]"),
    (r"(?i)sk-[A-Za-z0-9]{48}", "[OPENAI_KEY_REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY_REDACTED]"),
)

HTML_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&#x27;", "'"),
    ("&#x3C;", "<"),
    ("&#x3E;", ">"),
    ("&#60;", "<"),
    ("&#62;", ">"),
)

# Zero-width space, non-joiner, joiner, byte order mark, soft hyphen, word
# joiner, Mongolian vowel separator.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad\u2060\u180e"

# Unicode White_Space, trimmed from both ends of a normalised prompt.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

MSG_BLOCKED = "Prompt contains blocked pattern: "
MSG_INJECTION = "Potential prompt injection detected"
MSG_MAX_TOKENS = "Prompt exceeds estimated token limit"
MSG_OUTPUT_PII = "Model output contains PII"
MSG_LEAKAGE = "Model output may contain system prompt leakage"
MSG_DANGEROUS = "Model output contains potentially dangerous content: "

# --------------------------------------------------------------------------
# Literals without which a pattern cannot match, in lower case. Spark tests
# them with `contains` before it decodes the text for a regex. They avoid the
# letter s, which `(?i)` also finds in U+017F while lower() leaves that as it is.
# --------------------------------------------------------------------------

INJECTION_NEEDLES = (
    ("truction",),
    ("truction",),
    ("regard",),
    ("truction",),
    ("now",),
    ("truction",),
    ("prompt",),
    ("prompt",),
    ("prompt",),
    ("prompt",),
    ("jailbreak",),
    ("anything",),
    ("triction",),
)
LEAKAGE_NEEDLES = (
    ("truction",),
    ("told", "tructed", "programmed"),
    ("initial",),
    ("truction",),
)
DANGEROUS_NEEDLES = (
    ("udo", "chmod", "-rf"),
    ("drop", "delete", "truncate"),
    ("cript", "="),
)
SECRET_NEEDLES = (("api",), ("ecret", "word", "wd"), ("bearer",), ("ghp_",), ("k-",), ("akia",))

_WORD = "A-Za-z0-9_"
_SPACE = r"\t\n\f\r "
_BOUNDARY = f"(?-iu:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_DIGIT_START = rf"(?=[0-9])(?<![{_WORD}])"
_DIGIT_END = f"(?![{_WORD}])"

_TOKEN = re.compile(r"\(\?i\)|\\.|\[|\]|\.|[^\\\[\].(]+|\(")


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    """Rewrite an RE2 pattern so that Java's engine finds the same matches."""
    out: list[str] = []
    in_class = False
    tokens = _TOKEN.findall(pattern)
    for i, tok in enumerate(tokens):
        if tok == "(?i)":
            out.append("(?iu)")
        elif tok == "[" and not in_class:
            in_class = True
            out.append(tok)
        elif tok == "]" and in_class:
            in_class = False
            out.append(tok)
        elif tok == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
        elif tok == r"\S":
            # Beside \s in one class the two halves cover every character.
            out.append(r"\S\x0B" if in_class else f"[^{_SPACE}]")
        elif tok == r"\w":
            # Spelled out, since Java folds a range under (?iu) but not \w.
            out.append(_WORD if in_class else f"[{_WORD}]")
        elif tok == r"\b" and not in_class:
            if i + 1 < len(tokens) and tokens[i + 1] == r"\d":
                out.append(_DIGIT_START)
            elif i >= 2 and tokens[i - 2] == r"\d":
                out.append(_DIGIT_END)  # the token between is the count, as in \d{4}\b
            else:
                out.append(_BOUNDARY)
        elif tok == "." and not in_class:
            out.append(r"[^\n]")
        else:
            out.append(tok)
    return "".join(out)


# --------------------------------------------------------------------------
# RE2 takes linear time; Java's engine tries a pattern again from each start. On a
# hostile text of megabytes the patterns below would take hours, so they are
# rewritten to try each stretch of text once. All starts within a stretch fail or
# succeed together, and the first one is the match.
# --------------------------------------------------------------------------

_LOCAL = "[A-Za-z0-9._%+-]"
_FOLDED_WORD = f"[{_WORD}]"  # under (?iu), as RE2 folds \\w

# The local part ends at the @ from wherever in the stretch it starts. It starts at the
# stretch's first word character, or right behind the match before. Group 1 is what
# the stretch has in front of it.
EMAIL_FINDER = (
    rf"((?<!{_LOCAL})[.%+-]*+(?=[{_WORD}])|\G{_BOUNDARY}){_LOCAL}++"
    rf"@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_BOUNDARY}"
)
# Where one start within a word fails, so do the later ones.
HANDLER_TEST = (
    rf"(?iu)(<script|javascript:|(?<!{_FOLDED_WORD})(?>{_FOLDED_WORD}*?on){_FOLDED_WORD}++[{_SPACE}]*+=)"
)
HANDLER_FINDER = (
    rf"(?iu)(?<![{_SPACE}])[{_SPACE}]++on{_FOLDED_WORD}++[{_SPACE}]*+=[{_SPACE}]*+[\"'][^\"']*+[\"']"
)
# Up to the last closing tag, and behind it: there no block can end.
SCRIPT_PARTS = r"(?ius)\A(.*</script>)?(.*)\z"
# A stretch ends with its first >, which all opening tags in it share. Group 1 is
# what the stretch has in front of the first of them.
SCRIPT_FINDER = (
    r"(?iu)(?<![^>])([^<>]*+(?:<(?!script)[^<>]*+)*+)<script[^>]*+>(?s:.*?)</script>"
)
# The first DAN of a line reaches every jailbreak that a later one reaches.
JAILBREAK_TEST = (
    rf"(?iu)(?<![^\n])(?>[^\n]*?{_BOUNDARY}DAN{_BOUNDARY})[^\n]*{_BOUNDARY}jailbreak{_BOUNDARY}"
)

_TESTS = {
    PII_EMAIL[0]: EMAIL_FINDER,
    DANGEROUS_PATTERNS[2][1]: HANDLER_TEST,
    INJECTION_PATTERNS[10]: JAILBREAK_TEST,
}


def java_test(pattern: str) -> str:
    """A Java pattern that tells whether the pattern matches, in linear time."""
    return _TESTS.get(pattern) or to_java(pattern)


def any_of(patterns) -> str:
    """One Java pattern that matches where any of the given patterns does."""
    parts = []
    for p in patterns:
        java = java_test(p)
        parts.append(f"(?iu:{java[5:]})" if java.startswith("(?iu)") else f"(?:{java})")
    return "|".join(parts)


def quote_meta(text: str) -> str:
    """Escape regex metacharacters with a backslash, as shown in messages."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)
