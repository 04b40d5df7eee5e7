"""Quality rules as a short-circuit cascade.

On a bounded sample each rule's cost (measured seconds) and selectivity (share it rejects)
are estimated; rules run in the order of rejection per cost, and a text that one rejects is
not looked at by the rest: the cascade is one CASE expression, whose later branches Spark
does not evaluate. The order affects the time only; a text stays if no rule rejects it.

Everything is a built-in expression over the whole text; nothing is shuffled.

Defined results: null and empty texts have no words, so the first base rule rejects them;
repeated rows give repeated results; other columns pass through, and helper columns carry a
`__` prefix, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.llm.common import bottom_sample, cut_lineage, seconds

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOL, "")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def with_repeats(df: DataFrame, text_col: str, name: str, words_name: str) -> DataFrame:
    """Add the number of words inside five-word windows that the text has twice or more, and of all words.

    Each step is a column of its own, so that Spark computes it once and the lambdas of the
    next step only index into it. Texts without a repeated window skip the sort.
    """
    zero = F.array().cast("array<long>")
    last = F.size("__words") - WINDOW
    gram = lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)])
    same = lambda x, j: F.coalesce(F.get("__sorted", j)["g"] == x["g"], F.lit(False))
    twice = lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1)
    step = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1), p + WINDOW) - p)
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    df = df.withColumn("__words", words(F.coalesce(F.col(text_col), F.lit(""))))
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    df = df.withColumn("__grams", F.when(last >= 0, F.transform(starts, gram)).otherwise(zero))
    df = df.withColumn("__sorted", F.when(repeats, F.sort_array(
        F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    df = df.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.sort_array(
        F.transform(F.filter("__sorted", twice), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("__at", step), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumns({name: F.coalesce(covered, F.lit(0).cast("long")),
                         words_name: F.size("__words").cast("long")})
    return df.drop("__words", "__grams", "__sorted", "__at")


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules look at, each as a column."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = with_repeats(df, text_col, "n_repeat_words", "n_words")
    df = df.withColumn("__lines", worded_lines(text))
    return df.withColumns({
        "word_chars": word_chars(text), "n_symbols": n_symbols(text),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
    }).drop("__lines")


def repeat_words(text: Column) -> Column:
    """The same count as `with_repeats` in one lazy expression, for use inside the cascade.

    A one-element array binds each step to a lambda variable, so that it is computed once and
    only if the branch is reached.
    """
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def at(w: Column) -> Column:
        last = F.size(w) - WINDOW
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            *[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(grams, repeated))

    def repeated(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            let(pairs, covered))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        hit = F.filter(s, lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x)),
            F.lit(0).cast("long"), lambda a, x: a + x))

    return let(words(text), at)


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the counts by name, as columns, and is true for texts to drop."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


BASE = (
    Rule("few_words", lambda c: c["n_words"] < 10),
    Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
)
METHOD = (
    Rule("short_words", lambda c: c["word_chars"] < 2 * c["n_words"]),
    Rule("long_words", lambda c: c["word_chars"] > 15 * c["n_words"]),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("repeated_lines", lambda c: 100 * c["n_dup_lines"] > 30 * c["n_lines"]),
)
RULES = BASE + METHOD


def lazily(text_col: str = "text") -> dict[str, Column]:
    """The counts as expressions, computed only where a rule is reached."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = worded_lines(text)
    return {
        "n_words": n_words(text), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(text),
    }


def ordered(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by share of rejected texts per second, both measured on a sample of about `rows`."""
    sample = cut_lineage(bottom_sample(df.select(F.col(text_col).alias("__text")), rows, "__text"), "rule-sample")
    counts = lazily("__text")
    share = lambda rule: sample.agg(F.avg(rule.rejects(counts).cast("int")).alias("share")).first()["share"]
    idle = seconds(lambda: share(Rule("none", lambda c: F.lit(False))))
    worth = {}
    for rule in rules:
        found: list = []
        cost = seconds(lambda rule=rule, found=found: found.append(share(rule)))
        worth[rule.name] = (found[0] or 0.0) / max(cost - idle, 1e-3)
    return sorted(rules, key=lambda r: -worth[r.name])


def verdict(rules, counts: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, else null."""
    out = None
    for rule in rules:
        out = (out.when if out is not None else F.when)(rule.rejects(counts), F.lit(rule.name))
    return out


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, all columns unchanged."""
    order = ordered(df, rules, text_col)
    return df.filter(verdict(order, lazily(text_col)).isNull())


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts of all rows: base_failed, kept, and the counts themselves."""
    order = ordered(df, METHOD, text_col)
    rows = measured(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    counts = {name: F.col(name) for name in rows.columns if name not in ("__id", "__text")}
    failed = verdict(BASE, counts).isNotNull()
    rows = rows.withColumn("base_failed", failed).withColumn(
        "kept", F.when(failed, False).otherwise(verdict(order, counts).isNull()))
    return rows.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept")
