"""Deny-lists of any length: one pass over a prompt by an automaton, whatever the number of entries.

Entries are literal texts that match without regard to case, as `(?i)` does: two characters are alike if
the lower case of their upper case is the same, by Java's simple mappings. Entries and prompts are mapped to
that character by character, so places stay the same, and an Aho-Corasick automaton finds every entry's first
place. The entries are sent to the tasks once and are no part of the plan.

A list that is a table (`table_violations`) never lies whole in the driver or in a task: tasks get its different folded
texts, a block after the other, and what they find is joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.functions import patterns as P
from promptgov.functions.matching import VIOLATION
from promptgov.functions.text import normalize
from promptgov.plans.lineage import cut_lineage

#: Up to so many entries have a regex each; longer lists have an automaton.
FEW = 100
#: Characters of entries in one automaton (some 100 bytes of memory each); longer lists have several, one after the other.
TOGETHER = 2_000_000


def case_folds(spark: SparkSession) -> dict[int, int]:
    """The code points that are not their own lower case of the upper case, as Java maps them; some 2,800."""
    points = spark.range(0x110000).select(F.col("id").cast("int").alias("c"))
    upper = F.reflect(F.lit("java.lang.Character"), F.lit("toUpperCase"), F.col("c")).cast("int")
    folded = points.select("c", upper.alias("u")).select(
        "c", F.reflect(F.lit("java.lang.Character"), F.lit("toLowerCase"), F.col("u")).cast("int").alias("f"))
    return {r.c: r.f for r in folded.filter("c <> f").collect()}


def _blocks(entries: tuple[str, ...]) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for i, entry in enumerate(entries):
        if block and size + len(entry) > TOGETHER:
            yield block
            block, size = [], 0
        block.append((i, entry))
        size += len(entry)
    if block:
        yield block


def first_places(text: str, automaton) -> dict[int, int]:
    """Entry -> code points before its first place in a folded text."""
    found: dict[int, int] = {}
    for end, (size, numbers) in automaton.iter(text):
        if numbers[0] not in found:
            found.update(dict.fromkeys(numbers, end + 1 - size))
    return found


def automaton_of(block: list[tuple[int, str]], folds: dict[int, int]):
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for i, entry in block:
        if entry:
            numbers.setdefault(entry.translate(folds), []).append(i)
    automaton = ahocorasick.Automaton()
    for text, own in numbers.items():
        automaton.add_word(text, (len(text), own))
    automaton.make_automaton()
    return automaton if numbers else None


def deny_violations(norm: Column, entries: tuple[str, ...], spark: SparkSession) -> Column:
    """The violations of a normalised prompt, one per entry it holds, in the order of the list; empty for null.

    An empty entry is found at the beginning of every prompt; entries that are equal up to case are found each.
    """
    folds = case_folds(spark)
    arrays = []
    for block in _blocks(entries):
        sent = spark.sparkContext.broadcast((block, folds))
        arrays.append(_finder(sent)(norm))
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def _finder(sent):
    # A task builds the automaton once; the cache lives as long as the function does there.
    cache: list = []
    # A module would be imported where the function runs; what is taken from it travels along.
    blocked, quote_meta = P.MSG_BLOCKED, P.quote_meta

    def find(texts: pd.Series) -> pd.Series:
        block, folds = sent.value
        if not cache:
            cache.append((automaton_of(block, folds), dict(block), [i for i, entry in block if not entry]))
        automaton, named, empty = cache[0]

        def violations(text: str | None) -> list[dict]:
            if text is None:
                return []
            found = first_places(text.translate(folds), automaton) if automaton else {}
            found |= dict.fromkeys(empty, 0)
            return [{"Rule": "blocked_pattern", "Severity": "critical",
                     "Message": f"{blocked}(?i){quote_meta(named[i])}",
                     "Position": len(text[:at].encode())} for i, at in sorted(found.items())]

        return texts.map(violations, na_action=None)

    find.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(find, f"array<{VIOLATION}>")


def _folded(entries: DataFrame, folds: dict[int, int]) -> DataFrame:
    """entry, folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [entry.translate(folds) for entry in batch.column("entry").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(texts, pa.string())], names=["entry", "folded"])

    return entries.mapInArrow(run, "entry string, folded string")


def _places(norms: DataFrame, texts: list[str], folds: dict[int, int]) -> DataFrame:
    """The rows of `norms` without `__norm`, with each folded text that they hold and the bytes before its first place."""
    kept = [f for f in norms.schema.fields if f.name != "__norm"]
    sent = norms.sparkSession.sparkContext.broadcast((list(enumerate(texts)), folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, folds = sent.value
        automaton, empty = automaton_of(block, {}), [i for i, text in block if not text]
        for batch in batches:
            rows, folded, position = [], [], []
            for row, text in enumerate(batch.column("__norm")):
                if (text := text.as_py()) is None:
                    continue
                found = first_places(text.translate(folds), automaton) if automaton else {}
                for i, at in (found | dict.fromkeys(empty, 0)).items():
                    rows.append(row)
                    folded.append(block[i][1])
                    position.append(len(text[:at].encode()))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(at) for f in kept), pa.array(folded, pa.string()), pa.array(position, pa.int32())],
                names=[*(f.name for f in kept), "folded", "position"])

    return norms.mapInArrow(run, T.StructType([
        *kept, T.StructField("folded", T.StringType()), T.StructField("position", T.IntegerType())]))


def table_violations(prompts: DataFrame, entries: DataFrame, *order: str, prompt: str = "prompt") -> DataFrame:
    """A row per prompt and entry it holds, numbered per prompt by `order`, columns of `entries`: the columns of
    `prompts` but the text, ordinal, rule, severity, message, position. Null entries are left out.
    """
    spark = prompts.sparkSession
    folds = case_folds(spark)
    listed = entries.select("entry", *[F.col(c).alias(f"__order{n}") for n, c in enumerate(order)]).filter("entry IS NOT NULL")
    spelled = cut_lineage(_folded(listed.select("entry").distinct(), folds), "entries")
    texts = spelled.select("folded").distinct()
    size = texts.agg(F.sum(F.length("folded"))).first()[0] or 0
    blocks = size // TOGETHER + 1
    texts = texts.withColumn("block", F.pmod(F.xxhash64("folded"), F.lit(blocks)))

    keys = [c for c in prompts.columns if c != prompt]
    norms = normalize(prompts, prompt, "__norm").select(*keys, F.monotonically_increasing_id().alias("__row"), "__norm")
    if blocks > 1:
        norms = cut_lineage(norms, "normalised")
    found = [cut_lineage(_places(norms, [r.folded for r in texts.filter(F.col("block") == b).select("folded").collect()], folds),
                         "found") for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, found).join(spelled, "folded").join(listed, "entry")
    inside = Window.partitionBy("__row").orderBy(*[f"__order{n}" for n in range(len(order))])
    # As `quote_meta` writes it.
    quoted = F.regexp_replace("entry", r"([\\.+*?()|\[\]{}^$])", r"\\$1")
    return hits.select(
        *keys, (F.row_number().over(inside) - 1).alias("ordinal"), F.lit("blocked_pattern").alias("rule"),
        F.lit("critical").alias("severity"), F.concat(F.lit(f"{P.MSG_BLOCKED}(?i)"), quoted).alias("message"), "position")
