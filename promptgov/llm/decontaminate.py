"""Benchmark decontamination by Wu-Manber search over words.

Benchmark items become windows of ten consecutive words (an item with fewer is one window).
Patterns of one length are searched together: a shift table over blocks of two words skips
the positions at which no pattern can end, buckets by the last block hold the patterns that
may end there, split by first block, and a direct comparison of words confirms each
occurrence. Texts are read once, whole, and no text is shuffled.

Defined results: null and empty texts have no words; an item without words gives no window;
an item without id marks words but is not listed; repeated items count once; repeated rows
give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.common import as_bytes, cut_lineage, map_rows

#: Words keep digits, lower-case letters and everything beyond ASCII; A-Z become lower case.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Windows sent to the tasks at once; more of them are searched in several passes.
MAX_WINDOWS = 200_000

WINDOWS = "window array<binary>, items array<string>"
HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows with the ids of their items, from whole item texts."""
    field = T.StructField("windows", T.ArrayType(T.ArrayType(T.BinaryType())))

    def cut():
        def one(text):
            words = words_of(text)
            ends = range(max(1, len(words) - size + 1)) if words else ()
            return ([words[i:i + size] for i in ends],)
        return one

    rows = map_rows(benchmark, item_col, text_col, [field], cut)
    rows = rows.select(F.col(item_col).cast("string").alias("item"), F.explode("windows").alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


class Matcher:
    """Shift tables and buckets for all windows, one set per window length."""

    def __init__(self, patterns: list[tuple[tuple[bytes, ...], tuple[str, ...]]]):
        by_length = defaultdict(list)
        for words, items in patterns:
            by_length[len(words)].append((words, items))
        self.tables = [self._tables(m, found) for m, found in sorted(by_length.items())]

    @staticmethod
    def _tables(m, patterns):
        block = min(2, m)
        furthest = m - block + 1
        shift: dict = {}
        buckets: dict = defaultdict(lambda: defaultdict(dict))
        for words, items in patterns:
            for end in range(block, m + 1):
                key = words[end - block:end]
                shift[key] = min(shift.get(key, furthest), m - end)
            buckets[words[-block:]][words[:block]][words] = items
        return m, block, furthest, shift, {k: dict(v) for k, v in buckets.items()}

    def search(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Positions of the words inside occurrences, ascending, and the items that occur."""
        spans, items = [], set()
        for m, block, furthest, shift, buckets in self.tables:
            end, n, get = m, len(words), shift.get
            while end <= n:
                last = tuple(words[end - block:end])
                skip = get(last, furthest)
                if skip:
                    end += skip
                    continue
                start = end - m
                ends = buckets.get(last, {}).get(tuple(words[start:start + block]))
                if ends is not None:
                    found = ends.get(tuple(words[start:end]))
                    if found is not None:
                        spans.append((start, end))
                        items.update(found)
                end += 1
        hits, upto = [], 0
        for start, end in sorted(spans):
            hits.extend(range(max(start, upto), end))
            upto = max(upto, end)
        return hits, items


def _digest(n_words: int, n_hit: int, items) -> tuple:
    listed = ",".join(sorted(items))
    return n_words, n_hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), n_hit > 0


def _search(documents: DataFrame, patterns, id_col: str, text_col: str, fields, finish) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(patterns)

    def scan():
        matcher = Matcher(sent.value)

        def one(text):
            words = words_of(text)
            return finish(len(words), *matcher.search(words))
        return one

    return map_rows(documents, id_col, text_col, fields, scan)


def _collected(found: DataFrame) -> list:
    return [(tuple(bytes(w) for w in r["window"]), tuple(r["items"])) for r in found.collect()]


def contamination(
    documents: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
    text_col: str = "text", max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Per document: words, words inside benchmark windows, items that occur.

    At most `max_windows` windows reach a task at once. A benchmark with more is cut into
    blocks by hash; each block searches all documents, and the hits of the blocks are united.
    """
    found = windows(benchmark, size)
    blocks = -(-found.count() // max_windows)
    if blocks <= 1:
        return _search(documents, _collected(found), id_col, text_col, RESULT,
                       lambda n, hits, items: _digest(n, len(hits), items))

    # Several blocks: rows are told apart by id and text, so repeated ids stay separate.
    keyed = documents.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("__key"), text_col)
    parts = None
    for block in range(blocks):
        part = _collected(_block(found, block, blocks))
        rows = _search(keyed, part, "__key", text_col, HITS,
                       lambda n, hits, items: (n, hits, sorted(items)))
        rows = rows.filter((F.size("hits") > 0) if block else F.lit(True))
        parts = rows if parts is None else parts.unionByName(rows)
    copies = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("copies"))
    joined = parts.groupBy("__key").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).join(copies, "__key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(
        F.col("__key.id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents without any occurrence of a benchmark window, all their columns unchanged.

    Of a benchmark with more than `max_windows` windows each block searches what the block
    before has kept, written in between, so that no task holds the windows of two blocks.
    """
    found = windows(benchmark, size)
    blocks = max(1, -(-found.count() // max_windows))
    if blocks > 1:
        found = cut_lineage(found, "windows")
    for block in range(blocks):
        documents = _clean(documents, _collected(_block(found, block, blocks)), text_col)
        if block + 1 < blocks:
            documents = cut_lineage(documents, "clean")
    return documents


def _block(found: DataFrame, block: int, blocks: int) -> DataFrame:
    return found.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block) if blocks > 1 else found


def _clean(documents: DataFrame, patterns: list, text_col: str) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(patterns)
    names, schema = documents.columns, documents.schema

    def keep(batches):
        matcher = Matcher(sent.value)
        for batch in batches:
            clean = pa.array([not matcher.search(words_of(t))[0] for t in as_bytes(batch, text_col)], pa.bool_())
            yield batch.filter(clean).select(names)

    return documents.mapInArrow(keep, schema)
