"""Token counts by rank-synchronous merging of arrays.

Texts are cut into pre-tokens, and the pre-tokens of many texts are merged together: their bytes
lie in one ragged array of symbols, each symbol with the rank of the pair that it forms with the
next one. In each round every sequence finds the lowest rank among its pairs and merges all
occurrences of that pair at once, from the left where they overlap. Merged symbols are unlinked,
only the ranks beside a merge are looked up again, and sequences without any ranked pair drop
out. What survives are the tokens of the pre-token; their number is remembered for the task.

A round may merge all occurrences because a token is made by one pair and never serves a pair of
a lower rank than its own; a vocabulary for which this does not hold merges only the first
occurrence per round, which is the definition itself.

Letters and digits are those of the `regex` module's Unicode version, which is newer than the
one of the tokenizers library. Code points that became letters or digits after the version of
Python's own tables are in doubt; a text that holds one is cut by the library instead.

Defined results: null and empty texts have no bytes and no tokens; bytes that are not UTF-8 count
as bytes and are read as U+FFFD; the strings of added tokens inside texts are one token each;
null and repeated ids are kept as they are, a row per row; texts of any length are cut stretch by
stretch; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.common import as_bytes

# Fixed value: the cut of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern looks at most so many characters beyond a match.
BEYOND = 2
#: Characters cut at once, pre-tokens merged at once, and pre-tokens a task remembers.
STRETCH, TOGETHER, REMEMBERED = 1 << 18, 200_000, 1_000_000
#: Longer ones are not remembered.
LONGEST = 64
NONE = np.iinfo(np.int32).max


class Merges:
    """A byte-level BPE vocabulary as arrays: small, and sent to the tasks as it is."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        name = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.of_byte = np.array([vocabulary[name[b]] for b in range(256)], np.int32)
        self.size = max(vocabulary.values()) + 1
        pairs = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks, self.made = first.astype(np.int32), pairs[:, 2].astype(np.int32)
        every = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        self.of_pair = self.rank(*(self.of_byte[b] for b in every)).reshape(256, 256)
        self.together = self._in_order(pairs)

    @staticmethod
    def _in_order(pairs: np.ndarray) -> bool:
        """Every token is made by one pair, of a lower rank than all pairs that it serves."""
        born = {}
        for rank, made in enumerate(pairs[:, 2].tolist()):
            if made in born:
                return False
            born[made] = rank
        return all(born.get(part, -1) < rank for rank, (a, b, _) in enumerate(pairs.tolist()) for part in (a, b))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def surviving(self, sequences: list[str]) -> np.ndarray:
        """How many symbols are left of each sequence, none of them empty, after all merges."""
        whole = "".join(sequences)
        sizes = map(len, sequences) if whole.isascii() else (len(s) if s.isascii() else len(s.encode()) for s in sequences)
        lengths = np.fromiter(sizes, np.int64, len(sequences))
        left = lengths.copy()
        data = np.frombuffer(whole.encode(), np.uint8)
        symbols = self.of_byte[data]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
        ranks = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(~last)
        ranks[inner] = self.of_pair[data[inner], data[inner + 1]]
        alive = np.ones(len(symbols), bool)
        while len(symbols):
            # Sequences that can go on, and of those the symbols not merged away.
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            going = np.repeat(np.minimum.reduceat(ranks, starts) < NONE, sizes) & alive
            symbols, owner, ranks = symbols[going], owner[going], ranks[going]
            if len(symbols):
                alive = self._rounds(symbols, owner, ranks, left)
        return left

    def _rounds(self, symbols, owner, ranks, left) -> np.ndarray:
        """Merge round by round in place until half of the symbols are gone or at rest; which are alive."""
        n = len(symbols)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, n])
        alive, after, before = np.ones(n, bool), np.arange(1, n + 1), np.arange(-1, n - 1)
        gone = 0
        while True:
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < NONE
            gone_or_resting = gone + int(sizes[~going].sum())
            if 2 * gone_or_resting >= n or not going.any():
                return alive
            wanted = np.repeat(np.where(going, lowest, -1), sizes) if len(starts) > 1 else lowest[0]
            hits = np.flatnonzero(ranks == wanted)
            if not self.together:
                hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            else:  # of overlapping hits, every second one, from the left
                chained = np.r_[False, after[hits[:-1]] == hits[1:]]
                heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(hits))))
                hits = hits[(np.arange(len(hits)) - heads) % 2 == 0]
            eaten = after[hits]
            symbols[hits] = self.made[ranks[hits]]
            alive[eaten], ranks[eaten] = False, NONE
            after[hits] = after[eaten]
            follow = after[hits] < n
            before[after[hits[follow]]] = hits[follow]
            np.subtract.at(left, owner[hits], 1)
            gone += len(hits)
            touched = np.concatenate([hits, before[hits]])
            touched = touched[touched >= 0]
            follow = after[touched]
            inner = follow < n
            inner &= owner[np.where(inner, follow, 0)] == owner[touched]
            ranks[touched[~inner]] = NONE
            ranks[touched[inner]] = self.rank(symbols[touched[inner]], symbols[follow[inner]])


class Vocabulary:
    """What a tokenizers file says, as far as counting needs it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut["add_prefix_space"] and not spec["normalizer"] and not model.get("ignore_merges")
                 and not model.get("dropout"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs)
        self.doubtful, self.doubt_from = doubtful()


def doubtful() -> tuple[str, int]:
    """A character class of the letters and digits that Python's own tables do not know yet, and
    the least byte that a code point of it begins with."""
    known = lambda c: unicodedata.category(c)[0] in "LN"
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if not known(c)]
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    if not runs:
        return r"(?!)", 256
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]", chr(points[0]).encode()[0]


class Counter:
    """Counts the tokens of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers.pre_tokenizers import ByteLevel

        self.merges = vocabulary.merges
        self.cut = regex.compile(PATTERN)
        self.library = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.doubt, self.from_byte = regex.compile(vocabulary.doubtful), vocabulary.doubt_from
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.after = regex.compile(r"(?<=\S) (?=\S)")
        #: Counts of pre-tokens, and of parts with the space before them.
        self.known: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.new_parts: set[str] = set()

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens, a stretch at a time: a stretch ends where more text would not change them."""
        at, size = 0, STRETCH
        while at < len(text):
            words = self.cut.findall(text, at, at + size)
            if at + size < len(text):
                held = 0
                while words and held <= BEYOND:
                    held += len(words.pop())
                if not words:
                    size *= 2
                    continue
            yield words
            at, size = at + sum(map(len, words)), STRETCH

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """A text without added tokens in stretches: as parts that each follow a space, or as pre-tokens.

        No pre-token holds a character and the space after it, so parts between spaces can be
        counted by themselves, unless white space meets the spaces around them.
        """
        first, space, rest = text.partition(" ")
        for words in self.words(first):
            yield False, words
        while space:
            at = self.after.search(rest, STRETCH) if len(rest) > STRETCH else None
            piece, space, rest = (rest[:at.start()], " ", rest[at.end():]) if at else (rest, "", "")
            parts = piece.split(" ")
            new = set(parts).difference(self.spaced)
            if any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                for words in self.words(" " + piece):
                    yield False, words
            else:
                self.new_parts |= new
                yield True, parts

    def counts(self, texts: Iterable[bytes | None]) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each text."""
        sizes, totals, held, holding = [], [], [], 0
        for row, text in enumerate(texts):
            sizes.append(len(text) if text else 0)
            totals.append(0)
            if not text:
                continue
            content = text.decode("utf-8", "replace")
            segments = self.added.split(content) if self.added else [content]
            totals[row] += len(segments) - 1
            doubtful = np.frombuffer(text, np.uint8).max() >= self.from_byte and self.doubt.search(content)
            for segment in segments:
                for spaced, words in ([(False, [segment[a:b] for _, (a, b) in self.library(segment)])]
                                      if doubtful else self.parts(segment)):
                    held.append((row, spaced, words))
                    holding += len(words)
                    if holding >= TOGETHER:
                        self.settle(held, totals)
                        held, holding = [], 0
        self.settle(held, totals)
        return sizes, totals

    def settle(self, held: list[tuple[int, bool, list[str]]], totals: list[int]) -> None:
        """Count what was not met before, all in one array, and add up."""
        parts = list(self.new_parts)
        words = set().union(*(words for _, spaced, words in held if not spaced))
        new = [word for word in words if word not in self.known]
        # A pre-token that begins with a space begins a part.
        pieces = self.cut.findall(" " + " ".join(parts)) if parts else []
        counts = self.merges.surviving([*pieces, *new])
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        if parts:
            sums = np.add.reduceat(counts[:len(pieces)], first).tolist()
            self.spaced.update(zip(parts, sums, strict=True))
        self.known.update(zip(new, counts[len(pieces):].tolist(), strict=True))
        for row, spaced, words in held:
            totals[row] += sum(map((self.spaced if spaced else self.known).__getitem__, words))
        for part in (p for p in parts if len(p) > LONGEST):
            del self.spaced[part]
        for word in (w for w in new if len(w) > LONGEST):
            del self.known[word]
        self.new_parts = set()
        if len(self.known) + len(self.spaced) > REMEMBERED:
            self.known, self.spaced = {}, {}


def count_tokens(
    documents: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every text under the vocabulary file at `path`.

    The driver reads the file; tasks get its arrays, so executors need no such file.
    """
    vocabulary = Vocabulary(path)
    source = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([
        T.StructField(id_col, source.schema["__id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            sizes, totals = counter.counts(as_bytes(batch, "__text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], names=out.names)

    return source.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
