"""Suffix-array dedup: bytes covered by long strings that occur elsewhere.

The corpus is one text whose suffixes are put in order; the longest previous factor of a
position, and its mirror image the longest next factor, tell how long a string starting there
also starts earlier or later. Only whether they reach `length` bytes matters, so suffixes are
ordered by their first `length` bytes: suffixes that agree that far are neighbours, and the
nearest smaller (or larger) position beside one in that order gives its match.

Sorting all suffixes of the corpus in one order is not needed for that: `repeats` gathers the
suffixes that share an anchor, and each gathering is suffix-sorted by itself, by doubling the
compared prefix (8, 16, ... bytes). Suffixes from different gatherings cannot agree.

`keep="none"` removes every copy, `keep="first"` all but the first in the order of ids.

Defined results: a null text is empty; texts shorter than `length` lose nothing; rows with
equal id and text count as copies for keep="none" and as one document for keep="first";
null ids come first; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.repeats import Spec, U, covered, mixed, repeated_windows, sources, with_spans

TABLE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def byte_symbols(units: np.ndarray) -> np.ndarray:
    return TABLE[units]


def suffix_names(units: list[np.ndarray], run, offset, group, distance, length: int) -> np.ndarray:
    """Rank the suffixes that start at the windows by their first `length` bytes.

    Prefix doubling: the rank of 2m bytes comes from the ranks of m bytes at two places. The
    ranks start from 8 bytes read as one number. A suffix that the end of its run cuts short
    is ranked with zeros; no window reaches that far.
    """
    size = np.array([len(u) for u in units])
    text = np.concatenate([*units, np.zeros(8, np.uint8)])
    rank = np.zeros(len(text) - 8, U)
    for i in range(8):
        rank = (rank << U(8)) | text[i:len(text) - 8 + i]
    done = 8
    while done < length:
        ahead = min(done, length - done)
        order = np.unique(rank, return_inverse=True)[1].astype(U)
        second = np.zeros(len(order), U)
        second[:len(order) - ahead] = order[ahead:]
        rank, done = (order << U(32)) | second, done + ahead
    at = (np.cumsum(size) - size)[run] + offset
    return rank[at]


def spec_for(length: int, gram: int, earlier: bool) -> Spec:
    def names(units, run, offset, group, distance):
        return suffix_names(units, run, offset, group, distance, length)
    return Spec(length, gram, byte_units, byte_symbols, names, np.uint8, earlier)


FIELDS = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def repeated_bytes(
    documents: DataFrame, length: int = 400, keep: str = "none", gram: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: its bytes, those removed, the maximal removed runs, and a digest of the rest."""
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and below length")
    spec = spec_for(length, gram, earlier=keep == "first")
    texts = sources(documents, id_col, text_col)

    def one(text, spans):
        cuts = covered(spans, length, len(text))
        digest, at = hashlib.sha256(), 0
        for a, b in cuts:
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        return len(text), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest(), cuts

    return with_spans(texts, repeated_windows(texts, spec), FIELDS, one, id_col)
