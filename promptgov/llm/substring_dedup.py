"""Seed and extend: later copies of long word sequences.

Documents meet on winnowed anchors: every window of `length` words picks one gram of words as
its seed, the same one wherever the window occurs. At a seed all documents that share it are
extended together, to the left and to the right: with every word of distance those that still
agree stay in one class. A window is repeated where its left and right classes both meet those
of another occurrence; stretches of repeated windows merge into maximal repeats, of which the
first in the order of ids stays.

Defined results: a null text has no words; texts shorter than `length` words lose nothing;
rows with equal id and text are one document and get equal results; null ids come first;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from promptgov.llm.repeats import Hasher, Spec, U, covered, mixed, repeated_windows, sources, with_spans


def word_units(text: bytes) -> np.ndarray:
    """A 64-bit number for each word; words end at ASCII white space."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], U)


def extended(units: list[np.ndarray], run, offset, group, distance, length: int) -> np.ndarray:
    """Number the windows by seed, distance, and what lies left and right of the seed's place."""
    size = np.array([len(u) for u in units])
    begin = (np.cumsum(size) - size)[run] + offset
    hasher = Hasher()
    sums = hasher.sums(np.concatenate(units))
    left = hasher.of(sums, begin, begin + distance)
    right = hasher.of(sums, begin + distance, begin + length)
    return mixed(left ^ mixed(right ^ mixed((group.astype(U) << U(32)) | distance.astype(U))))


def spec_for(length: int, gram: int, earlier: bool = True) -> Spec:
    def names(units, run, offset, group, distance):
        return extended(units, run, offset, group, distance, length)
    return Spec(length, gram, word_units, lambda units: units, names, U, earlier)


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def repeated_words(
    documents: DataFrame, length: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: its words, those removed, a digest of the rest, and the removed runs of words."""
    if not 1 <= gram < length:
        raise ValueError("gram must be below length")
    spec = spec_for(length, gram)
    texts = sources(documents, id_col, text_col)

    def one(text, spans):
        words = text.split()
        cuts = covered(spans, length, len(words))
        kept, at = [], 0
        for a, b in cuts:
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), cuts

    return with_spans(texts, repeated_windows(texts, spec), FIELDS, one, id_col)
