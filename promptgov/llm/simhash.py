"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a nonzero vector of radius + 1 bits; each nonzero vector v
of that space gives a mask of the positions whose vector has an odd product with v. For any
`radius` positions some v is orthogonal to all their vectors, so two fingerprints that differ
in at most `radius` bits agree entirely under that mask: they meet in one of the
2**(radius+1) - 1 tables, with certainty. Fingerprints alone in all their tables have no
partner and drop out.

The rest are verified without listing pairs: each fingerprint names all points within half
the radius of it. Two fingerprints share such a point exactly if they are within the radius,
so each point links its (at most 65, for radius 2) fingerprints to the least of them.

Defined results: null, empty and wordless texts have fingerprint zero; equal fingerprints are
one class, so copies are never paired; rows with a null id take part, and a component whose
ids are all null has a null component_id; repeated rows stay repeated; texts of any length are read whole,
STRETCH shingles at a time; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.common import cut_lineage, map_rows
from promptgov.llm.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once.
STRETCH = 1 << 15


def fingerprint_of(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, as a signed number. Words end at ASCII white space."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    join, digest, counts, total = b" ".join, xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    if len(words) < shingle:
        grams = iter([words])
    else:
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    while hashes := [digest(join(g), seed) for g, _ in zip(grams, range(STRETCH), strict=False)]:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    field = T.StructField("fp", T.LongType())
    return map_rows(documents, id_col, text_col, [field], lambda: lambda text: (fingerprint_of(text, shingle),))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks(radius: int) -> list[int]:
    """Masks such that any `radius` bit positions are all outside at least one of them."""
    space = range(1, 1 << (radius + 1))
    vector = [1 + i % len(space) for i in range(64)]
    return [signed(sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2)) for v in space]


def flips(distance: int) -> list[int]:
    """All patterns of at most `distance` set bits."""
    return [signed(sum(1 << b for b in bits)) for n in range(distance + 1) for bits in combinations(range(64), n)]


def _each(fp: Column, values: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that join all fingerprints within `radius`; `classes` has distinct `fp`."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    tables = classes.select("fp", F.posexplode(masks).alias("table", "mask")).select(
        "fp", "table", F.col("mask").bitwiseAND(F.col("fp")).alias("key"))
    shared = tables.groupBy("table", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b")
    met = tables.join(shared.select("table", "key"), ["table", "key"], "left_semi").select("fp").distinct()
    near = met.select("fp", F.explode(F.array(*[F.lit(f) for f in flips(radius // 2)])).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    points = near.groupBy("point").agg(F.min("fp").alias("least"), F.collect_list("fp").alias("fps"))
    return points.filter(F.size("fps") > 1).select(
        F.explode("fps").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def near_duplicates(
    documents: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, fp and component_id (the smallest id reachable over fingerprints within `radius`)."""
    found = cut_lineage(fingerprints(documents, shingle, id_col, text_col), "fingerprints")
    classes = cut_lineage(found.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    roots = connected_components(links(classes, radius), "simhash")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return found.join(labels, "fp").select(id_col, "fp", "component_id")


def one_of_each(
    documents: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of each component; columns unchanged.

    It is the row with the least id; rows without an id come last, and of rows with one id that
    whose text has the lowest hash. Rows are numbered and written first, as ids may be null or
    repeated, so of equal rows one stays, too.
    """
    names = documents.columns
    row, key = (unused(names, n) for n in ("__row", "__key"))
    rows = cut_lineage(documents.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    place = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"),
                     F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(row).alias("row"))
    labels = near_duplicates(rows.select(place.alias(key), F.col(text_col).alias("text")), shingle, radius, key, "text")
    firsts = labels.filter(F.col(key) == F.col("component_id")).select(F.col(key)["row"].alias(row))
    return rows.join(firsts, row, "left_semi").select(names)


def unused(names: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    while name in names:
        name += "_"
    return name
