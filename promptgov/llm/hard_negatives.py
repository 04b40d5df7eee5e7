"""Hard-negative mining with exact integer scores by residue-number-system matrix products.

Vectors become integers. A product of an integer matrix of rows with one of anchors is taken
modulo several small primes: the residues, centred about zero, are so small that a float32 product
of them is exact. The Chinese remainder theorem, by mixed radix with centred digits, gives the
signed score back exactly; as many primes are taken as the largest possible score needs.

Anchors are a stated set of queries against all rows. They go in blocks of at most BLOCK_BYTES, and each
block is sent to all tasks, which multiply it with their rows a few thousand at a time. Only the
best few per anchor leave a task; a window over these gives the best of all. A first pass finds
the positives; their scores give the window of scores that a second pass takes negatives from.

Defined results: rows with a null id, label or vector, or with a component that is null or not
finite, take no part; a missing component of a shorter vector counts as zero; rows that share an id are
rows of their own, and of equal scores and ids either may come first; an anchor without positives,
and a positive without negatives, give no rows; other columns are not read; an empty table gives
no rows. Scores that may not fit a long are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptgov.llm.common import cut_lineage

#: Bytes of anchors that are sent at once, and anchors and rows that are multiplied at once.
BLOCK_BYTES, ANCHORS, ROWS = 32 << 20, 1024, 2048
#: Components of a product that is taken at once; more are added up modulo the prime.
DEPTH = 1024
EMPTY = -(1 << 62)


def primes_for(bound: int, depth: int) -> list[int]:
    """The largest primes whose residue products stay exact in float32, enough for scores up to `bound`."""
    half = math.isqrt((1 << 23) // min(depth, DEPTH))
    found, product, p = [], 1, min(2 * half + 1, 2047)
    while product <= 2 * bound + 1:
        if p < 3:
            raise ValueError("no primes left")
        if p % 2 and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 1
    return found


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p - 1) / 2 to (p - 1) / 2; whole numbers of up to 2**23 in float32."""
    x = x - np.float32(p) * np.rint(x * np.float32(1 / p))
    half = (p - 1) // 2
    x -= np.float32(p) * (x > half)
    x += np.float32(p) * (x < -half)
    return x


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The vectors modulo each prime, centred."""
    out = []
    for p in primes:
        r = vectors % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def products(rows: list[np.ndarray], anchors: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact scores of rows and anchors, given by their residues."""
    digits: list[np.ndarray] = []
    score, weight = np.zeros((len(rows[0]), len(anchors[0])), np.int64), 1
    for k, p in enumerate(primes):
        t = np.zeros(score.shape, np.float32)
        for at in range(0, rows[k].shape[1], DEPTH):
            t = centred(t + centred(rows[k][:, at:at + DEPTH] @ anchors[k][:, at:at + DEPTH].T, p), p)
        for q, digit in zip(primes[:k], digits, strict=True):
            inverse = pow(q, -1, p)
            t = centred(centred(t - digit, p) * np.float32(inverse - p * (inverse > p // 2)), p)
        digits.append(t)
        score += t.astype(np.int64) * weight
        weight *= p
    return score


class Best:
    """The k best rows of each slot: the highest scores, ties by the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((slots, k), EMPTY), np.full((slots, k), np.iinfo(np.int64).max)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, at: slice) -> None:
        """A row per candidate and a column per slot of `at`."""
        own_scores, own_ids = self.scores[at], self.ids[at]
        last, last_id = own_scores[:, -1], own_ids[:, -1]
        better = (scores > last) | ((scores == last) & (ids[:, None] < last_id))
        row, slot = np.nonzero(better & allowed)
        touched = np.unique(slot)
        if not len(touched):
            return
        slots = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([scores[row, slot], own_scores[touched].ravel()])
        names = np.concatenate([ids[row], own_ids[touched].ravel()])
        order = np.lexsort((names, -score, slots))
        slots, score, names = slots[order], score[order], names[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = place < self.k
        own_scores[slots[kept], place[kept]], own_ids[slots[kept], place[kept]] = score[kept], names[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores > EMPTY)
        return slot, self.ids[slot, place], self.scores[slot, place]


def matrix(lists: pa.ListArray, dimension: int) -> np.ndarray:
    """Vectors as the rows of a matrix, shorter ones filled up with zeros."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dimension), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def chunks(batches: Iterator[pa.RecordBatch], dimension: int):
    """Rows, few at first, while there is nothing yet that the best have to beat."""
    size = 64
    for batch in batches:
        at = 0
        while at < len(batch):
            part = batch.slice(at, size)
            at, size = at + len(part), min(2 * size, ROWS)
            row, ident, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "label"))
            yield row, ident, label, matrix(part.column("vector"), dimension)


def searcher(sent, primes: list[int], dimension: int, k: int, same: bool):
    """The best k rows of each anchor of a task's rows: of the anchor's label, but not the anchor itself,
    or of other labels within each window of scores. Slots are anchor + position of the window times anchors."""
    schema = pa.schema([("slot", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_rows, labels, anchors, lows, highs = sent.value
        n = len(anchor_rows)
        of_anchors = residues(anchors, primes)
        best = [Best(n, k) for _ in range(1 if same else len(lows))]
        for row, ident, label, vectors in chunks(batches, dimension):
            of_rows = residues(vectors, primes)
            for start in range(0, n, ANCHORS):
                at = slice(start, start + ANCHORS)
                scores = products(of_rows, [r[at] for r in of_anchors], primes)
                alike = label[:, None] == labels[at]
                if same:
                    best[0].offer(scores, ident, alike & (row[:, None] != anchor_rows[at]), at)
                else:
                    for own, low, high in zip(best, lows, highs, strict=True):
                        own.offer(scores, ident, ~alike & (scores >= low[at]) & (scores <= high[at]), at)
        for i, own in enumerate(best):
            slot, ident, score = own.found()
            yield pa.RecordBatch.from_arrays([pa.array(slot + i * n), pa.array(ident), pa.array(score)], schema=schema)

    return run


def integers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, label, vector): the rows that take part, their components times `scale` rounded down."""
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return known.select(
        F.monotonically_increasing_id().alias("row"), "id", "label",
        F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Of what the tasks found the best k per slot, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """The hardest negatives of each anchor and positive.

    Anchors are the rows where `anchor`, a condition on column `id`, holds; their positives are
    the `positives` other rows of the same label with the highest scores. The negatives of a positive are the
    `negatives` rows of other labels with the highest scores from low_percent to high_percent of the
    positive's. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    table = cut_lineage(integers(rows, id_col, label_col, vector_col, scale), "integer-vectors")
    least, most = F.array_min("vector"), F.array_max("vector")
    size = table.agg(
        F.max(F.size("vector")).alias("dimension"), F.max(F.greatest(F.abs(least.cast("double")), F.abs(most.cast("double")))).alias("largest"),
        F.count_if(anchor).alias("anchors")).first()
    dimension = max(size["dimension"] or 0, 1)
    bound = dimension * int(size["largest"] or 0) ** 2
    if bound >= -EMPTY // 100:
        raise ValueError(f"scores of up to {bound} do not fit")
    primes = primes_for(bound, dimension)
    count = -(-size["anchors"] * 8 * dimension // BLOCK_BYTES)
    anchors = table.filter(anchor).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(count, 1))))
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    search = table.select("row", "id", "label", "vector")

    done = None
    for number in range(count):
        block = anchors.filter(F.col("block") == number).select("row", "label", "vector").toArrow()
        n, context = len(block), spark.sparkContext
        if not n:
            continue
        # Plain arrays of a bounded size: rows, labels, vectors, and the scores that negatives lie between.
        sent = [block.column("row").to_numpy(), block.column("label").to_numpy(),
                matrix(block.column("vector").combine_chunks(), dimension), None, None]
        near = search.mapInArrow(
            searcher(context.broadcast(sent), primes, dimension, positives, True), "slot long, id long, score long")
        near = cut_lineage(best_of(near, positives), "positives")
        # At most `positives` rows per anchor of the block: as bounded as the block.
        found = near.toArrow()
        slot, place, score = (found.column(c).to_numpy() for c in ("slot", "rank", "score"))
        low, high = np.ones((positives, n), np.int64), np.zeros((positives, n), np.int64)
        low[place - 1, slot] = -(-low_percent * score // 100)
        high[place - 1, slot] = high_percent * score // 100
        far = search.mapInArrow(
            searcher(context.broadcast([*sent[:3], low, high]), primes, dimension, negatives, False),
            "slot long, id long, score long")
        far = best_of(far, negatives).select(
            (F.col("slot") % n).alias("slot"), (F.floor(F.col("slot") / n) + 1).cast("int").alias("place"),
            "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        numbered = spark.createDataFrame(
            pa.table({"slot": pa.array(np.arange(n)), "row": pa.array(sent[0])}))
        near = near.select("slot", F.col("rank").alias("place"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
        part = far.join(near, ["slot", "place"]).join(numbered, "slot").join(names, "row").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        if count > 1:
            part = cut_lineage(part, "negatives")
        done = part if done is None else done.unionByName(part)
    if done is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return done
