"""Best-fit packing of tokenised documents into sequences.

A piece takes a vector from a sequence: its tokens, one document, and the square of its
tokens as attention cost. The vector depends on the length alone, so best fit runs over
*counts per length* (at most as many as a sequence has tokens), whatever the size of the
corpus: sequences in the same state form a class, and a length goes to the feasible class
with the best score, as many pieces at once as both have. The outcome is a small plan of
intervals: of the pieces of one length, ranks a to b go to sequences s, s+1, ... at one
offset. Ranks come from a range-sorted table and per-partition counts, so neither the
packing nor the ranking passes the pieces through one task.

Defined results: null and empty texts are one piece with the end token alone; repeated rows
are packed once each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.common import cut_lineage, map_rows
from promptgov.plans.lineage import task_count

PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.BinaryType())]))
#: Words whose ids a task remembers; longer ones are not remembered.
REMEMBERED, LONGEST = 300_000, 64


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults for documents and cost never bind before tokens do."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path} has added tokens that depend on what is around them")
    return {t["content"]: t["id"] for t in added}


def byte_bpe(path: str, end: int = 2, added: dict[str, int] | None = None) -> Callable[[], Callable[[str], np.ndarray]]:
    """Ids of a text under a byte-level BPE rank file, with the end token.

    The pattern never joins a character to the space after it, so the ids of a text are those
    of its words, each with the space before it; a task remembers the words it has met, and encodes
    the new ones of a text together: a token that begins with a space begins a word. Texts
    with runs of white space are encoded whole. `added` tokens inside a text are one id each, and
    what is between them is encoded by itself.
    """
    added = added or {}
    strings = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))

    def load():
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encode = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        begins = np.zeros(max(ranks.values()) + 1, bool)
        begins[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        known: dict[str, bytes] = {}
        cut = re.compile(f"({strings})") if strings else None
        run = re.compile(r" (?:\s|\Z)")

        def plain(text: str) -> bytes:
            if run.search(text):
                return np.array(encode(text), "<u4").tobytes()
            first, *parts = text.split(" ")
            new = list(set(parts).difference(known))
            if new:
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list(set(parts))
                ids = np.array(encode(" " + " ".join(new)), "<u4")
                raw, at = ids.tobytes(), [*(4 * np.flatnonzero(begins[ids])).tolist(), 4 * len(ids)]
                known.update(zip(new, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            out = np.array(encode(first), "<u4").tobytes() + b"".join(map(known.__getitem__, parts))
            for part in new:
                if len(part) >= LONGEST:
                    del known[part]
            return out

        def ids(text: str) -> np.ndarray:
            segments = cut.split(text) if cut else [text]
            out = [plain(segments[0])]
            for token, segment in zip(segments[1::2], segments[2::2], strict=True):
                out += [added[token].to_bytes(4, "little"), plain(segment)]
            return np.frombuffer(b"".join([*out, end.to_bytes(4, "little")]), "<u4")
        return ids
    return load


def pieces(
    documents: DataFrame, tokenizer, size: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """The token pieces of each document: all of `size` tokens but the first, which may be shorter."""
    def load():
        encode = tokenizer()

        def one(text):
            ids = encode(text.decode() if text else "")
            cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
            parts = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            return ([(i, a, len(p) // 4, zlib.crc32(p), p if keep_ids else None)
                     for i, (a, p) in enumerate(zip(cuts, parts, strict=False))],)
        return one

    rows = map_rows(documents, id_col, text_col, [T.StructField("pieces", PIECES)], load)
    rows = rows.select(id_col, F.explode("pieces").alias("p")).select(id_col, "p.*")
    return rows if keep_ids else rows.drop("ids")


def best_fit(counts: dict[int, int], capacity: Capacity = Capacity(), score: str = "norm") -> list[tuple]:
    """Best fit, longest first, over classes of equal sequences.

    Returns (length, first rank, end rank, first sequence, offset): the pieces of that length
    with those ranks go to consecutive sequences at that offset. `score` picks among feasible
    classes: "norm" takes the smallest residual vector after the piece, "dot" the largest
    weighted dot product of the piece with the residual. Both weigh a component by how scarce
    it is: the share of all demand over capacity. No constraint is ever exceeded.
    """
    limit = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    demand = sum(np.array([n, 1.0, float(n) * n]) * c for n, c in counts.items()) / limit if counts else limit
    weight = demand / demand.max()
    plan: list[tuple] = []
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> ranges of sequences
    used = 0
    for length in sorted(counts, reverse=True):
        need, left, rank = (length, 1, length * length), counts[length], 0
        if any(a > b for a, b in zip(need, limit, strict=True)):
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        vector = np.array(need) / limit
        ready: list = []

        def offer(state, ready=ready, need=need, vector=vector):
            if all(a >= b for a, b in zip(state, need, strict=True)):
                residual = np.array(state) / limit
                value = (float(weight @ (residual - vector) ** 2) if score == "norm"
                         else -float(weight @ (residual * vector)))
                heapq.heappush(ready, (value, state))

        for state in classes:
            offer(state)
        while left:
            if ready:
                _, state = heapq.heappop(ready)
                ranges = classes.pop(state, [])
            else:
                state, ranges = tuple(int(x) for x in limit), [(used, used + left)]
                per = min(a // b for a, b in zip(state, need, strict=True))
                ranges = [(used, used + -(-left // max(1, per)))]
                used = ranges[0][1]
            after = tuple(a - b for a, b in zip(state, need, strict=True))
            for at, (a, b) in enumerate(ranges):
                take = min(left, b - a)
                if not take:
                    classes.setdefault(state, []).extend(ranges[at:])
                    break
                plan.append((length, rank, rank + take, a, capacity.tokens - state[0]))
                rank, left = rank + take, left - take
                if after not in classes:
                    offer(after)
                classes.setdefault(after, []).append((a, a + take))
                if take < b - a:
                    classes.setdefault(state, []).append((a + take, b))
        classes = {s: r for s, r in classes.items() if s[0] and s[1] and s[2]}
    return plan


def pack(rows: DataFrame, capacity: Capacity = Capacity(), score: str = "norm", *order: str) -> DataFrame:
    """Add sequence_id and offset to pieces; `order` fixes which piece of a length goes where."""
    spark = rows.sparkSession
    # Range partitioning looks at its input twice; without a table, texts would be tokenised twice.
    ranged = cut_lineage(rows, "unplaced").repartitionByRange(task_count(spark), "length", *order)
    rows = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()), "pieces")
    # One row per partition and length: at most as many per partition as a sequence has tokens.
    counted = rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(totals, capacity, score)

    by_length: dict[int, tuple] = {}
    for length in totals:
        own = sorted(p[1:] for p in plan if p[0] == length)
        by_length[length] = tuple(np.array(c, np.int64) for c in zip(*own, strict=True))
    sent = spark.sparkContext.broadcast(by_length)

    # A partition holds a stretch of the order, so ranks inside it need no further exchange of
    # more than its own rows.
    inside = Window.partitionBy("__part", "length").orderBy(*order, F.xxhash64(*rows.columns))
    ranked = rows.join(counted.drop("n"), ["length", "__part"]).withColumn(
        "__rank", F.col("__before") + F.row_number().over(inside) - 1).drop("__before", "__part")
    out = T.StructType([*ranked.drop("__rank").schema.fields, T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                first, _, base, at = sent.value[int(length)]
                i = np.searchsorted(first, ranks[here], side="right") - 1
                sequence[here], offset[here] = base[i] + ranks[here] - first[i], at[i]
            kept = batch.drop_columns(["__rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)],
                names=[*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, out)
