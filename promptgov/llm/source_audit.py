"""Source divergence audit: how far the words of each source of a language are from its others'.

Counting takes two passes over the texts. The first counts in how many documents each term
occurs, exactly, and keeps the terms of a language that are frequent enough. The kept terms of a
language are dealt into shards, each with a minimal perfect hash that stores its keys. The hashes are
sent to all tasks, as many at once as ROUND_BYTES hold, and the second pass recounts the texts: a
term's slot, verified against the stored key, is a place in an array of its group (language and source).
The slots of a
shard are cut into stretches so narrow that all sources of the language fit into CELLS. Only slots with counts leave
a task, as a row of two packed arrays per group and stretch.

Frequencies are then compared dense, with a count for every source and kept term: each stretch adds up what the tasks
counted and its part of every pair of sources. Of single terms each stretch passes on the best per source.

All arithmetic is exact: a share is a whole number of billionths, and divisions go digit by digit.

Defined results: null texts, languages and sources are empty ones; a group without terms has shares like any
other; a language without kept terms gives pairs with value 0; repeated rows count each; equal values
are ranked by the item's bytes; documents of any length are counted stretch by stretch; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptgov.llm.common import as_bytes, cut_lineage
from promptgov.llm.perfect_hash import PerfectHash, hashes

BILLION = 1_000_000_000
#: Lower-case terms of letters A to Z and of all that is not ASCII; the rest becomes spaces.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text split at once, and entries counted by name before they are passed on.
STRETCH, ENTRIES = 1 << 20, 500_000
#: Terms and bytes of one shard; bytes of hashes sent at once; slots counted at once in a task.
SHARD_TERMS, SHARD_BYTES, ROUND_BYTES, SLOTS = 1 << 16, 4 << 20, 32 << 20, 8 << 20
#: Frequencies compared at once, and slots that a stretch has at most, as many as two bytes tell apart.
CELLS, WIDEST = 1 << 17, 1 << 16
#: What leaves a task of the second pass.
COUNTED = "lang string, source string, shard long, stretch long, slots binary, counts binary, n long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in stretches that end between terms."""
    at = 0
    while at < len(text):
        piece, size = text[at:at + STRETCH].translate(TERMS), STRETCH
        while at + size < len(text) and (end := piece.rfind(b" ")) < 0:
            size *= 2
            piece = text[at:at + size].translate(TERMS)
        if at + size < len(text):
            piece = piece[:end + 1]
        yield piece.split()
        at += len(piece)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for batch in batches:
        yield from zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                       as_bytes(batch, "text"), strict=True)


def utf8(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents), combined within the task as far as ENTRIES allow."""
    held: dict[str, Counter] = defaultdict(Counter)

    def emit():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), utf8(list(counts)), pa.array(counts.values(), pa.int64())],
                names=["lang", "term", "documents"])
        held.clear()

    since = 0
    for lang, _, text in text_rows(batches):
        own = set()
        for words in terms(text):
            own.update(words)
        held[lang].update(own)
        since += len(own)
        if since >= ENTRIES:
            if sum(map(len, held.values())) >= ENTRIES // 2:
                yield from emit()
            since = 0
    yield from emit()


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term): the terms in at least `least` documents of their language."""
    counted = rows.mapInArrow(document_counts, "lang string, term string, documents long")
    return counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(
        F.col("documents") >= least).select("lang", "term")


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked(slots: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    slot = np.frombuffer(slots, np.uint16)
    return slot, np.frombuffer(counts, f"u{len(counts) // len(slot)}")


def sharded(kept: DataFrame, widths: DataFrame) -> DataFrame:
    """(lang, shards, shard, bytes, hash, keys, width): a perfect hash per shard, its keys in order of slots, and
    the width of its stretches."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD_TERMS), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("long")
    dealt = kept.join(sizes.select("lang", shards.alias("shards")), "lang").withColumn(
        "shard", F.pmod(F.xxhash64("term"), "shards"))

    def build(table: pa.Table) -> pa.Table:
        made = PerfectHash.of(table.column("term").cast(pa.binary()).to_pylist())
        keys, blob = made.keys, pickle.dumps(made.parts())
        return pa.table({
            "lang": table.column("lang")[:1], "shards": table.column("shards")[:1], "shard": table.column("shard")[:1],
            "bytes": pa.array([len(blob) + sum(map(len, keys))], pa.int64()), "hash": pa.array([blob], pa.binary()),
            "keys": pa.array([keys], pa.list_(pa.binary()))})

    return dealt.groupBy("lang", "shards", "shard").applyInArrow(
        build, "lang string, shards long, shard long, bytes long, hash binary, keys array<binary>").join(widths, "lang")


class Recount:
    """Dense counts of a task: per group and shard an array with a place for every slot."""

    def __init__(self, table: pa.Table):
        self.shards: dict[tuple[str, int], PerfectHash] = {}
        self.of_lang: dict[str, int] = {}
        self.width: dict[str, int] = {}
        for lang, shards, shard, blob, keys, width in zip(
                *(table.column(c).to_pylist() for c in ("lang", "shards", "shard", "hash", "keys", "width")), strict=True):
            self.shards[lang, shard] = PerfectHash(keys, *pickle.loads(blob))
            self.of_lang[lang], self.width[lang] = shards, width
        self.dense: dict[tuple[str, str, int], np.ndarray] = {}

    def add(self, lang: str, groups: dict[str, Counter]) -> None:
        """Count the terms of a language's sources; each term is looked up once for all of them."""
        strings = list(set().union(*groups.values()))
        h = hashes(strings)
        # Signed, as Spark sees it, for the number of the shard.
        shard, slot = h.view(np.int64) % self.of_lang[lang], np.full(len(strings), -1)
        for number in np.unique(shard).tolist():
            if (lang, number) in self.shards:  # else of another round
                own = np.flatnonzero(shard == number)
                slot[own] = self.shards[lang, number].slots([strings[i] for i in own], h[own])
        place = dict(zip(strings, range(len(strings)), strict=True))
        for source, counts in groups.items():
            at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            at, n = at[slot[at] >= 0], n[slot[at] >= 0]
            for number in np.unique(shard[at]).tolist():
                key, own = (lang, source, number), shard[at] == number
                if key not in self.dense:
                    self.dense[key] = np.zeros(len(self.shards[lang, number].keys), np.int64)
                # Different strings have different slots.
                self.dense[key][slot[at[own]]] += n[own]

    def full(self) -> bool:
        return sum(map(len, self.dense.values())) >= SLOTS

    def emit(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for (lang, source, shard), counts in self.dense.items():
            width, slot = self.width[lang], np.flatnonzero(counts)
            stretch = slot // width
            cuts = [*np.flatnonzero(np.diff(stretch, prepend=-1)).tolist(), len(slot)]
            slot, n = (slot - stretch * width).astype(np.uint16), counts[slot]
            rows += [(lang, source, shard, int(stretch[a]), slot[a:b].tobytes(), packed(n[a:b]), int(n[a:b].sum()))
                     for a, b in zip(cuts, cuts[1:], strict=False)]
        self.dense = {}
        if rows:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=[field.split()[0] for field in COUNTED.split(", ")])


def recounter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recount, held, since = Recount(sent.value), defaultdict(lambda: defaultdict(Counter)), 0

        def settle():
            for lang, groups in held.items():
                recount.add(lang, groups)
                if recount.full():
                    yield from recount.emit()
            held.clear()

        for lang, source, text in text_rows(batches):
            if lang not in recount.of_lang:
                continue
            for words in terms(text):
                held[lang][source].update(words)
                since += len(words)
                if since >= ENTRIES:
                    if sum(len(counts) for groups in held.values() for counts in groups.values()) >= ENTRIES // 2:
                        yield from settle()
                    since = 0
        yield from settle()
        yield from recount.emit()

    return run


def group_counts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """COUNTED: rows per group and stretch with its slots, their counts and the sum of these; several tasks may
    give the same slots. In rounds of hashes of a bounded size."""
    spark, counted, waiting, size = rows.sparkSession, None, [], 0
    listed = shards.select("lang", "shard", "bytes").orderBy("lang", "shard").collect()
    for at, r in enumerate(listed):
        waiting.append((r.lang, r.shard))
        size += r.bytes
        if at + 1 == len(listed) or size + listed[at + 1].bytes > ROUND_BYTES:
            wanted = spark.createDataFrame(waiting, "lang string, shard long")
            table = shards.join(F.broadcast(wanted), ["lang", "shard"], "left_semi").toArrow()
            part = cut_lineage(rows.mapInArrow(recounter(spark.sparkContext.broadcast(table)), COUNTED), "group-counts")
            counted = part if counted is None else counted.unionByName(part)
            waiting, size = [], 0
    if counted is None:
        return spark.createDataFrame([], COUNTED)
    return counted


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(BILLION * (counts + 1) / total), by three digits at a time so that nothing overflows."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def stretch_values(top: int):
    """What one stretch of slots adds to each pair of sources, and its best terms per source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals_of, name_of, counts_of = {}, {}, {}
        # The rows of each batch: groups, names of slots, and packed counts, whatever their order.
        for batch in batches:
            for lang, kind, source, slot, n, width, slots, packs in zip(*(batch.column(c).to_pylist() for c in (  # noqa: B007
                    "lang", "kind", "source", "slot", "n", "vocabulary", "slots", "counts")), strict=True):
                if kind == 0:
                    totals_of[source], v = n, width
                elif kind == 1:
                    name_of[slot] = source
                else:
                    if source not in counts_of:
                        counts_of[source] = np.zeros(width, np.int64)
                    at, found = unpacked(slots, packs)
                    counts_of[source][at] += found.astype(np.int64)
        sources, totals = list(totals_of), np.array(list(totals_of.values()), np.int64)
        names = np.array([name_of[slot] for slot in sorted(name_of)], object)
        counts = np.zeros((len(sources), len(names)), np.int64)
        for i, source in enumerate(sources):
            if source in counts_of:
                counts[i] = counts_of.pop(source)[:len(names)]
        p = shares(counts, totals[:, None] + v)
        q = shares(counts.sum(axis=0), np.int64(totals.sum() + v))
        rows: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

        def add(source, part, items, values):
            rows["source"] += [source] * len(items)
            rows["part"] += [part] * len(items)
            rows["item"] += items
            rows["value"] += values

        for i, source in enumerate(sources):
            others = [s for s in sources if s != source]
            sums = distance(p[i], p).sum(axis=1)
            add(source, "pair", others, np.delete(sums, i).tolist())
            own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = distance(p[i][own], q[own])
            encoded = [str(t).encode() for t in names[own]]
            order = sorted(range(len(own)), key=lambda k: (-value[k], encoded[k]))[:top]
            add(source, "term", [names[own[k]] for k in order], [int(value[k]) for k in order])
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(rows["source"]), pa.string()),
            "source": pa.array(rows["source"], pa.string()), "part": pa.array(rows["part"], pa.string()),
            "item": pa.array(rows["item"], pa.string()), "value": pa.array(rows["value"], pa.int64())})

    return run


def source_divergence(
    documents: DataFrame, *, least: int = 3, top: int = 200,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources by their divergence, and the terms that a source
    prefers.

    A share is p = 1 + floor(10**9 (count + 1) / (N + V)) for each of the V terms that occur in at least `least`
    documents of the language; the distance of p from q is floor((p - q)**2 / q). Part `pair` adds the distances of
    the source's shares from those of every other source; part `term` has the `top` terms of the
    source whose share lies farthest above that of the whole language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    named = cut_lineage(rows.select("lang", "source").distinct(), "sources")
    widths = named.groupBy("lang").agg(F.least(F.lit(WIDEST), F.greatest(
        F.lit(1), F.floor(F.lit(CELLS) / F.count(F.lit(1))))).cast("long").alias("width"))
    shards = cut_lineage(sharded(kept_terms(rows, least), widths), "perfect-hashes")
    counts = group_counts(rows, shards)

    sizes = shards.groupBy("lang").agg(F.sum(F.size("keys")).alias("vocabulary"))
    groups = named.join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "vocabulary"), "groups")
    none, zero = F.lit(None), F.lit(0).cast("long")
    bare_counts = (none.cast("binary").alias("slots"), none.cast("binary").alias("counts"))

    # Three kinds of rows per stretch: 0 its groups, 1 the names of its slots, 2 the packed counts with its width.
    names = shards.select("lang", "shard", "width", F.posexplode("keys").alias("slot", "key")).select(
        "lang", "shard", F.floor(F.col("slot") / F.col("width")).alias("stretch"), F.lit(1).alias("kind"),
        F.col("key").cast("string").alias("source"), F.col("slot").cast("long").alias("slot"), zero.alias("n"),
        none.cast("long").alias("vocabulary"), *bare_counts)
    found = counts.join(widths, "lang").select(
        "lang", "shard", "stretch", F.lit(2).alias("kind"), "source", zero.alias("slot"), zero.alias("n"),
        F.col("width").alias("vocabulary"), "slots", "counts")
    stretches = shards.select("lang", "shard", F.explode(F.sequence(
        zero, F.floor((F.size("keys") - 1) / F.col("width")))).alias("stretch"))
    every = stretches.join(groups, "lang").select(
        "lang", "shard", "stretch", F.lit(0).alias("kind"), "source", zero.alias("slot"), "n", "vocabulary", *bare_counts)
    values = every.unionByName(names).unionByName(found).groupBy("lang", "shard", "stretch").applyInArrow(
        stretch_values(top), "lang string, source string, part string, item string, value long")
    values = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))

    bare = groups.filter("vocabulary IS NULL").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = values.unionByName(bare).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
