"""Exact repeats of a fixed length across a corpus, found through winnowed anchors.

A text is a sequence of symbols (bytes or words). Every window of `length` symbols picks one
anchor inside it: the rightmost least hash among its grams of `gram` symbols. The choice
depends on the window's content alone, so equal windows have equal anchors at equal places.
Consecutive windows with one anchor are a *run*, and a run is one row of a few numbers:
the corpus is compared by about one row per 150 bytes or 6 words, not by one per window.

1. Anchors that occur once in the corpus drop out (counts combine before the shuffle).
2. Runs with equal anchor and equal surroundings form a class: all their windows agree, so a
   class is one run however many copies there are. Its copies meet by a join that Spark splits
   where it is skewed.
3. Where an anchor has several classes, one run of each brings its surroundings, and windows
   at the same distance from the anchor are compared. Anchors with up to `HOT` classes are
   compared in a task; those with more become rows of window hashes that Spark aggregates.

The result is the set of repeated window starts per text, as intervals. Nothing is capped,
and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.common import as_bytes, cut_lineage, pa_type

#: Classes of one anchor that a task compares at once; more are compared as rows.
HOT = 2048
#: Windows of one text handled at once, and the place numbers that fit beside a hash.
STRETCH, PLACES = 1 << 16, 20
#: Symbols of several anchors' classes that are sorted together.
TOGETHER = 1 << 17

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def give_back() -> None:
    """Workers live on after a task; return what a batch needed to the system."""
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass
class Hasher:
    """Polynomial hashes of any stretches of a sequence, by differences of running sums."""

    up: np.ndarray = field(default_factory=lambda: np.ones(1, U))
    down: np.ndarray = field(default_factory=lambda: np.ones(1, U))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        out = np.zeros(n, U)
        np.cumsum(symbols * self.up[:n - 1], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        """The hash of every gram, more lightly mixed."""
        x = sums[size:] - sums[:-size]
        x *= self.down[:len(x)]
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        return x


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` consecutive ones, in two running minima."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(U).max, U)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


@dataclass(frozen=True)
class Spec:
    """What counts as a repeat. `units` cuts a text into units, `symbols` gives these 64-bit
    codes; `name_windows` numbers the windows of several runs, equal ones alike."""

    length: int
    gram: int
    units: Callable[[bytes], np.ndarray]
    symbols: Callable[[np.ndarray], np.ndarray]
    name_windows: Callable[..., np.ndarray]
    kind: type  # of a unit
    earlier: bool  # only windows with an earlier equal one, or any with another one


def runs(symbols: np.ndarray, spec: Spec, hasher: Hasher) -> list[np.ndarray]:
    """Columns anchor key, class, first start, last start, anchor place, one entry per run."""
    found = []
    windows = len(symbols) - spec.length + 1
    for a in range(0, max(0, windows), STRETCH):
        own = symbols[a:min(windows, a + STRETCH) + spec.length - 1]
        sums = hasher.sums(own)
        grams = np.arange(len(own) - spec.gram + 1)
        key = hasher.grams(sums, spec.gram)
        low = U((1 << PLACES) - 1)
        ranked = (key & ~low) | (low - grams.astype(U))
        at = (low - (least_in(ranked, spec.length - spec.gram + 1) & low)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        at = at[first]
        shape = ((at - first).astype(U) << U(32)) | (last - first).astype(U)
        around = mixed(hasher.of(sums, first, last + spec.length) ^ mixed(shape + U(1)))
        found.append([key[at].view(np.int64), around.view(np.int64), first + a, last + a, at + a])
    if not found:
        return [np.zeros(0, np.int64)] * 5
    return [np.concatenate(c) for c in zip(*found, strict=True)]


RUN = ["key", "around", "first", "last", "at"]


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def sources(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, and a hash that tells texts of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _find_runs(texts: DataFrame, spec: Spec) -> DataFrame:
    schema = T.StructType([*texts.select("id", "h").schema.fields, *_long(*RUN)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [runs(spec.symbols(spec.units(text)), spec, hasher) for text in as_bytes(batch, "text")]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("h").take(pa.array(row)),
                 *[pa.array(c.astype(np.int64)) for c in columns]], names=["id", "h", *RUN])
            del found, columns, row
            give_back()

    return texts.mapInArrow(find, schema)


def packed(texts: DataFrame) -> DataFrame:
    """The texts compressed, as they cross the network twice."""
    schema = T.StructType([*texts.select("id", "h").schema.fields, T.StructField("packed", T.BinaryType())])

    def pack(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"),
                 pa.array([compress(t) for t in as_bytes(batch, "text")], pa.binary())], names=["id", "h", "packed"])
            give_back()

    return texts.mapInArrow(pack, schema)


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(t) for t in as_bytes(batch, "packed"))


def same_text(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])


def _with_surroundings(texts: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """The symbols around one run of each class; texts meet their runs by id and hash."""
    per_text = wanted.groupBy("id", "h").agg(
        F.collect_list(F.struct("key", "copies", "first", "last", "at")).alias("runs"))
    texts = packed(texts)
    met = texts.join(per_text, same_text(texts, per_text)).select(texts["id"], texts["h"], "packed", "runs")
    schema = T.StructType([*texts.select("id", "h").schema.fields,
                           *_long("key", "copies", "first", "last", "at"), T.StructField("units", T.BinaryType())])

    def rows_of(batch, rows, out):
        take = pa.array(rows, pa.int64())
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(take), batch.column("h").take(take),
             *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())],
            names=["id", "h", "key", "copies", "first", "last", "at", "units"])

    def cut(batches):
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(unpacked(batch)):
                units = spec.units(text)
                for r in batch.column("runs")[i].as_py():
                    around = units[r["first"]:r["last"] + spec.length]
                    rows.append(i)
                    out.append((r["key"], r["copies"], r["first"], r["last"], r["at"], around.tobytes()))
                if len(out) > 5_000:
                    yield rows_of(batch, rows, out)
                    rows, out = [], []
            yield rows_of(batch, rows, out)
            del rows, out
            give_back()

    return met.mapInArrow(cut, schema)


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values, ends included."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def repeated(names: np.ndarray, place: np.ndarray, copies: np.ndarray, earlier: bool) -> np.ndarray:
    """Which windows have an equal one: before them in the corpus, or anywhere.

    In the order of (name, place) equal windows are neighbours, and the first of each stretch
    is the earliest.
    """
    order = np.lexsort((place, names))
    name, at = names[order], place[order]
    begins = np.concatenate([[True], name[1:] != name[:-1]])
    least = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
    hit = np.zeros(len(names), bool)
    hit[order] = at > least
    if not earlier:
        ends = np.concatenate([begins[1:], [True]])
        last = np.flatnonzero(ends)
        most = at[last[np.searchsorted(last, np.arange(len(at)))]]
        hit[order] = (at > least) | (at < most)
        hit |= copies > 1
    return hit


def places(table: pa.Table) -> np.ndarray:
    """Numbers in the order of (id, text, anchor); a run that comes twice has one number."""
    order = pc.sort_indices(table, [(c, "ascending") for c in ("id", "h", "at")], null_placement="at_start").to_numpy()
    code = pc.fill_null(table.column("id").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    h, at = table.column("h").to_numpy(), table.column("at").to_numpy()
    new = np.zeros(len(order), np.int64)
    for column in (code, h, at):
        new[1:] |= column[order][1:] != column[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _compare(surrounded: DataFrame, spec: Spec) -> DataFrame:
    """Repeated windows of the runs that stand for their classes, anchor by anchor."""
    schema = T.StructType([*surrounded.select("id", "h").schema.fields, *_long("first", "last")])
    names = ["id", "h", "first", "last"]

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.get_total_buffer_size() < 1 << 20:
                continue
            keys = held.column("key").to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            yield from answer(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
            give_back()
        if held is not None:
            yield from answer(held)

    def answer(table):
        """Whole anchors, some at a time."""
        if not table.num_rows:
            return
        keys = table.column("key").to_numpy()
        ends = np.concatenate([np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        size, start = np.cumsum([len(s) for s in table.column("units").to_pylist()]), 0
        for i, end in enumerate(ends):
            if i + 1 == len(ends) or size[ends[i + 1] - 1] - (size[start - 1] if start else 0) > TOGETHER:
                yield one(table.slice(start, end - start))
                start = end

    def one(table):
        table = table.combine_chunks()
        first, last, at, copies, keys = (table.column(c).to_numpy() for c in ("first", "last", "at", "copies", "key"))
        place = places(table)
        units = [np.frombuffer(s, spec.kind) for s in table.column("units").to_pylist()]
        count = last - first + 1
        run = np.repeat(np.arange(len(first)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        group = np.unique(keys, return_inverse=True)[1][run]
        # Windows are equal only at the same distance from the same anchor.
        distance = (at - first)[run] - offset
        name = spec.name_windows(units, run, offset, group, distance)
        hit = repeated(name, place[run], copies[run], spec.earlier)
        rows, spans = [], []
        for i, (a, b) in enumerate(zip(np.cumsum(count) - count, np.cumsum(count), strict=True)):
            for s, e in intervals(hit[a:b]):
                rows.append(i)
                spans.append((s + first[i], e + first[i]))
        take = pa.array(rows, pa.int64())
        columns = list(zip(*spans, strict=True)) if spans else [(), ()]
        return pa.RecordBatch.from_arrays(
            [table.column("id").combine_chunks().take(take), table.column("h").combine_chunks().take(take),
             *[pa.array(c, pa.int64()) for c in columns]], names=names)

    dealt = surrounded.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, schema)


def _compare_as_rows(surrounded: DataFrame, spec: Spec) -> DataFrame:
    """The same for anchors of very many classes: each window is a row, and Spark aggregates."""
    schema = T.StructType([*surrounded.select("id", "h").schema.fields, *_long("key", "start", "distance", "window")])

    def spread(batches):
        hasher = Hasher()
        for batch in batches:
            first, at = (batch.column(c).to_numpy() for c in ("first", "at"))
            for i, stored in enumerate(batch.column("units").to_pylist()):
                sums = hasher.sums(spec.symbols(np.frombuffer(stored, spec.kind)))
                starts = np.arange(len(sums) - spec.length)
                window = hasher.of(sums, starts, starts + spec.length).view(np.int64)
                take = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in ("id", "h", "key")], pa.array(starts + first[i]),
                     pa.array(at[i] - first[i] - starts), pa.array(window)],
                    names=["id", "h", "key", "start", "distance", "window"])

    rows = surrounded.mapInArrow(spread, schema)
    same = ["key", "distance", "window"]
    place = F.struct("id", "h", "start")
    found = rows.groupBy(*same).agg(F.min(place).alias("__least"), F.max(place).alias("__most"))
    hit = rows.join(found.filter("__least <> __most"), same)
    if spec.earlier:
        hit = hit.filter(place > F.col("__least"))
    return hit.select("id", "h", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_windows(texts: DataFrame, spec: Spec, hot: int = HOT) -> DataFrame:
    """(id, h, first, last): starts of repeated windows, as intervals, for texts of `sources()`."""
    every = cut_lineage(_find_runs(texts, spec), "runs")
    # A table of its own: Spark splits a skewed join only where no aggregate shares its stage.
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = cut_lineage(shared, "shared-keys")
    some = cut_lineage(every.join(shared, "key", "left_semi"), "shared-runs")
    # What lies around a run holds its anchor, so it names the class; the tables of shared runs
    # lie by anchor, so most copies meet before this shuffle.
    place = F.struct("id", "h", "first")
    classes = cut_lineage(some.groupBy("around").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("id", "h", "first", "last", "at")).alias("head")), "classes")

    # Copies of a class: all of its runs, or all but the first in the corpus.
    copied = classes.filter("copies > 1").select("around", F.struct("head.id", "head.h", "head.first").alias("__head"))
    whole = some.join(copied, "around")
    if spec.earlier:
        whole = whole.filter(~place.eqNullSafe(F.col("__head")))
    result = whole.select("id", "h", "first", "last")

    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    apart = cut_lineage(classes.join(several, "key").select("key", "copies", "n", "head.*"), "apart")
    result = result.unionByName(_compare(_with_surroundings(texts, apart.filter(F.col("n") <= hot), spec), spec))
    crowded = apart.filter(F.col("n") > hot)
    if not crowded.isEmpty():
        result = result.unionByName(_compare_as_rows(_with_surroundings(texts, crowded, spec), spec))
    return result


def covered(spans: list[tuple[int, int]], length: int, n: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of the n symbols that windows starting in `spans` cover."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, min(b, n)) for a, b in out]


def with_spans(texts: DataFrame, windows: DataFrame, fields: list[T.StructField], one, id_col: str) -> DataFrame:
    """`one(text, spans)` for every text, where spans are the starts of its repeated windows."""
    per_text = windows.groupBy("id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    texts = packed(texts)
    met = texts.join(per_text, same_text(texts, per_text), "left").select(texts["id"], "packed", "spans")
    types = [pa_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(unpacked(batch)):
                spans = batch.column("spans")[i].as_py() or []
                rows.append(one(text, [(s["first"], s["last"]) for s in spans]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=[id_col, *[f.name for f in fields]])
            del rows, columns
            give_back()

    id_field = T.StructField(id_col, texts.schema["id"].dataType)
    return met.mapInArrow(run, T.StructType([id_field, *fields]))
