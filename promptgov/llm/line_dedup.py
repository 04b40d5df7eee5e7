"""Line dedup by a segment-partition edit join.

Two lines within `edits` edits: if one is cut into edits + 1 segments, at least one segment
survives in the other, near its place. Every line therefore puts its segments into an index
under its length, and looks up the substrings of its own that could be a segment of a line of
its length or up to `edits` shorter, at the few starts that are possible for each segment.
Pairs that meet are verified by edit distance inside the band of 2 * edits + 1 diagonals, whose
column of differences is one number that a few bit operations move along (so the length of
the lines does not matter).

Equal lines are one class from the start: a line that a third of all documents repeat is one
entry of the index. A line goes if an equal line or one within the distance comes earlier, in
the order of (id, line number). `every_line` compares all lines that are not blank, `line_join` those of
`least` code points or more, and `drop_lines` spares the shorter ones.

Only built-in expressions are used.

Defined results: null and empty texts have one empty line, which stays; null ids come first;
in `line_join` rows that share an id keep lines apart by number only, so of two equal lines with
one id and number both stay; `drop_lines` tells all rows apart, whatever their ids, and orders
rows of one id by the hash of their text; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.llm.common import cut_and_free, cut_lineage

EDITS, LEAST = 2, 40
#: Letters whose counts are compared before texts are; any would do.
LETTERS = "etaonihrsdlucmgpbf"
#: So many hashes of lines may be sent to every executor (16 MB); more are joined by a shuffle.
SENT_LINES = 1_000_000


def lines_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, no, line, a, b): the lines of at least `least` code points, with two hashes of each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    rows = rows.withColumn("size", F.length("line")).filter(F.col("size") >= least)
    return rows.withColumns({"a": F.xxhash64("line"), "b": F.hash("line")})


def segment(i: Column, parts: int, shorter: Column) -> tuple[Column, Column]:
    """Start and length of part i of `size - shorter` characters; the last parts take what is left over."""
    whole = F.col("size") - shorter
    rest = whole % parts
    base = ((whole - rest) / parts).cast("int")
    extra = lambda k: F.greatest(F.lit(0), k - parts + rest)
    return base * i + extra(i), base + extra(i + 1) - extra(i)


def index_places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, shift) of a line's own segments."""
    return [(0, i, 0) for i in range(edits + 1)]


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """Where a line may hold segment i of a line `shorter` characters shorter.

    Left of segment i there can be at most i edits, right of it at most edits - i, or an
    earlier segment survives; this bounds its shift on both sides.
    """
    return [(shorter, i, shift) for shorter in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)]


def keyed(classes: DataFrame, edits: int, places: list[tuple[int, int, int]], name: str, bits: str) -> DataFrame:
    """(name, bits, key): a row per line and place, with the hash of what stands there.

    The places are exploded first and hold for all lines, so one short expression makes every key:
    an array with an expression per place is more code than the JVM compiles.
    """
    place = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("shorter", "i", "shift"), p, strict=True)]) for p in places])
    rows = classes.select("a", "line", "size", sketch(edits).alias(bits), F.explode(place).alias("p"))
    start, length = segment(F.col("p.i"), edits + 1, F.col("p.shorter"))
    at = start + F.col("p.shift")
    key = F.xxhash64(F.col("size") - F.col("p.shorter"), F.col("p.i"), F.substring("line", at + 1, length))
    return rows.filter((at >= 0) & (at + length <= F.col("size"))).select(F.col("a").alias(name), bits, key.alias("key"))


def parities(line: Column) -> Column:
    """One bit for each of LETTERS: whether the line has an odd number of it. An edit turns at most two.

    Each letter is counted by taking it away from what the ones before have left.
    """
    bits, left = [], line
    for i, letter in enumerate(LETTERS):
        rest = F.replace(left, F.lit(letter), F.lit(""))
        bits.append((F.octet_length(left) - F.octet_length(rest)) % 2 * (1 << i))
        left = rest
    return sum(bits[1:], bits[0])


def sketch(edits: int) -> Column:
    """The parities, and above them the length modulo edits + 1, which tells equal lengths among near ones."""
    return F.col("parities") + F.shiftleft((F.col("size") % (edits + 1)).cast("long"), len(LETTERS))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def band_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of x and y where it is at most `edits`, else a larger number.

    Column j of the table of distances is held from row j - edits to row j + edits as two
    sets of bits, where the distance grows or falls by one from row to row; the frame moves
    down by one with each column. The distance is followed along the lowest diagonal to the
    last row, then along that row. Both lines must be longer than `edits`, and their lengths
    at most `edits` apart.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    xs, ys = F.split(x, ""), F.split(y, "")
    m, n = F.length(x), F.length(y)

    def matches(xs: Column, ys: Column) -> Column:
        row = lambda j, b: F.get(xs, (j - edits + b - 1).cast("int"))
        bit = lambda j, c, b: F.when(row(j, b) == c, F.lit(1 << b)).otherwise(0)
        return F.transform(ys, lambda c, j: sum((bit(j + 1, c, b) for b in range(1, width)), bit(j + 1, c, 0)))

    def turn(value: Column) -> Column:
        return F.lit(full) - value.bitwiseAND(F.lit(full))

    def column(acc: Column, item: Column) -> Column:
        vp, vn, j, same = acc["vp"], acc["vn"], acc["j"] + 1, item
        zero = (same.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(same).bitwiseOR(vn).bitwiseAND(F.lit(full))

        def step(d0: Column) -> Column:
            hp, hn = vn.bitwiseOR(turn(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            return bind(F.struct(d0.alias("d0"), hp.alias("hp"), hn.alias("hn")), move)

        def move(s: Column) -> Column:
            half = F.shiftright(s["d0"], 1)
            at = m - j + edits  # the bit of the last row
            diagonal = F.when(s["d0"].bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
            here = lambda v: v.bitwiseAND(F.element_at(powers, (at + 1).cast("int")))
            along = F.when(here(s["hp"]) != 0, 1).when(here(s["hn"]) != 0, -1).otherwise(0)
            return F.struct(
                s["hn"].bitwiseOR(turn(half.bitwiseOR(s["hp"]))).alias("vp"), half.bitwiseAND(s["hp"]).alias("vn"),
                j.alias("j"), (acc["d"] + F.when(j + edits <= m, diagonal).otherwise(along)).alias("d"))

        return bind(zero, step)

    powers = F.array(*[F.lit(1 << b) for b in range(width)])
    begin = F.struct(F.lit(full - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"),
                     F.lit(0).alias("j"), F.lit(edits).alias("d"))
    done = bind(F.struct(xs.alias("x"), ys.alias("y")), lambda s: F.aggregate(
        matches(s["x"], s["y"]), begin, column, lambda acc: acc["d"]))
    return F.when(F.abs(m - n) > edits, F.lit(edits + 1)).otherwise(done)


def line_classes(lines: DataFrame) -> DataFrame:
    """One row per different line: copies, first place, the line itself and its parities.

    All that depends on the text is computed on this table, once per different line.
    """
    known = lines.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "no", "line")).alias("least"))
    line = F.col("least.line")
    return known.select(
        "a", "b", "copies", F.struct(F.col("least.id").alias("id"), F.col("least.no").alias("no")).alias("first"),
        line.alias("line"), F.length(line).alias("size"), parities(line).alias("parities"))


def line_links(classes: DataFrame, edits: int = EDITS) -> DataFrame:
    """(u, v): hashes of different lines within the distance, each pair once in each direction."""
    index = keyed(classes, edits, index_places(edits), "u", "x")
    probes = keyed(classes, edits, probe_places(edits), "v", "y")
    differ, letters = F.col("x").bitwiseXOR(F.col("y")), (1 << len(LETTERS)) - 1
    alike = F.bit_count(differ.bitwiseAND(F.lit(letters))) <= 2 * edits
    # Lines of equal length find each other both ways, others only from the longer one.
    once = (F.col("u") < F.col("v")) | (differ > letters)
    met = index.join(probes, (index["key"] == probes["key"]) & (F.col("u") != F.col("v")) & once & alike).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    met = cut_and_free(met, "line-pairs")
    # The texts of the few lines that met somebody.
    needed = cut_lineage(met.select(F.col("u").alias("a")).unionByName(
        met.select(F.col("v").alias("a"))).distinct(), "met-lines")
    if needed.count() <= SENT_LINES:
        needed = F.broadcast(needed)
    texts = cut_lineage(classes.select("a", "line").join(needed, "a", "left_semi").dropDuplicates(["a"]), "met-texts")
    pairs = met.join(texts.select(F.col("a").alias("u"), F.col("line").alias("x")), "u").join(
        texts.select(F.col("a").alias("v"), F.col("line").alias("y")), "v")
    # The built-in banded distance is quick to discard; the bit-parallel one decides.
    near = pairs.filter(F.when(F.levenshtein("x", "y", edits) < 0, False).otherwise(
        band_distance(F.col("x"), F.col("y"), edits) <= edits)).select("u", "v")
    near = cut_lineage(near, "line-links")
    return near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))


def line_join(
    documents: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per line of at least `least` code points, with its class, links and fate.

    The class is named by the place of its first copy; n_links counts the different lines
    within `edits`; removed tells whether an equal or linked line comes earlier.
    """
    lines = lines_of(documents, id_col, text_col, least)
    classes = cut_and_free(line_classes(lines), "line-classes")
    return fates(lines, classes, line_links(classes, edits), id_col).drop("copies")


def fates(lines: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    firsts = classes.select(F.col("a").alias("v"), F.col("first").alias("other"))
    linked = links.join(firsts, "v").groupBy("u").agg(
        F.count(F.lit(1)).alias("n_links"), F.min("other").alias("other"))
    known = classes.select("a", "b", "copies", "first").join(linked, F.col("a") == F.col("u"), "left").select(
        "a", "b", "copies", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.least("first", "other").alias("earliest"))
    return lines.drop("line", "size").join(known, ["a", "b"]).select(
        F.col("id").alias(id_col), F.col("no").alias("line_no"), F.col("first.id").alias("class_doc_id"),
        F.col("first.no").alias("class_line_no"), "copies", "n_links",
        (F.struct("id", "no") > F.col("earliest")).alias("removed"))


def every_line(
    documents: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per line that is not blank, with its class, its number of copies, links and fate.

    The edits allowed fall with the length: `edits` between lines of at least `least` code points,
    half as many from half that length on, none below, where a class is all there is.
    """
    lines = lines_of(documents, id_col, text_col, 1).filter(F.col("line").rlike(r"\S"))
    classes = cut_and_free(line_classes(lines), "line-classes")
    # A line of just `least` code points meets shorter ones with their edits, too.
    long_, middle = classes.filter(F.col("size") >= least), classes.filter(F.col("size").between(least // 2, least))
    links = None
    for some, allowed in ((long_, edits), (middle, edits // 2)):
        if allowed:
            near = line_links(some, allowed)
            links = near if links is None else links.unionByName(near).distinct()
    if links is None:
        links = classes.select(F.col("a").alias("u"), F.col("a").alias("v")).filter("false")
    return fates(lines, classes, links, id_col)


def drop_lines(
    documents: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents without removed lines; other columns unchanged.

    A document all of whose lines are copies keeps its row, with an empty text; a null text
    stays null. Rows are numbered and written first, as ids may be null or repeated.
    """
    names = documents.columns
    rows = cut_lineage(documents.withColumn("__row", F.monotonically_increasing_id()), "line-rows")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col("__row").alias("row"))
    gone = line_join(rows.select(key.alias("__id"), F.col(text_col).alias("__text")),
                     edits, least, "__id", "__text").filter("removed")
    gone = gone.groupBy(F.col("__id.row").alias("__row")).agg(F.collect_set("line_no").alias("__gone"))
    met = rows.join(gone, "__row", "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains("__gone", i) | (F.length(line) < least))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return met.withColumn(text_col, text).select(names)
