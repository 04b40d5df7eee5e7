"""Secret scan with corpus-wide ownership frequency.

Three kinds of base spans are found by regex in every whole text: assignments, access keys
and hex strings. Beside them, long tokens of mixed letters and digits are candidates. The
values of all of them are counted over the corpus by distinct repositories and owners: a
value that many owners have is a widely copied example, one that few have looks like a live
credential. Candidates that look live are added as spans of kind `owned`; base spans stay
whatever their frequency.

An owner is a `source`, a repository a (`source`, `lang`) pair. Counting goes hash by owner
and repository first, then by hash, each combined before its shuffle, so a value in a third
of all texts is a few rows. No text is shuffled. Positions are code points.

Defined results: null texts are empty; a null source or language is an owner or language of
its own; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.llm.common import cut_lineage

ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))" r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Kind, pattern, the group that holds the value, and the shortest value. Where the pattern
#: is one run of a class, its least length is in the pattern: shorter runs hide nothing.
BASE_KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9_-]{20,}"
#: Values of at most so many owners and repositories look live.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4

SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches with their places.

    The text between matches and the matches themselves come in the same order, so places are
    running sums of their lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")),
                     lambda p: p["whole"].isNotNull())
    none = F.array().cast(SPANS)

    def place(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), place, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), F.filter(found, lambda s: F.length(s["value"]) >= least)).otherwise(none)


def looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def digest(found: Column) -> Column:
    """`kind:start:end`, comma-joined in order of start and kind."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.sort_array(found), line))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         lang_col: str = "lang") -> DataFrame:
    """Per row: base spans and candidates, before anything is known of the corpus."""
    rows = documents.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("lang"))
    rows = rows.withColumns({kind: spans(F.col("text"), pattern, group, least, kind, rank)
                             for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS)})
    rows = rows.withColumn("base", F.concat(*[F.col(kind[0]) for kind in BASE_KINDS]))
    other = spans(F.col("text"), CANDIDATE, 0, 20, "owned", len(BASE_KINDS))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    rows = rows.withColumn("candidates", other).withColumn("candidates", F.filter(
        "candidates", lambda c: looks_random(c["value"]) & apart(c)))
    return rows.select("id", "owner", "lang", *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in BASE_KINDS],
                       "base", "candidates")


def ownership(occurrences: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value hash."""
    per_owner = occurrences.groupBy("hash", "owner").agg(F.collect_set("lang").alias("langs"))
    return per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum(F.size("langs")).alias("n_repositories"))


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 lang_col: str = "lang", max_owners: int = MAX_OWNERS,
                 max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per row: counts and digest of base spans, all spans, and how many values look live or copied."""
    rows = scan(documents, id_col, text_col, owner_col, lang_col)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.select("row", "owner", "lang", F.explode(F.concat("base", "candidates")).alias("span")).select(
        "row", "owner", "lang", "span", F.sha2("span.value", 256).alias("hash"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = each.join(ownership(each), "hash").withColumn("live", live)
    owned = F.when(F.col("live") & (F.col("span.kind") == "owned"), F.col("span"))
    per_row = judged.groupBy("row").agg(
        F.collect_list(owned).alias("added"), F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    everything = F.concat("base", F.coalesce(F.col("added"), F.array().cast(SPANS)))
    zero = F.lit(0).cast("long")
    return rows.join(per_row, "row", "left").select(
        F.col("id").alias(id_col), *[f"n_{k[0]}" for k in BASE_KINDS],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(everything).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
