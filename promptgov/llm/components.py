"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgov.llm.common import cut_lineage


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge; the root is the component's least node.

    Alternating large-star and small-star rounds: every node hooks its neighbours onto the
    least of them, which needs a logarithmic number of rounds. Only `min` is computed per
    node, combined before the shuffle, so a hub with millions of neighbours is no group that
    anything has to hold. Each round is written down, which cuts the lineage.
    """
    edges = edges.toDF("u", "v").filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges, label)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small, label)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set that two equal sets share."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftrightunsigned(mixed, 32))).first())
