"""Connected components of a link table, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.tables import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that links (a, b) reach. Vertices without a link are not listed.

    Alternating star steps: every vertex hangs its larger neighbours, then its smaller ones, on the smallest vertex it
    knows. The number of steps grows with the logarithm of the longest path; a vertex with very many
    links only takes part in minimum aggregates, which combine before the shuffle.

    Before each step the leaves, vertices whose only link is to a smaller one, are set aside with that one. No path needs them and
    none is the smallest of its component, so steps only deal with what is not settled; at the end leaves are named after what they hang on.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    hung = []
    while not edges.isEmpty():
        ends = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count(F.lit(1)).alias("links"), F.min("v").alias("m"))
        hung.append(cut_lineage(ends.where("links = 1 AND m < u").select("u", "m")))
        edges = cut_lineage(edges.join(hung[-1], "u", "left_anti"))
        if edges.isEmpty():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct())
    named = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))  # none are left
    for leaves in reversed(hung):
        above = named.select(F.col("vertex").alias("m"), "component")
        named = cut_lineage(named.unionAll(leaves.join(above, "m", "left").select("u", F.coalesce("component", "m"))))
    return cut_lineage(named.unionAll(named.select("component", "component").distinct()))
