"""Connected components by alternating large and small stars (Kiveris et al., 2014), all in DataFrames.

Defined results: a null end of an edge is no node; loops and repeated edges change nothing; a node that is in no edge
but loops is not listed; an empty table gives no rows; other columns are not read. Tables of earlier rounds are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.repeats import salted_join
from ledgerloom.llm.scratch import materialize, remove, scope


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Links the greater (large) or lesser neighbours of each node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), "least", rows)
    linked = salted_join(both, least, ["u"], ["v"])  # a node may have a third of all edges
    moved = (linked.filter(F.col("v") > F.col("u")) if large else linked).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = moved if large else moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component. edges: columns u and v, of any ordered type, in any direction."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    edges = materialize(edges, "edges")
    rows = 2 * edges.count()  # no step makes more
    while True:
        before = edges
        with scope(edges.sparkSession) as keep:
            large = materialize(_star(edges, True, rows), "large", rows)
            edges = keep(materialize(_star(large, False, rows), "small", rows))
        remove(edges.sparkSession, before._scratch_path)
        # Done once all is stars: no node leads to two others, and none that leads to another is led to.
        ends = edges.select(
            F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leads")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leads")))).alias("e")
        ).select("e.*")
        open_nodes = ends.groupBy("node").agg(F.sum("leads").alias("leads"), F.count("*").alias("n")).filter("leads > 1 or (leads = 1 and n > 1)")
        if open_nodes.isEmpty():
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
