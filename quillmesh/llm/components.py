"""Connected components of an edge table, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each step replaces edges by stars
around smaller neighbours; the fixed point is one star per component around its
smallest node. A node's minimum is a map-side aggregate joined back (a hot hub is
a skewed join, which adaptive execution splits), never a collected group. Every
step is cut to the shared checkpoint folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        around = edges.union(flipped)
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    linked = around.join(least, F.col("a") == F.col("of"))
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("of").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (long a, b; self-loops and
    repeats allowed) the smallest node it reaches. Nodes without a link to
    another node are left out."""
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    for _ in range(max_steps):
        now = cut(_stars(_stars(now, large=True), large=False))
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == seen or not n:
            break
        seen = (n, total)
    else:
        raise RuntimeError(f"no fixed point after {max_steps} steps")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
