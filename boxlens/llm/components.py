"""Connected components of a table of links by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace


def _star(work: Workspace, edges: DataFrame, name: str, large: bool) -> DataFrame:
    """Ties each node's larger (large) or smaller (small) neighbours to the least of them all. The minima are a table of their own, so that both sides of the join are exchanges and a hub's rows can be split."""
    pairs = edges.select("u", "v")
    if large:
        pairs = pairs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = work.write(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    joined = pairs.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return work.write(moved.where("u > v").distinct(), name)


def connected_components(work: Workspace, links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b) that is not the least of its component; root is the least node. No links: no rows. Null ends and links of a node with itself are ignored; repeated links count once."""
    edges = work.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, turn = None, 0
    while True:
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, turn = state, turn + 1
        edges = _star(work, edges, f"large{turn}", True)
        edges = _star(work, edges, f"small{turn}", False)
