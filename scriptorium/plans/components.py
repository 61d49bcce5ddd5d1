"""Connected components over an edge table, by alternating star contraction.

Every round is a pair of aggregations with map-side combining and equi-joins,
so a hub with any number of neighbours is only ever a (splittable) join key.
Each round's edges are written to the shared folder; nothing is collected but
whether the edges have settled, which the round's first aggregate tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_stored, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself, and whether the node keeps its component from being a star around its least node."""
    found = _both(edges).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("up"), F.count_if(F.col("v") > F.col("u")).alias("down"))
    loose = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    # stored, so that the join deals both sides anew and a hub's neighbours can be split over tasks
    return stored(found.select("u", F.least("m", "u").alias("m"), loose.alias("loose")), "least")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both(edges).where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # all edges point from the larger end u to the smaller end v here
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Self-edges, repeated edges and either direction are accepted; rows with a
    null end are ignored; no edges give an empty table.
    """
    typed = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    current = stored(typed.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        least = _least(current)
        if least.where("loose").isEmpty():  # no node is loose: the edges have settled
            drop_stored(least)
            break
        after = stored(_small_star(_large_star(current, least).distinct()).distinct(), "edges")
        drop_stored(least)
        drop_stored(current)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merged_components(component: DataFrame, links: DataFrame, src: str, dst: str) -> DataFrame:
    """``component`` (node, component, as :func:`connected_components` gives it) once ``links`` are added.

    Only the least nodes of the components that a link joins are searched, so a
    link costs one edge however large its components are.
    """
    root = component.select(F.col("node").alias("of"), F.col("component").alias("root"))
    ends = links.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    for end in ("a", "b"):
        ends = ends.join(root, ends[end] == root["of"], "left").select(*[F.coalesce("root", c).alias(c) if c == end else F.col(c) for c in ("a", "b")])
    over = stored(connected_components(ends, "a", "b"), "merged")
    up = over.select(F.col("node").alias("of"), F.col("component").alias("to"))
    moved = component.join(up, component["component"] == up["of"], "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(over.join(component.select("node"), "node", "left_anti"))
