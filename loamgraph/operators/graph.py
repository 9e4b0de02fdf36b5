"""Neighbourhoods and bounded, cycle-safe impact over relations (src, predicate, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, predicate) as walked: down from callee to callers, up the other way, both."""
    up = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "predicate")
    down = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "predicate")
    return {"up": up, "down": down, "both": up.unionByName(down)}[direction]


def impact(edges: DataFrame, seeds: DataFrame, scratch: Scratch, direction: str = "both", depth: int = 3, reach_seeds: bool = False) -> DataFrame:
    """(id, hop, evidence): what is reached within ``depth`` hops, by least hop.

    evidence: sorted predicates of all edges scanned into the node.  Seeds are
    not affected unless ``reach_seeds`` (the form for edges between
    repositories).  Each level joins the frontier with the edges and drops
    what was visited; levels are written, so lineage stays flat.
    """
    # written once: each level reads the edges again, not what they were made of, and a small frontier is sent to them
    walk = scratch.cut(directed(edges, direction).select("a", "b", "predicate"))
    visited = scratch.cut(seeds.select(F.col("id"), F.lit(0).alias("hop")).distinct())
    frontier, scanned = visited, None
    for hop in range(1, depth + 1):
        into = scratch.cut(frontier.select(F.col("id").alias("a")).join(walk, "a").select(F.col("b").alias("id"), "predicate").distinct())
        scanned = into if scanned is None else scanned.unionByName(into)
        fresh = scratch.cut(into.select("id").distinct().join(visited, "id", "left_anti").withColumn("hop", F.lit(hop)), rows=F.count(F.lit(1)))
        if not scratch.seen["rows"]:
            break
        visited, frontier = visited.unionByName(fresh), fresh
    if reach_seeds:
        again = scanned.select("id").join(seeds.select("id"), "id", "left_semi").distinct().withColumn("hop", F.lit(0))
        nodes = visited.filter("hop > 0").unionByName(again)
    else:
        nodes = visited.filter("hop > 0")
    why = scanned.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("evidence"))
    return nodes.join(why, "id").select("id", "hop", "evidence")


def paths(edges: DataFrame, seeds: DataFrame, scratch: Scratch, direction: str = "both", depth: int = 3) -> DataFrame:
    """(id, hops, narrative): of each node within ``depth`` hops one shortest path, as "A --[R]--> B".

    Of several the least text counts; a node is extended once, so a cycle ends.
    """
    walk = scratch.cut(directed(edges, direction).select("a", "b", "predicate"))
    frontier = scratch.cut(seeds.select("id", F.col("id").alias("narrative")).distinct())
    visited, out = frontier.select("id"), None
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("a"), "narrative").join(walk, "a")
        text = F.concat("narrative", F.lit(" --["), "predicate", F.lit("]--> "), "b")
        frontier = scratch.cut(step.select(F.col("b").alias("id"), text.alias("narrative")).groupBy("id").agg(F.min("narrative").alias("narrative")).join(visited, "id", "left_anti"))
        found = frontier.select("id", F.lit(hop).alias("hops"), "narrative")
        out = found if out is None else out.unionByName(found)
        visited = visited.unionByName(frontier.select("id"))
    return out


def level(hop) -> object:
    """DIRECT, INDIRECT or POTENTIAL by hops."""
    return F.when(hop == 1, "DIRECT").when(hop == 2, "INDIRECT").otherwise("POTENTIAL")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, predicate, out_edges, in_edges) of every node."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"), "predicate")
    return sides.groupBy(F.col("x.id").alias("id"), "predicate").agg(F.sum("x.o").alias("out_edges"), F.sum("x.i").alias("in_edges"))


def around(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, side, predicate, other): the edges out of and into each of ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.lit("OUT").alias("side"), "predicate", F.col("dst").alias("other"))
    return out.unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.lit("IN").alias("side"), "predicate", F.col("src").alias("other")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end that is not among ``nodes``, null ends left out."""
    ids = nodes.select("id").distinct()
    lost = lambda end: edges.filter(F.col(end).isNotNull()).join(ids.withColumnRenamed("id", end), end, "left_anti").select("src", "predicate", "dst")
    return lost("src").unionByName(lost("dst")).distinct()
