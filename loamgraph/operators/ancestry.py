"""All ancestors and descendants of deep trees, in a form as small as the trees.

A history of n commits in one line has n * (n - 1) / 2 ancestor pairs, so they
are not listed.  Each node gets its path as the chains it runs along, at most
log2(n) of them, and its descendants as one interval of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.hierarchy import forest
from loamgraph.operators.intervals import within
from loamgraph.operators.newcommits import chains
from loamgraph.sources.tables import Scratch


def ancestry(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root_id, node_depth, chain, seq, path, first, last) of each node.

    ``nodes``: id, parent as in ``forest``.  ``path``: (chain, seq) from the
    root on; the full path is, for each, the nodes 0 to seq of that chain.
    ``first`` numbers the nodes of a root in preorder from 0: y is below x if
    they have one root and x.first < y.first <= x.last, and the distance is the
    difference of their depths.  On or below a cycle root_id is '', node_depth
    -1, and path, first and last are null.

    Light children are numbered before the heavy one, which takes the last
    numbers of its parent's interval; so along a chain first grows by what size
    loses, and only the chains' first nodes need a round a level.
    """
    whole = scratch.cut(nodes.select("id", "parent").join(forest(nodes.select("id", "parent"), scratch, sizes=True), "id"))
    numbered, ups = chains(nodes, scratch, whole)
    sized = scratch.cut(numbered.join(whole.select("id", "parent", "root_id", "node_depth", "size"), "id"))
    heads = sized.filter("seq = 0 and node_depth >= 0")
    earlier = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    hung = heads.filter("parent is not null").select("chain", "parent", F.col("size").alias("head_size"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    at = hung.join(sized.select(F.col("id").alias("parent"), F.col("size").alias("up_size")), "parent").join(ups, "chain")
    steps = scratch.cut(at.select("chain", "up_chain", "up_seq", "head_size", (F.col("before") + 1 - F.col("up_size")).alias("step")))
    frontier = scratch.cut(heads.filter("parent is null").select("chain", F.col("size").alias("head_size"), F.lit(0).cast("long").alias("start"), F.expr("cast(array() as array<struct<chain: string, seq: bigint>>)").alias("above")))
    levels = [frontier]
    while True:
        up = frontier.select(F.col("chain").alias("up_chain"), F.col("head_size").alias("top_size"), F.col("start").alias("top"), "above")
        frontier = scratch.cut(steps.join(up, "up_chain").select("chain", "head_size", (F.col("top") + F.col("top_size") + F.col("step")).alias("start"), F.concat("above", F.array(F.struct(F.col("up_chain").alias("chain"), F.col("up_seq").alias("seq")))).alias("above")), rows=F.count(F.lit(1)))
        if not scratch.seen["rows"]:
            break
        levels.append(frontier)
    reached = levels[0]
    for x in levels[1:]:
        reached = reached.unionByName(x)
    first = F.col("start") + F.col("head_size") - F.col("size")
    return sized.join(reached, "chain", "left").select("id", "root_id", "node_depth", "chain", "seq", F.concat("above", F.array(F.struct("chain", "seq"))).alias("path"), first.alias("first"), (first + F.col("size") - 1).alias("last"))


def descendants(trees: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of the nodes below ``ancestors`` (id), from what ``ancestry`` gives.

    A node's descendants are one interval of its root's numbers, met block by
    block, so a root with a third of all nodes is spread over its blocks.
    Ancestors on or below a cycle have none.
    """
    asked = trees.filter("first is not null").join(ancestors.select("id").distinct(), "id")
    ranges = asked.select(F.col("root_id").alias("stream"), (F.col("first") + 1).alias("lo"), F.col("last").alias("hi"), F.col("id").alias("ancestor_id"), F.col("node_depth").alias("top"))
    below = trees.filter("first is not null").select(F.col("root_id").alias("stream"), F.col("first").alias("seq"), F.col("id").alias("descendant_id"), "node_depth")
    return within(below, ranges).select("ancestor_id", "descendant_id", (F.col("node_depth") - F.col("top")).alias("distance"))
