"""Parent-child links to full hierarchies: roots, depths, paths, descendants, cycles.

Two forms of the frontier join:

* ``forest`` is for hierarchies of any depth (commit histories have chains of
  thousands of nodes).  Its frontier advances by powers of two: every open node
  holds a pointer to the ancestor 2^k levels up and joins the state of that
  ancestor, so a chain of n levels takes log2(n) joins instead of n.
* ``closure`` also doubles its reach, and carries full paths and ancestor
  pairs, for trees (directories) where those are small.

Each round is written to the shared folder, so lineage never grows and a lost
executor costs one round's tasks.  Nodes are unique by key, so the joins'
build side has one row a key; many nodes that share one ancestor are a skewed
probe side, which the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch


def numbered_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, p): the nodes with a number each, and their parents' numbers.

    Rounds join numbers of eight bytes instead of ids of any length, which is
    most of what they would shuffle and sort.  The numbers are written once, so
    they stay the same however often a task runs again.
    """
    base = scratch.cut(nodes.select("id", "parent").withColumn("n", F.monotonically_increasing_id()))
    return scratch.cut(base.join(base.select(F.col("id").alias("parent"), F.col("n").alias("p")), "parent", "left").select("id", "n", "p"))


def forest(nodes: DataFrame, scratch: Scratch, sizes: bool = False) -> DataFrame:
    """Root, depth and cycle flag of each node.

    ``nodes``: id string (unique, not null), parent string (null for a root;
    each other parent must be an id).  Result: id, root_id, node_depth long,
    on_cycle long.  Nodes on or below a cycle have root_id '' and
    node_depth -1.  With ``sizes``, also size: nodes in the subtree, itself
    included (not defined on cycles).  An empty input gives an empty result.
    """
    links = numbered_links(nodes, scratch)
    found = scratch.cut(jumps(links.select(F.col("n").alias("id"), F.col("p").alias("parent")), scratch, sizes)).withColumnsRenamed({"id": "n", "root_id": "root"})
    roots = links.filter("p is null").select(F.col("n").alias("root"), F.col("id").alias("root_id"))
    named = links.select("id", "n").join(found, "n").join(roots, "root", "left")
    return named.select("id", F.coalesce("root_id", F.lit("")).alias("root_id"), "node_depth", *(["size"] if sizes else []), "on_cycle")


def jumps(nodes: DataFrame, scratch: Scratch, sizes: bool = False) -> DataFrame:
    """``forest`` on ids of any type; root_id is null where there is none.

    A round in which no node finishes means that no depth in its range is
    taken; depths have no gaps, so all nodes still open reach a cycle.
    """
    id_type = nodes.schema["id"].dataType
    start = nodes.select(
        "id",
        F.col("parent").alias("ptr"),
        F.when(F.col("parent").isNull(), F.col("id")).alias("root_id"),
        F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("dist"),
        *([F.lit(1).cast("long").alias("size")] if sizes else []),
    )
    still = F.count(F.when(F.col("ptr").isNotNull(), 1))
    state = scratch.cut(start, left=still)
    pieces: list[DataFrame] = []  # finished nodes by round, when sizes aren't asked for
    before = scratch.seen["left"]
    while True:
        held = state
        if sizes:
            state = _add_sizes(state)
        opened = state.filter("ptr is not null")
        to = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("up"), F.col("root_id").alias("up_root"), F.col("dist").alias("up_dist"))
        if pieces:
            for p in pieces:
                to = to.unionByName(p.select(F.col("id").alias("ptr"), F.lit(None).cast(id_type).alias("up"), F.col("root_id").alias("up_root"), F.col("dist").alias("up_dist")))
        stepped = opened.join(to, "ptr").select("id", F.col("up").alias("ptr"), F.col("up_root").alias("root_id"), (F.col("dist") + F.col("up_dist")).alias("dist"), *(["size"] if sizes else []))
        done = state.filter("ptr is null")
        nxt = scratch.cut(stepped if not sizes else stepped.unionByName(done), left=still)
        left = scratch.seen["left"]
        finished, before = before - left, left
        if sizes:
            scratch.drop(held)
        else:
            pieces.append(done)
        state = nxt
        if left == 0 or finished == 0:
            break
    whole = state
    for p in pieces:
        whole = whole.unionByName(p)
    cyclic = _cycle_nodes(whole.filter("ptr is not null").select("id", "ptr"), scratch) if left else None
    out = whole.select(
        "id",
        F.when(F.col("ptr").isNull(), F.col("root_id")).alias("root_id"),
        F.when(F.col("ptr").isNull(), F.col("dist")).otherwise(F.lit(-1)).cast("long").alias("node_depth"),
        *([F.col("size")] if sizes else []),
    )
    if cyclic is None:
        return out.withColumn("on_cycle", F.lit(0).cast("long"))
    marks = cyclic.select("id", F.lit(1).cast("long").alias("on_cycle"))
    return out.join(marks, "id", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(0).cast("long")))


def levels(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``forest``, level by level: the frontier starts with the roots and joins their children.

    One job a level, so it is for shallow trees; ``forest`` takes the logarithm
    of the depth.  What the frontier never reaches lies on or below a cycle.
    """
    links = scratch.cut(nodes.select("id", "parent"))
    frontier = scratch.cut(links.filter("parent is null").select("id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("node_depth")), rows=F.count(F.lit(1)))
    reached = frontier
    children = links.filter("parent is not null")
    while scratch.seen["rows"]:
        up = frontier.select(F.col("id").alias("parent"), "root_id", (F.col("node_depth") + 1).alias("node_depth"))
        frontier = scratch.cut(children.join(up, "parent").select("id", "root_id", "node_depth"), rows=F.count(F.lit(1)))
        reached = reached.unionByName(frontier)
    lost = scratch.cut(children.join(reached.select("id"), "id", "left_anti"))
    out = reached.withColumn("on_cycle", F.lit(0).cast("long"))
    if lost.isEmpty():
        return out
    marks = _cycle_nodes(lost.select("id", F.col("parent").alias("ptr")), scratch).withColumn("on_cycle", F.lit(1).cast("long"))
    bad = lost.join(marks, "id", "left").select("id", F.lit("").alias("root_id"), F.lit(-1).cast("long").alias("node_depth"), F.coalesce("on_cycle", F.lit(0).cast("long")).alias("on_cycle"))
    return out.unionByName(bad)


def _add_sizes(state: DataFrame) -> DataFrame:
    """Adds to each node the sizes collected by the nodes 2^k levels below it."""
    below = state.filter("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
    return state.join(below, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")


def _cycle_nodes(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes on cycles, of nodes that all reach one.

    The images of all nodes under ever longer jumps shrink to the cycles; when
    doubling the jump no longer shrinks them, the jump is a bijection of them,
    so each lies on a cycle.
    """
    links = scratch.cut(links)
    count = links.select("ptr").distinct().count()
    while True:
        links = scratch.cut(links.join(links.select(F.col("id").alias("ptr"), F.col("ptr").alias("up")), "ptr").select("id", F.col("up").alias("ptr")))
        now = links.select("ptr").distinct().count()
        if now == count:
            return scratch.cut(links.select(F.col("ptr").alias("id")).distinct())
        count = now


def closure(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Full paths and ancestor pairs, of trees of any depth.

    ``nodes``: id, parent as in ``forest``, label string.  Results:
    (id, root_id, node_depth, full_path) with the labels from the root joined
    by '/', and (ancestor_id, id, distance), the latter without the node itself.
    Nodes on or below a cycle: path null, depth -1.

    As in ``forest`` each round doubles the reach and ends by the same rule.
    """
    up = F.col("parent").isNull()
    still = F.count(F.when(F.col("ptr").isNotNull(), 1))
    state = scratch.cut(nodes.select("id", F.col("parent").alias("ptr"), F.when(up, F.col("id")).alias("root_id"), F.col("label").alias("full_path"), F.when(up, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("above")), left=still)
    left, reached = scratch.seen["left"], state.filter("ptr is null")
    while left:
        whole = state.filter("ptr is not null").unionByName(reached)
        to = whole.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("root_id").alias("up_root"), F.col("full_path").alias("up_path"), F.col("above").alias("up_above"))
        state = scratch.cut(state.filter("ptr is not null").join(to, "ptr").select("id", F.col("next").alias("ptr"), F.col("up_root").alias("root_id"), F.concat_ws("/", "up_path", "full_path").alias("full_path"), F.concat("above", "up_above").alias("above")), left=still)
        before, left = left, scratch.seen["left"]
        reached = reached.unionByName(state.filter("ptr is null"))
        if left == before:
            break
    lost = state.filter("ptr is not null").select("id", F.lit("").alias("root_id"), F.lit(-1).cast("long").alias("node_depth"), F.lit(None).cast("string").alias("full_path"))
    pairs = reached.select("id", F.posexplode("above").alias("pos", "ancestor_id")).select("ancestor_id", "id", (F.col("pos") + 1).cast("long").alias("distance"))
    return reached.select("id", "root_id", F.size("above").cast("long").alias("node_depth"), "full_path").unionByName(lost), pairs
