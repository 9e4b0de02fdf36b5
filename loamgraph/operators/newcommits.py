"""Commits that are new in a run, however runs and commits arrive.

Commits are numbered along chains, so that what a run reaches is, for each
chain, the numbers from 0 to some seq.  The ledger keeps the numbering and the
processed intervals of each chain.  A call numbers only commits it has not seen
(a source whose history changed in the past, not at its end, is numbered anew),
takes only runs it has not answered, and gives each the gaps between what it
reaches and what was processed before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.normal import sha_ref, strip_ws
from loamgraph.operators.gitgraph import commit_nodes, resolve_refs
from loamgraph.operators.hierarchy import jumps, numbered_links
from loamgraph.operators.intervals import Ledger, State, merge, numbers, subtract, within
from loamgraph.operators.segments import chunked
from loamgraph.sources.tables import Scratch

NODES = "id string, parent string, source_id string, chain string, seq long"
UPS = "chain string, up_chain string, up_seq long"
INTERVALS = "stream string, lo long, hi long"
ANSWERED = "run_id string"
GIVEN = "run_id string, sha string"


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row a run_id, from the greatest updated_at: source_id, state, finished_at, ref.

    Equal rows are one; ties take the greater remaining fields.
    """
    m = F.max(F.struct("updated_at", F.upper(strip_ws(F.col("status"))).alias("state"), "finished_at", sha_ref(F.col("head_after")).alias("ref"), "source_id")).alias("m")
    return runs.filter("run_id is not null").groupBy("run_id").agg(m).select("run_id", "m.*")


def chains(nodes: DataFrame, scratch: Scratch, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sequence numbers along chains.

    Each node continues the chain of its parent if it is the child with the
    largest subtree there (any of several), so that any path to a root
    meets at most log2(n) chains; other children start chains.  A cycle is cut
    before its smallest node.  Results: (id, chain, seq) and, by chain,
    (chain, up_chain, up_seq): where the chain's first node hangs; a chain is
    named by its first node.  ``whole``: what ``forest`` with sizes gives, if
    that is at hand.
    """
    links = numbered_links(nodes, scratch)
    plain = links.select(F.col("n").alias("id"), F.col("p").alias("parent"))
    if whole is None:
        whole = scratch.cut(plain.join(jumps(plain, scratch, sizes=True), "id"))
    else:
        whole = scratch.cut(links.join(whole.select("id", "size", "on_cycle"), "id").select(F.col("n").alias("id"), F.col("p").alias("parent"), "size", "on_cycle"))
    cyclic = whole.filter("on_cycle = 1").select("id", "parent")
    cuts = _smallest_on_cycle(cyclic, scratch)
    linked = whole.join(cuts.withColumn("cut", F.lit(True)), "id", "left")
    heavy = linked.filter("parent is not null and cut is null").groupBy("parent").agg(F.max(F.struct("on_cycle", "size", "id")).alias("m")).select("parent", F.col("m.id").alias("heavy"))
    linked = linked.select("id", "parent", "cut").join(heavy, "parent", "left")
    goes_on = (F.col("heavy") == F.col("id")) & F.col("cut").isNull()
    linked = scratch.cut(linked.select("id", "parent", F.when(goes_on, F.col("parent")).alias("before")))
    numbered = scratch.cut(jumps(linked.select("id", F.col("before").alias("parent")), scratch).select("id", F.col("root_id").alias("chain"), F.col("node_depth").alias("seq")))
    hang = linked.filter("before is null and parent is not null").select(F.col("id").alias("chain"), "parent")
    ups = hang.join(numbered.select(F.col("id").alias("parent"), F.col("chain").alias("up_chain"), F.col("seq").alias("up_seq")), "parent").drop("parent")
    # a chain is named by its first node, of which there are far fewer than nodes
    heads = linked.filter("before is null").select(F.col("id").alias("n")).join(links.select("n", "id"), "n")
    named = lambda df, c: df.withColumnRenamed(c, "n").join(heads.withColumnRenamed("id", c), "n").drop("n")
    of = named(numbered.withColumnRenamed("id", "k"), "chain").join(links.select(F.col("n").alias("k"), "id"), "k").select("id", "chain", "seq")
    return scratch.cut(of), scratch.cut(named(named(ups, "chain"), "up_chain").select("chain", "up_chain", "up_seq"))


def _smallest_on_cycle(cyclic: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest id of each cycle, by doubling jumps around it.

    When a round lowers none, each stretch's least is at most that of the
    stretch behind it, all around, so all are the cycle's least.
    """
    s = scratch.cut(cyclic.select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")), rows=F.count(F.lit(1)))
    lowered = scratch.seen["rows"]
    while lowered:
        ahead = s.select(F.col("id").alias("ptr"), F.col("ptr").alias("up"), F.col("low").alias("up_low"))
        stepped = s.join(ahead, "ptr").select("id", F.col("up").alias("ptr"), F.least("low", "up_low").alias("low"), (F.col("up_low") < F.col("low")).alias("less"))
        s = scratch.cut(stepped, lowered=F.count(F.when(F.col("less"), 1))).drop("less")
        lowered = scratch.seen["lowered"]
    return s.filter("id = low").select("id")


def _extended(new: DataFrame, old: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, parent, source_id, chain, seq) and (chain, up_chain, up_seq) of new nodes behind numbered ones.

    The longest new chain that hangs on the last node of an old chain continues
    it; other new chains hang where their parent has its number.
    """
    ids = new.select(F.col("id").alias("parent"), F.lit(True).alias("inner"))
    linked = scratch.cut(new.join(ids, "parent", "left").select("id", "parent", "source_id", F.when(F.col("inner"), F.col("parent")).alias("within")))
    numbered, ups = chains(linked.select("id", F.col("within").alias("parent")), scratch)
    places = old.select(F.col("id").alias("parent"), F.col("chain").alias("up_chain"), F.col("seq").alias("up_seq"))
    hung = linked.filter("within is null and parent is not null").select(F.col("id").alias("chain"), "parent").join(places, "parent").select("chain", "up_chain", "up_seq")
    tails = old.groupBy(F.col("chain").alias("up_chain")).agg(F.max("seq").alias("tail"))
    sizes = numbered.groupBy("chain").agg(F.max("seq").alias("last"))
    hung = scratch.cut(hung.join(tails, "up_chain").join(sizes, "chain"))
    goes_on = hung.filter("up_seq = tail").groupBy("up_chain", "tail").agg(F.max(F.struct("last", "chain")).alias("m")).select(F.col("m.chain").alias("chain"), F.col("up_chain").alias("old_chain"), (F.col("tail") + 1).alias("shift"))
    goes_on = scratch.cut(goes_on)
    moved = numbered.join(goes_on, "chain", "left").select("id", F.coalesce("old_chain", "chain").alias("chain"), (F.col("seq") + F.coalesce("shift", F.lit(0))).alias("seq"))
    inner = ups.join(goes_on.withColumnRenamed("chain", "up_chain"), "up_chain", "left").select("chain", F.coalesce("old_chain", "up_chain").alias("up_chain"), (F.col("up_seq") + F.coalesce("shift", F.lit(0))).alias("up_seq"))
    outer = hung.join(goes_on.select("chain"), "chain", "left_anti").select("chain", "up_chain", "up_seq")
    return linked.select("id", "parent", "source_id").join(moved, "id").select("id", "parent", "source_id", "chain", "seq"), inner.unionByName(outer)


def _reach(heads: DataFrame, ups: DataFrame, scratch: Scratch) -> DataFrame:
    """(run_id, at, chain, seq): the last number of each chain that a run reaches."""
    reach = news = heads
    while True:
        more = news.join(ups, "chain").groupBy("run_id", "at", F.col("up_chain").alias("chain")).agg(F.max("up_seq").alias("seq"))
        known = reach.select("run_id", "chain", F.col("seq").alias("had"))
        news = scratch.cut(more.join(known, ["run_id", "chain"], "left").filter("had is null or seq > had").select("run_id", "at", "chain", "seq"), rows=F.count(F.lit(1)))
        if not scratch.seen["rows"]:
            return reach
        reach = scratch.cut(reach.unionByName(news).groupBy("run_id", "at", "chain").agg(F.max("seq").alias("seq")))


class CommitLedger:
    """A ledger of commits by run; its output is (run_id, sha).

    ``process`` answers the COMPLETED runs of a delivery that have a known head
    and were not answered before: each gets the commits it reaches and no
    earlier one had, whether earlier in a former delivery or, by finished_at,
    in this one.  Runs that end at the same instant in one delivery both get
    what neither had before; a null finished_at counts as later than all.  A
    run whose head is not delivered yet is answered when it is.  A commit that
    is delivered late, behind commits already given out, goes to the earliest
    run of those that reach it.
    """

    def __init__(self, spark, path: str, hot_rows: int = 1_000_000) -> None:
        self.spark, self.hot_rows = spark, hot_rows
        self.ledger = Ledger(spark, path)

    def output(self) -> DataFrame:
        found = self.ledger.output()
        return self.spark.createDataFrame([], GIVEN) if found is None else found

    def process(self, runs: DataFrame, commits: DataFrame) -> bool:
        """True if the delivery gave anything new."""
        return self.ledger.transact(lambda state: self._step(state, runs, commits))

    def _step(self, state: State, runs: DataFrame, commits: DataFrame) -> bool:
        scratch = Scratch(self.spark, "new-commits")
        nodes = scratch.cut(commit_nodes(commits))
        old, ups = state.table("nodes", NODES), state.table("ups", UPS)
        processed, answered = state.table("intervals", INTERVALS), state.table("answered", ANSWERED)
        done = latest_runs(runs).filter("state = 'COMPLETED'")
        heads = resolve_refs(done, nodes.select(F.col("id").alias("sha"), "source_id")).groupBy("run_id").agg(F.min(F.struct("found", "finished_at")).alias("m"))
        heads = heads.select("run_id", F.col("m.found").alias("id"), F.coalesce(F.unix_micros(F.col("m.finished_at").cast("timestamp")), F.lit(2**62)).alias("at"))

        if not state.number:  # the first delivery: there is nothing to compare with
            numbered, ups = chains(nodes.select("id", "parent"), scratch)
            numbered = scratch.cut(nodes.join(numbered, "id").select("id", "parent", "source_id", "chain", "seq"))
            asked = heads
            state.replace("nodes", numbered)
            state.replace("ups", ups)
        else:
            had = old.select("id", F.col("parent").alias("had"), F.lit(True).alias("known"))
            fresh = scratch.cut(nodes.join(had, "id", "left").filter("known is null or not (parent <=> had)").select("id", "parent", "source_id", F.coalesce("known", F.lit(False)).alias("known")))
            # a known commit with another parent: the numbers of its source no longer follow its history
            changed = scratch.cut(fresh.filter("known").select("source_id").distinct())
            redone = not changed.isEmpty()
            if redone:
                of = lambda df, how: df.join(changed.select(F.col("source_id").alias("c")), F.col("source_id").eqNullSafe(F.col("c")), how)
                again = of(nodes, "left_semi")
                kept = scratch.cut(of(old, "left_anti"))
                new = scratch.cut(again.unionByName(of(fresh.drop("known"), "left_anti")))
            else:
                again, kept, new = None, old, fresh.drop("known")
            if new.isEmpty():
                numbered, asked = old, heads.join(answered, "run_id", "left_anti")
            else:
                added, more_ups = _extended(new, kept, scratch)
                added, more_ups = scratch.cut(added), scratch.cut(more_ups)
                numbered = kept.unionByName(added)
                asked = heads.join(answered, "run_id", "left_anti")
                if redone:
                    gone = scratch.cut(of(old, "left_semi").select("chain").distinct())
                    ups = ups.join(gone, "chain", "left_anti").unionByName(more_ups)
                    ups = scratch.cut(ups)
                    # what was given of these sources keeps being processed, under its new numbers
                    given = self.output().select(F.col("sha").alias("id")).distinct().join(added.select("id", "chain", "seq"), "id").select(F.col("chain").alias("stream"), "seq")
                    processed = scratch.cut(processed.join(gone.withColumnRenamed("chain", "stream"), "stream", "left_anti").unionByName(merge(numbers(given), self.hot_rows)))
                    asked = asked.unionByName(heads.join(again.select("id"), "id", "left_semi").select(asked.columns)).distinct()
                    state.replace("nodes", numbered)
                    state.replace("ups", ups)
                else:
                    state.append("nodes", added, NODES)
                    state.append("ups", more_ups, UPS)
                    ups = ups.unionByName(more_ups)
        asked = scratch.cut(asked)
        reach = _reach(scratch.cut(asked.join(numbered, "id").select("run_id", "at", "chain", "seq")), ups, scratch)
        ends = reach.groupBy("chain", "at").agg(F.max("seq").alias("end"))
        before = chunked(ends, "chain", ["at"], self.hot_rows).running_max_before("end", "covered").df.select("chain", "at", F.coalesce("covered", F.lit(-1)).alias("covered"))
        stream = F.struct("run_id", "chain").alias("stream")
        reach = scratch.cut(reach.join(before, ["chain", "at"]))
        available = reach.select(stream, F.lit(0).cast("long").alias("lo"), F.col("seq").alias("hi"))
        earlier = reach.select(stream, F.lit(0).cast("long").alias("lo"), F.col("covered").alias("hi"))
        kept_before = reach.join(processed.withColumnRenamed("stream", "chain"), "chain").filter("lo <= seq").select(stream, "lo", "hi")
        # each stream is one run on one chain: a range from 0 and what is processed of that chain
        gaps = scratch.cut(subtract(available, earlier.unionByName(kept_before), None).select("stream.run_id", F.col("stream.chain").alias("stream"), "lo", "hi"))
        records = numbered.select(F.col("chain").alias("stream"), "seq", F.col("id").alias("sha"))
        given = within(records, gaps).select("run_id", "sha")
        state.emit(given)
        state.replace("intervals", merge(processed.unionByName(gaps.select("stream", "lo", "hi")), self.hot_rows))
        state.append("answered", asked.select("run_id").join(answered, "run_id", "left_anti"), ANSWERED)
        scratch.close()
        return True


def new_commits(runs: DataFrame, commits: DataFrame, path: str, hot_rows: int = 1_000_000) -> DataFrame:
    """(run_id, sha): for each COMPLETED run the commits that no earlier one reached.

    The output of a ledger under ``path`` after this delivery; see
    ``CommitLedger``.  Runs without a known head give nothing and cover nothing.
    """
    ledger = CommitLedger(runs.sparkSession, path, hot_rows)
    ledger.process(runs, commits)
    return ledger.output()
