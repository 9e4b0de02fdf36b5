"""Versions of a graph of entities and edges: candidates, publication, rollback, incremental updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.intervals import Ledger, State

ENTITIES = "key string, file string, value string"
EDGES = "src string, predicate string, dst string, file string"


class Refused(Exception):
    """A candidate that breaks an invariant; nothing was published."""


def removed(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without ``gone`` (key), edges at either end included."""
    ids = gone.select("key").distinct()
    left = edges.join(ids.withColumnRenamed("key", "src"), "src", "left_anti").join(ids.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return entities.join(ids, "key", "left_anti"), left.select("src", "predicate", "dst", "file")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, value): ADDED, DELETED or MODIFIED entities (key, value) between two states."""
    o, n = old.select("key", F.col("value").alias("v0"), F.lit(1).alias("a")), new.select("key", F.col("value").alias("v1"), F.lit(1).alias("b"))
    j = o.join(n, "key", "full_outer")
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "DELETED").when(~F.col("v0").eqNullSafe(F.col("v1")), "MODIFIED")
    return j.select("key", change.alias("change"), F.coalesce("v1", "v0").alias("value")).filter("change is not null")


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, predicate, dst, change): ADDED or DELETED edges between two states."""
    ends = ["src", "predicate", "dst"]
    a, b = old.select(*ends).distinct().withColumn("a", F.lit(1)), new.select(*ends).distinct().withColumn("b", F.lit(1))
    return a.join(b, ends, "full_outer").filter("a is null or b is null").select(*ends, F.when(F.col("a").isNull(), "ADDED").otherwise("DELETED").alias("change"))


def broken(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, predicate, dst, reason): edges with an end that is no entity (DANGLING) and types that extend themselves (SELF)."""
    ids = entities.select("key").distinct()
    ends = edges.select("src", "predicate", "dst").distinct()
    lost = lambda end: ends.join(ids.withColumnRenamed("key", end), end, "left_anti").select("src", "predicate", "dst")
    dangling = lost("src").unionByName(lost("dst")).distinct().withColumn("reason", F.lit("DANGLING"))
    return dangling.unionByName(ends.filter("src = dst and predicate = 'EXTENDS'").withColumn("reason", F.lit("SELF")))


class GraphStore:
    """A graph in versions; a version is never changed, a new one is published whole or not at all.

    Writers at once are ordered by the ledger: the later one's update is
    applied anew to what the earlier one published.  Readers of a version are
    not disturbed.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.ledger = spark, Ledger(spark, path)

    def version(self) -> int:
        return self.ledger.latest()

    def entities(self) -> DataFrame:
        """(key, file, value) of the current version."""
        return self.ledger.state().table("entities", ENTITIES)

    def edges(self) -> DataFrame:
        """(src, predicate, dst, file) of the current version."""
        return self.ledger.state().table("edges", EDGES)

    def publish(self, entities: DataFrame, edges: DataFrame) -> int:
        """A full rebuild; gives its number, or raises Refused."""
        return self._publish(lambda *_: (entities.select("key", "file", "value"), edges.select("src", "predicate", "dst", "file")))

    def update(self, files: DataFrame, entities: DataFrame, edges: DataFrame) -> int:
        """Replaces what the changed ``files`` (file) held by what they hold now; gives the number, or raises Refused.

        Entities of these files that are not among ``entities`` are removed with
        all their edges, also those that other files hold.
        """
        return self._publish(lambda old, had: self._applied(old, had, files, entities, edges))

    @staticmethod
    def _applied(old: DataFrame, had: DataFrame, files: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = files.select("file").distinct()
        now = entities.select("key", "file", "value")
        gone = old.join(named, "file", "left_semi").join(now.select("key"), "key", "left_anti")
        _, kept = removed(old, had.join(named, "file", "left_anti"), gone)
        # an entity that moved between files is the new one
        rest = old.join(named, "file", "left_anti").join(now.select("key"), "key", "left_anti").select("key", "file", "value")
        return rest.unionByName(now), kept.unionByName(edges.select("src", "predicate", "dst", "file"))

    def _publish(self, change) -> int:
        def step(state: State) -> bool:
            entities, edges = change(state.table("entities", ENTITIES), state.table("edges", EDGES))
            state.replace("entities", entities.distinct())
            state.replace("edges", edges.distinct())
            # the candidate as written is what is tested
            first = broken(state.table("entities", ENTITIES), state.table("edges", EDGES)).first()
            if first:
                raise Refused(f"{first.reason}: {first.src} {first.predicate} {first.dst}")
            return True

        self.ledger.transact(step)
        return self.ledger.latest()
