"""Commits as a graph: one row a commit, references resolved to commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.normal import sha_ref

#: A shortened reference has at least this many digits.
SHORT = 10


def latest_commits(commits: DataFrame) -> DataFrame:
    """One row a sha: sha, source_id, parent_ref, from the latest recorded_at.

    Ties of recorded_at take the greater parent reference.  Rows without a sha
    are no commits.  The maximum of a struct is combined before the shuffle,
    so one sha delivered very often costs no more than any other.
    """
    pick = F.max(F.struct("recorded_at", sha_ref(F.col("parent_sha")).alias("parent_ref"), "source_id")).alias("m")
    return commits.filter("sha is not null").groupBy("sha").agg(pick).select("sha", "m.source_id", "m.parent_ref")


def resolve_refs(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """``refs`` (source_id, ref and more) with found: the sha that ref means, or no row.

    A reference is a full sha or its first 10 to 14 digits, and means a commit
    of the same source.  One equi-join on the source and the first ten digits
    serves both lengths; the rest of the digits is compared on the joined row.
    """
    key = F.lower(F.trim(F.col("sha")))
    side = commits.select(F.col("source_id").alias("c_source"), F.substring(key, 1, SHORT).alias("c_head"), key.alias("c_key"), F.col("sha").alias("found"))
    cond = F.col("source_id").eqNullSafe(F.col("c_source")) & (F.substring("ref", 1, SHORT) == F.col("c_head")) & F.when(F.length("ref") < 40, (F.length("ref") >= SHORT) & F.col("c_key").startswith(F.col("ref"))).otherwise(F.col("c_key") == F.col("ref"))
    return refs.filter("ref is not null").join(side, cond).drop("c_source", "c_head", "c_key")


def commit_nodes(commits: DataFrame) -> DataFrame:
    """(id, parent, source_id) of the commits; parent null where none was delivered.

    If a short reference fits several commits, the smallest sha is its meaning.
    """
    one = latest_commits(commits)
    refs = one.select("sha", "source_id", F.col("parent_ref").alias("ref"))
    found = resolve_refs(refs, one).groupBy("sha").agg(F.min("found").alias("parent"))
    return one.join(found, "sha", "left").select(F.col("sha").alias("id"), "parent", "source_id")
