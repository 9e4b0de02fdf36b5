"""Differences, upserts and retention of stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, format_only) of two file sets (path, digest, bare_digest).

    ADDED, DELETED or MODIFIED by a full outer join; format_only where only
    comments and white space differ.
    """
    o = old.select("path", F.col("digest").alias("d0"), F.col("bare_digest").alias("b0"), F.lit(1).alias("in0"))
    n = new.select("path", F.col("digest").alias("d1"), F.col("bare_digest").alias("b1"), F.lit(1).alias("in1"))
    j = o.join(n, "path", "full_outer")
    change = F.when(F.col("in0").isNull(), "ADDED").when(F.col("in1").isNull(), "DELETED").when(~F.col("d0").eqNullSafe(F.col("d1")), "MODIFIED")
    return j.select("path", change.alias("change"), ((change == "MODIFIED") & F.col("b0").eqNullSafe(F.col("b1"))).alias("format_only")).filter("change is not null")


def upsert(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """(key, outcome, value): a merge of (key, value, status) with arrived (key, value).

    CREATED, UPDATED, UNCHANGED, REACTIVATED (was deleted), or DELETED (active
    but not arrived); deleted keys that do not arrive stay out.
    """
    s = stored.select("key", F.col("value").alias("v0"), F.upper("status").alias("st"), F.lit(1).alias("in0"))
    a = arrived.select("key", F.col("value").alias("v1"), F.lit(1).alias("in1"))
    j = s.join(a, "key", "full_outer")
    outcome = F.when(F.col("in0").isNull(), "CREATED").when(F.col("in1").isNull(), F.when(F.coalesce("st", F.lit("")) != "DELETED", "DELETED")).when(F.col("st") == "DELETED", "REACTIVATED").when(F.col("v0").eqNullSafe(F.col("v1")), "UNCHANGED").otherwise("UPDATED")
    return j.select("key", outcome.alias("outcome"), F.when(F.col("in1") == 1, F.col("v1")).otherwise(F.col("v0")).alias("value")).filter("outcome is not null")


def retained(snapshots: DataFrame, keep: int = 50) -> DataFrame:
    """Snapshots (stream, snapshot_id, created_at) to keep: the first of a stream and its newest ``keep``."""
    new = Window.partitionBy("stream").orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc())
    # a rank that is filtered at once keeps ``keep`` rows a stream in each task, before the shuffle
    newest = snapshots.withColumn("n", F.row_number().over(new)).filter(F.col("n") <= keep).select("stream", "snapshot_id", "created_at")
    first = snapshots.groupBy("stream").agg(F.min(F.struct("created_at", "snapshot_id")).alias("m")).select("stream", "m.snapshot_id", "m.created_at")
    return newest.unionByName(first).distinct()


def equivalence(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: how far two states (key, value) agree: shared, only_left, only_right, differing, match_rate."""
    j = one.select("key", F.col("value").alias("a"), F.lit(1).alias("l")).join(other.select("key", F.col("value").alias("b"), F.lit(1).alias("r")), "key", "full_outer")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    t = j.agg(F.count(F.when(both, 1)).alias("shared"), F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"), F.count(F.when(both & ~F.col("a").eqNullSafe(F.col("b")), 1)).alias("differing"), F.count("*").alias("n"))
    return t.select("shared", "only_left", "only_right", "differing", F.round((F.col("shared") - F.col("differing")) / F.greatest("n", F.lit(1)), 4).alias("match_rate"))
