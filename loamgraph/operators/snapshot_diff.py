"""What changed between full snapshots of a table.

A full outer join of each complete snapshot with the complete one before it,
on the snapshot pair and the entity key, comparing hashes of canonical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.normal import canonical_json, fwd, squeeze_ws, strip_ws


def canonical_rows(rows: DataFrame) -> DataFrame:
    """(snapshot_id, entity_key, is_file, row_hash), one row a key and snapshot.

    Nulls: a null name, status or signature equals only null; null metadata is
    ``{}``.  Rows without a key or snapshot are left out.  Several rows of one
    key that differ count with the smallest hash, so the result does not
    depend on their order.
    """
    parts = F.to_json(F.struct("name", F.lower(strip_ws(F.col("status"))).alias("status"), squeeze_ws(F.col("signature")).alias("signature"), canonical_json(F.col("metadata")).alias("metadata")))
    # two independent 64-bit hashes: a chance equality would lose a change
    h = F.struct(F.xxhash64(parts).alias("a"), F.xxhash64(F.lit("b"), parts).alias("b"))
    return (
        rows.filter("snapshot_id is not null and entity_key is not null")
        .select("snapshot_id", fwd(F.col("entity_key")).alias("entity_key"), (F.upper(strip_ws(F.col("entity_type"))) == "FILE").alias("is_file"), h.alias("row_hash"))
        .groupBy("snapshot_id", "entity_key")
        .agg(F.max(F.coalesce("is_file", F.lit(False))).alias("is_file"), F.min("row_hash").alias("row_hash"))
    )


def complete_pairs(snapshots: DataFrame, keyed: DataFrame) -> DataFrame:
    """(prev_id, snapshot_id) of consecutive complete snapshots of a source.

    Complete: the distinct FILE keys number file_count.  Repeated rows of a
    snapshot count once; order is created_at, then snapshot_id.
    """
    files = keyed.filter("is_file").groupBy("snapshot_id").agg(F.count("*").alias("files"))
    one = snapshots.filter("snapshot_id is not null").groupBy("snapshot_id").agg(F.max(F.struct("created_at", "source_id", "file_count")).alias("m")).select("snapshot_id", "m.*")
    whole = one.join(files, "snapshot_id", "left").filter(F.coalesce("files", F.lit(0)) == F.col("file_count"))
    w = Window.partitionBy("source_id").orderBy("created_at", "snapshot_id")
    return whole.select("snapshot_id", F.lag("snapshot_id").over(w).alias("prev_id")).filter("prev_id is not null")


def diff(snapshots: DataFrame, rows: DataFrame, cut=lambda df: df) -> DataFrame:
    """(snapshot_id, entity_key, change_kind): added, removed or changed.

    Extra columns of either table are ignored; empty tables give no rows.  The
    join key is the pair and the entity, so neither a source with a third of
    all snapshots nor a huge snapshot makes a hot partition.
    """
    keyed = cut(canonical_rows(rows))
    pairs = cut(complete_pairs(snapshots, keyed))
    new = keyed.join(pairs.select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", "entity_key", F.col("row_hash").alias("new_hash"))
    old = keyed.withColumnRenamed("snapshot_id", "prev_id").join(pairs, "prev_id").select("snapshot_id", "entity_key", F.col("row_hash").alias("old_hash"))
    both = old.join(new, ["snapshot_id", "entity_key"], "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.select("snapshot_id", "entity_key", kind.alias("change_kind")).filter("change_kind is not null")
