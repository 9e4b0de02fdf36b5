"""History of changing attributes: versions with the period each was valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.normal import fwd, squeeze_ws, strip_ws
from loamgraph.operators.segments import chunked


def versions(changes: DataFrame, hot_rows: int = 1_000_000, splits: int | None = None) -> DataFrame:
    """(entity_key, valid_from_us, valid_to_us, status, signature, file_rel_path).

    Gaps and islands over changes in order of authored_at: the hash of the
    attributes is compared with that of the row before; a difference, or the
    step from or to a deletion, marks a row, and the running sum of the marks
    numbers the islands.  An island's least instant is the version's start and
    the next island's start its end (-1: still valid).

    Of several rows of one entity and instant the greatest change_id counts; a
    null change_id is the smallest.  A null attribute keeps its last value,
    also across a deletion.  Rows without entity_key or authored_at are left
    out.  Repeated rows and rows that change nothing add nothing.  Entities
    with more rows than an average partition are scanned in chunks.
    """
    gone = F.upper(strip_ws(F.col("change_type"))) == "DELETED"
    keep = lambda c: F.when(~F.col("gone"), c)
    one = (
        changes.filter("entity_key is not null and authored_at is not null")
        .groupBy("entity_key", F.unix_micros(F.col("authored_at").cast("timestamp")).alias("at"))
        .agg(F.max(F.struct("change_id", F.coalesce(gone, F.lit(False)).alias("gone"), F.lower(strip_ws(F.col("status"))).alias("status"), squeeze_ws(F.col("signature")).alias("signature"), fwd(F.col("file_rel_path")).alias("file_rel_path"))).alias("m"))
        .select("entity_key", "at", "m.*")
        .select("entity_key", "at", "gone", *[keep(F.col(c)).alias(c) for c in ATTRIBUTES])
    )
    scan = chunked(one, "entity_key", ["at"], hot_rows, splits).fill_forward(ATTRIBUTES)
    scan = scan.replaced(scan.df.withColumn("h", F.xxhash64(F.to_json(F.struct(*ATTRIBUTES)))))
    scan = scan.neighbour(F.struct("gone", "h"), "prev")
    mark = F.col("prev").isNull() | (F.col("prev.gone") != F.col("gone")) | (~F.col("gone") & (F.col("prev.h") != F.col("h")))
    scan = scan.replaced(scan.df.withColumn("marked", mark).withColumn("island", F.col("marked").cast("long"))).running_sum("island")
    # grouped within the chunks the windows already made, so nothing is shuffled again; an island that began
    # in an earlier chunk has its marked row, and so its start, there
    first = F.min(F.struct("at", "gone", *ATTRIBUTES)).alias("m")
    islands = scan.df.groupBy("entity_key", "chunk", "hot", "island").agg(first, F.max("marked").alias("starts")).filter("starts").select("entity_key", "chunk", "hot", "m.*")
    islands = scan.replaced(islands).neighbour(F.col("at"), "nxt", after=True).df
    return islands.filter(~F.col("gone")).select("entity_key", F.col("at").alias("valid_from_us"), F.coalesce("nxt", F.lit(-1)).cast("long").alias("valid_to_us"), *ATTRIBUTES)


ATTRIBUTES = ["status", "signature", "file_rel_path"]
