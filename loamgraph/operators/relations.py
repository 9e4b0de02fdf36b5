"""Relations kept in step with what files say now: upsert by key, soft deletion by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synced(stored: DataFrame, arrived: DataFrame, files: DataFrame) -> DataFrame:
    """(relation_key, file, outcome, status, occurrences, object): the relations after a delivery of ``files`` (file).

    ``stored``: relation_key, file, status, occurrences, object; ``arrived``:
    relation_key, file, occurrences, object.  Rows of one key are merged first:
    occurrences add up, the least object counts.  CREATED, UPDATED, UNCHANGED,
    REACTIVATED (was deleted); DELETED where a delivered file no longer has it,
    KEPT where its file was not delivered.  A stored object stays where the
    arrived one is unknown.  Null keys are left out.
    """
    one = lambda df, *more: df.filter("relation_key is not null").groupBy("relation_key", "file").agg(F.sum("occurrences").alias("occurrences"), F.min("object").alias("object"), *more)
    s = one(stored, F.max("status").alias("was")).withColumn("in0", F.lit(True)).withColumnsRenamed({"occurrences": "o0", "object": "b0", "file": "f0"})
    a = one(arrived).withColumn("in1", F.lit(True)).withColumnsRenamed({"occurrences": "o1", "object": "b1", "file": "f1"})
    j = s.join(a, "relation_key", "full_outer").withColumn("file", F.coalesce("f1", "f0"))
    j = j.join(files.select("file").distinct().withColumn("delivered", F.lit(True)), "file", "left")
    same = F.col("o0").eqNullSafe(F.col("o1")) & F.col("b0").eqNullSafe(F.coalesce("b1", "b0"))
    gone = F.col("in1").isNull()
    outcome = F.when(F.col("in0").isNull(), "CREATED").when(gone & (F.col("was") == "DELETED"), "KEPT").when(gone & F.col("delivered"), "DELETED").when(gone, "KEPT").when(F.col("was") == "DELETED", "REACTIVATED").when(same, "UNCHANGED").otherwise("UPDATED")
    status = F.when(outcome == "DELETED", "DELETED").when(outcome == "KEPT", F.col("was")).otherwise("ACTIVE")
    return j.select("relation_key", "file", outcome.alias("outcome"), status.alias("status"), F.coalesce("o1", "o0").alias("occurrences"), F.coalesce("b1", "b0").alias("object"))
