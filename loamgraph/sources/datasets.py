"""Datasets split by time and written with checksums, and read back only if those hold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.segments import chunked


def split_by_time(df: DataFrame, group: str, order: list[str], shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """Adds split: TRAIN, VALIDATION or TEST by position in each group's order.

    ``order`` is unique within a group; its first column is a number or a
    timestamp, so that a group with a third of all rows is cut along it.
    """
    first = order[0]
    at = F.col(first) if not df.schema[first].dataType.typeName().startswith("timestamp") else F.unix_micros(F.col(first).cast("timestamp"))
    numbered = chunked(df.withColumns({"_at": at, "_n": F.lit(1).cast("long"), "_group": F.coalesce(F.col(group).cast("string"), F.lit("\u0001"))}), "_group", ["_at", *order]).running_sum("_n").df
    sizes = numbered.groupBy("_group").agg(F.count("*").alias("_of"))
    share = (F.col("_n") - 1) / F.col("_of")
    return numbered.join(sizes, "_group").withColumn("split", F.when(share < shares[0], "TRAIN").when(share < sum(shares), "VALIDATION").otherwise("TEST")).select(*df.columns, "split")


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of them that doesn't depend on their order: sums of two 64-bit hashes."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    s = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("b"), text).cast("decimal(38,0)")).alias("b")).first()
    return s.n, f"{s.a or 0:f}:{s.b or 0:f}"


def save(df: DataFrame, path: str) -> None:
    """Writes a frame with column split, and a manifest of each split's rows and digest."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    spark = df.sparkSession
    rows = []
    for (split,) in spark.read.parquet(f"{path}/data").select("split").distinct().orderBy("split").collect():
        n, digest = checksum(spark.read.parquet(f"{path}/data/split={split}"))
        rows.append((json.dumps({"split": split, "rows": n, "digest": digest}),))
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split, after its digest was compared with the manifest; ValueError if it differs."""
    held = {m["split"]: m for m in (json.loads(r.value) for r in spark.read.text(f"{path}/manifest").collect())}
    df = spark.read.parquet(f"{path}/data/split={split}")
    if split not in held or checksum(df) != (held[split]["rows"], held[split]["digest"]):
        raise ValueError(f"the split {split} differs from its manifest")
    return df
