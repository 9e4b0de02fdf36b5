"""Classification, calibration and ranking quality.

Predictions: task, expected, predicted, confidence.  Whatever depends only on
confidence and outcome is computed on their distinct pairs with counts, so a
grid of temperatures costs no more than the distinct confidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.scalars import tempered
from loamgraph.operators.segments import chunked

Z = 1.959963984540054


def confusion(p: DataFrame) -> DataFrame:
    return p.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def per_class(p: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1), four decimals, 0 where undefined."""
    c = confusion(p)
    sides = c.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("g")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("g")))).alias("x"), (F.col("expected") == F.col("predicted")).alias("hit"))
    t = sides.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.s").alias("support"), F.sum("x.g").alias("given"), F.sum(F.when(F.col("hit"), F.col("x.s")).otherwise(0)).alias("tp"))
    pr, re = F.col("tp") / F.nullif("given", F.lit(0)), F.col("tp") / F.nullif("support", F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(F.col("support") + F.col("given"), F.lit(0))
    return t.select("label", "support", F.round(F.coalesce(pr, F.lit(0.0)), 4).alias("precision"), F.round(F.coalesce(re, F.lit(0.0)), 4).alias("recall"), F.round(F.coalesce(f1, F.lit(0.0)), 4).alias("f1"))


def outcomes(p: DataFrame) -> DataFrame:
    """(confidence, correct, n): the distinct pairs."""
    return p.groupBy(F.col("confidence").cast("double").alias("confidence"), (F.col("expected") == F.col("predicted")).cast("int").alias("correct")).agg(F.count("*").alias("n"))


def losses(p: DataFrame) -> DataFrame:
    """(brier, nll), clipped at 1e-7, six decimals."""
    q = F.least(F.greatest("confidence", F.lit(1e-7)), F.lit(1 - 1e-7))
    o = outcomes(p).withColumn("q", q)
    total = F.sum("n")
    return o.agg(F.round(F.sum(F.col("n") * (F.col("q") - F.col("correct")) ** 2) / total, 6).alias("brier"), F.round(F.sum(-F.col("n") * F.log(F.when(F.col("correct") == 1, F.col("q")).otherwise(1 - F.col("q")))) / total, 6).alias("nll"))


def _bin(c, bins: int):
    """Half-open bins by their bounds as floating-point products, the last one closed."""
    b = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    width = 1.0 / bins
    return F.when(c < b * width, b - 1).when((c >= (b + 1) * width) & (b < bins - 1), b + 1).otherwise(b)


def calibration_bins(p: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence, gap) of the bins that hold something."""
    o = outcomes(p).withColumn("bin", _bin(F.col("confidence"), bins))
    t = o.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("correct")) / F.sum("n")).alias("a"), (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("c"))
    return t.select("bin", "n", F.round("a", 6).alias("accuracy"), F.round("c", 6).alias("confidence"), F.round(F.abs(F.col("a") - F.col("c")), 6).alias("gap"))


def temperatures(p: DataFrame, bins: int = 10) -> DataFrame:
    """(step, ece) of the 67 temperatures .20 to 3.50; the least ece, smallest step first, is the fit."""
    spark = p.sparkSession
    grid = spark.range(67).select(F.col("id").cast("int").alias("step"), (0.20 + 0.05 * F.col("id")).alias("t"))
    o = outcomes(p).crossJoin(F.broadcast(grid)).withColumn("q", tempered(F.col("confidence"), F.col("t")))
    b = o.withColumn("bin", _bin(F.col("q"), bins)).groupBy("step", "bin").agg(F.abs(F.sum(F.col("n") * (F.col("correct") - F.col("q")))).alias("gap"), F.sum("n").alias("n"))
    return b.groupBy("step").agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))


def wilson(k, n):
    """Low and high of the 95 % score interval, in percent to two decimals."""
    ph = k / n
    d = 1 + Z * Z / n
    mid, half = (ph + Z * Z / (2 * n)) / d, Z * F.sqrt(ph * (1 - ph) / n + Z * Z / (4 * n * n)) / d
    return F.round(100 * F.greatest(F.lit(0.0), mid - half), 2), F.round(100 * F.least(F.lit(1.0), mid + half), 2)


def ordinals(df: DataFrame, key: str, value: str, shares: list[float], hot_rows: int = 1_000_000) -> DataFrame:
    """(key, share, value): the value at index int(share x n) of the sorted values of each key.

    Equal values are counted first; a key with many different values is cut
    along them, so that no task sorts a third of all rows.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = c.groupBy(key).agg(F.sum("n").alias("all"))
    r = chunked(c.withColumn("to", F.col("n")), key, ["v"], hot_rows).running_sum("to").df.join(total, key)
    at = F.least(F.floor(F.col("share") * F.col("all")), F.col("all") - 1)
    x = r.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).filter((at >= F.col("to") - F.col("n")) & (at < F.col("to")))
    return x.select(key, "share", F.col("v").alias(value))


def ranking(results: DataFrame, k: int = 10) -> DataFrame:
    """(queries, recall, mrr, ndcg) of results (query_id, rank, relevant 0/1, total_relevant)."""
    top = results.filter(F.col("rank") <= k)
    per = top.groupBy("query_id").agg((F.sum("relevant") / F.greatest(F.least(F.max("total_relevant"), F.lit(k)), F.lit(1))).alias("recall"), F.coalesce(F.max(F.col("relevant") / F.col("rank")), F.lit(0.0)).alias("rr"), F.sum(F.col("relevant") / F.log2(F.col("rank") + 1)).alias("dcg"), F.greatest(F.least(F.max("total_relevant"), F.lit(k)), F.lit(1)).cast("int").alias("ideal"))
    idcg = F.aggregate(F.sequence(F.lit(1), F.col("ideal")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("dcg") / idcg), 6).alias("ndcg"))
