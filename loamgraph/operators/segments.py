"""Ordered scans over groups of any size.

A window over one group runs in one task.  Where a group holds more rows than
an average partition, it is cut into chunks along its order (quantiles of the
order column), windows run per chunk, and what a chunk needs from its
neighbours comes from a summary with one row a chunk.  Results are the same
with or without cutting; nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Chunked:
    """Rows with chunk (int) and hot (boolean) columns, and how they are ordered."""

    df: DataFrame
    key: str
    order: list[str]
    any_hot: bool

    @property
    def window(self):
        return Window.partitionBy(self.key, "chunk").orderBy(*self.order)

    def replaced(self, df: DataFrame) -> Chunked:
        return Chunked(df, self.key, self.order, self.any_hot)

    def _carried(self, aggs: dict[str, Column], back: bool) -> DataFrame:
        """By (key, chunk) of hot groups: the nearest non-null aggregate of the chunks before (or after) it."""
        per = self.df.filter("hot").groupBy(self.key, "chunk").agg(*[a.alias(n) for n, a in aggs.items()])
        order = F.col("chunk").desc() if back else F.col("chunk").asc()
        w = Window.partitionBy(self.key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        # all chunk numbers come from rows, so an empty chunk has no row and is stepped over
        return per.select(self.key, "chunk", *[F.last(n, True).over(w).alias(n) for n in aggs])

    def fill_forward(self, cols: list[str]) -> Chunked:
        """Replaces each column by its last non-null value up to the row."""
        w = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self.df
        if self.any_hot:
            pos = F.struct(*self.order)
            before = self._carried({f"_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), pos)) for c in cols}, False)
            df = df.join(before, [self.key, "chunk"], "left")
        out = df.withColumns({c: F.last(c, True).over(w) if not self.any_hot else F.coalesce(F.last(c, True).over(w), f"_{c}") for c in cols})
        return self.replaced(out.drop(*[f"_{c}" for c in cols]))

    def neighbour(self, value: Column, name: str, after: bool = False) -> Chunked:
        """Adds the value (never null) of the row before, or after, in the whole group."""
        df = self.df.withColumn("_v", value)
        near = F.lead("_v").over(self.window) if after else F.lag("_v").over(self.window)
        if self.any_hot:
            pos = F.struct(*self.order)
            other = Chunked(df, self.key, self.order, True)._carried({"_o": (F.min_by if after else F.max_by)("_v", pos)}, after)
            df = df.join(other, [self.key, "chunk"], "left")
            near = F.coalesce(near, "_o")
        return self.replaced(df.withColumn(name, near).drop("_v", "_o"))

    def running_max_before(self, col: str, name: str) -> Chunked:
        """Adds the greatest value of the rows before it in the group, null for the first."""
        w = self.window.rowsBetween(Window.unboundedPreceding, -1)
        df, best = self.df, F.max(col).over(w)
        if self.any_hot:
            per = self.df.filter("hot").groupBy(self.key, "chunk").agg(F.max(col).alias("_m"))
            wk = Window.partitionBy(self.key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            df = df.join(per.select(self.key, "chunk", F.max("_m").over(wk).alias("_m")), [self.key, "chunk"], "left")
            best = F.greatest(best, "_m")
        return self.replaced(df.withColumn(name, best).drop("_m"))

    def running_sum(self, col: str) -> Chunked:
        """Replaces the column by its sum up to the row."""
        w = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df, total = self.df, F.sum(col).over(w)
        if self.any_hot:
            per = self.df.filter("hot").groupBy(self.key, "chunk").agg(F.sum(col).alias("_t"))
            wk = Window.partitionBy(self.key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            df = df.join(per.select(self.key, "chunk", F.sum("_t").over(wk).alias("_t")), [self.key, "chunk"], "left")
            total = total + F.coalesce("_t", F.lit(0))
        return self.replaced(df.withColumn(col, total).drop("_t"))


def chunked(df: DataFrame, key: str, order: list[str], hot_rows: int = 1_000_000, splits: int | None = None) -> Chunked:
    """Cuts groups with more than ``hot_rows`` rows and more than total/splits.

    At most ``splits`` groups (default: the shuffle partitions) can have more
    than total/splits rows, so the list of cut groups is bounded and may be
    broadcast.  ``order`` must be unique within a group; its first column,
    numeric or timestamp, gives the quantiles.
    """
    spark = df.sparkSession
    splits = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    # the greatest count and the sum, then only the few keys above the line
    row = counts.agg(F.sum("n").alias("t"), F.max("n").alias("m")).first()
    line = max(hot_rows, (row.t or 0) // splits)
    if (row.m or 0) <= line:
        return Chunked(df.withColumns({"chunk": F.lit(0), "hot": F.lit(False)}), key, order, False)
    hot = [r[0] for r in counts.filter(F.col("n") > line).select(key).collect()]  # at most `splits` keys
    first = order[0]
    grid = [i / splits for i in range(1, splits)]
    pos = F.col(first).cast("double")
    bounds = df.filter(F.col(key).isin(hot)).groupBy(key).agg(F.percentile_approx(pos, grid, 10_000).alias("_b"))
    out = df.join(F.broadcast(bounds), key, "left").withColumns({"hot": F.col("_b").isNotNull(), "chunk": F.coalesce(F.size(F.filter("_b", lambda b: b < pos)), F.lit(0))})
    return Chunked(out.drop("_b"), key, order, True)
