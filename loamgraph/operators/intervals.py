"""Processing only what is new: processed sequence numbers as disjoint intervals.

``merge`` and ``subtract`` are the interval algebra; ``Ledger`` keeps the
processed intervals of record streams with the output they belong to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.segments import Chunked, chunked
from loamgraph.sources.tables import Scratch

#: Sequence numbers a block: an interval meets records block by block, so no join key gets more.
BLOCK = 4096


def _sweep(events: DataFrame, hot_rows: int | None) -> DataFrame:
    """(stream, lo, hi) of the stretches with cover in a and none in b.

    ``events``: stream, pos, a, b, the changes of cover at pos.  Equal
    positions are summed first, so the order within one can't matter.  Streams
    with more than ``hot_rows`` events are scanned in chunks (None: no stream
    can have so many).
    """
    e = events.groupBy("stream", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = chunked(e, "stream", ["pos"], hot_rows) if hot_rows else Chunked(e.withColumns({"chunk": F.lit(0), "hot": F.lit(False)}), "stream", ["pos"], False)
    s = s.running_sum("a").running_sum("b")
    s = s.replaced(s.df.withColumn("on", (F.col("a") > 0) & (F.col("b") == 0))).neighbour(F.col("on"), "was")
    s = s.replaced(s.df.filter(F.col("on") != F.coalesce("was", F.lit(False)))).neighbour(F.col("pos"), "end", after=True)
    return s.df.filter("`on`").select("stream", F.col("pos").alias("lo"), (F.col("end") - 1).alias("hi"))


def _edges(df: DataFrame, a: int, b: int) -> DataFrame:
    df = df.filter("lo <= hi")
    return df.select("stream", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct((F.col("hi") + 1).alias("pos"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))).alias("e")).select("stream", "e.*")


def merge(intervals: DataFrame, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Disjoint, non-adjacent intervals with the same numbers; lo > hi or null is empty."""
    return _sweep(_edges(intervals, 1, 0), hot_rows)


def subtract(available: DataFrame, processed: DataFrame, hot_rows: int | None = 1_000_000) -> DataFrame:
    """The gaps: numbers of ``available`` that ``processed`` lacks."""
    return _sweep(_edges(available, 1, 0).unionByName(_edges(processed, 0, 1)), hot_rows)


def numbers(records: DataFrame) -> DataFrame:
    """(stream, lo, hi) of the numbers that records (stream, seq) have, disjoint, by block of numbers.

    Repeats fall together before the shuffle, and islands are found block by
    block, so a stream with a third of all records is many small groups.
    """
    one = records.select("stream", F.col("seq").cast("long").alias("seq")).distinct().withColumn("block", F.floor(F.col("seq") / BLOCK))
    island = F.col("seq") - F.row_number().over(Window.partitionBy("stream", "block").orderBy("seq"))
    return one.withColumn("island", island).groupBy("stream", "block", "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).select("stream", "lo", "hi")


def within(records: DataFrame, intervals: DataFrame) -> DataFrame:
    """Records (stream, seq, ...) that lie in an interval, once for each interval.

    Joined on the stream and a block of numbers: a stream with a third of all
    records is spread over all its blocks.
    """
    cut = intervals.filter("lo <= hi").withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    return records.withColumn("_block", F.floor(F.col("seq") / BLOCK)).join(cut, ["stream", "_block"]).filter("seq between lo and hi").drop("_block", "lo", "hi")


class Conflict(Exception):
    """Another run committed first."""


class State:
    """What a committed version holds, and what a run writes for the next one."""

    def __init__(self, ledger: Ledger, number: int, name: str, parts: dict[str, list[str]]) -> None:
        self.ledger, self.number, self.name, self.parts = ledger, number, name, parts

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the version; empty if there is none."""
        paths = self.parts.get(name, [])
        if not paths:
            return self.ledger.spark.createDataFrame([], schema)
        return self.ledger.spark.read.schema(schema).parquet(*paths)

    def replace(self, name: str, df: DataFrame) -> None:
        path = f"{self.ledger.path}/state/{name}/{self.name}"
        df.write.parquet(path)
        self.parts[name] = [path]

    def append(self, name: str, df: DataFrame, schema: str) -> None:
        """Adds rows as a part of their own; when there are many parts they become one."""
        path = f"{self.ledger.path}/state/{name}/{self.name}"
        before = self.parts.get(name, [])
        if len(before) >= Ledger.PARTS:
            df = self.table(name, schema).unionByName(df)
            before = []
        df.write.parquet(path)
        self.parts[name] = [*before, path]

    def emit(self, df: DataFrame) -> None:
        """The run's output."""
        df.write.parquet(f"{self.ledger.path}/output/version={self.name}")


class Ledger:
    """Processed intervals and the output they stand for, committed together.

    A run reads the latest version, writes its output and the new state beside
    it, and commits by creating the file of the next version's number, which
    only one run can do: the file is written under another name and renamed
    without overwriting.  A run that fails before has changed nothing: its
    numbers are still gaps and its output is not listed.  A run that finds the
    number taken removes what it wrote and starts again from the new version,
    so two runs at once give nothing twice and lose nothing.  Late records fill
    gaps of any age.

    The file system's rename must fail where the target exists (HDFS, local
    and shared file systems do).
    """

    #: Parts of a table, at most.
    PARTS = 16

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit_file(self, number: int) -> str:
        return f"{self.path}/commits/{number:012d}.json"

    def latest(self) -> int:
        """The number of the latest version, 0 before the first; found by halving, without a listing."""
        there = lambda n: self._fs.exists(self._path(self._commit_file(n)))
        high = 1
        while there(high):
            high *= 2
        low = high // 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if there(mid) else (low, mid)
        return low

    def state(self) -> State:
        """The latest version, to be read and to write the next one from."""
        number, parts = self.latest(), {}
        if number:
            parts = json.loads(self.spark.read.text(self._commit_file(number), wholetext=True).first()[0])["parts"]
        return State(self, number, f"{number + 1:012d}-{uuid.uuid4().hex}", parts)

    def processed(self) -> DataFrame:
        return self.state().table("intervals", "stream string, lo long, hi long")

    def output(self) -> DataFrame | None:
        """The rows of all committed versions, by a join with their names; what failed runs left is not among them."""
        if not self.latest():
            return None
        names = self.spark.read.schema("name string").json(f"{self.path}/commits/*.json").select(F.col("name").alias("version"))
        rows = self.spark.read.parquet(f"{self.path}/output")
        return rows.join(names, "version", "left_semi").drop("version")

    def transact(self, step: Callable[[State], bool]) -> bool:
        """Runs ``step`` on the latest version and commits, anew until no other run comes between.

        ``step`` writes tables and emits output, or gives False if there is
        nothing to do.
        """
        while True:
            state = self.state()
            try:
                if not step(state):
                    self._discard(state)
                    return False
                self._commit(state)
                return True
            except Conflict:
                self._discard(state)
            except BaseException:
                self._discard(state)
                raise

    def run(self, records: DataFrame, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Processes the records (stream, seq, ...) that are new; gives the number of new intervals.

        One record a sequence number counts: repeats of a number that comes in
        one delivery are processed together, later repeats not again.
        """
        found = 0

        def once(state: State) -> bool:
            nonlocal found
            scratch = Scratch(self.spark, "ledger")
            done = state.table("intervals", "stream string, lo long, hi long")
            gaps = scratch.cut(subtract(numbers(records.filter("stream is not null and seq is not null")), done))
            found = gaps.count()
            if found:
                state.emit(step(within(records, gaps)))
                state.replace("intervals", merge(done.unionByName(gaps)))
            scratch.close()
            return found > 0

        self.transact(once)
        return found

    def _commit(self, state: State) -> None:
        new = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"name": state.name, "parts": state.parts}).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(new, self._path(self._commit_file(state.number + 1)), option)
        except Exception as e:
            self._fs.delete(new, False)
            if self._fs.exists(self._path(self._commit_file(state.number + 1))):
                raise Conflict from e
            raise

    def _discard(self, state: State) -> None:
        self._fs.delete(self._path(f"{self.path}/output/version={state.name}"), True)
        for paths in state.parts.values():
            if paths and paths[-1].endswith(state.name):
                self._fs.delete(self._path(paths[-1]), True)
