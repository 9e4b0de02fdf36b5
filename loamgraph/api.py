"""The public calls over the tables of one folder; each gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import scalars
from loamgraph.operators import graph, retrieval
from loamgraph.plans.code import edges_of
from loamgraph.plans.problems import entity_nodes
from loamgraph.sources.tables import Scratch, table


class Knowledge:
    """Search, symbols, references, dependencies, impact, history and snapshots."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def _listed(self, df: DataFrame, order: list[str], limit: int | None, offset: int, equal: dict) -> DataFrame:
        for name, value in equal.items():
            if value is not None:
                df = df.filter(F.col(name) == value)
        df = df.orderBy(*order).offset(offset)
        return df if limit is None else df.limit(limit)

    def entities(self, project_key=None, entity_type=None, status=None, limit: int | None = 100, offset: int = 0) -> DataFrame:
        """A page of entities in order of creation, by equality filters."""
        return self._listed(self.table("entities"), ["created_at", "entity_key"], limit, offset, {"project_key": project_key, "entity_type": entity_type, "status": status})

    def projects(self, kind=None, role=None, status=None) -> DataFrame:
        return self._listed(self.table("projects"), ["key"], None, 0, {"kind": kind, "role": role, "status": status})

    def runs(self, project_id=None, limit: int = 20) -> DataFrame:
        """The newest runs."""
        df = self.table("ingestion_runs")
        df = df if project_id is None else df.filter(F.col("project_id") == project_id)
        return df.orderBy(F.col("started_at").desc(), "run_id").limit(limit)

    def entity(self, key: str) -> DataFrame:
        """The current row of one entity."""
        e = self.table("entities").filter(F.col("entity_key") == key)
        rest = [c for c in e.columns if c != "updated_at"]
        return e.groupBy().agg(F.max(F.struct("updated_at", *rest)).alias("m")).filter("m is not null").select(*[f"m.{c}" for c in e.columns])

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        """(id, fused, intent): text and title of documents, weighted by the kind of question."""
        q = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        docs = self.table("documents")
        titles = docs.filter("title is not null").select(F.col("doc_id").alias("id"), F.col("title").alias("text"))
        text = retrieval.bm25(docs.select("doc_id", "text"), q, scalars.lower_terms, Scratch(self.spark, "search"), 2 * top_k).select("query_id", F.lit("KEYWORD").alias("channel"), F.col("doc_id").alias("id"), "score", "rank")
        title = retrieval.overlap(titles, q, scalars.lower_terms, 2 * top_k).select("query_id", F.lit("ENTITY").alias("channel"), "id", "score", "rank")
        by_intent = F.create_map(*[x for k, w in scalars.WEIGHTS.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for kv in w.items() for y in kv]))])
        kind = q.select("query_id", scalars.intent(F.col("text")).alias("intent"))
        weights = kind.select("query_id", F.explode(by_intent[F.col("intent")]).alias("channel", "weight")).filter("weight > 0.05")
        return retrieval.fuse(text.unionByName(title), weights).join(kind, "query_id").orderBy(F.col("fused").desc(), "id").limit(top_k).select("id", "fused", "intent")

    def symbol(self, name: str) -> DataFrame:
        """(entity_key, score): exact matches before those that only start so."""
        q = self.spark.createDataFrame([(name,)], "query string")
        e = self.table("entities")
        both = retrieval.exact(e, q).unionByName(retrieval.prefixed(e.filter("name is not null"), q))
        return both.groupBy("entity_key").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "entity_key")

    def edges(self) -> DataFrame:
        """(src, predicate, dst): directories contain, files import, types extend, callables call; imports from outside by name."""
        contains = entity_nodes(self.table("entities")).filter("parent is not null").select(F.col("parent").alias("src"), F.lit("CONTAINS").alias("predicate"), F.col("id").alias("dst"))
        inner, outside = edges_of(self.table("source_files"))
        return contains.unionByName(inner.select("src", "predicate", "dst")).unionByName(outside.select("src", F.lit("IMPORTS").alias("predicate"), F.col("target").alias("dst")))

    def references(self, key: str) -> DataFrame:
        """The edges into and out of one entity."""
        return self.edges().filter((F.col("src") == key) | (F.col("dst") == key))

    def dependencies(self, seed: str, depth: int = 3) -> DataFrame:
        """(id, hop, evidence): what the seed needs, within ``depth`` hops."""
        return self.impact([seed], depth, "up")

    def impact(self, seeds: list[str], depth: int = 3, direction: str = "down") -> DataFrame:
        """(id, hop, evidence, level): what a change of the seeds reaches."""
        s = self.spark.createDataFrame([(x,) for x in seeds], "id string")
        found = graph.impact(self.edges(), s, Scratch(self.spark, "impact"), direction, depth)
        return found.withColumn("level", graph.level(F.col("hop")))

    def history(self, path: str, limit: int = 10) -> DataFrame:
        """The newest changes of a path."""
        return self.table("entity_changes").filter(F.col("file_rel_path") == path).orderBy(F.col("authored_at").desc(), F.col("change_id").desc()).limit(limit)

    def snapshot(self, snapshot_id: str) -> DataFrame:
        """The entities of one snapshot, a key once."""
        e = self.table("snapshot_entities").filter(F.col("snapshot_id") == snapshot_id)
        rest = [c for c in e.columns if c != "entity_key"]
        return e.groupBy("entity_key").agg(F.max(F.struct(*rest)).alias("m")).select(*[c if c == "entity_key" else f"m.{c}" for c in e.columns])

    def explain(self, key: str) -> DataFrame:
        """(entity_key, entity_type, layers) of one entity."""
        return self.entity(key).select("entity_key", "entity_type", scalars.layers(F.concat_ws(" ", "path", "name")).alias("layers"))
