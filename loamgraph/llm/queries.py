"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import broken, handwritten, leakage, packing, truncation
from loamgraph.sources.tables import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(file_id) of the source files that do not parse."""
    return broken.verdicts(table(spark, d, "source_files")).filter("reason is not null").select("file_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of files that do not parse, by project, source and language."""
    return broken.rates(broken.verdicts(table(spark, d, "source_files")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(file_id) of the source files that nobody wrote by hand."""
    return p6_kinds(spark, d).select("file_id")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, kind) of the source files that nobody wrote by hand."""
    return handwritten.found(table(spark, d, "source_files"), Scratch(spark, "handwritten"))


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    """(source, files, share) of the sources of evidence that decide over p6_found."""
    return handwritten.shares(table(spark, d, "source_files"), Scratch(spark, "handwritten"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) of documents that contain a passage of a held-out item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), Scratch(spark, "leakage"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, documents) of the held-out items that leaked."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of the documents that were cut off."""
    return truncation.cut_texts(table(spark, d, "documents"), Scratch(spark, "truncation")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of cut texts by source."""
    docs = table(spark, d, "documents")
    return truncation.rates(docs, truncation.cut_texts(docs, Scratch(spark, "truncation")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, tokens, container_id) in containers of 2,048 tokens."""
    return packing.containers(packing.pieces(packing.sized(table(spark, d, "documents"))), Scratch(spark, "packing"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, from_byte, to_byte, tokens) of the texts that no container holds whole."""
    return packing.offsets(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, tokens, room left and its share, and the least number of containers."""
    size = F.lit(packing.CAPACITY)
    total = p7_containers(spark, d).agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select("containers", "tokens", (F.col("containers") * size - F.col("tokens")).alias("room"), F.round(1 - F.col("tokens") / (F.col("containers") * size), 6).alias("room_share"), F.ceil(F.col("tokens") / size).alias("least_containers"))


def p7_buckets(spark: SparkSession, d: str) -> DataFrame:
    """(over, up_to, texts, padding) of sixteen length buckets with the least padding."""
    items = packing.pieces(packing.sized(table(spark, d, "documents")))
    histogram = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame(packing.length_buckets(histogram), "over long, up_to long, texts long, padding long")


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p6_found, p6_kinds, p6_evidence, p7_containers, p7_pieces, p7_fill, p7_buckets, p8_found, p8_items, p9_found, p9_rates)}
ORACLE: dict[str, str] = {}
