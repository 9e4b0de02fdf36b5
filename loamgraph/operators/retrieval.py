"""Lexical, name and vector retrieval for many queries at once, and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch

K1, B, RRF_K, ALPHA = 1.5, 0.75, 60, 0.5
#: Postings of a query's rarest terms, for each of its best k, that give the bound; scores nearer than this are equal.
SEEDS, ROUNDED = 500, 1e-5


def postings(docs: DataFrame, terms: Column) -> DataFrame:
    """(doc_id, term, tf, len) of ``docs`` (doc_id and what ``terms`` needs)."""
    t = docs.select("doc_id", terms.alias("terms"))
    return t.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def _best(post: DataFrame, asked: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(query_id, doc_id, raw) of all documents that can be among a query's best k; raw is the sum of weights.

    ``post``: doc_id, term, w (not negative); ``asked``: query_id, term, times.
    ``post``: doc_id, term, w (not negative); ``asked``: query_id, term, times.
    Scoring every document that shares any term with a query would be documents
    times queries.  Instead the query's rarest terms give k documents whose
    partial scores bound the k-th best from below.  Terms whose greatest weights
    together stay under that bound (the common ones) can't lift a document into
    the best k by themselves: they are left out of the first sum, and added for
    those documents only that can still reach the bound.  Exact, ties included.
    """
    terms = asked.join(post.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most")), "term").withColumn("ub", F.col("times") * F.col("most"))
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = terms.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).filter(F.col("before") < SEEDS * k)
    partial = post.join(seeds, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("times")).alias("raw"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc()))
    bound = partial.withColumn("n", nth).filter(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("raw")).alias("bound"))
    common = Window.partitionBy("query_id").orderBy("ub", F.col("df").desc(), "term")
    needed = F.col("bound").isNull() | (F.sum("ub").over(common) >= F.col("bound") - ROUNDED)
    # a row a query term: small, and read by both sums
    terms = scratch.cut(terms.join(bound, "query_id", "left").select("query_id", "term", "times", "ub", "bound", needed.alias("needed")))
    rest = terms.groupBy("query_id").agg(F.max("bound").alias("bound"), F.sum(F.when(~F.col("needed"), F.col("ub")).otherwise(0.0)).alias("rest"))
    first = post.join(terms.filter("needed").select("query_id", "term", "times"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("times")).alias("raw"))
    open_ = scratch.cut(first.join(rest, "query_id").filter(F.col("bound").isNull() | (F.col("raw") + F.col("rest") >= F.col("bound") - ROUNDED)).select("query_id", "doc_id", "raw"))
    more = open_.select("query_id", "doc_id").join(post, "doc_id").join(terms.filter("not needed").select("query_id", "term", "times"), ["query_id", "term"]).select("query_id", "doc_id", (F.col("w") * F.col("times")).alias("raw"))
    return open_.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("raw").alias("raw"))


def bm25(docs: DataFrame, queries: DataFrame, terms, scratch: Scratch, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best k documents of each query.

    idf = ln(1 + (N - df + .5) / (df + .5)); scores relative to 1.05 times the
    query's best, between .1 and 1.  A repeated query term counts each time.
    Texts are read once: their postings of query terms, and their lengths, are
    written; other terms never leave the scan.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    listed = docs.select("doc_id", terms(F.col("text")).alias("terms"))
    # a null term stands for the document itself, so that lengths come with the postings
    wanted = asked.select("term").distinct().withColumn("asked", F.lit(True))
    every = listed.select("doc_id", F.size("terms").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"))
    held = scratch.cut(every.join(wanted, "term", "left").filter("asked or term is null").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")))
    stats = held.filter("term is null").agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    post = held.filter("term is not null")
    idf = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats).select("term", "avg_len", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = _best(post.join(idf, "term").select("doc_id", "term", weight.alias("w")), asked, scratch, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("raw", 6).desc(), "doc_id"))
    # the rank alone is filtered first, so that each task keeps k rows a query before the shuffle
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("best", F.max("raw").over(Window.partitionBy("query_id")))
    return top.select("query_id", "doc_id", F.round(F.least(F.greatest(F.col("raw") / (1.05 * F.col("best")), F.lit(0.1)), F.lit(1.0)), 6).alias("score"), "rank")


def exact(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entity_key, score): key 1.0, name .98, canonical name .95, case ignored."""
    q = queries.select("query", F.lower("query").alias("q")).distinct()
    tiers = [("entity_key", 1.0), ("name", 0.98), ("canonical_name", 0.95)]
    sides = entities.select("entity_key", F.explode(F.array(*[F.struct(F.lower(c).alias("q"), F.lit(s).alias("score")) for c, s in tiers])).alias("x")).select("entity_key", "x.*")
    return sides.join(q, "q").groupBy("query", "entity_key").agg(F.max("score").alias("score"))


def prefixed(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entity_key, score) of names that start with the query, case ignored.

    An equi-join on the name's start at the lengths that queries have, instead
    of comparing each name with each query.
    """
    q = queries.select("query", F.lower("query").alias("q")).filter("q != ''").distinct()
    lengths = q.select(F.length("q").alias("n")).distinct()
    names = entities.select("entity_key", F.lower("name").alias("name")).distinct()
    starts = names.join(lengths, F.length("name") >= F.col("n")).select("entity_key", F.length("name").alias("size"), F.expr("substring(name, 1, n)").alias("q"))
    score = F.greatest(F.lit(0.6), F.lit(0.9) - 0.02 * (F.col("size") - F.length("q")))
    return starts.join(q, "q").groupBy("query", "entity_key").agg(F.round(F.max(score), 6).alias("score"))


def overlap(texts: DataFrame, queries: DataFrame, terms, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): min(.95, .6 + .1 x shared terms), best k of each query.

    The stated queries meet every text inside its own row, so nothing but the
    best k of each task and query is shuffled.  Texts that share no term are no
    hits.  A set of queries too large to be sent along is met in blocks.
    """
    left = texts.select("id", F.array_distinct(terms(F.col("text"))).alias("terms")).filter(F.size("terms") > 0)
    right = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("asked")).filter(F.size("asked") > 0)
    shared = left.crossJoin(right).select("query_id", "id", F.size(F.array_intersect("asked", "terms")).alias("n")).filter("n > 0")
    scored = shared.select("query_id", "id", F.round(F.least(F.lit(0.95), 0.6 + 0.1 * F.col("n")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of unit rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(len(lists), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _blocks(df: DataFrame, id_: str, name: str, rows: int) -> DataFrame:
    """(name_ids, name_vectors) of about ``rows`` rows each, spread by hash."""
    n = df.count()
    held = df.filter(F.col(id_).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_).cast("long").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    return held.groupBy(F.pmod(F.xxhash64("i"), F.lit(max(1, -(-n // rows)))).alias("b")).agg(F.collect_list(F.struct("i", "v")).alias("x")).select(F.col("x.i").alias(f"{name}_ids"), F.col("x.v").alias(f"{name}_vectors"))


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.2, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): (cos + 1) / 2 of at least ``least``, best k, itself left out.

    Exact.  Vectors and the stated queries are put into blocks of a bounded
    size; each pair of blocks is one matrix product that keeps the best k of
    every query, and only those are ranked across blocks.  Nothing passes
    through the driver.  Vectors of one call have one length.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                v, q = b.column("v_ids")[r].values.to_numpy(), b.column("q_ids")[r].values.to_numpy()
                s = np.round(np.clip((_matrix(b.column("q_vectors")[r].values) @ _matrix(b.column("v_vectors")[r].values).T + 1) / 2, 0, 1), 6)
                s[q[:, None] == v[None, :]] = -1
                order = np.lexsort((np.broadcast_to(v, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(v[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "vec_id", "score"])

    pairs = _blocks(vectors, "vec_id", "v", block).crossJoin(_blocks(queries, "query_id", "q", block))
    out = pairs.mapInArrow(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.filter(F.col("score") >= least).withColumn("rank", rank).filter(F.col("rank") <= k)


def fuse(channels: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, id, fused): weighted reciprocal ranks and scores.

    ``channels``: query_id, channel, id, score, rank; repeats of an id in one
    channel each count.  Half the reciprocal-rank sum relative to the query's
    best, half the weighted score up to 1, to four decimals.
    """
    c = channels.join(weights, ["query_id", "channel"])
    s = c.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("rrf"), F.sum(F.col("weight") * F.col("score")).alias("w"))
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    return s.select("query_id", "id", F.round(ALPHA * F.col("rrf") / best + (1 - ALPHA) * F.least(F.lit(1.0), F.col("w")), 4).alias("fused"))
