"""Calls matched with the endpoints that serve them, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbers(path):
    return F.regexp_replace(path, "/[0-9]+", "/{id}")


def graded(calls: DataFrame, served: DataFrame) -> DataFrame:
    """(call_id, end_id, grade, confidence), each pair at its highest grade.

    ``calls``: call_id, method, path; ``served``: end_id, method, path.  Equal
    paths EXACT 1.0 (other method STRONG .9); equal behind the gateway prefix
    STRONG .9 (HEURISTIC .75); equal last two literal segments HEURISTIC .7
    (.6).  Each tier is an equi-join on its own key; a union keeps the best.
    """

    def keyed(df: DataFrame, own: str) -> DataFrame:
        p = _numbers(F.col("path"))
        words = F.filter(F.split(p, "/"), lambda s: (s != "") & ~s.startswith("{"))
        stripped = F.regexp_replace(p, r"^/api(?:/v\d+)?", "")
        keys = F.array_compact(F.array(F.struct(F.lit(1).alias("tier"), p.alias("key")), F.when(stripped != "", F.struct(F.lit(2).alias("tier"), stripped.alias("key"))), F.when(F.size(words) >= 2, F.struct(F.lit(3).alias("tier"), F.array_join(F.slice(words, -2, 2), "/").alias("key")))))
        return df.select(F.col(own), F.col("method").alias(f"{own}_method"), F.explode(keys).alias("k")).select(own, f"{own}_method", "k.tier", "k.key")

    both = keyed(calls, "call_id").join(keyed(served, "end_id"), ["tier", "key"])
    same = F.col("call_id_method") == F.col("end_id_method")
    rank = F.when(F.col("tier") == 1, F.when(same, F.struct(F.lit(1.0).alias("c"), F.lit("EXACT").alias("g"))).otherwise(F.struct(F.lit(0.9).alias("c"), F.lit("STRONG").alias("g")))).when(F.col("tier") == 2, F.when(same, F.struct(F.lit(0.9).alias("c"), F.lit("STRONG").alias("g"))).otherwise(F.struct(F.lit(0.75).alias("c"), F.lit("HEURISTIC").alias("g")))).otherwise(F.struct(F.when(same, F.lit(0.7)).otherwise(F.lit(0.6)).alias("c"), F.lit("HEURISTIC").alias("g")))
    best = both.groupBy("call_id", "end_id").agg(F.min(F.struct("tier", rank.alias("r"))).alias("m"))
    return best.select("call_id", "end_id", F.col("m.r.g").alias("grade"), F.col("m.r.c").alias("confidence"))


def ranked(matches: DataFrame, served: DataFrame) -> DataFrame:
    """Adds rank and ambiguous to graded matches; mock ends lose .4, legacy ones .25 (not below .1).

    ambiguous: the best two of a call are at most .2 apart.
    """
    text = F.lower(F.concat_ws(" ", "file_path", "path"))
    penal = served.select("end_id", F.when(text.contains("mock"), 0.4).when(text.rlike("legacy|deprecated"), 0.25).otherwise(0.0).alias("loss"))
    c = matches.join(penal, "end_id").withColumn("confidence", F.when(F.col("loss") > 0, F.greatest(F.col("confidence") - F.col("loss"), F.lit(0.1))).otherwise(F.col("confidence")))
    w = Window.partitionBy("call_id").orderBy(F.col("confidence").desc(), "end_id")
    out = c.withColumn("rank", F.row_number().over(w)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("confidence"))).over(Window.partitionBy("call_id"))).withColumn("first", F.max("confidence").over(Window.partitionBy("call_id")))
    return out.select("call_id", "end_id", "grade", F.round("confidence", 6).alias("confidence"), "rank", F.coalesce(F.round(F.col("first") - F.col("second"), 6) <= 0.2, F.lit(False)).alias("ambiguous"))


def by_prefix(raw: DataFrame, packages: DataFrame) -> DataFrame:
    """(raw, package, project_key): raw is the package or below it; the first other project by key.

    Instead of a theta join each raw target gives its path prefixes, which are
    joined by equality.
    """
    parts = F.split("raw", "/")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = raw.select("raw", F.col("project_key").alias("own"), F.explode(cut).alias("package")).distinct()
    hit = up.join(packages, "package").filter("project_key != own")
    return hit.groupBy("raw", "own", "package").agg(F.min("project_key").alias("project_key"))


def merged(candidates: DataFrame) -> DataFrame:
    """One row a relation_key: sites (distinct, sorted), greatest confidence, first object, resolved."""
    sites = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("line", "column"))), lambda s: F.concat_ws(":", s["line"].cast("string"), s["column"].cast("string"))), ",")
    return candidates.groupBy("relation_key").agg(sites.alias("sites"), F.count("*").alias("rows"), F.max("confidence").alias("confidence"), F.min("object_key").alias("object_key"), F.max(F.col("object_key").isNotNull()).alias("resolved"))


def dispatched(calls: DataFrame, implementations: DataFrame) -> DataFrame:
    """(call_key, impl_key, confidence): .9 for the only implementation, else 1/N to five decimals."""
    # counted by interface before the join, so no call's implementations are gathered in one place
    n = implementations.groupBy("interface").agg(F.count("*").alias("n"))
    return calls.join(implementations, "interface").join(n, "interface").select("call_key", "impl_key", F.when(F.col("n") == 1, F.lit(0.9)).otherwise(F.round(1 / F.col("n"), 5)).cast("decimal(6,5)").alias("confidence"))


#: What the names of one type may end in on either side.
TYPE_ENDINGS = r"(?:Dto|DTO|Request|Response|Entity|Model|Vo|VO)$"


def field_lineage(front: DataFrame, back: DataFrame) -> DataFrame:
    """(type, field, front_type, back_type, front_files, back_files): fields that types of one name share on both sides.

    ``front``, ``back``: file_id, owner, name, signature.  Names are compared
    without what marks a transfer type.  Each side is counted by type and field
    before the join, so a field that stands in many files is one row.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        kind = F.regexp_replace(F.regexp_extract("owner", r"[^.]*$", 0), TYPE_ENDINGS, "")
        return df.filter("owner is not null and name is not null").select(kind.alias("type"), F.col("name").alias("field"), "file_id", F.regexp_replace(F.coalesce("signature", F.lit("")), r"^:?\s*", "").alias("t")).filter("type != ''").groupBy("type", "field").agg(F.min("t").alias(f"{name}_type"), F.countDistinct("file_id").alias(f"{name}_files"))

    return side(front, "front").join(side(back, "back"), ["type", "field"]).select("type", "field", "front_type", "back_type", "front_files", "back_files")


def referenced(references: DataFrame, providers: DataFrame) -> DataFrame:
    """(project_key, name, provider_project, provider, confidence): contracts that other projects provide.

    ``references``: project_key, name; ``providers``: project_key, name, key.
    The least other project, then its least key, provides a name; .85.
    """
    # the two least projects of a name are enough to find one that is not one's own
    one = providers.filter("name is not null and project_key is not null").groupBy("name", "project_key").agg(F.min("key").alias("key"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("project_key"))
    least = one.withColumn("r", rank).filter("r <= 2").select("name", F.col("project_key").alias("provider_project"), F.col("key").alias("provider"))
    hit = references.select("project_key", "name").distinct().join(least, "name").filter("provider_project != project_key")
    best = hit.groupBy("project_key", "name").agg(F.min(F.struct("provider_project", "provider")).alias("m"))
    return best.select("project_key", "name", "m.provider_project", "m.provider", F.lit(0.85).alias("confidence"))
