"""Queries that build search indexes, events, links between manifests, paths and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import scalars, signatures
from loamgraph.operators import graph
from loamgraph.plans.catalog import _EDGES, relations
from loamgraph.sources import parse
from loamgraph.sources.tables import Scratch, table


def m3_signature_types(spark: SparkSession, d: str) -> DataFrame:
    """(change_id, types): the parameters' types of each changed signature."""
    c = table(spark, d, "entity_changes").filter("change_id is not null and signature like '%(%'")
    body = F.regexp_extract("signature", r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    return c.select("change_id", signatures.typescript_signature(body).alias("types"))


def m3_uri_parts(spark: SparkSession, d: str) -> DataFrame:
    """(entity_key, repository, path, symbol) from the address that each entity has."""
    e = table(spark, d, "entities").filter("entity_key is not null and project_key is not null and path is not null and not contains(path, '#')")
    uri = scalars.uri(F.col("project_key"), F.col("path"), F.when(F.col("entity_key").startswith("SYMBOL:"), F.col("name")))
    return e.select("entity_key", signatures.uri_parts(uri).alias("p")).select("entity_key", "p.*")


def m3_relation_keys(spark: SparkSession, d: str) -> DataFrame:
    """(sha, relation_key, trace_key): keys of the edges from commits to their projects."""
    c = table(spark, d, "commits").filter("sha is not null and project_key is not null and source_id is not null").select("sha", "project_key", "source_id").distinct()
    lit = F.lit
    return c.select("sha", signatures.relation_key(F.col("project_key"), F.col("sha"), lit("BELONGS_TO"), F.col("source_id"), lit("COMMIT")).alias("relation_key"), signatures.bridge_key("TRACE", F.col("project_key"), F.col("source_id"), F.col("sha"), lit("TRACES_TO"), signatures.endpoint_key(lit("get"), F.col("source_id")), lit("API")).alias("trace_key"))


def m2_event_fanout(spark: SparkSession, d: str) -> DataFrame:
    """(event_key, event_type, at): an event a commit, one a file it changed, one an entity of such a file."""
    c = table(spark, d, "commits").filter("sha is not null and project_key is not null").groupBy("sha").agg(F.max(F.struct("recorded_at", "project_key", "authored_at")).alias("m")).select("sha", "m.project_key", "m.authored_at")
    ch = table(spark, d, "entity_changes").select(F.col("commit_sha").alias("sha"), "file_rel_path", "entity_key")
    key = lambda kind, *more: F.concat_ws(":", F.lit("EVENT"), "project_key", F.lit(kind), "sha", *more)
    commits = c.select(key("COMMIT").alias("event_key"), F.lit("COMMIT").alias("event_type"), F.col("authored_at").alias("at"))
    files = ch.filter("file_rel_path is not null").select("sha", "file_rel_path").distinct().join(c, "sha").select(key("FILE_CHANGED", "file_rel_path"), F.lit("FILE_CHANGED"), "authored_at")
    entities = ch.filter("entity_key is not null").select("sha", "entity_key").distinct().join(c, "sha").select(key("ENTITY_CHANGED", "entity_key"), F.lit("ENTITY_CHANGED"), "authored_at")
    return commits.union(files).union(entities)


def m8_manifest_links(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, name, provider): dependencies of a manifest that another manifest provides, the least file of a name."""
    m = parse.manifest_entries(table(spark, d, "source_files").filter(F.lower("file_path").endswith(".json")))
    files = table(spark, d, "source_files").filter(F.lower("file_path").endswith(".json"))
    named = files.select("file_id", F.from_json("content", "name string").alias("j")).filter("j.name is not null")
    provider = named.groupBy(F.col("j.name").alias("name")).agg(F.min("file_id").alias("provider"))
    needs = m.filter("section != 'scripts'").select("file_id", "name").distinct()
    return needs.join(provider, "name").filter("provider != file_id").select("file_id", "name", "provider")


def m14_project_counts(spark: SparkSession, d: str) -> DataFrame:
    """(project_key, entities, files, commits, changes) of every project."""
    n = lambda name, what, cond="true": table(spark, d, name).filter(cond).groupBy("project_key").agg(F.countDistinct(what).alias("n"))
    p = table(spark, d, "projects").select(F.col("key").alias("project_key"))
    for alias, df in (("entities", n("entities", "entity_key")), ("files", n("entities", "entity_key", "entity_type = 'FILE'")), ("commits", n("commits", "sha")), ("changes", n("entity_changes", "change_id"))):
        p = p.join(df.withColumnRenamed("n", alias), "project_key", "left")
    return p.fillna(0, ["entities", "files", "commits", "changes"])


def m14_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, name, confidence) of the frameworks in the latest snapshot of each source."""
    last = table(spark, d, "project_snapshots").groupBy("source_id").agg(F.max(F.struct("created_at", "snapshot_id", "frameworks")).alias("m"))
    return last.select("source_id", F.explode(F.from_json("m.frameworks", "array<struct<name: string, confidence: double>>")).alias("f")).select("source_id", "f.name", "f.confidence")


def m4_index_rows(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, project_key, title, body_hash, dense): what each entity, document and commit puts into the indexes.

    dense: whether it goes to the vector index; entities do by type.
    """
    e = table(spark, d, "entities").filter("entity_key is not null").groupBy("entity_key").agg(F.max(F.struct("updated_at", "project_key", "name", "entity_type", "path")).alias("m")).select("entity_key", "m.*")
    types = ["CLASS", "INTERFACE", "FUNCTION", "METHOD", "FILE", "COMPONENT"]
    ents = e.select(F.lit("ENTITY").alias("kind"), F.col("entity_key").alias("id"), "project_key", F.col("name").alias("title"), F.md5(F.concat_ws(" ", "entity_type", "name", "path")).alias("body_hash"), F.coalesce(F.col("entity_type").isin(types), F.lit(False)).alias("dense"))
    docs = table(spark, d, "documents").select(F.lit("DOCUMENT"), F.col("doc_id").cast("string"), "project_key", "title", F.md5(F.concat_ws(" ", "title", "text")), F.lit(True))
    c = table(spark, d, "commits").filter("sha is not null").groupBy("sha").agg(F.max(F.struct("recorded_at", "project_key", "message")).alias("m"))
    commits = c.select(F.lit("COMMIT"), "sha", "m.project_key", F.substring_index("m.message", "\n", 1), F.md5(F.coalesce("m.message", F.lit(""))), F.lit(False))
    return ents.union(docs).union(commits)


def m7_paths(spark: SparkSession, d: str) -> DataFrame:
    """(id, hops, narrative): one shortest path to each node within two hops of a supplier."""
    seeds = spark.createDataFrame([("SUPPLIER:1",)], "id string")
    return graph.paths(relations(spark, d), seeds, Scratch(spark, "paths"), "both", 2)


QUERIES = {f.__name__: f for f in (m3_signature_types, m3_uri_parts, m3_relation_keys, m2_event_fanout, m8_manifest_links, m14_project_counts, m14_frameworks, m4_index_rows, m7_paths)}

_COMMITS = "c as (select * from (select *, row_number() over (partition by sha order by recorded_at desc nulls last, project_key desc nulls last, {}) as rn from commits where sha is not null{}) where rn = 1)"
ORACLE = {
    "m3_uri_parts": "select entity_key, project_key as repository, path, case when entity_key like 'SYMBOL:%' then nullif(name, '') end as symbol from entities where entity_key is not null and project_key is not null and path is not null and not contains(path, '#')",
    "m3_relation_keys": "select distinct sha, 'RELATION:' || project_key || ':' || sha || ':BELONGS_TO:' || source_id || ':COMMIT:default' as relation_key, 'RELATION:TRACE:' || project_key || ':' || source_id || ':' || sha || ':TRACES_TO:ENDPOINT:GET:' || source_id || ':API:default' as trace_key from commits where sha is not null and project_key is not null and source_id is not null",
    "m2_event_fanout": f"""with {_COMMITS.format('authored_at desc nulls last', ' and project_key is not null')} select 'EVENT:' || project_key || ':COMMIT:' || sha as event_key, 'COMMIT' as event_type, authored_at as at from c
union all select 'EVENT:' || project_key || ':FILE_CHANGED:' || sha || ':' || file_rel_path, 'FILE_CHANGED', c.authored_at from (select distinct commit_sha, file_rel_path from entity_changes where file_rel_path is not null) x join c on c.sha = x.commit_sha
union all select 'EVENT:' || project_key || ':ENTITY_CHANGED:' || sha || ':' || entity_key, 'ENTITY_CHANGED', c.authored_at from (select distinct commit_sha, entity_key from entity_changes where entity_key is not null) x join c on c.sha = x.commit_sha""",
    "m8_manifest_links": """with v as (select file_id, content from source_files where lower(file_path) like '%.json' and content is not null and json_valid(content) and json_type(content) = 'OBJECT' and (content ->> '$.name') is not null),
p as (select content ->> '$.name' as name, min(file_id) as provider from v group by 1), s as (select distinct file_id, unnest(json_keys(content, '$.' || section)) as name from v, (values ('dependencies'), ('devDependencies'), ('peerDependencies'), ('optionalDependencies')) t(section) where json_type(content, '$.' || section) = 'OBJECT')
select s.file_id, s.name, p.provider from s join p using (name) where p.provider <> s.file_id""",
    "m14_project_counts": """select p.key as project_key, coalesce(e.n, 0) as entities, coalesce(e.f, 0) as files, coalesce(c.n, 0) as commits, coalesce(x.n, 0) as changes from projects p
left join (select project_key, count(distinct entity_key) as n, count(distinct entity_key) filter (where entity_type = 'FILE') as f from entities group by 1) e on e.project_key = p.key
left join (select project_key, count(distinct sha) as n from commits group by 1) c on c.project_key = p.key left join (select project_key, count(distinct change_id) as n from entity_changes group by 1) x on x.project_key = p.key""",
    "m14_frameworks": """with l as (select source_id, max_by(frameworks, (created_at, snapshot_id)) as f from project_snapshots group by source_id), x as (select source_id, unnest(from_json(f, '[{"name":"VARCHAR","confidence":"DOUBLE"}]')) as e from l) select source_id, e.name as name, e.confidence as confidence from x""",
    "m4_index_rows": f"""with e as (select * from (select *, row_number() over (partition by entity_key order by updated_at desc nulls last, project_key desc nulls last, name desc nulls last, entity_type desc nulls last, path desc nulls last) as rn from entities where entity_key is not null) where rn = 1), {_COMMITS.format('message desc nulls last', '')}
select 'ENTITY' as kind, entity_key as id, project_key, name as title, md5(concat_ws(' ', entity_type, name, path)) as body_hash, coalesce(entity_type in ('CLASS', 'INTERFACE', 'FUNCTION', 'METHOD', 'FILE', 'COMPONENT'), false) as dense from e
union all select 'DOCUMENT', doc_id::varchar, project_key, title, md5(concat_ws(' ', title, text)), true from documents union all select 'COMMIT', sha, project_key, split_part(message, chr(10), 1), md5(coalesce(message, '')), false from c""",
    "m7_paths": f"""with {_EDGES}, w as (select src as a, dst as b, predicate from e union all select dst, src, predicate from e),
one as (select b as id, 1 as hops, min('SUPPLIER:1 --[' || predicate || ']--> ' || b) as narrative from w where a = 'SUPPLIER:1' and b <> 'SUPPLIER:1' group by b),
two as (select w.b as id, 2 as hops, min(one.narrative || ' --[' || w.predicate || ']--> ' || w.b) as narrative from one join w on w.a = one.id where w.b <> 'SUPPLIER:1' and w.b not in (select id from one) group by w.b)
select * from one union all select * from two""",
}
