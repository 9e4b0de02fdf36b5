"""Queries over source code as a graph, and over its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.normal import fwd
from loamgraph.operators import contracts, graphstate, relations, resolve, state
from loamgraph.sources import code, parse
from loamgraph.sources.tables import Scratch, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return code.extracted(table(spark, d, "source_files"))


def m13_symbols_full(spark: SparkSession, d: str) -> DataFrame:
    """Every declaration of every file: kind, qualified name, signature, modifiers and lines."""
    return code.symbols(_rows(spark, d))


def m13_calls(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, row, subject, target, arguments, line) of calls and constructions."""
    return _rows(spark, d).filter("row in ('call', 'new')").select("file_id", "row", F.col("owner").alias("subject"), "target", "arguments", "line")


def m13_extends(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, predicate, subject, target, line) of types that extend or implement others."""
    return _rows(spark, d).filter("row = 'heritage'").select("file_id", F.col("kind").alias("predicate"), F.col("owner").alias("subject"), "target", "line")


def m13_module_imports(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, kind, target, names, line) of imports and re-exports."""
    return _rows(spark, d).filter("row = 'import'").select("file_id", "kind", "target", F.col("detail").alias("names"), "line")


def m13_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, side, method, path, handler, services, line): served routes and client calls."""
    return _rows(spark, d).filter("row in ('endpoint', 'client')").select("file_id", F.when(F.col("row") == "endpoint", "SERVED").otherwise("CALLED").alias("side"), F.col("kind").alias("method"), F.col("target").alias("path"), F.col("owner").alias("handler"), F.when(F.col("row") == "endpoint", F.col("detail")).alias("services"), "line")


def m13_component_facts(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, fact, name, count) of single-file components: macros, option groups, events and used components."""
    r = _rows(spark, d).filter("row in ('macro', 'options', 'event', 'template')")
    return r.groupBy("file_id", F.col("row").alias("fact"), F.coalesce("name", "detail").alias("name")).agg(F.count("*").alias("count"))


def m13_extraction_status(spark: SparkSession, d: str) -> DataFrame:
    """(language, reason, files, symbols): how files were read; the files of all rows are those of the table."""
    s = _rows(spark, d).filter("row = 'status'")
    return s.groupBy(F.coalesce("kind", F.lit("")).alias("language"), F.col("name").alias("reason")).agg(F.count("*").alias("files"), F.sum("arguments").alias("symbols"))


def edges_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, predicate, dst, tier) of resolved relations, by entity keys, and (src, target) of imports that mean no file."""
    spark = files.sparkSession
    scratch = Scratch(spark, "resolved")
    rows = scratch.cut(code.extracted(files))
    index = scratch.cut(resolve.file_index(files))
    top = rows.filter("row = 'symbol' and owner = ''").select("file_id", "name")
    imported = rows.filter("row = 'import'")
    found = scratch.cut(resolve.modules(imported, index, rows.filter("row = 'package'").select("file_id", "name"), top))
    path = index.select("file_id", F.concat(F.lit("FILE:"), "project_key", F.lit(":"), "path").alias("key"))
    of = lambda name: path.select(F.col("file_id").alias(f"{name}_id"), F.col("key").alias(name))
    imports = found.join(of("src"), F.col("file_id") == F.col("src_id")).join(of("dst"), F.col("object") == F.col("dst_id")).select("src", F.lit("IMPORTS").alias("predicate"), "dst", "tier")
    edges = resolve.symbols_of(code.relations(rows), rows, index, found)
    named = scratch.cut(resolve.keys(rows, index))
    inner = named.select("file_id", F.col("qualified").alias("subject"), F.col("key").alias("src"))
    target = named.select(F.col("file_id").alias("object_file"), F.col("qualified").alias("object"), F.col("key").alias("dst"))
    whole = path.select("file_id", F.col("key").alias("file_key"))
    sym = edges.join(inner, ["file_id", "subject"], "left").join(whole, "file_id").join(target, ["object_file", "object"]).select(F.coalesce("src", "file_key").alias("src"), "predicate", "dst", "tier")
    outside = imported.select("file_id", "target").distinct().join(found.select("file_id", "target"), ["file_id", "target"], "left_anti").join(whole, "file_id").select(F.col("file_key").alias("src"), "target").distinct()
    return imports.unionByName(sym).distinct(), outside


def m8_resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, predicate, dst, tier): imports between files and edges between symbols, by entity keys."""
    return edges_of(table(spark, d, "source_files"))[0]


def m8_resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, target, object): relative and aliased imports, as read by pattern, with the file each means."""
    files = table(spark, d, "source_files")
    scratch = Scratch(spark, "imports")
    index = scratch.cut(resolve.file_index(files))
    none = spark.createDataFrame([], "file_id long, name string")
    found = resolve.modules(parse.imports(files).filter(F.col("target").rlike(r"^(\.\.?/|@/)")), index, none, none)
    return found.filter("tier = 'PATH'").select("file_id", "target", "object")


def m8_field_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Fields that an interface of client code and a class of served code of one name share."""
    rows = Scratch(spark, "fields").cut(_rows(spark, d))
    kind = rows.filter("row = 'status'").select("file_id", F.col("kind").alias("language"))
    front = rows.filter("row = 'field'").select("file_id", "owner", "name", "signature")
    back = rows.filter("row = 'symbol' and kind = 'FIELD'").join(kind.filter("language = 'java'").select("file_id").distinct(), "file_id", "left_semi").select("file_id", "owner", "name", "signature")
    return contracts.field_lineage(front, back)


def m8_contract_references(spark: SparkSession, d: str) -> DataFrame:
    """Names that a project imports from outside and another project exports as a type."""
    files = table(spark, d, "source_files")
    rows = Scratch(spark, "references").cut(code.extracted(files))
    of = files.filter("file_id is not null and project_key is not null").groupBy("file_id").agg(F.min("project_key").alias("project_key"), F.min("entity_key").alias("key"))
    wanted = rows.filter("row = 'import' and detail != ''").select("file_id", F.explode(F.split("detail", ",")).alias("name")).join(of, "file_id").select("project_key", "name")
    own = rows.filter("row = 'symbol' and owner = ''").join(of, "file_id").select("project_key", "name").distinct()
    offered = rows.filter("row = 'symbol' and exported and owner = '' and kind in ('INTERFACE', 'CLASS', 'TYPE', 'ENUM')").join(of, "file_id").select("project_key", "name", "key")
    return contracts.referenced(wanted.distinct().join(own, ["project_key", "name"], "left_anti"), offered)


def _relation_side(files: DataFrame, pick) -> DataFrame:
    """Imports by path of the first or last delivery of each path of a source."""
    one = files.filter("file_path is not null and content is not null").groupBy("source_id", "file_path").agg(pick("file_id").alias("file_id"))
    rel = parse.imports(files).join(one, "file_id")
    return rel.select(F.concat_ws("|", "source_id", "file_path", "target").alias("relation_key"), F.concat_ws("|", "source_id", "file_path").alias("file"), "occurrences", F.lit(None).cast("string").alias("object"))


def m11_relation_sync(spark: SparkSession, d: str) -> DataFrame:
    """(relation_key, outcome, status, occurrences): imports of the first delivery of each path, after the last one came."""
    files = table(spark, d, "source_files")
    old, new = _relation_side(files, F.min), _relation_side(files, F.max)
    delivered = files.filter("file_path is not null and content is not null").select(F.concat_ws("|", "source_id", "file_path").alias("file"))
    return relations.synced(old.withColumn("status", F.lit("ACTIVE")), new, delivered).select("relation_key", "outcome", "status", "occurrences")


def _versions(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities and edges of all sources at their first and at their last snapshot.

    A file holds its own entity and its symbols; edges: a file DEFINES the
    symbols of its path, a directory CONTAINS what lies one level below.
    """
    s = table(spark, d, "project_snapshots").filter("snapshot_id is not null").groupBy("source_id").agg(F.min(F.struct("created_at", "snapshot_id")).alias("a"), F.max(F.struct("created_at", "snapshot_id")).alias("z"))
    ends = s.select(F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a.snapshot_id").alias("snapshot_id")), F.struct(F.lit(1).alias("end"), F.col("z.snapshot_id").alias("snapshot_id")))).alias("e")).select("e.*")
    e = table(spark, d, "snapshot_entities").filter("entity_key is not null and file_path is not null").join(ends, "snapshot_id")
    value = F.concat_ws("|", F.coalesce("name", F.lit("")), F.lower(F.coalesce("status", F.lit(""))), F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", ""))
    e = scratch.cut(e.groupBy("end", fwd(F.col("entity_key")).alias("key")).agg(F.max(F.struct(fwd(F.col("file_path")).alias("path"), value.alias("value"), "entity_type", "repo_id")).alias("m")).select("end", "key", "m.*").withColumn("file", F.concat_ws("|", "repo_id", "path")))
    holders = e.filter("entity_type = 'FILE'").groupBy("end", "file").agg(F.min("key").alias("src"))
    defines = e.filter("entity_type not in ('FILE', 'DIRECTORY')").join(holders, ["end", "file"]).select("end", "src", F.lit("DEFINES").alias("predicate"), F.col("key").alias("dst"), "file")
    dirs = e.filter("entity_type = 'DIRECTORY'").groupBy("end", "file").agg(F.min("key").alias("src")).withColumnRenamed("file", "up")
    below = e.filter("entity_type in ('FILE', 'DIRECTORY')").withColumn("up", F.concat_ws("|", "repo_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    contains = below.join(dirs, ["end", "up"]).filter("key != src").select("end", "src", F.lit("CONTAINS").alias("predicate"), F.col("key").alias("dst"), "file")
    edges = scratch.cut(defines.unionByName(contains).distinct())
    part = lambda df, n: df.filter(F.col("end") == n).drop("end")
    cols = ["end", "key", "file", "value"]
    return part(e.select(*cols), 0), part(edges, 0), part(e.select(*cols), 1), part(edges, 1)


def m11_entity_delta(spark: SparkSession, d: str) -> DataFrame:
    """(key, change): entities added, deleted or modified from the first to the last snapshot of each source."""
    old, _, new, _ = _versions(spark, d, Scratch(spark, "delta"))
    return graphstate.delta(old, new).select("key", "change")


def m11_edge_diff(spark: SparkSession, d: str) -> DataFrame:
    """(src, predicate, dst, change): edges added or deleted from the first to the last snapshot of each source."""
    _, old, _, new = _versions(spark, d, Scratch(spark, "edges"))
    return graphstate.edge_delta(old, new)


def _updated(spark: SparkSession, d: str):
    """A store with the first snapshots, updated by the files that differ in the last ones."""
    scratch = Scratch(spark, "store")
    old, old_edges, new, new_edges = _versions(spark, d, scratch)
    store = graphstate.GraphStore(spark, scratch.folder())
    store.publish(old, old_edges)
    # a file changed if an entity or an edge that it holds did
    held = lambda e, v: e.select("file", F.concat_ws("|", "key", "value").alias("x")).unionByName(v.select("file", F.concat_ws("|", "src", "predicate", "dst").alias("x"))).distinct()
    a, b = held(old, old_edges).withColumn("a", F.lit(1)), held(new, new_edges).withColumn("b", F.lit(1))
    changed = scratch.cut(a.join(b, ["file", "x"], "full_outer").filter("a is null or b is null").select("file").distinct())
    return store, changed, new, new_edges


def m11_publish(spark: SparkSession, d: str) -> DataFrame:
    """(key, value) after an incremental update; the SQL takes the last snapshots from scratch."""
    store, changed, new, new_edges = _updated(spark, d)
    store.update(changed, new.join(changed, "file", "left_semi"), new_edges.join(changed, "file", "left_semi"))
    return store.entities().select("key", "value")


def m11_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """One row: how far the edges of the incremental update equal those of a full rebuild."""
    store, changed, new, new_edges = _updated(spark, d)
    store.update(changed, new.join(changed, "file", "left_semi"), new_edges.join(changed, "file", "left_semi"))
    key = lambda df: df.select(F.concat_ws("|", "src", "predicate", "dst").alias("key"), F.col("file").alias("value"))
    return state.equivalence(key(store.edges()), key(new_edges))


def m11_rollback(spark: SparkSession, d: str) -> DataFrame:
    """(key, value) after an update that would leave edges without an end was refused: the first snapshots still."""
    store, changed, _, new_edges = _updated(spark, d)
    try:
        store.update(changed, store.entities().filter("false"), new_edges.join(changed, "file", "left_semi"))
    except graphstate.Refused:
        pass
    return store.entities().select("key", "value")


QUERIES = {f.__name__: f for f in (m13_symbols_full, m13_calls, m13_extends, m13_module_imports, m13_endpoints, m13_component_facts, m13_extraction_status, m8_resolved_edges, m8_resolved_imports, m8_field_lineage, m8_contract_references, m11_relation_sync, m11_entity_delta, m11_edge_diff, m11_publish, m11_rebuild, m11_rollback)}

_IMPORTS = r"""imp as (select file_id, target, count(*) as occurrences from (select file_id, unnest(list_concat(regexp_extract_all(content, '(?m)^\s*import\s+(?:[^''";]*?from\s+)?[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, '(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;', 1))) as target from source_files) group by all)"""
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '/$', '')"
_VALUE = r"coalesce(name, '') || '|' || lower(coalesce(status, '')) || '|' || regexp_replace(coalesce(signature, ''), '\s+', '', 'g')"
_GRAPH = rf"""s as (select source_id, min_by(snapshot_id, (created_at, snapshot_id)) as a, max_by(snapshot_id, (created_at, snapshot_id)) as z from project_snapshots where snapshot_id is not null group by source_id),
x as (select 0 as "end", a as snapshot_id from s union all select 1, z from s),
r as (select x."end", replace(entity_key, '\', '/') as key, replace(file_path, '\', '/') as path, {_VALUE} as value, entity_type, repo_id from snapshot_entities join x using (snapshot_id) where entity_key is not null and file_path is not null),
e as (select *, repo_id || '|' || path as file from (select *, row_number() over (partition by "end", key order by path desc, value desc, entity_type desc, repo_id desc) as rn from r) where rn = 1),
h as (select "end", file, min(key) as src from e where entity_type = 'FILE' group by all), g as (select "end", file as up, min(key) as src from e where entity_type = 'DIRECTORY' group by all),
v as (select distinct e."end", h.src, 'DEFINES' as predicate, e.key as dst, e.file from e join h on h."end" = e."end" and h.file = e.file where e.entity_type not in ('FILE', 'DIRECTORY') union
select e."end", g.src, 'CONTAINS', e.key, e.file from e join g on g."end" = e."end" and g.up = e.repo_id || '|' || regexp_extract(e.path, '^(.*)/[^/]*$', 1) where e.entity_type in ('FILE', 'DIRECTORY') and e.key <> g.src)"""
_ENDINGS = ", ".join(f"('{e}', {n})" for n, e in enumerate(resolve.ENDINGS))
ORACLE = {
    "m11_relation_sync": f"""with {_IMPORTS}, f as (select source_id, file_path, min(file_id) as a, max(file_id) as z from source_files where file_path is not null and content is not null group by all),
o as (select concat_ws('|', source_id, file_path, target) as k, sum(occurrences) as n from f join imp on imp.file_id = f.a group by all), w as (select concat_ws('|', source_id, file_path, target) as k, sum(occurrences) as n from f join imp on imp.file_id = f.z group by all)
select coalesce(o.k, w.k) as relation_key, case when o.k is null then 'CREATED' when w.k is null then 'DELETED' when o.n = w.n then 'UNCHANGED' else 'UPDATED' end as outcome, case when w.k is null then 'DELETED' else 'ACTIVE' end as status, cast(coalesce(w.n, o.n) as bigint) as occurrences from o full join w on o.k = w.k""",
    "m8_resolved_imports": rf"""with {_IMPORTS}, i as (select source_id, {_CLEAN} as path, max_by(file_id, (ingested_at, file_id)) as file_id from source_files where file_id is not null and file_path is not null group by all),
q as (select imp.file_id, target, i.source_id, i.path as own, case when target like '@/%' then [split_part(i.path, '/', 1) || '/src/' || target[3:], split_part(i.path, '/', 1) || '/' || target[3:]] else [regexp_replace(i.path, '(^|/)[^/]*$', '') || '/' || target] end as w from imp join i using (file_id) where regexp_matches(target, '^(\.\.?/|@/)')),
p as (select file_id, target, source_id, own, a, list_reduce(list_prepend([]::varchar[], list_transform(string_split(w[a], '/'), lambda s: [s])), lambda acc, s: case when acc is null then null when s[1] in ('', '.') then acc when s[1] <> '..' then list_concat(acc, s) when len(acc) > 0 then acc[1:len(acc) - 1] else null end) as parts from (select *, unnest(range(1, len(w) + 1)) as a from q)),
c as (select p.*, array_to_string(parts, '/') || t.ending as path, t.b from p, (values {_ENDINGS}) t(ending, b) where parts is not null)
select c.file_id, target, min_by(i.file_id, (a, b, i.file_id)) as object from c join i on i.source_id is not distinct from c.source_id and i.path = c.path where c.own <> c.path group by all""",
    "m11_entity_delta": f"""with {_GRAPH}, a as (select * from e where "end" = 0), b as (select * from e where "end" = 1)
select coalesce(a.key, b.key) as key, case when a.key is null then 'ADDED' when b.key is null then 'DELETED' else 'MODIFIED' end as change from a full join b on a.key = b.key where a.key is null or b.key is null or a.value <> b.value""",
    "m11_edge_diff": f"""with {_GRAPH}, a as (select distinct src, predicate, dst from v where "end" = 0), b as (select distinct src, predicate, dst from v where "end" = 1)
select src, predicate, dst, 'ADDED' as change from (select * from b except select * from a) union all select src, predicate, dst, 'DELETED' from (select * from a except select * from b)""",
    "m11_publish": f"""with {_GRAPH} select key, value from e where "end" = 1""",
    "m11_rebuild": f"""with {_GRAPH} select count(*) as shared, cast(0 as bigint) as only_left, cast(0 as bigint) as only_right, cast(0 as bigint) as differing, 1.0::double as match_rate from (select distinct src, predicate, dst, file from v where "end" = 1)""",
    "m11_rollback": f"""with {_GRAPH} select key, value from e where "end" = 0""",
}
