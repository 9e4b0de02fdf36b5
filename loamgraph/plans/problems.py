"""Queries of the general data problems: changed records, snapshots, history, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.normal import clean_path, parent_path, sha_ref, strip_ws
from loamgraph.operators.ancestry import ancestry, descendants
from loamgraph.operators.gitgraph import commit_nodes, resolve_refs
from loamgraph.operators.hierarchy import closure, forest
from loamgraph.operators.history import versions
from loamgraph.operators.newcommits import new_commits
from loamgraph.operators.snapshot_diff import diff
from loamgraph.sources.tables import Scratch, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, sha) of commits that are new in each completed run: the output of a ledger that starts empty."""
    return new_commits(table(spark, d, "ingestion_runs"), table(spark, d, "commits"), Scratch(spark, "commit-ledger").folder())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, entity_key, change_kind) against the complete snapshot before."""
    return diff(table(spark, d, "project_snapshots"), table(spark, d, "snapshot_entities"), Scratch(spark, "snapshots").cut)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(entity_key, valid_from_us, valid_to_us) of each version."""
    return versions(table(spark, d, "entity_changes")).select("entity_key", "valid_from_us", "valid_to_us")


def entity_nodes(entities: DataFrame) -> DataFrame:
    """(id, parent, label) of DIRECTORY and FILE entities with a path.

    The latest updated_at of a key counts, ties by the greater path.  Where two
    directories of a project have one path, the smaller key is the parent.
    """
    m = F.max(F.struct("updated_at", F.upper(strip_ws(F.col("entity_type"))).alias("kind"), clean_path(F.col("path")).alias("path"), "project_key")).alias("m")
    one = entities.filter("entity_key is not null").groupBy("entity_key").agg(m).select("entity_key", "m.kind", "m.path", "m.project_key").filter("path is not null and kind in ('DIRECTORY', 'FILE')")
    dirs = one.filter("kind = 'DIRECTORY'").groupBy(F.col("project_key").alias("d_project"), F.col("path").alias("d_path")).agg(F.min("entity_key").alias("parent"))
    up = parent_path(F.col("path"))
    return one.withColumn("up", up).join(dirs, F.col("project_key").eqNullSafe(F.col("d_project")) & (F.col("up") == F.col("d_path")), "left").select(F.col("entity_key").alias("id"), "parent", F.regexp_extract("path", "[^/]*$", 0).alias("label"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(node_kind, node_id, root_id, node_depth, on_cycle) of commits and entities."""
    scratch = Scratch(spark, "hierarchy")
    tag = lambda df, kind: df.select(F.concat(F.lit(kind[0]), "id").alias("id"), F.concat(F.lit(kind[0]), "parent").alias("parent"))
    nodes = tag(commit_nodes(table(spark, d, "commits")), "commit").unionByName(tag(entity_nodes(table(spark, d, "entities")), "entity"))
    found = forest(nodes, scratch)
    return found.select(F.when(F.col("id").startswith("c"), "commit").otherwise("entity").alias("node_kind"), F.expr("substring(id, 2)").alias("node_id"), F.expr("substring(root_id, 2)").alias("root_id"), "node_depth", "on_cycle")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, root_id, node_depth, full_path) of the directory trees, level by level."""
    paths, _ = closure(entity_nodes(table(spark, d, "entities")), Scratch(spark, "paths"))
    return paths.select(F.col("id").alias("node_id"), "root_id", "node_depth", "full_path")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of the directory trees."""
    _, pairs = closure(entity_nodes(table(spark, d, "entities")), Scratch(spark, "descendants"))
    return pairs.select("ancestor_id", F.col("id").alias("descendant_id"), "distance")


def p5_subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, descendants) of each commit that reaches a root."""
    found = forest(commit_nodes(table(spark, d, "commits")).select("id", "parent"), Scratch(spark, "sizes"), sizes=True)
    return found.filter("node_depth >= 0").select(F.col("id").alias("node_id"), (F.col("size") - 1).alias("descendants"))


def p5_commit_trees(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, root_id, node_depth, chain, seq, path, first, last): path and descendants of each commit, see ``ancestry``."""
    return ancestry(commit_nodes(table(spark, d, "commits")), Scratch(spark, "commit-trees")).withColumnRenamed("id", "node_id")


def p5_commit_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(ancestor_id, descendant_id, distance): all commits below the heads of snapshots."""
    nodes = commit_nodes(table(spark, d, "commits"))
    scratch = Scratch(spark, "commit-descendants")
    nodes = scratch.cut(nodes)
    heads = table(spark, d, "project_snapshots").select("source_id", sha_ref(F.col("head")).alias("ref")).distinct()
    asked = resolve_refs(heads, nodes.select(F.col("id").alias("sha"), "source_id")).groupBy("source_id", "ref").agg(F.min("found").alias("id"))
    return descendants(scratch.cut(ancestry(nodes, scratch)), asked)


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p5_paths, p5_descendants, p5_commit_trees, p5_commit_descendants, p5_subtree_sizes)}

_ONE = """one as (select sha, source_id, parent_ref from (select sha, source_id, nullif(regexp_replace(lower(regexp_replace(parent_sha, '^\\s+|\\s+$', '', 'g')), '^0+$', ''), '') as parent_ref, row_number() over (partition by sha order by recorded_at desc nulls last, nullif(regexp_replace(lower(regexp_replace(parent_sha, '^\\s+|\\s+$', '', 'g')), '^0+$', ''), '') desc nulls last, source_id desc) as rn from commits where sha is not null) where rn = 1),
par as (select c.sha as id, min(p.sha) as parent from one c left join one p on p.source_id = c.source_id and left(p.sha, 10) = left(c.parent_ref, 10) and (p.sha = c.parent_ref or (length(c.parent_ref) between 10 and 39 and starts_with(p.sha, c.parent_ref))) group by c.sha)"""
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '/$', '')"
_ENT = f"""ent as (select entity_key, kind, path, project_key from (select entity_key, upper(trim(entity_type)) as kind, {_CLEAN} as path, project_key, row_number() over (partition by entity_key order by updated_at desc nulls last) as rn from entities where entity_key is not null) where rn = 1 and path is not null and kind in ('DIRECTORY', 'FILE')),
epar as (select e.entity_key as id, min(d.entity_key) as parent, any_value(regexp_extract(e.path, '[^/]*$')) as label from ent e left join ent d on d.kind = 'DIRECTORY' and d.project_key is not distinct from e.project_key and e.path like '%/%' and d.path = regexp_replace(e.path, '/[^/]*$', '') group by e.entity_key)"""
_RUNS = """run as (select run_id, source_id, upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) as state, finished_at, nullif(regexp_replace(lower(regexp_replace(head_after, '^\\s+|\\s+$', '', 'g')), '^0+$', ''), '') as ref from (select *, row_number() over (partition by run_id order by updated_at desc) as rn from ingestion_runs where run_id is not null) where rn = 1),
head as (select r.run_id, any_value(r.finished_at) as finished_at, min(c.sha) as id from run r join one c on c.source_id = r.source_id and left(c.sha, 10) = left(r.ref, 10) and (c.sha = r.ref or (length(r.ref) between 10 and 39 and starts_with(c.sha, r.ref))) where r.state = 'COMPLETED' group by r.run_id)"""
ORACLE: dict[str, str] = {
    "p2_found": f"""with recursive {_ONE}, {_RUNS}, reach(run_id, finished_at, id) as (select run_id, finished_at, id from head union select r.run_id, r.finished_at, p.parent from reach r join par p on p.id = r.id where p.parent is not null),
f as (select id, min(finished_at) as at0 from reach group by id) select run_id, reach.id as sha from reach join f on f.id = reach.id and f.at0 = reach.finished_at""",
    "p3_found": r"""with k as (select distinct snapshot_id, replace(entity_key, '\', '/') as entity_key, entity_type, name, lower(status) as status, regexp_replace(signature, '\s+', '', 'g') as signature,
case when metadata is null then '' else coalesce((select string_agg(j || '=' || v, '|' order by j) from (select unnest(json_keys(metadata)) as j, metadata ->> ('$.' || j) as v, json_type(metadata, '$.' || j) as t) where t <> 'NULL'), '') end as metadata from snapshot_entities where entity_key is not null),
s as (select distinct snapshot_id, source_id, file_count, created_at from project_snapshots), n as (select snapshot_id, count(distinct entity_key) as files from k where entity_type = 'FILE' group by 1),
c as (select s.*, lag(snapshot_id) over (partition by source_id order by created_at, snapshot_id) as prev_id from s left join n using (snapshot_id) where coalesce(files, 0) = file_count),
old as (select c.snapshot_id, k.* exclude (snapshot_id) from k join c on k.snapshot_id = c.prev_id), new as (select k.* from k join c on k.snapshot_id = c.snapshot_id and c.prev_id is not null)
select coalesce(old.snapshot_id, new.snapshot_id) as snapshot_id, coalesce(old.entity_key, new.entity_key) as entity_key, case when old.entity_key is null then 'added' when new.entity_key is null then 'removed' else 'changed' end as change_kind
from old full join new on old.snapshot_id = new.snapshot_id and old.entity_key = new.entity_key where old.entity_key is null or new.entity_key is null or (old.name, old.status, old.signature, old.metadata) is distinct from (new.name, new.status, new.signature, new.metadata)""",
    "p4_found": r"""with o as (select entity_key, epoch_us(authored_at) as t0, change_type, status, signature, file_rel_path from entity_changes where entity_key is not null and authored_at is not null qualify row_number() over (partition by entity_key, authored_at order by change_id desc) = 1),
g as (select entity_key, t0, coalesce(upper(trim(change_type)), '') = 'DELETED' as gone, lower(status) as s, regexp_replace(signature, '\s+', '', 'g') as g, replace(file_rel_path, '\', '/') as p from o),
n as (select entity_key, t0, gone, last_value(case when not gone then s end ignore nulls) over w as s, last_value(case when not gone then g end ignore nulls) over w as g, last_value(case when not gone then p end ignore nulls) over w as p from g window w as (partition by entity_key order by t0 rows unbounded preceding)),
m as (select *, lag(gone) over w as wg, lag(s) over w as ws, lag(g) over w as wgg, lag(p) over w as wp from n window w as (partition by entity_key order by t0)),
i as (select *, lead(t0) over (partition by entity_key order by t0) as nxt from m where wg is null or wg <> gone or (not gone and (s, g, p) is distinct from (ws, wgg, wp)))
select entity_key, t0 as valid_from_us, coalesce(nxt, -1) as valid_to_us from i where not gone""",
    "p5_found": f"""with recursive {_ONE}, {_ENT}, nodes as (select 'commit' as k, id, parent from par union all select 'entity', id, parent from epar),
down(k, id, root_id, node_depth) as (select k, id, id, 0 from nodes where parent is null union all select n.k, n.id, d.root_id, d.node_depth + 1 from down d join nodes n on n.k = d.k and n.parent = d.id),
lost as (select n.* from nodes n left join down d on d.k = n.k and d.id = n.id where d.id is null), walk(k, id, cur) as (select k, id, parent from lost union select w.k, w.id, l.parent from walk w join lost l on l.k = w.k and l.id = w.cur)
select k as node_kind, id as node_id, root_id, cast(node_depth as bigint) as node_depth, cast(0 as bigint) as on_cycle from down union all
select l.k, l.id, '', cast(-1 as bigint), cast(exists (select 1 from walk w where w.k = l.k and w.id = l.id and w.cur = l.id) as bigint) from lost l""",
    "p5_paths": f"""with recursive {_ENT}, down(id, root_id, node_depth, full_path) as (select id, id, 0, label from epar where parent is null union all select n.id, d.root_id, d.node_depth + 1, d.full_path || '/' || n.label from down d join epar n on n.parent = d.id)
select id as node_id, root_id, cast(node_depth as bigint) as node_depth, full_path from down""",
    "p5_descendants": f"""with recursive {_ENT}, pairs(a, d, n) as (select parent, id, 1 from epar where parent is not null union all select e.parent, p.d, p.n + 1 from pairs p join epar e on e.id = p.a where e.parent is not null)
select a as ancestor_id, d as descendant_id, cast(n as bigint) as distance from pairs""",
    "p5_commit_descendants": f"""with recursive {_ONE}, h as (select distinct source_id, nullif(regexp_replace(lower(regexp_replace(head, '^\\s+|\\s+$', '', 'g')), '^0+$', ''), '') as ref from project_snapshots),
a as (select distinct min(c.sha) as id from h join one c on c.source_id = h.source_id and left(c.sha, 10) = left(h.ref, 10) and (c.sha = h.ref or (length(h.ref) between 10 and 39 and starts_with(c.sha, h.ref))) group by h.source_id, h.ref),
up(id) as (select id from par where parent is null union all select n.id from up join par n on n.parent = up.id), down(a, d, n) as (select id, id, 0 from a where id in (select id from up) union all select w.a, p.id, w.n + 1 from down w join par p on p.parent = w.d)
select a as ancestor_id, d as descendant_id, cast(n as bigint) as distance from down where n > 0""",
    "p5_subtree_sizes": f"""with recursive {_ONE}, down(id) as (select id from par where parent is null union all select n.id from down d join par n on n.parent = d.id), up(a, d) as (select id, id from down union all select p.parent, u.d from up u join par p on p.id = u.a where p.parent is not null)
select a as node_id, count(*) - 1 as descendants from up group by a""",
}
