"""The operators applied to whole tables, each with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions import scalars as S
from loamgraph.functions.normal import clean_path
from loamgraph.operators import contracts, graph, metrics, retrieval, state
from loamgraph.operators.gitgraph import latest_commits, resolve_refs
from loamgraph.operators.segments import chunked
from loamgraph.sources import parse
from loamgraph.sources.tables import Scratch, table
from loamgraph.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- history of commits and changes


@query("""select p.key as project_key, c.sha, c.author_name, c.authored_at, p.kind from commits c join projects p on c.project_key = p.key
where c.authored_at >= timestamp '2025-03-01' and c.authored_at < timestamp '2025-09-01' and c.author_name is not null""")
def m2_timeline(spark, d):
    c = table(spark, d, "commits").filter((F.col("authored_at") >= "2025-03-01") & (F.col("authored_at") < "2025-09-01") & F.col("author_name").isNotNull())
    p = table(spark, d, "projects").select(F.col("key").alias("project_key"), "kind")
    return c.join(p, "project_key").select("project_key", "sha", "author_name", "authored_at", "kind")


@query("""with m as (select *, row_number() over (partition by sha order by authored_at desc, recorded_at desc, total_insertions) as rn from commits where message like '%audit%')
select project_key, count(distinct sha) as modifications, count(distinct author_name) as authors, cast(sum(total_insertions) as bigint) as insertions, cast(sum(total_deletions) as bigint) as deletions
from m where rn = 1 group by project_key""")
def m1_change_frequency(spark, d):
    c = table(spark, d, "commits").filter(F.col("message").contains("audit") & F.col("sha").isNotNull())
    # the least of a struct is combined before the shuffle; times are turned round to take the latest
    latest = F.min(F.struct((-F.unix_micros(F.col("authored_at").cast("timestamp"))).alias("a"), (-F.unix_micros(F.col("recorded_at").cast("timestamp"))).alias("b"), "total_insertions", "project_key", "author_name", "total_deletions")).alias("m")
    one = c.groupBy("sha").agg(latest).select("sha", "m.*")
    return one.groupBy("project_key").agg(F.countDistinct("sha").alias("modifications"), F.countDistinct("author_name").alias("authors"), F.sum("total_insertions").alias("insertions"), F.sum("total_deletions").alias("deletions"))


@query("""select project_key, sha as first_sha, authored_at as first_at from (select project_key, sha, authored_at, row_number() over (partition by project_key order by authored_at, sha) rn
from commits where lower(message) like '%ledger%') where rn = 1""")
def m2_first_appearance(spark, d):
    c = table(spark, d, "commits").filter(F.lower("message").contains("ledger"))
    m = c.groupBy("project_key").agg(F.min(F.struct("authored_at", "sha")).alias("m"))
    return m.select("project_key", F.col("m.sha").alias("first_sha"), F.col("m.authored_at").alias("first_at"))


@query("""with a as (select source_id, min(authored_at) as at0 from commits where sha in (select min(sha) from commits group by source_id) group by source_id)
select c.source_id, count(distinct c.sha) as later from commits c join a on c.source_id = a.source_id where c.authored_at > a.at0 group by c.source_id""")
def m2_changes_since(spark, d):
    c = table(spark, d, "commits")
    anchor = c.groupBy("source_id").agg(F.min(F.struct("sha", "authored_at")).alias("m")).select("source_id", F.col("m.authored_at").alias("at0"))
    return c.join(anchor, "source_id").filter(F.col("authored_at") > F.col("at0")).groupBy("source_id").agg(F.countDistinct("sha").alias("later"))


@query("""select file_rel_path, change_id, authored_at, row_number() over (partition by file_rel_path order by authored_at desc, change_id) as n from entity_changes where file_rel_path is not null""")
def m2_file_timeline(spark, d):
    c = table(spark, d, "entity_changes").filter("file_rel_path is not null").select("file_rel_path", "change_id", "authored_at", (-F.unix_micros(F.col("authored_at").cast("timestamp"))).alias("back"), F.lit(1).cast("long").alias("n"))
    return chunked(c, "file_rel_path", ["back", "change_id"]).running_sum("n").df.select("file_rel_path", "change_id", "authored_at", F.col("n").cast("int").alias("n"))


@query("""select entity_key, count(*) as changes, max(authored_at) as newest, count(distinct commit_sha) as commits from entity_changes where entity_key is not null group by entity_key""")
def m2_entity_timeline(spark, d):
    return table(spark, d, "entity_changes").filter("entity_key is not null").groupBy("entity_key").agg(F.count("*").alias("changes"), F.max("authored_at").alias("newest"), F.countDistinct("commit_sha").alias("commits"))


@query("""select entity_key, change_id, change_type, authored_at, row_number() over (partition by entity_key order by authored_at, change_id) as n from (select *, row_number() over (partition by change_id order by recorded_at desc) as rn from entity_changes where entity_key is not null and change_id is not null) where rn = 1""")
def m2_entity_history(spark, d):
    """Every change of every entity, numbered in order of time; a repeated change counts once."""
    latest = F.max(F.struct("recorded_at", "entity_key", "change_type", "authored_at")).alias("m")
    one = table(spark, d, "entity_changes").filter("entity_key is not null and change_id is not null").groupBy("change_id").agg(latest).select("change_id", "m.*")
    c = one.select("entity_key", "change_id", "change_type", "authored_at", F.unix_micros(F.col("authored_at").cast("timestamp")).alias("at"), F.lit(1).cast("long").alias("n"))
    return chunked(c, "entity_key", ["at", "change_id"]).running_sum("n").df.select("entity_key", "change_id", "change_type", "authored_at", F.col("n").cast("int").alias("n"))


# -- scalars


@query(r"""select entity_key, regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '/$', '') as clean,
case lower(regexp_extract(regexp_replace(replace(path, '\', '/'), '/$', ''), '\.([^./]+)$', 1)) when 'java' then 'java' when 'ts' then 'typescript' when 'tsx' then 'tsx' when 'js' then 'javascript' when 'jsx' then 'jsx' when 'vue' then 'vue' when 'py' then 'python' when 'json' then 'json' when 'sql' then 'sql' when 'md' then 'markdown' when 'yaml' then 'yaml' when 'yml' then 'yaml' when 'xml' then 'xml' when 'css' then 'css' when 'sh' then 'shell' end as language
from entities where path is not null and entity_type = 'FILE'""")
def m3_path_normalize(spark, d):
    e = table(spark, d, "entities").filter("path is not null and entity_type = 'FILE'")
    return e.select("entity_key", clean_path(F.col("path")).alias("clean"), S.language(clean_path(F.col("path"))).alias("language"))


@query("""select entity_key, split_part(entity_key, ':', 2) as project, split_part(entity_key, ':', 3) as path, split_part(entity_key, ':', 4) as kind, regexp_extract(entity_key, '[^:]*$') as disc,
'repo://' || project_key || '/' || coalesce(path, '') || '#' || name as uri, sha256(name) as name_hash from entities where entity_key like 'SYMBOL:%' and name is not null""")
def m3_symbol_key(spark, d):
    e = table(spark, d, "entities").filter(F.col("entity_key").startswith("SYMBOL:") & F.col("name").isNotNull())
    p = F.split("entity_key", ":")
    return e.select("entity_key", F.get(p, F.lit(1)).alias("project"), F.get(p, F.lit(2)).alias("path"), F.get(p, F.lit(3)).alias("kind"), F.regexp_extract("entity_key", "[^:]*$", 0).alias("disc"), S.uri(F.col("project_key"), F.coalesce("path", F.lit("")), F.col("name")).alias("uri"), F.sha2("name", 256).alias("name_hash"))


@query("""with o as (select distinct 0.5 + l_tax * 5 as confidence from lineitem)
select round(confidence, 6) as raw, round(1 / (1 + exp(-ln(least(greatest(confidence, 1e-6), 1 - 1e-6) / (1 - least(greatest(confidence, 1e-6), 1 - 1e-6))) / 0.55)), 4) as tempered from o""")
def m3_tempered_confidence(spark, d):
    o = table(spark, d, "lineitem").select((0.5 + F.col("l_tax") * 5).alias("confidence")).distinct()
    return o.select(F.round("confidence", 6).alias("raw"), S.tempered(F.col("confidence"), 0.55).alias("tempered"))


@query()
def m3_index_terms(spark, d):
    """Terms of the lexical index of every title and text: CJK pairs and identifier humps."""
    docs = table(spark, d, "documents").select("doc_id", S.index_terms(F.concat_ws(" ", "title", "text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"))


# -- retrieval

_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""with t as (select doc_id, unnest({_TERMS.format('text')}) as term from documents) select term, count(distinct doc_id) as docs, count(*) as occurrences from t group by term""")
def m4_postings_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return retrieval.postings(docs, S.lower_terms(F.col("text"))).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def asked(spark, d):
    """The stated queries: held-out items whose id is divisible by 20."""
    return table(spark, d, "eval_items").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def bm25_results(spark, d, k=10):
    return retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), asked(spark, d), S.lower_terms, Scratch(spark, "bm25"), k)


_BM25 = f"""t as (select doc_id, len({_TERMS.format('text')}) as len, unnest({_TERMS.format('text')}) as term from documents),
s as (select count(*) as docs, avg(len({_TERMS.format('text')})) as avg_len from documents),
q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TERMS.format('text')}) as term from eval_items where item_id % 20 = 0) group by all),
p as (select doc_id, len, term, count(*) as tf from t where term in (select term from q) group by all),
i as (select term, ln(1 + (any_value(s.docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from p, s group by term),
r as (select q.query_id, p.doc_id, sum(q.times * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / s.avg_len))) as raw from p join i using (term) join q using (term), s group by all),
b as (select query_id, doc_id, raw, max(raw) over (partition by query_id) as best, row_number() over (partition by query_id order by round(raw, 6) desc, doc_id) as rank from r)"""


@query(f"with {_BM25} select query_id, doc_id, round(least(greatest(raw / (1.05 * best), 0.1), 1), 6) as score, rank from b where rank <= 10")
def m4_bm25_topk(spark, d):
    return bm25_results(spark, d)


@query("""with q as (select distinct entity_name as query, lower(entity_name) as q from entity_changes where change_id % 20 = 0 and entity_name is not null),
t as (select entity_key, lower(entity_key) as q, 1.0 as score from entities union all select entity_key, lower(name), 0.98 from entities union all select entity_key, lower(canonical_name), 0.95 from entities)
select query, entity_key, cast(max(score) as double) as score from t join q using (q) group by all""")
def m4_entity_exact(spark, d):
    q = table(spark, d, "entity_changes").filter("change_id % 20 = 0 and entity_name is not null").select(F.col("entity_name").alias("query"))
    return retrieval.exact(table(spark, d, "entities"), q)


@query("""with q as (select distinct substr(entity_name, 1, 9) as query, lower(substr(entity_name, 1, 9)) as q from entity_changes where change_id % 20 = 0 and entity_name <> ''),
n as (select distinct entity_key, lower(name) as name from entities where name is not null)
select query, entity_key, round(max(greatest(0.6, 0.9 - 0.02 * (length(name) - length(q)))), 6) as score from n join q on starts_with(name, q) group by all""")
def m4_entity_prefix(spark, d):
    q = table(spark, d, "entity_changes").filter("change_id % 20 = 0 and entity_name <> ''").select(F.substring("entity_name", 1, 9).alias("query"))
    return retrieval.prefixed(table(spark, d, "entities").filter("name is not null"), q)


@query(f"""with t as (select distinct sha as id, unnest({_TERMS.format('message')}) as term from commits where message is not null),
q as (select distinct item_id as query_id, unnest({_TERMS.format('text')}) as term from eval_items where item_id % 20 = 0),
s as (select query_id, id, round(least(0.95, 0.6 + 0.1 * count(distinct term)), 6) as score from t join q using (term) group by all)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10""")
def m4_message_overlap(spark, d):
    c = table(spark, d, "commits").filter("message is not null").groupBy("sha").agg(F.concat_ws(" ", F.collect_set("message")).alias("text")).select(F.col("sha").alias("id"), "text")
    return retrieval.overlap(c, asked(spark, d), S.lower_terms)


def cosine_results(spark, d, k=10):
    v = table(spark, d, "embeddings")
    return retrieval.cosine(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


_COSINE = """c as (select q.vec_id as query_id, v.vec_id, round(least(greatest((list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))) + 1) / 2, 0), 1), 6) as score, q.label as ql, v.label as vl
from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from c where score >= 0.2)"""


@query(f"with {_COSINE} select query_id, vec_id, score, rank from k where rank <= 10")
def m5_cosine_topk(spark, d):
    return cosine_results(spark, d)


@query("""with t as (select distinct sha, unnest(regexp_extract_all(lower(message), '[a-z0-9]+')) as token from commits where message is not null)
select sha, ('0x' || right(md5(token), 2))::int & 127 as bucket, cast(sum(case when ('0x' || substr(md5(token), 30, 1))::int % 2 = 0 then -1 else 1 end) as bigint) as weight from t group by all""")
def m5_hash_embed(spark, d):
    t = table(spark, d, "commits").filter("message is not null").select("sha", F.explode(S.lower_terms(F.col("message"))).alias("token")).distinct()
    bucket, sign = S.hash_bucket(F.col("token"))
    return t.select("sha", bucket.alias("bucket"), sign.alias("s")).groupBy("sha", "bucket").agg(F.sum("s").alias("weight"))


@query(f"""select doc_id, case when regexp_matches(lower(title), '{S.HISTORY}') or regexp_matches(lower(title), '\\bauthor\\b') then 'HISTORY_QUERY' when regexp_matches(lower(title), '{S.IMPACT}') then 'IMPACT_QUERY'
when regexp_matches(lower(title), '{S.RELATION}') and regexp_matches(lower(title), '{S.RELATION_STRONG}') then 'RELATION_QUERY'
when regexp_matches(lower(title), '{S.LOOKUP}') or (not regexp_matches(trim(title), '\\s') and trim(title) <> '' and (regexp_matches(trim(title), '^[A-Z][a-zA-Z0-9]+$') or contains(title, '.'))) then 'ENTITY_LOOKUP'
when regexp_matches(lower(title), '{S.BUSINESS}') then 'BUSINESS_QUERY' when regexp_matches(lower(title), '{S.CODE}') then 'CODE_LOOKUP' when regexp_matches(lower(title), '{S.SEMANTIC}') then 'SEMANTIC_QUERY' else 'UNKNOWN' end as intent
from documents where title is not null""")
def m6_route_intent(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", S.intent(F.col("title")).alias("intent"))


_TITLES = f"""t2 as (select distinct doc_id as id, unnest({_TERMS.format('title')}) as term from documents where title is not null),
q2 as (select distinct item_id as query_id, unnest({_TERMS.format('text')}) as term from eval_items where item_id % 20 = 0),
s2 as (select query_id, id, round(least(0.95, 0.6 + 0.1 * count(distinct term)), 6) as score from t2 join q2 using (term) group by all),
o2 as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s2)"""


@query(f"""with {_BM25}, {_TITLES}, c as (select query_id, doc_id as id, round(least(greatest(raw / (1.05 * best), 0.1), 1), 6) as score, rank, 0.6 as weight from b where rank <= 20
union all select query_id, id, score, rank, 0.4 from o2 where rank <= 20), f as (select query_id, id, sum(weight / (60 + rank)) as rrf, sum(weight * score) as w from c group by all)
select query_id, id, round(0.5 * rrf / max(rrf) over (partition by query_id) + 0.5 * least(1, w), 4) as fused from f""")
def m6_hybrid(spark, d):
    """Flagship: text and title channels of the stated queries, fused by reciprocal rank and score."""
    titles = table(spark, d, "documents").filter("title is not null").select(F.col("doc_id").alias("id"), F.col("title").alias("text"))
    text = bm25_results(spark, d, 20).select("query_id", F.lit("KEYWORD").alias("channel"), F.col("doc_id").alias("id"), "score", "rank")
    title = retrieval.overlap(titles, asked(spark, d), S.lower_terms, 20).select("query_id", F.lit("ENTITY").alias("channel"), "id", "score", "rank")
    weights = asked(spark, d).select("query_id", F.explode(F.create_map(F.lit("KEYWORD"), F.lit(0.6), F.lit("ENTITY"), F.lit(0.4))).alias("channel", "weight"))
    return retrieval.fuse(text.unionByName(title), weights)


# -- graph


def relations(spark, d):
    """(src, predicate, dst) of the trade tables as a knowledge graph."""
    t = lambda n: table(spark, d, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    row = lambda df, a, p, b: df.select(a.alias("src"), F.lit(p).alias("predicate"), b.alias("dst"))
    out = row(t("nation"), key("NATION", "n_nationkey"), "IN", key("REGION", "n_regionkey"))
    for df, a, p, b in ((t("customer"), key("CUSTOMER", "c_custkey"), "LIVES", key("NATION", "c_nationkey")), (t("supplier"), key("SUPPLIER", "s_suppkey"), "SITS", key("NATION", "s_nationkey")), (t("orders"), key("ORDER", "o_orderkey"), "PLACED", key("CUSTOMER", "o_custkey")), (t("lineitem").select("l_partkey", "l_suppkey").distinct(), key("PART", "l_partkey"), "SUPPLIED", key("SUPPLIER", "l_suppkey"))):
        out = out.unionByName(row(df, a, p, b))
    return out


_EDGES = """e as (select 'NATION:' || n_nationkey as src, 'IN' as predicate, 'REGION:' || n_regionkey as dst from nation union all select 'CUSTOMER:' || c_custkey, 'LIVES', 'NATION:' || c_nationkey from customer
union all select 'SUPPLIER:' || s_suppkey, 'SITS', 'NATION:' || s_nationkey from supplier union all select 'ORDER:' || o_orderkey, 'PLACED', 'CUSTOMER:' || o_custkey from orders
union all select distinct 'PART:' || l_partkey, 'SUPPLIED', 'SUPPLIER:' || l_suppkey from lineitem)"""


def _bfs_sql(walk: str, seed: str, depth: int) -> str:
    return f"""with recursive {_EDGES}, w as ({walk}), r(id, hop) as (select '{seed}', 0 union select w.b, r.hop + 1 from r join w on w.a = r.id where r.hop < {depth}),
m as (select id, min(hop) as hop from r group by id), s as (select distinct w.b as id, w.predicate from m join w on w.a = m.id where m.hop < {depth})
select m.id, m.hop, array_to_string(list_sort(list(s.predicate)), ',') as evidence from m join s on s.id = m.id where m.hop > 0 group by all"""


_DOWN, _UP = "select dst as a, src as b, predicate from e", "select src as a, dst as b, predicate from e"


def _bfs(spark, d, seed, direction, depth):
    seeds = spark.createDataFrame([(seed,)], "id string")
    return graph.impact(relations(spark, d), seeds, Scratch(spark, "impact"), direction, depth)


@query(_bfs_sql(_DOWN, "REGION:1", 3))
def m7_bfs_down(spark, d):
    return _bfs(spark, d, "REGION:1", "down", 3)


@query(_bfs_sql(_UP, "ORDER:1", 3))
def m7_bfs_up(spark, d):
    return _bfs(spark, d, "ORDER:1", "up", 3)


@query(_bfs_sql(f"{_DOWN} union all {_UP}", "SUPPLIER:1", 2))
def m7_bfs_both(spark, d):
    return _bfs(spark, d, "SUPPLIER:1", "both", 2)


@query(f"with {_EDGES} select id, predicate, cast(sum(o) as bigint) as out_edges, cast(sum(i) as bigint) as in_edges from (select src as id, predicate, 1 as o, 0 as i from e union all select dst, predicate, 0, 1 from e) group by all")
def m7_neighbours(spark, d):
    return graph.neighbours(relations(spark, d))


@query(f"""with {_EDGES}, s as (select 'SUPPLIER:' || s_suppkey as id from supplier where s_suppkey % 20 = 0) select id, 'OUT' as side, predicate, dst as other from e join s on src = id union all select id, 'IN', predicate, src from e join s on dst = id""")
def m7_neighbour_rows(spark, d):
    """The edges around the stated nodes, a row each."""
    asked = table(spark, d, "supplier").filter("s_suppkey % 20 = 0").select(F.concat(F.lit("SUPPLIER:"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.around(relations(spark, d), asked)


@query(f"with {_EDGES} select src, predicate, dst from e where regexp_matches(src, '^(NATION|SUPPLIER|REGION)') and regexp_matches(dst, '^(NATION|SUPPLIER|REGION)')")
def m7_overview(spark, d):
    e = relations(spark, d)
    ids = e.select("src").union(e.select("dst")).toDF("id").filter(F.col("id").rlike("^(NATION|SUPPLIER|REGION)")).distinct()
    return graph.induced(e, ids).select("src", "predicate", "dst")


@query("""select layer, count(*) as entities from (select entity_key, unnest(list_filter([case when regexp_matches(lower(path || ' ' || name), 'view|page|layout') then 'page' end, case when regexp_matches(lower(path || ' ' || name), 'component|panel|modal|drawer|table|button') then 'component' end,
case when regexp_matches(lower(path || ' ' || name), 'api|controller|endpoint|client|request') then 'api' end, case when regexp_matches(lower(path || ' ' || name), 'service|manager|handler|helper|util') then 'service' end,
case when regexp_matches(lower(path || ' ' || name), 'rule|validator|policy|business') then 'rule' end], lambda x: x is not null)) as layer from entities where path is not null and name is not null) group by layer""")
def m7_layers(spark, d):
    e = table(spark, d, "entities").filter("path is not null and name is not null")
    return e.select(F.explode(S.layers(F.concat_ws(" ", "path", "name"))).alias("layer")).groupBy("layer").agg(F.count("*").alias("entities"))


# -- contracts


@query("""select l_partkey || ':' || l_suppkey as relation_key, array_to_string(list_transform(list_sort(list(distinct {'line': l_orderkey, 'column': l_linenumber})), lambda x: x.line || ':' || x.column), ',') as sites, count(*) as rows,
max(cast(1 - l_discount as decimal(6,5))) as confidence, min(case when l_returnflag = 'R' then 'R' || l_suppkey end) as object_key, max(case when l_returnflag = 'R' then 1 else 0 end) = 1 as resolved from lineitem group by l_partkey, l_suppkey""")
def m8_occurrence_merge(spark, d):
    c = table(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("relation_key"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("column"), (1 - F.col("l_discount")).cast("decimal(6,5)").alias("confidence"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("R"), F.col("l_suppkey").cast("string"))).alias("object_key"))
    return contracts.merged(c)


@query("""with i as (select distinct l_partkey, l_suppkey from lineitem), n as (select l_partkey, count(*) as n from i group by 1)
select p_partkey as call_key, l_suppkey as impl_key, cast(case when n = 1 then 0.9 else round(1.0::double / n, 5) end as decimal(6,5)) as confidence from part join i on l_partkey = p_partkey join n using (l_partkey)""")
def m8_dispatch_conf(spark, d):
    calls = table(spark, d, "part").select(F.col("p_partkey").alias("call_key"), F.col("p_partkey").alias("interface"))
    impl = table(spark, d, "lineitem").select(F.col("l_partkey").alias("interface"), F.col("l_suppkey").alias("impl_key")).distinct()
    return contracts.dispatched(calls, impl)


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '/$', '')"


@query(f"""with r as (select distinct {_CLEAN} as raw, project_key as own from entities where path is not null and entity_type = 'FILE'),
p as (select distinct regexp_replace({_CLEAN}, '^[^/]*/', '') as package, project_key from entities where path is not null and entity_type = 'DIRECTORY'),
x as (select distinct regexp_replace(raw, '^[^/]*/', '') as raw, own from r), y as (select distinct raw, own, array_to_string(string_split(raw, '/')[1:i], '/') as package from (select raw, own, unnest(range(1, len(string_split(raw, '/')) + 1)) as i from x))
select y.raw, y.own, y.package, min(p.project_key) as project_key from y join p on p.package = y.package and p.project_key <> y.own group by all""")
def m8_prefix_join(spark, d):
    e = table(spark, d, "entities").filter("path is not null").withColumn("p", F.regexp_replace(clean_path(F.col("path")), "^[^/]*/", ""))
    raw = e.filter("entity_type = 'FILE'").select(F.col("p").alias("raw"), "project_key").distinct()
    packages = e.filter("entity_type = 'DIRECTORY'").select(F.col("p").alias("package"), "project_key").distinct()
    return contracts.by_prefix(raw, packages)


# each literal call, and what is added to its route: a name, a template's placeholder or another literal
_CALLS = r"""select file_id, upper(regexp_extract(m, '(?i)\.(get|post|put|delete|patch)', 1)) as method, regexp_replace(regexp_replace(regexp_replace(case when starts_with(p, '/') then p else '/' || p end, '\$\{[^}]+\}', '{id}', 'g'), '/+', '/', 'g'), '/+$', '') as path
from (select file_id, m, regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(m, '\(\s*(.*)$', 1)), '[`''"]\s*\+\s*[\w$.]+\s*\+\s*[`''"]', '{id}', 'g'), '[`''"]\s*\+\s*[\w$.]+\s*$', '{id}'), '[`''"]', '', 'g') as p
from (select file_id, unnest(regexp_extract_all(content, '(?i)\b(?:axios|apiClient|http|request|client)\.(?:get|post|put|delete|patch)\s*\(\s*[`''"][^`''"]+[`''"](?:\s*\+\s*(?:[\w$.]+|[`''"][^`''"]*[`''"]))*')) as m from source_files))
union all select file_id, upper(coalesce(nullif(regexp_extract(m, 'method\s*:\s*[''"]([A-Za-z]+)', 1), ''), 'GET')), regexp_replace(regexp_replace(regexp_replace(case when starts_with(p, '/') then p else '/' || p end, '\$\{[^}]+\}', '{id}', 'g'), '/+', '/', 'g'), '/+$', '')
from (select file_id, m, regexp_extract(m, 'url\s*:\s*[`''"]([^`''"]+)', 1) as p from (select file_id, unnest(regexp_extract_all(content, '\{\s*url\s*:\s*[`''"][^`''"]+[`''"](?:\s*,\s*method\s*:\s*[''"][A-Za-z]+[''"])?')) as m from source_files))"""


@query(_CALLS)
def m8_client_calls(spark, d):
    """Calls of an HTTP client by pattern; a route's parameters, in templates or added by +, are {id}."""
    return parse.client_calls(table(spark, d, "source_files"))


@query(r"""select file_id, case when regexp_extract(m, '@(Get|Post|Put|Delete|Request)', 1) = 'Request' then 'GET' else upper(regexp_extract(m, '@(Get|Post|Put|Delete|Request)', 1)) end as method, regexp_replace(regexp_replace('/' || trim(regexp_extract(m, '"([^"]*)"', 1)), '/+', '/', 'g'), '/+$', '') as path
from (select file_id, unnest(regexp_extract_all(content, '@(?:Get|Post|Put|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?"[^"]*"')) as m from source_files)""")
def m8_served_routes(spark, d):
    return parse.served_routes(table(spark, d, "source_files"))


def _contract_sides(spark, d):
    """Call sites and endpoints, a row a file, with the representative each stands under.

    Calls of one method and path are one; endpoints also need the same loss (mock, legacy or none) by their file's path.
    """
    files = table(spark, d, "source_files")
    calls = parse.client_calls(files).select("file_id", "method", "path", F.concat_ws(" ", "method", "path").alias("call_id")).distinct()
    low = F.lower(F.col("file_path"))
    loss = F.when(low.contains("mock"), "mock").when(low.rlike("legacy|deprecated"), "legacy").otherwise("")
    served = parse.served_routes(files).join(files.groupBy("file_id").agg(F.max("file_path").alias("file_path")), "file_id")
    served = served.select("file_id", "method", "path", F.coalesce(loss, F.lit("")).alias("file_path")).distinct()
    return calls, served.withColumn("end_id", F.concat_ws(" ", "method", "path", F.when(F.col("file_path") != "", F.col("file_path"))))


@query()
def m8_ranked_contracts(spark, d):
    """Calls against routes, by representatives; m8_contract_members has their files.

    Paths that are equal only without a plural s are HEURISTIC, .7 at most.
    ``ends`` files serve the route; they take the ranks from ``rank`` on, and
    two of them at the top make a call ambiguous.
    """
    calls, served = _contract_sides(spark, d)
    calls = calls.select("call_id", "method", "path").distinct()
    ends = served.groupBy("end_id", "method", "path", "file_path").agg(F.countDistinct("file_id").alias("ends"))
    singular = lambda df: df.withColumn("path", F.regexp_replace("path", r"s(/|$)", "$1"))
    exact = contracts.graded(calls, ends)
    alike = contracts.graded(singular(calls), singular(ends)).join(exact, ["call_id", "end_id"], "left_anti").select("call_id", "end_id", F.lit("HEURISTIC").alias("grade"), F.least("confidence", F.lit(0.7)).alias("confidence"))
    out = contracts.ranked(exact.unionByName(alike), ends).join(ends.select("end_id", "ends"), "end_id")
    w = Window.partitionBy("call_id")
    several = F.max(F.when(F.col("rank") == 1, F.col("ends"))).over(w) > 1
    rank = F.coalesce(F.sum("ends").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return out.select("call_id", "end_id", "grade", "confidence", rank.alias("rank"), (F.col("ambiguous") | several).alias("ambiguous"), "ends")


@query()
def m8_contract_members(spark, d):
    """(side, id, file_id): the files that each call_id and end_id of m8_ranked_contracts stands for."""
    calls, served = _contract_sides(spark, d)
    return calls.select(F.lit("call").alias("side"), F.col("call_id").alias("id"), "file_id").unionByName(served.select(F.lit("end").alias("side"), F.col("end_id").alias("id"), "file_id"))


# -- quality

_P = "p as (select l_linestatus as task, l_returnflag as expected, case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end as predicted, 0.5 + l_tax * 5 as confidence from lineitem)"
_O = "o as (select confidence, case when expected = predicted then 1 else 0 end as correct, count(*) as n from p group by all)"


def predictions(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("task"), F.col("l_returnflag").alias("expected"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("predicted"), (0.5 + F.col("l_tax") * 5).alias("confidence"))


@query(f"with {_P} select expected, predicted, count(*) as n from p group by all")
def m9_confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query(f"""with {_P}, l as (select expected as label from p union select predicted from p), t as (select label, (select count(*) from p where expected = label) as support, (select count(*) from p where predicted = label) as given, (select count(*) from p where expected = label and predicted = label) as tp from l)
select label, support, round(coalesce(tp / nullif(given, 0), 0), 4) as precision, round(coalesce(tp / nullif(support, 0), 0), 4) as recall, round(coalesce(2 * tp / nullif(support + given, 0), 0), 4) as f1 from t""")
def m9_prf(spark, d):
    return metrics.per_class(predictions(spark, d))


@query(f"with {_P}, {_O}, c as (select *, least(greatest(confidence, 1e-7), 1 - 1e-7) as q from o) select round(sum(n * (q - correct) ** 2) / sum(n), 6) as brier, round(sum(-n * ln(case when correct = 1 then q else 1 - q end)) / sum(n), 6) as nll from c")
def m9_brier_nll(spark, d):
    return metrics.losses(predictions(spark, d))


_BIN = "case when {q} < b0 * 0.1::double then b0 - 1 when {q} >= (b0 + 1) * 0.1::double and b0 < 9 then b0 + 1 else b0 end"


@query(f"""with {_P}, {_O}, c as (select *, least(floor(confidence * 10), 9)::int as b0 from o), g as (select *, {_BIN.format(q='confidence')} as bin from c)
select bin, cast(sum(n) as bigint) as n, round(sum(n * correct) / sum(n), 6) as accuracy, round(sum(n * confidence) / sum(n), 6) as confidence, round(abs(sum(n * correct) / sum(n) - sum(n * g.confidence) / sum(n)), 6) as gap from g group by bin""")
def m9_ece_bins(spark, d):
    return metrics.calibration_bins(predictions(spark, d))


@query(f"""with {_P}, {_O}, t as (select i::int as step, 0.20::double + 0.05::double * i as t from range(67) r(i)),
c as (select step, n, correct, round(1 / (1 + exp(-(ln(least(greatest(confidence, 1e-6), 1 - 1e-6) / (1 - least(greatest(confidence, 1e-6), 1 - 1e-6))) / t))), 4) as q from o, t), b as (select *, least(floor(q * 10), 9)::int as b0 from c), g as (select *, {_BIN.format(q='q')} as bin from b),
s as (select step, bin, abs(sum(n * (correct - q))) as gap, sum(n) as n from g group by all) select step, round(sum(gap) / sum(n), 6) as ece from s group by step""")
def m9_temp_fit(spark, d):
    return metrics.temperatures(predictions(spark, d))


@query(f"""with {_P}, t as (select task, count(*)::double as n, sum(case when expected = predicted then 1 else 0 end)::double as k from p group by task), z as (select *, 1.959963984540054::double as z, k / n as ph from t)
select task, round(100 * greatest(0, (ph + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(ph*(1-ph)/n + z*z/(4*n*n)) / (1 + z*z/n)), 2) as low, round(100 * least(1, (ph + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(ph*(1-ph)/n + z*z/(4*n*n)) / (1 + z*z/n)), 2) as high from z""")
def m9_wilson(spark, d):
    t = predictions(spark, d).groupBy("task").agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("expected") == F.col("predicted"), 1)).cast("double").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return t.select("task", low.alias("low"), high.alias("high"))


@query("""with s as (select event_type, list(value order by value) as v from events where value is not null group by event_type)
select event_type, share, v[least(floor(share * len(v))::int, len(v) - 1) + 1] as value from s, (values (0.5::double), (0.95::double), (0.99::double)) t(share)""")
def m9_percentiles(spark, d):
    return metrics.ordinals(table(spark, d, "events"), "event_type", "value", [0.5, 0.95, 0.99])


@query(f"with {_P} select coalesce(task, 'ALL') as task, count(*) as n, round(avg(case when expected = predicted then 1.0::double else 0.0::double end), 6) as accuracy from p group by grouping sets ((), (task))")
def m9_grouping_sets(spark, d):
    p = predictions(spark, d).withColumn("hit", (F.col("expected") == F.col("predicted")).cast("double"))
    return p.rollup("task").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy")).select(F.coalesce("task", F.lit("ALL")).alias("task"), "n", "accuracy")


@query(f"""with {_COSINE}, r as (select query_id, rank, case when ql = vl then 1 else 0 end as relevant from k where rank <= 10), n as (select q.vec_id as query_id, count(*) as total from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 20 = 0 group by all),
x as (select r.query_id, sum(relevant) / any_value(greatest(least(coalesce(total, 0), 10), 1)) as recall, coalesce(max(relevant / rank), 0) as rr, sum(relevant / log2(rank + 1)) as dcg, any_value(greatest(least(coalesce(total, 0), 10), 1)) as ideal from r left join n using (query_id) group by r.query_id)
select count(*) as queries, round(avg(recall), 6) as recall, round(avg(rr), 6) as mrr, round(avg(dcg / list_sum(list_transform(range(1, ideal + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg from x""")
def m9_rank_metrics(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    r = cosine_results(spark, d).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(v, "vec_id")
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("total_relevant")).withColumnRenamed("label", "ql")
    return metrics.ranking(r.join(sizes, "ql").select("query_id", "rank", (F.col("ql") == F.col("label")).cast("int").alias("relevant"), "total_relevant"))


# -- state


def _ends(spark, d):
    s = table(spark, d, "project_snapshots").groupBy("source_id").agg(F.min(F.struct("created_at", "snapshot_id")).alias("a"), F.max(F.struct("created_at", "snapshot_id")).alias("z"))
    e = table(spark, d, "snapshot_entities").filter("entity_type = 'FILE'").select("snapshot_id", F.regexp_replace("entity_key", r"\\", "/").alias("path"), F.get_json_object("metadata", "$.size_bytes").alias("digest"))
    side = lambda end: e.join(s.select(F.col(f"{end}.snapshot_id").alias("snapshot_id")), "snapshot_id", "left_semi").groupBy("path").agg(F.max("digest").alias("digest")).withColumn("bare_digest", F.col("digest"))
    return side("a"), side("z")


_ENDS = r"""s as (select source_id, min_by(snapshot_id, (created_at, snapshot_id)) as a, max_by(snapshot_id, (created_at, snapshot_id)) as z from project_snapshots group by source_id),
e as (select snapshot_id, replace(entity_key, '\', '/') as path, metadata ->> '$.size_bytes' as digest from snapshot_entities where entity_type = 'FILE'),
o as (select path, max(digest) as d from e where snapshot_id in (select a from s) group by path), n as (select path, max(digest) as d from e where snapshot_id in (select z from s) group by path)"""


@query(f"""with {_ENDS} select coalesce(o.path, n.path) as path, case when o.path is null then 'ADDED' when n.path is null then 'DELETED' else 'MODIFIED' end as change, case when o.path is null or n.path is null then false else o.d is not distinct from n.d end as format_only
from o full join n on o.path = n.path where o.path is null or n.path is null or o.d is distinct from n.d""")
def m11_file_diff(spark, d):
    old, new = _ends(spark, d)
    return state.file_diff(old, new)


@query(f"""with {_ENDS} select count(o.path) filter (where n.path is not null) as shared, count(*) filter (where n.path is null) as only_left, count(*) filter (where o.path is null) as only_right,
count(*) filter (where o.path is not null and n.path is not null and o.d is distinct from n.d) as differing, round((count(*) filter (where o.path is not null and n.path is not null and o.d is not distinct from n.d)) / greatest(count(*), 1), 4) as match_rate from o full join n on o.path = n.path""")
def m11_equivalence(spark, d):
    old, new = _ends(spark, d)
    return state.equivalence(old.select(F.col("path").alias("key"), F.col("digest").alias("value")), new.select(F.col("path").alias("key"), F.col("digest").alias("value")))


def _content_ends(spark, d):
    """(path, digest) of the files of all first and of all last snapshots: sha256, or the size where an end of the path lacks it."""
    s = table(spark, d, "project_snapshots").groupBy("source_id").agg(F.min(F.struct("created_at", "snapshot_id")).alias("a"), F.max(F.struct("created_at", "snapshot_id")).alias("z"))
    e = table(spark, d, "snapshot_entities").filter("entity_type = 'FILE'").select("snapshot_id", F.regexp_replace("entity_key", r"\\", "/").alias("path"), F.get_json_object("metadata", "$.sha256").alias("sha"), F.get_json_object("metadata", "$.size_bytes").alias("size"))
    side = lambda end: e.join(s.select(F.col(f"{end}.snapshot_id").alias("snapshot_id")), "snapshot_id", "left_semi").groupBy("path").agg(F.max("sha").alias("sha"), F.max("size").alias("size")).withColumn("end", F.lit(end))
    both = side("a").unionByName(side("z")).withColumn("lacks", F.max(F.col("sha").isNull()).over(Window.partitionBy("path")))
    both = both.select("end", "path", F.when(F.col("lacks"), F.col("size")).otherwise(F.col("sha")).alias("digest"))
    return both.filter("end = 'a'").drop("end"), both.filter("end = 'z'").drop("end")


_CONTENT_ENDS = r"""s as (select source_id, min_by(snapshot_id, (created_at, snapshot_id)) as a, max_by(snapshot_id, (created_at, snapshot_id)) as z from project_snapshots group by source_id),
e as (select snapshot_id, replace(entity_key, '\', '/') as path, metadata ->> '$.sha256' as sha, metadata ->> '$.size_bytes' as size from snapshot_entities where entity_type = 'FILE'),
o as (select path, max(sha) as sha, max(size) as size from e where snapshot_id in (select a from s) group by path), n as (select path, max(sha) as sha, max(size) as size from e where snapshot_id in (select z from s) group by path),
j as (select o.path as p0, n.path as p1, case when o.sha is null or n.sha is null then o.size is distinct from n.size else o.sha <> n.sha end as differs from o full join n on o.path = n.path)"""


@query(f"with {_CONTENT_ENDS} select coalesce(p0, p1) as path, case when p0 is null then 'ADDED' when p1 is null then 'DELETED' else 'MODIFIED' end as change from j where p0 is null or p1 is null or differs")
def m11_content_diff(spark, d):
    """As m11_file_diff, by content; the data have no text of both ends, so what is format only is not known."""
    old, new = (x.withColumn("bare_digest", F.col("digest")) for x in _content_ends(spark, d))
    return state.file_diff(old, new).drop("format_only")


@query(f"""with {_CONTENT_ENDS} select count(*) filter (where p0 is not null and p1 is not null) as shared, count(*) filter (where p1 is null) as only_left, count(*) filter (where p0 is null) as only_right, count(*) filter (where p0 is not null and p1 is not null and differs) as differing, round((count(*) filter (where p0 is not null and p1 is not null and not differs)) / greatest(count(*), 1), 4) as match_rate from j""")
def m11_content_equivalence(spark, d):
    old, new = _content_ends(spark, d)
    return state.equivalence(old.withColumnsRenamed({"path": "key", "digest": "value"}), new.withColumnsRenamed({"path": "key", "digest": "value"}))


@query("""with s as (select entity_key as key, name as value, upper(status) as st from (select *, row_number() over (partition by entity_key order by updated_at desc, name) rn from entities) where rn = 1),
a as (select entity_key as key, max_by(entity_name, (authored_at, change_id)) as value from entity_changes where entity_key is not null and entity_name is not null and upper(change_type) <> 'DELETED' group by 1)
select coalesce(s.key, a.key) as key, case when s.key is null then 'CREATED' when a.key is null then 'DELETED' when st = 'DELETED' then 'REACTIVATED' when s.value is not distinct from a.value then 'UNCHANGED' else 'UPDATED' end as outcome, case when a.key is not null then a.value else s.value end as value
from s full join a on s.key = a.key where not (a.key is null and coalesce(st, '') = 'DELETED')""")
def m11_upsert_status(spark, d):
    latest = F.min(F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("t"), "name", "status")).alias("m")
    stored = table(spark, d, "entities").groupBy(F.col("entity_key").alias("key")).agg(latest).select("key", F.col("m.name").alias("value"), "m.status")
    arrived = table(spark, d, "entity_changes").filter("entity_key is not null and entity_name is not null and upper(change_type) <> 'DELETED'").groupBy(F.col("entity_key").alias("key")).agg(F.max_by("entity_name", F.struct("authored_at", "change_id")).alias("value"))
    return state.upsert(stored, arrived)


@query(r"""with one as (select sha, source_id, nullif(regexp_replace(lower(regexp_replace(parent_sha, '^\s+|\s+$', '', 'g')), '^0+$', ''), '') as ref from (select *, row_number() over (partition by sha order by recorded_at desc nulls last, nullif(regexp_replace(lower(regexp_replace(parent_sha, '^\s+|\s+$', '', 'g')), '^0+$', ''), '') desc nulls last, source_id desc) as rn from commits where sha is not null) where rn = 1)
select c.sha as src, 'PARENT' as predicate, c.ref as dst from one c where ref is not null and not exists (select 1 from one p where p.source_id is not distinct from c.source_id and (p.sha = c.ref or (length(c.ref) between 10 and 39 and starts_with(p.sha, c.ref))))""")
def m11_stale_edges(spark, d):
    """Parent references, as last delivered, that mean no commit of their source; no-parent marks are no reference."""
    one = latest_commits(table(spark, d, "commits"))
    refs = one.filter("parent_ref is not null").select(F.col("sha").alias("src"), "source_id", F.col("parent_ref").alias("ref"))
    found = resolve_refs(refs, one.select("sha", "source_id")).select("src")
    return refs.join(found, "src", "left_anti").select("src", F.lit("PARENT").alias("predicate"), F.col("ref").alias("dst"))


@query("""with u as (select distinct source_id as stream, snapshot_id, created_at from project_snapshots), r as (select *, row_number() over (partition by stream order by created_at desc, snapshot_id desc) as n, row_number() over (partition by stream order by created_at, snapshot_id) as o from u)
select stream, snapshot_id, created_at from r where n <= 3 or o = 1""")
def m11_retention(spark, d):
    s = table(spark, d, "project_snapshots").select(F.col("source_id").alias("stream"), "snapshot_id", "created_at").distinct()
    return state.retained(s, 3)


# -- events


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def m12_tumbling(spark, d):
    return ingest.tumbling(table(spark, d, "events"))


@query("""select w as window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select *, unnest([date_trunc('day', ts) + (case when hour(ts) >= 12 then interval 12 hour else interval 0 hour end), date_trunc('day', ts) + (case when hour(ts) >= 12 then interval 12 hour else interval 0 hour end) - interval 12 hour]) as w from events) group by all""")
def m12_sliding(spark, d):
    return ingest.tumbling(table(spark, d, "events"), "24 hours", "12 hours")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, sid""")
def m12_sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"))


@query("select event_id, ts, user_id, event_type, value from events qualify row_number() over (partition by event_id order by ts) = 1")
def m12_dedupe(spark, d):
    return ingest.deduplicated(table(spark, d, "events")).select("event_id", "ts", "user_id", "event_type", "value")


# -- parsing


@query(r"""select file_id, kind, name from (select file_id, 'CLASS' as kind, unnest(regexp_extract_all(content, '(?:public\s+|export\s+)?(?:class|interface)\s+([A-Za-z0-9_]+)', 1)) as name from source_files
union all select file_id, 'METHOD', unnest(regexp_extract_all(content, '(?:public|private|protected|async|function)\s+(?:[A-Za-z0-9_<>\[\], ]+\s+)?([A-Za-z0-9_]+)\s*\(([^)]*)\)', 1)) from source_files) where kind = 'CLASS' or name not in ('if','for','while','switch','catch','class','interface')""")
def m13_symbols(spark, d):
    return parse.symbols(table(spark, d, "source_files"))


@query(r"""select file_id, target, count(*) as occurrences from (select file_id, unnest(list_concat(regexp_extract_all(content, '(?m)^\s*import\s+(?:[^''";]*?from\s+)?[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, '(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;', 1))) as target from source_files) group by all""")
def m13_imports(spark, d):
    return parse.imports(table(spark, d, "source_files"))


@query("""with v as (select file_id, content from source_files where lower(file_path) like '%.json' and content is not null and json_valid(content) and json_type(content) = 'OBJECT' and (content ->> '$.name') is not null),
s as (select file_id, content, section from v, (values ('scripts'), ('dependencies'), ('devDependencies'), ('peerDependencies'), ('optionalDependencies')) t(section) where json_type(content, '$.' || section) = 'OBJECT')
select file_id, content ->> '$.name' as package, content ->> '$.version' as version, section, name, json_extract_string(content, '$.' || section || '."' || name || '"') as spec from (select *, unnest(json_keys(content, '$.' || section)) as name from s)""")
def m13_manifest_entries(spark, d):
    """Scripts and dependencies of the package manifests among the JSON files."""
    return parse.manifest_entries(table(spark, d, "source_files").filter(F.lower("file_path").endswith(".json")))


@query(r"""select file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '<([A-Z][\w]*|[a-z]+(?:-[a-z0-9]+)+)[\s/>]', 1))), ',') as tags, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?:@|v-on:)([a-z][\w-]*)', 1))), ',') as events,
length(regexp_extract(content, '(?s)<script[^>]*>(.*?)</script>', 1)) as script_chars from source_files where lower(file_path) like '%.vue'""")
def m13_template_tags(spark, d):
    """Component tags and event bindings of single-file components."""
    v = table(spark, d, "source_files").filter(F.lower("file_path").endswith(".vue"))
    return v.select("file_id", F.array_join(parse.component_tags(F.col("content")), ",").alias("tags"), F.array_join(parse.event_bindings(F.col("content")), ",").alias("events"), F.length(parse.script_block(F.col("content"))).alias("script_chars"))


@query(r"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), i as (select doc_id, unnest(range(1, len(ls) + 1)) as n, unnest(ls) as line from l),
g as (select doc_id, n, line, sum(case when n = 1 or regexp_matches(line, '^#{1,3} ') then 1 else 0 end) over (partition by doc_id order by n) as part from i),
c as (select doc_id, part, min(n) as start_line, max(n) as end_line, string_agg(line, chr(10) order by n) as t from g group by doc_id, part)
select doc_id, row_number() over (partition by doc_id order by part) - 1 as chunk, start_line, end_line, length(t) as chars from c where trim(regexp_replace(t, '\s+', ' ', 'g')) <> ''""")
def m13_chunks(spark, d):
    """Markdown sections of every document."""
    return parse.chunks(table(spark, d, "documents").filter("text is not null")).select("doc_id", "chunk", "start_line", "end_line", F.length("text").alias("chars"))


@query(r"""with p as (select distinct project_key, regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '/$', '') as p from entities where path is not null and entity_type = 'FILE'),
x as (select project_key, string_split(p, '/') as s from p) select distinct project_key, array_to_string(s[1:i], '/') as directory from (select project_key, s, unnest(range(1, len(s))) as i from x)""")
def m13_directories(spark, d):
    e = table(spark, d, "entities").filter("path is not null and entity_type = 'FILE'").select("project_key", F.split(clean_path(F.col("path")), "/").alias("s")).filter(F.size("s") > 1)
    return e.select("project_key", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.array_join(F.slice("s", F.lit(1), i), "/"))).alias("directory")).distinct()


@query("""select l as language, count(*) as files, round(count(*) / sum(count(*)) over (), 4) as share from (select case when language is null or trim(language) = '' then lower(regexp_extract(file_path, '[^.]*$')) else lower(trim(language)) end as l from source_files) group by l""")
def m13_languages(spark, d):
    lang = F.when(F.trim(F.coalesce("language", F.lit(""))) == "", F.lower(F.regexp_extract("file_path", "[^.]*$", 0))).otherwise(F.lower(F.trim("language")))
    c = table(spark, d, "source_files").groupBy(lang.alias("language")).agg(F.count("*").alias("files"))
    return c.crossJoin(c.agg(F.sum("files").alias("all"))).select("language", "files", F.round(F.col("files") / F.col("all"), 4).alias("share"))


@query("""select entity_type, upper(status) as status, count(*) as n, count(distinct entity_key) as keys from entities group by all""")
def m14_overview_counts(spark, d):
    return table(spark, d, "entities").groupBy("entity_type", F.upper("status").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("entity_key").alias("keys"))


@query("select source_id, max_by(snapshot_id, (created_at, snapshot_id)) as snapshot_id, max(created_at) as created_at from project_snapshots group by source_id")
def m14_latest_snapshot(spark, d):
    m = table(spark, d, "project_snapshots").groupBy("source_id").agg(F.max(F.struct("created_at", "snapshot_id")).alias("m"))
    return m.select("source_id", "m.snapshot_id", "m.created_at")
