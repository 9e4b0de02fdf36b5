"""Signatures, keys, paths and links between manifests."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from loamgraph.functions import signatures as S
from loamgraph.operators import graph
from loamgraph.plans import index
from loamgraph.sources.tables import Scratch


def test_signatures(spark):
    assert S.split_parameters("a: Map<string, {x: number, y: [A, B]}>, b = f(1, 2), ...c") == ["a: Map<string, {x: number, y: [A, B]}>", "b = f(1, 2)", "...c"]
    for body, want in (("a: string, b?: number, ...c: T[]", "string,number?,...T[]"), ("x, { y, z }: P", "?,P"), ("private readonly a: Map<string, U> = new Map()", "Map<string,U>?"), ("@Inject(X) a: A", "A"), ("", ""), (None, "")):
        assert S.typescript_types(body) == want, body
    for body, want in (("final List<String> a, int... b", "List<String>,int..."), ('@PathVariable("id") @Valid Long id, int c[]', "Long,int[]"), ("Foo this, Map<String, List<A>> m", "Map<String,List<A>>"), ("", ""), (None, "")):
        assert S.java_types(body) == want, body
    df = spark.createDataFrame([(1, "a: string, b"), (2, None)], "i int, s string")
    assert rows(df.select("i", S.typescript_signature(F.col("s")), S.java_signature(F.col("s")))) == {(1, "string,?", "a:,b"), (2, None, None)}


def test_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(S.qualified_name(F.array(lit("A"), lit(""), lit("b")), lit("c"))) == "A::b::c" and one(S.qualified_name(lit(None).cast("array<string>"), lit("c"))) == "c"
    assert tuple(one(S.uri_parts(lit("repo://r/a/b.ts#X.y")))) == ("r", "a/b.ts", "X.y") and tuple(one(S.uri_parts(lit("repo://r/")))) == ("r", "", None) and one(S.uri_parts(lit("http://r/a"))) is None
    assert one(S.relation_key(lit("P"), lit("s"), lit("CALLS"), lit("t"), lit("K"))) == "RELATION:P:s:CALLS:t:K:default"
    assert one(S.bridge_key("CROSS", lit("P"), lit("Q"), lit("s"), lit("CALLS"), lit("t"), lit("K"), lit("d"))) == "RELATION:CROSS:P:Q:s:CALLS:t:K:d"
    assert one(S.endpoint_key(lit("get"), lit("/x"))) == "ENDPOINT:GET:/x"
    assert one(S.occurrence(line=lit(3), column=lit(None).cast("int"))) == '{"line":3}'


def test_shortest_paths(spark):
    e = spark.createDataFrame([("A", "CALLS", "B"), ("A", "USES", "C"), ("C", "CALLS", "D"), ("B", "CALLS", "D"), ("D", "CALLS", "A"), ("D", "CALLS", "E")], "src string, predicate string, dst string")
    seeds = spark.createDataFrame([("A",)], "id string")
    assert rows(graph.paths(e, seeds, Scratch(spark, "t"), "up", 2)) == {("B", 1, "A --[CALLS]--> B"), ("C", 1, "A --[USES]--> C"), ("D", 2, "A --[CALLS]--> B --[CALLS]--> D")}
    assert graph.paths(e, seeds.filter("false"), Scratch(spark, "t"), "up", 2).count() == 0


def test_manifest_links(spark, tmp_path):
    m = lambda name, **deps: f'{{"name": "{name}", "dependencies": {str(deps).replace(chr(39), chr(34))}}}'
    data = [(1, "a/package.json", m("one", two="1", react="18")), (2, "b/package.json", m("two", two="1", one="2")), (3, "c/package.json", m("two")), (4, "d.json", "not json"), (5, "e.json", None), (6, None, "{}")]
    spark.createDataFrame(data, "file_id long, file_path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    assert rows(index.m8_manifest_links(spark, str(tmp_path))) == {(1, "two", 2), (2, "one", 1)}


def test_fanout_edges(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("s", "P", at, at), ("s", "P", at, at), (None, "P", at, at), ("t", None, at, at)], "sha string, project_key string, authored_at timestamp, recorded_at timestamp").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([("s", "f", "e"), ("s", "f", "g"), ("s", None, None), ("x", "f", "e"), (None, "f", "e")], "commit_sha string, file_rel_path string, entity_key string").write.parquet(f"{tmp_path}/entity_changes.parquet")
    assert rows(index.m2_event_fanout(spark, str(tmp_path)).select("event_key")) == {("EVENT:P:COMMIT:s",), ("EVENT:P:FILE_CHANGED:s:f",), ("EVENT:P:ENTITY_CHANGED:s:e",), ("EVENT:P:ENTITY_CHANGED:s:g",)}
