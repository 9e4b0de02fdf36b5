"""Small cases of the reference's operators."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loamgraph.functions import normal, scalars
from loamgraph.operators import contracts, graph, metrics, retrieval, state
from loamgraph.plans import catalog
from loamgraph.sources import parse
from loamgraph.sources.tables import Scratch
from loamgraph.streaming import ingest


def one(spark, col, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(col.alias("x")).first().x


def test_routes_and_paths(spark):
    v = F.col("v0")
    for raw, want in (("users/:id//", "/users/{param}"), ("/a/{x}?q=1", "/a/{param}"), ("", "/"), ("\\a\\b", "/a/b"), (None, "/")):
        assert one(spark, scalars.route(v), raw) == want
    for raw, want in ((".//a//b/", "a/b"), ("././x", "x"), ("a\\b", "a/b"), ("a", "a")):
        assert one(spark, normal.clean_path(v), raw) == want
    assert one(spark, normal.parent_path(v), "a/b/c") == "a/b" and one(spark, normal.parent_path(v), "a") is None


def test_canonical_json(spark):
    v = F.col("v0")
    same = ['{"a":1,"b":{"y":2}}', ' { "b": {"z": null, "y":2}, "a" : 1, "c": null}']
    assert len({one(spark, normal.canonical_json(v), s) for s in same}) == 1
    assert one(spark, normal.canonical_json(v), None) == one(spark, normal.canonical_json(v), '{"x": null}') == "{}"
    assert one(spark, normal.canonical_json(v), '{"p":"a\\":null,}"}') == '{"p":"a\\":null,}"}'
    assert one(spark, normal.canonical_json(v), " not json ") == "text:not json"


def test_terms_and_intent(spark):
    assert one(spark, scalars.index_terms(F.col("v0")), "LeadService 转换规则 a") == ["lead", "service", "leadservice", "转", "换", "规", "则", "转换", "换规", "规则", "转换规则"]
    for q, want in (("谁改了 LeadService", "HISTORY_QUERY"), ("impact of x", "IMPACT_QUERY"), ("LeadService", "ENTITY_LOOKUP"), ("calls to /crm", "RELATION_QUERY"), ("hello there", "UNKNOWN")):
        assert one(spark, scalars.intent(F.col("v0")), q) == want
    assert one(spark, scalars.name_tokens(F.col("v0")), "the LeadService of ab Xy") == ["LeadService"]
    assert one(spark, scalars.path_tokens(F.col("v0")), "see a/b.ts and /crm/lead") == ["a/b.ts", "/crm/lead"]


def test_small_scalars(spark):
    assert one(spark, scalars.pascal(F.col("v0")), "lead-list_item") == "LeadListItem"
    assert one(spark, scalars.redact(F.col("v0")), "https://me:secret@host/x") == "https://me:***@host/x"
    assert one(spark, scalars.bare_code(F.col("v0")), "a // x\n /* y */ b") == "ab"
    assert len(one(spark, scalars.clipped(F.col("v0")), "x" * 400)) == 255
    assert one(spark, scalars.symbol_key(*[F.col(f"v{i}") for i in range(5)]), "P", "a.ts", "CLASS", "A", "") == "SYMBOL:P:a.ts:CLASS:A:e3b0c44298fc1c14"
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0])], "a array<double>, b array<double>")
    assert df.select(scalars.dot(F.col("a"), F.col("b"))).first()[0] == 11.0
    assert df.select(scalars.tempered(F.lit(0.9), 1.0)).first()[0] == 0.9


EDGES = [("AdSetup", "IMPORTS", "leadApi"), ("leadApi", "API_CALLS", "LeadController"), ("LeadController", "CALLS", "LeadService"), ("LeadService", "IMPLEMENTS", "ConversionRule")]


def reach(spark, edges, seeds, direction, depth=3, **more):
    e = spark.createDataFrame(edges, "src string, predicate string, dst string")
    return {r.id: (r.hop, r.evidence) for r in graph.impact(e, spark.createDataFrame([(s,) for s in seeds], "id string"), Scratch(spark, "g"), direction, depth, **more).collect()}


def test_impact(spark):
    got = reach(spark, EDGES, ["LeadController"], "both")
    assert got["leadApi"][0] == 1 and got["AdSetup"][0] == 2 and got["ConversionRule"][0] == 2
    cycle = [("A", "CALLS", "B"), ("B", "CALLS", "C"), ("C", "CALLS", "A")]
    assert set(reach(spark, cycle, ["A"], "up")) == {"B", "C"}
    assert set(reach(spark, cycle, ["A"], "up", reach_seeds=True)) == {"A", "B", "C"}
    assert reach(spark, cycle, ["nobody"], "both") == {}
    many = [("A", "CALLS", "B"), ("B", "CALLS", "D"), ("A", "IMPORTS", "C"), ("C", "IMPORTS", "D")]
    assert reach(spark, many, ["A"], "up")["D"] == (2, "CALLS,IMPORTS")
    tree = [(str(i), "CALLS", str(c)) for i in range(134) for c in (3 * i + 1, 3 * i + 2, 3 * i + 3) if c < 400]
    assert [len(reach(spark, tree, ["0"], "up", d)) for d in (1, 2, 3)] == [3, 12, 39]


def test_contracts(spark):
    calls = spark.createDataFrame([("c1", "GET", "/users/1"), ("c2", "POST", "/users/{id}"), ("c3", "GET", "/api/v1/orders"), ("c4", "GET", "/x/crm/lead"), ("c5", "GET", "/none")], "call_id string, method string, path string")
    ends = spark.createDataFrame([("e1", "GET", "/users/{id}", "a"), ("e2", "GET", "/orders", "a"), ("e3", "GET", "/crm/lead", "LegacyController"), ("e4", "GET", "/crm/lead", "mock/x")], "end_id string, method string, path string, file_path string")
    g = contracts.graded(calls, ends)
    assert rows(g) == {("c1", "e1", "EXACT", 1.0), ("c2", "e1", "STRONG", 0.9), ("c3", "e2", "STRONG", 0.9), ("c4", "e3", "HEURISTIC", 0.7), ("c4", "e4", "HEURISTIC", 0.7)}
    r = {(x.call_id, x.end_id): (x.confidence, x.rank, x.ambiguous) for x in contracts.ranked(g, ends).collect()}
    assert r["c4", "e3"] == (0.45, 1, True) and r["c4", "e4"] == (0.3, 2, True) and r["c1", "e1"] == (1.0, 1, False)
    d = contracts.dispatched(spark.createDataFrame([("c", "I"), ("d", "J")], "call_key string, interface string"), spark.createDataFrame([("I", "x"), ("I", "y"), ("J", "z")], "interface string, impl_key string"))
    assert {(a, b, float(c)) for a, b, c in rows(d)} == {("c", "x", 0.5), ("c", "y", 0.5), ("d", "z", 0.9)}


def test_contracts_by_file(spark, tmp_path):
    serve = '@GetMapping("{}")'.format
    data = [(1, "a/page.ts", "http.get('/users')"), (2, "a/more.ts", "http.get('/users')\nhttp.get('/roles')\nhttp.get('/user')"), (3, "a/Own.java", serve("/users")), (4, "legacy/Old.java", serve("/users")), (5, "mock/Fake.java", serve("/users")), (6, "b/R.java", serve("/roles")), (7, "c/R.java", serve("/roles"))]
    spark.createDataFrame(data, "file_id long, file_path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = {(r.call_id, r.end_id): (r.grade, r.confidence, r.rank, r.ambiguous) for r in catalog.m8_ranked_contracts(spark, str(tmp_path)).collect()}
    members = rows(catalog.m8_contract_members(spark, str(tmp_path)))
    files = lambda side, i: {f for s, x, f in members if (s, x) == (side, i)}
    pairs = {(c, path, e): v for (call, end), v in got.items() for c in files("call", call) for e in files("end", end) for path in [call]}
    want = {}
    for c, path in ((1, "GET /users"), (2, "GET /users")):
        want |= {(c, path, 3): ("EXACT", 1.0, 1, False), (c, path, 4): ("EXACT", 0.75, 2, False), (c, path, 5): ("EXACT", 0.6, 3, False)}
    want |= {(2, "GET /roles", e): ("EXACT", 1.0, 1, True) for e in (6, 7)}
    want |= {(2, "GET /user", e): ("HEURISTIC", c, n, False) for e, c, n in ((3, 0.7, 1), (4, 0.45, 2), (5, 0.3, 3))}
    assert pairs == want


def test_metrics(spark):
    p = spark.createDataFrame([("t", "AUTO", "AUTO", 0.90), ("t", "REJECT", "REJECT", 0.95), ("t", "AUTO", "REVIEW", 0.60), ("t", "REJECT", "AUTO", 0.85)], "task string, expected string, predicted string, confidence double")
    assert tuple(metrics.losses(p).first()) == (0.27375, 0.742516)
    got = {r.label: (r.precision, r.recall) for r in metrics.per_class(p).collect()}
    assert got == {"AUTO": (0.5, 0.5), "REJECT": (1.0, 0.5), "REVIEW": (0.0, 0.0)}
    b = spark.createDataFrame([("t", "A", "A", 0.3)], p.schema)
    assert metrics.calibration_bins(b).first().bin == 2  # 3 * 0.1 is above 0.3 in floating point
    o = metrics.ordinals(spark.createDataFrame([("k", float(i)) for i in range(10)], "k string, v double"), "k", "v", [0.5, 0.99, 1.0])
    assert rows(o) == {("k", 0.5, 5.0), ("k", 0.99, 9.0), ("k", 1.0, 9.0)}


def test_content_diff(spark, tmp_path):
    spark.createDataFrame([("s1", "a", 1), ("s2", "a", 2)], "snapshot_id string, source_id string, created_at int").write.parquet(f"{tmp_path}/project_snapshots.parquet")
    meta = lambda size, sha: f'{{"size_bytes": {size}' + (f', "sha256": "{sha}"}}' if sha else "}")
    ents = [("s1", "same", meta(5, "x")), ("s2", "same", meta(5, "x")), ("s1", "edit", meta(5, "x")), ("s2", "edit", meta(5, "y")), ("s1", "bare", meta(5, "x")), ("s2", "bare", meta(5, None)), ("s1", "gone", meta(5, "x")), ("s2", "new", meta(5, "x"))]
    spark.createDataFrame([(*e, "FILE") for e in ents], "snapshot_id string, entity_key string, metadata string, entity_type string").write.parquet(f"{tmp_path}/snapshot_entities.parquet")
    assert rows(catalog.m11_content_diff(spark, str(tmp_path))) == {("edit", "MODIFIED"), ("gone", "DELETED"), ("new", "ADDED")}
    assert tuple(catalog.m11_content_equivalence(spark, str(tmp_path)).first()) == (3, 1, 1, 1, 0.4)


def test_state(spark):
    f = lambda v: spark.createDataFrame(v, "path string, digest string, bare_digest string")
    assert rows(state.file_diff(f([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")]), f([("b", "9", "y"), ("c", "3", "z"), ("d", "4", "w")]))) == {("a", "DELETED", False), ("b", "MODIFIED", True), ("d", "ADDED", False)}
    s = spark.createDataFrame([("a", "1", "ACTIVE"), ("b", "1", "deleted"), ("c", "1", "ACTIVE"), ("e", "1", "DELETED"), ("f", "1", None)], "key string, value string, status string")
    n = spark.createDataFrame([("a", "2"), ("b", "1"), ("d", "1"), ("f", "1")], "key string, value string")
    assert {(r.key, r.outcome) for r in state.upsert(s, n).collect()} == {("a", "UPDATED"), ("b", "REACTIVATED"), ("c", "DELETED"), ("d", "CREATED"), ("f", "UNCHANGED")}


def test_cosine_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 3), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 6 = 0").selectExpr("vec_id as query_id", "embedding")
    assert rows(retrieval.cosine(v, q, 5, block=3)) == rows(retrieval.cosine(v, q, 5, block=100))
    assert retrieval.cosine(v, q.filter("false"), 5).count() == 0


def test_parsing(spark):
    log = ["s1\x1fann\x1f2025\nM\ta.ts\nR100\told.ts\tnew.ts\n3\t1\ta.ts\n-\t-\tnew.ts\n", "s2\x1fbob\x1f2025\nD\tb.ts", "", None]
    got = rows(parse.commit_log(spark.createDataFrame([(x,) for x in log], "value string")))
    assert got == {("s1", "ann", "a.ts", "MODIFIED", None, 3, 1), ("s1", "ann", "new.ts", "RENAMED", "old.ts", 0, 0), ("s2", "bob", "b.ts", "DELETED", None, 0, 0)}
    pom = "<project><groupId>g</groupId><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency></dependencies></project>"
    assert rows(parse.pom_entries(spark.createDataFrame([(1, pom)], "file_id long, content string"))) == {(1, "x:y", "managed", "compile")}
    md = "intro\n# A\none\n\n## B\n   \n# C\ntwo"
    c = parse.chunks(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("chunk").collect()
    assert [(r.start_line, r.end_line) for r in c] == [(1, 1), (2, 4), (5, 6), (7, 8)]
    f = spark.createDataFrame([(1, "class A extends B { public void run(int a) {} if (x) {} }\nclient.get(`/a/${x}/b`)\n@PostMapping(\"/z/\")")], "file_id long, content string")
    assert rows(parse.symbols(f)) == {(1, "CLASS", "A"), (1, "METHOD", "run")}
    assert rows(parse.client_calls(f)) == {(1, "GET", "/a/{id}/b")} and rows(parse.served_routes(f)) == {(1, "POST", "/z")}


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    q = ingest.ingest(ingest.deduplicated(stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == spark.read.parquet(f"{data}/events.parquet").count()
    w = ingest.tumbling(stream()).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    batch = ingest.tumbling(spark.read.parquet(f"{data}/events.parquet"))
    assert rows(spark.table("windows")) == rows(batch)


def test_earliest_event_counts(spark):
    e = spark.createDataFrame([("a", 5, 1, None), ("a", 3, 9, 7), ("a", 3, 2, None), ("b", None, 1, 1)], "event_id string, ts int, user_id int, value int")
    assert rows(ingest.deduplicated(e)) == {("a", 3, 2, None), ("b", None, 1, 1)}
    assert ingest.deduplicated(e.limit(0)).count() == 0


def test_scoring_by_bounds(spark, monkeypatch):
    """Leaving documents out by bounds changes nothing: as all pairs scored, at any number of seeds."""
    import random

    rnd = random.Random(7)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(rnd.sample(words, rnd.randrange(1, 30)))) for i in range(400)] + [(900, ""), (901, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(rnd.sample(words, 12))) for q in range(6)] + [(90, "nothing here"), (91, ""), (92, "w1 w1 w2")], "query_id long, text string")
    call = lambda: rows(retrieval.bm25(docs, queries, scalars.lower_terms, Scratch(spark, "t"), 5))
    few = None
    for seeds in (0, 1, 3, 10**6):
        monkeypatch.setattr(retrieval, "SEEDS", seeds)
        got = call()
        few = few or got
        assert got == few and {r[0] for r in got} == {0, 1, 2, 3, 4, 5, 92}


def test_client_calls(spark):
    text = "axios.get('/users/' + id + '/x'); API.client.Post(`/a/${b}/c`); http.delete(\"/d/\" + row.id); request({ url: '/o', method: 'put' }); request({url: '/p'}); client.get(path)"
    got = rows(parse.client_calls(spark.createDataFrame([(1, text)], "file_id long, content string")))
    assert got == {(1, "GET", "/users/{id}/x"), (1, "POST", "/a/{id}/c"), (1, "DELETE", "/d/{id}"), (1, "PUT", "/o"), (1, "GET", "/p")}


def test_percentiles_of_a_hot_key(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(500)] + [("j", 1.0)], "k string, v double")
    assert rows(metrics.ordinals(df, "k", "v", [0.5, 0.99], 10)) == rows(metrics.ordinals(df, "k", "v", [0.5, 0.99])) == {("k", 0.5, 250.0), ("k", 0.99, 495.0), ("j", 0.5, 1.0), ("j", 0.99, 1.0)}


@pytest.mark.parametrize("name", ["a.env", "id_rsa", "x.pem"])
def test_sensitive(spark, name, tmp_path):
    (tmp_path / "plain.txt").write_bytes(b"a\x00b")
    df = parse.scanned(spark.read.format("binaryFile").load(str(tmp_path)))
    r = df.first()
    assert r.is_binary and not r.is_sensitive and r["size"] == 3
