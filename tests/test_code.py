"""The reader of source text, resolution of targets, relations in step with files, and versions of a graph."""

import datetime as dt

import pytest
from conftest import rows

from loamgraph.operators import contracts, graphstate, relations, resolve
from loamgraph.plans import code as plans
from loamgraph.sources import code
from loamgraph.sources.tables import Scratch, table

FILES = "file_id long, source_id string, project_key string, file_path string, language string, content string, ingested_at timestamp, row string"
T0 = dt.datetime(2025, 1, 1)

TS = """import A, { B as C, type D } from './x'; import * as E from "e"; import type F from 'f'; export { q } from './q'; export * from './all';
// class Not {}
const s = 'class No2 {'; const re = /class No3 {/g;
@Dec({a:1}) export abstract class Foo<T> extends Bar<T> implements Baz, Qux.Z {
  private readonly x: number = 3; #p = 1; static y?: string;
  constructor(private a: string, b = 2) { super(a); this.go(); }
  async m<U>(p: Map<string, U>, {q, r}: any): Promise<void> { await this.api.get(`/users/${p}/x`); new Thing(1, f(2)); }
  get v(): number { return 1 }
  abstract z(): void;
}
export interface I extends J, K<L> { f(a: string): void; g: number }
export type T1 = { a: string } | null;
enum Color { Red, Green = 2 }
export const useThing = (a: string) => a;
export const Card = ({ rows }) => (<div onClick={() => go()}>{rows}</div>);
const { a, b: { c }, ...rest } = foo();
export default async function main() { axios.post('/users/' + id + '/z', { x }); request({ url: '/a/b', method: 'put' }); function inner() {} }
const ROUTES = { list: '/api/list', x: 1 };
namespace N.M { export function f2() {} }
"""
JAVA = """package a.b.c;
import java.util.List; import static x.Y.z; import q.w.*;
/** class Doc {} */
@RestController @RequestMapping("/base") public class Foo<T extends Q> extends Bar<T> implements X, Y<Z> {
  private final int a = 1, b; static { init(); }
  @Deprecated public Foo(String s) { super(s); }
  @GetMapping("/x/{id}") public List<String> get(@PathVariable("id") Long id, final String... r) throws E1, E2 { return userService.find(id).map(q -> new Dto(q, 1)); }
  @RequestMapping(value = "/y", method = RequestMethod.POST) void post() { orderService.save(); }
  record Pt(int x, int y) { Pt { check(x); } }
  enum E implements I { A(1) { void x() { go(); } }, B; E(int... i) {} }
  interface In { int K = 3; default void d() {} }
  @interface Note { String value() default "x"; }
}
"""
VUE = """<template><div @click="go"><user-card :a="1"/><UserCard/></div></template>
<script setup lang="ts">
import UserCard from './UserCard.vue';
const props = withDefaults(defineProps<{ a: string }>(), { a: '' });
function go() { emit('x'); }
</script>
<script>export default { name: 'N', props: { a: String }, methods: { async load(x) { await this.api.get('/a'); } } }</script>
"""


def found(text, language, row):
    return [r for r in code.read(text, language, "d/File.x") if r["row"] == row]


def test_typescript():
    s = {(r["kind"], r["qualified"]): r for r in found(TS, "tsx", "symbol")}
    assert set(s) == {("VARIABLE", "s"), ("VARIABLE", "re"), ("CLASS", "Foo"), ("FIELD", "Foo.x"), ("FIELD", "Foo.#p"), ("FIELD", "Foo.y"), ("METHOD", "Foo.constructor"), ("FIELD", "Foo.a"), ("METHOD", "Foo.m"), ("METHOD", "Foo.v"), ("METHOD", "Foo.z"), ("INTERFACE", "I"), ("TYPE", "T1"), ("ENUM", "Color"), ("HOOK", "useThing"), ("COMPONENT", "Card"), ("VARIABLE", "a"), ("VARIABLE", "c"), ("VARIABLE", "rest"), ("FUNCTION", "main"), ("FUNCTION", "main.inner"), ("VARIABLE", "ROUTES"), ("FUNCTION", "N.M.f2")}
    assert s["METHOD", "Foo.m"]["signature"] == "(p: Map<string, U>, {q, r}: any): Promise<void>" and s["METHOD", "Foo.m"]["modifiers"] == "async"
    assert (s["CLASS", "Foo"]["line"], s["CLASS", "Foo"]["end_line"]) == (4, 10) and s["CLASS", "Foo"]["exported"] and s["ENUM", "Color"]["detail"] == "Red,Green"
    assert {(r["kind"], r["owner"], r["target"]) for r in found(TS, "tsx", "heritage")} == {("EXTENDS", "Foo", "Bar"), ("IMPLEMENTS", "Foo", "Baz"), ("IMPLEMENTS", "Foo", "Qux.Z"), ("EXTENDS", "I", "J"), ("EXTENDS", "I", "K")}
    assert [(r["kind"], r["target"], r["detail"]) for r in found(TS, "tsx", "import")] == [("VALUE", "./x", "A,C,D"), ("VALUE", "e", "E"), ("TYPE", "f", "F"), ("REEXPORT", "./q", "q"), ("REEXPORT", "./all", "*")]
    assert {(r["owner"], r["target"], r["arguments"]) for r in found(TS, "tsx", "call")} == {("", "Dec", 1), ("Foo.constructor", "super", 1), ("Foo.constructor", "this.go", 0), ("Foo.m", "this.api.get", 1), ("Foo.m", "f", 1), ("Card", "go", 0), ("", "foo", 0), ("main", "axios.post", 2), ("main", "request", 1)}
    assert [(r["owner"], r["target"], r["arguments"]) for r in found(TS, "tsx", "new")] == [("Foo.m", "Thing", 2)]
    assert {(r["kind"], r["target"]) for r in found(TS, "tsx", "client")} == {("ANY", "/api/list"), ("GET", "/users/{id}/x"), ("POST", "/users/{id}/z"), ("PUT", "/a/b")}


def test_interface_fields():
    text = "interface A { a: string; readonly b?: Map<string, {x: number, y: Q}>, f(x: T): void; [k: string]: any; 'c-d': 1 | 2 }\ninterface B {\n  p: number\n  q?: A[]\n  g(): void\n  r: { s: string; t: number }\n}"
    assert [(r["owner"], r["name"], r["signature"]) for r in found(text, "typescript", "field")] == [("A", "a", "string"), ("A", "b", "Map<string, {x: number, y: Q}>"), ("A", "c-d", "1 | 2"), ("B", "p", "number"), ("B", "q", "A[]"), ("B", "r", "{ s: string; t: number }")]


def test_lineage_and_references(spark):
    fields = "file_id long, owner string, name string, signature string"
    front = spark.createDataFrame([(1, "User", "name", "string"), (2, "UserDto", "name", "string"), (1, "User", "age", "number"), (3, None, "x", "")], fields)
    back = spark.createDataFrame([(7, "a.UserEntity", "name", "String"), (8, "Other", "age", "int")], fields)
    assert rows(contracts.field_lineage(front, back)) == {("User", "name", "string", "String", 2, 1)}
    refs = spark.createDataFrame([("P", "T"), ("P", "T"), ("Q", "T"), ("P", "None")], "project_key string, name string")
    offers = spark.createDataFrame([("P", "T", "k1"), ("Q", "T", "k3"), ("Q", "T", "k2"), ("R", "T", "k4"), (None, "T", "k0")], "project_key string, name string, key string")
    assert rows(contracts.referenced(refs, offers)) == {("P", "T", "Q", "k2", 0.85), ("Q", "T", "P", "k1", 0.85)}


def test_java():
    s = {(r["kind"], r["qualified"]): r for r in found(JAVA, "java", "symbol")}
    assert set(s) == {("CLASS", "Foo"), ("FIELD", "Foo.a"), ("FIELD", "Foo.b"), ("METHOD", "Foo.<init>"), ("METHOD", "Foo.get"), ("METHOD", "Foo.post"), ("CLASS", "Foo.Pt"), ("METHOD", "Foo.Pt.<init>"), ("ENUM", "Foo.E"), ("METHOD", "Foo.E.x"), ("METHOD", "Foo.E.<init>"), ("INTERFACE", "Foo.In"), ("FIELD", "Foo.In.K"), ("METHOD", "Foo.In.d"), ("ANNOTATION", "Foo.Note"), ("METHOD", "Foo.Note.value")}
    assert s["METHOD", "Foo.get"]["signature"] == "(Long id, String... r): List<String> throws E1, E2" and s["METHOD", "Foo.Pt.<init>"]["signature"] == "(int x, int y)"
    assert s["FIELD", "Foo.In.K"]["modifiers"] == "public static final" and s["ENUM", "Foo.E"]["detail"] == "A,B"
    assert {(r["kind"], r["owner"], r["target"]) for r in found(JAVA, "java", "heritage")} == {("EXTENDS", "Foo", "Bar"), ("IMPLEMENTS", "Foo", "X"), ("IMPLEMENTS", "Foo", "Y"), ("IMPLEMENTS", "Foo.E", "I")}
    assert [(r["kind"], r["target"]) for r in found(JAVA, "java", "import")] == [("TYPE", "java.util.List"), ("STATIC", "x.Y.z"), ("WILDCARD", "q.w.*")]
    assert [(r["kind"], r["target"], r["name"], r["detail"]) for r in found(JAVA, "java", "endpoint")] == [("GET", "/base/x/{id}", "get", "userService.find"), ("POST", "/base/y", "post", "orderService.save")]
    assert ("Foo.get", "Dto", 2) in {(r["owner"], r["target"], r["arguments"]) for r in found(JAVA, "java", "new")}


def test_vue():
    assert {(r["kind"], r["qualified"]) for r in found(VUE, "vue", "symbol")} == {("COMPONENT", "File"), ("VARIABLE", "script_setup.props"), ("FUNCTION", "script_setup.go"), ("METHOD", "script.load")}
    assert sorted(r["name"] for r in found(VUE, "vue", "macro")) == ["defineProps", "withDefaults"]
    assert [(r["name"], r["arguments"]) for r in found(VUE, "vue", "template")] == [("UserCard", 2)] and [r["name"] for r in found(VUE, "vue", "event")] == ["click"]
    assert [r["detail"] for r in found(VUE, "vue", "options")] == ["props,methods"]
    assert next(r["line"] for r in found(VUE, "vue", "symbol") if r["name"] == "go") == 5


def test_status_of_odd_texts():
    reason = lambda *a: code.read(*a)[-1]["name"]
    assert [reason(None, "java", "a.java"), reason("x", None, "a.sql"), reason(" \n", "java", None), reason("a\0b", "java", ""), reason("class A { void f() {", "java", ""), reason("const a = 1", " TypeScript ", None)] == ["NO_CONTENT", "UNSUPPORTED_LANGUAGE", "EMPTY", "BINARY", "UNBALANCED", "OK"]
    assert reason("x = `a${b ? `c${d}` : ''}e`; f(" + "(" * 5000 + ")" * 5000 + ")", "javascript", "") in ("OK", "FAILED")
    assert [r["qualified"] for r in code.read("class A { int x = 1; void g() {", "java", "") if r["row"] == "symbol"] == ["A", "A.x", "A.g"]
    for text in ("class", "export", "import {", "function", "@", "enum A {", "<", "a ? b", "class A extends", "type X =", "const {", "interface I"):
        assert code.read(text, "typescript", "")[-1]["row"] == "status" and code.read(text, "java", "")[-1]["row"] == "status"


def test_rows_of_whole_table(spark, data):
    files = table(spark, data, "source_files")
    r = Scratch(spark, "t").cut(code.extracted(files))
    status = r.filter("row = 'status'")
    assert status.count() == files.count() and status.agg({"arguments": "sum"}).first()[0] == r.filter("row = 'symbol'").count() > 0
    assert code.extracted(files.limit(0)).count() == 0
    # what the patterns of m13_imports find at the start of lines, the reader finds as well, but in comments and broken files
    whole = {x.file_id for x in status.filter("name = 'OK'").collect()}
    read = {(x.file_id, x.target) for x in r.filter("row = 'import'").collect()}
    from loamgraph.sources import parse

    assert {(x.file_id, x.target) for x in parse.imports(files).collect() if x.file_id in whole} <= read


def project(spark):
    f = lambda i, path, text, minute=0: (i, "s", "P", path, None, text, T0 + dt.timedelta(minutes=minute), "x")
    return spark.createDataFrame(
        [
            f(1, "app/src/a/main.ts", "import { help } from '../lib/help';\nimport X from '@/lib/index'; import { N } from './none'; export class M extends Base { run() { help(1); this.stop(); other(); } stop() {} }\nclass Base {}\nfunction other() {}"),
            f(2, "./app/src/lib/help.ts", "export function help(n) {}"),
            f(3, "app/src/lib/index.js", "export default class X {}"),
            f(4, "app/src/lib/help.ts", "export function help(n) { }", 9),
            f(5, "app/java/a/b/Foo.java", "package a.b; import a.c.Bar; class Foo extends Bar implements Near { void f() { g(); new Bar(); } void g() {} }"),
            f(6, "app/java/a/c/Bar.java", "package a.c; public class Bar {}"),
            f(7, "app/java/a/b/Near.java", "package a.b; interface Near {}"),
            f(8, None, "x", 1), f(9, "app/src/z.ts", None),
        ],
        FILES,
    )


def resolved(files):
    r, index = code.extracted(files), resolve.file_index(files)
    top = r.filter("row = 'symbol' and owner = ''").select("file_id", "name")
    return r, index, resolve.modules(r.filter("row = 'import'"), index, r.filter("row = 'package'").select("file_id", "name"), top)


def test_targets_are_resolved(spark):
    r, index, found = resolved(project(spark))
    assert rows(found) == {(1, "../lib/help", "PATH", 4), (1, "@/lib/index", "PATH", 3), (5, "a.c.Bar", "FQN", 6)}
    edges = rows(resolve.symbols_of(code.relations(r), r, index, found).select("file_id", "subject", "predicate", "target", "tier", "object_file", "object"))
    assert edges == {
        (1, "M", "EXTENDS", "Base", "SAME_FILE", 1, "Base"), (1, "M.run", "CALLS", "help", "IMPORT", 4, "help"), (1, "M.run", "CALLS", "this.stop", "SAME_TYPE", 1, "M.stop"), (1, "M.run", "CALLS", "other", "SAME_FILE", 1, "other"),
        (5, "Foo", "EXTENDS", "Bar", "IMPORT", 6, "Bar"), (5, "Foo", "IMPLEMENTS", "Near", "PACKAGE", 7, "Near"), (5, "Foo.f", "CALLS", "g", "SAME_TYPE", 5, "Foo.g"), (5, "Foo.f", "CREATES", "Bar", "IMPORT", 6, "Bar"),
    }
    assert resolved(project(spark).limit(0))[2].count() == 0


def test_suffix_tier(spark):
    f = lambda i, path, text: (i, "s", "P", path, None, text, T0, "x")
    files = spark.createDataFrame([f(1, "r/a.ts", "import x from 'util/deep/thing'; import y from 'twin/one';"), f(2, "r/src/util/deep/thing.ts", "1"), f(3, "r/p/twin/one.ts", "1"), f(4, "r/q/twin/one.ts", "1")], FILES)
    assert rows(resolved(files)[2]) == {(1, "util/deep/thing", "SUFFIX", 2)}


def test_queries_over_the_fixture(spark, monkeypatch):
    monkeypatch.setattr(plans, "table", lambda s, d, n: project(spark))
    edges = rows(plans.m8_resolved_edges(spark, "x"))
    key = lambda path, kind, name: next(k for e in edges for k in (e[0], e[2]) if f":{path}:{kind}:{name}:" in k)
    assert ("FILE:P:app/src/a/main.ts", "IMPORTS", "FILE:P:app/src/lib/help.ts", "PATH") in edges and len(edges) == 11
    assert (key("app/java/a/b/Foo.java", "METHOD", "Foo::f"), "CALLS", key("app/java/a/b/Foo.java", "METHOD", "Foo::g"), "SAME_TYPE") in edges
    assert rows(plans.m8_resolved_imports(spark, "x")) == {(1, "../lib/help", 4), (1, "@/lib/index", 3)}


def test_relations_follow_files(spark):
    stored = spark.createDataFrame([("a", "f", "ACTIVE", 1, "x"), ("b", "f", "ACTIVE", 2, None), ("c", "f", "DELETED", 1, None), ("d", "f", "ACTIVE", 1, None), ("e", "g", "ACTIVE", 1, None), ("h", "f", "DELETED", 4, None), (None, "f", "ACTIVE", 1, None)], "relation_key string, file string, status string, occurrences long, object string")
    arrived = spark.createDataFrame([("a", "f", 1, None), ("b", "f", 2, None), ("b", "f", 3, "y"), ("c", "f", 1, None), ("n", "f", 1, None)], "relation_key string, file string, occurrences long, object string")
    files = spark.createDataFrame([("f",), ("f",)], "file string")
    got = rows(relations.synced(stored, arrived, files).select("relation_key", "outcome", "status", "occurrences", "object"))
    assert got == {("a", "UNCHANGED", "ACTIVE", 1, "x"), ("b", "UPDATED", "ACTIVE", 5, "y"), ("c", "REACTIVATED", "ACTIVE", 1, None), ("d", "DELETED", "DELETED", 1, None), ("e", "KEPT", "ACTIVE", 1, None), ("h", "KEPT", "DELETED", 4, None), ("n", "CREATED", "ACTIVE", 1, None)}


def test_graph_versions(spark, tmp_path):
    ents = lambda v: spark.createDataFrame(v, graphstate.ENTITIES)
    edges = lambda v: spark.createDataFrame(v, graphstate.EDGES)
    files = lambda *v: spark.createDataFrame([(x,) for x in v], "file string")
    store = graphstate.GraphStore(spark, str(tmp_path / "g"))
    assert store.publish(ents([("A", "f", "1"), ("a1", "f", "1"), ("B", "g", "1"), ("b1", "g", "1")]), edges([("A", "DEFINES", "a1", "f"), ("B", "DEFINES", "b1", "g"), ("b1", "CALLS", "a1", "g")])) == 1
    # a1 goes: the edge that g holds into it goes as well
    assert store.update(files("f"), ents([("A", "f", "2"), ("a2", "f", "1")]), edges([("A", "DEFINES", "a2", "f")])) == 2
    assert rows(store.entities()) == {("A", "f", "2"), ("a2", "f", "1"), ("B", "g", "1"), ("b1", "g", "1")}
    assert rows(store.edges()) == {("A", "DEFINES", "a2", "f"), ("B", "DEFINES", "b1", "g")}
    for bad in ([("A", "DEFINES", "gone", "f")], [("A", "EXTENDS", "A", "f")]):
        with pytest.raises(graphstate.Refused):
            store.update(files("f"), ents([("A", "f", "3")]), edges(bad))
    assert store.version() == 2 and rows(store.entities().filter("key = 'A'")) == {("A", "f", "2")}
    assert store.update(files("f", "g"), ents([]), edges([])) == 3 and store.entities().count() == store.edges().count() == 0
    old, new = ents([("A", "f", "1"), ("B", "f", None)]), ents([("A", "f", "2"), ("C", "f", "1"), ("B", "g", None)])
    assert rows(graphstate.delta(old, new)) == {("A", "MODIFIED", "2"), ("C", "ADDED", "1")}
    assert rows(graphstate.edge_delta(edges([("A", "X", "B", "f")]), edges([("A", "Y", "B", "g")]))) == {("A", "X", "B", "DELETED"), ("A", "Y", "B", "ADDED")}
