"""Recognisers: valid and broken snippets of each language."""

import ast
import json

import pyarrow.dataset as ds
import pytest

from loamgraph.llm.syntax import language_of, verdict

GOOD = {
    "typescript": [
        "const a = <T,>(a: T): T => a;", "type A<T> = T extends (infer U)[] ? U : never;", "let y = a < b && c > d;", "f<string>(x); const z = a as unknown as B<C>;",
        "abstract class A<T> extends B<T> implements C { constructor(private readonly x: number, y?: string) { super(); } static #p = 1; get v(): number { return this.#q } [k: string]: any; abstract m(): void; }",
        "declare module 'x' { export const y: number; }", "let v = a ? (b): c => d : e;", "x!.y![0]!()", "type M = { readonly [K in keyof T]?: T[K] };", "let t = `a${b ? `c${d}` : ''}e`;",
        "function isS(x: any): x is string { return true }", "import type B, { C } from 'b';", "@Dec({a:1}) export class Q { @Input() x!: string; m(@P() p) {} }", "namespace N.M { export let a = 1 }",
        "const s = '<<<<<<< not a marker'; // >>>>>>> neither\n/*\n=======\n*/", "function o(a: string): void; function o(a: any) {}", "let x: [a: string, b?: number, ...c: T[]];", "",
    ],
    "tsx": ["const a = <div {...p} key={1}>{x && <b>y's</b>}{/* c */}<></></div>;", "const f = <T,>(x: T) => <C<T> v={x} />;"],
    "jsx": ["const a = <a.b x='y' d={`q`}>don't ( [</a.b>;"],
    "javascript": ["let a = async (x) => x; async () => {}; var async; async(1)", "x = y\n/re/g.exec(z)", "import('x').then(m => m); import.meta.url", "class A { static { this.x = 1 } async *m() {} 'q'() {} get; set = 2 }", "const re = /[({]+x[)}]?$/gi", "#!/usr/bin/env node\nfoo()", "label: for(;;) { break label }", "/* only a comment ( */"],
    "java": [
        "class A<T extends B & C> { A() { this(1); } int[] a = {1,2}, b[] = new int[3][]; T m(final @N String... s) throws E { return (T) s; } static { } { } }", "enum E implements I { A(1) { void x() {} }, B; E(int... i) {} }",
        "class B { void f() { for (var x : xs) { } Runnable r = () -> {}; h = A::new; int y = (int) -1; z = (a) + b; var q = switch (x) { case Integer i when i > 3 -> 1; default -> throw new E(); }; if (o instanceof String s) {} try (var in = open()) {} catch (A | B e) {} char c = '{'; String t = \"\"\"\n  a \"b\" {\n  \"\"\"; } }",
        "package a.b; import static c.D.*; public final class Z { }",
    ],
    "vue": ["<template>\n<div v-if=\"a > b\" @click=\"x++\"><br><img src='a'>{{ a ? b : c }}</div>\n</template>\n<script setup lang=\"ts\">const a: number = 1</script>\n<style scoped>.a { b: c; }</style>", ""],
    "python": ["def f(x):\n    return f'{x!r:>{10}}'\n", "x = '''a ( [ {'''  # )", ""],
    "json": ['{"a": [1, 2.5e3, true, null, "}"]}', "[]", '"x"'],
}
BAD = {
    "javascript": ["let x: number = 1", "interface A {}", "const a = <div/>;", "foo(", "a b", "return 1", "x = {a: 1 b: 2}", "if (a {", "'abc", "`abc", "a = 1 +", "import { a from 'b'", "}", "1 = 2", "let = = 3", "/* open", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "package a.b;"],
    "typescript": ["let x: = 1", "const a = <div>x</div>;", "interface A { a: }", "type X = ", "<!DOCTYPE html>\n<html></html>", "def f(x):\n  return x"],
    "jsx": ["const a = <div><b></div>;", "const a = <div>", "let x: number", "x = <div a=b/>"],
    "java": ["class A { void f() { foo } }", "class A { int x = ; }", "class A {", "class A { void f() { int x = 'ab'; } }", "class A { String s = \"x; }", "class A { void f() { x + 1; } }", "import a.b"],
    "vue": ["<template><div></template>", "<template><div></div>", "<script>let x: number</script>", "<template>{{ a + }}</template>", "<template/><template/>", "<!DOCTYPE html><html></html>", "import json"],
    "python": ["def f(:\n  pass", "print 'x'", "x = (1, [2)", "def f():\n<<<<<<< HEAD\n    a\n", "'open", "class {"],
    "json": ["", " ", '{"a": 1,}', "{'a': 1}", '{"a" 1}', '{"a": 1} {"b": 2}', "// c\n{}", '{"a": 01}', '["x', "NaN"],
}
REASONS = [("javascript", "foo('abc", "unterminated_literal"), ("javascript", "f(1]", "unbalanced_delimiter"), ("java", "class A { void f() {", "premature_end"), ("python", "x = 1\n=======\ny = 2", "conflict_marker"), ("json", '{"a": [1}', "unbalanced_delimiter")]


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    assert verdict(text, lang) == (None, None)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_broken(lang, text):
    assert verdict(text, lang)[0]


@pytest.mark.parametrize("lang,text,reason", REASONS)
def test_reason(lang, text, reason):
    assert verdict(text, lang)[0] == reason


def test_languages():
    assert language_of(" TypeScript ", "x.java") == "typescript" and language_of(None, "a\\b.TSX") == "tsx"
    assert language_of("", "a.b/c") is None and verdict(None, "java") == (None, None) and verdict("(", None) == (None, None)


def test_depth_and_length():
    assert verdict("x = " + "(" * 3000 + "1" + ")" * 3000, "javascript") == (None, None)
    assert verdict("x = " + "[" * 3000, "javascript")[0] == "premature_end"
    assert verdict("a();\n" * 50_000, "java")[0] and verdict("a();\n" * 50_000, "javascript") == (None, None)


def test_exact_checks(data):
    t = ds.dataset(f"{data}/source_files.parquet").to_table(columns=["language", "file_path", "content"]).to_pylist()
    for r in t:
        lang = language_of(r["language"], r["file_path"])
        if lang in ("python", "json"):
            try:
                ast.parse(r["content"]) if lang == "python" else json.loads(r["content"])
                ok = True
            except ValueError:
                ok = False
            except SyntaxError:
                ok = False
            assert ok == (verdict(r["content"], lang)[0] is None)


def _nested(n, start, form):
    x = start
    for _ in range(n):
        x = form.format(x)
    return f"x = {x};"


@pytest.mark.parametrize("form", ["c ? (a = {}) : b", "d ? (b) : c => ({})", "(a = {}): number => a", "async (a = {})", "f<T>((a = {}) => a)"])
def test_nested_attempts_end(form):
    """What may be an arrow's head or an expression is not tried again at each level: below a second, not 2 to the 200."""
    import time

    for language in ("typescript", "tsx"):
        began = time.perf_counter()
        assert verdict(_nested(200, "1", form), language) == (None, None)
        assert time.perf_counter() - began < 5


def test_any_depth():
    """150,000 brackets are as valid as two; what can't be followed is not judged."""
    import sys

    from loamgraph.llm import syntax

    n, limit = 150_000, sys.getrecursionlimit()
    try:
        for text, language in (("x=" + "[" * n + "]" * n + ";", "javascript"), ("x=" + "(" * n + "1" + ")" * n + ";", "typescript"), ("class A { int x = " + "(" * n + "1" + ")" * n + "; }", "java"), ("[" * n + "]" * n, "json")):
            assert verdict(text, language) == (None, None), language
        assert verdict("x=" + "[" * n + "]" * (n - 1) + ";", "javascript")[0]
        sys.setrecursionlimit(syntax.DEEPEST)
        with pytest.raises(syntax.NotJudged):
            verdict("x=" + "[" * 700_000 + "]" * 700_000 + ";", "javascript")
    finally:
        sys.setrecursionlimit(limit)
