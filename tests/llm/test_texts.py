"""Operators on files and documents: small cases, held-out accuracy, edge cases."""

import random

import numpy as np
import pytest
from conftest import rows

from loamgraph.llm import attributes, broken, endings, evidence, handwritten, leakage, packing, truncation
from loamgraph.sources.tables import Scratch, table

FILES = "file_id long, project_key string, source_id string, file_path string, language string, content string, runs int, kind string"
DOCS = "doc_id long, text string, source string, key long, last string"
ITEMS = "item_id long, text string, doc_id long"


def hand(i):
    rnd = random.Random(i)
    w = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    lines = [f"  const {w()} = {w()}({w()}, {rnd.randrange(999)});\n  if ({w()} > {w()}) return {w()};" for _ in range(14)]
    return f"import {{ {w()} }} from './{w()}';\nexport function {w()}({w()}) {{\n" + "\n".join(lines) + "\n}\n"


def test_broken_edges(spark):
    df = spark.createDataFrame([(1, "p", "s", "a.js", None, "f(", 0, ""), (2, None, None, None, None, None, 0, ""), (3, "p", "s", "a.json", "JSON", "", 0, ""), (4, "p", "s", "x.unknown", None, "((", 0, ""), (1, "p", "s", "a.js", None, "f(", 0, "")], FILES)
    v = broken.verdicts(df)
    assert sorted((r.file_id, r.reason) for r in v.collect() if r.reason) == [(1, "premature_end"), (1, "premature_end"), (3, "premature_end")]
    assert {(r.language, r.files, r.broken) for r in broken.rates(v).collect()} == {("javascript", 1, 1), ("json", 1, 1), ("unknown", 1, 0), (None, 1, 0)}
    assert {(r.language, r.judged, r.rate) for r in broken.rates(v).collect()} == {("javascript", 1, 1.0), ("json", 1, 1.0), ("unknown", 0, None), (None, 0, None)}
    assert broken.verdicts(df.limit(0)).count() == 0


def test_kinds():
    k = evidence.kind
    own = hand(1)
    assert k(own, "javascript") is None and k(None, "java") is None and k("", "java") is None
    for notice in ("// Code generated by xgen 1.2. DO NOT EDIT.", "// @generated by y", "/* <auto-generated> z </auto-generated> */", "// Generated on 2025-01-01 by q", "// AUTOGENERATED from a.schema - run `q build`"):
        assert k(notice + "\n" + own, "javascript") == "generated", notice
    for decoy in ("// Ids are generated by the permit sequence, never by callers.", "// NOTE: do not edit rows in place, append instead.", "// The auto-generated number is checked here.", "// vendor rows arrive minified", "// Copyright 2025 the team, internal use."):
        assert k(decoy + "\n" + own, "javascript") is None, decoy
    assert k("/*! lib v3.8.3 | (c) the lib authors | released under the notice below */\n" + own, "javascript") == "vendored"
    assert k(own + "\nconst s = '@generated by y';", "javascript") is None
    assert k("export const A = [" + ", ".join(f"[{i}.25, -{i}.5]" for i in range(60)) + "];", "typescript") == "data"
    assert k("export const A = ['a', 'b', 'c'];", "typescript") is None
    assert k("!function(e,t){" + "".join(f"function a{i}(b,c){{return b.x>c?b:c}}var d{i}=function(e){{if(!e)return null;e.y=!0;return e}};" for i in range(20)) + "}(this,0);", "javascript") == "minified"
    assert k("\n".join(f"export function getF{i}(m) {{ return m.f{i}; }}\nexport const F{i}_NUMBER = {i};" for i in range(12)), "javascript") == "generated"


def test_fingerprints_local():
    t = hand(3)
    assert np.intersect1d(evidence.fingerprints(t), evidence.fingerprints("x y z\n" + t + "\n more words here")).size == evidence.fingerprints(t).size
    assert evidence.fingerprints(None).size == evidence.fingerprints("a b").size == 0


def test_handwritten(spark):
    lib = hand(99)
    data = [(i, f"P{i % 3}", f"s{i}", f"s{i}/x{i}.js", "javascript", hand(i), 1, "x") for i in range(12)]
    data += [(100, "P0", "s0", "s0/a/lib.js", "javascript", lib, 1, "x"), (101, "P1", "s1", "s1/q.js", "javascript", lib.replace("import", "// local\nimport"), 1, "x"), (102, "P2", "s2", "s2/r.js", "javascript", None, 1, "x"), (100, "P0", "s0", "s0/a/lib.js", "javascript", lib, 1, "x")]
    own = hand(500)
    data += [(110, "P0", "s0", "s0/m.js", "javascript", own, 1, "x"), (111, "P0", "s9", "s9/m.js", "javascript", own, 1, "x")]  # two checkouts of one project
    data += [(200, "P1", "s1", "s1/.gitattributes", None, "gen/** linguist-generated\n*.v.js linguist-vendored\nq.js -linguist-vendored\n", 1, "x"), (201, "P1", "s1", "s1/gen/.gitattributes", None, "keep.js -linguist-generated\n", 1, "x"), (202, "P1", "s1", "s1/gen/a/b.js", "javascript", hand(600), 1, "x"), (203, "P1", "s1", "s1/gen/keep.js", "javascript", hand(601), 1, "x"), (204, "P1", "s1", "s1/k.v.js", "javascript", hand(602), 1, "x")]
    df = spark.createDataFrame(data, FILES)
    assert rows(handwritten.found(df, Scratch(spark, "t"))) == {(100, "vendored"), (201, "generated"), (202, "generated"), (204, "vendored")}
    assert handwritten.found(df.limit(0), Scratch(spark, "t")).count() == 0


def test_mined_notices(spark):
    """What declared files say in their notice is carried over to sources that declare nothing, whatever the words."""
    note = "// Emitted for {} through wireweaver stage {}, schema {}.xyz\n"
    f = lambda i, p, path, text: (i, p, f"s{p}", f"s{p}/{path}", None, text, 1, "x")
    data = [f(1000 + p, f"P{p}", ".gitattributes", f"out/* linguist-generated\nplain{p} text\n") for p in range(3)]
    data += [f(10 * p + k, f"P{p}", f"out/f{k}.js", note.format("Kiosk", k, f"a/b{k}") + hand(100 + 10 * p + k)) for p in range(3) for k in range(3)]
    data += [f(500, "P9", "lib/q.js", note.format("Depot", 77, "c/d") + hand(500)), f(501, "P9", "lib/r.js", "// Emitted rows are kept for the audit.\n" + hand(501)), f(502, "P9", "lib/s.js", hand(502) + note.format("Depot", 7, "c/d"))]
    df = spark.createDataFrame(data, FILES)
    got = rows(handwritten.found(df, Scratch(spark, "t")))
    assert got == {(10 * p + k, "generated") for p in range(3) for k in range(3)} | {(500, "generated")}
    assert {(r.source, r.files) for r in handwritten.shares(df, Scratch(spark, "t")).collect()} == {("declared", 9), ("notice", 1)}
    # one project alone confirms nothing
    assert {r.file_id for r in handwritten.found(df.filter("project_key in ('P0', 'P9')"), Scratch(spark, "t")).collect()} == {0, 1, 2}


def test_runs_of_declared_files(spark):
    """A copy of a declared file is one in its own project too, at any depth of attribute files."""
    f = lambda i, path, text: (i, "P", "s", f"s/{path}", None, text, 1, "x")
    data = [f(1, ".gitattributes", "*.gen.js linguist-vendored\na/** linguist-vendored"), f(2, "a/.gitattributes", "b/* -linguist-vendored"), f(3, "a/b/.gitattributes", "c.js linguist-vendored"), f(4, "a/x.js", hand(1)), f(5, "a/b/d.js", hand(2)), f(6, "a/b/c.js", hand(3)), f(7, "z/copy.js", "// ours\n" + hand(1)), f(8, "z/w.gen.js", hand(4)), f(9, "z/own.js", hand(5))]
    assert {r.file_id for r in handwritten.found(spark.createDataFrame(data, FILES), Scratch(spark, "t")).collect()} - {2, 3} == {4, 6, 7, 8}


def test_copies_of_any_size(spark):
    small = "package a.b;\nclass Grid {\n" + "\n".join(f"  int {x} = {i};" for i, x in enumerate(["top", "left", "width", "height", "rows", "columns", "gap", "margin", "border", "shade", "depth"])) + "\n}\n"
    assert 0 < evidence.fingerprints(small).size < 8 and evidence.fingerprints("var pad = (s, n) => s.padStart(n);").size == 0
    data = [(i, f"P{i % 2}", f"s{i}", f"s{i}/g{i}.java", "java", ("// local\n" if i else "") + small, 1, "x") for i in range(2)]
    data += [(10 + i, f"P{i}", f"s{i}", f"s{i}/pad.js", "javascript", "var pad = (s, n) => s.padStart(n);" + " " * i, 1, "x") for i in range(2)]
    data += [(20 + i, f"P{i}", f"s{i}", f"s{i}/empty.js", "javascript", "/* intentionally empty */", 1, "x") for i in range(2)]  # no words
    data += [(30 + i, "P0", f"t{i}", f"t{i}/own.js", "javascript", "var own = (a, b) => a.join(b);", 1, "x") for i in range(2)]  # one project
    data += [(40 + i, f"P{i}", f"s{i}", f"s{i}/near.js", "javascript", f"export const size{'ab'[i]} = read();", 1, "x") for i in range(2)]
    assert rows(handwritten.found(spark.createDataFrame(data, FILES), Scratch(spark, "t"))) == {(i, "vendored") for i in (0, 1, 10, 11)}


@pytest.mark.parametrize("glob,path,ok", [("*.js", "a/b.js", True), ("*.js", "a.jsx", False), ("/a/*.js", "a/b.js", True), ("a/*.js", "x/a/b.js", False), ("**/gen/**", "x/gen/y/z", True), ("a?c", "q/abc", True), ("[ab].c", "b.c", True)])
def test_globs(glob, path, ok):
    import re

    assert bool(re.fullmatch(attributes.glob_regex(glob), path)) == ok


def test_packing_plan():
    rnd = random.Random(1)
    h = {}
    for _ in range(3000):
        s = min(2048, int(rnd.expovariate(1 / 300)) + 1)
        h[s] = h.get(s, 0) + 1
    plan = packing.fill_plan(h)
    used = {}
    for times, filling in plan:
        assert sum(s * n for s, n in filling) <= 2048 and times > 0
        for s, n in filling:
            used[s] = used.get(s, 0) + times * n
    assert used == h
    total, n = sum(s * k for s, k in h.items()), sum(t for t, _ in plan)
    assert n <= -(-total // 2048) + 2
    assert packing.fill_plan({}) == [] and packing.fill_plan({0: 5}) == []
    b = packing.length_buckets(h, 8)
    assert sum(x[2] for x in b) == 3000 and packing.batches(b) > n
    naive = packing.length_buckets(h, 1)[0][3]
    assert sum(x[3] for x in b) < naive


def test_buckets_are_least():
    h = {3: 5, 4: 1, 9: 2, 10: 7, 30: 1}
    best = min(sum(h[s] * (min(b for b in (x, y, 30) if b >= s) - s) for s in h) for x in h for y in h)
    assert sum(x[3] for x in packing.length_buckets(h, 3, 64)) == best


def test_containers(spark):
    data = [(i, "word " * (i % 40) if i % 9 else None, "s", 0, "") for i in range(300)] + [(1000, "long text " * 3000, "s", 0, ""), (7, "word " * 7, "s", 0, ""), (None, "x", "s", 0, "")]
    df = spark.createDataFrame(data, DOCS)
    out = packing.containers(packing.pieces(packing.sized(df)), Scratch(spark, "t")).collect()
    assert len({(r.doc_id, r.piece) for r in out}) == len(out) and {r.doc_id for r in out} == {*range(300), 1000}
    fill = {}
    for r in out:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
    sizes = {r.doc_id: r.tokens for r in packing.sized(df).collect()}
    assert all(sum(1 for r in out if r.doc_id == i) == max(1, -(-t // 2048)) for i, t in sizes.items())
    assert packing.containers(packing.pieces(packing.sized(df.limit(0))), Scratch(spark, "t")).count() == 0


def test_token_stretches(monkeypatch):
    text = "Some words, 12 numbers and CamelCase — über 中文 text.  Two  spaces\n\nand lines " * 60
    path = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"
    whole = len(packing.encoder(path).encode_ordinary(text))
    monkeypatch.setattr(packing, "STRETCH", 97)
    assert packing.tokens_in(text, path) == whole and packing.tokens_in("x" * 500, path) > 0 and packing.tokens_in(None, path) == 0


def test_pieces_are_the_text(spark):
    path = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"
    text = "Some words, 12 Größen and 中文 text with a ✓.\n" * 900
    df = spark.createDataFrame([(1, text, "s", 0, ""), (2, "short", "s", 0, ""), (1, "x", "s", 0, ""), (3, None, "s", 0, ""), (4, "ab" * 1500, "s", 0, "")], DOCS)
    got = sorted(packing.offsets(df).collect())
    raw = text.encode()
    assert b"".join(raw[r.from_byte : r.to_byte] for r in got) == raw and {r.doc_id for r in got} == {1}
    assert [(r.doc_id, r.piece, r.tokens) for r in got] == sorted((r.doc_id, r.piece, r.tokens) for r in packing.pieces(packing.sized(df)).filter("doc_id = 1").collect())
    assert got[0].tokens == 2048 and sum(r.tokens for r in got) == packing.tokens_in(text, path)
    assert packing.offsets(df.limit(0)).count() == 0


def test_budget_batches():
    h = {2000: 2, 100: 21, 50: 1}
    assert packing.budget_batches(h, [(0, 100, 22, 0), (100, 2048, 2, 0)]) == 2 + 2
    assert packing.budget_batches({}, []) == 0


def make_items(n=24):
    rnd = random.Random(5)
    name = lambda: rnd.choice(["Lead", "Cargo", "Dock", "Fleet", "Harbor"]) + rnd.choice("ABCDEFGH") + str(rnd.randrange(900))
    out = []
    for i in range(n):
        parts = ["Given the change set, list every component."]
        for _ in range(3):
            parts.append(f"During sprint {rnd.randrange(90)}, the crew replaced {name()} with {name()} after a complaint, leaving the {name()} table locked in {name()} until {rnd.randrange(28)} June.")
        out.append((i, " ".join([*parts, "What should the agent do next?"]), 0))
    return out


def test_leaks(spark):
    items = make_items()
    scen = [" ".join(t.split(". ")[1:4]) for _, t, _ in items]
    half = lambda i: " ".join(scen[i].split()[5:32])
    noisy = scen[2].split()
    noisy[7], noisy[30] = "xxx", "yyy"
    del noisy[18]
    docs = [
        (1, f"Intro. {items[0][1]} End.", "s", 0, ""), (2, f"<p>{half(1).upper()}</p>", "s", 0, ""), (3, " ".join(noisy), "s", 0, ""),
        (4, " ".join(scen[3].split()[4:14]), "s", 0, ""), (5, "Given the change set, list every component. What should the agent do next?", "s", 0, ""),
        (6, "During sprint 91, the crew replaced DockZ1 with DockZ2 after a complaint, leaving the DockZ3 table locked in DockZ4 until 30 June. " * 2, "s", 0, ""),
        (7, '{"t": "' + scen[4].replace(". ", ".\\n") + '"}', "s", 0, ""), (8, None, "s", 0, ""), (9, "", "s", 0, ""), (10, "filler words here " * 400 + half(5) + " tail words" * 400, "s", 0, ""), (1, f"Intro. {items[0][1]} End.", "s", 0, ""),
        (11, scen[6].replace("complaint", "com-\nplaint").replace(" the ", "\n> the "), "s", 0, ""),
    ]
    got = rows(leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items + [(None, "x", 0), (99, None, 0)], ITEMS), Scratch(spark, "t")))
    assert got == {(1, 0), (2, 1), (3, 2), (7, 4), (10, 5), (11, 6)}
    assert leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS), Scratch(spark, "t")).count() == 0
    assert leakage.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS), Scratch(spark, "t")).count() == 0


def test_leaks_with_a_full_filter(spark, data, monkeypatch):
    """However small the filter, its errors fall out of the join."""
    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    a = rows(leakage.leaks(docs, items, Scratch(spark, "t")))
    monkeypatch.setattr(leakage, "MOST_BITS", 1024)
    assert rows(leakage.leaks(docs, items, Scratch(spark, "t"))) == a


def test_leaks_of_equal_items(spark):
    """Two ids of one text, and two items of one scenario under other instructions, are all named."""
    items = make_items()
    text = items[0][1]
    other = (51, text.replace("Given the change set, list every component.", "Read the request and pick one."), 0)
    fill = [(60 + i, items[10 + i][1].replace("Given the change set, list every component.", "Read the request and pick one."), 0) for i in range(5)]
    docs = [(1, " ".join(text.split(". ")[1:4]), "s", 0, "")]
    assert rows(leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (50, text, 0)], ITEMS), Scratch(spark, "t"))) == {(1, 0), (1, 50)}
    few = [items[0], other, *items[1:9], *fill]
    assert rows(leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(few, ITEMS), Scratch(spark, "t"))) == {(1, 0), (1, 51)}


def test_leaks_in_other_scripts(spark):
    rnd = random.Random(3)
    han = lambda: "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(3))
    zh = lambda: f"在第{rnd.randrange(90)}次迭代中，{han()}组用{han()}模块替换了旧的{han()}表，因此{han()}任务必须在{han()}之前重新运行。"
    name = lambda: "".join(rnd.choice(["grün", "weiß", "süd", "öst", "mühl", "fähr", "käu", "stra"]) for _ in range(3))
    de = lambda: f"Während des Laufs {rnd.randrange(90)} prüfte die Gruppe {name()} alle {rnd.randrange(500)} Verträge der Straße {name()} und löschte danach die größte Übersicht für {name()} {rnd.randrange(900)}."
    items = [(i, "请列出所有受影响的组件。" + zh() + zh() + "接下来应该做什么？", 0) for i in range(10)] + [(100 + i, "Nenne alle Teile. " + de() + " " + de() + " Was nun?", 0) for i in range(10)]
    docs = [(1, "说明：" + items[3][1][12:-9] + "完。", "s", 0, ""), (2, "Hinweis. " + items[14][1].replace("Nenne alle Teile. ", "").upper(), "s", 0, ""), (3, zh() + zh(), "s", 0, ""), (4, de() + de(), "s", 0, "")]
    assert leakage.words_of("Größe für 中文") == ["grösse", "für", "中", "文"]
    assert rows(leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), Scratch(spark, "t"))) == {(1, 3), (2, 104)}


def test_short_altered_passages(spark):
    items = make_items()
    scen = [" ".join(t.split(". ")[1:4]).split() for _, t, _ in items]
    one, two, less = scen[1][2:22], scen[2][2:25], scen[3][2:20]
    one[9], two[6], two[15] = "xxx", "yyy", "zzz"
    docs = [(1, " ".join(one), "s", 0, ""), (2, "x " * 5000 + " ".join(two) + " y" * 5000, "s", 0, ""), (3, " ".join(less), "s", 0, "")]
    assert rows(leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), Scratch(spark, "t"))) == {(1, 1), (2, 2)}


def test_passages_in_long_stretches():
    item = [f"w{i % 37}" for i in range(90)]
    doc = [f"v{i % 11}" for i in range(20_000)]
    doc[15_000:15_040] = item[20:60]
    assert leakage._passage_in(item, doc) == (40, 40, 1.0)


def test_endings():
    e = endings.ending
    for done in ("All is well.", "Is it?", "完成了。", 'He said "no."', "x\n```\nf()\n```", None, "", "   "):
        assert e(done) is None, done
    for cut in ("half �", "see (a and", "x\n```\nf(", "one, two,", "the dry-"):
        assert e(cut)["sure"], cut
    assert e("same c…")["marked"] and e("a lot [truncated]")["marked"] and not e("no stop here")["sure"]


def test_cuts_held_out(spark, data):
    """Texts that end well, half of them cut at a random place: most cuts are found, hardly any other."""
    rnd = random.Random(4)
    base = [r for r in table(spark, "/root/testdata/sf0.01", "documents").collect() if endings.ending(r.text) is None and len(r.text) > 80]
    docs = [(r.doc_id, r.text[: rnd.randrange(40, len(r.text) - 2)] if r.doc_id % 2 else r.text, r.source, 0, "") for r in base]
    got = {r.doc_id for r in truncation.cut_texts(spark.createDataFrame(docs, DOCS), Scratch(spark, "t")).collect()}
    cut = {d[0] for d in docs if d[0] % 2}
    assert len(got & cut) >= 0.8 * len(cut) and len(got - cut) <= 0.01 * len(docs)


def test_cuts_of_a_repeated_corpus(spark):
    """The same corpus delivered ten times: the same texts are cut, for the same reasons."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    one = rows(truncation.cut_texts(docs, Scratch(spark, "t")).select("doc_id", "reason"))
    times = docs.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).selectExpr("doc_id * 10 + copy as doc_id", "text", "source")
    assert one and rows(truncation.cut_texts(times, Scratch(spark, "t")).select("doc_id", "reason")) == {(10 * i + k, r) for i, r in one for k in range(10)}


def test_closing_lines_and_blobs(spark):
    """What many texts end with is an ending, though it goes on elsewhere; long runs of characters are no words."""
    names = ["oak", "beech", "hawthorn", "elder", "yew", "sycamoretree"]
    docs = [(i, f"The {a} index was built by {b}. It stays with {a}.\n[...]\n{a} stays", "w", 0, "") for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    docs += [(100 + i, f"The {a} index stays with {b} until the {b} run ends.", "w", 0, "") for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    docs += [(200, "The oak index was built by elder. It stays with", "w", 0, ""), (201, "blob " + "Ab9" * 400_000, "w", 0, ""), (202, "a.b-" * 50_000, "w", 0, ""), (203, "it is " + "x" * 3000, "w", 0, "")]
    got = {r.doc_id for r in truncation.cut_texts(spark.createDataFrame(docs, DOCS), Scratch(spark, "t")).collect()}
    assert 200 in got and not got & set(range(200))


def test_context_keys_agree():
    text = "We moved the roster.\n\nSee core/a.py and core/lib or 3 more"
    (keys, ends, goes, _), words = endings.counts([text, text], [5, 5 + 64])
    seen = dict(zip(keys.tolist(), zip(ends.tolist(), goes.tolist())))
    assert seen[endings.key(("moved", "the", "roster"))] == (2, 0) and seen[endings.key(("we", "moved"))] == (0, 2) and seen[endings.key(("\u0001P", "and", "\u0001Q"))] == (0, 2)
    assert endings.key(("3", "more")) not in seen and words["roster"] == [2, 1 << 5] and "more" not in words
    assert endings.counts([], [])[1] == {} and len(endings.counts(["x"], [1])[0][0]) == 0


def test_cut_edges(spark):
    docs = [(1, None, "a", 0, ""), (2, "", None, 0, ""), (3, "it was (never", None, 0, ""), (3, "it was (never", None, 0, ""), (4, "done.", "a", 0, "")]
    df = spark.createDataFrame(docs, DOCS)
    found = truncation.cut_texts(df, Scratch(spark, "t"))
    assert [(r.doc_id, r.source) for r in found.collect()] == [(3, "")]
    assert rows(truncation.rates(df, found)) == {("", 2, 1, 0.5), ("a", 1, 0, 0.0)}
    assert truncation.cut_texts(df.limit(0), Scratch(spark, "t")).count() == 0
