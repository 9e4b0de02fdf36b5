"""The general problems against plain Python, and their edge cases."""

import datetime as dt
import random

import brute
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.operators import history, intervals, snapshot_diff
from loamgraph.operators.ancestry import ancestry, descendants
from loamgraph.operators.hierarchy import closure, forest, levels
from loamgraph.operators.newcommits import CommitLedger, new_commits
from loamgraph.plans import problems
from loamgraph.sources.tables import Scratch, table

T0 = dt.datetime(2025, 1, 1)
COMMITS = "sha string, parent_sha string, source_id string, recorded_at timestamp, extra string"
RUNS = "run_id string, source_id string, status string, finished_at timestamp, head_after string, updated_at timestamp, id int"
CHANGES = "change_id long, entity_key string, change_type string, status string, signature string, file_rel_path string, authored_at timestamp, h string"
SNAPS = "snapshot_id string, source_id string, file_count int, created_at timestamp, row_hash int"
ENTS = "snapshot_id string, entity_key string, name string, entity_type string, signature string, status string, metadata string, is_file int"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def dicts(data, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return [dict(zip(names, r)) for r in data]


@pytest.mark.parametrize("name,want", [("p2_found", lambda r: brute.p2(r("ingestion_runs"), r("commits"))), ("p3_found", lambda r: brute.p3(r("project_snapshots"), r("snapshot_entities"))), ("p4_found", lambda r: brute.p4(r("entity_changes"))), ("p5_found", lambda r: brute.p5(r("commits"), r("entities")))])
def test_whole_tables(spark, data, name, want):
    got = problems.QUERIES[name](spark, data).collect()
    found = {tuple(r) for r in got}
    assert len(found) == len(got)
    assert found == want(lambda t: brute.read(f"{data}/{t}.parquet"))


def random_history(seed, n=60):
    rnd = random.Random(seed)
    ids = [f"{rnd.getrandbits(160):040x}" for _ in range(n)]
    commits = []
    for i, s in enumerate(ids):
        p = rnd.choice(ids[max(0, i - 4) : i] or [None])
        if p and rnd.random() < 0.1:
            p = rnd.choice([p[:10], p[:14], p.upper(), f" {p}\n"])
        if rnd.random() < 0.05:
            p = rnd.choice([None, "", "0" * 40, "f" * 40])
        commits.append((s, p, "a", at(i), "x"))
    for i in (5, 20):  # two cycles
        commits[i] = (ids[i], ids[i + 7], "a", at(500), None)
    commits += [(ids[3], ids[1], "a", at(-5), None), commits[9], (None, ids[0], "a", at(1), None)]
    runs = [(f"r{k}", "a", rnd.choice(["COMPLETED", " completed ", "FAILED", None]), at(rnd.randrange(12)), rnd.choice([rnd.choice(ids), rnd.choice(ids)[:12], None, "e" * 40]), at(k), 1) for k in range(25)]
    runs += [(runs[0][0], "a", "FAILED", None, None, at(-9), 1), runs[3]]
    return commits, runs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_new_commits_random(spark, seed):
    commits, runs = random_history(seed)
    got = rows(new_commits(spark.createDataFrame(runs, RUNS), spark.createDataFrame(commits, COMMITS), Scratch(spark, "t").folder(), hot_rows=2))
    runs_d, commits_d = dicts(runs, RUNS), dicts(commits, COMMITS)
    assert got == brute.p2(runs_d, commits_d)


def test_empty_tables(spark):
    commits, runs = spark.createDataFrame([], COMMITS), spark.createDataFrame([], RUNS)
    assert new_commits(runs, commits, Scratch(spark, "t").folder()).count() == 0
    assert snapshot_diff.diff(spark.createDataFrame([], SNAPS), spark.createDataFrame([], ENTS)).count() == 0
    assert history.versions(spark.createDataFrame([], CHANGES)).count() == 0
    assert forest(spark.createDataFrame([], "id string, parent string"), Scratch(spark, "t")).count() == 0
    a, b = closure(spark.createDataFrame([], "id string, parent string, label string"), Scratch(spark, "t"))
    assert a.count() == b.count() == 0


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_history_random(spark, hot_rows):
    rnd = random.Random(7)
    data = []
    for i in range(400):
        key = rnd.choice(["hot"] * 6 + ["b", "c", None])
        data.append((i if rnd.random() < 0.97 else None, key, rnd.choice(["ADDED", "modified", "DELETED", "deleted ", None]), rnd.choice(["ACTIVE", "active", "OLD", None]), rnd.choice(["f( a )", "f(a)", "g()", None]), rnd.choice(["a/b", "a\\b", None, ""]), at(rnd.randrange(90)) if rnd.random() < 0.97 else None, "x"))
    data += data[:20]
    clean = [r for r in dicts(data, CHANGES) if r["entity_key"] is not None and r["authored_at"] is not None]
    for r in clean:
        r["change_id"] = -1 if r["change_id"] is None else r["change_id"]
    # rows that tie without an id have no order: keep one of each
    seen, kept = set(), []
    for r in clean:
        k = (r["entity_key"], r["authored_at"], r["change_id"])
        if r["change_id"] != -1 or k not in seen:
            kept.append(r)
        seen.add(k)
    names = [c.split()[0] for c in CHANGES.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in kept], CHANGES)
    got = rows(history.versions(df, hot_rows=hot_rows, splits=5).select("entity_key", "valid_from_us", "valid_to_us"))
    assert got == brute.p4(kept)


def test_snapshot_diff_cases(spark):
    snaps = [("s1", "a", 2, at(0), 0), ("s2", "a", 3, at(1), 0), ("s3", "a", 2, at(2), 0), ("s3", "a", 2, at(2), 0), ("s4", None, 0, at(0), 0), (None, "a", 1, at(5), 0)]
    e = lambda s, k, t="FILE", n="n", m="{}", st="ACTIVE", g=None: (s, k, n, t, g, st, m, 1)
    ents = [
        e("s1", "F:a"), e("s1", "F:b", m='{"x": 1, "y": null}'), e("s1", "S:c", "CLASS", g="f( a )"), e("s1", "S:d", "CLASS"),
        e("s2", "F:a"),  # partial: one of three files
        e("s3", "F:a", m='{"k": 2}'), e("s3", "F:b", m='{ "x":1 }', st="active"), e("s3", "S:c", "CLASS", g="f(a)", m=None), e("s3", "S:e", "CLASS"), e("s3", "F:a", m='{"k":2}'), e("s3", None), e(None, "F:z"),
    ]
    got = rows(snapshot_diff.diff(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(ents, ENTS)))
    assert got == {("s3", "F:a", "changed"), ("s3", "S:d", "removed"), ("s3", "S:e", "added")}


def test_forest_and_closure(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "z"), ("z", "y"), ("q", "q"), ("w", "x")]
    n = spark.createDataFrame(links, "id string, parent string")
    got = {r.id: (r.root_id, r.node_depth, r.on_cycle) for r in forest(n, Scratch(spark, "t")).collect()}
    assert got == brute.tree(dict(links)) == {r.id: (r.root_id, r.node_depth, r.on_cycle) for r in levels(n, Scratch(spark, "t")).collect()}
    assert levels(n.limit(0), Scratch(spark, "t")).count() == 0
    sizes = {r.id: r.size for r in forest(n, Scratch(spark, "t"), sizes=True).collect() if r.node_depth >= 0}
    assert sizes == {"a": 4, "b": 2, "c": 1, "d": 1}
    p, pairs = closure(n.selectExpr("id", "parent", "id as label"), Scratch(spark, "t"))
    assert {r.id: r.full_path for r in p.collect()} == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/d", "x": None, "y": None, "z": None, "q": None, "w": None}
    assert rows(pairs) == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("a", "d", 1)}


@pytest.mark.parametrize("seed", [4, 5])
def test_commit_trees(spark, seed):
    commits, _ = random_history(seed)
    parent, _, _ = brute.commit_parents(dicts(commits, COMMITS))
    nodes = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r.id: r for r in ancestry(nodes, Scratch(spark, "t")).collect()}
    tree = brute.tree(parent)
    assert {k: (r.root_id, r.node_depth) for k, r in got.items()} == {k: v[:2] for k, v in tree.items()}
    members = {(r.chain, r.seq): k for k, r in got.items()}
    below = set()
    for k, (_, depth, _) in tree.items():
        if depth < 0:
            assert got[k].path is None and got[k].first is None and got[k].last is None
            continue
        up = [k]
        while parent[up[-1]] is not None:
            up.append(parent[up[-1]])
        assert [members[c, i] for c, n in got[k].path for i in range(n + 1)] == up[::-1]
        below |= {(a, k, i) for i, a in enumerate(up) if i}
    whole = [r for r in got.values() if r.node_depth >= 0]
    assert {(a.id, b.id, b.node_depth - a.node_depth) for a in whole for b in whole if a.root_id == b.root_id and a.first < b.first <= a.last} == below
    trees = Scratch(spark, "t").cut(ancestry(nodes, Scratch(spark, "t")))
    assert rows(descendants(trees, nodes)) == below
    assert ancestry(nodes.limit(0), Scratch(spark, "t")).count() == 0


def test_deep_chain(spark):
    n = 3000
    df = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)], "id string, parent string")
    assert forest(df, Scratch(spark, "t")).filter("root_id = '0' and node_depth = cast(id as long)").count() == n


def test_closure_of_deep_chain(spark):
    n = 1003
    df = spark.createDataFrame([(str(i), str(i - 1) if i else None, "d") for i in range(n)], "id string, parent string, label string")
    paths, pairs = closure(df, Scratch(spark, "t"))
    assert paths.filter("root_id = '0' and node_depth = cast(id as long) and length(full_path) = 2 * node_depth + 1").count() == n
    assert pairs.filter("cast(id as long) - cast(ancestor_id as long) = distance").distinct().count() == n * (n - 1) // 2


spans = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(-2, 8)), max_size=12)


@settings(max_examples=8, deadline=None)
@given(a=spans, b=spans)
def test_interval_algebra(spark, a, b):
    mk = lambda v: spark.createDataFrame([(s, lo, lo + k) for s, lo, k in v], "stream string, lo long, hi long")
    points = lambda v: {(s, x) for s, lo, hi in v for x in range(lo, hi + 1)}
    want = points([(s, lo, lo + k) for s, lo, k in a]) - points([(s, lo, lo + k) for s, lo, k in b])
    gaps = rows(intervals.subtract(mk(a), mk(b)))
    assert points(gaps) == want and sum(hi - lo + 1 for _, lo, hi in gaps) == len(want)
    merged = sorted(rows(intervals.merge(mk(a))))
    assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(merged, merged[1:]))


def test_ledger_survives_failures(spark, tmp_path):
    led = intervals.Ledger(spark, str(tmp_path / "ledger"))
    recs = lambda v: spark.createDataFrame([(s, n, f"{s}{n}") for s, n in v], "stream string, seq long, body string")

    def boom(df):
        raise RuntimeError("lost")

    first = [("a", 1), ("a", 2), ("b", 7), ("a", 2)]
    with pytest.raises(RuntimeError):
        led.run(recs(first), boom)
    assert led.latest() == 0 and led.output() is None
    assert led.run(recs(first)) == 2
    late = [*first, ("a", 9), ("a", 5), ("b", 3)]
    with pytest.raises(RuntimeError):
        led.run(recs(late), boom)
    led.run(recs(late))
    assert led.run(recs(late)) == 0
    assert sorted((r.stream, r.seq) for r in led.output().collect()) == [("a", 1), ("a", 2), ("a", 2), ("a", 5), ("a", 9), ("b", 3), ("b", 7)]
    assert rows(led.processed()) == {("a", 1, 2), ("a", 5, 5), ("a", 9, 9), ("b", 3, 3), ("b", 7, 7)}


def test_ledger_runs_at_once(spark, tmp_path):
    """A run that another one overtakes starts anew, and gives nothing twice."""
    recs = lambda v: spark.createDataFrame([("a", n) for n in v], "stream string, seq long")
    one, other = intervals.Ledger(spark, str(tmp_path / "l")), intervals.Ledger(spark, str(tmp_path / "l"))
    one.run(recs([1]))
    late = []

    def overtaken(df):
        if not late:
            late.append(other.run(recs([1, 2, 3])))
        return df

    assert one.run(recs([2, 3, 4]), overtaken) == 1 and late == [1]
    assert sorted(r.seq for r in one.output().collect()) == [1, 2, 3, 4] and one.latest() == 3
    assert rows(other.processed()) == {("a", 1, 4)}
    assert len(list((tmp_path / "l" / "output").glob("version=*"))) == 3


def test_numbers_and_hot_streams(spark):
    recs = spark.createDataFrame([("a", n) for n in [*range(0, 9000), 9005, 9005, 9006]] + [("b", 3)], "stream string, seq long")
    got = intervals.numbers(recs)
    assert got.count() == 5 and rows(intervals.merge(got)) == rows(intervals.merge(got, 2)) == {("a", 0, 8999), ("a", 9005, 9006), ("b", 3, 3)}
    odd = spark.createDataFrame([("a", 2 * n, 2 * n) for n in range(200)] + [("b", 1, 5)], "stream string, lo long, hi long")
    every = spark.createDataFrame([("a", 0, 399), ("b", 4, 9)], "stream string, lo long, hi long")
    want = {("a", 2 * n + 1, 2 * n + 1) for n in range(200)} | {("b", 6, 9)}
    assert rows(intervals.subtract(every, odd, 10)) == rows(intervals.subtract(every, odd)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_commit_ledger_in_deliveries(spark, tmp_path, seed):
    """Commits and runs in any order and pieces: nothing lost, nothing twice; in order it equals the whole."""
    commits, runs = random_history(seed)
    frame = lambda c, r: (spark.createDataFrame(r, RUNS), spark.createDataFrame(c, COMMITS))
    want = brute.p2(dicts(runs, RUNS), dicts(commits, COMMITS))
    whole = CommitLedger(spark, str(tmp_path / "whole"))
    whole.process(*frame(commits, runs))
    assert rows(whole.output()) == want
    rnd = random.Random(seed)
    mixed = CommitLedger(spark, str(tmp_path / "mixed"), hot_rows=5)
    shuffled = rnd.sample(commits, len(commits))
    for share in (0.5, 1):
        mixed.process(*frame(shuffled[: int(share * len(commits))], rnd.sample(runs, int(share * len(runs)))))
    got = [tuple(r) for r in mixed.output().collect()]
    assert {s for _, s in got} == {s for _, s in want}
    ended = {r["run_id"]: r["finished_at"] for r in dicts(runs, RUNS)}
    assert all(len({ended[r] for r, s in got if s == sha}) == 1 for sha in {s for _, s in got}) and len(set(got)) == len(got)
    mixed.process(*frame(commits, runs))
    assert sorted(tuple(r) for r in mixed.output().collect()) == sorted(got)


def test_commit_ledger_appends(spark, tmp_path):
    """A line of commits that grows is numbered at its end only, and each run gets what came since the last."""
    ids = [f"{i:040x}" for i in range(1, 60)]
    line = [(s, ids[i - 1] if i else None, "a", at(i), "x") for i, s in enumerate(ids)]
    side = [(f"{i:040x}", ids[10] if i == 900 else f"{i - 1:040x}", "a", at(i), "x") for i in range(900, 905)]
    led, runs, have = CommitLedger(spark, str(tmp_path / "l")), [], []
    for k, (upto, extra) in enumerate([(20, []), (35, side), (35, []), (59, [])]):
        have = line[:upto] + side * bool(extra or k > 1)
        runs.append((f"r{k}", "a", "COMPLETED", at(1000 + k), ids[upto - 1] if k != 2 else side[-1][0], at(1000 + k), 1))
        led.process(spark.createDataFrame(runs, RUNS), spark.createDataFrame(have, COMMITS))
        state = led.ledger.state()
        assert len(state.parts["nodes"]) == (1, 2, 2, 3)[k] and state.table("nodes", "id string").distinct().count() == len(have)
    got = rows(led.output())
    assert got == {("r0", s) for s in ids[:20]} | {("r1", s) for s in ids[20:35]} | {("r2", c[0]) for c in side} | {("r3", s) for s in ids[35:]}
    assert spark.read.parquet(led.ledger.state().parts["nodes"][1]).count() == 20
    assert led.ledger.processed().count() == 2


def test_commit_ledger_survives_failures(spark, tmp_path, monkeypatch):
    commits, runs = random_history(9, 30)
    frames = spark.createDataFrame(runs, RUNS), spark.createDataFrame(commits, COMMITS)
    led = CommitLedger(spark, str(tmp_path / "l"))
    monkeypatch.setattr(intervals.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        led.process(*frames)
    monkeypatch.undo()
    assert led.output().count() == 0
    led.process(*frames)
    assert rows(led.output()) == brute.p2(dicts(runs, RUNS), dicts(commits, COMMITS))


def test_shared_folder_on_a_cluster():
    from loamgraph.sources.tables import shared_dir

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d: {"spark.master": "spark://host:7077"}.get(k, d))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_extra_columns(spark, data):
    c = table(spark, data, "entity_changes")
    more = c.selectExpr("*", "1 as m", "2 as chunk", "'x' as hot", "3 as at", "4 as gone")
    a, b = history.versions(c), history.versions(more)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
