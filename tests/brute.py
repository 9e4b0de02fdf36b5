"""Plain Python versions of the general problems, to hold the operators against."""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd


def read(path: str) -> list[dict]:
    import pyarrow.dataset as ds

    return ds.dataset(path).to_table().to_pylist()


def ref_of(v):
    v = (v or "").strip().lower()
    return None if not v or set(v) == {"0"} else v


def commit_parents(commits):
    best = {}
    for r in commits:
        if r["sha"] is None:
            continue
        k = (r["recorded_at"] is not None, r["recorded_at"], ref_of(r["parent_sha"]) or "")
        if r["sha"] not in best or k > best[r["sha"]][0]:
            best[r["sha"]] = (k, r)
    source = {s: r["source_id"] for s, (_, r) in best.items()}
    by = defaultdict(list)
    for s, src in source.items():
        by[src, s.strip().lower()[:10]].append(s)

    def resolve(ref, src):
        if ref is None:
            return None
        hits = [s for s in by.get((src, ref[:10]), []) if (s.strip().lower().startswith(ref) and len(ref) >= 10 if len(ref) < 40 else s.strip().lower() == ref)]
        return min(hits) if hits else None

    parent = {s: resolve(ref_of(r["parent_sha"]), source[s]) for s, (_, r) in best.items()}
    return parent, source, resolve


def tree(parent):
    """id -> (root, depth, on_cycle)"""
    out = {}
    for n in parent:
        path, seen, x = [], {}, n
        while x is not None and x not in seen and x not in out:
            seen[x] = len(path)
            path.append(x)
            x = parent[x]
        if x is not None and x in seen:
            for i, y in enumerate(path):
                out[y] = ("", -1, int(i >= seen[x]))
        else:
            base = (None, -1, 0) if x is None else out[x]
            for y in reversed(path):
                base = ("", -1, 0) if base[0] == "" else (base[0] or y, base[1] + 1, 0)
                out[y] = base
    return out


def p2(runs, commits):
    parent, _, resolve = commit_parents(commits)
    best = {}
    for r in runs:
        if r["run_id"] not in best or r["updated_at"] > best[r["run_id"]]["updated_at"]:
            best[r["run_id"]] = r
    done = [r for r in best.values() if (r["status"] or "").strip().upper() == "COMPLETED"]
    reach = {}
    for r in done:
        h, s = resolve(ref_of(r["head_after"]), r["source_id"]), set()
        while h is not None and h not in s:
            s.add(h)
            h = parent[h]
        reach[r["run_id"]] = s
    first = {}
    for r in done:
        for c in reach[r["run_id"]]:
            first[c] = min(first.get(c, r["finished_at"]), r["finished_at"])
    return {(r["run_id"], c) for r in done for c in reach[r["run_id"]] if first[c] == r["finished_at"]}


def canon(text):
    def drop(v):
        if isinstance(v, dict):
            return {k: drop(x) for k, x in sorted(v.items()) if x is not None}
        return [drop(x) for x in v] if isinstance(v, list) else v

    if text is None:
        return "{}"
    try:
        return json.dumps(drop(json.loads(text)), sort_keys=True)
    except ValueError:
        return "text:" + text.strip()


def p3(snapshots, rows):
    ents, files = defaultdict(dict), defaultdict(set)
    for r in rows:
        if r["entity_key"] is None:
            continue
        k = r["entity_key"].replace("\\", "/")
        ents[r["snapshot_id"]][k] = (r["name"], r["status"] and r["status"].strip().lower(), r["signature"] and re.sub(r"\s+", "", r["signature"]), canon(r["metadata"]))
        if r["entity_type"] == "FILE":
            files[r["snapshot_id"]].add(k)
    by = defaultdict(set)
    for s in snapshots:
        if len(files[s["snapshot_id"]]) == s["file_count"]:
            by[s["source_id"]].add((s["created_at"], s["snapshot_id"]))
    out = set()
    for v in by.values():
        v = sorted(v)
        for (_, a), (_, b) in zip(v, v[1:]):
            x, y = ents[a], ents[b]
            out |= {(b, k, "added") for k in y.keys() - x.keys()} | {(b, k, "removed") for k in x.keys() - y.keys()} | {(b, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]}
    return out


def p4(changes):
    by = defaultdict(dict)
    for r in changes:
        if r["entity_key"] is None or r["authored_at"] is None:
            continue
        at = pd.Timestamp(r["authored_at"]).value // 1000
        old = by[r["entity_key"]].get(at)
        if old is None or r["change_id"] > old["change_id"]:
            by[r["entity_key"]][at] = r
    out = set()
    for key, rows in by.items():
        last, opened = [None] * 3, None
        for at in sorted(rows):
            r = rows[at]
            if (r["change_type"] or "").strip().upper() == "DELETED":
                if opened is not None:
                    out.add((key, opened[0], at))
                opened = None
                continue
            new = [r["status"] and r["status"].strip().lower(), r["signature"] if r["signature"] is None else re.sub(r"\s+", "", r["signature"]), r["file_rel_path"] and r["file_rel_path"].replace("\\", "/")]
            last = [a if a is not None else b for a, b in zip(new, last)]
            if opened is None or opened[1] != last:
                if opened is not None:
                    out.add((key, opened[0], at))
                opened = (at, last)
        if opened is not None:
            out.add((key, opened[0], -1))
    return out


def clean(p):
    p = re.sub("/{2,}", "/", p.replace("\\", "/"))
    return re.sub("/$", "", re.sub(r"^(\./)+", "", p))


def p5(commits, entities):
    parent, _, _ = commit_parents(commits)
    out = {("commit", k, *v) for k, v in tree(parent).items()}
    best = {}
    for r in entities:
        if r["entity_key"] not in best or r["updated_at"] > best[r["entity_key"]]["updated_at"]:
            best[r["entity_key"]] = r
    best = {k: (r["project_key"], clean(r["path"]), r["entity_type"]) for k, r in best.items() if r["path"] is not None and r["entity_type"] in ("FILE", "DIRECTORY")}
    dirs = {}
    for k, (pk, p, t) in sorted(best.items(), reverse=True):
        if t == "DIRECTORY":
            dirs[pk, p] = k
    parent = {k: dirs.get((pk, p.rsplit("/", 1)[0])) if "/" in p else None for k, (pk, p, t) in best.items()}
    return out | {("entity", k, *v) for k, v in tree(parent).items()}
