"""Repository attribute files: which paths they declare generated or vendored.

The format is that of git: lines of a glob and attributes, one file a
directory, the deepest directory's last matching line decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.normal import clean_path

# The attributes read, and what they say of a path.
MEANING = {"linguist-generated": "generated", "linguist-vendored": "vendored"}


def glob_regex(glob: str) -> str:
    """A regular expression for paths relative to the attribute file's directory."""
    anchored = "/" in glob.rstrip("/")
    g = glob.strip("/") if glob.endswith("/") else glob.lstrip("/")
    out, i = "", 0
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if g.startswith("/**", i) and i + 3 == len(g):
            out, i = out + "/.*", i + 3
            continue
        if c == "*":
            while i + 1 < len(g) and g[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = g.find("]", i + 2)
            if j < 0:
                out += r"\["
            else:
                body = g[i + 1 : j]
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
                i = j
        elif c == "\\" and i + 1 < len(g):
            i += 1
            out += re.escape(g[i])
        else:
            out += re.escape(c)
        i += 1
    return ("" if anchored else "(?:.*/)?") + out


def parse(text: str | None) -> list[tuple[int, str, str, bool | None]]:
    """(line, regex, meaning, value) of the lines; value None takes a mark back."""
    out = []
    for k, line in enumerate((text or "").splitlines()):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            if name in MEANING:
                on = None if a.startswith("!") else not a.startswith("-") and value.lower() not in ("false", "0")
                out.append((k, glob_regex(parts[0]), MEANING[name], on))
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(s, d, *r) for s, d, t in zip(b.source_id, b.dir, b.content) for r in parse(t)]
        if rows:
            yield pd.DataFrame(rows, columns=["source_id", "dir", "line", "regex", "meaning", "value"])


def _matching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        hit = [bool(re.fullmatch(r, p)) for r, p in zip(b.regex, b.rel)]
        if any(hit):
            yield b[hit][["file_id", "meaning", "dir", "line", "value"]]


def declared(files: DataFrame) -> DataFrame:
    """(file_id, meaning, value) that attribute files among ``files`` declare.

    A source without attribute files costs nothing: only paths of sources that
    have one are expanded to their directories and matched.  Without any the
    result is empty.
    """
    path = clean_path(F.col("file_path"))
    dir_of = F.regexp_replace(path, "(^|/)[^/]*$", "")
    marks = files.filter(path.rlike(r"(^|/)\.gitattributes$")).select("source_id", dir_of.alias("dir"), "content")
    rules = marks.mapInPandas(_rules, "source_id string, dir string, line int, regex string, meaning string, value boolean")
    paths = files.join(rules.select("source_id").distinct(), "source_id", "left_semi").select("file_id", "source_id", path.alias("path"))
    up = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(up) - 1), lambda i: F.array_join(F.slice(up, F.lit(1), i), "/"))
    at = paths.select("file_id", "source_id", "path", F.explode(dirs).alias("dir"))
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    hits = at.join(rules, ["source_id", "dir"]).select("file_id", "dir", rel.alias("rel"), "line", "regex", "meaning", "value").mapInPandas(_matching, "file_id long, meaning string, dir string, line int, value boolean")
    best = F.row_number().over(Window.partitionBy("file_id", "meaning").orderBy(F.length("dir").desc(), F.col("line").desc()))
    return hits.withColumn("_n", best).filter("_n = 1 and value is not null").select("file_id", "meaning", "value")
