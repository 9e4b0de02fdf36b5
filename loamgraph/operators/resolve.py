"""Raw targets of relations resolved to files and symbols, by tiers of equi-joins.

Each tier is a join on its own key; the first tier that has an answer gives it.
Nothing is compared pair by pair: relative paths are folded, candidate names
and path suffixes are written out as rows and joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.normal import clean_path
from loamgraph.functions.scalars import symbol_key

# What a module's name may lack, in the order it is tried; roots that an alias stands for.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".vue", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue"]
ALIAS, ALIAS_ROOTS = "@/", ["src/", ""]


def file_index(files: DataFrame) -> DataFrame:
    """(file_id, source_id, project_key, path): the file that each path of a source means, the latest delivery.

    Ties, and files without a time, take the greater file_id.
    """
    one = files.filter("file_id is not null and file_path is not null")
    return one.groupBy("source_id", clean_path(F.col("file_path")).alias("path")).agg(F.max(F.struct("ingested_at", "file_id", "project_key")).alias("m")).select("m.file_id", "source_id", "m.project_key", "path")


def folded(path: Column) -> Column:
    """A path without . and .. segments; null if it leaves its root."""
    start = F.array().cast("array<string>")
    step = lambda acc, s: F.when(acc.isNull() | (s == "") | (s == "."), acc).when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def modules(imports: DataFrame, index: DataFrame, packages: DataFrame, types: DataFrame) -> DataFrame:
    """(file_id, target, tier, object): the file that each imported target means, targets without one left out.

    ``imports``: file_id, target of files in ``index``; ``packages``: file_id,
    name; ``types``: file_id, name of top-level types.  Tiers: PATH (relative or
    by alias, with the endings that a name may lack, in their order), FQN
    (package and type, in the same project), SUFFIX (the only file of the
    project whose path ends so).  A static or nested import means its type.
    """
    raw = imports.select("file_id", "target").distinct().join(index.select("file_id", "source_id", "project_key", F.col("path").alias("own")), "file_id")
    target = F.regexp_replace("target", r"\\", "/")
    directory = F.regexp_replace("own", "(^|/)[^/]*$", "")
    root = F.substring_index("own", "/", 1)
    written = F.when(target.rlike(r"^\.\.?(/|$)"), F.array(F.concat_ws("/", directory, target))).when(target.startswith(ALIAS), F.array(*[F.concat(root, F.lit("/" + r), F.expr(f"substring(target, {len(ALIAS) + 1})")) for r in ALIAS_ROOTS]))
    tried = raw.select("file_id", "target", "source_id", F.posexplode(written).alias("a", "p"), "own").select("file_id", "target", "source_id", "own", "a", folded(F.col("p")).alias("p"))
    tried = tried.select("file_id", "target", "source_id", "own", "a", "p", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("b", "ending")).withColumn("path", F.concat("p", "ending"))
    found = tried.join(index.select(F.col("source_id").alias("s"), "path", F.col("file_id").alias("object")), (F.col("source_id").eqNullSafe(F.col("s"))) & (tried.path == index.path) & (F.col("own") != tried.path)).select("file_id", "target", F.lit(1).alias("tier"), F.struct("a", "b", "object").alias("m"))

    named = types.join(packages.select("file_id", F.col("name").alias("package")), "file_id").join(index.select("file_id", "project_key"), "file_id")
    fqn = named.groupBy("project_key", F.concat_ws(".", "package", "name").alias("fqn")).agg(F.min("file_id").alias("object"))
    dotted = raw.filter(F.col("target").rlike(r"^[\w$]+(\.[\w$]+)+$"))
    parts = F.split("target", r"\.")
    ups = dotted.select("file_id", "target", "project_key", F.posexplode(F.array("target", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))).alias("a", "fqn"))
    full = ups.join(fqn.withColumnRenamed("project_key", "k"), F.col("project_key").eqNullSafe(F.col("k")) & (ups.fqn == fqn.fqn)).filter("object != file_id").select("file_id", "target", F.lit(2).alias("tier"), F.struct("a", F.lit(0).alias("b"), "object").alias("m"))

    # every suffix of two segments and more, once a file: as many rows as paths have segments
    segments = F.split(F.regexp_replace("path", r"\.[A-Za-z.]+$", ""), "/")
    tails = index.select("file_id", "project_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda i: F.array_join(F.slice(segments, i, 1000), "/"))).alias("tail")).filter(F.col("tail").contains("/"))
    only = tails.groupBy("project_key", "tail").agg(F.min("file_id").alias("object"), F.max("file_id").alias("last")).filter("object = last").drop("last")
    bare = raw.withColumn("tail", F.regexp_replace(F.regexp_replace(F.regexp_replace(target, r"^(?:\.{1,2}/)+|^@/", ""), r"\.(?:ts|tsx|js|jsx|vue)$", ""), r"\.(?=[\w$]+(?:\.|$))", "/"))
    suffix = bare.filter(F.col("tail").contains("/")).join(only.withColumnRenamed("project_key", "k").withColumnRenamed("tail", "t"), F.col("project_key").eqNullSafe(F.col("k")) & (F.col("tail") == F.col("t"))).filter("object != file_id").select("file_id", "target", F.lit(3).alias("tier"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), "object").alias("m"))
    best = found.unionByName(full).unionByName(suffix).groupBy("file_id", "target").agg(F.min(F.struct("tier", "m")).alias("x"))
    tiers = F.element_at(F.array(*map(F.lit, ["PATH", "FQN", "SUFFIX"])), F.col("x.tier"))
    return best.select("file_id", "target", tiers.alias("tier"), F.col("x.m.object").alias("object"))


def _first(*tiers: DataFrame) -> DataFrame:
    """Of (file_id, subject, predicate, target, object_file, object) the answer of the first tier, least object first."""
    every = None
    for n, (name, t) in enumerate(tiers):
        t = t.select("file_id", "subject", "predicate", "target", F.struct(F.lit(n).alias("n"), "object_file", "object", F.lit(name).alias("tier")).alias("x"))
        every = t if every is None else every.unionByName(t)
    return every.groupBy("file_id", "subject", "predicate", "target").agg(F.min("x").alias("x")).select("file_id", "subject", "predicate", "target", "x.tier", "x.object_file", "x.object")


def symbols_of(relations: DataFrame, rows: DataFrame, index: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file_id, subject, predicate, target, tier, object_file, object): the symbol each edge means, others left out.

    ``relations``: file_id, subject, predicate, target; ``rows`` as extracted;
    ``resolved``: modules.  EXTENDS, IMPLEMENTS and CREATES take types: by full
    name, in the same file, by an import, in the same package.  CALLS take
    functions and methods: in the same file (the subject's own type first), by
    an import.  A file's rows count only if it is the one its path means.
    """
    known = index.select("file_id", "project_key")
    symbols = rows.filter("row = 'symbol'").join(known, "file_id").select("file_id", "project_key", "kind", "name", "qualified", "owner")
    types = symbols.filter(F.col("kind").isin("CLASS", "INTERFACE", "ENUM", "TYPE", "ANNOTATION", "COMPONENT"))
    callables = symbols.filter(F.col("kind").isin("FUNCTION", "METHOD", "HOOK", "COMPONENT"))
    package = rows.filter("row = 'package'").groupBy("file_id").agg(F.min("name").alias("package"))
    edges = relations.join(known, "file_id").withColumn("last", F.regexp_extract("target", r"[^.]*$", 0)).withColumn("head", F.substring_index("target", ".", 1))
    heirs = edges.filter(F.col("predicate").isin("EXTENDS", "IMPLEMENTS", "CREATES"))
    calls = edges.filter("predicate = 'CALLS'").filter(~F.col("target").startswith("()"))
    out = ["file_id", "subject", "predicate", "target", "object_file", "object"]

    def pick(df: DataFrame) -> DataFrame:
        return df.select(*out)

    top = types.filter("owner = ''").join(package, "file_id")
    fqn = top.select(F.col("project_key").alias("k"), F.concat_ws(".", "package", "name").alias("full"), F.col("file_id").alias("object_file"), F.col("qualified").alias("object"))
    full = pick(heirs.filter(F.col("target").contains(".")).join(fqn, F.col("project_key").eqNullSafe(F.col("k")) & (F.col("target") == F.col("full"))))
    own = lambda e, s: pick(e.join(s.select("file_id", F.col("name").alias("last"), F.col("qualified").alias("object")), ["file_id", "last"]).withColumn("object_file", F.col("file_id")).filter("object != subject"))
    bound = rows.filter("row = 'import' and detail != ''").select("file_id", F.col("target").alias("module"), F.explode(F.split("detail", ",")).alias("head")).join(resolved.select("file_id", F.col("target").alias("module"), F.col("object").alias("object_file")), ["file_id", "module"]).select("file_id", "head", "object_file").distinct()

    def imported(e: DataFrame, s: DataFrame) -> DataFrame:
        there = s.select(F.col("file_id").alias("object_file"), F.col("name").alias("last"), F.col("qualified").alias("object"))
        return pick(e.join(bound, ["file_id", "head"]).join(there, ["object_file", "last"]))

    near = top.select(F.col("project_key").alias("k"), F.col("package").alias("p"), F.col("name").alias("n"), F.col("file_id").alias("object_file"), F.col("qualified").alias("object"))
    beside = pick(heirs.join(package, "file_id").join(near, F.col("project_key").eqNullSafe(F.col("k")) & (F.col("package") == F.col("p")) & (F.col("target") == F.col("n"))).filter("object_file != file_id"))
    plain = calls.filter((F.col("head") == F.col("last")) | F.col("head").isin("this", "super"))
    sibling = callables.select("file_id", F.col("name").alias("last"), F.col("owner"), F.col("qualified").alias("object"))
    scope = F.regexp_replace("subject", r"\.?[^.]*$", "")
    same_type = pick(plain.withColumn("owner", scope).join(sibling, ["file_id", "last", "owner"]).withColumn("object_file", F.col("file_id")).filter("object != subject and owner != ''"))
    a = _first(("FQN", full), ("SAME_FILE", own(heirs, types)), ("IMPORT", imported(heirs, types)), ("PACKAGE", beside))
    b = _first(("SAME_TYPE", same_type), ("SAME_FILE", own(plain, callables)), ("IMPORT", imported(calls, callables)))
    return a.unionByName(b)


def keys(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(file_id, qualified, key): the key of each symbol of the files that paths mean, the first of a qualified name.

    Overloads have one qualified name; the least signature stands for them.
    """
    s = rows.filter("row = 'symbol'").join(index.select("file_id", "project_key", "path"), "file_id")
    one = s.groupBy("file_id", "project_key", "path", "qualified").agg(F.min(F.struct(F.coalesce("signature", F.lit("")).alias("signature"), "kind")).alias("m"))
    return one.select("file_id", "qualified", symbol_key(F.col("project_key"), F.col("path"), F.col("m.kind"), F.regexp_replace("qualified", r"\.", "::"), F.col("m.signature")).alias("key"))
