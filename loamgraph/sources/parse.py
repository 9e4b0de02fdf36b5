"""Rows out of source text, manifests and version-control logs, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.scalars import bare_code

# Patterns of the declarations, routes and imports that are read.
TYPE_PATTERN = r"(?:public\s+|export\s+)?(?:class|interface)\s+([A-Za-z0-9_]+)"
METHOD_PATTERN = r"(?:public|private|protected|async|function)\s+(?:[A-Za-z0-9_<>\[\], ]+\s+)?([A-Za-z0-9_]+)\s*\(([^)]*)\)"
MAPPING_PATTERN = r"@(Get|Post|Put|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?\"([^\"]*)\""
IMPORT_PATTERN = r"(?m)^\s*import\s+(?:[^'\";]*?from\s+)?['\"]([^'\"]+)['\"]"
JAVA_IMPORT_PATTERN = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"
NOT_METHODS = ["if", "for", "while", "switch", "catch", "class", "interface"]


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def symbols(files: DataFrame) -> DataFrame:
    """(file_id, kind, name) of types and methods declared in ``files`` (file_id, content)."""
    types = files.select("file_id", F.lit("CLASS").alias("kind"), F.explode(_all(F.col("content"), TYPE_PATTERN, 1)).alias("name"))
    methods = files.select("file_id", F.lit("METHOD").alias("kind"), F.explode(_all(F.col("content"), METHOD_PATTERN, 1)).alias("name")).filter(~F.col("name").isin(NOT_METHODS))
    return types.unionByName(methods)


def imports(files: DataFrame) -> DataFrame:
    """(file_id, target, occurrences): one edge a raw target."""
    found = files.select("file_id", F.explode(F.concat(_all(F.col("content"), IMPORT_PATTERN, 1), _all(F.col("content"), JAVA_IMPORT_PATTERN, 1))).alias("target"))
    return found.groupBy("file_id", "target").agg(F.count("*").alias("occurrences"))


def _clean_route(path: Column) -> Column:
    p = F.regexp_replace(path, r"\$\{[^}]+\}", "{id}")
    p = F.regexp_replace(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), "/+", "/")
    return F.regexp_replace(p, "/+$", "")


#: A client's name and verb, in any letter case, a literal, and what is added to it.
_CALL = r"(?i)\b(?:axios|apiClient|http|request|client)\.(get|post|put|delete|patch)\s*\(\s*([`'\"][^`'\"]+[`'\"](?:\s*\+\s*(?:[\w$.]+|[`'\"][^`'\"]*[`'\"]))*)"
_OPTIONS = r"\{\s*url\s*:\s*[`'\"]([^`'\"]+)[`'\"](?:\s*,\s*method\s*:\s*['\"]([A-Za-z]+)['\"])?"


def client_calls(files: DataFrame) -> DataFrame:
    """(file_id, method, path) of HTTP calls in client code: verb calls, and options with url and method.

    What a template or a sum puts into the route is {id}; options without a
    method are GET.  ``code.extracted`` reads the same from tokens.
    """
    pairs = lambda pattern: F.arrays_zip(_all(F.col("content"), pattern, 1).alias("m"), _all(F.col("content"), pattern, 2).alias("p"))
    calls = files.select("file_id", F.explode(pairs(_CALL)).alias("x"))
    quote = r"[`'\"]"
    between = F.regexp_replace(F.trim("x.p"), rf"{quote}\s*\+\s*[\w$.]+\s*\+\s*{quote}", "{id}")
    route = F.regexp_replace(F.regexp_replace(between, rf"{quote}\s*\+\s*[\w$.]+\s*$", "{id}"), quote, "")
    options = files.select("file_id", F.explode(pairs(_OPTIONS)).alias("x"))
    by_options = options.select("file_id", F.upper(F.when(F.col("x.p") != "", F.col("x.p")).otherwise("GET")).alias("method"), _clean_route(F.col("x.m")).alias("path"))
    return calls.select("file_id", F.upper("x.m").alias("method"), _clean_route(route).alias("path")).unionByName(by_options)


def served_routes(files: DataFrame) -> DataFrame:
    """(file_id, method, path) of mapped handlers; a mapping without a verb serves GET."""
    pairs = F.arrays_zip(_all(F.col("content"), MAPPING_PATTERN, 1).alias("m"), _all(F.col("content"), MAPPING_PATTERN, 2).alias("p"))
    c = files.select("file_id", F.explode(pairs).alias("x"))
    path = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), F.trim("x.p")), "/+", "/"), "/+$", "")
    return c.select("file_id", F.when(F.col("x.m") == "Request", "GET").otherwise(F.upper("x.m")).alias("method"), path.alias("path"))


def fields(code: Column, optional_mark: bool = True) -> Column:
    """Names of the typed fields of an interface or class body."""
    return _all(code, r"(?m)^\s*(?:private |public |readonly )?([A-Za-z0-9_]+)\??:\s*[A-Za-z0-9_<>\[\]| ]+;" if optional_mark else r"(?m)^\s*(?:private|public|protected)\s+[A-Za-z0-9_<>\[\], ]+\s+([A-Za-z0-9_]+)\s*(?:=[^;]*)?;", 1)


def component_tags(template: Column) -> Column:
    """Distinct sorted component tags (with an upper-case letter or a dash) of a template."""
    return F.sort_array(F.array_distinct(_all(template, r"<([A-Z][\w]*|[a-z]+(?:-[a-z0-9]+)+)[\s/>]", 1)))


def event_bindings(template: Column) -> Column:
    """Distinct sorted events bound in a template."""
    return F.sort_array(F.array_distinct(_all(template, r"(?:@|v-on:)([a-z][\w-]*)", 1)))


def script_block(component: Column) -> Column:
    """The script of a single-file component."""
    return F.regexp_extract(component, r"(?s)<script[^>]*>(.*?)</script>", 1)


def manifest_entries(files: DataFrame) -> DataFrame:
    """(file_id, package, version, section, name, spec) of package manifests in JSON."""
    kinds = ["scripts", "dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    parsed = F.from_json("content", "name string, version string, " + ", ".join(f"{k} map<string,string>" for k in kinds))
    m = files.select("file_id", parsed.alias("j")).filter("j.name is not null")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.col(f"j.{k}").alias("entries")) for k in kinds]))
    s = m.select("file_id", F.col("j.name").alias("package"), F.col("j.version").alias("version"), rows.alias("r"))
    return s.select("file_id", "package", "version", "r.section", F.explode("r.entries").alias("name", "spec"))


def pom_entries(files: DataFrame) -> DataFrame:
    """(file_id, package, version, scope) of Maven dependencies; version managed and scope compile by default."""
    schema = "groupId string, artifactId string, dependencies struct<dependency: array<struct<groupId:string,artifactId:string,version:string,scope:string>>>"
    d = files.select("file_id", F.explode(F.from_xml("content", schema)["dependencies"]["dependency"]).alias("d"))
    return d.select("file_id", F.concat_ws(":", "d.groupId", "d.artifactId").alias("package"), F.coalesce("d.version", F.lit("managed")).alias("version"), F.coalesce("d.scope", F.lit("compile")).alias("scope"))


def chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, chunk, start_line, end_line, text): markdown sections from heading to heading.

    A heading is one to three # and a space; blank sections are dropped.  The
    text of one document is split inside its row, so no group is shuffled.
    """
    lines = F.split("text", "\n", -1)
    head = F.transform(F.col("lines"), lambda line: line.rlike(r"^#{1,3} "))
    starts = F.filter(F.transform(F.col("lines"), lambda line, i: F.when((i == 0) | head[i], i)), lambda i: i.isNotNull())
    d = documents.select("doc_id", lines.alias("lines")).withColumn("starts", starts)
    end = lambda i: F.coalesce(F.try_element_at("starts", i + 2), F.size("lines"))
    parts = F.transform("starts", lambda s, i: F.struct((s + 1).alias("start_line"), end(i).alias("end_line"), F.array_join(F.slice("lines", s + 1, end(i) - s), "\n").alias("text")))
    kept = F.filter(parts, lambda p: F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != "")
    return d.select("doc_id", F.posexplode(kept).alias("chunk", "p")).select("doc_id", "chunk", "p.start_line", "p.end_line", "p.text")


def commit_log(records: DataFrame) -> DataFrame:
    """(sha, author, path, change, old_path, insertions, deletions) of log records (value).

    A record is one commit, as a text source with the record separator as
    ``lineSep`` gives it: a header of sha, author and time between unit
    separators, then name-status and numstat lines.  Each record is parsed
    inside its row.  Counts that are no numbers (binary files) are 0.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.split(F.get(lines, F.lit(0)), "\x1f")
    r = records.select(F.get(head, F.lit(0)).alias("sha"), F.get(head, F.lit(1)).alias("author"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines"))
    number = lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0))
    counts = F.transform(F.filter("lines", lambda x: x.rlike(r"^[\d-]+\t[\d-]+\t")), lambda x: F.struct(F.split(x, "\t")[2].alias("path"), number(F.split(x, "\t")[0]).alias("insertions"), number(F.split(x, "\t")[1]).alias("deletions")))
    r = r.withColumn("counts", counts).withColumn("line", F.explode(F.filter("lines", lambda x: x.rlike(r"^[A-Z]\d*\t"))))
    t = F.split("line", "\t")
    path = F.when(F.size(t) > 2, F.get(t, F.lit(2))).otherwise(F.get(t, F.lit(1)))
    own = F.filter("counts", lambda c: c["path"] == path)
    kind = F.when(t[0].startswith("A"), "ADDED").when(t[0].startswith("D"), "DELETED").when(t[0].startswith("R"), "RENAMED").otherwise("MODIFIED")
    return r.select("sha", "author", path.alias("path"), kind.alias("change"), F.when(t[0].startswith("R"), t[1]).alias("old_path"), F.coalesce(F.get(own, F.lit(0))["insertions"], F.lit(0)).alias("insertions"), F.coalesce(F.get(own, F.lit(0))["deletions"], F.lit(0)).alias("deletions"))


def scanned(binary_files: DataFrame) -> DataFrame:
    """(path, size, sha256, is_binary, is_sensitive) of a ``binaryFile`` source.

    Files over 10 MB are not hashed; names that look like secrets give size 0.
    """
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    secret = name.rlike(r"^(\.env.*|.*\.pem|.*\.key|.*\.p12|.*\.pfx|.*\.jks|id_rsa.*|id_dsa.*|credentials.*|secrets?\..*|\.npmrc)$")
    sniffed = F.position(F.unhex(F.lit("00")).cast("string"), F.substring("content", 1, 8192).cast("string")) > 0
    return binary_files.select("path", F.when(secret, 0).otherwise(F.col("length")).alias("size"), F.when(~secret & (F.col("length") <= 10 * 1024 * 1024), F.sha2("content", 256)).alias("sha256"), sniffed.alias("is_binary"), secret.alias("is_sensitive"))


def digests(files: DataFrame) -> DataFrame:
    """(path, digest, bare_digest) of (file_path, content), the latest delivery of a path."""
    one = files.groupBy("file_path").agg(F.max(F.struct("ingested_at", "file_id", "content")).alias("m")).select("file_path", "m.content")
    return one.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("digest"), F.sha2(bare_code(F.col("content")), 256).alias("bare_digest"))
