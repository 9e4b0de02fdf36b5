"""Written forms of parameter lists, and the keys and addresses of symbols and relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgraph.sources.code import Text


def split_parameters(body: str | None) -> list[str]:
    """Parts between commas; brackets of all kinds, type arguments, strings and comments are stepped over."""
    t = Text(body or "", java=True)
    return [t.source(a, b) for a, b in t.parts(0, t.end)]


def typescript_types(body: str | None) -> str:
    """Types of TypeScript parameters by comma: an optional one ends in ?, a rest begins with ..., an untyped one is ?."""
    out = []
    for part in split_parameters(body):
        t = Text(part, java=True)
        a = 0
        while t.is_p(a, "@") or t.is_word(a, "public", "private", "protected", "readonly") and a + 1 < t.end and t.kind[a + 1] == "word":
            a = t.dotted(a + 1, t.end)[1] if t.is_p(a, "@") else a + 1
            a = t.close(a) + 1 if t.is_p(a, "(") else a
        rest = t.is_p(a, "...")
        a += rest
        name_end = t.close(a) + 1 if t.is_p(a, "{") or t.is_p(a, "[") else a + 1
        optional = t.is_p(name_end, "?")
        at = name_end + optional
        stop = next((k for a_, _ in [(at, 0)] for k in range(a_, t.end) if t.is_p(k, "=")), t.end)
        kind = "".join(t.source(at + 1, stop).split()) if t.is_p(at, ":") else "?"
        out.append(("..." if rest else "") + kind + ("?" if (optional or stop < t.end) and kind != "?" else ""))
    return ",".join(out)


def java_types(body: str | None) -> str:
    """Types of Java parameters by comma, without annotations, modifiers, names and a receiver."""
    out = []
    for part in split_parameters(body):
        t = Text(part, java=True)
        a = 0
        while t.is_p(a, "@") or t.is_word(a, "final"):
            a = t.dotted(a + 1, t.end)[1] if t.is_p(a, "@") else a + 1
            a = t.close(a) + 1 if t.is_p(a, "(") else a
        if t.end - a < 1 or t.is_word(t.end - 1, "this"):
            continue
        end = t.end
        dims = 0
        while end - 2 > a and t.is_p(end - 1, "]") and t.is_p(end - 2, "["):
            end, dims = end - 2, dims + 1
        out.append("".join(t.source(a, end - 1 if end - a > 1 else end).split()) + "[]" * dims)
    return ",".join(out)


def _column(f):
    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x), na_action="ignore")

    return each


def typescript_signature(body: Column) -> Column:
    return _column(typescript_types)(body)


def java_signature(body: Column) -> Column:
    return _column(java_types)(body)


def qualified_name(scopes: Column, name: Column) -> Column:
    """Scopes and name by ::; empty scopes are left out."""
    return F.array_join(F.concat(F.filter(F.coalesce(scopes, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")), F.array(name)), "::")


def uri_parts(uri: Column) -> Column:
    """(repository, path, symbol) of repo://repository/path#symbol; null for anything else, symbol null where there is none."""
    part = lambda n: F.regexp_extract(uri, r"^repo://([^/]+)/([^#]*)(?:#(.*))?$", n)
    return F.when(uri.rlike(r"^repo://[^/]+/"), F.struct(part(1).alias("repository"), part(2).alias("path"), F.nullif(part(3), F.lit("")).alias("symbol")))


def relation_key(project: Column, subject: Column, predicate: Column, target: Column, kind: Column, discriminator: Column | None = None) -> Column:
    return F.concat_ws(":", F.lit("RELATION"), project, subject, predicate, target, kind, F.lit("default") if discriminator is None else discriminator)


def bridge_key(form: str, source: Column, target_project: Column, subject: Column, predicate: Column, target: Column, kind: Column, discriminator: Column | None = None) -> Column:
    """The key of a relation between projects; form: TRACE (of calls) or CROSS."""
    return F.concat_ws(":", F.lit("RELATION"), F.lit(form), source, target_project, subject, predicate, target, kind, F.lit("default") if discriminator is None else discriminator)


def endpoint_key(method: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("ENDPOINT"), F.upper(method), path)


def occurrence(**fields: Column) -> Column:
    """A place as JSON, without the fields that are null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
