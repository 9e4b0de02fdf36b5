"""Column expressions that bring identifiers, paths and JSON to one written form.

Everything here is a composition of built-in functions, so it stays inside
whole-stage code generation and can be pushed next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Value without white space at either end (tabs and line feeds included)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze_ws(c: Column) -> Column:
    """Value without any white space."""
    return F.regexp_replace(c, r"\s+", "")


def sha_ref(c: Column) -> Column:
    """A commit reference in lower case without spaces; null for 'no commit'.

    Empty strings and all-zero references mean that there is none.
    """
    v = F.lower(strip_ws(c))
    return F.when((v != "") & ~v.rlike("^0+$"), v)


def fwd(c: Column) -> Column:
    """Value with forward slashes."""
    return F.regexp_replace(c, r"\\", "/")


def clean_path(c: Column) -> Column:
    """Path with forward slashes, without leading ./, doubled or trailing slashes."""
    p = F.regexp_replace(fwd(c), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(?:\./)+", ""), "/$", "")


def parent_path(c: Column) -> Column:
    """Directory one level up; null for a top-level path."""
    return F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", ""))


def canonical_json(c: Column) -> Column:
    """JSON text in one written form: keys sorted, no layout, no null members.

    Null input gives ``{}``.  Text that is not JSON is kept as it is, without
    outer white space, behind a mark, so that it only equals the same text.
    A variant stores object members ordered by key, so serialising one is the
    sorted form; the two scans then step over whole string tokens and remove
    null members, so nothing inside a string is touched.
    """
    v = F.to_json(F.try_parse_json(c))
    string = r'"(?:[^"\\]|\\.)*"'
    v = F.regexp_replace(v, rf"{string}:null,?|({string})", "$1")
    v = F.regexp_replace(v, rf"({string})|,(?=\}})", "$1")
    return F.when(c.isNull(), F.lit("{}")).otherwise(F.coalesce(v, F.concat(F.lit("text:"), strip_ws(c))))
