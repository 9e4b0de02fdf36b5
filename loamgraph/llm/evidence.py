"""What a source file's own text says about who wrote it."""

from __future__ import annotations

import re

import numpy as np

# Notices that generators and distributors put at the top of a file, the seeds of what is mined.
GENERATED_NOTICES = [
    r"@generated\b",
    r"<auto-?generated\b",
    r"\bauto-?generated (?:from|by)\b",
    r"\b(?:file|code|class|module|source)\b[^.;]{0,30}\b(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using)\b",
    r"^\W*(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using|on|at)\b",
    r"\bdo not (?:edit|modify|change)\b[^a-z]*(?:$|by hand|manually|this file|directly)",
    r"\bdo not (?:edit|modify|change)\b[^\n]{0,20}\b(?:generated|produced|created) (?:by|from)\b",
    r"\bmanual (?:edits|changes|modifications)\b[^\n]{0,30}\b(?:overwritten|lost|discarded)\b",
    r"\b(?:changes|edits|modifications)\b[^\n]{0,20}\bwill be (?:lost|overwritten|discarded)\b",
]
DISTRIBUTED_NOTICES = [
    r"\blicensed under\b",
    r"\breleased under\b",
    r"\bupstream\b",
    r"\bthird[- ]party\b",
    r"\bpackage [@\w./-]+@\d",
    r"\(c\)[^\n]{0,60}\bauthors\b",
    r"\brelease notes\b",
]
_VERSION = re.compile(r"(?:@|\bv|\bversion |\s-\s|\s)\d+\.\d+(?:\.\d+)?\b", re.I)
_GENERATED = re.compile("|".join(GENERATED_NOTICES), re.I | re.M)
_DISTRIBUTED = re.compile("|".join(DISTRIBUTED_NOTICES), re.I)
_ANNOTATED = re.compile(r"^\s*@(?:javax?\.annotation\.)?(?:processing\.)?Generated\s*\(", re.M)
_TRANSPILED = re.compile(r"Object\.defineProperty\(exports,\s*[\"']__esModule[\"']|^//[#@] sourceMappingURL=", re.M)
_COMMENT = re.compile(r"\s*(?:(//[^\n]*)|(/\*[\s\S]*?\*/)|(#[^\n]*)|(<!--[\s\S]*?-->))")
_STRING = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_ANY_COMMENT = re.compile(r"(?:(?<=\s)|^)//[^\n]*|/\*[\s\S]*?\*/|^\s*#[^\n]*|<!--[\s\S]*?-->", re.M)
_NUMBER = re.compile(r"(?<![\w.])-?\d[\d_.]*(?:[eE][+-]?\d+)?\b")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_TOKEN = re.compile(r"\w+")
_COUNTED = re.compile(r"[A-Za-z_]\d+(?![a-z0-9])|-\d+\"")

#: A file needs this many characters, or lines, for its statistics to mean anything.
LEAST_CHARS, LEAST_LINES = 300, 8


def leading(text: str) -> str:
    """The comments at the top, before any code but a package line or directive."""
    at, out = 0, []
    text = re.sub(r"\A(?:#![^\n]*\n)?\s*(?:(?:[\"']use strict[\"'];?|package [\w.]+;|<\?[^\n]*\?>)\s*)?", "", text, count=1)
    while True:
        m = _COMMENT.match(text, at)
        if m is None:
            return "\n".join(out)
        out.append(m.group())
        at = m.end()


def _clean(head: str) -> str:
    return "\n".join(re.sub(r"^(?:\s|//+|/\*+!?|\*+|#+|<!--)+|(?:\s|\*+/|-->)+$", "", x) for x in head.split("\n"))


def notice(head: str) -> str | None:
    """generated or vendored by the seeds: a generator's notice, or a distributor's with a version."""
    clean = _clean(head)
    if _GENERATED.search(clean):
        return "generated"
    return "vendored" if _VERSION.search(head) and _DISTRIBUTED.search(clean) else None


#: Words of a phrase.
PHRASE = 3
_TERM = re.compile(r"@?[^\W\d_]+(?:['-][^\W\d_]+)*|\d[\w.:/-]*|[\w./-]+|[©<>]")


def phrases(head: str) -> np.ndarray:
    """Hashes of the runs of ``PHRASE`` words in the lines of leading comments; numbers, paths and names are kinds."""
    import xxhash

    out = set()
    for line in _clean(head).split("\n"):
        terms = ["^"]
        for t in _TERM.findall(line):
            terms.append("#" if t[0].isdigit() else "/" if "/" in t or "." in t else "~" if any(c.isupper() for c in t[1:]) and not t.isupper() or "_" in t else t.lower())
        terms.append("$")
        out.update(xxhash.xxh3_64_intdigest(" ".join(terms[i : i + PHRASE])) for i in range(len(terms) - PHRASE + 1) if sum(x[-1].isalpha() for x in terms[i : i + PHRASE]) >= 2)
    return np.array(sorted(out), np.uint64).astype(np.int64)


def kind(text: str | None, language: str | None) -> str | None:
    """generated, minified, data or vendored by the text alone: by the seeds, else by its shape; else None."""
    if not text or not text.strip():
        return None
    return notice(leading(text)) or shape(text, language)


def shape(text: str | None, language: str | None) -> str | None:
    """generated, minified or data by what the text consists of, else None.

    * a generator's annotation, or a compiler's prologue or map reference;
    * minified: little white space, short names, most characters in long lines;
    * data: nearly all characters are literals and their punctuation;
    * generated: lines of few shapes whose names are counted up.
    """
    if not text or not text.strip():
        return None
    body = _ANY_COMMENT.sub(" ", text)
    if language in ("java", None) and _ANNOTATED.search(body) or language in ("javascript", "jsx", "typescript", "tsx", None) and _TRANSPILED.search(text):
        return "generated"
    solid = len(re.sub(r"\s", "", body))
    if solid < LEAST_CHARS // 2:
        return None
    bare = _STRING.sub('""', body)
    if language not in ("json", "python", "vue"):
        names = _WORD.findall(bare)
        long = sum(len(x) for x in body.split("\n") if len(x) > 200) / len(body)
        spaces = sum(c.isspace() for c in bare) / max(1, len(bare))
        short = sum(len(x) == 1 for x in names) / max(1, len(names))
        if long > 0.5 and spaces < 0.1 and short > 0.15:
            return "minified"
    if solid < LEAST_CHARS:
        return None
    rows = [x for x in body.split("\n") if len(x.strip()) > 3]
    shapes = {re.sub(r"\d+", "0", _WORD.sub("x", _STRING.sub("S", re.sub(r"\d+", "0", x.strip())))) for x in rows}
    counted = sum(bool(_COUNTED.search(x)) for x in rows) / max(1, len(rows))
    few = len(shapes) / max(1, len(rows))
    if language == "json":
        objects = re.findall(r"\{[^{}]*\}", text)
        keys = [tuple(re.findall(r"\"([^\"]*)\"\s*:", o)) for o in objects]
        same = max((keys.count(k) for k in set(keys)), default=0)
        numbers = sum(len(m) for m in _NUMBER.findall(bare))
        if same >= 8 and sum(map(len, objects)) > 0.6 * len(text):
            return "generated" if counted > 0.1 and "integrity" in text else "data"
        return "data" if numbers > 0.5 * solid else None
    words = sum(map(len, _WORD.findall(bare)))
    if words < 0.12 * solid:
        return "data"
    if len(rows) >= LEAST_LINES and few <= 0.3 and counted >= 0.55:
        return "data" if "<path" in text else "generated"
    return None


def fingerprints(text: str | None, words: int = 24, window: int = 5) -> np.ndarray:
    """Winnowed hashes of runs of ``words`` words outside comments.

    Of each ``window`` neighbouring runs the least hash is kept, so a passage
    of words + window - 1 words gives the same hashes wherever it stands.
    """
    w = _TOKEN.findall(_ANY_COMMENT.sub(" ", (text or "").lower()))
    n = len(w) - words + 1
    if n <= 0:
        return np.empty(0, np.int64)
    import xxhash

    each = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(words):
            h = h * np.uint64(0x100000001B3) + each[i : i + n]
            h ^= h >> np.uint64(29)
    if n > window:
        h = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
    return np.unique(h).astype(np.int64)


def whole(text: str | None) -> np.ndarray:
    """One hash of all words outside comments, for a text too short for a run; none without words."""
    w = _TOKEN.findall(_ANY_COMMENT.sub(" ", (text or "").lower()))
    if not w:
        return np.empty(0, np.int64)
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest("\0".join(["whole", *w]))], np.uint64).astype(np.int64)
