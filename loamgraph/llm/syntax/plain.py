"""Recognisers of Python and strict JSON: lexers with a stack, then the exact check."""

from __future__ import annotations

import ast
import re
import warnings

from loamgraph.llm.syntax.base import CLOSER, CONFLICT, ILLEGAL, PREMATURE, UNBALANCED, UNEXPECTED, UNTERMINATED, Rejected, _MARKER

_PY = re.compile(r"#[^\n]*|(?P<s>[rRbBuUfFtT]{0,2}(?:\"\"\"|'''|\"|'))|(?P<d>[()\[\]{}])|(?P<w>\w+)|\n|[^\S\n]+|[^\w\s]")
_BODIES = {'"""': re.compile(r"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\""), "'''": re.compile(r"(?:[^\\']|\\[\s\S]|'(?!''))*'''"), '"': re.compile(r"(?:[^\\\"\n]|\\[\s\S])*\""), "'": re.compile(r"(?:[^\\'\n]|\\[\s\S])*'")}


def _marked(x: str, at: int) -> bool:
    return bool(_MARKER.match(x, x.rfind("\n", 0, at) + 1))


def check_python(x: str) -> None:
    """Literals and delimiters by lexer and stack; what passes is parsed exactly."""
    at, stack, line_start = 0, [], True
    n = len(x)
    while at < n:
        if line_start and _MARKER.match(x, at):
            raise Rejected(CONFLICT, at)
        m = _PY.match(x, at)
        line_start = m.group() == "\n"
        if m["s"]:
            quote = m["s"].lstrip("rRbBuUfFtT")
            prefix = m["s"][: -len(quote)].lower()
            body = _BODIES[quote].match(x, m.end())
            if body is None:
                if "f" in prefix or "t" in prefix:
                    break  # a replacement field may hold the quote: left to the exact check
                raise Rejected(UNTERMINATED, at)
            at = body.end()
            continue
        if m["d"]:
            d = m["d"]
            if d in CLOSER:
                stack.append(d)
            elif not stack or CLOSER[stack.pop()] != d:
                raise Rejected(UNBALANCED, at)
        at = m.end()
    else:
        if stack:
            raise Rejected(PREMATURE, n)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(x)
        except SyntaxError as e:
            lines = x.split("\n")
            k = min((e.lineno or 1), len(lines)) - 1
            at = sum(len(y) + 1 for y in lines[:k])
            late = k >= len(lines) - 2 and not "".join(lines[k + 1 :]).strip()
            raise Rejected(CONFLICT if _marked(x, at) else PREMATURE if late else UNEXPECTED, at) from None
        except ValueError:
            raise Rejected(ILLEGAL, 0) from None


_JSON = re.compile(r"[ \t\r\n]*(?:(?P<s>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9A-Fa-f]{4}))*\")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b)|(?P<p>[{}\[\],:]))")


def check_json(x: str) -> None:
    """A pushdown automaton over strict JSON; the empty text is rejected."""
    at, n = 0, len(x)
    stack: list[str] = []
    state = "value"  # value, key, colon, after; *_or_end directly after an opening
    if x.startswith("﻿"):
        at = 1
    while True:
        m = _JSON.match(x, at)
        if m is None:
            rest = re.compile(r"[ \t\r\n]*").match(x, at).end()
            if rest >= n:
                if stack or state != "after":
                    raise Rejected(PREMATURE, n)
                return
            if _marked(x, rest):
                raise Rejected(CONFLICT, rest)
            raise Rejected(UNTERMINATED if x[rest] == '"' else ILLEGAL if x[rest] not in "'/" else UNEXPECTED, rest)
        s, v, p = m["s"], m["v"], m["p"]
        start = m.start(m.lastgroup)
        ok = True
        if state.startswith("value"):
            if s or v:
                state = "after"
            elif p == "{":
                stack.append(p)
                state = "key_or_end"
            elif p == "[":
                stack.append(p)
                state = "value_or_end"
            elif p == "]" and state == "value_or_end":
                stack.pop()
                state = "after"
            else:
                ok = False
        elif state.startswith("key"):
            if s:
                state = "colon"
            elif p == "}" and state == "key_or_end":
                stack.pop()
                state = "after"
            else:
                ok = False
        elif state == "colon":
            ok = p == ":"
            state = "value"
        elif p == "," and stack:
            state = "key" if stack[-1] == "{" else "value"
        elif p in ("}", "]") and stack and CLOSER[stack[-1]] == p:
            stack.pop()
        else:
            ok = False
        if not ok:
            raise Rejected(CONFLICT if _marked(x, start) else UNBALANCED if p in ("}", "]") and (not stack or CLOSER[stack[-1]] != p) else UNEXPECTED, start)
        at = m.end()
