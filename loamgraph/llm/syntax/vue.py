"""Pushdown recogniser of single-file components: blocks, template tags, scripts."""

from __future__ import annotations

import re

from loamgraph.llm.syntax.base import CONFLICT, PREMATURE, UNBALANCED, UNEXPECTED, UNTERMINATED, Rejected, _MARKER
from loamgraph.llm.syntax.ecma import Ecma

# Elements that have no end tag, in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])

_TAG = re.compile(r"<([A-Za-z][^\s/>\"'<=]*)")
_END = re.compile(r"</([A-Za-z][^\s/>]*)\s*>")
_ATTRIBUTE = re.compile(r"\s*(?:([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)")
_STATEMENT_HANDLER = re.compile(r"^(?:@|v-on[:.])")
_FOR = re.compile(r"^\s*\(?([\s\S]*?)\)?\s+(?:in|of)\s+([\s\S]+)$")


def fail(text: str, reason: str, at: int) -> None:
    line = text.rfind("\n", 0, at) + 1
    raise Rejected(CONFLICT if _MARKER.match(text, line) else reason, at)


def open_tag(x: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """Name, attributes, whether it closes itself, and the offset behind the tag."""
    m = _TAG.match(x, at)
    if m is None:
        fail(x, UNEXPECTED, at)
    name, e, found = m.group(1), m.end(), {}
    while True:
        while e < len(x) and x[e].isspace():
            e += 1
        if e >= len(x):
            fail(x, PREMATURE, e)
        if x[e] == ">":
            return name, found, False, e + 1
        if x.startswith("/>", e):
            return name, found, True, e + 2
        m = _ATTRIBUTE.match(x, e)
        if m is None or m.group(1) is None or m.end() == e:
            if x[e] == "/":
                e += 1
                continue
            fail(x, UNEXPECTED, e)
        key, value = m.group(1), m.group(2)
        if value is None and re.match(r"\s*=", x[m.end() : m.end() + 40]):
            at_value = m.end() + re.match(r"\s*=\s*", x[m.end() :]).end()
            fail(x, UNTERMINATED if at_value < len(x) and x[at_value] in "\"'" else UNEXPECTED, at_value)
        if key in found:
            fail(x, UNEXPECTED, e)
        found[key] = value[1:-1] if value and value[0] in "\"'" else value or ""
        e = m.end()


def expression(x: str, at: int, code: str, types: bool, statements: bool = False) -> None:
    if not code.strip():
        return
    try:
        if statements:
            try:
                Ecma(code, types, False).check_expression()
            except Rejected:
                p = Ecma(code, types, False)
                p.functions = 1
                p.check()
        else:
            Ecma(code, types, False).check_expression()
    except Rejected as e:
        raise Rejected(e.reason, at) from None


def check_attributes(x: str, at: int, found: dict[str, str], types: bool) -> None:
    for key, value in found.items():
        if _STATEMENT_HANDLER.match(key):
            expression(x, at, value, types, statements=True)
        elif key == "v-for":
            m = _FOR.match(value)
            if m is None:
                fail(x, UNEXPECTED, at)
            if m.group(1).strip():
                expression(x, at, f"({m.group(1)}) => 0", types)
            expression(x, at, m.group(2), types)
        elif key.startswith(("v-slot", "#")):
            if value.strip():
                expression(x, at, f"({value}) => 0", types)
        elif key.startswith((":", "v-bind", "v-if", "v-else-if", "v-show", "v-model", "v-html", "v-text")):
            expression(x, at, value, types)


def template(x: str, at: int, types: bool, outer: str) -> int:
    """Offset behind the end tag of the template whose content starts at ``at``."""
    opened = [(outer, at)]
    n = len(x)
    while True:
        next_tag, mustache = x.find("<", at), x.find("{{", at)
        if mustache >= 0 and (next_tag < 0 or mustache < next_tag):
            end = x.find("}}", mustache)
            if end < 0:
                fail(x, UNTERMINATED, mustache)
            expression(x, mustache, x[mustache + 2 : end], types)
            at = end + 2
            continue
        if next_tag < 0:
            fail(x, PREMATURE, n)
        at = next_tag
        if x.startswith("<!--", at):
            end = x.find("-->", at + 4)
            if end < 0:
                fail(x, UNTERMINATED, at)
            at = end + 3
        elif x.startswith("</", at):
            m = _END.match(x, at)
            if m is None:
                fail(x, PREMATURE if x.find(">", at) < 0 else UNEXPECTED, at)
            if m.group(1) != opened[-1][0]:
                fail(x, UNBALANCED, at)
            opened.pop()
            at = m.end()
            if not opened:
                return at
        elif x.startswith("<!", at):
            end = x.find(">", at)
            if end < 0:
                fail(x, PREMATURE, n)
            at = end + 1
        elif _TAG.match(x, at):
            name, found, selfclosed, e = open_tag(x, at)
            check_attributes(x, at, found, types)
            at = e
            if not selfclosed and name.lower() not in VOID:
                if name.lower() in RAW:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(x, at)
                    if end is None:
                        fail(x, PREMATURE, n)
                    at = end.end()
                else:
                    opened.append((name, at))
        else:
            fail(x, UNEXPECTED, at)


def style(x: str, code: str, base: int) -> None:
    """Brackets, comments and strings of a style block."""
    stack = []
    for m in re.finditer(r"/\*[\s\S]*?\*/|/\*|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[\"'{}()\[\]]", code):
        t = m.group()
        if t in ("/*", '"', "'"):
            fail(x, UNTERMINATED, base + m.start())
        if t in ("{", "(", "["):
            stack.append(t)
        elif t in ("}", ")", "]"):
            if not stack or {"{": "}", "(": ")", "[": "]"}[stack.pop()] != t:
                fail(x, UNBALANCED, base + m.start())
    if stack:
        fail(x, PREMATURE, base + len(code))
    for line in re.finditer(r"^.*$", code, re.M):
        if _MARKER.match(line.group()):
            raise Rejected(CONFLICT, base + line.start())


def check(x: str) -> None:
    """Raises Rejected unless the text is a component with sound blocks."""
    at, seen, blocks = 0, {"template": 0, "script": 0, "setup": 0}, []
    types = bool(re.search(r"<script[^>]*\blang\s*=\s*[\"']?tsx?\b", x))
    while True:
        m = re.compile(r"\s*(?:<!--[\s\S]*?-->\s*)*").match(x, at)
        at = m.end()
        if at >= len(x):
            break
        if x[at] != "<":
            # text between blocks is ignored by component compilers, but no markup may be broken by it
            nxt = x.find("<", at)
            line = x.rfind("\n", 0, at) + 1
            if _MARKER.match(x, line) or _MARKER.match(x, at):
                raise Rejected(CONFLICT, at)
            raise Rejected(UNEXPECTED, at if nxt < 0 else at)
        if x.startswith("<!--", at):
            fail(x, UNTERMINATED, at)
        if x.startswith("</", at):
            fail(x, UNBALANCED, at)
        if _TAG.match(x, at) is None:
            fail(x, UNEXPECTED, at)
        name, found, selfclosed, e = open_tag(x, at)
        kind = "setup" if name == "script" and "setup" in found else name
        if kind in seen:
            seen[kind] += 1
            if seen[kind] > 1:
                fail(x, UNEXPECTED, at)
        blocks.append(name)
        if selfclosed:
            at = e
            continue
        if name == "template" and found.get("lang", "html") == "html":
            at = template(x, e, types, name)
            continue
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(x, e)
        if end is None:
            if name == "script":
                inner(x, e, len(x), found)
            fail(x, PREMATURE, len(x))
        if name == "script":
            inner(x, e, end.start(), found)
        elif name == "style":
            style(x, x[e : end.start()], e)
        at = end.end()
    if x.strip() and not any(b in ("template", "script") for b in blocks):
        raise Rejected(UNEXPECTED, 0)


def inner(x: str, start: int, end: int, found: dict[str, str]) -> None:
    if found.get("lang", "js") in ("js", "ts", "jsx", "tsx") and "src" not in found:
        lang = found.get("lang", "js")
        try:
            Ecma(x[start:end], lang in ("ts", "tsx"), lang in ("jsx", "tsx")).check()
        except Rejected as e:
            raise Rejected(e.reason, start + e.at) from None
