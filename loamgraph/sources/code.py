"""Declarations, imports, heritage, calls and endpoints out of source text.

A reader of tokens and matched brackets, not of patterns: comments, strings,
templates and regular expressions are tokens of their own, so what stands in
them declares nothing, and each declaration knows where its body ends.  One
pass over a text gives all its rows; ``rows`` is the only column the readers
share, and the functions at the end select one kind of row each.

It reads what is there: a file that does not parse gives the declarations up to
where its brackets still match.  Whether a text is valid is another question.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extensions and languages that are read; verbs, mappings, macros and option groups looked for.
READERS = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "java": "java", "vue": "vue"}
VERBS = frozenset("get post put delete patch head options".split())
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}
MACROS = frozenset("defineProps defineEmits defineExpose defineOptions defineSlots defineModel withDefaults".split())
OPTION_GROUPS = frozenset("props emits data computed methods watch components setup".split())
JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
TS_MODIFIERS = frozenset("public private protected static readonly abstract async override declare accessor get set".split())
KEYWORDS = frozenset("if for while switch catch return typeof new function class do else in of instanceof await yield throw delete void case import export super this try finally with synchronized assert".split())
ROUTE_PREFIXES = ("/api/", "/crm/")

#: Frames up to which nested bodies are followed (some four a level); a deeper file has the status FAILED.
DEEPEST = 100_000

FIELDS = [("row", "string"), ("kind", "string"), ("name", "string"), ("qualified", "string"), ("owner", "string"), ("target", "string"), ("signature", "string"), ("modifiers", "string"), ("detail", "string"), ("arguments", "int"), ("line", "int"), ("end_line", "int"), ("exported", "boolean")]
SCHEMA = "file_id long, " + ", ".join(f"{n} {t}" for n, t in FIELDS)

_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\s+)"
    r"|(?P<block>\"\"\"[\s\S]*?(?:\"\"\"|\Z))"
    r"|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)"
    r"|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<p>=>|->|\?\.|\.\.\.|::|[^\w\s])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BEFORE_REGEX = frozenset("( [ { , ; = : ? ! & | + - * % ^ ~ < > => }".split())


class Text:
    """Tokens (kind, value, start) of a text, the partner of each bracket, and lines by offset."""

    def __init__(self, text: str, first_line: int = 1, java: bool = False) -> None:
        self.text, self.first_line = text, first_line
        self.kind: list[str] = []
        self.value: list[str] = []
        self.start: list[int] = []
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        at, n = 0, len(text)
        while at < n:
            c = text[at]
            if c == "`" and not java:
                end = self._template(at)
                self._add("tmpl", text[at:end], at)
                at = end
                continue
            if c == "/" and not java and text[at + 1 : at + 2] not in ("/", "*") and (not self.kind or self.value[-1] in _BEFORE_REGEX and self.kind[-1] == "p" or self.value[-1] in ("return", "typeof", "case")):
                m = _REGEX.match(text, at)
                if m:
                    self._add("regex", m.group(), at)
                    at = m.end()
                    continue
            m = _TOKEN.match(text, at)
            kind = m.lastgroup
            if kind == "block" and not java:
                self._add("str", '""', at)
                at += 2
                continue
            if kind != "skip":
                self._add("str" if kind == "block" else kind, m.group(), at)
            at = m.end()
        self.end = len(self.kind)
        self.partner: dict[int, int] = {}
        self.balanced = True
        opened: list[int] = []
        for i, (k, v) in enumerate(zip(self.kind, self.value)):
            if k == "p" and v in _OPEN:
                opened.append(i)
            elif k == "p" and v in _CLOSE:
                if opened and _OPEN[self.value[opened[-1]]] == v:
                    self.partner[opened.pop()] = i
                else:
                    self.balanced = False
        self.balanced = self.balanced and not opened

    def _add(self, kind: str, value: str, start: int) -> None:
        self.kind.append(kind)
        self.value.append(value)
        self.start.append(start)

    def _template(self, at: int) -> int:
        """Behind a template; code in it, and templates in that code, are stepped over."""
        depth: list[int] = []  # open braces in each placeholder
        i, n = at + 1, len(self.text)
        while i < n:
            c = self.text[i]
            if c == "\\":
                i += 1
            elif depth and depth[-1] >= 0:
                if c == "{":
                    depth[-1] += 1
                elif c == "}":
                    depth[-1] -= 1
                    if depth[-1] == 0:
                        depth.pop()
                elif c == "`":
                    depth.append(-1)
            elif c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif c == "$" and self.text[i + 1 : i + 2] == "{":
                depth.append(1)
                i += 1
            i += 1
        return n

    def line(self, i: int) -> int:
        at = self.start[min(i, self.end - 1)] if self.end else 0
        return self.first_line + bisect_right(self.breaks, at - 1)

    def is_p(self, i: int, v: str) -> bool:
        return i < self.end and self.value[i] == v and self.kind[i] == "p"

    def is_word(self, i: int, *words: str) -> bool:
        return i < self.end and self.kind[i] == "word" and (not words or self.value[i] in words)

    def source(self, a: int, b: int) -> str:
        """The text of tokens a to b - 1, white space as one space."""
        if a >= b or a >= self.end:
            return ""
        last = min(b, self.end) - 1
        return " ".join(self.text[self.start[a] : self.start[last] + len(self.value[last])].split())

    def close(self, i: int) -> int:
        """The partner of the bracket at i; the end where it has none."""
        return self.partner.get(i, self.end)

    def angle(self, i: int) -> int:
        """Behind type arguments that open at i; i itself if they do not close soon."""
        depth, k = 0, i
        while k < self.end and k - i < 400:
            v = self.value[k]
            if self.kind[k] == "p":
                if v == "<":
                    depth += 1
                elif v == ">":
                    depth -= 1
                    if not depth:
                        return k + 1
                elif v in ("(", "[", "{"):
                    k = self.close(k)
                elif v in (";", ")", "}"):
                    return i
            k += 1
        return i

    def parts(self, a: int, b: int, comma: str = ",") -> list[tuple[int, int]]:
        """Stretches between commas from a to b, brackets and type arguments stepped over."""
        out, k, at = [], a, a
        while k < b:
            if self.kind[k] == "p":
                if self.value[k] in _OPEN:
                    k = self.close(k)
                elif self.value[k] == "<" and self.angle(k) > k:
                    k = self.angle(k) - 1
                elif self.value[k] == comma:
                    out.append((at, k))
                    at = k + 1
            k += 1
        if at < b:
            out.append((at, b))
        return out

    def dotted(self, i: int, b: int) -> tuple[str, int]:
        """A dotted name from i on, and what follows it."""
        k = i
        while k + 2 < b and self.is_p(k + 1, ".") and self.is_word(k + 2):
            k += 2
        return "".join(self.value[i : k + 1]), k + 1


class Reader:
    """Rows of one text; ``scopes`` are the bodies of declarations, innermost last."""

    def __init__(self, t: Text, scope: tuple[str, ...] = ()) -> None:
        self.t, self.base = t, scope
        self.rows: list[dict] = []
        self.scopes: list[tuple[int, int, str]] = []
        self.declared: set[int] = set()

    def emit(self, row: str, **values) -> None:
        self.rows.append({"row": row, **values})

    def symbol(self, kind: str, name: str, scope: tuple[str, ...], at: int, end: int, signature: str = "", modifiers: list[str] = (), exported: bool = False, detail: str = "", owned: str | None = None) -> str:
        qualified = ".".join([*scope, owned or name])
        self.emit("symbol", kind=kind, name=name, qualified=qualified, owner=".".join(scope), signature=signature, modifiers=" ".join(modifiers), detail=detail, line=self.t.line(at), end_line=self.t.line(end), exported=exported)
        return qualified

    def calls(self) -> None:
        """call and new rows: a name or chain before parentheses that is no declaration and no keyword."""
        t = self.t
        order = sorted(self.scopes)
        stack: list[tuple[int, int, str]] = []
        nxt = 0
        for i in range(t.end):
            while nxt < len(order) and order[nxt][0] <= i:
                stack.append(order[nxt])
                nxt += 1
            while stack and stack[-1][1] < i:
                stack.pop()
            if t.kind[i] != "word" or i in self.declared:
                continue
            k = i + 1
            if t.is_p(k, "<"):
                k = t.angle(k)
            if not t.is_p(k, "("):
                continue
            new = False
            a = i
            while a >= 2 and t.kind[a - 1] == "p" and t.value[a - 1] in (".", "?."):
                if t.kind[a - 2] == "word":
                    a -= 2
                else:
                    break
            new = t.is_word(a - 1, "new") if a else False
            if t.value[i] in KEYWORDS and not (t.value[i] in ("super", "this") and a == i):
                continue
            target = "".join(t.value[a : i + 1]).replace("?.", ".")
            if a and t.kind[a - 1] == "p" and t.value[a - 1] in (".", "?."):
                target = "()." + target  # on the result of an expression
            end = t.close(k)
            self.emit("new" if new else "call", owner=stack[-1][2] if stack else ".".join(self.base), target=target, name=t.value[i], arguments=len(t.parts(k + 1, end)), line=t.line(i))

    def literal(self, i: int) -> str | None:
        if i < self.t.end and self.t.kind[i] in ("str", "tmpl"):
            return self.t.value[i][1:-1]
        return None


class Script(Reader):
    """TypeScript and JavaScript, with or without JSX."""

    def read(self) -> list[dict]:
        self.statements(0, self.t.end, self.base)
        self.calls()
        self.clients()
        return self.rows

    def statements(self, a: int, b: int, scope: tuple[str, ...]) -> None:
        i = a
        while i < b:
            i = max(i + 1, self.statement(i, b, scope))

    def statement(self, i: int, b: int, scope: tuple[str, ...]) -> int:
        """Reads what begins at i; gives where to go on."""
        t, start, exported, how = self.t, i, False, ""
        if t.is_word(i, "export"):
            exported = True
            i += 1
            if t.is_p(i, "{") or t.is_p(i, "*"):
                return self.reexport(i, b)
            if t.is_word(i, "default"):
                how = "default"
                i += 1
                if t.is_p(i, "{"):
                    return self.options(i, scope)
                if t.is_word(i, "defineComponent") and t.is_p(i + 1, "(") and t.is_p(i + 2, "{"):
                    return self.options(i + 2, scope)
        modifiers = []
        while t.is_word(i, "declare", "abstract", "async") and t.is_word(i + 1):
            modifiers.append(t.value[i])
            i += 1
        if t.is_word(i, "import") and not t.is_p(i + 1, "(") and not t.is_p(i + 1, "."):
            return self.importing(i, b)
        if t.is_word(i, "function"):
            return self.function(i, b, scope, start, modifiers, exported, how)
        if t.is_word(i, "class") and (t.is_word(i + 1) or how):
            return self.klass(i, b, scope, start, modifiers, exported, how)
        if t.is_word(i, "interface") and t.is_word(i + 1):
            name = t.value[i + 1]
            k = i + 2
            if t.is_p(k, "<"):
                k = t.angle(k)
            body = next((x for x in range(k, min(b, k + 300)) if t.is_p(x, "{")), None)
            if body is None:
                return i + 1
            end = t.close(body)
            own = self.symbol("INTERFACE", name, scope, start, end, modifiers=modifiers, exported=exported, detail=how)
            if t.is_word(k, "extends"):
                self.heritage("EXTENDS", own, k + 1, body)
            self.fields(body, own)
            self.declared.update(range(body, min(end, t.end)))
            return end + 1
        if t.is_word(i, "type") and t.is_word(i + 1) and (t.is_p(i + 2, "=") or t.is_p(i + 2, "<")):
            end = self.end_of(i + 2, b)
            self.symbol("TYPE", t.value[i + 1], scope, start, end - 1, modifiers=modifiers, exported=exported, detail=how)
            self.declared.update(range(i, min(end, t.end)))
            return end
        if t.is_word(i, "enum") and t.is_word(i + 1) or t.is_word(i, "const") and t.is_word(i + 1, "enum"):
            k = i + (2 if t.value[i] == "const" else 1)
            if t.is_p(k + 1, "{"):
                end = t.close(k + 1)
                members = [t.value[x] for x, y in t.parts(k + 2, end) if t.kind[x] in ("word", "str")]
                self.symbol("ENUM", t.value[k], scope, start, end, modifiers=modifiers, exported=exported, detail=",".join(members))
                return end + 1
        if t.is_word(i, "namespace", "module") and t.is_word(i + 1):
            name, k = t.dotted(i + 1, b)
            if t.is_p(k, "{"):
                end = t.close(k)
                self.statements(k + 1, end, (*scope, name))
                return end + 1
        if t.is_word(i, "const", "let", "var") and (t.is_word(i + 1) or t.is_p(i + 1, "{") or t.is_p(i + 1, "[")):
            return self.variables(i, b, scope, start, modifiers, exported)
        if t.kind[i] == "p" and t.value[i] in ("{", "("):  # a block, or what a call is given
            self.nested(i + 1, t.close(i), scope)
            return t.close(i) + 1
        return i + 1

    def nested(self, a: int, b: int, scope: tuple[str, ...]) -> None:
        self.statements(a, min(b, self.t.end), scope)

    def end_of(self, i: int, b: int) -> int:
        """Behind the statement that goes on at i: a semicolon, or a line that ends it."""
        t, k = self.t, i
        while k < b:
            if t.kind[k] == "p":
                if t.value[k] in _OPEN:
                    k = t.close(k)
                elif t.value[k] == ";":
                    return k + 1
                elif t.value[k] in _CLOSE:
                    return k
            if k + 1 < b and t.line(k + 1) > t.line(min(k, t.end - 1)) and not (t.kind[k] == "p" and t.value[k] not in (")", "]", "}", ">")) and not (t.kind[k + 1] == "p" and t.value[k + 1] in (".", "?.", "|", "&", "?", ":", "=", "+", "-", "*", "/", ",", "=>", "(", "{", "[")) and not t.is_word(k, "extends", "typeof", "keyof", "return"):
                return k + 1
            k += 1
        return b

    def specifiers(self, a: int, b: int) -> list[str]:
        out = []
        for x, y in self.t.parts(a, b):
            words = [self.t.value[k] for k in range(x, y) if self.t.kind[k] == "word" and self.t.value[k] not in ("type", "as")]
            if words:
                out.append(words[-1])
        return out

    def importing(self, i: int, b: int) -> int:
        t, k = self.t, i + 1
        only_types = t.is_word(k, "type") and not t.is_p(k + 1, ",") and not t.is_word(k + 1, "from")
        k += only_types
        names: list[str] = []
        while k < b and t.kind[k] not in ("str",) and k - i < 400:
            if t.is_p(k, "{"):
                names += self.specifiers(k + 1, t.close(k))
                k = t.close(k)
            elif t.is_p(k, "*") and t.is_word(k + 1, "as") and t.is_word(k + 2):
                names.append(t.value[k + 2])
                k += 2
            elif t.is_p(k, "=") or t.is_p(k, ";"):
                return k + 1
            elif t.is_word(k) and t.value[k] != "from":
                names.append(t.value[k])
            k += 1
        target = self.literal(k)
        if target:
            self.emit("import", kind="TYPE" if only_types else "VALUE", target=target, detail=",".join(names), line=t.line(i))
        return k + 1

    def fields(self, body: int, own: str) -> None:
        """field rows: the typed members of an interface, methods left out."""
        t, i, end = self.t, body + 1, min(self.t.close(body), self.t.end)
        while i < end:
            i += t.is_word(i, "readonly") and i + 1 < end and t.kind[i + 1] in ("word", "str")
            if t.kind[i] in ("word", "str") and (t.is_p(i + 1, ":") or t.is_p(i + 1, "?") and t.is_p(i + 2, ":")):
                stop = next((k for k in self.stops(i + 1, end)), end)
                self.emit("field", name=t.value[i].strip("'\""), owner=own, signature=t.source(i + 2 + t.is_p(i + 1, "?"), stop), line=t.line(i))
            else:
                stop = next((k for k in self.stops(i, end)), end)
            i = stop + (stop < end and t.kind[stop] == "p" and t.value[stop] in (";", ","))

    def stops(self, a: int, b: int) -> Iterator[int]:
        """Where a member's type may end: a semicolon, a comma, or a new line that begins another member."""
        t, k = self.t, a
        while k < b:
            if t.kind[k] == "p":
                if t.value[k] in _OPEN:
                    k = t.close(k)
                elif t.value[k] == "<":
                    k = max(k, t.angle(k) - 1)
                elif t.value[k] in (";", ","):
                    yield k
            if k + 1 < b and t.line(k + 1) > t.line(k) and t.kind[k + 1] in ("word", "str") and (t.is_p(k + 2, ":") or t.is_p(k + 2, "?") or t.is_p(k + 2, "(")):
                yield k + 1
            k += 1

    def reexport(self, i: int, b: int) -> int:
        t = self.t
        k = t.close(i) + 1 if t.is_p(i, "{") else i + 1
        while t.is_word(k) and t.value[k] != "from" and k < i + 4:
            k += 1
        if t.is_word(k, "from") and self.literal(k + 1):
            names = self.specifiers(i + 1, t.close(i)) if t.is_p(i, "{") else ["*"]
            self.emit("import", kind="REEXPORT", target=self.literal(k + 1), detail=",".join(names), line=t.line(i))
            return k + 2
        return k

    def classified(self, name: str, a: int, b: int) -> str:
        """HOOK by name, COMPONENT if a capital name gives markup, else FUNCTION."""
        if re.match(r"use[A-Z0-9]", name):
            return "HOOK"
        if name[:1].isupper():
            for k in range(a, min(b, self.t.end) - 1):
                if self.t.is_p(k, "<") and (self.t.kind[k + 1] == "word" or self.t.is_p(k + 1, ">")) and (self.t.is_p(k - 1, "(") or self.t.is_word(k - 1, "return") or self.t.is_p(k - 1, "=>")):
                    return "COMPONENT"
        return "FUNCTION"

    def parameters(self, i: int) -> str:
        """Names and types of parameters in parentheses at i."""
        out = []
        for x, y in self.t.parts(i + 1, self.t.close(i)):
            while self.t.is_word(x, "public", "private", "protected", "readonly") and x + 1 < y:
                x += 1
            colon = next((k for k in range(x, y) if self.t.is_p(k, ":") and k - x <= 2 or self.t.is_p(k, ":") and self.t.is_p(x, "{") and k > self.t.close(x)), None)
            equal = next((k for k in range(x, y) if self.t.is_p(k, "=")), y)
            name = self.t.source(x, min(colon if colon is not None else y, equal)).rstrip("?").strip()
            out.append(f"{name}: {self.t.source(colon + 1, max(equal, colon + 1))}" if colon is not None and colon < equal else name)
        return f"({', '.join(out)})"

    def returns(self, i: int, b: int) -> tuple[str, int]:
        """The return type behind parameters, and where it ends."""
        t = self.t
        if not t.is_p(i, ":"):
            return "", i
        k = i + 1
        while k < b:
            if t.is_p(k, "{") and k > i + 1 and not (t.kind[k - 1] == "p" and t.value[k - 1] in ("|", "&", "<", ",", ":")):
                break
            if t.kind[k] == "p":
                if t.value[k] in _OPEN:
                    k = t.close(k)
                elif t.value[k] == "<":
                    k = max(k, t.angle(k) - 1)
                elif t.value[k] in ("=>", ";", ",", "=") or t.value[k] in _CLOSE:
                    break
            k += 1
        return ": " + t.source(i + 1, k), k

    def function(self, i: int, b: int, scope, start: int, modifiers: list[str], exported: bool, how: str) -> int:
        t, k = self.t, i + 1
        if t.is_p(k, "*"):
            modifiers = [*modifiers, "generator"]
            k += 1
        name = t.value[k] if t.is_word(k) else "default" if how else ""
        self.declared.add(k)
        k += bool(t.is_word(k))
        if t.is_p(k, "<"):
            k = t.angle(k)
        if not t.is_p(k, "(") or not name:
            return i + 1
        signature = self.parameters(k)
        what, body = self.returns(t.close(k) + 1, b)
        end = t.close(body) if t.is_p(body, "{") else body
        own = self.symbol(self.classified(name, body, end), name, scope, start, end, signature + what, modifiers, exported, how)
        if t.is_p(body, "{"):
            self.scopes.append((body, end, own))
            self.nested(body + 1, end, (*scope, name))
        return end + 1

    def heritage(self, predicate: str, own: str, a: int, b: int) -> None:
        for x, _ in self.t.parts(a, b):
            if self.t.is_word(x):
                self.emit("heritage", kind=predicate, owner=own, target=self.t.dotted(x, b)[0], line=self.t.line(x))

    def klass(self, i: int, b: int, scope, start: int, modifiers: list[str], exported: bool, how: str) -> int:
        t, k = self.t, i + 1
        name = t.value[k] if t.is_word(k) and t.value[k] not in ("extends", "implements") else "default"
        k += name != "default" or t.is_word(k, "default")
        if t.is_p(k, "<"):
            k = t.angle(k)
        above = below = None
        body = k
        while body < b and not t.is_p(body, "{"):
            if t.is_word(body, "extends"):
                above = body + 1
            elif t.is_word(body, "implements"):
                below = body + 1
            if t.is_p(body, "("):
                body = t.close(body)
            elif t.is_p(body, "<"):
                body = max(body, t.angle(body) - 1)
            body += 1
        if body >= b:
            return i + 1
        end = t.close(body)
        own = self.symbol("CLASS", name, scope, start, end, modifiers=modifiers, exported=exported, detail=how)
        if above is not None:
            self.heritage("EXTENDS", own, above, (below or body + 1) - 1)
        if below is not None:
            self.heritage("IMPLEMENTS", own, below, body)
        self.scopes.append((body, end, own))
        self.members(body + 1, end, (*scope, name))
        return end + 1

    def members(self, a: int, b: int, scope: tuple[str, ...]) -> None:
        t, i = self.t, a
        while i < min(b, t.end):
            start, modifiers = i, []
            while t.is_p(i, "@"):
                i = t.dotted(i + 1, b)[1]
                if t.is_p(i, "("):
                    i = t.close(i) + 1
            while t.is_word(i) and t.value[i] in TS_MODIFIERS and i + 1 < b and (t.kind[i + 1] in ("word", "str") or t.is_p(i + 1, "[") or t.is_p(i + 1, "#") or t.is_p(i + 1, "*") or t.is_p(i + 1, "{")):
                modifiers.append(t.value[i])
                i += 1
            if t.is_p(i, "{") and modifiers == ["static"]:
                self.nested(i + 1, t.close(i), scope)
                i = t.close(i) + 1
                continue
            i += t.is_p(i, "*")
            private = t.is_p(i, "#")
            i += private
            if i >= min(b, t.end):
                break
            if t.kind[i] not in ("word", "str", "num"):
                i = t.close(i) + 1 if t.is_p(i, "[") or t.is_p(i, "{") else i + 1
                continue
            name = ("#" if private else "") + t.value[i].strip("'\"")
            self.declared.add(i)
            k = i + 1
            k += t.is_p(k, "?") or t.is_p(k, "!")
            if t.is_p(k, "<"):
                k = t.angle(k)
            if t.is_p(k, "("):
                signature = self.parameters(k)
                what, body = self.returns(t.close(k) + 1, b)
                end = t.close(body) if t.is_p(body, "{") else body
                own = self.symbol("METHOD", name, scope, start, end, signature + what, modifiers)
                if name == "constructor":
                    self.properties(k, scope)
                if t.is_p(body, "{"):
                    self.scopes.append((body, end, own))
                    self.nested(body + 1, end, (*scope, name))
                i = end + 1
            else:
                kind = self.returns(k, b)[0] if t.is_p(k, ":") else ""
                end = self.end_of(k, b)
                own = self.symbol("FIELD", name, scope, start, end - 1, kind, modifiers)
                self.scopes.append((k, end - 1, own))
                self.nested(k, end, (*scope, name))
                i = max(end, i + 1)

    def properties(self, i: int, scope: tuple[str, ...]) -> None:
        """Parameters of a constructor that are fields as well."""
        t = self.t
        for x, y in t.parts(i + 1, t.close(i)):
            modifiers = []
            while t.is_word(x, "public", "private", "protected", "readonly") and x + 1 < y:
                modifiers.append(t.value[x])
                x += 1
            if modifiers and t.is_word(x):
                self.symbol("FIELD", t.value[x], scope, x, y - 1, modifiers=modifiers)

    def names(self, a: int, b: int) -> list[str]:
        """The names that a destructuring pattern binds."""
        t, out = self.t, []
        for x, y in t.parts(a + 1, t.close(a)):
            x += t.is_p(x, "...")
            colon = next((k for k in range(x, y) if t.is_p(k, ":")), None) if t.is_p(a, "{") else None
            x = colon + 1 if colon is not None else x
            if t.is_p(x, "{") or t.is_p(x, "["):
                out += self.names(x, y)
            elif t.is_word(x):
                out.append(t.value[x])
        return out

    def variables(self, i: int, b: int, scope, start: int, modifiers: list[str], exported: bool) -> int:
        t = self.t
        end = self.end_of(i + 1, b)
        for x, y in t.parts(i + 1, end):
            y = min(y, end)
            if t.is_p(x, "{") or t.is_p(x, "["):
                for name in self.names(x, y):
                    self.symbol("VARIABLE", name, scope, x, y - 1, modifiers=[t.value[i], *modifiers], exported=exported, detail="destructured")
                self.nested(t.close(x) + 1, y, scope)
                continue
            if not t.is_word(x):
                continue
            name = t.value[x]
            equal = next((k for k in range(x + 1, y) if t.is_p(k, "=")), None)
            arrow = self.callable_at(equal + 1, y) if equal is not None else None
            if arrow is not None:
                signature, body, stop, more = arrow
                own = self.symbol(self.classified(name, body, stop), name, scope, start if x == i + 1 else x, stop, signature, [t.value[i], *more], exported, "arrow" if "function" not in more else "expression")
                self.scopes.append((body, stop, own))
                self.nested(body + t.is_p(body, "{"), stop, (*scope, name))
                continue
            own = self.symbol("VARIABLE", name, scope, start if x == i + 1 else x, y - 1, modifiers=[t.value[i], *modifiers], exported=exported)
            if not scope:
                self.scopes.append((x, y - 1, own))
            if equal is not None:
                self.routes(equal + 1, y, own)
                self.nested(equal + 1, y, (*scope, name))
        return max(end, i + 1)

    def callable_at(self, k: int, b: int) -> tuple[str, int, int, list[str]] | None:
        """(signature, body, end, modifiers) if an arrow or function expression begins at k."""
        t, more = self.t, []
        if t.is_word(k, "async"):
            more.append("async")
            k += 1
        if t.is_word(k, "function"):
            k += 1 + t.is_p(k + 1, "*")
            if t.is_word(k):
                self.declared.add(k)
                k += 1
            if not t.is_p(k, "("):
                return None
            what, body = self.returns(t.close(k) + 1, b)
            return (self.parameters(k) + what, body, t.close(body), [*more, "function"]) if t.is_p(body, "{") else None
        if t.is_p(k, "<"):
            k = t.angle(k)
        if t.is_word(k) and t.is_p(k + 1, "=>"):
            signature, at = f"({t.value[k]})", k + 1
        elif t.is_p(k, "("):
            what, at = self.returns(t.close(k) + 1, b)
            signature = self.parameters(k) + what
        else:
            return None
        if not t.is_p(at, "=>"):
            return None
        body = at + 1
        return signature, body, t.close(body) if t.is_p(body, "{") else max(body, b - 1), more

    def options(self, i: int, scope: tuple[str, ...]) -> int:
        """A default-exported object: the option groups of a component, and its methods."""
        t, end = self.t, self.t.close(i)
        groups = []
        for x, y in t.parts(i + 1, end):
            x += t.is_word(x, "async") and not t.is_p(x + 1, ":")
            if not t.is_word(x):
                continue
            name = t.value[x]
            if name in OPTION_GROUPS:
                groups.append(name)
            if t.is_p(x + 1, "("):
                self.object_method(x, y, scope, [])
            elif t.is_p(x + 1, ":") and t.is_p(x + 2, "{") and name in ("methods", "computed", "watch"):
                for p, q in t.parts(x + 3, t.close(x + 2)):
                    flags = ["async"] if t.is_word(p, "async") and t.is_word(p + 1) else []
                    self.object_method(p + len(flags), q, scope, [*flags, name])
        self.emit("options", detail=",".join(groups), line=t.line(i))
        return end + 1

    def object_method(self, x: int, y: int, scope: tuple[str, ...], modifiers: list[str]) -> None:
        t = self.t
        if not t.is_word(x):
            return
        name = t.value[x]
        self.declared.add(x)
        if t.is_p(x + 1, "("):
            what, body = self.returns(t.close(x + 1) + 1, y)
            signature, end = self.parameters(x + 1) + what, t.close(body) if t.is_p(body, "{") else y - 1
        elif t.is_p(x + 1, ":") and (found := self.callable_at(x + 2, y)):
            signature, body, end, _ = found
        else:
            return
        own = self.symbol("METHOD", name, scope, x, end, signature, modifiers)
        self.scopes.append((body, end, own))
        self.nested(body + 1, end, (*scope, name))

    def path(self, a: int, b: int) -> str | None:
        """A route from a literal, with what is put in or added as {id}."""
        first = self.literal(a)
        if first is None:
            return None
        out = re.sub(r"\$\{[^}]*\}", "{id}", first)
        k = a + 1
        while k < b and self.t.is_p(k, "+"):
            more = self.literal(k + 1)
            out += re.sub(r"\$\{[^}]*\}", "{id}", more) if more is not None else "{id}"
            k += 2
            while k < b and not self.t.is_p(k, "+"):
                k = self.t.close(k) + 1 if self.t.kind[k] == "p" and self.t.value[k] in _OPEN else k + 1
        return out

    def clients(self) -> None:
        """client rows: verb calls with a literal route, and calls with url and method options."""
        t = self.t
        for i in range(t.end - 2):
            if t.kind[i] == "word" and t.value[i].lower() in VERBS and i and t.is_p(i - 1, "."):
                k = t.angle(i + 1) if t.is_p(i + 1, "<") else i + 1
                if t.is_p(k, "(") and i not in self.declared:
                    first = t.parts(k + 1, t.close(k))[:1]
                    route = self.path(*first[0]) if first else None
                    if route and (route.startswith(("/", "http", "{id}"))):
                        self.emit("client", kind=t.value[i].upper(), target=route, detail=t.value[i - 2] if i > 1 and t.kind[i - 2] == "word" else "", line=t.line(i))
            elif t.is_word(i, "url") and t.is_p(i + 1, ":") and self.literal(i + 2) is not None:
                here = self.around(i)
                route = self.path(i + 2, min(t.end, i + 40) if here is None else here[1])
                verb = None
                if here:
                    verb = next((self.literal(k + 2) for k in range(here[0], here[1]) if t.is_word(k, "method") and t.is_p(k + 1, ":")), None)
                if route and route.startswith(("/", "http")):
                    self.emit("client", kind=(verb or "GET").upper(), target=route, detail="options", line=t.line(i))

    def around(self, i: int, reach: int = 60) -> tuple[int, int] | None:
        """The braces around i, if they open near it."""
        t, depth = self.t, 0
        for k in range(i - 1, max(-1, i - reach), -1):
            if t.kind[k] == "p" and t.value[k] in _CLOSE:
                depth += 1
            elif t.kind[k] == "p" and t.value[k] in _OPEN:
                if not depth:
                    return (k, t.close(k)) if t.value[k] == "{" else None
                depth -= 1
        return None

    def routes(self, a: int, b: int, own: str) -> None:
        """client rows of kind ANY for constants that are routes."""
        for k in range(a, b):
            if self.t.kind[k] == "str" and self.t.value[k][1:-1].startswith(ROUTE_PREFIXES) and (k == a or self.t.is_p(k - 1, ":")):
                self.emit("client", kind="ANY", target=self.t.value[k][1:-1], owner=own, detail="constant", line=self.t.line(k))


class Java(Reader):
    """Java: types, members, imports, heritage, calls and mapped handlers."""

    def read(self) -> list[dict]:
        t, i = self.t, 0
        self.package = ""
        while i < t.end:
            if t.is_word(i, "package") and t.is_word(i + 1):
                self.package, i = t.dotted(i + 1, t.end)
                self.emit("package", name=self.package, line=t.line(i))
            elif t.is_word(i, "import"):
                static = t.is_word(i + 1, "static")
                name, k = t.dotted(i + 1 + static, t.end)
                wild = t.is_p(k, ".") and t.is_p(k + 1, "*")
                self.emit("import", kind="STATIC" if static else "WILDCARD" if wild else "TYPE", target=name + (".*" if wild else ""), detail="" if wild else name.rpartition(".")[2], line=t.line(i))
                i = k + 2 * wild + 1
            else:
                i = max(i + 1, self.member(i, t.end, self.base, None))
        self.calls()
        return self.rows

    def head(self, i: int, b: int) -> tuple[int, list[str], list[tuple[str, int, int]]]:
        """Modifiers and annotations from i on: (what follows, modifiers, (name, from, to))."""
        t, modifiers, notes = self.t, [], []
        while i < b:
            if t.is_p(i, "@") and t.is_word(i + 1) and t.value[i + 1] != "interface":
                name, k = t.dotted(i + 1, b)
                end = t.close(k) + 1 if t.is_p(k, "(") else k
                self.declared.update(range(i, min(end, t.end)))
                notes.append((name.rpartition(".")[2], k, end))
                i = end
            elif t.is_word(i) and t.value[i] in JAVA_MODIFIERS and not t.is_p(i + 1, ":") and not t.is_p(i + 1, "->"):
                modifiers.append(t.value[i])
                i += 1
            elif t.is_word(i, "non") and t.is_p(i + 1, "-") and t.is_word(i + 2, "sealed"):
                modifiers.append("non-sealed")
                i += 3
            else:
                break
        return i, modifiers, notes

    def typed(self, i: int, b: int) -> int:
        """Behind a type that begins at i; i if none does."""
        t = self.t
        if not t.is_word(i) or t.value[i] in KEYWORDS and t.value[i] != "void":
            return i
        _, k = t.dotted(i, b)
        if t.is_p(k, "<"):
            k = t.angle(k)
        while t.is_p(k, "[") and t.is_p(k + 1, "]"):
            k += 2
        if t.is_p(k, "..."):
            k += 1
        return k

    def types(self, a: int, b: int) -> str:
        """Types and names of parameters between parentheses; a receiver does not count."""
        out = []
        for x, y in self.t.parts(a, b):
            x, _, _ = self.head(x, y)
            k = self.typed(x, y)
            if k > x and not self.t.is_word(k, "this"):
                out.append(self.t.source(x, y))
        return f"({', '.join(out)})"

    def member(self, i: int, b: int, scope: tuple[str, ...], owner: dict | None) -> int:
        """Reads one declaration that begins at i; gives where to go on."""
        t, start = self.t, i
        i, modifiers, notes = self.head(i, b)
        told = " ".join(n for n, _, _ in notes)
        if i >= b:
            return b
        if t.is_p(i, "@") and t.is_word(i + 1, "interface"):
            return self.type_at(i + 1, b, scope, start, modifiers, notes, "ANNOTATION")
        kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "CLASS"}.get(t.value[i]) if t.kind[i] == "word" else None
        if kind and t.is_word(i + 1) and (t.value[i] != "record" or t.is_p(i + 2, "(") or t.is_p(i + 2, "<")):
            return self.type_at(i, b, scope, start, modifiers, notes, kind)
        if t.is_p(i, "{"):  # an initialiser
            if owner:
                self.scopes.append((i, t.close(i), ".".join(scope)))
                self.body(i + 1, t.close(i), scope)
            return t.close(i) + 1
        if not owner:
            return i + 1
        if t.is_p(i, "<"):
            i = t.angle(i)
        if t.is_word(i, owner["name"]) and (t.is_p(i + 1, "(") or t.is_p(i + 1, "{") and owner["record"]):
            self.declared.add(i)
            compact = t.is_p(i + 1, "{")
            signature = owner["components"] if compact else self.types(i + 2, t.close(i + 1))
            return self.callable("<init>", i + 1 if compact else t.close(i + 1) + 1, b, scope, start, signature, modifiers, told, "", notes, owner)
        k = self.typed(i, b)
        if k == i or not t.is_word(k):
            return i + 1
        name, what = t.value[k], t.source(i, k)
        self.declared.add(k)
        if t.is_p(k + 1, "("):
            return self.callable(name, t.close(k + 1) + 1, b, scope, start, self.types(k + 2, t.close(k + 1)), modifiers, told, what, notes, owner)
        end = self.end_of(k, b)
        if owner["kind"] == "INTERFACE":
            modifiers = ["public", "static", "final"]
        for x, y in t.parts(k, end - 1):
            if t.is_word(x):
                self.declared.add(x)
                own = self.symbol("FIELD", t.value[x], scope, start if x == k else x, y - 1, what, modifiers, "public" in modifiers, told)
                self.scopes.append((x, y - 1, own))
                self.body(x + 1, y, (*scope, t.value[x]))
        return end

    def end_of(self, i: int, b: int) -> int:
        t, k = self.t, i
        while k < b:
            if t.kind[k] == "p":
                if t.value[k] == ";":
                    return k + 1
                if t.value[k] in _OPEN:
                    k = t.close(k)
            k += 1
        return b

    def callable(self, name: str, k: int, b: int, scope, start: int, signature: str, modifiers: list[str], told: str, what: str, notes, owner: dict) -> int:
        t = self.t
        while t.is_p(k, "[") and t.is_p(k + 1, "]"):
            k += 2
        thrown = ""
        if t.is_word(k, "throws"):
            stop = next((x for x in range(k, b) if t.is_p(x, "{") or t.is_p(x, ";")), b)
            thrown = " throws " + t.source(k + 1, stop)
            k = stop
        if t.is_word(k, "default"):
            k = self.end_of(k, b) - 1
        end = t.close(k) if t.is_p(k, "{") else k
        own = self.symbol("METHOD", name, scope, start, end, signature + (": " + what if what else "") + thrown, modifiers, "public" in modifiers, told)
        if t.is_p(k, "{"):
            self.scopes.append((k, end, own))
            self.body(k + 1, end, (*scope, name))
        for note, x, y in notes:
            if note in MAPPINGS:
                services = sorted({f"{t.value[z]}.{t.value[z + 2]}" for z in range(k, min(end, t.end - 3)) if t.kind[z] == "word" and "service" in t.value[z].lower() and t.is_p(z + 1, ".") and t.kind[z + 2] == "word" and t.is_p(z + 3, "(")})
                verb = MAPPINGS[note]
                if note == "RequestMapping":
                    verb = next((t.value[z].rpartition(".")[2] for z in range(x, y) if t.kind[z] == "word" and t.value[z].lower() in VERBS and t.value[z].isupper()), "GET")
                for route in self.literals(x, y) or [""]:
                    path = re.sub("/+", "/", "/".join(["", owner["base"], route])).rstrip("/") or "/"
                    self.emit("endpoint", kind=verb, target=path, name=name, owner=own, detail=",".join(services), line=t.line(start))
        return end + 1

    def literals(self, a: int, b: int) -> list[str]:
        """Routes named in an annotation's arguments: the value, path or only argument."""
        t, out = self.t, []
        for x, y in t.parts(a + 1, b - 1) if t.is_p(a, "(") else []:
            named = t.is_word(x) and t.is_p(x + 1, "=")
            if not named or t.value[x] in ("value", "path"):
                out += [t.value[k][1:-1] for k in range(x, y) if t.kind[k] == "str"]
        return out

    def type_at(self, i: int, b: int, scope, start: int, modifiers: list[str], notes, kind: str) -> int:
        t = self.t
        record = t.is_word(i, "record")
        name, k = t.value[i + 1], i + 2
        self.declared.add(i + 1)
        if t.is_p(k, "<"):
            k = t.angle(k)
        components = ""
        if record and t.is_p(k, "("):
            components = self.types(k + 1, t.close(k))
            k = t.close(k) + 1
        marks, body = {}, k
        while body < b and not t.is_p(body, "{"):
            if t.is_word(body, "extends", "implements", "permits"):
                marks[t.value[body]] = body + 1
            body = max(body + 1, t.angle(body)) if t.is_p(body, "<") else body + 1
        if body >= b:
            return i + 1
        end = t.close(body)
        constants, first = [], body + 1
        if kind == "ENUM":
            first = next((x for x in self.semicolons(body + 1, end)), end)
            for x, y in t.parts(body + 1, first):
                x, _, _ = self.head(x, y)
                if t.is_word(x):
                    constants.append(t.value[x])
                    self.declared.add(x)
        own = self.symbol(kind, name, scope, start, end, components, modifiers, "public" in modifiers, ",".join(constants) or " ".join(n for n, _, _ in notes))
        cuts = sorted([*marks.values(), body + 1])
        for word, a in marks.items():
            if word != "permits":
                stop = next(c for c in cuts if c > a) - 1
                for x, _ in t.parts(a, stop):
                    if t.is_word(x):
                        self.emit("heritage", kind=word.upper(), owner=own, target=t.dotted(x, stop)[0], line=t.line(x))
        base = next((r for n, x, y in notes if n == "RequestMapping" for r in self.literals(x, y)), "")
        info = {"name": name, "record": record, "components": components, "kind": kind, "base": base}
        self.scopes.append((body, end, own))
        if kind == "ENUM":
            for x, y in t.parts(body + 1, first):
                inner = next((z for z in range(x, y) if t.is_p(z, "{")), None)
                if inner is not None:
                    self.walk(inner + 1, t.close(inner), (*scope, name), info)
        self.walk(first, end, (*scope, name), info)
        return end + 1

    def semicolons(self, a: int, b: int) -> Iterator[int]:
        t, k = self.t, a
        while k < b:
            if t.kind[k] == "p":
                if t.value[k] in _OPEN:
                    k = t.close(k)
                elif t.value[k] == ";":
                    yield k
            k += 1

    def walk(self, a: int, b: int, scope: tuple[str, ...], owner: dict) -> None:
        i = a
        while i < min(b, self.t.end):
            i = max(i + 1, self.member(i, b, scope, owner)) if not self.t.is_p(i, ";") else i + 1

    def body(self, a: int, b: int, scope: tuple[str, ...]) -> None:
        """Types declared inside a body, local and anonymous ones' members included by their own braces."""
        t, i = self.t, a
        while i < min(b, t.end):
            if t.is_word(i, "class", "interface", "enum", "record") and t.is_word(i + 1) and not t.is_p(i - 1, ".") and (t.value[i] != "record" or t.is_p(i + 2, "(")):
                kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "CLASS"}[t.value[i]]
                i = self.type_at(i, b, scope, i, [], [], kind)
            else:
                i += 1


_BLOCK = re.compile(r"<(script|template|style)\b([^>]*)>", re.I)
_TAG = re.compile(r"<([A-Za-z][\w-]*)")


def _vue(text: str, name: str) -> tuple[list[dict], bool]:
    """A component for the file, the rows of its scripts, and what its template uses."""
    rows: list[dict] = [{"row": "symbol", "kind": "COMPONENT", "name": name, "qualified": name, "owner": "", "line": 1, "end_line": text.count("\n") + 1, "exported": True}]
    balanced, template, at = True, "", 0
    while m := _BLOCK.search(text, at):
        tag = m[1].lower()
        end = text.rfind("</template") if tag == "template" else text.lower().find(f"</{tag}", m.end())
        end = len(text) if end < m.end() else end
        inner, at = text[m.end() : end], end + 1
        if tag == "template":
            template = inner
        elif tag == "script":
            t = Text(inner, text.count("\n", 0, m.end()) + 1)
            setup = re.search(r"\bsetup\b", m[2]) is not None
            found = Script(t, ("script_setup" if setup else "script",)).read()
            balanced &= t.balanced
            for r in found:
                if r["row"] == "call" and r["target"] in MACROS:
                    rows.append({"row": "macro", "name": r["target"], "line": r["line"], "arguments": r["arguments"]})
            rows += found
    tags = _TAG.findall(template)
    pascal = lambda s: "".join(w[:1].upper() + w[1:] for w in s.split("-"))
    used: dict[str, int] = {}
    for g in tags:
        used[pascal(g)] = used.get(pascal(g), 0) + 1
    for r in [r for r in rows if r["row"] == "import"]:
        for n in filter(None, (r.get("detail") or "").split(",")):
            if used.get(pascal(n)):
                rows.append({"row": "template", "name": n, "target": r["target"], "arguments": used[pascal(n)], "line": r["line"]})
    for e in sorted(set(re.findall(r"(?:@|v-on:)([a-z][\w-]*)", template))):
        rows.append({"row": "event", "name": e, "line": 1})
    return rows, balanced


def reader_of(language: str | None, path: str | None) -> str | None:
    name = (language or "").strip().lower()
    if name in READERS.values():
        return name
    return READERS.get((path or "").replace("\\", "/").rpartition(".")[2].lower()) if not name or name not in READERS.values() else None


def read(text: str | None, language: str | None, path: str | None) -> list[dict]:
    """All rows of one text; the last is its status: ok, or the reason why it gave nothing.

    Reasons: NO_CONTENT, EMPTY, BINARY, UNSUPPORTED_LANGUAGE, UNBALANCED (its
    rows are given all the same) and FAILED (the reader could not go on).
    """
    kind = reader_of(language, path)

    def status(reason: str | None, rows: list[dict] = ()) -> list[dict]:
        return [*rows, {"row": "status", "kind": kind, "name": reason or "OK", "arguments": sum(r["row"] == "symbol" for r in rows)}]

    if text is None:
        return status("NO_CONTENT")
    if kind is None:
        return status("UNSUPPORTED_LANGUAGE")
    if not text.strip():
        return status("EMPTY")
    if "\0" in text[:8192]:
        return status("BINARY")
    try:
        if kind == "vue":
            name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[0] or "component"
            rows, balanced = _vue(text, name)
        else:
            t = Text(text, java=kind == "java")
            rows, balanced = (Java(t) if kind == "java" else Script(t)).read(), t.balanced
    except (RecursionError, IndexError):
        return status("FAILED")
    return status(None if balanced else "UNBALANCED", rows)


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW_SCHEMA = pa.schema([("file_id", pa.int64()), *[(n, _ARROW[t]) for n, t in FIELDS]])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    for b in batches:
        found = [(i, r) for i, lang, path, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "language", "file_path", "content"))) for r in read(text, lang, path)]
        columns = [pa.array([i for i, _ in found], pa.int64()), *[pa.array([r.get(n) for _, r in found], _ARROW[t]) for n, t in FIELDS]]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)


def extracted(files: DataFrame) -> DataFrame:
    """The rows of all ``files`` (file_id, language, file_path, content); each file has one status row.

    The language is taken by name in any letter case, else by the extension.
    Repeated rows give repeated rows; files with a null file_id are left out.
    """
    return files.filter("file_id is not null").select("file_id", "language", "file_path", "content").mapInArrow(_read, SCHEMA)


def symbols(rows: DataFrame) -> DataFrame:
    """(file_id, kind, name, qualified, owner, signature, modifiers, exported, line, end_line)."""
    return rows.filter("row = 'symbol'").select("file_id", "kind", "name", "qualified", "owner", "signature", "modifiers", "exported", "line", "end_line")


def relations(rows: DataFrame) -> DataFrame:
    """(file_id, predicate, subject, target, occurrences, lines): one row a logical edge, its places merged.

    predicate: IMPORTS, EXTENDS, IMPLEMENTS, CALLS, CREATES or USES (a component
    in a template).  subject: the qualified name around the place, '' for the file.
    """
    predicate = F.when(F.col("row") == "import", "IMPORTS").when(F.col("row") == "heritage", F.col("kind")).when(F.col("row") == "call", "CALLS").when(F.col("row") == "new", "CREATES").when(F.col("row") == "template", "USES")
    found = rows.withColumn("predicate", predicate).filter("predicate is not null and target is not null")
    return found.groupBy("file_id", "predicate", F.when(F.col("row").isin("import", "template"), "").otherwise(F.coalesce("owner", F.lit(""))).alias("subject"), "target").agg(F.count("*").alias("occurrences"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
