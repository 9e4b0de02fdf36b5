"""Pushdown recogniser of JavaScript and TypeScript, with or without JSX."""

from __future__ import annotations

import re

from loamgraph.llm.syntax.base import ILLEGAL, PREMATURE, UNTERMINATED, Recogniser, Rejected

# The languages' punctuators and reserved words.
PUNCTUATORS = ">>>= ... <<= >>>  === !== **= >>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split()
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("|| && ?? | ^ & == != === !== < > <= >= << >> >>> + - * / % **".split())
PREFIX = frozenset("! ~ + - ++ --".split())
MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor export default in out const".split())

_SPACE = re.compile(r"(?:[ \t\v\f\xa0﻿\r\n    -   　]+|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TOKEN = re.compile(
    r"(?P<id>(?:[^\W\d]|[$]|\\u[0-9A-Fa-f]{4})(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4})*)"
    r"|(?P<num>0[xX][0-9A-Fa-f][0-9A-Fa-f_]*n?|0[bB][01][01_]*n?|0[oO][0-7][0-7_]*n?|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<p>" + "|".join(re.escape(p) for p in sorted(PUNCTUATORS, key=len, reverse=True)) + ")"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.-]*(?::[\w-]+)?")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_HASHBANG = re.compile(r"#![^\n]*")


class Ecma(Recogniser):
    """``Ecma(text, types, jsx).check()`` raises Rejected if the text is no program."""

    def __init__(self, text: str, types: bool, jsx: bool) -> None:
        super().__init__(text)
        self.types, self.jsx = types, jsx
        self.functions = 0
        self.no_in = False
        self.no_arrow_type = False
        self.ends: dict[int, tuple[str, str]] = {}
        m = _HASHBANG.match(text)
        self.e = m.end() if m else 0

    def modes(self) -> tuple:
        return (self.functions, self.no_in, self.no_arrow_type, self.in_type, self.in_condition)

    def set_modes(self, modes: tuple) -> None:
        self.functions, self.no_in, self.no_arrow_type, self.in_type, self.in_condition = modes

    # -- tokens
    def advance(self) -> None:
        self.ended = at = self.e
        m = _SPACE.match(self.x, at)
        s = m.end()
        self.nl = s > at and any(c in "\n\r  " for c in m.group())
        self.lex(s)

    def lex(self, s: int) -> None:
        x = self.x
        self.s = s
        if s >= self.n:
            self.k, self.v, self.e = "eof", "", self.n
            return
        m = _TOKEN.match(x, s)
        if m is None:
            c = x[s]
            if c == "`":
                self.k, self.v, self.e = "tmpl", "`", s + 1
                return
            if c in "\"'":
                self.lexical(UNTERMINATED, s)
            self.lexical(ILLEGAL, s)
        self.k = m.lastgroup
        self.v = m.group()
        self.e = m.end()
        if self.k == "p" and self.v == "/" and x.startswith("*", s + 1):
            self.lexical(UNTERMINATED, s)
        if self.k == "p" and self.v == "?." and self.e < self.n and x[self.e].isdigit():
            self.v, self.e = "?", s + 1
        if self.k == "num" and self.e < self.n and (x[self.e].isalpha() or x[self.e] in "_$"):
            self.lexical(ILLEGAL, s)

    def split(self, first: str) -> None:
        """Takes only ``first`` of a longer punctuator (the > of >>)."""
        self.v, self.e = first, self.s + len(first)

    def template(self) -> None:
        """A template from its back quote on."""
        depth = len(self.stack)
        while True:
            m = _TEMPLATE.match(self.x, self.e)
            at = m.end()
            if at >= self.n:
                self.lexical(UNTERMINATED, self.s)
            if self.x[at] == "`":
                self.e = at + 1
                self.advance()
                return
            if self.x[at] == "\\":
                self.lexical(UNTERMINATED, at)
            self.e = at + 2
            self.stack.append("{")
            self.advance()
            if self.types and self.in_type:
                self.type()
            else:
                self.expression()
            if not self.at("}"):
                self.fail()
            self.stack.pop()
            assert len(self.stack) == depth

    in_type = False

    # -- program and statements
    def check(self) -> None:
        self.advance()
        while self.k != "eof":
            self.statement()

    def check_expression(self) -> None:
        self.advance()
        self.expression()
        if self.k != "eof":
            self.fail()

    def semicolon(self) -> None:
        if self.at(";"):
            self.advance()
        elif not (self.at("}") or self.k == "eof" or self.nl):
            self.fail()

    def block(self) -> None:
        self.open("{")
        while not self.at("}"):
            if self.k == "eof":
                self.fail()
            self.statement()
        self.close("}")

    def peek(self):
        """Kind, value and newline flag of the token after this one."""
        saved = self.save()
        try:
            self.advance()
            return self.k, self.v, self.nl
        except Rejected:
            return "?", "", False
        finally:
            self.back(saved)

    def statement(self) -> None:
        k, v = self.k, self.v
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.advance()
            if v == "@":
                self.decorators()
                if self.word("export"):
                    return self.export()
                if self.types and self.word("abstract"):
                    self.advance()
                if not self.word("class"):
                    self.fail()
                return self.klass()
        elif k == "id":
            rule = getattr(self, "s_" + v, None) if v in STATEMENTS else None
            if rule:
                return rule()
            if v in ("var", "const"):
                if v == "const" and self.types and self.peek()[1] == "enum":
                    self.advance()
                    return self.enum()
                self.advance()
                self.bindings()
                return self.semicolon()
            if v == "let":
                kk, vv, _ = self.peek()
                if kk == "id" and vv not in ("in", "instanceof", "of") or vv in ("[", "{") and kk == "p":
                    self.advance()
                    self.bindings()
                    return self.semicolon()
            if v == "async" and self.peek()[:2] == ("id", "function") and not self.peek()[2]:
                self.advance()
                return self.function()
            if self.types and self.typed_statement(v):
                return None
            if v not in RESERVED and self.peek()[:2] == ("p", ":"):
                self.advance()
                self.advance()
                return self.statement()
        self.expression()
        self.semicolon()
        return None

    def paren_expression(self) -> None:
        self.open("(")
        self.expression()
        self.close(")")

    def s_if(self) -> None:
        self.advance()
        self.paren_expression()
        self.statement()
        if self.word("else"):
            self.advance()
            self.statement()

    def s_while(self) -> None:
        self.advance()
        self.paren_expression()
        self.statement()

    s_with = s_while

    def s_do(self) -> None:
        self.advance()
        self.statement()
        if not self.word("while"):
            self.fail()
        self.advance()
        self.paren_expression()
        if self.at(";"):
            self.advance()

    def s_for(self) -> None:
        self.advance()
        if self.word("await"):
            self.advance()
        self.open("(")
        if self.at(";"):
            pass
        else:
            self.no_in = True
            if self.k == "id" and (self.v in ("var", "const") or self.v == "let" and (self.peek()[0] == "id" and self.peek()[1] not in ("in", "of") or self.peek()[1] in ("[", "{"))):
                self.advance()
                self.bindings(loop=True)
            else:
                self.expression()
            self.no_in = False
            if self.k == "id" and self.v in ("of", "in"):
                self.advance()
                self.expression()
                self.close(")")
                return self.statement()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.close(")")
        return self.statement()

    def s_switch(self) -> None:
        self.advance()
        self.paren_expression()
        self.open("{")
        while not self.at("}"):
            if self.word("case"):
                self.advance()
                self.expression()
            elif self.word("default"):
                self.advance()
            else:
                self.fail()
            self.need(":")
            while not (self.at("}") or self.word("case") or self.word("default")):
                if self.k == "eof":
                    self.fail()
                self.statement()
        self.close("}")

    def s_try(self) -> None:
        self.advance()
        self.block()
        found = False
        if self.word("catch"):
            found = True
            self.advance()
            if self.at("("):
                self.open("(")
                self.binding_target()
                if self.types and self.eat(":"):
                    self.type()
                self.close(")")
            self.block()
        if self.word("finally"):
            found = True
            self.advance()
            self.block()
        if not found:
            self.fail()

    def s_return(self) -> None:
        if not self.functions:
            self.fail()
        self.advance()
        if not (self.at(";") or self.at("}") or self.k == "eof" or self.nl):
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.advance()
        if self.nl:
            self.fail()
        self.expression()
        self.semicolon()

    def s_break(self) -> None:
        self.advance()
        if self.k == "id" and not self.nl and self.v not in RESERVED:
            self.advance()
        self.semicolon()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.advance()
        self.semicolon()

    def s_function(self) -> None:
        self.function()

    def s_class(self) -> None:
        self.klass()

    def s_enum(self) -> None:
        if not self.types:
            self.fail()
        self.enum()

    def s_import(self) -> None:
        if self.peek()[1] in ("(", "."):
            self.expression()
            return self.semicolon()
        self.advance()
        if self.k == "str":
            self.advance()
            return self.import_tail()
        if self.types and self.word("type"):
            kk, vv, _ = self.peek()
            if kk == "id" and vv != "from" or vv in ("{", "*"):
                self.advance()
        if self.k == "id":
            self.name()
            if self.types and self.at("="):
                self.advance()
                self.expression()
                return self.semicolon()
            if self.at(","):
                self.advance()
                if not (self.at("{") or self.at("*")):
                    self.fail()
        if self.at("*"):
            self.advance()
            if not self.word("as"):
                self.fail()
            self.advance()
            self.name()
        elif self.at("{"):
            self.specifiers()
        if not self.word("from"):
            self.fail()
        self.advance()
        if self.k != "str":
            self.fail()
        self.advance()
        return self.import_tail()

    def import_tail(self) -> None:
        if self.k == "id" and self.v in ("with", "assert") and not self.nl:
            self.advance()
            self.object_literal()
        self.semicolon()

    def specifiers(self) -> None:
        self.open("{")
        while not self.at("}"):
            if self.k not in ("id", "str"):
                self.fail()
            self.advance()
            while self.k in ("id", "str"):  # type a as b
                self.advance()
            if not self.at("}"):
                self.need(",")
        self.close("}")

    def s_export(self) -> None:
        self.export()

    def export(self) -> None:
        self.advance()
        if self.at("*"):
            self.advance()
            if self.word("as"):
                self.advance()
                self.advance()
            if not self.word("from"):
                self.fail()
            self.advance()
            if self.k != "str":
                self.fail()
            self.advance()
            return self.import_tail()
        if self.types and self.word("type") and self.peek()[1] in ("{", "*"):
            self.advance()
            if self.at("*"):
                self.advance()
                if self.word("as"):
                    self.advance()
                    self.advance()
            else:
                self.specifiers()
            if self.word("from"):
                self.advance()
                self.advance()
            return self.semicolon()
        if self.at("{"):
            self.specifiers()
            if self.word("from"):
                self.advance()
                if self.k != "str":
                    self.fail()
                self.advance()
                return self.import_tail()
            return self.semicolon()
        if self.types and self.at("="):
            self.advance()
            self.expression()
            return self.semicolon()
        if self.types and self.word("as"):
            self.advance()
            self.advance()
            self.name()
            return self.semicolon()
        if self.word("default"):
            self.advance()
            if self.at("@"):
                self.decorators()
            if self.word("function"):
                return self.function(named=False)
            if self.word("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.advance()
                return self.function(named=False)
            if self.types and self.word("abstract") and self.peek()[1] == "class":
                self.advance()
            if self.word("class"):
                return self.klass()
            if self.types and self.word("interface"):
                return self.statement()
            self.assignment()
            return self.semicolon()
        if self.at("@"):
            self.decorators()
        if self.k == "id" and (self.v in ("var", "let", "const", "function", "class", "async", "import") or self.types and self.v in ("interface", "type", "enum", "declare", "abstract", "namespace", "module")):
            return self.statement()
        return self.fail()

    # -- TypeScript statements
    def typed_statement(self, v: str) -> bool:
        if v not in ("interface", "type", "declare", "abstract", "namespace", "module", "global"):
            return False
        kk, vv, nl = self.peek()
        if v in ("interface", "type"):
            if kk != "id" or nl:
                return False
            self.advance()
            self.name()
            self.type_parameters()
            if v == "type":
                self.need("=")
                self.type()
                self.semicolon()
            else:
                if self.word("extends"):
                    self.advance()
                    self.type()
                    while self.eat(","):
                        self.type()
                self.members()
            return True
        if v == "declare":
            if kk != "id" or nl:
                return False
            self.advance()
            self.statement()
            return True
        if v == "abstract":
            if vv != "class" or nl:
                return False
            self.advance()
            self.klass()
            return True
        if v == "global" and vv != "{":
            return False
        if v != "global" and (kk not in ("id", "str") or nl):
            return False
        self.advance()
        if v != "global":
            self.advance()
            while self.at("."):
                self.advance()
                self.name()
        if self.at("{"):
            self.block()
        else:
            self.semicolon()
        return True

    def enum(self) -> None:
        self.advance()
        self.name()
        self.open("{")
        while not self.at("}"):
            if self.at("["):
                self.open("[")
                self.assignment()
                self.close("]")
            elif self.k in ("id", "str"):
                self.advance()
            else:
                self.fail()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")
        self.close("}")

    # -- bindings, functions, classes
    def name(self) -> None:
        if self.k != "id" or self.v in RESERVED:
            self.fail()
        self.advance()

    def bindings(self, loop: bool = False) -> None:
        while True:
            pattern = self.at("[") or self.at("{")
            self.binding_target()
            if self.types:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.at("="):
                self.advance()
                self.assignment()
            elif pattern and not loop:
                self.fail()
            if not self.at(","):
                return
            self.advance()

    def binding_target(self) -> None:
        if self.at("["):
            self.open("[")
            while not self.at("]"):
                if self.at(","):
                    self.advance()
                    continue
                if self.at("..."):
                    self.advance()
                self.binding_element()
                if not self.at("]"):
                    self.need(",")
            self.close("]")
        elif self.at("{"):
            self.open("{")
            while not self.at("}"):
                if self.at("..."):
                    self.advance()
                    self.binding_target()
                else:
                    plain = self.k == "id" and self.v not in RESERVED
                    self.property_name()
                    if self.at(":"):
                        self.advance()
                        self.binding_element()
                    elif not plain:
                        self.fail()
                    elif self.at("="):
                        self.advance()
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
            self.close("}")
        else:
            self.name()

    def binding_element(self) -> None:
        self.binding_target()
        if self.at("="):
            self.advance()
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held

    def parameters(self) -> None:
        self.open("(")
        held, self.no_in = self.no_in, False
        while not self.at(")"):
            if self.at("@"):
                self.decorators()
            if self.types:
                while self.k == "id" and self.v in ("public", "private", "protected", "readonly", "override") and self.peek()[0] == "id":
                    self.advance()
            if self.at("..."):
                self.advance()
            if self.types and self.word("this"):
                self.advance()
            else:
                self.binding_target()
            if self.types:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.at("="):
                self.advance()
                self.assignment()
            if not self.at(")"):
                self.need(",")
        self.no_in = held
        self.close(")")

    def body(self) -> None:
        held, self.no_in = self.no_in, False
        self.functions += 1
        self.block()
        self.functions -= 1
        self.no_in = held

    def function(self, named: bool = True) -> None:
        self.advance()
        if self.at("*"):
            self.advance()
        if self.k == "id" and self.v not in RESERVED:
            self.advance()
        elif named:
            self.fail()
        self.signature_and_body(self.types)

    def signature_and_body(self, bodiless: bool = False) -> None:
        self.type_parameters()
        self.parameters()
        if self.types and self.eat(":"):
            self.return_type()
        if bodiless and not self.at("{"):
            return self.semicolon()
        return self.body()

    def decorators(self) -> None:
        while self.at("@"):
            self.advance()
            if self.at("("):
                self.paren_expression()
                continue
            self.name()
            while self.at("."):
                self.advance()
                self.advance()
            if self.at("("):
                self.arguments()

    def klass(self) -> None:
        self.advance()
        if self.k == "id" and self.v not in ("extends", "implements"):
            self.name()
        self.type_parameters()
        if self.word("extends"):
            self.advance()
            self.member_expression()
            if self.types and self.at("<"):
                self.type_arguments()
        if self.types and self.word("implements"):
            self.advance()
            self.type()
            while self.eat(","):
                self.type()
        self.open("{")
        held, self.no_in = self.no_in, False
        while not self.at("}"):
            if self.at(";"):
                self.advance()
                continue
            if self.k == "eof":
                self.fail()
            self.class_member()
        self.no_in = held
        self.close("}")

    def class_member(self) -> None:
        if self.at("@"):
            self.decorators()
        if self.word("static") and self.peek()[1] == "{" and self.peek()[0] == "p":
            self.advance()
            return self.body()
        while self.k == "id" and self.v in MODIFIERS and (self.types or self.v in ("static", "async", "get", "set", "accessor")):
            kk, vv, nl = self.peek()
            if kk in ("id", "str", "num") or kk == "p" and vv in ("[", "*", "#", "{"):
                if vv == "{" or nl and self.v in ("get", "set", "static") and not kk == "id":
                    break
                self.advance()
            else:
                break
        if self.at("*"):
            self.advance()
        if self.types and self.at("["):
            if self.attempt(self.index_signature):
                return None
        self.property_name(private=True)
        if self.types:
            self.eat("?")
            self.eat("!")
        if self.at("(") or self.types and self.at("<"):
            return self.signature_and_body(self.types)
        if self.types and self.eat(":"):
            self.type()
        if self.at("="):
            self.advance()
            self.functions += 1
            self.assignment()
            self.functions -= 1
        return self.semicolon()

    def index_signature(self) -> bool:
        self.open("[")
        self.name()
        self.need(":")
        self.type()
        self.close("]")
        if self.eat("?"):
            pass
        if self.eat(":"):
            self.type()
        self.member_end()
        return True

    def property_name(self, private: bool = False) -> None:
        if self.at("["):
            self.open("[")
            self.assignment()
            self.close("]")
        elif self.at("#") and private:
            self.advance()
            if self.k != "id":
                self.fail()
            self.advance()
        elif self.k in ("id", "str", "num"):
            self.advance()
        else:
            self.fail()

    # -- expressions
    def expression(self) -> None:
        self.assignment()
        while self.at(","):
            self.advance()
            self.assignment()

    def assignment(self) -> None:
        """One assignment expression, with conditional and arrow forms."""
        k, v = self.k, self.v
        if k == "id":
            if v == "yield" and self.functions:
                self.advance()
                if self.at("*"):
                    self.advance()
                    return self.assignment()
                if not (self.nl or self.k == "eof" or self.k == "p" and self.v in (")", "]", "}", ",", ";", ":")):
                    self.assignment()
                return None
            if v == "async":
                kk, vv, nl = self.peek()
                if not nl:
                    if kk == "id" and vv not in RESERVED and vv not in ("of", "in", "as"):
                        saved = self.save()
                        self.advance()
                        self.advance()
                        if self.at("=>"):
                            return self.arrow_body()
                        self.back(saved)
                    elif vv == "(" or self.types and vv == "<":
                        saved = self.save()
                        self.advance()
                        if self.arrow():
                            return None
                        self.back(saved)
            elif v not in RESERVED:
                saved = self.save()
                self.advance()
                if self.at("=>") and not self.nl:
                    return self.arrow_body()
                self.back(saved)
        elif k == "p" and (v == "(" or v == "<" and self.types):
            if self.arrow():
                return None
        target = self.conditional()
        if self.k == "p" and self.v in ASSIGN:
            if not target:
                self.fail()
            self.advance()
            self.assignment()
        return None

    def arrow(self) -> bool:
        """An arrow function from its parameters on, if there is one."""
        if self.at("("):
            after = self.after_parens()
            if after != ("p", "=>") and not (self.types and after == ("p", ":")):
                return False
            if after == ("p", "=>") and not self.types:
                self.parameters()
                if self.nl:
                    self.fail()
                self.arrow_body()
                return True

        def head() -> bool:
            self.type_parameters()
            self.parameters()
            if self.types and self.at(":"):
                self.advance()
                self.return_type()
            if not self.at("=>") or self.nl:
                self.fail()
            return True

        saved = self.save()
        if not self.attempt(head):
            return False
        if self.in_condition and self.types:
            # in a ? (b) : c => d the colon may belong to the condition
            def whole() -> bool:
                self.arrow_body()
                if not self.at(":"):
                    self.fail()
                return True

            if self.attempt(whole):
                return True
            if self.after_was_colon(saved):
                self.back(saved)
                return False
        self.arrow_body()
        return True

    in_condition = 0

    def after_was_colon(self, saved) -> bool:
        now = self.save()
        self.back(saved)
        try:
            return self.at("(") and self.after_parens() == ("p", ":")
        finally:
            self.back(now)

    def arrow_body(self) -> None:
        self.advance()
        if self.at("{"):
            return self.body()
        return self.assignment()

    def after_parens(self) -> tuple[str, str]:
        """The token behind the parenthesis that closes the one here."""
        start = self.s
        if start in self.ends:
            return self.ends[start]
        saved = self.save()
        opened: list[int] = []
        found = ("?", "")
        last = ("", "")
        try:
            while True:
                k, v, s = self.k, self.v, self.s
                if k == "eof":
                    break
                if k == "tmpl":
                    self.skip_template()
                    last = ("tmpl", "`")
                    self.advance()
                    continue
                if k == "p":
                    if v in ("/", "/=") and (last[0] == "p" and last[1] not in (")", "]", "}") or last[0] == "" or last[0] == "id" and last[1] in RESERVED):
                        m = _REGEX.match(self.x, s)
                        if m:
                            self.e = m.end()
                    elif v in ("(", "[", "{"):
                        opened.append(s)
                    elif v in (")", "]", "}"):
                        at = opened.pop()
                        last = (k, v)
                        self.advance()
                        if v == ")":
                            self.ends[at] = (self.k, self.v)
                        if not opened:
                            found = (self.k, self.v)
                            break
                        continue
                last = (k, v)
                self.advance()
        except (Rejected, IndexError):
            pass
        self.back(saved)
        self.ends[start] = found
        return found

    def skip_template(self) -> None:
        depth = 0
        e = self.e
        while True:
            e = _TEMPLATE.match(self.x, e).end()
            if e >= self.n:
                raise Rejected(UNTERMINATED, self.s)
            if self.x[e] == "`":
                self.e = e + 1
                return
            self.e = e + 2
            depth = 1
            self.advance()
            while depth:
                if self.k == "eof":
                    raise Rejected(PREMATURE, self.s)
                if self.k == "tmpl":
                    self.skip_template()
                elif self.v == "{":
                    depth += 1
                elif self.v == "}":
                    depth -= 1
                    if not depth:
                        e = self.e
                        break
                self.advance()

    def conditional(self) -> bool:
        target = self.binary()
        if self.at("?"):
            self.advance()
            held, self.no_in = self.no_in, False
            self.in_condition += 1
            self.assignment()
            self.in_condition -= 1
            self.no_in = held
            self.need(":")
            self.assignment()
            return False
        return target

    def binary(self) -> bool:
        target = self.unary()
        while True:
            k, v = self.k, self.v
            if k == "p" and v in BINARY or k == "id" and (v == "instanceof" or v == "in" and not self.no_in):
                self.advance()
                self.unary()
                target = False
            elif self.types and k == "id" and v in ("as", "satisfies") and not self.nl:
                self.advance()
                if self.word("const"):
                    self.advance()
                else:
                    self.type()
                target = False
            else:
                return target

    def unary(self) -> bool:
        k, v = self.k, self.v
        if k == "p" and v in PREFIX or k == "id" and v in ("typeof", "void", "delete"):
            self.advance()
            self.unary()
            return False
        if k == "id" and v == "await":
            kk, vv, nl = self.peek()
            if not nl and (kk in ("id", "str", "num", "tmpl") and vv not in ("in", "of", "instanceof", "as") or vv in ("(", "[", "{", "!", "+", "-", "<") and kk == "p"):
                self.advance()
                self.unary()
                return False
        if k == "p" and v == "<":
            if self.jsx:
                self.element()
                self.postfix_of_element()
                return False
            if self.types:
                self.advance()
                self.type()
                self.close_angle()
                self.unary()
                return False
        target = self.member_expression(calls=True)
        if self.k == "p" and self.v in ("++", "--") and not self.nl:
            if not target:
                self.fail()
            self.advance()
            return False
        return target

    def postfix_of_element(self) -> None:
        if self.at("<") and self.jsx:  # adjacent elements have no parent
            self.fail()

    def member_expression(self, calls: bool = True) -> bool:
        target = self.primary()
        while True:
            k, v = self.k, self.v
            if k == "p":
                if v == ".":
                    self.advance()
                    if self.at("#"):
                        self.advance()
                    if self.k != "id":
                        self.fail()
                    self.advance()
                    target = True
                elif v == "?.":
                    self.advance()
                    if self.at("("):
                        self.arguments()
                    elif self.at("["):
                        self.open("[")
                        self.expression()
                        self.close("]")
                    elif self.types and self.at("<"):
                        self.type_arguments()
                        self.arguments()
                    else:
                        if self.at("#"):
                            self.advance()
                        if self.k != "id":
                            self.fail()
                        self.advance()
                    target = False
                elif v == "[":
                    self.open("[")
                    held, self.no_in = self.no_in, False
                    self.expression()
                    self.no_in = held
                    self.close("]")
                    target = True
                elif v == "(" and calls:
                    self.arguments()
                    target = False
                elif v == "!" and self.types and not self.nl:
                    self.advance()
                elif v in ("<", "<<") and self.types and v == "<":
                    if not self.attempt(self.applied_types):
                        return target
                    target = False
                else:
                    return target
            elif k == "tmpl":
                self.template()
                target = False
            else:
                return target

    def applied_types(self) -> bool:
        self.type_arguments()
        if not (self.at("(") or self.k in ("tmpl", "eof") or self.k == "p" and self.v in (")", "]", "}", ",", ";", ":", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "=") or self.nl):
            self.fail()
        if self.at("("):
            self.arguments()
        return True

    def arguments(self) -> None:
        self.open("(")
        held, self.no_in = self.no_in, False
        conditions, self.in_condition = self.in_condition, 0
        while not self.at(")"):
            if self.at("..."):
                self.advance()
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.no_in, self.in_condition = held, conditions
        self.close(")")

    def primary(self) -> bool:
        """An operand; true if it may be assigned to."""
        k, v = self.k, self.v
        if k == "id":
            if v == "function":
                self.function(named=False)
                return False
            if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.advance()
                self.function(named=False)
                return False
            if v == "class":
                self.klass()
                return False
            if v == "new":
                self.advance()
                if self.at("."):
                    self.advance()
                    self.advance()
                    return False
                self.member_expression(calls=False)
                if self.types and self.at("<"):
                    self.type_arguments()
                if self.at("("):
                    self.arguments()
                return False
            if v in ("this", "null", "true", "false"):
                self.advance()
                return False
            if v == "super":
                self.advance()
                if not (self.at("(") or self.at(".") or self.at("[")):
                    self.fail()
                return False
            if v == "import":
                self.advance()
                if not (self.at("(") or self.at(".")):
                    self.fail()
                return False
            if v in RESERVED:
                self.fail()
            self.advance()
            return True
        if k in ("num", "str"):
            self.advance()
            return False
        if k == "tmpl":
            self.template()
            return False
        if k == "p":
            if v == "(":
                self.open("(")
                held, self.no_in = self.no_in, False
                conditions, self.in_condition = self.in_condition, 0
                self.expression()
                self.no_in, self.in_condition = held, conditions
                self.close(")")
                return True
            if v == "[":
                self.open("[")
                held, self.no_in = self.no_in, False
                while not self.at("]"):
                    if self.at(","):
                        self.advance()
                        continue
                    if self.at("..."):
                        self.advance()
                    self.assignment()
                    if not self.at("]"):
                        self.need(",")
                self.no_in = held
                self.close("]")
                return True
            if v == "{":
                self.object_literal()
                return True
            if v in ("/", "/="):
                m = _REGEX.match(self.x, self.s)
                if m is None:
                    self.lexical(UNTERMINATED, self.s)
                self.e = m.end()
                self.k, self.v = "regex", ""
                self.advance()
                return False
            if v == "@":
                self.decorators()
                if self.word("class"):
                    self.klass()
                    return False
            if v == "#":
                self.advance()
                if self.k == "id" and self.peek()[1] == "in":
                    self.advance()
                    return False
        self.fail()
        return False

    def object_literal(self) -> None:
        self.open("{")
        held, self.no_in = self.no_in, False
        conditions, self.in_condition = self.in_condition, 0
        while not self.at("}"):
            if self.at("..."):
                self.advance()
                self.assignment()
            else:
                self.object_member()
            if not self.at("}"):
                self.need(",")
        self.no_in, self.in_condition = held, conditions
        self.close("}")

    def object_member(self) -> None:
        while self.k == "id" and self.v in ("async", "get", "set"):
            kk, vv, _ = self.peek()
            if kk in ("id", "str", "num") or kk == "p" and vv in ("[", "*"):
                self.advance()
            else:
                break
        star = self.at("*")
        if star:
            self.advance()
        plain = self.k == "id" and self.v not in RESERVED
        self.property_name()
        if self.at("(") or self.types and self.at("<"):
            self.signature_and_body()
        elif star:
            self.fail()
        elif self.at(":"):
            self.advance()
            self.assignment()
        elif not plain:
            self.fail()
        elif self.at("="):
            self.advance()
            self.assignment()

    # -- JSX
    def element(self) -> None:
        """From the opening angle to behind the element."""
        if self.tag_name_at(self.e) is None and not self.x.startswith(">", _SPACE.match(self.x, self.e).end()):
            self.fail()
        self.e = self.element_from(self.e)
        self.advance()

    def tag_name_at(self, at: int):
        return _JSX_NAME.match(self.x, _SPACE.match(self.x, at).end())

    def element_from(self, at: int) -> int:
        """Offset behind the element whose '<' ends at ``at``; children may hold expressions."""
        open_tags: list[str] = []
        x, n = self.x, self.n
        depth = len(self.stack)
        while True:
            # at: behind a '<' of an opening tag
            self.s = at
            m = self.tag_name_at(at)
            name = m.group() if m else ""
            at = m.end() if m else _SPACE.match(x, at).end()
            if self.types and x.startswith("<", at):
                self.e = at
                self.advance()
                self.type_arguments_raw()
                at = self.s if self.k == "eof" else self.ended
            selfclosed = False
            while True:
                at = _SPACE.match(x, at).end()
                if at >= n:
                    self.k, self.s = "eof", n
                    self.fail()
                c = x[at]
                if c == ">":
                    at += 1
                    break
                if x.startswith("/>", at):
                    at += 2
                    selfclosed = True
                    break
                if not name:
                    self.broken(at)
                if c == "{":
                    at = self.container(at, spread=True)
                    continue
                m = _JSX_NAME.match(x, at)
                if m is None:
                    self.broken(at)
                at = _SPACE.match(x, m.end()).end()
                if x.startswith("=", at):
                    at = _SPACE.match(x, at + 1).end()
                    if at < n and x[at] in "\"'":
                        m = _JSX_STRING.match(x, at)
                        if m is None:
                            self.lexical(UNTERMINATED, at)
                        at = m.end()
                    elif at < n and x[at] == "{":
                        at = self.container(at)
                    elif at < n and x[at] == "<":
                        at = self.element_from(at + 1)
                    else:
                        self.broken(at)
            if not selfclosed:
                open_tags.append(name)
            elif not open_tags:
                return at
            # children until the next opening tag
            while True:
                at = _JSX_TEXT.match(x, at).end()
                if at >= n:
                    self.k, self.s = "eof", n
                    self.fail()
                c = x[at]
                if c == "{":
                    at = self.container(at, empty=True)
                elif c != "<":
                    self.broken(at)
                else:
                    after = _SPACE.match(x, at + 1).end()
                    if not x.startswith("/", after):
                        at += 1
                        break
                    m = self.tag_name_at(after + 1)
                    got = m.group() if m else ""
                    at = _SPACE.match(x, m.end() if m else after + 1).end()
                    if not x.startswith(">", at):
                        self.broken(at)
                    if got != open_tags.pop():
                        self.broken(at)
                    at += 1
                    if not open_tags:
                        assert len(self.stack) == depth
                        return at

    def broken(self, at: int) -> None:
        self.k, self.v, self.s = ("eof", "", self.n) if at >= self.n else ("p", self.x[at], at)
        self.fail()

    def container(self, at: int, spread: bool = False, empty: bool = False) -> int:
        """Offset behind the braces at ``at``."""
        self.stack.append("{")
        self.e = at + 1
        self.advance()
        if self.at("}"):
            if not empty:
                self.fail()
        else:
            if self.at("..."):
                self.advance()
            elif spread:
                self.fail()
            held = (self.no_in, self.in_condition)
            self.no_in, self.in_condition = False, 0
            self.expression()
            self.no_in, self.in_condition = held
        if not self.at("}"):
            self.fail()
        self.stack.pop()
        return self.e

    # -- types
    def type_parameters(self) -> None:
        if not (self.types and self.at("<")):
            return
        self.advance()
        while not self.at(">"):
            while self.k == "id" and self.v in ("const", "in", "out") and self.peek()[0] == "id":
                self.advance()
            self.name()
            if self.word("extends"):
                self.advance()
                self.type()
            if self.at("="):
                self.advance()
                self.type()
            if not self.at(">"):
                self.need(",")
        self.advance()

    def type_arguments(self) -> None:
        self.type_arguments_raw()

    def type_arguments_raw(self) -> None:
        self.need("<")
        self.type()
        while self.at(","):
            self.advance()
            self.type()
        self.close_angle()

    def close_angle(self) -> None:
        if self.k == "p" and self.v[0] == ">" and self.v != ">":
            self.split(">")
        self.need(">")

    def return_type(self) -> None:
        if self.word("asserts") and self.peek()[0] == "id" and not self.peek()[2]:
            self.advance()
            self.advance()
            if self.word("is"):
                self.advance()
                self.type()
            return
        if self.k == "id" and self.peek()[1] == "is" and not self.peek()[2]:
            self.advance()
            self.advance()
        self.type()

    def type(self) -> None:
        held, self.in_type = self.in_type, True
        self._type()
        self.in_type = held

    def _type(self) -> None:
        if self.word("new") or self.word("abstract") and self.peek()[1] == "new":
            if self.word("abstract"):
                self.advance()
            self.advance()
            return self.function_type()
        if self.at("<") or self.at("(") and self.after_parens() == ("p", "=>"):
            return self.function_type()
        self.union()
        if self.word("extends") and not self.nl:
            self.advance()
            self.union()
            self.need("?")
            self._type()
            self.need(":")
            self._type()
        return None

    def function_type(self) -> None:
        self.type_parameters()
        held, self.in_type = self.in_type, False
        self.parameters()
        self.in_type = held
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        if self.k == "p" and self.v in ("|", "&"):
            self.advance()
        self.prefixed_type()
        while self.k == "p" and self.v in ("|", "&"):
            self.advance()
            if self.at("(") and self.after_parens() == ("p", "=>"):
                self.function_type()
            else:
                self.prefixed_type()

    def prefixed_type(self) -> None:
        while self.k == "id" and self.v in ("keyof", "readonly", "unique", "infer"):
            kk, vv, _ = self.peek()
            if kk in ("id", "str", "num") or vv in ("(", "[", "{"):
                self.advance()
            else:
                break
        self.atom_type()
        while self.at("[") and not self.nl:
            self.open("[")
            if not self.at("]"):
                self._type()
            self.close("]")

    def atom_type(self) -> None:
        k, v = self.k, self.v
        if k == "p":
            if v == "(":
                self.open("(")
                self._type()
                return self.close(")")
            if v == "[":
                self.open("[")
                while not self.at("]"):
                    if self.at("..."):
                        self.advance()
                    if self.k == "id" and self.peek()[1] in (":", "?") and self.peek()[0] == "p":
                        self.advance()
                        self.eat("?")
                        if self.eat(":"):
                            self._type()
                    else:
                        self._type()
                        self.eat("?")
                    if not self.at("]"):
                        self.need(",")
                return self.close("]")
            if v == "{":
                if self.attempt(self.mapped_type):
                    return None
                return self.members()
            if v == "-":
                self.advance()
                if self.k != "num":
                    self.fail()
                return self.advance()
            return self.fail()
        if k in ("str", "num"):
            return self.advance()
        if k == "tmpl":
            return self.template()
        if k != "id" or v in RESERVED and v not in ("void", "null", "true", "false", "this", "typeof", "import"):
            return self.fail()
        if v == "typeof":
            self.advance()
            if self.word("import"):
                return self.atom_type()
            self.advance()
        elif v == "import":
            self.advance()
            self.open("(")
            self._type()
            self.close(")")
        else:
            self.advance()
        while self.at("."):
            self.advance()
            if self.k != "id":
                self.fail()
            self.advance()
        if self.at("<") and not self.nl:
            self.type_arguments_raw()
        return None

    def mapped_type(self) -> bool:
        self.open("{")
        if self.k == "p" and self.v in ("+", "-"):
            self.advance()
        if self.word("readonly"):
            self.advance()
        self.open("[")
        self.name()
        if not self.word("in"):
            self.fail()
        self.advance()
        self._type()
        if self.word("as"):
            self.advance()
            self._type()
        self.close("]")
        if self.k == "p" and self.v in ("+", "-"):
            self.advance()
        self.eat("?")
        if self.eat(":"):
            self._type()
        self.eat(";")
        self.close("}")
        return True

    def member_end(self) -> None:
        if self.k == "p" and self.v in (";", ","):
            self.advance()
        elif not (self.at("}") or self.nl):
            self.fail()

    def members(self) -> None:
        """The braces of an interface or object type."""
        self.open("{")
        while not self.at("}"):
            while self.k == "id" and self.v in ("readonly", "get", "set"):
                kk, vv, _ = self.peek()
                if kk in ("id", "str", "num") or vv == "[":
                    self.advance()
                else:
                    break
            if self.at("[") and self.attempt(self.index_signature):
                continue
            if self.word("new") and self.peek()[1] in ("(", "<"):
                self.advance()
            if not (self.at("(") or self.at("<")):
                held, self.in_type = self.in_type, False
                self.property_name()
                self.in_type = held
            self.eat("?")
            if self.at("(") or self.at("<"):
                self.type_parameters()
                held, self.in_type = self.in_type, False
                self.parameters()
                self.in_type = held
                if self.eat(":"):
                    self.return_type()
            elif self.eat(":"):
                self.type()
            self.member_end()
        self.close("}")


STATEMENTS = frozenset(n[2:] for n in dir(Ecma) if n.startswith("s_"))
