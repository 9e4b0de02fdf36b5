"""Pushdown recogniser of Java (to 21)."""

from __future__ import annotations

import re

from loamgraph.llm.syntax.base import ILLEGAL, UNTERMINATED, Recogniser, Rejected

# The language's punctuators, reserved words and modifiers.
PUNCTUATORS = ">>>= ... <<= >>>  >>= -> :: == != <= >= && || ++ -- += -= *= /= &= |= ^= %= << >> { } ( ) [ ] ; , . @ = < > ! ~ ? : + - * / & | ^ %".split()
RESERVED = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
PRIMITIVE = frozenset("boolean byte char short int long float double".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
BINARY = frozenset("|| && | ^ & == != < > <= >= << >> >>> + - * / %".split())

_SPACE = re.compile(r"(?:[ \t\f\r\n\x1a]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TOKEN = re.compile(
    r"(?P<id>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<num>0[xX][0-9A-Fa-f_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
    r"|(?P<str>\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n\r]|\\(?:u+[0-9A-Fa-f]{4}|[btnfrs0-7\"'\\]))*\"|'(?:[^'\\\n\r]|\\(?:u+[0-9A-Fa-f]{4}|[btnfrs\"'\\]|[0-7]{1,3}))')"
    r"|(?P<p>" + "|".join(re.escape(p) for p in sorted(PUNCTUATORS, key=len, reverse=True)) + ")"
)


class Java(Recogniser):
    """``Java(text).check()`` raises Rejected if the text is no compilation unit."""

    def __init__(self, text: str) -> None:
        super().__init__(text)
        self.ends: dict[int, tuple[str, str]] = {}

    def advance(self) -> None:
        self.ended = self.e
        s = self.s = _SPACE.match(self.x, self.e).end()
        if s >= self.n:
            self.k, self.v, self.e = "eof", "", self.n
            return
        m = _TOKEN.match(self.x, s)
        if m is None:
            self.lexical(UNTERMINATED if self.x[s] in "\"'" else ILLEGAL, s)
        self.k, self.v, self.e = m.lastgroup, m.group(), m.end()
        if self.k == "p" and self.v == "/" and self.x.startswith("*", s + 1):
            self.lexical(UNTERMINATED, s)
        if self.k == "num" and self.e < self.n and (self.x[self.e].isalpha() or self.x[self.e] in "_$"):
            self.lexical(ILLEGAL, s)

    def peek(self):
        saved = self.save()
        try:
            self.advance()
            return self.k, self.v
        except Rejected:
            return "?", ""
        finally:
            self.back(saved)

    def name(self) -> None:
        if self.k != "id" or self.v in RESERVED:
            self.fail()
        self.advance()

    def dotted(self) -> None:
        self.name()
        while self.at("."):
            self.advance()
            self.name()

    # -- declarations
    def check(self) -> None:
        self.advance()
        saved = self.save()
        if self.at("@") and self.peek()[1] != "interface":
            self.modifiers()
        if self.word("package"):
            self.advance()
            self.dotted()
            self.need(";")
        else:
            self.back(saved)
        while self.k != "eof":
            if self.at(";"):
                self.advance()
            elif self.word("import"):
                self.advance()
                if self.word("static"):
                    self.advance()
                self.name()
                while self.at("."):
                    self.advance()
                    if self.at("*"):
                        self.advance()
                        break
                    self.name()
                self.need(";")
            elif self.k == "id" and self.v in ("module", "open") and self.peek()[0] == "id":
                while not self.at("{"):
                    self.advance()
                    if self.k == "eof":
                        self.fail()
                self.open("{")
                while not self.at("}"):
                    if self.k not in ("id", "p") or self.k == "p" and self.v not in (".", ",", ";"):
                        self.fail()
                    self.advance()
                self.close("}")
            else:
                self.modifiers()
                if not self.type_declaration():
                    self.fail()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek()[1] != "interface":
                self.annotation()
            elif self.k == "id" and self.v in MODIFIERS:
                if self.v == "default" and self.peek()[1] in (":", "->") or self.v == "sealed" and self.peek()[0] != "id":
                    return
                self.advance()
            elif self.word("non"):
                saved = self.save()
                self.advance()
                if not self.at("-"):
                    self.back(saved)
                    return
                self.advance()
                if not self.word("sealed"):
                    self.back(saved)
                    return
                self.advance()
            else:
                return

    def annotation(self) -> None:
        self.advance()
        self.dotted()
        if self.at("("):
            self.open("(")
            while not self.at(")"):
                if self.k == "id" and self.peek() == ("p", "="):
                    self.advance()
                    self.advance()
                self.element_value()
                if not self.at(")"):
                    self.need(",")
            self.close(")")

    def element_value(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.at("{"):
            self.open("{")
            while not self.at("}"):
                self.element_value()
                if not self.at("}"):
                    self.need(",")
            self.close("}")
        else:
            self.conditional()

    def type_declaration(self) -> bool:
        if self.word("class"):
            self.advance()
            self.name()
            self.type_parameters()
            if self.word("extends"):
                self.advance()
                self.type()
            self.type_list("implements")
            self.type_list("permits")
            self.class_body()
        elif self.word("interface"):
            self.advance()
            self.name()
            self.type_parameters()
            self.type_list("extends")
            self.type_list("permits")
            self.class_body()
        elif self.word("enum"):
            self.advance()
            self.name()
            self.type_list("implements")
            self.enum_body()
        elif self.at("@") and self.peek()[1] == "interface":
            self.advance()
            self.advance()
            self.name()
            self.class_body()
        elif self.word("record") and self.peek()[0] == "id":
            self.advance()
            self.name()
            self.type_parameters()
            self.parameters()
            self.type_list("implements")
            self.class_body()
        else:
            return False
        return True

    def type_list(self, word: str) -> None:
        if self.word(word):
            self.advance()
            self.type()
            while self.eat(","):
                self.type()

    def enum_body(self) -> None:
        self.open("{")
        while not (self.at(";") or self.at("}")):
            self.modifiers()
            self.name()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.class_body()
            if not (self.at(";") or self.at("}")):
                self.need(",")
        while not self.at("}"):
            self.member()
        self.close("}")

    def class_body(self) -> None:
        self.open("{")
        while not self.at("}"):
            self.member()
        self.close("}")

    def member(self) -> None:
        if self.k == "eof":
            self.fail()
        if self.at(";"):
            return self.advance()
        if self.at("{"):
            return self.block()
        self.modifiers()
        if self.at("{"):
            return self.block()
        if self.type_declaration():
            return None
        self.type_parameters()
        if self.k == "id" and self.v not in RESERVED and self.peek()[1] in ("(", "{"):
            self.advance()
            if self.at("("):
                self.parameters()
            self.type_list("throws")
            return self.block()
        if self.word("void"):
            self.advance()
        else:
            self.type()
        self.name()
        if self.at("("):
            self.parameters()
            self.dims()
            self.type_list("throws")
            if self.word("default"):
                self.advance()
                self.element_value()
            if self.at(";"):
                return self.advance()
            return self.block()
        self.declarators()
        return self.need(";")

    def declarators(self) -> None:
        """From behind the first name."""
        while True:
            self.dims()
            if self.at("="):
                self.advance()
                self.initializer()
            if not self.at(","):
                return
            self.advance()
            self.name()

    def initializer(self) -> None:
        if self.at("{"):
            self.open("{")
            while not self.at("}"):
                self.initializer()
                if not self.at("}"):
                    self.need(",")
            self.close("}")
        else:
            self.expression()

    def parameters(self) -> None:
        self.open("(")
        while not self.at(")"):
            self.modifiers()
            self.type()
            while self.at("@"):
                self.annotation()
            if self.at("..."):
                self.advance()
            if self.word("this"):
                self.advance()
            else:
                self.name()
                if self.at("."):
                    self.advance()
                    self.need("this")
            self.dims()
            if not self.at(")"):
                self.need(",")
        self.close(")")

    # -- types
    def type_parameters(self) -> None:
        if not self.at("<"):
            return
        self.advance()
        while True:
            self.modifiers()
            self.name()
            if self.word("extends"):
                self.advance()
                self.type()
                while self.at("&"):
                    self.advance()
                    self.type()
            if not self.at(","):
                break
            self.advance()
        self.close_angle()

    def close_angle(self) -> None:
        if self.k == "p" and self.v[0] == ">" and self.v != ">":
            self.v, self.e = ">", self.s + 1
        self.need(">")

    def type(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.k == "id" and self.v in PRIMITIVE:
            self.advance()
        else:
            self.name()
            self.type_arguments()
            while self.at("."):
                self.advance()
                while self.at("@"):
                    self.annotation()
                self.name()
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if not self.at("<"):
            return
        self.advance()
        if not self.at(">"):
            while True:
                while self.at("@"):
                    self.annotation()
                if self.at("?"):
                    self.advance()
                    if self.k == "id" and self.v in ("extends", "super"):
                        self.advance()
                        self.type()
                else:
                    self.type()
                if not self.at(","):
                    break
                self.advance()
        self.close_angle()

    def dims(self) -> None:
        while self.at("[") and self.peek()[1] == "]" or self.at("@"):
            if self.at("@"):
                self.annotation()
                continue
            self.open("[")
            self.close("]")

    # -- statements
    def block(self) -> None:
        self.open("{")
        while not self.at("}"):
            if self.k == "eof":
                self.fail()
            self.statement(local=True)
        self.close("}")

    def paren_expression(self) -> None:
        self.open("(")
        self.expression()
        self.close(")")

    def local_head(self) -> bool:
        """A type and a name, as a local variable begins."""
        self.type()
        self.name()
        if not (self.k == "p" and self.v in ("=", ";", ",", ":", "[")):
            self.fail()
        return True

    def statement(self, local: bool = False) -> None:
        k, v = self.k, self.v
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.advance()
        elif k == "id":
            rule = getattr(self, "s_" + v, None) if v in STATEMENTS else None
            if rule and not (v == "yield" and self.peek()[1] in ("=", ".", "(", "++", "--", "[")):
                return rule()
            if v not in RESERVED and self.peek() == ("p", ":"):
                self.advance()
                self.advance()
                return self.statement()
        if local:
            self.modifiers_of_local()
            if self.k == "id" and self.v in ("class", "interface", "enum") or self.word("record") and self.peek()[0] == "id":
                if self.type_declaration():
                    return None
            if self.attempt(self.local_head):
                self.declarators()
                return self.need(";")
        self.expression_statement()
        return self.need(";")

    def modifiers_of_local(self) -> None:
        while self.at("@") or self.k == "id" and self.v in ("final", "abstract", "static", "strictfp", "sealed") and self.peek()[0] in ("id", "p") and self.v in MODIFIERS and not (self.v == "sealed" and self.peek()[0] == "p"):
            if self.at("@"):
                self.annotation()
            else:
                self.advance()

    def expression_statement(self) -> None:
        self.effect = False
        self.expression()
        if not self.effect:
            self.fail()

    effect = False

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

    def s_do(self) -> None:
        self.advance()
        self.statement()
        self.need("while")
        self.paren_expression()
        self.need(";")

    def s_for(self) -> None:
        self.advance()
        self.open("(")
        if not self.at(";"):
            self.modifiers_of_local()
            if self.attempt(self.local_head):
                if self.at(":"):
                    self.advance()
                    self.expression()
                    self.close(")")
                    return self.statement()
                self.declarators()
            else:
                self.expression_statement()
                while self.eat(","):
                    self.expression_statement()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression_statement()
            while self.eat(","):
                self.expression_statement()
        self.close(")")
        return self.statement()

    def s_switch(self) -> None:
        self.switch()
        if self.at("."):  # a switch expression used as an operand
            self.fail()

    def switch(self) -> None:
        self.advance()
        self.paren_expression()
        self.open("{")
        while not self.at("}"):
            if self.word("default"):
                self.advance()
            elif self.word("case"):
                self.advance()
                self.case_label()
                while self.eat(","):
                    self.case_label()
                if self.word("when"):
                    self.advance()
                    self.expression()
            else:
                self.fail()
            if self.at("->"):
                self.advance()
                if self.at("{"):
                    self.block()
                elif self.word("throw"):
                    self.s_throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not (self.at("}") or self.word("case") or self.word("default")):
                    if self.k == "eof":
                        self.fail()
                    self.statement(local=True)
        self.close("}")

    def case_label(self) -> None:
        if self.word("default"):
            return self.advance()
        if self.attempt(self.pattern):
            return None
        return self.conditional()

    def pattern(self) -> bool:
        if self.word("final"):
            self.advance()
        self.type()
        if self.at("("):
            self.open("(")
            while not self.at(")"):
                self.pattern()
                if not self.at(")"):
                    self.need(",")
            self.close(")")
            if self.k == "id" and self.v not in RESERVED and self.v != "when":
                self.advance()
        else:
            self.name()
        return True

    def s_try(self) -> None:
        self.advance()
        found = False
        if self.at("("):
            found = True
            self.open("(")
            while not self.at(")"):
                self.modifiers_of_local()
                if self.attempt(self.local_head):
                    self.declarators()
                else:
                    self.expression()
                if not self.at(")"):
                    self.need(";")
            self.close(")")
        self.block()
        while self.word("catch"):
            found = True
            self.advance()
            self.open("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.close(")")
            self.block()
        if self.word("finally"):
            found = True
            self.advance()
            self.block()
        if not found:
            self.fail()

    def s_return(self) -> None:
        self.advance()
        if not self.at(";"):
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.advance()
        self.expression()
        self.need(";")

    s_yield = s_throw

    def s_break(self) -> None:
        self.advance()
        if self.k == "id":
            self.name()
        self.need(";")

    s_continue = s_break

    def s_synchronized(self) -> None:
        self.advance()
        self.paren_expression()
        self.block()

    def s_assert(self) -> None:
        self.advance()
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    # -- expressions
    def expression(self) -> None:
        if self.at("(") and self.after_parens() == ("p", "->"):
            self.open("(")
            if self.k == "id" and self.peek()[1] in (",", ")"):
                self.name()
                while self.eat(","):
                    self.name()
                self.close(")")
            else:
                while not self.at(")"):
                    self.modifiers()
                    self.type()
                    if self.at("..."):
                        self.advance()
                    self.name()
                    self.dims()
                    if not self.at(")"):
                        self.need(",")
                self.close(")")
            return self.lambda_body()
        if self.k == "id" and self.v not in RESERVED and self.peek() == ("p", "->"):
            self.advance()
            return self.lambda_body()
        self.conditional()
        if self.k == "p" and self.v in ASSIGN:
            if not self.target:
                self.fail()
            self.advance()
            self.expression()
            self.effect = True
            self.target = False
        return None

    target = False

    def lambda_body(self) -> None:
        self.need("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()
        self.effect = False

    def after_parens(self) -> tuple[str, str]:
        start = self.s
        if start in self.ends:
            return self.ends[start]
        saved = self.save()
        opened: list[int] = []
        found = ("?", "")
        try:
            while self.k != "eof":
                if self.k == "p" and self.v in ("(", "[", "{"):
                    opened.append(self.s)
                elif self.k == "p" and self.v in (")", "]", "}"):
                    v, at = self.v, opened.pop()
                    self.advance()
                    if v == ")":
                        self.ends[at] = (self.k, self.v)
                    if not opened:
                        found = (self.k, self.v)
                        break
                    continue
                self.advance()
        except (Rejected, IndexError):
            pass
        self.back(saved)
        self.ends[start] = found
        return found

    def conditional(self) -> None:
        self.binary()
        if self.at("?"):
            self.advance()
            self.expression()
            self.need(":")
            if self.k == "id" and self.peek() == ("p", "->") or self.at("(") and self.after_parens() == ("p", "->"):
                self.expression()
            else:
                self.conditional()
            self.effect = self.target = False

    def binary(self) -> None:
        self.unary()
        while True:
            if self.k == "p" and self.v in BINARY:
                self.advance()
                self.unary()
            elif self.word("instanceof"):
                self.advance()
                if self.word("final"):
                    self.advance()
                if not self.attempt(self.pattern):
                    self.type()
            else:
                return
            self.effect = self.target = False

    def cast_head(self) -> bool:
        self.open("(")
        primitive = self.k == "id" and self.v in PRIMITIVE
        self.type()
        while self.at("&"):
            self.advance()
            self.type()
        self.close(")")
        if self.k in ("num", "str"):
            return True
        if self.k == "id":
            if self.v in RESERVED and self.v not in PRIMITIVE and self.v not in ("this", "super", "new", "true", "false", "null", "switch"):
                self.fail()
            return True
        if self.k == "p" and (self.v in ("(", "!", "~") or primitive and self.v in ("+", "-", "++", "--")):
            return True
        self.fail()
        return False

    def unary(self) -> None:
        if self.k == "p":
            if self.v in ("++", "--"):
                self.advance()
                self.unary()
                self.effect, self.target = True, False
                return
            if self.v in ("+", "-", "!", "~"):
                self.advance()
                self.unary()
                self.effect = self.target = False
                return
            if self.v == "(" and self.attempt(self.cast_head):
                if self.k == "id" and self.peek() == ("p", "->") or self.at("(") and self.after_parens() == ("p", "->"):
                    self.expression()
                else:
                    self.unary()
                self.effect = self.target = False
                return
        self.postfix()

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.at("."):
                self.advance()
                if self.at("<"):
                    self.type_arguments()
                if self.word("new"):
                    self.creation()
                    self.effect, self.target = True, False
                elif self.k == "id" and self.v in ("class", "this", "super"):
                    self.advance()
                    self.effect = self.target = False
                else:
                    self.name()
                    self.effect, self.target = False, True
            elif self.at("("):
                if not self.callable:
                    self.fail()
                self.arguments()
                self.effect, self.target = True, False
                self.callable = False
                continue
            elif self.at("["):
                self.open("[")
                self.expression()
                self.close("]")
                self.effect, self.target = False, True
            elif self.at("::"):
                self.advance()
                if self.at("<"):
                    self.type_arguments()
                if self.word("new"):
                    self.advance()
                else:
                    self.name()
                self.effect = self.target = False
            else:
                break
            self.callable = self.x[self.ended - 1].isalnum() or self.x[self.ended - 1] in "_$"
        if self.k == "p" and self.v in ("++", "--"):
            if not self.target:
                self.fail()
            self.advance()
            self.effect, self.target = True, False

    callable = False

    def generic_reference(self) -> bool:
        """A type that only makes sense before :: or .class."""
        self.type()
        if not (self.at("::") or self.at(".") and self.peek()[1] == "class"):
            self.fail()
        return True

    def primary(self) -> None:
        k, v = self.k, self.v
        self.effect = self.target = self.callable = False
        if k in ("num", "str"):
            return self.advance()
        if k == "p" and v == "(":
            self.paren_expression()
            self.effect, self.target = False, True
            return None
        if k == "id":
            if v == "new":
                self.creation()
                self.effect, self.target, self.callable = True, False, False
                return None
            if v == "switch":
                self.switch()
                self.effect = self.target = False
                return None
            if v in ("this", "super"):
                self.advance()
                self.callable = True
                return None
            if v in ("true", "false", "null"):
                return self.advance()
            if v == "void":
                self.advance()
                if not self.at("."):
                    self.fail()
                return None
            if v in PRIMITIVE:
                if not self.attempt(self.generic_reference):
                    self.fail()
                return None
            if v in RESERVED:
                self.fail()
            if self.peek()[1] in ("<", "[") and self.attempt(self.generic_reference):
                return None
            self.advance()
            self.target = self.callable = True
            return None
        return self.fail()

    def creation(self) -> None:
        self.advance()
        if self.at("<"):
            self.type_arguments()
        while self.at("@"):
            self.annotation()
        if self.k == "id" and self.v in PRIMITIVE:
            self.advance()
        else:
            self.name()
            self.type_arguments()
            while self.at("."):
                self.advance()
                self.name()
                self.type_arguments()
        if self.at("["):
            sized = False
            while self.at("["):
                self.open("[")
                if not self.at("]"):
                    self.expression()
                    sized = True
                self.close("]")
            if self.at("{"):
                if sized:
                    self.fail()
                self.initializer()
            elif not sized:
                self.fail()
            return
        self.arguments()
        if self.at("{"):
            self.class_body()

    def arguments(self) -> None:
        self.open("(")
        while not self.at(")"):
            self.expression()
            if not self.at(")"):
                self.need(",")
        self.close(")")


STATEMENTS = frozenset(n[2:] for n in dir(Java) if n.startswith("s_"))
