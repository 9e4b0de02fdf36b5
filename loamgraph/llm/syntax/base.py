"""What the lexers and pushdown recognisers share: tokens, the stack, verdicts."""

from __future__ import annotations

import re

#: Reasons of a rejected file.
UNTERMINATED, UNBALANCED, PREMATURE, CONFLICT, UNEXPECTED, ILLEGAL = "unterminated_literal", "unbalanced_delimiter", "premature_end", "conflict_marker", "unexpected_token", "illegal_character"

_MARKER = re.compile(r"(?:<{7}|\|{7}|={7}|>{7})(?![<|=>])")
CLOSER = {"(": ")", "[": "]", "{": "}"}


class Rejected(Exception):
    """The text is not valid: a reason and the offset where that shows."""

    def __init__(self, reason: str, at: int) -> None:
        super().__init__(reason)
        self.reason, self.at = reason, at


class Recogniser:
    """A lexer of single tokens under a stack of open delimiters.

    Subclasses set ``token`` (kind, value, start, end, newline before) in
    ``advance``.  The grammar's methods push each delimiter they open and pop
    it when its partner comes, so that a failure tells whether something was
    left open, closed wrongly or just does not fit.
    """

    def __init__(self, text: str) -> None:
        self.x, self.n = text, len(text)
        self.k = self.v = ""
        self.s = self.e = 0
        self.nl = False
        self.stack: list[str] = []
        self.ended = 0  # end of the token before
        self.failed: set[tuple] = set()

    def fail(self) -> None:
        x, s = self.x, self.s
        line = x.rfind("\n", 0, s) + 1
        if _MARKER.match(x, line) or _MARKER.match(x, s):
            raise Rejected(CONFLICT, s)
        if self.k == "eof":
            raise Rejected(PREMATURE, s)
        if self.v in (")", "]", "}") and self.k == "p" and (not self.stack or CLOSER.get(self.stack[-1]) != self.v):
            raise Rejected(UNBALANCED, s)
        raise Rejected(UNEXPECTED, s)

    def lexical(self, reason: str, at: int) -> None:
        line = self.x.rfind("\n", 0, at) + 1
        raise Rejected(CONFLICT if _MARKER.match(self.x, line) else reason, at)

    def advance(self) -> None:
        raise NotImplementedError

    def save(self):
        return (self.k, self.v, self.s, self.e, self.nl, len(self.stack), self.ended)

    def back(self, saved) -> None:
        self.k, self.v, self.s, self.e, self.nl, depth, self.ended = saved
        del self.stack[depth:]

    def at(self, v: str) -> bool:
        return self.v == v and self.k == "p"

    def word(self, v: str) -> bool:
        return self.v == v and self.k == "id"

    def eat(self, v: str) -> bool:
        if self.v == v and self.k != "str":
            self.advance()
            return True
        return False

    def need(self, v: str) -> None:
        if self.v != v or self.k == "str":
            self.fail()
        self.advance()

    def open(self, v: str) -> None:
        if self.v != v or self.k != "p":
            self.fail()
        self.stack.append(v)
        self.advance()

    def close(self, v: str) -> None:
        if self.v != v or self.k != "p":
            self.fail()
        self.stack.pop()
        self.advance()

    def modes(self) -> tuple:
        """What else than the position decides whether a rule fits here."""
        return ()

    def set_modes(self, modes: tuple) -> None:
        pass

    def attempt(self, rule):
        """The rule's result, or None with nothing consumed if it fails.

        A failure is remembered by rule, position and modes, so that text which
        is read again, nested in other attempts, does not fail all over again:
        n nested attempts cost n squared steps at most, not 2 to the n.
        """
        modes = self.modes()
        here = (rule.__name__, self.s, self.v, *map(bool, modes))
        if here in self.failed:
            return None
        saved = self.save()  # a rule closes only what it opened, so the stack is cut back to its depth
        try:
            return rule()
        except Rejected:
            self.back(saved)
            self.set_modes(modes)
            self.failed.add(here)
            return None
