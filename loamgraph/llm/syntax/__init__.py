"""Recognisers of source languages: a lexer and a pushdown stack each."""

from __future__ import annotations

import sys

from loamgraph.llm.syntax import plain, vue
from loamgraph.llm.syntax.base import ILLEGAL, Rejected
from loamgraph.llm.syntax.ecma import Ecma
from loamgraph.llm.syntax.java import Java

#: Languages by file extension or name.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "typescript": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "javascript": "javascript", "jsx": "jsx", "java": "java", "vue": "vue", "py": "python", "python": "python", "json": "json"}


def language_of(language: str | None, path: str | None) -> str | None:
    """The language by name, or, where that is null or blank, by the path's extension."""
    return LANGUAGES.get(stated(language, path))


def stated(language: str | None, path: str | None) -> str | None:
    """The language's name, else the path's extension, in lower case; None without either."""
    name = (language or "").strip().lower()
    if not name:
        name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return name or None


#: Frames (about 200 bytes each) up to which nesting is followed: some 400,000 brackets.
DEEPEST = 4_000_000


class NotJudged(Exception):
    """The text nests deeper than can be followed here, so it got no verdict."""


def verdict(text: str | None, language: str | None) -> tuple[str | None, int | None]:
    """(reason, line) if the text is not valid in the language, else (None, None).

    Null text and unknown languages give no verdict.  The empty text is valid
    in every language but JSON.  Raises NotJudged where the nesting needs more
    than ``DEEPEST`` frames, or more memory than there is.
    """
    if text is None or language is None:
        return None, None
    text = text[1:] if text.startswith("﻿") else text
    try:
        try:
            if language == "json":
                plain.check_json(text)
            elif not text.strip():
                pass
            elif language == "python":
                plain.check_python(text)
            elif language == "java":
                Java(text).check()
            elif language == "vue":
                vue.check(text)
            else:
                Ecma(text, language in ("typescript", "tsx"), language in ("jsx", "tsx")).check()
        except RecursionError:
            if sys.getrecursionlimit() >= DEEPEST:
                raise NotJudged from None
            sys.setrecursionlimit(min(DEEPEST, sys.getrecursionlimit() * 10))
            return verdict(text, language)
        except MemoryError:
            if language == "python":  # the parser's own stack: the language's parser rejects it
                raise Rejected(ILLEGAL, 0) from None
            raise NotJudged from None
    except Rejected as e:
        return e.reason, text.count("\n", 0, e.at) + 1
    return None, None
