"""Source files that do not parse.

Each language has a lexer and a pushdown recogniser (``syntax``): the stack of
open delimiters and the grammar's states find unterminated literals,
unbalanced delimiters, premature ends, conflict markers and anything else that
has no place in the language.  Python text that passes its lexer is then parsed
exactly.  Files are judged one by one, so the scan needs no shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.syntax import NotJudged, language_of, stated, verdict

SCHEMA = "file_id long, project_key string, source_id string, language string, judged boolean, reason string, line int"


def _judged(text: str | None, language: str | None) -> tuple[bool, str | None, int | None]:
    try:
        return text is not None and language is not None, *verdict(text, language)
    except NotJudged:
        return False, None, None


def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    for b in batches:
        langs = [language_of(a, p) for a, p in zip(b.language, b.file_path)]
        found = [_judged(t, lang) for t, lang in zip(b.content, langs)]
        named = [lang or stated(a, p) for lang, a, p in zip(langs, b.language, b.file_path)]
        yield pd.DataFrame({"file_id": b.file_id, "project_key": b.project_key, "source_id": b.source_id, "language": named, "judged": [j for j, _, _ in found], "reason": [r for _, r, _ in found], "line": pd.array([n for _, _, n in found], dtype="Int32")})


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, project_key, source_id, language, judged, reason, line) of each file.

    reason and line are null for files that parse and for those not judged:
    null content, languages without a recogniser, nesting beyond
    ``syntax.DEEPEST``.  The language is taken by name in any letter case, else
    by the path's extension; an unknown one is given in lower case, null if
    there is none.  The empty text is valid but in JSON.  Repeated rows give
    repeated verdicts.
    """
    return files.select("file_id", "project_key", "source_id", "language", "file_path", "content").mapInPandas(judge, SCHEMA)


def rates(found: DataFrame) -> DataFrame:
    """(project_key, source_id, language, files, judged, broken, rate), a file_id once.

    rate: broken of the judged; null where none was.
    """
    one = found.groupBy("project_key", "source_id", "language", "file_id").agg(F.max("judged").alias("judged"), F.max(F.col("reason").isNotNull()).alias("bad"))
    out = one.groupBy("project_key", "source_id", "language").agg(F.count("*").alias("files"), F.count(F.when(F.col("judged"), 1)).alias("judged"), F.count(F.when(F.col("bad"), 1)).alias("broken"))
    return out.withColumn("rate", F.round(F.try_divide("broken", "judged"), 6))
