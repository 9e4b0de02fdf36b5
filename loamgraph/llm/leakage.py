"""Evaluation texts inside documents.

Template canonicalisation: words that many items share stay, everything else
becomes a typed placeholder (number, identifier of digits and letters, name).
Windows of canonical words are hash-joined together with the value of one of
their slots; a joined window counts if its slots are consistent, that is, at
most one differs.  A re-parameterised item has the windows but not the values,
so it falls out here.  Pairs with enough consistent windows are checked by
aligning the words of item and document.

Texts are read once and never shuffled: the scan asks a Bloom filter of the
items' keys (its size has a bound, its errors fall out of the join) and passes
on, for the few documents with enough hits, the hits and the words around them.
The items themselves are rows of a table throughout; the driver sees only the
filter and the words of templates, of which there are at most
1 / ``TEMPLATE_SHARE`` times the mean number of words of an item.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch

#: Words a window; consistent windows a pair needs to be checked.
WINDOW, LEAST_WINDOWS = 6, 2
#: A passage counts from this score on: one for each word, less two for each altered, added or dropped one
#: (twenty words with one altered have 17), and only if that is this share of the words it spans; scenarios
#: merely built alike, in which every third or fourth word differs, have far less.  Of the words that are not
#: the template's this share has to be the same.
LEAST_SCORE, LEAST_WORDS, LEAST_EVEN, LEAST_KEPT = 17, 20, 0.6, 0.6
#: Bits of the filter: so many a key, as long as this number (16 MB) lasts.
BITS_A_KEY, MOST_BITS, PROBES = 16, 1 << 27, 3
#: A word in at least this share of the items, and in five, belongs to templates.
TEMPLATE_SHARE = 0.02
#: A sentence in more than this share of the items, and in two, is one they share.
SHARED_SENTENCE = 0.01
#: Words that a scan works on at once, and those that a passage may have more than its item.
TOGETHER, SLACK = 200_000, 40
#: Stands between stretches of a document; no word.
GAP = "\u0001"

_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_BROKEN = re.compile(r"([A-Za-z])-[ \t]*\r?\n[ \t|>/*#;%-]*(?=[a-zA-Z])")
_LINE = re.compile(r"\r?\n")
#: A word is a run of letters and digits, in scripts without spaces one character.
_SINGLE = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")
_DASHES = str.maketrans({"‐": "-", "‑": "-", "‒": " ", "–": " ", "—": " ", "­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None})


def words_of(text: str | None) -> list[str]:
    """The words of a text without letter case, markup, escaping, punctuation and layout."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    t = unicodedata.normalize("NFKC", t.translate(_DASHES))
    if "\\" in t:
        t = _ESCAPES.sub(lambda m: chr(int(m[1], 16)), t)
        t = t.replace("\\n", "\n").replace("\\t", " ").replace("\\r", " ").replace('\\"', '"').replace("\\/", "/")
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "-" in t:
        t = _BROKEN.sub(r"\1", t)
    return _WORD.findall(t.casefold())


_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！])\s*")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    return [w for w in map(words_of, _SENTENCE.split(text or "")) if w]


def _hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


_TYPED = {"N": _hash("\u0001number"), "I": _hash("\u0001identifier"), "W": _hash("\u0001name")}


class Codes(dict):
    """Word -> (form, value): a template word has no value, any other a typed form."""

    def __init__(self, fixed: frozenset[str]) -> None:
        super().__init__()
        self.fixed = fixed

    def __missing__(self, w: str) -> tuple[int, int]:
        if len(self) > 1 << 20:
            self.clear()
        if w in self.fixed:
            code = (_hash(w), 0)
        else:
            code = (_TYPED["N" if w.isdigit() else "I" if any(c.isdigit() for c in w) else "W"], _hash(w) | 1)
        self[w] = code
        return code


_PLACES = np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def windows(texts: list[list[str]], codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slot of a window: the place of each window in all words together, its key, and all words' values.

    Windows lie within one text; a window has a key for each of its slots.
    """
    coded = [codes[w] for t in texts for w in t]
    if len(coded) < WINDOW:
        return
    form = np.array([f for f, _ in coded], np.uint64)
    value = np.array([v for _, v in coded], np.uint64)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    n = len(form) - WINDOW + 1
    inside = np.arange(n) + WINDOW <= ends[:n]
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + form[i : i + n]
            h ^= h >> np.uint64(31)
        for i in range(WINDOW):
            v = value[i : i + n]
            at = np.flatnonzero(inside & (v != 0))
            yield at, (h[at] ^ _PLACES[i]) * np.uint64(0xFF51AFD7ED558CCD) ^ v[at] * np.uint64(0xC4CEB9FE1A85EC53), value


def probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bits of each key; ``bits`` is a power of two."""
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:PROBES]:
        with np.errstate(over="ignore"):
            x = (keys ^ keys >> np.uint64(33)) * np.uint64(salt)
        yield (x >> np.uint64(20)) & np.uint64(bits - 1)


def contained(keys: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in probes(keys, len(filter_) * 64):
        ok &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def passage(item: list[str], doc: list[str], slots: frozenset[int] = frozenset()) -> tuple[int, int, float]:
    """Best score of a passage of the item in the document, the item's words it spans, and the share of ``slots`` kept in it.

    ``slots``: places of the item's words that do not belong to its template.
    """
    best, span, kept = 0, 0, 1.0
    blocks = difflib.SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks()
    score = start = a = b = 0
    same: set[int] = set()
    for m in blocks:
        if not m.size:
            continue
        score -= 2 * max(m.a - a, m.b - b)
        if score <= 0:
            score, start = 0, m.a
        score += m.size
        a, b = m.a + m.size, m.b + m.size
        same.update(range(m.a, a))
        if score > best:
            best, span = score, a - start
            here = [p for p in slots if start <= p < a]
            kept = sum(p in same for p in here) / len(here) if here else 1.0
    return best, span, kept


def _passage_in(item: list[str], doc: list[str], slots: frozenset[int] = frozenset()) -> tuple[int, int, float]:
    """``passage`` in a stretch of any length, by overlapping parts, so that time grows with the length only."""
    reach = len(item) + SLACK
    if len(doc) <= 4 * reach:
        return passage(item, doc, slots)
    return max(passage(item, doc[i : i + 4 * reach], slots) for i in range(0, len(doc) - 2 * reach, 2 * reach))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, t in zip(b.item_id, b.text):
            parts = sentences(t)
            whole = _hash(" ".join(w for p in parts for w in p)) >> 1
            rows += [(i, whole, n, " ".join(p)) for n, p in enumerate(parts)]
        if rows:
            yield pd.DataFrame(rows, columns=["item_id", "whole", "n", "sentence"])


def scenarios(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item_id, whole, words) of each item without the sentences that items share.

    ``whole`` is equal for items of equal words; such items count once where
    items are counted, so each keeps its scenario.  An item that has nothing
    else keeps the sentences that the fewest items have.
    """
    parts = scratch.cut(items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text")).mapInPandas(_split, "item_id long, whole long, n int, sentence string"))
    total = parts.select("whole").distinct().count()
    seen = parts.groupBy("sentence").agg(F.countDistinct("whole").alias("times"))
    each = parts.join(seen, "sentence").groupBy("item_id", "whole").agg(F.min("times").alias("least"), F.sort_array(F.collect_list(F.struct("n", "times", "sentence"))).alias("parts"))
    most = F.greatest("least", F.lit(max(1, int(SHARED_SENTENCE * total))))
    kept = F.filter("parts", lambda p: p["times"] <= most)
    return scratch.cut(each.select("item_id", "whole", F.array_join(F.transform(kept, lambda p: p["sentence"]), " ").alias("words")))


def template_words(scen: DataFrame) -> frozenset[str]:
    """The words that belong to templates rather than to one item."""
    one = scen.groupBy("whole").agg(F.min("words").alias("words"))
    least = max(5, TEMPLATE_SHARE * one.count())
    words = one.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return frozenset(r.w for r in words.select("w").collect() if r.w and not any(c.isdigit() for c in r.w))


def _filter_of(side: DataFrame) -> np.ndarray:
    """The Bloom filter of the items' keys: at most ``MOST_BITS``, filled by the executors."""
    n = side.select("key").distinct().count()
    bits = 1 << max(10, min(MOST_BITS, n * BITS_A_KEY).bit_length())
    bits = min(bits, MOST_BITS)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(np.concatenate([*probes(b.key.to_numpy(np.int64).astype(np.uint64), bits)]))
            if len(at):
                yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).astype(np.int64)})

    out = np.zeros(bits // 64, np.uint64)
    rows = side.select("key").mapInPandas(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint64)
    return out


def leaks(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, item_id): the document contains a passage of the item.

    A passage: the item's whole scenario or at least twenty words in sequence,
    but for a few altered, added or dropped words.  Sentences that items share
    (instructions, closing questions) do not count.  Words are those of any
    script; in scripts without spaces a character is one.  Null and empty texts
    match nothing; repeated documents give a pair once, of an item_id with
    several texts the smallest counts, and items of equal text are all named.
    """
    spark = documents.sparkSession
    scen = scenarios(items, scratch)
    known = spark.sparkContext.broadcast(template_words(scen))
    longest = (scen.agg(F.max(F.size(F.split("words", " ")))).first()[0] or 0) + SLACK

    def item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(known.value)
        for b in batches:
            for i, t in zip(b.item_id, b.words):
                for at, keys, values in windows([t.split(" ")], codes):
                    if len(at):
                        yield pd.DataFrame({"item_id": i, "key": keys.astype(np.int64), "item_values": [values[k : k + WINDOW].astype(np.int64).tolist() for k in at]})

    side = scratch.cut(scen.mapInPandas(item_rows, "item_id long, key long, item_values array<long>"))
    wanted = spark.sparkContext.broadcast(_filter_of(side))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(known.value)
        ids: list[int] = []
        texts: list[list[str]] = []
        held = 0
        for b in batches:
            for i, t in zip(b.doc_id, b.text):
                w = words_of(t)
                if len(w) >= WINDOW:
                    ids.append(i)
                    texts.append(w)
                    held += len(w)
                if held >= TOGETHER:
                    yield from near_hits(ids, texts, codes)
                    ids, texts, held = [], [], 0
        yield from near_hits(ids, texts, codes)

    def near_hits(ids: list[int], texts: list[list[str]], codes: Codes) -> Iterator[pd.DataFrame]:
        found: dict[int, list[tuple[int, int]]] = {}
        starts = np.cumsum([0, *map(len, texts)])
        values = None
        for at, keys, values in windows(texts, codes):
            ok = contained(keys, wanted.value)
            for k, p in zip(keys[ok].astype(np.int64).tolist(), at[ok].tolist()):
                found.setdefault(int(np.searchsorted(starts, p, "right")) - 1, []).append((p, k))
        rows = []
        for n, hits in found.items():
            places = sorted({p for p, _ in hits})
            if len(places) < LEAST_WINDOWS:
                continue
            near: list[str] = []
            end, last = 0, int(starts[n])
            for p in places:  # the words that a passage with this window can reach
                lo, hi = max(0, p - last - longest), min(len(texts[n]), p - last + WINDOW + longest)
                if lo > end and near:
                    near.append(GAP)
                near += texts[n][max(lo, end) : hi]
                end = max(end, hi)
            rows.append((ids[n], " ".join(near), [{"pos": p - last, "key": k, "doc_values": values[p : p + WINDOW].astype(np.int64).tolist()} for p, k in hits]))
        if rows:  # an empty frame has no types to convert
            yield pd.DataFrame(rows, columns=["doc_id", "near", "hits"])

    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    near = scratch.cut(docs.mapInPandas(scan, "doc_id long, near string, hits array<struct<pos: int, key: long, doc_values: array<long>>>"))
    hits = near.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    differs = F.size(F.filter(F.zip_with("doc_values", "item_values", lambda x, y: x != y), lambda v: v))
    # written first, so that few pairs can be sent to the words instead of the words to the pairs
    pairs = hits.join(side, "key").filter(differs <= 1).groupBy("doc_id", "item_id").agg(F.countDistinct("pos").alias("n")).filter(F.col("n") >= LEAST_WINDOWS).select("doc_id", "item_id")
    pairs = scratch.cut(pairs)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for doc, item in zip(b.near, b.words):
                scenario, text = item.split(" "), doc.split(" ")
                slots = frozenset(n for n, w in enumerate(scenario) if w not in known.value)
                score, span, kept = _passage_in(scenario, text, slots)
                ok.append(score >= min(LEAST_SCORE, 0.8 * len(scenario)) and span >= min(LEAST_WORDS, len(scenario)) and score >= LEAST_EVEN * span and kept >= LEAST_KEPT)
            if any(ok):
                yield b[ok][["doc_id", "item_id"]]

    return pairs.join(near.select("doc_id", "near"), "doc_id").join(scen.select("item_id", "words"), "item_id").mapInPandas(check, "doc_id long, item_id long").distinct()
