"""Filling fixed-capacity containers with texts, whole where they fit.

Texts are measured in tokens of a public tokenizer.  The global histogram of
sizes has at most as many entries as a container has tokens, so the driver
plans on it alone: which sizes share a container, and how often.  Texts get
their places by their rank among texts of the same size.

Two plans are built on the histogram:

* ``fill_plan`` fills each container from the largest size down with whatever
  still fits, all containers of one filling at once;
* ``length_buckets`` chooses bucket bounds by dynamic programming so that
  padding to the bound is least, with token-budget batches inside each bucket.
  Batches of one bucket leave capacity modulo bound unused, whatever the
  bounds are, so the containers come from the first plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.sources.tables import Scratch

#: Folder and name of the tokenizer's vocabulary; a parameter of each function.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Fixed value: the published word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in stretches of this many characters, cut at white space before a word.
STRETCH = 20_000


@lru_cache(maxsize=4)
def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _stretch(text: str, at: int) -> int:
    """Where the stretch that begins at ``at`` ends."""
    n = len(text)
    end = min(n, at + STRETCH)
    while end < n and not (text[end] == " " and text[end - 1].isalnum() and end + 1 < n and text[end + 1].isalpha()):
        end += 1
    return end


def tokens_in(text: str | None, path: str) -> int:
    """Number of tokens; null and empty texts have none.

    A long text is encoded in stretches that end before a space and a word,
    where the pattern always splits, so the sum is that of the whole text.
    """
    if not text:
        return 0
    enc, total, at, n = encoder(path), 0, 0, len(text)
    while at < n:
        end = _stretch(text, at)
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def sized(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each document row; repeated ids keep the largest."""
    path = f"{tokenizers.rstrip('/')}/{vocabulary}"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "tokens": [tokens_in(t, path) for t in b.text]})

    return documents.filter("doc_id is not null").select("doc_id", "text").mapInPandas(measure, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def cut_bytes(text: str, path: str, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(from, to, tokens) in UTF-8 bytes of each piece of a text; the stretches joined are the text."""
    enc, sizes, at, n = encoder(path), [], 0, len(text)
    while at < n:
        end = _stretch(text, at)
        sizes += [len(b) for b in enc.decode_tokens_bytes(enc.encode_ordinary(text[at:end]))]
        at = end
    ends = np.cumsum([0, *sizes])
    marks = [*range(0, len(sizes), capacity), len(sizes)]
    return [(int(ends[a]), int(ends[z]), z - a) for a, z in zip(marks, marks[1:])]


def offsets(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, from_byte, to_byte, tokens): where texts longer than a container are cut.

    Bytes are those of the text in UTF-8; of repeated ids the longest text
    counts, ties by the greater text.  Texts of no more bytes than a container
    has tokens fit, so they never leave the scan.
    """
    path = f"{tokenizers.rstrip('/')}/{vocabulary}"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *c) for i, t in zip(b.doc_id, b.text) for cuts in [cut_bytes(t, path, capacity)] if len(cuts) > 1 for k, c in enumerate(cuts)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "from_byte", "to_byte", "tokens"])

    long = documents.filter("doc_id is not null and text is not null").filter(F.octet_length("text") > capacity)
    return long.groupBy("doc_id").agg(F.max(F.struct(F.length("text"), "text")).alias("m")).select("doc_id", "m.text").mapInPandas(cut, "doc_id long, piece long, from_byte long, to_byte long, tokens long")


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens): a text longer than a container becomes full pieces and a rest."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0))
    out = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return out.select("doc_id", "piece", F.when(F.col("piece") < last, F.lit(capacity)).otherwise(F.col("tokens") - last * capacity).cast("long").alias("tokens"))


def fill_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(size, texts of it in one container)]) of each filling.

    A filling starts with the largest size left and takes the largest that
    fits, again and again; it is repeated until one of its sizes runs out.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if size > 0:
            left[size] += n
    plan = []
    while True:
        have = np.nonzero(left)[0]
        if not have.size:
            return plan
        room, filling = capacity, []
        top = int(have[-1])
        while top > 0:
            k = int(np.searchsorted(have, min(room, top), side="right")) - 1
            if k < 0:
                break
            size = int(have[k])
            n = min(room // size, int(left[size]))
            filling.append((size, n))
            room -= n * size
            top = size - 1
            if room <= 0:
                break
        times = min(int(left[s]) // n for s, n in filling)
        for s, n in filling:
            left[s] -= times * n
        plan.append((times, filling))


def containers(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, container_id).

    ``items`` (doc_id, piece, tokens <= capacity) are written once, counted by
    size (at most ``capacity`` numbers reach the driver), and ranked within
    their size in slices by hash, so that one size with a third of all texts
    is spread.  Texts without tokens share container 0.
    """
    spark = items.sparkSession
    items = scratch.cut(items)
    slices = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = placed.groupBy("tokens", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("tokens").orderBy("slice")) - F.col("n")).select("tokens", "slice", "before")
    histogram = {r.tokens: r.n for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    taken: dict[int, int] = {}
    base, rows = 0, []
    for times, filling in fill_plan(histogram, capacity):
        for size, n in filling:
            start = taken.get(size, 0)
            rows.append((size, start, start + times * n, base, n))
            taken[size] = start + times * n
        base += times
    places = spark.createDataFrame(rows, "tokens long, lo long, hi long, base long, per long")
    place = places.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "per"))).alias("places"))
    rank = F.row_number().over(Window.partitionBy("tokens", "slice").orderBy("doc_id", "piece")) - 1
    ranked = placed.withColumn("r", rank).join(before, ["tokens", "slice"]).withColumn("rank", F.col("r") + F.col("before"))
    # bounded by the capacity: at most that many sizes, and a filling uses up one of them
    found = ranked.join(F.broadcast(place), "tokens", "left")
    own = F.get(F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), F.lit(0))
    return found.withColumn("p", own).select("doc_id", "piece", "tokens", F.coalesce(F.col("p.base") + F.floor((F.col("rank") - F.col("p.lo")) / F.col("p.per")), F.lit(0)).cast("long").alias("container_id"))


def length_buckets(histogram: dict[int, int], buckets: int = 16, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(over, up_to, texts, padding) of the buckets with the least padding to their upper bound."""
    n = np.zeros(capacity + 1)
    for size, k in histogram.items():
        if 0 < size <= capacity:
            n[size] += k
    count, weight = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    b = np.arange(capacity + 1)
    # cost[a, b]: sizes a+1..b padded to b
    cost = b[None, :] * (count[None, :] - count[:, None]) - (weight[None, :] - weight[:, None])
    cost[np.tril_indices(capacity + 1, -1)] = np.inf
    best, back = cost[0].copy(), []
    for _ in range(buckets - 1):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    bounds, at = [], int(np.max(np.nonzero(n)[0])) if n.any() else 0
    for step in reversed(back):
        bounds.append((int(step[at]), at))
        at = int(step[at])
    bounds.append((0, at))
    return [(a, z, int(count[z] - count[a]), int(cost[a, z])) for a, z in reversed(bounds) if z > a and count[z] > count[a]]


def batches(buckets: list[tuple[int, int, int, int]], capacity: int = CAPACITY) -> int:
    """Containers of a plan in which each holds texts of one bucket, at its bound."""
    return sum(-(-texts // (capacity // up_to)) for _, up_to, texts, _ in buckets)


def budget_batches(histogram: dict[int, int], buckets: list[tuple[int, int, int, int]], capacity: int = CAPACITY) -> int:
    """Containers of a plan in which each holds texts of one bucket, by their own sizes, from the largest down."""
    total = 0
    for over, up_to, _, _ in buckets:
        room = 0
        for size in sorted((s for s in histogram if over < s <= up_to), reverse=True):
            n = histogram[size]
            fit = min(n, room // size)
            room, n = room - fit * size, n - fit
            if n:
                per = capacity // size
                opened = -(-n // per)
                total += opened
                room = capacity - (n - (opened - 1) * per) * size
    return total
