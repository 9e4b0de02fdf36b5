"""Text cut off by field limits or in transfer.

What the whole corpus says decides over each text's last words:

* the vocabulary as a prefix table (a trie by its paths): a last word that
  hardly occurs, but as a proper prefix of known words, is half a word;
* how often the last one to three words end a sentence, or a text, and how
  often they go on: words that always go on do not end a text, and what many
  different texts end with is an ending;
* length evidence: lengths, in characters or bytes, at which a source has many
  more texts than chance puts there;
* marks of a cut, broken characters, open brackets and code fences.

Every text is read and tokenised once.  Statistics are counted over all
documents, pre-aggregated in each task and combined in the shuffle; only
endings that are in doubt are joined to them.  All lines are bounds of
confidence on shares of different texts, so they mean the same for any number
of documents and however often a text is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.endings import LONGEST_WORD, ORDER, counts, ending, text_hash
from loamgraph.sources.tables import Scratch

#: Share of ends below which words go on, and with a mark; width, in standard errors, of its bounds
#: above and below (one text alone says neither).
GOES_ON, GOES_ON_MARKED, ABOVE, BELOW = 0.15, 0.4, 1.0, 3.0
#: A word is half a word if it stands, and ends texts, at most this share as often as longer ones.
HALF_WORD = 0.01
#: Least length of a field limit, times the texts at the lengths around, how many are around at
#: either side, the texts that are thought to be there before any is seen, and the surprise
#: (negative log of chance) that makes a limit: 1 in 100,000.
LIMIT_CHARS, LIMIT_TIMES, AROUND, PRIOR, SURPRISE = 64, 8, 12, 2, 11.5
#: Characters of texts whose statistics a task combines before it passes them on.
TOGETHER = 2_000_000

SCAN = "doc_id long, source string, hash long, chars long, bytes long, asked boolean, marked boolean, sure boolean, path boolean, last string, k1 long, k2 long, k3 long, p2 long, p3 long, key long, word string, a long, b long, bits long"


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in SCAN.split(", ")])


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    """A batch with the other columns null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _statistics(texts: list[str], hashes: list[int]) -> Iterator[pa.RecordBatch]:
    (keys, ends, goes, bits), words = counts(texts, hashes)
    if len(keys):
        yield _batch({"key": keys, "a": ends, "b": goes, "bits": bits})
    if words:
        yield _batch({"word": list(words), "a": [n for n, _ in words.values()], "bits": [_signed(b) for _, b in words.values()]})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _SCHEMA.names[:15]
    held: list[str] = []
    hashes: list[int] = []
    size = 0
    for b in batches:
        rows = []
        for i, s, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "text"))):
            h = text_hash(t)
            held.append(t)
            hashes.append(h)
            size += len(t)
            if size >= TOGETHER:
                yield from _statistics(held, hashes)
                held, hashes, size = [], [], 0
            e = ending(t)
            k = e["keys"] if e else [0] * (2 * ORDER - 1)
            rows.append((i, s, _signed(h), len(t), len(t.encode("utf-8", "replace")), e is not None, bool(e and e["marked"]), bool(e and e["sure"]), bool(e and e["path"]), e["last"] if e else "", *k))
        if rows:
            yield _batch(dict(zip(names, zip(*rows))))
    yield from _statistics(held, hashes)


def _texts(bits: Column, n: Column) -> Column:
    """About how many different texts set ``bits``: the number of texts that leaves as many bits unset."""
    unset = 64 - F.bit_count(bits)
    return F.when(unset > 0, F.least(n.cast("double"), -64.0 * F.log(unset / 64.0))).otherwise(n.cast("double"))


def _bound(share: Column, n: Column, errors: float) -> Column:
    """Wilson's bound, above or below (negative), of a share seen in n cases."""
    z2 = errors**2
    return (share + z2 / (2 * n) + errors * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _going_on(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id) of the endings that go on elsewhere, by the longest context that decides.

    Texts that end in a context speak for an ending, unless they are so few of
    the places where its last word may stand that cuts explain them, or end in
    an unfinished path, which says how often paths are cut.
    """
    numbers = stats.filter("key is not null").select("key", "a", "b", "bits")
    each = F.posexplode(F.arrays_zip(F.array("k1", "k2", "k3").alias("key"), F.array(F.lit(0), "p2", "p3").alias("before")))
    contexts = asked.select("doc_id", "marked", "hash", "path", each.alias("n", "c")).select("doc_id", "marked", "hash", "path", "n", "c.key", "c.before").filter("key != 0")
    places = numbers.select(F.col("key").alias("before"), (F.col("a") + F.col("b")).alias("places"))
    closing = contexts.select("key", "before", "hash", "path").distinct().groupBy("key", "before").agg(F.max("path").alias("path"), (F.count("*") - 1).alias("n")).join(places, "before", "left")
    closing = closing.select("key", F.when(F.col("path") | (F.col("n") <= HALF_WORD * F.coalesce("places", F.lit(0))), 0).otherwise(F.col("n")).alias("others"))
    seen = contexts.drop("path", "before").join(numbers, "key", "left").fillna(0, ["a", "b", "bits"]).join(closing, "key")
    ends, total = F.col("a") + F.col("others"), F.nullif(F.col("a") + F.col("b") + F.col("others"), F.lit(0))
    n = F.nullif(F.least(total.cast("double"), _texts(F.col("bits"), F.col("a") + F.col("b")) + F.col("others")), F.lit(0.0))
    line = F.when(F.col("marked"), GOES_ON_MARKED).otherwise(GOES_ON)
    share = ends / total
    says = F.when(_bound(share, n, ABOVE) < line, True).when(_bound(share, n, -BELOW) >= line, False)
    return seen.select("doc_id", "n", says.alias("on")).filter("`on` is not null").groupBy("doc_id").agg(F.max_by("on", "n").alias("on")).filter("`on`").select("doc_id", F.lit(True).alias("goes_on"))


def _half_words(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """(last) of the last words that are halves of other words."""
    lasts = asked.filter("last != ''").groupBy(F.col("last").alias("word")).agg((F.countDistinct("hash") - 1).alias("others"))
    words = stats.filter("word is not null").select("word", F.col("a").alias("texts"), "bits")
    # at most as many numbers as a word may have characters
    sizes = sorted(r[0] for r in lasts.select(F.length("word")).distinct().collect())
    if not sizes:
        return lasts.select(F.col("word").alias("last"), F.lit(True).alias("half"))
    at = F.filter(F.array(*map(F.lit, sizes)), lambda n: n < F.length("word"))
    longer = words.select("texts", "bits", "word", F.explode(at).alias("n")).select(F.expr("substring(word, 1, n)").alias("word"), "texts", "bits")
    longer = longer.join(lasts.select("word"), "word", "left_semi").groupBy("word").agg(F.sum("texts").alias("longer"), F.bit_or("bits").alias("in"))
    judged = longer.filter(F.bit_count("in") > 1).join(lasts, "word").join(words.select("word", "texts"), "word", "left")
    few = HALF_WORD * F.col("longer")
    return judged.filter((F.coalesce("texts", F.lit(0)) <= few) & (F.col("others") <= F.greatest(few, F.lit(1)))).select(F.col("word").alias("last"), F.lit(True).alias("half"))


def _limits(texts: DataFrame) -> DataFrame:
    """(source, unit, size) at which a source has more different texts than chance allows."""
    one = texts.select("source", "chars", "bytes", "hash").distinct()
    sizes = one.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("size")))).alias("z")).groupBy("source", "z.unit", "z.size").agg(F.count("*").alias("n"))
    # a source has as many sizes as its texts have lengths; each is seen by the sizes around it, so ranges of sizes are windows of their own
    span, halo = 4096, 2 * AROUND
    home = F.floor(F.col("size") / span)
    near = F.array_distinct(F.array(home, F.floor((F.col("size") - halo) / span), F.floor((F.col("size") + halo) / span)))
    spread = sizes.withColumn("home", home).withColumn("block", F.explode(near))
    w = Window.partitionBy("source", "unit", "block").orderBy("size").rangeBetween(-AROUND, AROUND)
    around = (F.sum("n").over(w) - F.col("n") + PRIOR) / (2 * AROUND)
    n = F.col("n")
    rare = n * F.log(n / F.col("around")) - n + F.col("around") >= SURPRISE
    return spread.withColumn("around", around).filter("block = home").filter((F.col("size") >= LIMIT_CHARS) & (n >= LIMIT_TIMES * F.col("around")) & rare).select("source", "unit", "size")


def cut_texts(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, reason) of the documents that were cut, a document once.

    reason: mark, half_word, limit or goes_on.  Null and empty texts are not
    cut.  A null source is a source of its own.  Repeated rows and repeated
    texts count once wherever a number of texts matters; shares of occurrences
    stay as they are if the whole corpus is repeated.  Runs of more than
    ``LONGEST_WORD`` word characters are no words, so they are never half a word.
    """
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    scan = scratch.cut(docs.mapInArrow(_scan, SCAN))
    stats = scratch.cut(scan.filter("doc_id is null").groupBy("key", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_or("bits").alias("bits")))
    texts = scan.filter("doc_id is not null")
    asked = texts.filter("asked")
    limits = _limits(texts)
    of = lambda unit, col: limits.filter(F.col("unit") == unit).select("source", F.col("size").alias(col), F.lit(True).alias(f"at_{unit}"))

    judged = asked.join(_going_on(asked, stats), "doc_id", "left").join(_half_words(asked, stats), "last", "left").join(of("c", "chars"), ["source", "chars"], "left").join(of("b", "bytes"), ["source", "bytes"], "left")
    reason = F.when(F.col("sure"), "mark").when(F.col("half"), "half_word").when(F.col("at_c") | F.col("at_b"), "limit").when(F.col("goes_on"), "goes_on")
    return judged.select("doc_id", "source", reason.alias("reason")).filter("reason is not null").groupBy("doc_id").agg(F.min(F.struct("source", "reason")).alias("m")).select("doc_id", "m.*")


def rates(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(source, texts, cut, rate) by source."""
    src = F.coalesce("source", F.lit("")).alias("source")
    total = documents.filter("doc_id is not null and text is not null").groupBy(src).agg(F.countDistinct("doc_id").alias("texts"))
    cut = found.groupBy("source").agg(F.count("*").alias("cut"))
    return total.join(cut, "source", "left").select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("texts"), 6).alias("rate"))
