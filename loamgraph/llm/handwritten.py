"""Files nobody wrote by hand: generated, minified, vendored, or mere data.

Sources of evidence, strongest first:

1. attribute files of the repository (``attributes``), glob by glob;
2. runs of 24 words mined from other repositories: a file that consists of runs
   that also stand in a file of another project, or in one that an attribute
   file declares, is a copy of something from outside, with or without its
   notice.  A file of fewer words than a run is one when another project has
   all its words in the same order.  Any size counts; a file of comments alone
   has no words;
3. notices mined from leading comments: phrases that, over all files, stand in
   confirmed files of two projects and more (declared ones, copies, and those
   with a known notice, the seeds) and hardly in any other.  They are what
   attribute files and copies say, carried over to sources that declare nothing;
4. the shape of the text (``evidence.shape``);
5. a known notice that has no mined phrase, as in a collection too small for
   mining.

No pairs of files are formed: runs and phrases are counted, with the least and
greatest project of each, combined before the shuffle, and joined back; a
library with a third of all files is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm import attributes
from loamgraph.llm.evidence import fingerprints, leading, notice, phrases, shape, whole
from loamgraph.llm.syntax import language_of
from loamgraph.sources.tables import Scratch

#: Share of a file's runs that must stand in another project.
COPIED_SHARE = 0.8
#: A mined phrase stands in confirmed files at least so often, by Wilson's lower bound at so many standard errors.
LEAST_TRUE, ERRORS = 0.7, 1.0


def _runs(text: str | None) -> np.ndarray:
    found = fingerprints(text)
    return found if found.size else whole(text)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        heads = [leading(t) if t and t.strip() else "" for t in b.content]
        seeds = [notice(h) if h else None for h in heads]
        # a generator's notice is enough: what shape such a text has, or where else it stands, adds nothing
        shapes = [None if k else shape(t, language_of(a, p)) for t, a, p, k in zip(b.content, b.language, b.file_path, seeds)]
        runs = [_runs(t) if k != "generated" and s is None else [] for t, k, s in zip(b.content, seeds, shapes)]
        yield pd.DataFrame({"file_id": b.file_id, "project_key": b.project_key, "seed": seeds, "shape": shapes, "runs": runs, "phrases": [phrases(h) if h else [] for h in heads]})


def _two(kind: str) -> list:
    """Least and greatest project whose files of the kind have a phrase, and their number."""
    own = F.when(F.col("label") == kind, F.col("project_key"))
    return [F.min(own).alias(f"{kind}_a"), F.max(own).alias(f"{kind}_z"), F.count(own).alias(f"{kind}_n")]


def evidence(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(file_id, kind, source): each kind that a source of evidence gives a file; sources as listed above.

    source: declared, copied, notice, shape or seed.  What an attribute file
    denies of a path is left out.
    """
    read = scratch.cut(files.select("file_id", "project_key", "language", "file_path", "content").mapInPandas(_read, "file_id long, project_key string, seed string, shape string, runs array<long>, phrases array<long>").withColumn("project_key", F.coalesce("project_key", F.lit(""))))
    said = scratch.cut(attributes.declared(files))
    declared = said.filter("value").select("file_id", F.col("meaning").alias("kind"))

    runs = read.filter(F.size("runs") > 0).select("file_id", "project_key", F.explode("runs").alias("run"))
    told = runs.join(declared.select("file_id").distinct().withColumn("told", F.lit(True)), "file_id", "left")
    seen = told.groupBy("run").agg(F.min("project_key").alias("a"), F.max("project_key").alias("z"), F.max("told").alias("told")).filter("a != z or told").select("run")
    shared = runs.join(seen, "run").groupBy("file_id").agg(F.countDistinct("run").alias("shared"))
    copied = read.filter(F.size("runs") > 0).select("file_id", F.size("runs").alias("n")).join(shared, "file_id").filter(F.col("shared") >= COPIED_SHARE * F.col("n")).select("file_id", F.lit("vendored").alias("kind")).distinct()
    copied = scratch.cut(copied)

    confirmed = declared.unionByName(copied).groupBy("file_id").agg(F.min("kind").alias("known"))
    labelled = read.filter(F.size("phrases") > 0).select("file_id", "project_key", "seed", "shape", "phrases").join(confirmed, "file_id", "left").withColumn("label", F.coalesce("seed", "known", F.when(F.col("shape").isNull(), F.lit("hand"))))
    spread = labelled.select("file_id", "project_key", "label", F.explode("phrases").alias("phrase"))
    counts = spread.filter("label is not null").groupBy("phrase").agg(*_two("generated"), *_two("vendored"), F.count("*").alias("n"))
    z2 = ERRORS**2
    lower = lambda k: (F.col(k) / F.col("n") + z2 / (2 * F.col("n")) - ERRORS * F.sqrt(F.col(k) / F.col("n") * (1 - F.col(k) / F.col("n")) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    good = lambda k: (F.col(f"{k}_a") != F.col(f"{k}_z")) & (lower(f"{k}_n") >= LEAST_TRUE)
    mined = counts.select("phrase", F.when(good("generated"), "generated").when(good("vendored"), "vendored").alias("kind")).filter("kind is not null")
    noted = spread.join(mined, "phrase").groupBy("file_id").agg(F.min("kind").alias("kind"))

    of = lambda df, name: df.select("file_id", "kind", F.lit(name).alias("source"))
    own = of(copied, "copied").unionByName(of(noted, "notice")).unionByName(of(read.filter("shape is not null").select("file_id", F.col("shape").alias("kind")), "shape")).unionByName(of(read.filter("seed is not null").select("file_id", F.col("seed").alias("kind")), "seed"))
    kept = own.join(said.filter("not value").select("file_id", F.col("meaning").alias("kind")), ["file_id", "kind"], "left_anti")
    return kept.select("file_id", "kind", "source").unionByName(of(declared, "declared")).distinct()


def found(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(file_id, kind): generated, minified, data or vendored, a file once.

    Null or empty content is no case.  A repeated file_id counts once, with
    the smallest kind.  What an attribute file says of a path decides over the
    text, either way.  Copies between checkouts of one project say nothing; a
    null project is one project.
    """
    return evidence(files, scratch).groupBy("file_id").agg(F.min("kind").alias("kind"))


#: Sources of evidence, strongest first.
SOURCES = ["declared", "copied", "notice", "shape", "seed"]


def shares(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, files, share): the files that each source of evidence decides, a file by its strongest."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    best = evidence(files, scratch).groupBy("file_id").agg(F.min(F.struct(rank.alias("n"), "source")).alias("m")).groupBy(F.col("m.source").alias("source")).agg(F.count("*").alias("files"))
    return best.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy()), 4))
