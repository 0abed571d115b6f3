"""Lines repeated across the documents of one source, and their removal.

Method: per-source line-count tables that grow by deltas.  The state holds, for
each source, the number of its articles and, for each line of it, the number of
articles with that line.  A new partition of articles gives a delta of both; the
merge adds them, and comparing a line's standing before and after tells which
lines crossed the threshold, up or down (a growing source can also drop a line
below its share).  Only documents with a newly crossed line are built again.
The queries go through that: the articles arrive in ``DELTAS`` partitions, each is
merged into the stored state, and places and contents built before stand unless
one of their lines crossed.

A line is compared after dropping HTML tags, decoding entities, lower-casing,
reducing white space to single blanks and replacing each run of the digits 0-9
by one 0.  It is kept as a 64-bit hash; at a billion lines of one source two
different lines share one with a chance of a few per cent, at a million never.

Nulls: null or empty content has no lines but the article counts for its
source; a null id or source is left out.  Blank lines are numbered but never
repeated lines.  A line that stands twice in an article counts once for it and
both places are reported.  Rows of one id count once.  Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from rankspark.sources.shared import stored

MIN_ARTICLES = 8
MIN_PER_CENT = 6
#: Partitions in which a table of articles is merged.
DELTAS = 2
_TAG = re.compile(r"<[^>]*>")
_DIGITS = re.compile(r"[0-9]+")


def plain_line(line: str) -> str:
    if "<" in line:
        line = _TAG.sub("", line)
    if "&" in line:
        line = html.unescape(line)
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        article, source, number, line = [], [], [], []
        for i, feed, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for k, text in enumerate(content.split("\n"), 1):
                text = plain_line(text)
                if text:
                    article.append(i)
                    source.append(feed)
                    number.append(k)
                    line.append(xxhash.xxh3_64_intdigest(text))
        yield pa.RecordBatch.from_arrays([pa.array(article, pa.int64()), pa.array(source, pa.string()), pa.array(number, pa.int32()), pa.array(np.array(line, np.uint64).view(np.int64))], names=["article_id", "source", "line_no", "line"])


def article_lines(articles: DataFrame) -> DataFrame:
    """(article_id, source, line_no, line) of each line that isn't blank; from (article_id, source, content)."""
    rows = articles.select("article_id", "source", "content").where("article_id is not null and source is not null and content is not null")
    return rows.mapInArrow(_lines, "article_id long, source string, line_no int, line long")


@dataclass
class LineState:
    """Tables of one state: articles (source, article_id), totals (source, articles), counts (source, line, articles)."""

    articles: DataFrame
    totals: DataFrame
    counts: DataFrame


def repeated(state: LineState, min_articles: int = MIN_ARTICLES, min_per_cent: int = MIN_PER_CENT) -> DataFrame:
    """(source, line) of the lines over both thresholds."""
    often = state.counts.where(F.col("articles") >= min_articles)
    totals = state.totals.withColumnRenamed("articles", "total")
    return often.join(totals, "source").where(F.col("articles") * 100 >= F.col("total") * min_per_cent).select("source", "line")


def merge(state: LineState, ids: DataFrame, lines: DataFrame) -> LineState:
    """The state with a new partition: ``ids`` (source, article_id) of all its articles, ``lines`` from :func:`article_lines`.

    Articles that the state has already are no news: a redelivered article
    changes no count.
    """
    ids = ids.select("source", "article_id").where("article_id is not null and source is not null").distinct()
    again = ids.join(state.articles, ["source", "article_id"], "left_semi")
    # the lines, many times the ids, meet the known articles only if there are any among the new
    if again.head(1):
        ids, lines = (t.join(again, ["source", "article_id"], "left_anti") for t in (ids, lines))
    add = lambda old, fresh, *keys: old.unionByName(fresh).groupBy(*keys).agg(F.sum("articles").alias("articles"))
    return LineState(
        state.articles.unionByName(ids),
        add(state.totals, ids.groupBy("source").agg(F.count("*").alias("articles")), "source"),
        add(state.counts, line_counts(lines), "source", "line"),
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """(source, line, articles) of one partition; the first step is by article, so a hot line is counted in parts."""
    return lines.groupBy("source", "line", "article_id").agg(F.lit(1).alias("once")).groupBy("source", "line").agg(F.count("*").alias("articles"))


def first_state(ids: DataFrame, lines: DataFrame) -> LineState:
    """The state of a first partition: nothing to compare with, so counts come from the delta alone."""
    ids = ids.select("source", "article_id").where("article_id is not null and source is not null").distinct()
    return LineState(ids, ids.groupBy("source").agg(F.count("*").alias("articles")), line_counts(lines))


def kept(state: LineState) -> LineState:
    """The state in the shared folder, from which the next merge goes on."""
    return LineState(*(stored(table, "lines-state")[0] for table in (state.articles, state.totals, state.counts)))


def crossings(before: LineState, after: LineState, **limits: int) -> DataFrame:
    """(source, line, repeated): lines whose standing a merge changed, and their new standing."""
    was, now = repeated(before, **limits), repeated(after, **limits)
    up = now.join(was, ["source", "line"], "left_anti").withColumn("repeated", F.lit(True))
    return up.unionByName(was.join(now, ["source", "line"], "left_anti").withColumn("repeated", F.lit(False)))


def places(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(article_id, line_no) of each place of a wanted (source, line)."""
    return lines.join(wanted.select("source", "line"), ["source", "line"], "left_semi").select("article_id", "line_no").distinct()


def rebuild(articles: DataFrame, lines: DataFrame, touched: DataFrame, now: DataFrame) -> DataFrame:
    """(article_id, content) without repeated lines, of the ``touched`` (article_id) only.

    ``now`` are all repeated lines.  The others' contents stand as built before.
    """
    # an article has as many numbers here as repeated lines at most
    out = places(lines, now).groupBy("article_id").agg(F.collect_list("line_no").alias("out"))
    keep = F.filter(F.split("content", "\n", -1), lambda _, k: ~F.array_contains(F.coalesce("out", F.array().cast("array<int>")), (k + 1).cast("int")))
    rows = articles.select("article_id", "content").join(touched.select("article_id").distinct(), "article_id", "left_semi").dropDuplicates(["article_id"])
    return rows.join(out, "article_id", "left").select("article_id", F.array_join(keep, "\n").alias("content"))


def with_line(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """(article_id) of the articles that have a line of ``changed``."""
    return lines.join(changed.select("source", "line"), ["source", "line"], "left_semi").select("article_id").distinct()


@dataclass
class Step:
    """One merge: the lines known before and those that came, the lines that crossed and those repeated now."""

    before: DataFrame
    came: DataFrame
    crossed: DataFrame
    now: DataFrame


def merged(articles: DataFrame, deltas: int = DELTAS) -> Iterator[Step]:
    """The articles, from (article_id, source, content), merged into the state partition by partition."""
    part = F.pmod(F.xxhash64("article_id"), F.lit(deltas)).cast("int")
    lines, _ = stored(article_lines(articles).withColumn("part", part), "lines", "part")
    state, now = None, None
    for k in range(deltas):
        ids = articles.select("source", "article_id").where(part == k)
        came = lines.where(F.col("part") == k).drop("part")
        after = kept(first_state(ids, came) if state is None else merge(state, ids, came))
        crossed = repeated(after).withColumn("repeated", F.lit(True)) if state is None else crossings(state, after)
        crossed, _ = stored(crossed, "crossed")
        up = crossed.where("repeated").select("source", "line")
        if now is not None:
            up = now.join(crossed.where("not repeated"), ["source", "line"], "left_anti").unionByName(up)
        state, now = after, up
        yield Step(lines.where(F.col("part") < k).drop("part"), came, crossed, now)


def repeated_places(articles: DataFrame) -> DataFrame:
    """(article_id, line_no): each place of a line repeated excessively in its source."""
    keys, found = ["source", "line"], None
    for step in merged(articles):
        new = step.came.join(step.now, keys, "left_semi")
        if found is not None:
            # what stood stays but for lines that fell; lines that rose are looked up in what came before
            fell, rose = step.crossed.where("not repeated"), step.crossed.where("repeated")
            new = found.join(fell, keys, "left_anti").unionByName(step.before.join(rose, keys, "left_semi")).unionByName(new)
        found = new
    return found.select("article_id", "line_no").distinct()


def cleaned(articles: DataFrame) -> DataFrame:
    """(article_id, content) of every article, repeated lines removed; null content stays null."""
    built = None
    for step in merged(articles):
        # old documents with a crossed line, and new ones with a repeated line
        lines = step.before.join(step.crossed, ["source", "line"], "left_semi").unionByName(step.came.join(step.now, ["source", "line"], "left_semi"))
        touched, _ = stored(lines.select("article_id").distinct(), "touched")
        new = rebuild(articles, step.before.unionByName(step.came), touched, step.now)
        built, _ = stored(new if built is None else built.join(touched, "article_id", "left_anti").unionByName(new), "built")
    rows = articles.select("article_id", "content").dropDuplicates(["article_id"])
    # content may be null: whether an article was built is told by its row, not by its text
    return rows.join(built.withColumnRenamed("content", "built").withColumn("was", F.lit(True)), "article_id", "left").select("article_id", F.when(F.col("was"), F.col("built")).otherwise(F.col("content")).alias("content"))
