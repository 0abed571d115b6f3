"""Texts that were cut off before their author's end.

Method: intact texts are cut artificially to make positives; hashed logistic
regression is trained on the closing characters and words, on punctuation and
open quotes, and on the distance of the length to its source's limit; then every
record is scored.

1. Site matter at the end of texts is found by counting: a line that stands in
   at least ``SITE_ARTICLES`` articles and ``SITE_PER_CENT`` % of its source's
   articles (in small sources, fewer that are a larger share; compared without
   markup, case and digits) is the site's, and so is a last line that only begins
   like one.  All lines are counted, whatever their number and length, by hash;
   the text of a site's line is looked up in one article that has it.
2. What is left after the site's lines, markup, and leftovers of a cut (ellipsis
   marks, half tags, half entities, a broken character) is the author's text.
   Positions where suspiciously many texts of a source end are its limits.
3. Of ``SAMPLE`` records at most (a bound on training, chosen by hash of the id),
   those that end neither at a limit nor in a leftover count as intact.  Each is
   also cut once inside a sentence, within a word or at a blank, with leftovers
   or without, at a limit or not, and that copy is a positive.
4. A record is cut off if its probability is 0.5 or more.  Every record is
   scored on its whole text.

Nulls: null, empty and blank contents are no cases, nor are texts without any
line of their own; they count as articles of their source.  A null id or source
is left out.  Rows of one id give the same score and count once.  Empty tables
give empty results, extra columns are ignored.  With no intact record to learn
from nothing is found.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from rankspark.llm.site_lines import plain_line
from rankspark.sources.shared import stored

SITE_ARTICLES, SITE_PER_CENT = 8, 2
#: In small sources fewer articles do, if they are a larger share.
SMALL_ARTICLES, SMALL_PER_CENT = 3, 10
LIMIT_ARTICLES, LIMIT_PER_CENT = 6, 2
SAMPLE = 20_000
FEATURES = 1 << 14
#: Probability from which an intact record is doubted after the first fit.
DOUBT = 0.4
SEED = 42

_BREAK = re.compile(r"\n|<br\s*/?>|</(?:p|div|li|h\d)\s*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_HALF_TAG = re.compile(r"</?(?:[a-zA-Z][^<>]*)?$")
_HALF_ENTITY = re.compile(r"&(?:#\d{0,6}|#?[a-z]{0,7})$")
_MARK = re.compile(r"\s*(?:[\[(]\s*(?:…|\.\.\.)\s*[\])]|…|\.\.\.)$")
_OPENING, _CLOSING = "(„«“", ")“»”"
_END = ".!?。！？"
_AFTER_END = "\"'”“»’)]"


def pieces(content: str) -> list[tuple[int, str]]:
    """(number of characters up to the line's end, the line as it stands) of the lines that aren't blank."""
    out, at = [], 0
    for m in _BREAK.finditer(content):
        raw = content[at : m.start()]
        if raw and not raw.isspace():
            out.append((at + len(raw), raw))
        at = m.end()
    raw = content[at:]
    if raw and not raw.isspace():
        out.append((at + len(raw), raw))
    return out


def line_text(raw: str) -> str:
    text = _TAG.sub("", raw) if "<" in raw else raw
    if "&" in text:
        # half an entity stays as it is: decoding would make a character of it
        cut = _HALF_ENTITY.search(text)
        text = html.unescape(text[: cut.start()]) + cut[0] if cut else html.unescape(text)
    return text.strip()


class Site:
    """The lines of one source that are the site's."""

    def __init__(self, lines: list[str]):
        self.lines = set(lines)
        self.hashes = {line_hash(x) for x in lines}
        self.ordered = sorted(lines)

    def begins(self, plain: str) -> bool:
        """Whether a line of the site begins with ``plain``."""
        at = bisect.bisect_left(self.ordered, plain)
        return len(plain) >= 6 and at < len(self.ordered) and self.ordered[at].startswith(plain)


def line_hash(plain: str) -> int:
    return xxhash.xxh3_64_intdigest(plain) - (1 << 63)


def own_text(content: str, site: Site) -> tuple[list[tuple[int, str]], str, str, int] | None:
    """The lines before the author's last one (as they stand), that one's text, the leftover of a cut that follows it
    (or ""), and where it ends; none without such a line.  Lines are taken from the end, as far as needed."""
    lines, last = pieces(content), True
    while lines:
        plain = plain_line(lines[-1][1])
        if plain:
            if plain not in site.lines and not (last and site.begins(plain)):
                break
            last = False
        lines.pop()
    if not lines:
        return None
    end, raw = lines.pop()
    text, left = line_text(raw), ""
    for name, pattern in (("tag", _HALF_TAG), ("entity", _HALF_ENTITY)):
        cut = pattern.search(text)
        if cut:
            left, text = name, text[: cut.start()].rstrip()
    if text.endswith("�"):
        left, text = "broken", text.rstrip("�").rstrip()
    mark = _MARK.search(text)
    if mark and mark.start():
        left, text = "mark", text[: mark.start()]
    return lines, text, left, end


def texts_of(lines: list[tuple[int, str]], most: int | None = None) -> list[str]:
    """The texts of lines with something to read, the last ``most`` of them."""
    out = []
    for _, raw in reversed(lines):
        if len(out) == most:
            break
        if plain_line(raw):
            out.append(line_text(raw))
    return out[::-1]


def _class(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else " " if c.isspace() else c if ord(c) < 0x2100 else "*"


def features(lines: list[str], left: str, at_limit: bool) -> list[str]:
    """Names of the features that hold: closing characters and words, punctuation, length to limit."""
    text = lines[-1]
    body = text.rstrip()
    shape = "".join(map(_class, body[-4:]))
    words = body.split()
    last = words[-1] if words else ""
    # the end behind closing quotes, brackets and symbols
    core = body
    while core and (core[-1] in _AFTER_END or _class(core[-1]) in "*️‍") and len(body) - len(core) < 8:
        core = core[:-1].rstrip()
    final = _class(core[-1]) if core else "none"
    ended = core[-1:] in _END and bool(core)
    out = [f"final={final}", f"shape={shape[-1:]}", f"shape2={shape[-2:]}", f"shape4={shape}", f"ended={ended}", f"left={left}", f"left={bool(left)}:ended={ended}", f"limit={at_limit}", f"limit={at_limit}:ended={ended}"]
    # short words and abbreviations by name; of longer ones only the end, which many share
    out.append("last=" + (re.sub(r"\d+", "0", last.lower()) if len(last) <= 4 or last[-1:] == "." and len(last) <= 8 else "*" + last[-1:]))
    out.append(f"lastlen={min(len(last), 4)}:{final}")
    out.append(f"words={min(len(words), 12)}:{ended}")
    # a quote or bracket that stays open; the dot of an abbreviation has its word before it
    opened = sum(body.count(c) for c in "(„«") - sum(body.count(c) for c in ")»")
    out.append(f"open={opened > 0}:{ended}")
    out.append(f"straight={body.count(chr(34)) % 2}:{ended}")
    line = " ".join("".join(map(_class, w)) for w in words[:2])
    out.append("begin=" + re.sub(r"(.)\1+", r"\1", line)[:12])
    out.append("first=" + (words[0].lower() if words and len(words[0]) <= 3 else ""))
    if len(words) <= 8:
        out.append("form=" + re.sub(r"(.)\1+", r"\1", " ".join("".join(map(_class, w)) for w in words))[:40])
    previous = lines[-2].rstrip() if len(lines) > 1 else ""
    out.append(f"previous={_class(previous[-1]) if previous else 'none'}:{ended}")
    return out


def cut_copy(lines: list[str], rng: np.random.Generator) -> tuple[list[str], str, bool] | None:
    """An intact text cut inside a sentence of one of its longer lines: lines, leftover, at a limit."""
    long_ = [k for k, t in enumerate(lines) if len(t.split()) >= 6]
    if not long_:
        return None
    k = long_[int(rng.integers(len(long_)))]
    text = lines[k]
    for _ in range(8):
        # a third of the cuts fall near the start of the line: short last lines occur
        at = int(rng.integers(2, max(3, len(text) // 3 if rng.random() < 0.33 else len(text))))
        if rng.random() < 0.35:
            at = text.rfind(" ", 0, at) if text.rfind(" ", 0, at) > 0 else at
        head, tail = text[:at].rstrip(), text[at:]
        closed = head.rstrip(_AFTER_END)[-1:]
        # inside a sentence: the next one doesn't begin here (a dot before a small letter or digit ends none)
        rest = tail.lstrip(_AFTER_END + " ")
        inside = rest and not (closed and closed in _END and not (rest[0].islower() or rest[0].isdigit()))
        if head and inside:
            left = ("", "", "", "", "", "mark", "mark", "tag", "entity", "broken")[int(rng.integers(10))]
            return lines[:k] + [head], left, bool(rng.random() < 0.4)
    return None


def finished_copy(lines: list[str], rng: np.random.Generator) -> tuple[list[str], str, bool] | None:
    """An intact text cut between two sentences, or as it is, with a leftover and limit drawn as for cut copies: no case."""
    ends = [(k, m.end()) for k, t in enumerate(lines) if len(t.split()) >= 6 for m in re.finditer(r"[.!?][\"'”“»’)]*(?=\s+[^\W\d_a-zà-ÿ]|$)", t)]
    if not ends:
        return None
    k, at = ends[int(rng.integers(len(ends)))]
    left = ("", "mark", "tag", "entity")[int(rng.integers(4))]
    return lines[:k] + [lines[k][:at]], left, bool(rng.random() < 0.4)


_PARSED = "article_id long, source string, lines array<long>, ends array<int>, last string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each article the hashes of its lines, where they end, and the plain form of the last."""
    for batch in batches:
        lines, ends, last = [], [], []
        for content in batch.column(2).to_pylist():
            plain = [(end, p) for end, raw in pieces(content) if (p := plain_line(raw))]
            lines.append([line_hash(p) for _, p in plain])
            ends.append([end for end, _ in plain])
            last.append(plain[-1][1] if plain else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array(last, pa.string())], names=["article_id", "source", "lines", "ends", "last"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, line = [], []
        for feed, content, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for plain in {p for _, raw in pieces(content) if (p := plain_line(raw)) and line_hash(p) in wanted}:
                source.append(feed)
                line.append(plain)
        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(line, pa.string())], names=["source", "line"])


def site_matter(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source, site): the lines of each source that are the site's, one below the other; a source has at most a hundredfold of the lines of an
    article, by ``SITE_PER_CENT``."""
    totals = rows.groupBy("source").agg(F.count("*").alias("total"))
    lines = parsed.select("article_id", "source", F.explode(F.array_distinct("lines")).alias("line"))
    counts = lines.groupBy("source", "line").agg(F.count("*").alias("n"), F.min("article_id").alias("article_id")).where(F.col("n") >= min(SITE_ARTICLES, SMALL_ARTICLES))
    share = lambda n, per_cent: (F.col("n") >= n) & (F.col("n") * 100 >= F.col("total") * per_cent)
    often = counts.join(totals, "source").where(share(SITE_ARTICLES, SITE_PER_CENT) | share(SMALL_ARTICLES, SMALL_PER_CENT))
    # one article for each line, or for several: few against all
    wanted = often.groupBy("source", "article_id").agg(F.collect_list("line").alias("wanted"))
    named = rows.where("content is not null").join(wanted, ["source", "article_id"]).select("source", "content", "wanted").mapInArrow(_named, "source string, line string")
    return named.distinct().groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("site"))


def _sites(column: pa.Array) -> Iterator[Site]:
    known: dict[str | None, Site] = {}
    for site in column.to_pylist():
        if site not in known:
            known[site] = Site(site.split("\n") if site else [])
        yield known[site]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, end = [], []
        for feed, lines, ends, last, site in zip(*(batch.column(k).to_pylist() for k in range(4)), _sites(batch.column(4))):
            k = len(lines) - 1
            if k >= 0 and lines[k] not in site.hashes and site.begins(last):
                k -= 1
            while k >= 0 and lines[k] in site.hashes:
                k -= 1
            if k >= 0:
                source.append(feed)
                end.append(ends[k])
        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(end, pa.int32())], names=["source", "end"])


def limits(parsed: DataFrame) -> DataFrame:
    """(source, limits): lengths at which suspiciously many texts of a source end; at most 100 / ``LIMIT_PER_CENT`` each."""
    ends = parsed.select("source", "lines", "ends", "last", "site").mapInArrow(_ends, "source string, `end` int")
    counts = ends.groupBy("source", "end").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    often = counts.where(F.col("n") >= LIMIT_ARTICLES).join(totals, "source").where(F.col("n") * 100 >= F.col("total") * LIMIT_PER_CENT)
    return often.groupBy("source").agg(F.collect_list("end").alias("limits"))


def _featured(share: float):
    schema = pa.schema([("article_id", pa.int64()), ("label", pa.float64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"article_id": [], "label": [], "words": []}
            for i, content, site, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sites(batch.column(2)), batch.column(3).to_pylist()):
                own = own_text(content, site)
                if own is None:
                    continue
                before, text, left, end = own
                near = any(m - 1 <= end <= m + 1 for m in marks or ())
                draw = zlib.crc32(f"{SEED} {i}".encode()) / 2**32 < share
                rows["article_id"].append(i)
                # intact: what ends neither in a leftover nor at a limit
                rows["label"].append(0.0 if draw and not left and not near else None)
                rows["words"].append(features([*texts_of(before, 1), text], left, near))
                if draw and not left and not near:
                    lines = [*texts_of(before), text]
                    rng = np.random.default_rng([SEED, i & 0x7FFFFFFFFFFFFFFF])
                    for label, copy in ((1.0, cut_copy(lines, rng)), (0.0, finished_copy(lines, rng) if rng.random() < 0.3 else None)):
                        if copy:
                            rows["article_id"].append(None)
                            rows["label"].append(label)
                            rows["words"].append(features(*copy))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def scored(articles: DataFrame) -> DataFrame:
    """(article_id, probability) of each article with a text of its own, from (article_id, source, content)."""
    rows = articles.select("article_id", "source", "content").where("article_id is not null and source is not null")
    parsed, _ = stored(rows.where("content is not null").mapInArrow(_parsed, _PARSED), "lines")
    site, _ = stored(site_matter(rows, parsed), "site")
    marks, _ = stored(limits(parsed.join(site, "source", "left")), "limits")
    share = min(1.0, SAMPLE / max(1, rows.count()))
    known = rows.where("content is not null").join(site, "source", "left").join(marks, "source", "left")
    made = known.select("article_id", "content", "site", "limits").mapInArrow(_featured(share), "article_id long, label double, words array<string>")
    made, _ = stored(made, "features")
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True)
    # the bounded sample is small: one partition, so that a round of the fit is one task
    train, _ = stored(hashing.transform(made.where("label is not null").select("article_id", "label", "words")).select("article_id", "label", "features").coalesce(1), "training")
    train = train.coalesce(1).persist()
    every = hashing.transform(made.where("article_id is not null").select("article_id", "words"))
    if train.select("label").distinct().count() < 2:
        return every.select("article_id", F.lit(0.0).alias("probability")).dropDuplicates(["article_id"])
    fit = LogisticRegression(regParam=1e-3, maxIter=60, standardization=False).fit
    # intact records that the first model takes for cut ones are most likely that: they go, and it is fitted again
    sure = (F.col("label") == 1) | F.col("article_id").isNull() | (vector_to_array("probability")[1] < DOUBT)
    model = fit(fit(train).transform(train).where(sure).select("label", "features"))
    train.unpersist()
    return model.transform(every).select("article_id", vector_to_array("probability")[1].alias("probability")).dropDuplicates(["article_id"])


def cut_off(articles: DataFrame) -> DataFrame:
    """(article_id) of each article that was cut off."""
    return scored(articles).where("probability >= 0.5").select("article_id")


def rates(articles: DataFrame) -> DataFrame:
    """(source, articles, cut_off, share) of each source; every article counts, those without content too."""
    rows = articles.where("article_id is not null and source is not null").select("article_id", "source").dropDuplicates(["article_id"])
    cut = cut_off(articles).withColumn("cut", F.lit(1))
    out = rows.join(cut, "article_id", "left").groupBy("source").agg(F.count("*").alias("articles"), F.count("cut").alias("cut_off"))
    return out.withColumn("share", F.col("cut_off") / F.col("articles"))
