"""Records of evaluation splits that occur, exactly or almost, in the training split.

Method: a compressed full-text index (FM-index) over the words of the evaluation
articles, in shards of bounded size.  Training articles stream through it by
backward search: from every ``STEP``-th word on, a match is extended to the left
word by word until no evaluation text has it, which gives the left-maximal
matches and, as intervals of the index, all places where they occur.  Where a match
grows in some of its places only, the others are given at the length they reached,
so each text with a seed is found, however close others are.  A search stops at
``MAX_MATCH`` words, for what lies further left is found from earlier ends in the
same places: merged, the spans are the maximal matches whatever their length.
Matches of at least ``MIN_MATCH`` words are located, merged into spans of each
pair of articles, and counted; every common run of ``MIN_MATCH + STEP - 1`` words
or more is found.

Which pairs are alike is known before: of sets at a similarity of a half, put into
one order, the first common sequence stands so early in both that as many can follow
as the pair must share.  So the sequences of a text's first half are enough, and of
pairs that share one those count whose sizes and places there allow it.  The order is
by how often the evaluation articles have a sequence, rarest first (counted over all
of them in a table of bounded size; where two share a cell the order stays one order,
so that no pair is lost).  The pairs are screened by a sketch of their sets (that of
the near-duplicate operator, with a wider margin) and verified exactly on the full
sets of three-word sequences, which the index holds beside the texts.  The words of
training articles with an alike partner go to its shard once more, where the matches of
the pairs are extended, located and merged; those without a match have no words and no
spans.  So no set moves, and no text of an article without a partner; the search reads
the sets of a shard, and the shard's index is read once.

The index of a shard holds the Burrows-Wheeler transform as positions by word, a
suffix array sampled at every ``RATE``-th word, and the intervals of all
sequences of ``MIN_MATCH`` words, from which the searches start.  It is written to the
shared folder; a task of the search reads the sets of one shard at a time and streams
all articles it holds through them, up to ``HELD`` words.

Copies of one text are indexed and streamed once, under one id, and take part in
its pairs by a join at the end, so a hot group of copies costs one search.

Nulls: a null or empty title counts as no words; articles with too few words of
content, null or empty ones included, those without a split and splits other
than the named ones are left out.  Rows of one id count once.  Empty tables give
an empty result, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rankspark.llm import words as W
from rankspark.llm.near_duplicates import MIN_WORDS, SIMILARITY, WIDE, WIDTH, matching, sketches
from rankspark.sources.shared import stored

SHARD_WORDS = 1_800_000
STEP = 4
MIN_MATCH = 6
MAX_MATCH = 24
RATE = 8
#: Articles of a shard with a seed from which it is frequent: no bound here, a size for tests.
FREQUENT = 64
STREAM = 5_000
#: Words of training articles that a task holds while the shards pass.
HELD = 2_500_000
LOCATE = 500_000
#: Bits of a sequence's hash in the order, and of a size beside it; articles to one sort; cells of the table of counts at most.
TOKEN, SIZE = 43, 21
TOGETHER = 1 << 64 - TOKEN - 8
CELLS = 1 << 25
PARTS = 16
_BIG = np.uint64(0x9E3779B97F4A7C15)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling on what isn't sorted yet; the last symbol must be unique."""
    n = len(symbols)
    key = symbols.astype(np.int64)
    key *= int(symbols.max()) + 2
    key[:-1] += symbols[1:]
    key[:-1] += 1
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).astype(np.int32)
    del key
    size = np.diff(np.append(start, np.int32(n)))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(start, size)
    active, k = order[np.repeat(size > 1, size)], 2
    del order
    while len(active):
        after = np.where(active + k < n, rank[np.minimum(active + k, n - 1)] + 1, 0)
        # by rank, then by what follows
        order = np.argsort(rank[active].astype(np.int64) * (n + 2) + after, kind="stable")
        active, after, old = active[order], after[order], rank[active[order]]
        head = np.r_[True, old[1:] != old[:-1]]
        first = head | np.r_[True, after[1:] != after[:-1]]
        at = np.arange(len(active), dtype=np.int32)
        base = np.maximum.accumulate(np.where(head, at, 0))
        rank[active] = old + np.maximum.accumulate(np.where(first, at, 0)) - base
        size = np.diff(np.append(np.flatnonzero(first), len(active)))
        active = active[np.repeat(size > 1, size)]
        k *= 2
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    return suffixes


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of the ``MIN_MATCH`` words from each position on, as far as there are as many."""
    n = max(0, len(words) - MIN_MATCH + 1)
    h = words[:n].copy()
    for k in range(1, MIN_MATCH):
        h = h * _BIG + words[k : n + k]
    return W.mix(h)


def pieces(sizes: np.ndarray, begin: int, end: int) -> list[np.ndarray]:
    """The numbers from ``begin`` to ``end`` in pieces whose sizes sum to about ``LOCATE``."""
    total = np.cumsum(sizes[begin:end])
    return np.split(np.arange(begin, end), np.searchsorted(total, np.arange(1, sizes[begin:end].sum() // LOCATE + 1) * LOCATE))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def tokens(sets: np.ndarray) -> np.ndarray:
    return sets >> np.uint64(W.HASH_BITS - TOKEN)


def beginnings(sets: np.ndarray, sizes: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, article, place) of the first half of each article's set, rarest first, without what no evaluation article has."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    found = [(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))]
    for at in range(0, len(sizes), TOGETHER):
        size = sizes[at : at + TOGETHER]
        token = tokens(sets[edge[at] : edge[at + len(size)]])
        key = np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(TOKEN + 8), size)
        key |= rarity[(token & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(TOKEN)
        key = np.sort(key | token)
        doc = (key >> np.uint64(TOKEN + 8)).astype(np.int32)
        place = (np.arange(len(key)) - (edge[at : at + len(size)] - edge[at])[doc]).astype(np.int32)
        early = (2 * place <= size[doc]) & ((key >> np.uint64(TOKEN)) & np.uint64(255) > 0)
        found.append((key[early] & np.uint64((1 << TOKEN) - 1), doc[early] + np.int32(at), place[early]))
    return tuple(np.concatenate(x) for x in zip(*found))


def sized(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Token and size in one key."""
    return token << np.uint64(SIZE) | np.clip(size, 0, (1 << SIZE) - 1).astype(np.uint64)


class Side:
    """The sets of a shard's evaluation articles, and where the first halves have which sequence."""

    FIELDS = (("keys", np.uint64), ("docs", np.int32), ("limits", np.int32))

    def __init__(self, read, **fields: np.ndarray):
        self.__dict__.update(fields)
        self.read = read

    @classmethod
    def postings(cls, sets: np.ndarray, sizes: np.ndarray, rarity: np.ndarray) -> dict[str, np.ndarray]:
        """In the order of token and size; ``limits`` is the largest size of a partner whose first common sequence this is."""
        token, doc, place = beginnings(sets, sizes, rarity)
        key = sized(token, sizes[doc])
        order = np.argsort(key)
        return {"keys": key[order], "docs": doc[order], "limits": (2 * sizes[doc] - 3 * place)[order].astype(np.int32)}

    def __getattr__(self, name: str) -> np.ndarray:
        if name != "sets":
            raise AttributeError(name)
        self.sets = self.read("sets")
        return self.sets


class Index:
    """An FM-index over the words of some articles."""

    FIELDS = (("ids", np.int64), ("starts", np.int64), ("vocabulary", np.uint64), ("counts", np.int64), ("places", np.int32), ("sampled", np.int32), ("positions", np.int32), ("seeds", np.uint64), ("low", np.int32), ("high", np.int32), ("sketch", np.uint64), ("sets", np.uint64), ("sizes", np.int64))

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)
        self.n = len(self.places)
        # places are grouped by word: one sorted key finds rank and new row in one search
        word = np.repeat(np.arange(len(self.counts)), self.counts)
        self.key = word * (self.n + 1) + self.places
        # the row of the suffix one word longer, and the position of the rows where it is known
        self.longer = np.empty(self.n, np.int32)
        self.longer[self.places] = np.arange(self.n, dtype=np.int32)
        # the word in front of each row
        self.before = np.empty(self.n, np.int32)
        self.before[self.places] = word
        self.at = np.full(self.n, -1, np.int32)
        self.at[self.sampled] = self.positions

    @classmethod
    def build(cls, ids: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> Index:
        """``flat`` holds the word hashes of the articles one after the other; none may be empty."""
        vocabulary, symbol = np.unique(flat, return_inverse=True)
        d = len(ids)
        starts = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
        n = len(flat) + d
        is_end = np.zeros(n, bool)
        is_end[starts + counts] = True
        # each article ends in a mark of its own, so no match crosses an end
        order = np.empty(n, np.int64)
        order[is_end], order[~is_end] = np.arange(d), symbol + d
        suffixes = suffix_order(order)
        text = np.zeros(n, np.int64)
        text[~is_end] = symbol + 1
        before = text[suffixes - 1]
        places = np.argsort(before, kind="stable").astype(np.int32)
        words = np.zeros(n, np.uint64)
        words[~is_end] = flat
        # seeds in the order of the suffixes: each is one interval
        ends = np.concatenate([[0], np.cumsum(is_end)])
        m = max(0, n - MIN_MATCH + 1)
        inside = np.zeros(n, bool)
        inside[:m] = ends[MIN_MATCH : MIN_MATCH + m] == ends[:m]
        hashed = np.zeros(n, np.uint64)
        hashed[:m] = seed_hashes(words)
        row = np.flatnonzero(inside[suffixes])
        hashed = hashed[suffixes[row]]
        first = np.flatnonzero(np.r_[True, (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1] + 1)]) if len(row) else np.empty(0, np.int64)
        last = np.append(first[1:], len(row)) - 1
        by = np.argsort(hashed[first])
        # positions known without walking: every RATE-th, and each article's first word
        known = np.zeros(n, bool)
        known[::RATE] = True
        known[starts] = True
        sampled = np.flatnonzero(known[suffixes])
        doc, sets, _ = W.shingles(flat, counts)
        return cls(
            ids=ids, starts=starts, vocabulary=vocabulary, counts=np.bincount(before, minlength=len(vocabulary) + 1), places=places,
            sampled=sampled.astype(np.int32), positions=suffixes[sampled].astype(np.int32),
            seeds=hashed[first][by], low=row[first][by].astype(np.int32), high=(row[last][by] + 1).astype(np.int32), sketch=sketches(doc, sets, d).ravel(), sets=sets, sizes=np.bincount(doc, minlength=d),
        )

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Word hashes as symbols; 0 for words that no article here has."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with ``symbol`` put in front."""
        base = symbol * (self.n + 1)
        wanted = np.concatenate([base + low, base + high])
        # in order, so that the search stays in the cache
        order = np.argsort(wanted)
        found = np.empty(len(wanted), np.int64)
        found[order] = np.searchsorted(self.key, wanted[order])
        return found[: len(low)], found[len(low) :]

    def start(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of seeds (sorted): which occur, and their intervals."""
        if not len(self.seeds):
            none = np.empty(0, np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.seeds, hashed), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == hashed)
        return hit, self.low[at[hit]].astype(np.int64), self.high[at[hit]].astype(np.int64)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Article numbers of rows of the index: walk back to the next sampled row."""
        position = self.at[rows]
        left, row, walked = np.flatnonzero(position < 0), rows, 0
        row = row[left]
        while len(left):
            row, walked = self.longer[row], walked + 1
            at = self.at[row]
            hit = at >= 0
            position[left[hit]] = at[hit] + walked
            left, row = left[~hit], row[~hit]
        return np.searchsorted(self.starts, position, side="right") - 1

    def articles(self, low: np.ndarray, high: np.ndarray, grown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many articles each interval has outside its rows with the word ``grown`` in front, and their numbers, each once an interval."""
        times, d = high - low, len(self.ids)
        found = [np.empty(0, np.int64)]
        for piece in pieces(times, 0, len(low)):
            t = times[piece]
            rows = np.repeat(low[piece] - np.cumsum(t) + t, t) + np.arange(t.sum())
            piece = np.repeat(piece, t)
            here = self.before[rows] != grown[piece]
            found.append(distinct(piece[here] * d + self.locate(rows[here])))
        interval, article = np.divmod(np.concatenate(found), d)
        return np.bincount(interval, minlength=len(low)), article


def left_maximal(index: Index, flat: np.ndarray, begin: np.ndarray, first: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which, first word, low, high, grown) of the matches grown to the left from seeds.

    Each place of a seed belongs to one match, the longest there: the rows of the
    interval without those that have the word ``grown`` in front (-1 for none),
    which are in a longer match.  ``first`` is the first word of each seed, ``hashed`` its hash (sorted),
    ``begin`` the first word of its article.
    """
    which, low, high = index.start(hashed)
    begin = np.maximum(begin[which], first[which] + MIN_MATCH - MAX_MATCH)
    first = first[which]
    out = []
    while len(which):
        on = np.flatnonzero(first > begin)
        symbol = index.symbols(flat[first[on] - 1])
        new_low, new_high = index.extend(symbol, low[on], high[on])
        grown = (symbol > 0) & (new_low < new_high)
        stay = np.ones(len(which), bool)
        stay[on[grown]] = False
        out.append((which[stay], first[stay], low[stay], high[stay], np.full(stay.sum(), -1)))
        # the places where the match doesn't grow
        some = grown & (new_high - new_low < high[on] - low[on])
        out.append((which[on[some]], first[on[some]], low[on[some]], high[on[some]], symbol[some]))
        on = on[grown]
        which, begin, first, low, high = which[on], begin[on], first[on] - 1, new_low[grown], new_high[grown]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 5


class Seeds:
    """Training articles with the hashes of their seeds, in the order of the hashes."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat = flat
        self.start = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        hashed = seed_hashes(flat)
        at = np.arange(len(hashed))
        offset = at - self.start[self.doc[: len(at)]]
        # seeds at every STEP-th word, counted from the first seed of the article
        good = np.flatnonzero((offset % STEP == 0) & (self.doc[: len(at)] == self.doc[MIN_MATCH - 1 : MIN_MATCH - 1 + len(at)]))
        self.first = good[np.argsort(hashed[good])]
        self.hashed = hashed[self.first]

    def overlaps(self, index: Index, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """(training number, evaluation number, words covered, spans) of the pairs, in order; zeros where they have no match."""
        d = len(index.ids)
        which, first, low, high, grown = left_maximal(index, self.flat, self.start[self.doc[self.first]], self.first, self.hashed)
        end = self.first[which] + MIN_MATCH - 1
        mine, theirs, covered, spans = pairs_of_matches(index, self.doc, end, first, low, high, grown, wanted)
        at = np.searchsorted(wanted, mine * d + theirs)
        words, parts = np.zeros((2, len(wanted)), np.int64)
        words[at], parts[at] = covered, spans
        return wanted // d, wanted % d, words, parts


class Stream:
    """A batch of training articles with the first halves of their sets."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray, rarity: np.ndarray):
        self.flat, self.edge = flat, np.concatenate([[0], np.cumsum(counts)])
        of, sets, _ = W.shingles(flat, counts)
        self.sketch = sketches(of, sets, len(counts))
        self.sizes = np.bincount(of, minlength=len(counts))
        token, doc, place = beginnings(sets, self.sizes, rarity)
        order = np.argsort(token)
        token, self.owner, place = token[order], doc[order].astype(np.min_scalar_type(len(counts))), place[order]
        # partners' sizes: half of this one's at least, at most what may still follow
        size = self.sizes[self.owner]
        self.least, self.most = sized(token, (size + 1) // 2), sized(token, 2 * size - 3 * place)
        self.sets = of.astype(np.uint64) << np.uint64(W.HASH_BITS) | sets

    def alike(self, side: Side, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (training number * evaluation articles + evaluation number, in order) of at least ``similarity``, and their similarities."""
        return self.exact(side, self.candidates(side), similarity)

    def candidates(self, side: Side) -> np.ndarray:
        """The pairs, in order, that share an early sequence and whose sketches match."""
        d, theirs = len(side.ids), side.sketch.reshape(-1, WIDTH)
        low = np.searchsorted(side.keys, self.least)
        hit = np.flatnonzero(side.keys[np.minimum(low, len(side.keys) - 1)] <= self.most) if len(side.keys) else np.empty(0, np.int64)
        hit = hit[low[hit] < len(side.keys)]
        high = np.searchsorted(side.keys, self.most[hit], side="right")
        order = np.argsort(self.owner[hit], kind="stable")
        hit, high = hit[order], high[order]
        low, owner = low[hit], self.owner[hit].astype(np.int64)
        t = high - low
        wanted = [np.empty(0, np.int64)]
        for piece in pieces(t, 0, len(t)):
            n = t[piece]
            at = np.repeat(low[piece] - np.cumsum(n) + n, n) + np.arange(n.sum())
            a = np.repeat(owner[piece], n)
            good = side.limits[at] >= self.sizes[a]
            pair = distinct(a[good] * d + side.docs[at[good]])
            wanted.append(pair[matching(self.sketch[pair // d], theirs[pair % d], WIDE)])
        return distinct(np.concatenate(wanted))

    def exact(self, side: Side, wanted: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (in order) those of at least ``similarity``, and their similarities."""
        value = np.zeros(len(wanted))
        if not len(wanted):
            return wanted, value
        edge = np.concatenate([[0], np.cumsum(side.sizes)])
        a, b = np.divmod(wanted, len(side.ids))
        for piece in pieces(side.sizes[b], 0, len(b)):
            if not len(piece):
                continue
            size = side.sizes[b[piece]]
            start = np.cumsum(size) - size
            theirs = side.sets[np.repeat(edge[b[piece]] - start, size) + np.arange(size.sum())] | np.repeat(a[piece].astype(np.uint64) << np.uint64(W.HASH_BITS), size)
            at = np.minimum(np.searchsorted(self.sets, theirs), len(self.sets) - 1)
            common = np.add.reduceat(self.sets[at] == theirs, start, dtype=np.int64)
            value[piece] = common / (self.sizes[a[piece]] + size - common)
        good = value >= similarity
        return wanted[good], value[good]


def pairs_of_matches(index: Index, doc: np.ndarray, end: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, grown: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(training number, evaluation number, words covered, spans) of the ``wanted`` pairs."""
    of = doc[end]
    # each interval is located once, however many matches have it
    _, kind = np.unique(low * (index.n + 1) + high, return_inverse=True)
    _, lead, kind = np.unique(kind * (len(index.counts) + 1) + grown + 1, return_index=True, return_inverse=True)
    size, articles = index.articles(low[lead], high[lead], grown[lead])
    start, t = np.concatenate([[0], np.cumsum(size)])[:-1], size[kind]
    found = [np.empty((2, 0), np.int64)]
    for piece in pieces(t, 0, len(t)):
        n = t[piece]
        match = np.repeat(piece, n)
        pair = of[match] * len(index.ids) + articles[np.repeat(start[kind[piece]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.minimum(np.searchsorted(wanted, pair), max(0, len(wanted) - 1))
        here = wanted[at] == pair if len(wanted) else np.zeros(len(pair), bool)
        found.append(np.stack([match[here], pair[here]]))
    match, pair = np.concatenate(found, axis=1)
    # merge the matches of each pair into spans
    order = np.lexsort((first[match], pair))
    pair, a, b = pair[order], first[match][order], end[match][order] + 1
    if not len(pair):
        return (np.empty(0, np.int64),) * 4
    head = np.r_[True, pair[1:] != pair[:-1]]
    group = np.cumsum(head) - 1
    wide = len(doc) + 1
    reach = np.maximum.accumulate(group * wide + b) - group * wide  # the farthest end so far in the pair
    before = np.r_[0, reach[:-1]]
    fresh = head | (a > before)
    gain = np.where(head, b - a, np.maximum(0, b - np.maximum(a, before)))
    where = np.flatnonzero(head)
    covered = np.add.reduceat(gain, where)
    spans = np.add.reduceat(fresh.astype(np.int64), where)
    mine, theirs = np.divmod(pair[where], len(index.ids))
    return mine, theirs, covered, spans


def _word_blocks(shards: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat, counts = W.article_words(batch, min_words)
            if not len(ids):
                continue
            # copies of one text go to one shard
            keys = W.text_keys(flat, counts)
            shard = (W.mix(keys) % np.uint64(shards)).astype(np.int64)
            rows: dict[str, list] = {"shard": [], "ids": [], "copy_of": [], "counts": [], "flat": []}
            # of copies in a batch one sends its words
            _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
            lead = np.zeros(len(ids), bool)
            lead[first] = True
            of = np.repeat(np.where(lead, shard, -1), counts)
            for s in np.unique(shard):
                here = shard == s
                for name, value in (("ids", ids[here]), ("copy_of", ids[first][kind][here]), ("counts", np.where(lead, counts, 0)[here]), ("flat", flat[of == s])):
                    rows[name].append(value.tobytes())
                rows["shard"].append(int(s))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int32())] + [(c, pa.binary()) for c in ("ids", "copy_of", "counts", "flat")]))

    return run


def _indexed(frame: pd.DataFrame) -> pd.DataFrame:
    ids, copy_of, counts = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("ids", "copy_of", "counts"))
    flat = np.frombuffer(b"".join(frame["flat"]), np.uint64)
    # one text for each sequence of words, under its smallest id
    lead = np.flatnonzero(counts)
    edge = np.concatenate([[0], np.cumsum(counts[lead])])
    keys = W.text_keys(flat, counts[lead])
    order = np.lexsort((ids[lead], keys))
    first = order[np.r_[True, keys[order][1:] != keys[order][:-1]]]
    smallest = dict(zip(keys[first].tolist(), ids[lead][first].tolist()))
    leader = dict(zip(ids[lead].tolist(), (smallest[k] for k in keys.tolist())))
    keep = np.zeros(len(lead), bool)
    keep[first] = True
    index = Index.build(ids[lead][keep], flat[np.repeat(keep, np.diff(edge))], counts[lead][keep])
    copies = sorted({(leader[c], i) for c, i in zip(copy_of.tolist(), ids.tolist()) if leader[c] != i})
    return pd.DataFrame({"shard": frame["shard"].iloc[:1]} | {name: [getattr(index, name).astype(kind).tobytes()] for name, kind in Index.FIELDS} | {"copies": [np.array(copies, np.int64).tobytes()]})


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        pairs = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, np.int64) for x in frame["copies"]]]).reshape(-1, 2)
        yield pd.DataFrame({"leader": pairs[:, 0], "copy": pairs[:, 1]})


def _fields(path: str, shard: int, names: list[str]) -> dict[str, memoryview] | None:
    files, at = pafs.FileSystem.from_uri(path)
    if files.get_file_info(f"{at}/shard={shard}").type == pafs.FileType.NotFound:
        return None
    found = [i.path for i in files.get_file_info(pafs.FileSelector(f"{at}/shard={shard}")) if i.base_name.endswith(".parquet")]
    table = pq.ParquetFile(files.open_input_file(found[0])).read(columns=names)
    return {name: table.column(name)[0].as_buffer() for name in names}


def read_index(path: str, shard: int) -> Index | None:
    read = _fields(path, shard, [name for name, _ in Index.FIELDS])
    return read and Index(**{name: np.frombuffer(read[name], kind) for name, kind in Index.FIELDS})


def read_side(path: str, postings: str, shard: int) -> Side | None:
    kinds = dict(Index.FIELDS)
    names = ("ids", "sizes", "sketch")
    read, more = _fields(path, shard, list(names)), _fields(postings, shard, [name for name, _ in Side.FIELDS])
    if read is None or more is None:
        return None
    fields = {name: np.frombuffer(read[name], kinds[name]) for name in names} | {name: np.frombuffer(more[name], kind) for name, kind in Side.FIELDS}
    return Side(lambda name: np.frombuffer(_fields(path, shard, [name])[name], kinds[name]), **fields)


def _counted(cells: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.uint32)
        for frame in frames:
            for sets in frame["sets"]:
                np.add.at(total, (tokens(np.frombuffer(sets, np.uint64)) & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(PARTS, -1)
            yield pd.DataFrame({"part": np.arange(PARTS, dtype=np.int32), "n": [p.tobytes() for p in parts]})

    return run


def _rarity(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts as bytes, exact up to 127, then by eighths of a doubling."""
    total = sum(np.frombuffer(n, np.uint16).astype(np.int64) for n in frame["n"])
    value = np.where(total < 128, total, np.minimum(255, 128 + 8 * np.log2(np.maximum(total, 128) / 128))).astype(np.uint8)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "n": [value.tobytes()]})


_rarities: dict[str, np.ndarray] = {}


def read_rarity(path: str) -> np.ndarray:
    """The table of counts; a worker keeps one.  Without evaluation articles it has one empty cell."""
    if path not in _rarities:
        files, at = pafs.FileSystem.from_uri(path)
        names = [i.path for i in files.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith(".parquet")]
        rows = [row for name in names for row in pq.ParquetFile(files.open_input_file(name)).read().to_pylist()]
        _rarities.clear()
        _rarities[path] = np.frombuffer(b"".join(r["n"] for r in sorted(rows, key=lambda r: r["part"])) or b"\0", np.uint8)
    return _rarities[path]


def _posted(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, sizes, sets in zip(frame["shard"], frame["sizes"], frame["sets"]):
                made = Side.postings(np.frombuffer(sets, np.uint64), np.frombuffer(sizes, np.int64), read_rarity(path))
                yield pd.DataFrame({"shard": np.array([shard], np.int32)} | {name: [made[name].astype(kind).tobytes()] for name, kind in Side.FIELDS})

    return run


def _streamed(path: str, postings: str, rarity: str, shards: int, min_words: int, similarity: float):
    schema = pa.schema([("train_id", pa.int64()), ("copy_of", pa.int64()), ("shard", pa.int32())] + [(c, pa.binary()) for c in ("words", "numbers", "similarities")])

    def through(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        streams = []
        for ids, flat, counts in held:
            # copies of one text are streamed once; a row without words says whose copy an article is
            _, first, kind = np.unique(W.text_keys(flat, counts), return_index=True, return_inverse=True)
            lead = np.zeros(len(ids), bool)
            lead[first] = True
            copy = np.flatnonzero(ids[first][kind] != ids)
            none = pa.nulls(len(copy), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[copy]), pa.array(ids[first][kind][copy]), pa.nulls(len(copy), pa.int32()), none, none, none], schema=schema)
            streams.append((ids[lead], Stream(flat[np.repeat(lead, counts)], counts[lead], read_rarity(rarity))))
        for shard in range(shards):
            side = read_side(path, postings, shard)
            for mine, stream in streams if side is not None else []:
                wanted, value = stream.alike(side, similarity)
                if len(wanted):
                    # a row an article, with the numbers of its partners
                    a, b = np.divmod(wanted, len(side.ids))
                    lead = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                    rows = {
                        "train_id": mine[a[lead]], "copy_of": pa.nulls(len(lead), pa.int64()), "shard": np.full(len(lead), shard, np.int32),
                        "words": [stream.flat[stream.edge[k] : stream.edge[k + 1]].tobytes() for k in a[lead]],
                        "numbers": [x.tobytes() for x in np.split(b, lead[1:])], "similarities": [x.tobytes() for x in np.split(value, lead[1:])],
                    }
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, STREAM):
                words = W.article_words(batch.slice(start, STREAM), min_words)
                if len(words[0]):
                    held.append(words)
            if sum(len(h[1]) for h in held) >= HELD:
                yield from through(held)
                held = []
        if held:
            yield from through(held)

    return run


def _matched(path: str):
    """Words and spans of the alike pairs; rows come by shard."""
    schema = pa.schema([(c, pa.int64()) for c in ("train_id", "eval_id", "words", "spans")] + [("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, -1
        for batch in batches:
            shards = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(shards)), np.flatnonzero(shards[1:] != shards[:-1]) + 1):
                for start in range(0, len(rows), STREAM):
                    part = batch.slice(rows[start], len(rows[start : start + STREAM]))
                    if shards[rows[0]] != at:
                        at = int(shards[rows[0]])
                        index = read_index(path, at)
                    texts, numbers = ([np.frombuffer(x, kind) for x in part.column(c).to_pylist()] for c, kind in (("words", np.uint64), ("numbers", np.int64)))
                    wanted = np.repeat(np.arange(len(texts)), list(map(len, numbers))) * len(index.ids) + np.concatenate(numbers)
                    a, b, covered, spans = Seeds(np.concatenate(texts), np.array(list(map(len, texts)))).overlaps(index, wanted)
                    value = np.frombuffer(b"".join(part.column("similarities").to_pylist()), np.float64)
                    yield pa.RecordBatch.from_pydict({"train_id": part.column("train_id").to_numpy()[a], "eval_id": index.ids[b], "words": covered, "spans": spans, "similarity": value}, schema=schema)

    return run


def alike_representatives(train: DataFrame, evaluation: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alike pairs (train_id, eval_id, words, spans, similarity) of different texts' representatives, and the copies (leader, copy) of
    training and of evaluation texts, from two tables of (article_id, title, content)."""
    # shards by characters: about six a word
    size = evaluation.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = 1 + size // 6 // shard_words
    blocks = evaluation.select("article_id", "title", "content").mapInArrow(_word_blocks(shards, min_words), "shard int, ids binary, copy_of binary, counts binary, flat binary")
    schema = "shard int, " + ", ".join(f"{name} binary" for name, _ in Index.FIELDS) + ", copies binary"
    index, path = stored(blocks.groupBy("shard").applyInPandas(_indexed, schema), "index", "shard")
    cells = min(CELLS, max(1 << 16, 1 << int(size // 6).bit_length()))
    counts = index.select("sets").mapInPandas(_counted(cells), "part int, n binary").groupBy("part").applyInPandas(_rarity, "part int, n binary")
    _, rarity = stored(counts, "rarity")
    _, postings = stored(index.select("shard", "sizes", "sets").mapInPandas(_posted(rarity), "shard int, " + ", ".join(f"{name} binary" for name, _ in Side.FIELDS)), "postings", "shard")
    found = train.select("article_id", "title", "content").mapInArrow(_streamed(path, postings, rarity, shards, min_words, similarity), "train_id long, copy_of long, shard int, words binary, numbers binary, similarities binary")
    found, _ = stored(found, "alike")
    alike = found.where("shard is not null").select("shard", "train_id", "words", "numbers", "similarities").repartition(2 * shards, "shard").sortWithinPartitions("shard")
    matched, _ = stored(alike.mapInArrow(_matched(path), "train_id long, eval_id long, words long, spans long, similarity double"), "overlaps")
    pairs = matched.groupBy("train_id", "eval_id").agg(F.max("words").alias("words"), F.max("spans").alias("spans"), F.max("similarity").alias("similarity"))
    copies = found.where("shard is null").select(F.col("copy_of").alias("leader"), F.col("train_id").alias("copy")).distinct()
    return pairs, copies, index.select("copies").mapInPandas(_listed, "leader long, copy long")


def _with_copies(pairs: DataFrame, copies: DataFrame, column: str) -> DataFrame:
    """The pairs, and the same with each copy of ``column``'s article."""
    more = pairs.join(copies.withColumnRenamed("leader", column), column).drop(column).withColumnRenamed("copy", column)
    return pairs.unionByName(more).distinct()


#: Rows of the table of splits up to which it is broadcast (about 20 MB).
SMALL = 1_000_000


def with_split(articles: DataFrame, splits: DataFrame) -> DataFrame:
    """Articles joined with their split: by broadcast while the table of splits is small, else by a shuffle."""
    known = splits.select("article_id", "split").where("article_id is not null and split is not null").dropDuplicates(["article_id"])
    return articles.drop("split").join(F.broadcast(known) if splits.count() <= SMALL else known, "article_id")


def split_overlaps(articles: DataFrame, splits: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"), similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(train_id, eval_id, words, spans, similarity) of every alike pair across the splits."""
    rows = with_split(articles, splits)
    here, there = rows.where(F.col("split") == train), rows.where(F.col("split").isin(*evaluation))
    alike, train_copies, eval_copies = alike_representatives(here, there, similarity, min_words)
    return _with_copies(_with_copies(alike, train_copies, "train_id"), eval_copies, "eval_id")


def overlap_report(found: DataFrame, articles: DataFrame, splits: DataFrame, evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(split, feed_name, articles, overlapping, pairs) of each evaluation split and source."""
    rows = with_split(articles.select("article_id", "feed_name"), splits).where(F.col("split").isin(*evaluation)).dropDuplicates(["article_id"])
    hits = found.groupBy(F.col("eval_id").alias("article_id")).agg(F.count("*").alias("pairs"))
    joined = rows.join(hits, "article_id", "left")
    return joined.groupBy("split", "feed_name").agg(F.count("*").alias("articles"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
