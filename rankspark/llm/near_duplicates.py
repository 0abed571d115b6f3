"""Near-duplicate articles: a set-similarity self-join by universe partition.

Method (partition of the universe, pigeonhole, one-deletion neighbourhoods,
cost-based allocation, exact verification):

1. An article is the set of its three-word shingles.  The universe of shingles
   is hashed into ``m`` segments; a shingle's segment depends on its *anchor*
   (its smallest word hash), so the few shingles that one edited word destroys
   fall into one or two segments, not into three or more.
2. Size bands: ``m`` is a power of two, and an article of ``n`` shingles uses
   the two steps that leave 1.5 to 6 shingles a segment.  Articles whose sizes
   differ by up to a factor of two share a step; beyond that no pair can reach a
   similarity of 0.5.
3. An article emits a key for each segment: the hash of the subset of its
   shingles in it.  Allocation: a segment with a single shingle costs most (its
   key is shared by many) and gets none; all others get the exact key; what is
   left of the budget (``KEYS``) goes to one-deletion keys of the segments with
   3 to 9 shingles, those of the coarser step first, which a partner of half or
   twice the size shares.  Of the ``m`` segments the first ``SEGMENTS`` are
   used.  A set of under ``4 * TINY`` shingles has a key for each.
4. Keys travel with ids only.  Articles under one key are compared by sketch, and
   the pairs within reach of the threshold are verified exactly on the full sets.
5. Links are chained by rounds of label minimisation; nothing is collected.

Hot keys.  Articles of the same set in a batch are linked and one goes on; near
copies are linked to a leader by parts of the sketch, with a leader a batch in
front of the shuffle.  A key that more than ``HOT`` articles share waits until
these links and those of the other keys are verified and chained.  Then all its
pairs of articles in *different* chains are compared by two sketches, in sub-blocks
of at most ``PART`` by ``PART``; members of the largest chain meet the others only.  Of the
pairs between two chains the ``ALLOWED`` nearest are verified first, and more in
further rounds as long as there are any and the chains stay apart.  So a hot
group of near copies costs a link each, and no pair is left out.

The theoretical budget of the pigeonhole for a Jaccard similarity of 0.5 asks for
as many segments as a third of both sizes.  The ladder is as fine as that at its
finer step; what gives up the worst-case guarantee is that segments of a single
shingle get no key and ``SEGMENTS`` are used.  The measured loss is in the README.

Nulls: a null or empty title counts as no words; articles with under
``MIN_WORDS`` words of content, null or empty content included, are left out.
Rows of one id count once.  Ties cannot arise: groups are named by their
smallest id.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import Broadcast
from pyspark.sql import DataFrame

from rankspark.llm import words as W
from rankspark.llm.components import components
from rankspark.sources.shared import stored

MIN_WORDS = 20
SIMILARITY = 0.5
KEYS = 64
SEGMENTS = 32
#: Shingles a segment at the finer step, at least.
FINE = 1.5
TINY = 16
#: Members of a key from which it waits for the chains of the others.
HOT = 32
#: Members of a key in one batch from which its articles are spread over all blocks.
SPREAD = 64
#: Members on each side of a sub-block of a hot key.
PART = 8192
#: Pairs between two chains that are verified in the first round; each further round allows as many times more.
ALLOWED = 16
BINS = 128
SIZES = 1024


class Margin(NamedTuple):
    """Matching bins that a pair of sets needs, in all bins and in the first half, by the size of the smaller (the last for all larger)."""

    need: np.ndarray
    half: np.ndarray


def margin(deviations: float) -> Margin:
    """A pair with similarity 0.5 has 80 matching bins on average, 40 in half of them; it may have so many standard deviations less."""
    size = np.maximum(np.arange(SIZES + 1), 0.75)
    need = 80 - deviations * np.sqrt(5.5**2 + 48**2 / (4 / 3 * size))
    half = 40 - (deviations + 0.5) * np.sqrt(3.9**2 + 24**2 / (4 / 3 * size))
    return Margin(np.maximum(0, need).astype(np.int64), np.maximum(0, half).astype(np.int64))


#: Screening in front of a shuffle of sets (5 of 10,000 pairs at the threshold may fail), and in front of sets at hand (1 of 30,000).
SCREEN, WIDE = margin(3.3), margin(4.0)
#: Two sketches together, as the members of hot keys have them: twice the bins, twice the variance.
BOTH = np.maximum(0, 160 - 3.3 * np.sqrt(2 * (5.5**2 + 48**2 / (4 / 3 * np.maximum(np.arange(SIZES + 1), 0.75))))).astype(np.int64)
WIDTH = 5
#: Articles that are worked on at once: memory stays bounded, arrays in the cache.
PIECE = 2000
#: 64-bit words of the bitmap of wanted ids, whatever their number (8 MB).
BITMAP = 1 << 20
#: Bytes of a shingle's hash in the sets that are verified.
PACKED = 5
#: Articles to one block of keys.
BLOCK_ARTICLES = 25_000


def sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Two bits of the smallest hash in each of 128 bins, as four words (even columns the low bits), and the set's size: (n, 5)."""
    bins = (h >> np.uint64(W.HASH_BITS - 7)).astype(np.int64)
    cell = doc * BINS + bins
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    value = np.full((n, BINS), 4, np.uint8)
    value.reshape(-1)[cell[first]] = (W.mix(h[first]) & np.uint64(3)).astype(np.uint8)
    for _ in range(2):  # an empty bin takes the next full one's value, around the end
        for c in range(BINS - 1, -1, -1):
            empty = value[:, c] == 4
            value[empty, c] = value[empty, (c + 1) % BINS]
    planes = [np.packbits((value >> p) & 1, axis=1).view(np.uint64) for p in (0, 1)]
    size = np.bincount(doc, minlength=n).astype(np.uint64)
    return np.ascontiguousarray(np.stack([planes[0][:, 0], planes[1][:, 0], planes[0][:, 1], planes[1][:, 1], size], axis=1))


def second_sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The same by other hashes, without the sizes: (n, 4)."""
    other = W.mix(h ^ np.uint64(0x2ED)) & np.uint64((1 << W.HASH_BITS) - 1)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(W.HASH_BITS)) | other)  # in_pieces: documents in 16 bits
    return sketches(doc, other[order], n)[:, :4]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bins in which sketches differ."""
    return np.bitwise_count((a[..., 0:4:2] ^ b[..., 0:4:2]) | (a[..., 1:4:2] ^ b[..., 1:4:2])).sum(axis=-1)


def _segment_keys(doc: np.ndarray, h: np.ndarray, anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of all allocated segment subsets and one-deletion neighbours."""
    size = np.bincount(doc, minlength=n)
    top = np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / FINE))).astype(np.int64)
    place, token = W.mix(anchor ^ np.uint64(0x5EED)), W.mix(h)
    keys, docs, spare, late = [], [], np.full(n, KEYS, np.int64), []
    for down in (1, 0):
        used = (top >= down) | (down == 0)
        m = np.left_shift(1, np.maximum(top - down, 0))
        seg = (place & (m[doc] - 1).astype(np.uint64)).astype(np.int64)
        width = np.minimum(m, SEGMENTS) * used
        start = np.concatenate([[0], np.cumsum(width)])
        inside = np.flatnonzero(seg < width[doc])
        # segment by segment, so that sums are of runs
        cell = start[doc[inside]] + seg[inside]
        order = np.argsort(cell, kind="stable")
        inside, cell = inside[order], cell[order]
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
        count = np.diff(np.append(edge, len(cell)))
        owner = doc[inside[edge]]
        salt = W.mix((m[owner].astype(np.uint64) << np.uint64(32)) | (cell[edge] - start[owner]).astype(np.uint64))
        full = np.add.reduceat(token[inside], edge) if len(edge) else np.empty(0, np.uint64)
        good = count >= 2
        keys.append(W.mix(full + salt)[good])
        docs.append(owner[good])
        spare -= np.bincount(owner[good], minlength=n)
        # one-deletion keys: the subset without each of its shingles
        roomy = np.flatnonzero(np.repeat((count >= 3) & (count <= 9), count))
        c = np.repeat(np.arange(len(edge)), count)[roomy]
        # a full subset of the partner may equal a one-deletion key: both forms live in one key space
        late.append((W.mix(full[c] - token[inside[roomy]] + salt[c]), owner[c]))
    tiny = np.flatnonzero(size[doc] < 4 * TINY)
    keys.append(W.mix(token[tiny] ^ np.uint64(0x71)))
    docs.append(doc[tiny])
    for k, d in late:
        # documents come in order here
        keep = np.arange(len(d)) - np.searchsorted(d, d) < spare[d]
        keys.append(k[keep])
        docs.append(d[keep])
        spare -= np.bincount(d[keep], minlength=n)
    return np.concatenate(keys), np.concatenate(docs)


def _near_codes(sketch: np.ndarray) -> np.ndarray:
    """Eight codes of each sketch, each of 16 of its bins: near copies share one or more; (n, 8)."""
    planes = sketch[:, :4].view(np.uint16).reshape(len(sketch), 2, 2, 4).astype(np.uint64)
    code = planes[:, :, 0] | (planes[:, :, 1] << np.uint64(16))
    return W.mix(code.reshape(len(sketch), 8) | (np.arange(1, 9, dtype=np.uint64) << np.uint64(40)))


_COLUMNS = {"keys": np.uint64, "ids": np.int64, "marks": np.uint64, "hot_keys": np.uint64, "hot_ids": np.int64, "codes": np.uint64, "code_ids": np.int64, "copies": np.int64, "links": np.int64, "sketch_ids": np.int64, "sketches": np.uint64}


def _leaders(code: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by code and id, first in that order of each one's code)."""
    order = np.lexsort((ids, code))
    head = np.r_[True, code[order][1:] != code[order][:-1]][: len(code)]
    return order, order[np.maximum.accumulate(np.where(head, np.arange(len(code)), 0))] if len(code) else order


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            yield batch.slice(start, PIECE)


def _emit(blocks: int, min_words: int):
    schema = pa.schema([("block", pa.int32())] + [(c, pa.binary()) for c in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            ids, flat, counts = W.article_words(batch, min_words)
            doc, h, anchor = W.shingles(flat, counts)
            if not len(h):
                continue
            # of articles with the same set in a batch, one goes on and the others are linked to it
            total = np.zeros(len(ids), np.uint64)
            some = np.bincount(doc, minlength=len(ids)) > 0
            edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[edge]] = np.add.reduceat(W.mix(h), edge)
            _, first, kind = np.unique(total, return_index=True, return_inverse=True)
            leader = ids[first][kind]
            alone = np.isin(np.arange(len(ids)), first) & some
            copies = np.stack([leader, ids], axis=1)[(leader != ids) & some]
            keep = alone[doc]
            place = np.cumsum(alone) - 1
            ids, doc, h, anchor = ids[alone], place[doc[keep]], h[keep], anchor[keep]
            n = len(ids)
            sketch = sketches(doc, h, n)
            more = np.concatenate([sketch, second_sketches(doc, h, n)], axis=1)
            key, owner = _segment_keys(doc, h, anchor, n)
            # near copies are linked to a leader of the batch, which alone goes on with the code
            code, by = _near_codes(sketch).ravel(), np.repeat(np.arange(n), 8)
            large = sketch[by, 4] >= 2 * TINY  # a sketch of a small set says too little
            code, by = code[large], by[large]
            order, lead = _leaders(code, ids[by])
            mine, theirs = by[order], by[lead]
            links = np.unique(np.stack([ids[mine], ids[theirs]], axis=1)[mine != theirs], axis=0)
            links = links[np.unique(links[:, 0], return_index=True)[1]]  # one leader each, the smallest
            leads = order[mine == theirs]
            # keys that many share here are spread over all blocks; the key's own block is told
            u, at, times = np.unique(key, return_inverse=True, return_counts=True)
            often = times[at] > SPREAD
            marks = u[times > SPREAD]
            parts = [
                (key[~often] % np.uint64(blocks), (("keys", key[~often]), ("ids", ids[owner[~often]]))),
                (marks % np.uint64(blocks), (("marks", marks),)),
                (W.mix(key[often] ^ ids[owner[often]].view(np.uint64)) % np.uint64(blocks), (("hot_keys", key[often]), ("hot_ids", ids[owner[often]]))),
                (code[leads] % np.uint64(blocks), (("codes", code[leads]), ("code_ids", ids[by[leads]]))),
                (W.mix(ids.view(np.uint64)) % np.uint64(blocks), (("sketch_ids", ids), ("sketches", more))),
            ]
            parts += [(W.mix(v[:, 1].astype(np.uint64)) % np.uint64(blocks), ((name, v),)) for name, v in (("copies", copies), ("links", links))]
            rows: dict[int, dict[str, bytes]] = {}
            for block, values in parts:
                order = np.argsort(block, kind="stable")
                edge = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1], True]) if len(block) else [0]
                for a, b in zip(edge[:-1], edge[1:]):
                    here = order[a:b]
                    rows.setdefault(int(block[here[0]]), {}).update({name: value[here].tobytes() for name, value in values})
            yield pa.RecordBatch.from_pydict({"block": list(rows)} | {c: [r.get(c, b"") for r in rows.values()] for c in _COLUMNS}, schema=schema)

    return run


def half_reach(sketch: np.ndarray, allowed: Margin = SCREEN) -> np.ndarray:
    """Bins of the first half in which a partner may differ; of a pair the larger counts, that of the smaller set."""
    return (BINS // 2 - allowed.half[np.minimum(sketch[:, 4], np.uint64(SIZES)).astype(np.int64)]).astype(np.uint8)


def matching(a: np.ndarray, b: np.ndarray, allowed: Margin = SCREEN) -> np.ndarray:
    """Which pairs of sketches agree in enough bins: half of the bins first, then all."""
    half = np.bitwise_count((a[:, 0] ^ b[:, 0]) | (a[:, 1] ^ b[:, 1]))
    size = np.minimum(np.minimum(a[:, 4], b[:, 4]), np.uint64(SIZES)).astype(np.int64)
    ok = np.flatnonzero(half <= BINS // 2 - allowed.half[size])
    rest = np.bitwise_count((a[ok, 2] ^ b[ok, 2]) | (a[ok, 3] ^ b[ok, 3]))
    return ok[half[ok].astype(np.int64) + rest <= BINS - allowed.need[size[ok]]]


#: Kinds of rows after the exchange of keys.
COLD, WAITING, COPY, LINK, SKETCH = range(5)


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the (key, id) of keys that two or more share, links of near copies, sketches by id."""
    part = {c: np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in _COLUMNS.items()}
    key, ids = part["keys"], part["ids"]
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])][: len(key)]
    key, ids = key[fresh], ids[fresh]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    count = np.diff(edge)
    marked = np.isin(key[edge[:-1]], part["marks"])
    hot = np.repeat((count > HOT) | marked, count)
    cold = np.repeat(count >= 2, count) & ~hot
    order, lead = _leaders(part["codes"], part["code_ids"])
    near = np.stack([part["code_ids"][lead], part["code_ids"][order]], axis=1)
    # a leader of its batch needs the smallest leader only
    near = near[near[:, 0] != near[:, 1]]
    links = np.concatenate([part["links"].reshape(-1, 2), near])
    links = links[links[:, 0] != links[:, 1]]
    _, first = np.unique(part["sketch_ids"], return_index=True)
    sketch = part["sketches"].reshape(-1, WIDTH + 4)[first]
    copies = part["copies"].reshape(-1, 2)
    x = [key[cold], key[hot], part["hot_keys"], copies.min(axis=1), links.min(axis=1), part["sketch_ids"][first]]
    y = [ids[cold], ids[hot], part["hot_ids"], copies.max(axis=1), links.max(axis=1), part["sketch_ids"][first]]
    kind = np.repeat([COLD, WAITING, WAITING, COPY, LINK, SKETCH], [len(v) for v in x])
    held = np.full(len(kind), None, object)
    if len(sketch):
        held[-len(sketch) :] = [row.tobytes() for row in sketch]
    return pd.DataFrame({"kind": kind.astype(np.int32), "x": np.concatenate([v.view(np.int64) for v in x]), "y": np.concatenate(y), "sketch": held})


def _members(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    return frame["y"].to_numpy(), np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(-1, width)


def _compared(frame: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of the articles under one key whose sketches match."""
    ids, sketch = _members(frame, WIDTH)
    key = frame["x"].to_numpy()
    order = np.lexsort((ids, key))
    key, ids, sketch = key[order], ids[order], sketch[order]
    end = np.searchsorted(key, key, side="right")
    at, gap, a, b = np.arange(len(key)), 1, [], []
    while len(at):
        at = at[at + gap < end[at]]
        for piece in np.array_split(at, len(at) // 500_000 + 1):
            ok = piece[matching(sketch[piece], sketch[piece + gap])]
            a.append(ids[ok])
            b.append(ids[ok + gap])
        gap += 1
    pairs = np.unique(np.stack([np.concatenate([np.empty(0, np.int64), *v]) for v in (a, b)], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _apart(allowed: int):
    """(a, b, more) of the articles of different chains under one key whose sketches match, ``allowed`` nearest ones of two
    chains at most; ``more`` if there are others."""

    def one(x: np.ndarray, y: np.ndarray, label: np.ndarray, sketch: np.ndarray, same: bool) -> Iterator[np.ndarray]:
        step = max(1, 500_000 // max(1, len(y)))
        reach = half_reach(sketch)
        theirs, reach_y, label_y = np.ascontiguousarray(sketch[y].T), reach[y], label[y]
        for start in range(0, len(x), step):
            here = x[start : start + step]
            mine = sketch[here]
            half = np.bitwise_count((mine[:, :1] ^ theirs[0]) | (mine[:, 1:2] ^ theirs[1]))
            i, j = np.nonzero((half <= np.maximum(reach[here][:, None], reach_y)) & (label[here][:, None] != label_y))
            i, j = here[i], y[j]
            if same:
                i, j = i[i < j], j[i < j]
            # no similarity of a half between sets of which one is over twice as large
            near = (sketch[i, 4] <= 2 * sketch[j, 4]) & (sketch[j, 4] <= 2 * sketch[i, 4])
            i, j = i[near], j[near]
            ok = matching(sketch[i], sketch[j])
            i, j = i[ok], j[ok]
            size = np.minimum(np.minimum(sketch[i, 4], sketch[j, 4]), np.uint64(SIZES)).astype(np.int64)
            ok = differing(sketch[i], sketch[j]) + differing(sketch[i, WIDTH:], sketch[j, WIDTH:]) <= 2 * BINS - BOTH[size]
            yield np.stack([i[ok], j[ok]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sketch = _members(frame, WIDTH + 4)
        label, key, side = frame["label"].to_numpy(), frame["x"].to_numpy(), frame["side"].to_numpy()
        # side 0 meets itself, 1 meets 2, and nothing else
        order = np.lexsort((side, key))
        edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        found = [np.empty((2, 0), np.int64)]
        for a, b in zip(edge[:-1], edge[1:]):
            here = order[a:b]
            sides = [here[side[here] == s] for s in range(3)]
            for x, y, same in ((sides[0], sides[0], True), (sides[1], sides[2], False)):
                found += one(x, y, label, sketch, same)
        i, j = np.concatenate(found, axis=1)
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        one_, two = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        order = np.lexsort((high, low, differing(sketch[i], sketch[j]), two, one_))
        low, high, one_, two = (v[order] for v in (low, high, one_, two))
        fresh = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(low)]
        low, high, one_, two = (v[fresh] for v in (low, high, one_, two))
        head = np.flatnonzero(np.r_[True, (one_[1:] != one_[:-1]) | (two[1:] != two[:-1])][: len(low)])
        size = np.diff(np.append(head, len(low)))
        keep = np.arange(len(low)) - np.repeat(head, size) < allowed
        return pd.DataFrame({"a": low[keep], "b": high[keep], "more": np.repeat(size > allowed, size)[keep]})

    return run


def _blocks_apart(waiting: DataFrame, sketched: DataFrame, labels: DataFrame, blocks: int) -> DataFrame:
    """The members of hot keys, (block, side, x, y, label, sketch), in sub-blocks where chains meet that are apart."""
    named = waiting.join(labels.select(F.col("node").alias("y"), F.col("component").alias("label")), "y", "left").withColumn("label", F.coalesce("label", "y"))
    named, _ = stored(named, "waiting")
    chains = named.groupBy("x", "label").agg(F.count("*").alias("n"))
    # of each key the largest chain meets the others only; a key with one chain is done
    sizes = chains.groupBy("x").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("chains")).where("chains > 1")
    sizes = sizes.select("x", "all", F.col("m.label").alias("largest"), F.ceil(F.col("m.n") / PART).cast("int").alias("large"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("m.n")) / PART)).cast("int").alias("others"))
    rows = named.join(sizes, "x")
    # most keys fit one sub-block
    few = rows.where(F.col("all") <= PART).select(F.pmod("x", F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "x", "y", "label")
    inside = F.col("label") == F.col("largest")
    part = F.when(inside, F.pmod(F.xxhash64("y"), "large")).otherwise(F.pmod(F.xxhash64("y"), "others")).cast("int")
    many = rows.where(F.col("all") > PART).select("x", "y", "label", inside.alias("inside"), "large", "others", part.alias("part"))
    # sub-blocks: each part of the others with itself, with each later part, and with each part of the largest chain
    seq = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    part = F.col("part")
    with_large = F.when(F.col("inside"), F.transform(seq("others"), lambda i: pair(1, i, part, F.lit(2)))).otherwise(F.transform(seq("large"), lambda j: pair(1, part, j, F.lit(1))))
    others = F.transform(seq("others"), lambda k: pair(0, F.least(part, k), F.greatest(part, k), F.when(k == part, 0).when(part < k, 1).otherwise(2)))
    many = many.withColumn("s", F.explode(F.when(F.col("inside"), with_large).otherwise(F.concat(with_large, others))))
    many = many.select(F.xxhash64("x", "s.kind", "s.i", "s.j").alias("block"), F.col("s.side").alias("side"), "x", "y", "label")
    return few.unionByName(many).join(sketched, "y")


def _sets(min_words: int, bitmap: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            place = np.asarray(batch.column("place")).view(np.uint64)
            wanted = batch.filter(pa.array((bits[place >> np.uint64(6) & np.uint64(BITMAP - 1)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for piece in in_pieces(iter([wanted])):
                ids, flat, counts = W.article_words(piece, min_words)
                doc, h, _ = W.shingles(flat, counts)
                edge = np.searchsorted(doc, np.arange(len(ids) + 1))
                # 40 bits of each hash: two of a pair of sets agree by chance once in ten million pairs
                packed = h.view(np.uint8).reshape(-1, 8)[:, :PACKED]
                yield pa.RecordBatch.from_pydict({"article_id": ids, "shingles": [packed[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]}, schema=pa.schema([("article_id", pa.int64()), ("shingles", pa.binary())]))

    return run


def _unpacked(x: bytes) -> np.ndarray:
    h = np.zeros((len(x) // PACKED, 8), np.uint8)
    h[:, :PACKED] = np.frombuffer(x, np.uint8).reshape(-1, PACKED)
    return h.view(np.uint64).ravel()


def _verify(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            value = np.empty(len(frame))
            for k, (x, y) in enumerate(zip(frame["set_a"], frame["set_b"])):
                x, y = _unpacked(x), _unpacked(y)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                value[k] = common / (len(both) - common) if len(both) else 0.0
            yield frame[["a", "b"]].assign(similarity=value)[value >= similarity]

    return run


def shingle_sets(wanted: DataFrame, articles: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(article_id, shingles) of the ``wanted`` ids (article_id) and perhaps a few others, stored; some may come twice.

    Only articles in a bitmap of the wanted ids are shingled, so no text moves.
    The bitmap has ``BITMAP`` words whatever the number of ids: with very many it
    lets all pass, and the joins that follow drop what isn't wanted.
    """
    spark = articles.sparkSession
    place = F.xxhash64(F.col("article_id").cast("long"))
    word = F.shiftrightunsigned(place, 6).bitwiseAND(F.lit(BITMAP - 1)).cast("int")
    # one bit each: eight bytes of a word, so that no shift touches the sign
    found = wanted.select(word.alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.when(F.col("bit") < 32, F.expr("shiftleft(1L, bit)")).otherwise(0)).alias("low"), F.bit_or(F.when(F.col("bit") >= 32, F.expr("shiftleft(1L, bit - 32)")).otherwise(0)).alias("high")).toPandas()
    bits = np.zeros(BITMAP, np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["low"].to_numpy(np.uint64) | (found["high"].to_numpy(np.uint64) << np.uint64(32))
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    rows = articles.select("article_id", "title", "content", place.alias("place")).where("article_id is not null")
    return stored(rows.mapInArrow(_sets(min_words, bitmap), "article_id long, shingles binary"), "shingles")[0]


def with_sets(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach ``similarity`` on their sets; the sets may repeat an id."""
    both = pairs.join(sets.select(F.col("article_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("article_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.mapInPandas(_verify(similarity), "a long, b long, similarity double").dropDuplicates(["a", "b"])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("article_id")).distinct()


def verified(pairs: DataFrame, articles: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The pairs (a, b) of at least ``similarity``, computed on the full sets of shingles."""
    return with_sets(pairs, shingle_sets(ends(pairs), articles, min_words), similarity)


def chains(articles: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(node, component) of each article that is alike to another, chained by alike pairs; a chain is named by its smallest id."""
    rows = articles.select("article_id", "title", "content")
    blocks = 16 + rows.count() // BLOCK_ARTICLES
    keyed = rows.mapInArrow(_emit(blocks, min_words), "block int, " + ", ".join(f"{c} binary" for c in _COLUMNS))
    keyed, _ = stored(keyed.groupBy("block").applyInPandas(_shared, "kind int, x long, y long, sketch binary"), "keys", "kind")
    of = lambda kind: keyed.where(F.col("kind") == kind)
    sketched = of(SKETCH).select("y", "sketch").dropDuplicates(["y"])
    cold = of(COLD).select("x", "y").join(sketched.select("y", F.substring("sketch", 1, 8 * WIDTH).alias("sketch")), "y").withColumn("block", F.pmod("x", F.lit(blocks)))
    pairs = cold.groupBy("block").applyInPandas(_compared, "a long, b long")
    pairs, _ = stored(pairs.union(of(LINK).select("x", "y")).distinct(), "candidates")
    found = components(verified(pairs, articles, similarity, min_words).select("a", "b").union(of(COPY).select("x", "y")))
    # an article that came twice may stand twice under a hot key, in one chain with itself
    waiting, allowed, more = of(WAITING).select("x", "y"), ALLOWED, True
    while more and waiting.head(1):
        apart = _blocks_apart(waiting, sketched, found, blocks).groupBy("block").applyInPandas(_apart(allowed), "a long, b long, more boolean")
        apart, _ = stored(apart.groupBy("a", "b").agg(F.max("more").alias("more")), "apart")
        more = apart.agg(F.max("more")).first()[0]
        if more is None:
            break
        fresh, _ = stored(verified(apart.select("a", "b"), articles, similarity, min_words).select("a", "b"), "links")
        if fresh.head(1):
            found = components(fresh.union(found.select("node", "component")))
        allowed *= ALLOWED
    return found


def duplicate_groups(articles: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(article_id, group_id) of each article in a group of two or more; a group is named by its smallest id."""
    return chains(articles, similarity, min_words).withColumnsRenamed({"node": "article_id", "component": "group_id"})


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (article_id_a < article_id_b) of one group: the listing that the statement of the problem asks for."""
    a = groups.select("group_id", F.col("article_id").alias("article_id_a"))
    b = groups.select("group_id", F.col("article_id").alias("article_id_b"))
    return a.join(b, "group_id").where("article_id_a < article_id_b").select("article_id_a", "article_id_b")
