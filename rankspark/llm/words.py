"""Words and word shingles of articles, computed batch-wise with numpy.

The text similarity of the near-duplicate operators works on the *set* of
``width``-word sequences of title and content.  Everything here takes whole
texts and returns one flat array for a batch, so the per-document Python cost
is one regex pass; hashing, shingling and de-duplication are vectorised.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash

MARK = re.compile(r"\[\d+\]|\(TS:\s*\d+\)")
TAG = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W_]+")
#: Words kept in a worker's hash table before it is emptied: memory stays bounded.
TABLE = 300_000
HASH_BITS = 48
_MASK = np.uint64((1 << HASH_BITS) - 1)


class _Hashes(dict):
    """word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def title_words(title: str | None) -> list[str]:
    return WORD.findall(MARK.sub(" ", title).lower()) if title else []


def content_words(content: str | None) -> list[str]:
    """Tags become a space, entities are decoded, letters and digits form words."""
    if not content:
        return []
    if "<" in content:
        content = TAG.sub(" ", content)
    if "&" in content:
        content = html.unescape(content)
    return WORD.findall(content.lower())


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, flat, and the number of words of each text."""
    if len(_hashes) > TABLE:
        _hashes.clear()
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.empty(int(counts.sum()), dtype=np.uint64)
    at = 0
    look = _hashes.__getitem__
    for words in texts:
        flat[at : at + len(words)] = list(map(look, words))
        at += len(words)
    return flat, counts


def article_words(batch: pa.RecordBatch, min_words: int, piece: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, word hashes, words of each) of the articles of a batch with ``min_words`` words of content or more.

    A null id is left out and of an id's rows the first counts.  Words exist as
    strings for ``piece`` articles at a time only.
    """
    ids: list[int] = []
    seen: set[int] = set()
    flats, counts = [], []
    for start in range(0, batch.num_rows, piece):
        part, texts = batch.slice(start, piece), []
        for i, title, content in zip(part.column("article_id").to_pylist(), part.column("title").to_pylist(), part.column("content").to_pylist()):
            if i is None or i in seen:
                continue
            body = content_words(content)
            if len(body) >= min_words:
                seen.add(i)
                ids.append(i)
                texts.append(title_words(title) + body)
        flat, count = word_hashes(texts)
        flats.append(flat)
        counts.append(count)
    none = np.empty(0, np.uint64)
    return np.array(ids, np.int64), np.concatenate([none, *flats]), np.concatenate([np.empty(0, np.int64), *counts])


def text_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each article's whole sequence of words."""
    edge = np.concatenate([[0], np.cumsum(counts)])
    return np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(flat: np.ndarray, counts: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, 48-bit shingle hash, anchor), distinct per document, sorted.

    The anchor of a shingle is the smallest word hash in it: neighbouring
    shingles mostly share it.  A text shorter than ``width`` words has none.
    """
    n = len(flat) - width + 1
    if n <= 0:
        none = np.empty(0, np.uint64)
        return np.empty(0, np.int64), none, none
    doc = np.repeat(np.arange(len(counts)), counts)
    h, anchor = flat[:n].copy(), flat[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : n + k]
        anchor = np.minimum(anchor, flat[k : n + k])
    inside = doc[:n] == doc[width - 1 :]
    h, anchor, doc = mix(h[inside]) & _MASK, anchor[inside], doc[:n][inside]
    if len(counts) > 1 << 64 - HASH_BITS:
        order = np.lexsort((h, doc))
        doc, h, anchor = doc[order], h[order], anchor[order]
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
        return doc[fresh], h[fresh], anchor[fresh]
    # up to 2^16 documents: one key sorts by document and hash
    key = (doc.astype(np.uint64) << np.uint64(HASH_BITS)) | h
    key, first = np.unique(key, return_index=True)
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & _MASK, anchor[first]
