"""Token ids of whole texts by a public byte-level BPE vocabulary.

Method: prefix dynamic programming.  For every byte prefix of a piece the table
holds the one token that ends the encoding of that prefix: the encoding of a
prefix is the encoding of a shorter prefix plus one token, and exactly one
token fits, namely the one that may follow the shorter prefix's last token.
Two tokens may stand side by side when undoing their merges from the highest
rank down never meets a pair that the merges would have joined first.  The
table makes appending exact and lets an edit re-encode only its surroundings.

The vocabulary is read from a rank file whose path is a parameter; nothing is
copied or trained.  Texts are first split by the vocabulary's own pattern, so
the tables are kept by distinct piece in each Python worker.

Nulls and empty texts have no ids (an empty list); any text length works, in
time linear in its bytes; markers such as ``<|endoftext|>`` are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary and splits a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept in a worker's table before it is emptied.
TABLE = 400_000


class Vocabulary:
    """Tokens by bytes, and how each was merged."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(piece): int(number) for piece, number in map(bytes.split, lines)}
        self.piece = {number: piece for piece, number in self.rank.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        # longest token by its last two bytes: how far back a last token can reach
        self.reach: dict[bytes, int] = {}
        for piece in self.rank:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        for number in sorted(self.piece):
            piece = self.piece[number]
            for cut in range(1, len(piece)):
                left, right = self.rank.get(piece[:cut], number), self.rank.get(piece[cut:], number)
                if left < number and right < number and self.fits(left, right):
                    self.parts[number] = (left, right)
                    self.joined[left, right] = number
                    break

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        The boundary between both stays when no merge across it comes before the
        merges that built the two sides: undo the later merge of the two again
        and again, and look for a join across that ranks earlier.
        """
        until = 1 << 60
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < until:
                return False
            undo_left = left in self.parts and (left > right or right not in self.parts)
            if undo_left:
                until = left
                left = self.parts[left][1]
            elif right in self.parts:
                # at equal ranks the left merge happens first, so a join that needs it is still in time
                until = right + 1
                right = self.parts[right][0]
            else:
                return True


class Prefixes:
    """The table of one piece: ``last[i]`` ends the encoding of the first ``i + 1`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def _end(self, stop: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        # a token of two bytes or more ends in the last two bytes
        most = max(v.reach.get(bytes(data[stop - 2 : stop]), 1), 1) if stop > 1 else 1
        for length in range(min(most, stop), 0, -1):
            token = v.rank.get(bytes(data[stop - length : stop]))
            if token is not None and (length == stop or v.fits(last[stop - length - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        """Exact: what stands before is not encoded again."""
        for byte in data:
            self.data.append(byte)
            self.last.append(self._end(len(self.data)))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of [start, stop); the number of prefixes computed.

        Behind the edit, computing stops once as many entries in a row as the
        longest token has bytes agree with the old table: from there on each
        entry follows from the same bytes and the same entries.
        """
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start:]
        self.append(data)
        longest, same, done = max(self.vocabulary.reach.values()), 0, len(data)
        for k, byte in enumerate(tail):
            if same >= longest:
                self.data += tail[k:]
                self.last += old[k:]
                break
            self.data.append(byte)
            self.last.append(self._end(len(self.data)))
            same = same + 1 if self.last[-1] == old[k] else 0
            done += 1
        return done

    def ids(self) -> list[int]:
        found, at = [], len(self.last)
        while at:
            token = self.last[at - 1]
            found.append(token)
            at -= len(self.vocabulary.piece[token])
        return found[::-1]


class _Pieces(dict):
    """piece -> ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.rank.get(data)
        # a vocabulary's token that its own merges build encodes itself
        if whole is not None and (len(data) == 1 or whole in self.vocabulary.parts):
            ids: tuple[int, ...] = (whole,)
        else:
            ids = tuple(Prefixes(self.vocabulary, data).ids())
        if len(self) > TABLE:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(Vocabulary(path))

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0


@lru_cache(2)
def encoder(path: str = RANKS) -> Encoder:
    """One for a Python worker."""
    return Encoder(path)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, ids array<int>), one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [np.array(encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, *keep: str, text: str = "text", path: str = RANKS) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (long), one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            tokens = pa.array([count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], tokens], names=[*keep, "tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(text, *keep).mapInArrow(run, f"{schema}, tokens long")
