"""Text decoded with the wrong character encoding: find it and restore it.

Method: a hidden Markov model with one clean state and one state for each
encoding pair (written in W, read as R).  The emission of a word in a pair's
state is the probability of what the pair's inverse transform makes of it
(back to bytes by R, decoded by W) under a character-bigram model of clean
text; in the clean state, of the word as it stands.  Words of plain ASCII look
the same in every state and are skipped, so the chain runs over the words with
other characters; all characters of a word share its label.  A word that a
state can't decode pays for each character lost, so a damaged span still holds
together.  One more state stands for characters lost for good (U+FFFD).  The
Viterbi path labels the text, and each labelled span gets its state's inverse
transform.

The bigram model is trained here, on all words of all documents: the words are
stored once, and each round counts where they lie and adds up the counts, so the
driver gets characters and bigrams only.  However common a garbling is, it must not
pass for a language: documents with a word that is malformed as it stands (letters
of two scripts, signs inside, capitals after small letters, hardly a plain letter
in a Latin word) and well-formed of usual characters under some pair are left out
first; then the model is fitted, and again without the documents that it finds
garbled.  Scoring covers every word of every document.  Only a word that no pair's
inverse could make more probable, however likely the result were, skips it, and a
text whose words could not pay for a garbled span together.

Character references, numeric or named, of characters from 128 on are resolved
first: a garbled text may have been escaped afterwards.

Nulls, empty and ASCII texts are clean; rows are independent, so repeated rows
and ties have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import html.entities
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from operator import add

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rankspark.sources.shared import stored

#: Words of a text that ``spread`` keeps.
SAMPLE_WORDS = 200
ENTER, LEAVE = 8.0, 2.0
#: What a character costs that a state can't decode, and a character already lost.
LOST, MISSING = 7.0, 4.0
#: Words, and words with what the pairs make of them, that a worker remembers.
WORDS, UNDONE = 200_000, 20_000

WORD = re.compile("[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
#: A word from its first character beyond ASCII on; faster to find than its plain beginning.
TAIL = re.compile("[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
REFERENCE = re.compile(r"&(?:#(\d{3,7}|[xX][0-9a-fA-F]{2,6})|([A-Za-z]{2,8}[0-9]{0,2}));")

# The encoding pairs (written, read); western is Windows-1252 with Latin-1's controls in its gaps.
PAIRS = (
    ("utf-8", "western"),
    ("utf-8", "western", "utf-8", "western"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp1250"),
    ("utf-8", "iso8859-2"),
    ("utf-8", "koi8-r"),
    ("utf-8", "cp866"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp1251"),
    ("mac_roman", "western"),
    ("cp437", "western"),
    ("cp850", "western"),
    ("cp1250", "western"),
    ("iso8859-2", "western"),
    ("cp1251", "western"),
    ("koi8-r", "western"),
    ("cp866", "western"),
    ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("utf-8", "cp1253"),
    ("utf-8", "cp1254"),
    ("utf-8", "cp1257"),
    ("utf-8", "gbk"),
    ("utf-8", "big5"),
    ("utf-8", "shift_jis"),
    ("utf-8", "euc_kr"),
    ("gbk", "western"),
    ("big5", "western"),
    ("shift_jis", "western"),
    ("euc_kr", "western"),
)
LOSSY = len(PAIRS) + 1


def _bytes_of(encoding: str) -> dict[int, int]:
    """Character -> byte of a one-byte encoding; its gaps hold Latin-1's controls."""
    found = {}
    for b in range(128, 256):
        found[b if encoding == "western" or b < 160 else -b] = b
        try:
            found[ord(bytes([b]).decode("cp1252" if encoding == "western" else encoding))] = b
        except UnicodeDecodeError:
            found[b] = b
    return found


class _Bytes(dict):
    """Character -> its bytes in an encoding, or None; multi-byte encodings on demand."""

    def __init__(self, encoding: str):
        self.encoding = encoding
        self.wide = encoding in WIDE
        self.codes: dict[int, int] = {}
        if not self.wide:
            super().__init__((c, bytes([b])) for c, b in _bytes_of(encoding).items() if c > 0)
            self.codes = {c: c for c in range(128)} | {c: b[0] for c, b in self.items()}

    def whole(self, word: str) -> bytes | None:
        """The bytes of a word all of whose characters have some."""
        try:
            return word.encode(self.encoding) if self.wide else codecs.charmap_encode(word, "strict", self.codes)[0]
        except UnicodeEncodeError:
            return None

    def __missing__(self, c: int) -> bytes | None:
        if not self.wide:
            return None
        try:
            value = chr(c).encode(self.encoding)
        except UnicodeEncodeError:
            value = None
        self[c] = value
        return value


#: Encodings of which a character may take several bytes.
WIDE = ("gbk", "big5", "shift_jis", "euc_kr")
_BYTES = {name: _Bytes(name) for name in {pair[k] for pair in PAIRS for k in range(1, len(pair), 2)}}


def cut(word: str, read: str) -> list[bytes | str] | None:
    """The word as bytes of an encoding, and as strings what has none; none if that is all beyond ASCII."""
    table = _BYTES[read]
    whole = table.whole(word)
    if whole is not None:
        return [whole]
    out: list[bytes | str] = []
    run, some = bytearray(), False
    for c in map(ord, word):
        if c < 128:
            run.append(c)
            continue
        b = table[c]
        if b is None:
            if run:
                out.append(bytes(run))
                run.clear()
            out.append(chr(c))
        else:
            some = True
            run += b
    if run:
        out.append(bytes(run))
    return out if some else None


def decoded(parts: list[bytes | str], written: str) -> tuple[str, int]:
    out, lost = [], 0
    for part in parts:
        if isinstance(part, bytes):
            part = part.decode(written, "replace")
            lost += part.count("�")
        else:
            lost += 1
        out.append(part)
    return "".join(out), lost


def undo(word: str, written: str, read: str) -> tuple[str, int]:
    """The word with the pair's reading undone, and the characters that couldn't be."""
    parts = cut(word, read)
    return decoded(parts, written) if parts is not None else (word, sum(c > "\x7f" for c in word))


_undone: dict[str, tuple] = {}


def undone(word: str) -> tuple[tuple[int, str, int], ...]:
    """(state, text, lost) of the pairs that make something else of the word."""
    known = _undone.get(word)
    if known is None:
        parts = {read: cut(word, read) for read in _BYTES}
        made = []
        for k, pair in enumerate(PAIRS, 1):
            if parts[pair[1]] is not None:
                text, lost = decoded(parts[pair[1]], pair[0])
                if len(pair) > 2:
                    text, more = undo_pair(text, pair[2:])
                    lost += more
                if text != word:
                    made.append((k, text, lost))
        known = tuple(made)
        if len(_undone) >= UNDONE:
            _undone.clear()
        _undone[word] = known
    return known


def undo_pair(word: str, pair: tuple[str, ...]) -> tuple[str, int]:
    lost = 0
    for k in range(0, len(pair), 2):
        word, more = undo(word, pair[k], pair[k + 1])
        lost += more
    return word, lost


def resolve(text: str) -> str:
    """Character references of characters from 128 on, as characters."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[2]:
            code = html.entities.name2codepoint.get(m[2], 0)
            return chr(code) if code >= 128 else m[0]
        code = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        return chr(code) if 128 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return REFERENCE.sub(one, text)


def words_of(text: str | None) -> list[str]:
    """The matches of ``WORD`` in a text whose references are resolved."""
    if not text or text.isascii() and "&" not in text:
        return []
    text = resolve(text)
    out = []
    for m in TAIL.finditer(text):
        start, end = m.span()
        while start and text[start - 1] in LETTERS:
            start -= 1
        out.append(text[start:end])
    return out


def bigrams(words: Counter) -> Counter:
    """How often one character follows another in words (from a blank to a blank) without lost characters."""
    pairs: Counter = Counter()
    for word, n in words.items():
        if "�" not in word:
            w = f" {word} "
            for pair in map(add, w, w[1:]):
                pairs[pair] += n
    return pairs


class _Terms(dict):
    """Bigram -> logarithm of its second character's probability after the first, on demand."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, pair: str) -> float:
        (a, b), model = pair, self.model
        if b == "�":
            value = -MISSING
        else:
            alone = (model.firsts.get(b, 0) + 0.01) / (model.total + 1000)
            value = math.log((model.pairs.get(pair, 0) + 2 * alone) / (model.firsts.get(a, 0) + 2))
        if len(self) > WORDS:
            self.clear()
        self[pair] = value
        return value


@dataclass
class Model:
    """Character bigrams of clean words (a word starts and ends in a blank)."""

    pairs: dict[str, int] = field(default_factory=dict)
    firsts: dict[str, int] = field(default_factory=dict)
    total: int = 0
    _seen: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.name = uuid.uuid4().hex
        self._terms = _Terms(self)

    def __reduce__(self) -> tuple:
        return _kept, (self.name, self.pairs, self.firsts, self.total)

    @classmethod
    def fit(cls, words: Counter) -> Model:
        return cls.of_pairs(bigrams(words))

    @classmethod
    def of_pairs(cls, pairs: dict[str, int]) -> Model:
        firsts: Counter = Counter()
        for pair, n in pairs.items():
            firsts[pair[0]] += n
        return cls(dict(pairs), dict(firsts), sum(firsts.values()))

    def log_probability(self, word: str) -> float:
        w = f" {word} "
        return sum(map(self._terms.__getitem__, map(add, w, w[1:])))

    def scores(self, word: str) -> np.ndarray | None:
        """Of each state, over the clean one's; none if no state beats it."""
        known = self._seen.get(word)
        if known is None:
            known = (self._score(word),)
            if len(self._seen) > WORDS:
                self._seen.clear()
            self._seen[word] = known
        return known[0]

    def _score(self, word: str) -> np.ndarray | None:
        clean = self.log_probability(word) - 4 * LOST * word.count("�")
        made = undone(word)
        # a probability of 1 would have to make up for what is lost
        if "�" not in word and all(LOST * lost >= -clean for _, _, lost in made):
            return None
        value = np.full(LOSSY + 1, -1e9)
        value[0] = 0.0
        for k, text, lost in made:
            value[k] = self.log_probability(text) - LOST * lost - clean
        if "�" in word:
            value[LOSSY] = self.log_probability(word) - clean
        return value if value.max() > 0 else None

    def garbled(self, words: list[str]) -> bool:
        return any(self.labels(words))

    def labels(self, words: list[str]) -> list[int]:
        """The state of each word on the best path."""
        score = [self.scores(w) for w in words]
        # all that words gain together must pay for one span
        if sum(float(s.max()) for s in score if s is not None) < ENTER + LEAVE - 1e-6:
            return [0] * len(words)
        # words that only the clean state explains cost the others as much as an undecodable one
        flat = np.full(LOSSY + 1, -LOST)
        flat[0] = 0.0
        best, back = np.full(LOSSY + 1, -ENTER), []
        best[0] = 0.0
        for s in score:
            # from the clean state into any, from any back to clean, or stay
            came = np.arange(LOSSY + 1)
            step = best.copy()
            enter = best[0] - ENTER
            came[step < enter] = 0
            step = np.maximum(step, enter)
            out = int(np.argmax(best[1:])) + 1
            if best[out] - LEAVE > best[0]:
                came[0], step[0] = out, best[out] - LEAVE
            back.append(came)
            best = step + (flat if s is None else s)
        best[1:] -= LEAVE
        state = int(np.argmax(best))
        path = []
        for came in reversed(back):
            path.append(state)
            state = int(came[state])
        return path[::-1]


_models: dict[str, Model] = {}


def _kept(name: str, pairs: dict[str, int], firsts: dict[str, int], total: int) -> Model:
    """A model that came to a worker; the tasks of one worker share it with the scores that it remembers."""
    if name not in _models:
        _models.clear()
        _models[name] = Model(pairs, firsts, total)
        _models[name].name = name
    return _models[name]


def text_labels(model: Model, text: str | None) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with references resolved, and (start, end, state) of each word not clean."""
    if not text or text.isascii() and "&" not in text:
        return text or "", []
    text = resolve(text)
    found = list(WORD.finditer(text))
    if not found:
        return text, []
    states = model.labels([m[0] for m in found])
    return text, [(m.start(), m.end(), s) for m, s in zip(found, states) if s]


def restore(model: Model, text: str, rounds: int = 3) -> tuple[str, bool]:
    """The text with its garbled spans undone, and whether nothing was lost."""
    whole = True
    for _ in range(rounds):
        text, spans = text_labels(model, text)
        if not spans:
            break
        out, at = [], 0
        for start, end, state in spans:
            fixed, lost = (text[start:end], 1) if state == LOSSY else undo_pair(text[start:end], PAIRS[state - 1])
            if lost:
                fixed, whole = text[start:end], False
            out += [text[at:start], fixed]
            at = end
        before, text = text, "".join([*out, text[at:]])
        if text == before:
            break
    return text, whole


def spread(words: list[str]) -> list[str]:
    """``SAMPLE_WORDS`` of the words at most, evenly from the whole list, none of them overlong; for a caller's own ``fit_words``."""
    return [w[:100] for w in words[:: -(-len(words) // SAMPLE_WORDS) or 1]]


def _counts(counted: Counter) -> Iterator[pa.RecordBatch]:
    if counted:
        yield pa.RecordBatch.from_pydict({"words": pa.nulls(len(counted), pa.string()), "what": list(counted), "n": list(counted.values())}, schema=pa.schema([("words", pa.string()), ("what", pa.string()), ("n", pa.int64())]))


def word_lists(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words) of the documents that have words beyond ASCII, all of them, a line each; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ["\n".join(words_of(t)) for t in batch.column(1).to_pylist()]
            keep = [k for k, w in enumerate(words) if w]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([words[k] for k in keep], pa.string())], names=[key, "_words"])

    rows = documents.select(key, text).where(F.col(text).isNotNull())
    return stored(rows.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, _words string"), "words")[0]


def usual_characters(seen: dict[str, int], texts: int, share: float = 0.002) -> set[str]:
    """The characters beyond ASCII that many of the texts have."""
    return {c for c, n in seen.items() if n >= max(2, share * texts)}


def _usual(lists: DataFrame) -> set[str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for words in batch.column(0).to_pylist():
                seen.update(c for c in set(words) if c > "\x7f")
            seen[""] += batch.num_rows
        yield from _counts(seen)

    seen = _added(lists.select("_words").mapInArrow(run, "words string, what string, n long"))
    texts = seen.pop("", 0)
    return usual_characters(seen, texts)


def _added(counted: DataFrame) -> dict[str, int]:
    return dict(map(tuple, counted.where("what is not null").groupBy("what").agg(F.sum("n")).collect()))


def _round(lists: DataFrame, bad: Malformed | Model, last: bool = False) -> tuple[DataFrame | None, Model]:
    """The lists without those that are ``bad`` (none in the last round, which has no use for them), and the model of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            split = [(line, line.split("\n")) for line in batch.column(0).to_pylist()]
            good = [(line, w) for line, w in split if not bad.garbled(w)]
            for _, w in good:
                words.update(w)
            if len(words) > WORDS:
                yield from _counts(bigrams(words))
                words.clear()
            if not last:
                none = pa.nulls(len(good), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([line for line, _ in good], pa.string()), none.cast(pa.string()), none], names=["words", "what", "n"])
        yield from _counts(bigrams(words))

    rows = lists.select(lists.columns[-1]).mapInArrow(run, "words string, what string, n long")
    if last:
        return None, Model.of_pairs(_added(rows))
    rows = stored(rows, "clean")[0]
    return rows.where("words is not null").select("words"), Model.of_pairs(_added(rows))


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of clean text, from all words of all documents."""
    return fit_lists(word_lists(documents, key, text))


def fit_lists(lists: DataFrame, rounds: int = 3) -> Model:
    """The same from what ``word_lists`` stored."""
    bad: Malformed | Model = Malformed(_usual(lists))
    for k in range(1, rounds + 1):
        lists, bad = _round(lists, bad, last=k == rounds)
    return bad


def fit_words(texts: list[list[str]], rounds: int = 3) -> Model:
    """The model of clean text from the words of each sample text."""
    texts = [t for t, bad in zip(texts, _malformed(texts)) if not bad]
    model = Model()
    for _ in range(rounds):
        model = Model.fit(Counter(w for t in texts for w in t))
        texts = [t for t in texts if not any(model.labels(t))]
    model._seen.clear()
    return model


@cache
def _script(c: str) -> str:
    name = unicodedata.name(c, "none").split()[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "FULLWIDTH") else name


def well_formed(word: str) -> bool | None:
    """Whether a word of three letters or more looks written by somebody; none for shorter ones."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) < 3:
        return None
    first, last = (next(k for k in order if word[k].isalpha()) for order in (range(len(word)), range(len(word) - 1, -1, -1)))
    if any(not (c.isalpha() or c in "'’-‐–·" or unicodedata.category(c)[0] in "MN") for c in word[first : last + 1]):
        return False
    if len({_script(c) for c in letters}) > 1:
        return False
    if any(a.islower() and b.isupper() for a, b in zip(letters, letters[1:])):
        return False
    return not (_script(letters[0]) == "LATIN" and len(letters) >= 4 and sum(c > "\x7f" for c in letters) > 2 / 3 * len(letters))


class Malformed:
    """Whether a text holds a word that is malformed, but well-formed and made of usual characters under some pair; or that is
    well-formed UTF-8 then.

    A first cleaning, so that frequent garbling doesn't pass for a language.
    """

    def __init__(self, usual: set[str]):
        self.usual = usual
        self._known: dict[str, bool] = {}

    def garbled(self, words: list[str]) -> bool:
        return any(map(self.decodes, words))

    def decodes(self, word: str) -> bool:
        known = self._known.get(word)
        if known is None:
            if len(self._known) > WORDS:
                self._known.clear()
            known = self._known[word] = self._decodes(word)
        return known

    def _decodes(self, word: str) -> bool:
        bad = well_formed(word) is False
        for k, text, lost in undone(word):
            pair = PAIRS[k - 1]
            utf8 = pair[0] == "utf-8"
            if not bad and (not utf8 or len(pair) > 2) or lost or not all(c < "\x80" or c in self.usual for c in text):
                continue
            if utf8 and len(text) < len(word) or bad and len(word) >= 4 and well_formed(text):
                return True
        return False


def _malformed(texts: list[list[str]]) -> list[bool]:
    seen = Counter(c for t in texts for c in set("".join(t)) if c > "\x7f")
    bad = Malformed(usual_characters(seen, len(texts)))
    return [bad.garbled(t) for t in texts]


def found(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key) of each document with at least one garbled passage."""
    lists = word_lists(documents, key, text)
    model = model or fit_lists(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, words in enumerate(batch.column(1).to_pylist()) if model.garbled(words.split("\n"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], names=[key])

    return lists.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}")


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, restored, whole) of each garbled document; ``whole`` is false where characters were lost for good."""
    model = model or fit(documents, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, whole = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if text_labels(model, t)[1]:
                    fixed, ok = restore(model, t)
                    keep.append(k)
                    texts.append(fixed)
                    whole.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], names=[key, "restored", "whole"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, restored string, whole boolean")
