"""Encoders: texts to unit vectors, in Arrow batches.

The encoder is a parameter, so a pretrained one can be put in; it is built once
in each Python worker.  ``HashingEncoder`` is a deterministic stand-in whose
vectors depend on the words only: token vectors by hash, masked mean, length 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankspark.sources import files


# The files that make a usable snapshot of an encoder, and the mark of a complete one.
SETTINGS = "config.json"
TOKENIZERS = ("tokenizer.json", "tokenizer.model", "vocab.json")
WEIGHTS = ("model.safetensors.index.json",)
WEIGHT_ENDINGS = (".safetensors", ".bin")
READY = ".snapshot_complete"


def has_snapshot(path: str) -> bool:
    """Whether a folder holds settings, a tokenizer and weights of an encoder."""
    there = set(files.names(path))
    weights = any(n in WEIGHTS or n.endswith(WEIGHT_ENDINGS) for n in there)
    return SETTINGS in there and bool(there & set(TOKENIZERS)) and weights


def ensured_snapshot(path: str, fetch: Callable[[str], None]) -> str:
    """The folder of an encoder, filled by ``fetch`` once: a marked or usable one is taken as it is.

    The mark is set after a complete fetch, so one that broke off is made again.
    """
    if not files.exists(f"{path}/{READY}"):
        if not has_snapshot(path):
            files.make_folder(path)
            fetch(path)
        files.write_text(f"{path}/{READY}", "\n")
    return path


class Encoder(Protocol):
    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """(number of texts, dimensions) float32."""


def output_dimensions(encoder: Encoder) -> int:
    """The length of an encoder's vectors; an error if it doesn't tell."""
    length = getattr(encoder, "dimensions", None)
    if not length:
        raise RuntimeError(f"{type(encoder).__name__} has no dimensions")
    return int(length)


def peak_gpu_gb() -> float:
    """The most memory that this process had on a GPU, in GB; 0 without one."""
    try:
        from torch import cuda
    except ImportError:
        return 0.0
    return cuda.max_memory_allocated() / 1e9 if cuda.is_available() else 0.0


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors (texts, tokens, dimensions) where ``mask`` is set; texts without tokens give zeros."""
    weights = mask[..., None].astype(np.float32)
    return (tokens * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)


def normalised(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


@dataclass(frozen=True)
class HashingEncoder:
    dimensions: int = 64
    max_length: int = 2048
    batch: int = 64

    def _token(self, word: str) -> np.ndarray:
        seeds = np.frombuffer(b"".join(hashlib.sha256(f"{k}|{word}".encode()).digest() for k in range((self.dimensions + 31) // 32)), np.int8)
        return seeds[: self.dimensions].astype(np.float32) / 128

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for start in range(0, len(texts), self.batch):
            words = [t.split()[: self.max_length] for t in texts[start : start + self.batch]]
            longest = max(map(len, words), default=0)
            if not longest:
                continue
            known = {w: self._token(w) for ws in words for w in ws}
            tokens = np.zeros((len(words), longest, self.dimensions), np.float32)
            mask = np.zeros((len(words), longest), bool)
            for k, ws in enumerate(words):
                if ws:
                    tokens[k, : len(ws)] = [known[w] for w in ws]
                    mask[k, : len(ws)] = True
            out[start : start + len(words)] = normalised(mean_pool(tokens, mask))
        return out


def encoded(rows: DataFrame, make: Callable[[], Encoder], text: str = "text", out: str = "embedding", batch: int = 256) -> DataFrame:
    """``rows`` with ``out`` (array<float>) for ``text``; null text counts as empty."""
    keep = [c for c in rows.columns if c != out]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = [t or "" for t in part.column(keep.index(text)).to_pylist()]
                vectors = encoder.encode(texts)
                if vectors.shape != (len(texts), output_dimensions(encoder)):
                    raise RuntimeError(f"{len(texts)} texts gave vectors of shape {vectors.shape}")
                ends = np.arange(len(texts) + 1, dtype=np.int32) * vectors.shape[1]
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*keep, out])

    return rows.select(*keep).mapInArrow(run, schema)
