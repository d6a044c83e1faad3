"""Embedders: objects with a name, the number of dimensions, and vectors(texts) for a batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomtext.session import ship_package

# Terms of retrieval, run sizes, and the number that a digest gives.
TERM = re.compile(r"[^\W_]+")
GRAM_SIZES = (3, 4, 5)
DIGESTS: dict[str, Callable[[bytes], int]] = {
    "blake2b": lambda raw: int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big"),
    "md5": lambda raw: int.from_bytes(hashlib.md5(raw).digest()[:4], "big"),
}
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters counted at a time, and the size of the table of known runs (16 MB in a process).
WINDOW, MEMO_BITS = 1 << 16, 20


def terms(text: str) -> list[str]:
    """Runs of letters and digits of the raw text, each fully case-folded."""
    return [t.casefold() for t in TERM.findall(text)]


class Embedder(Protocol):
    name: str
    dims: int

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row for each text; of any length, cosines divide by the norms."""


class _Memo:
    """Buckets of the runs that a process met last, in a table of fixed size: each distinct run is hashed when it isn't there."""

    def __init__(self, dims: int, digest: str) -> None:
        self.dims, self.number = dims, DIGESTS[digest]
        self.keys, self.values = np.zeros(1 << MEMO_BITS, np.uint64), np.zeros(1 << MEMO_BITS, np.int64)

    def buckets(self, key: np.ndarray, places: np.ndarray, line: str, size: int) -> np.ndarray:
        slot = (key * MIX >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        out = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            keys, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            made = np.array([self.number(line[i : i + size].encode()) % self.dims for i in places[new[first]].tolist()], np.int64)
            out[new] = made[which]
            at, one = np.unique(slot[new[first]], return_index=True)
            self.keys[at], self.values[at] = keys[one], made[one]
        return out


_memo = lru_cache(4)(_Memo)


class HashingEmbedder:
    """Counts of a text's character runs of three to five, over its terms joined by blanks, in hashed buckets.

    A batch is one array of code points, counted a window at a time; a process hashes a run again
    only when others have taken its place in a table of fixed size.
    """

    def __init__(self, dims: int = 256, digest: str = "blake2b") -> None:
        if dims < 1:
            raise ValueError("dims must be positive")
        self.dims, self.digest = dims, digest
        self.name = f"hashing-ngram-{dims}" + ("" if digest == "blake2b" else f"-{digest}")

    def vectors(self, texts: list[str]) -> np.ndarray:
        memo = _memo(self.dims, self.digest)
        flat = [" ".join(terms(t)) for t in texts]
        line = "".join(flat)
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in flat])
        out = np.zeros((len(flat), self.dims))
        for at in range(0, len(points), WINDOW):
            part = points[at : at + WINDOW + GRAM_SIZES[-1] - 1].astype(np.uint64)
            row = np.searchsorted(ends, np.arange(at, at + len(part)), "right")
            for size in GRAM_SIZES:
                last = min(WINDOW, len(part) - size + 1)
                if last <= 0:
                    continue
                key = np.full(last, size, np.uint64)
                for k in range(size):
                    key = (key ^ key >> np.uint64(31)) * MIX + part[k : k + last]
                inside = np.flatnonzero(row[:last] == row[size - 1 : size - 1 + last])
                if len(inside):
                    own = row[inside]
                    cells = (own - own[0]) * self.dims + memo.buckets(key[inside], at + inside, line, size)
                    out[own[0] : own[-1] + 1] += np.bincount(cells, minlength=(own[-1] - own[0] + 1) * self.dims).reshape(-1, self.dims)
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; a text without a run keeps the zero vector."""
        v = self.vectors(texts)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


class TransformerEmbedder:
    """A sentence encoder by the name of its model, loaded when a worker first needs it; needs the optional package sentence_transformers."""

    def __init__(self, model: str, dims: int) -> None:
        self.model, self.dims, self.name = model, dims, model
        self._loaded = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}  # a loaded model stays in its process

    def vectors(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return np.asarray(self._loaded.encode(list(texts), normalize_embeddings=True), float)

    encode = vectors


class TransformerReranker:
    """A cross-encoder by the name of its model, loaded when a worker first needs it; needs the same optional package."""

    def __init__(self, model: str) -> None:
        self.model, self.name = model, model
        self._loaded = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def score(self, query: str, passages: list[str]) -> list[float]:
        if self._loaded is None:
            from sentence_transformers import CrossEncoder

            self._loaded = CrossEncoder(self.model)
        return [float(x) for x in self._loaded.predict([(query, p) for p in passages])]


def encoder(embedder, batch: int = 256) -> Callable[[Column], Column]:
    """A column function that embeds texts; null gives null. The embedder must return as many vectors as texts."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        values, offsets, end = [], [], 0
        for at in range(0, len(texts), batch):
            some = texts.slice(at, batch).to_pylist()
            made = np.asarray(embedder.encode([t or "" for t in some]), float)
            if len(made) != len(some):
                raise ValueError(f"{embedder.name} gave {len(made)} vectors for {len(some)} texts")
            there = np.array([t is not None for t in some], bool)
            values.append(made[there].ravel())
            for t in there.tolist():
                offsets.append(end if t else None)
                end += made.shape[1] if t else 0
        out = pa.ListArray.from_arrays(pa.array([*offsets, end], pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0)))
        pa.default_memory_pool().release_unused()
        return out

    def column(texts: Column) -> Column:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            ship_package(spark)  # bounds the bytes of a batch too
        return run(texts)

    return column
