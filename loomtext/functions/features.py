"""Sparse features of text segments as sorted integer columns, for scoring inside one row.

A *bag* holds the counts of many segments at once: parallel arrays (segment, key, count) in order of
the key. Keys are exact codes within one call, not hashes, so two bags compare only if one
``Coder`` made both.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa

# Words of the pairwise scorer, sentences and lines, and runs of signs.
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
SEGMENT = re.compile(r"[^\n.!?]+(?:[.!?]+|$)|[^\n]+", re.MULTILINE)
SIGNS = re.compile(r"[^\w]+")
GRAM_SIZES = (3, 4, 5)
#: Products of counts expanded at a time when bags are multiplied.
EXPANDED = 1 << 21


def normal(text: str) -> str:
    """Compatibility composition, full case folding, single blanks."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def words(text: str) -> list[str]:
    return WORD.findall(normal(text))


@dataclass
class Segment:
    start: int
    end: int
    text: str
    words: list[str]


def segments(text: str, least: int = 4, most: int = 80) -> list[Segment]:
    """Sentences and lines of at least ``least`` words, those of more than ``most`` as half-overlapping windows; the whole stripped text where none has so many."""
    found = []
    for piece in SEGMENT.finditer(text):
        core = piece.group().strip()
        own = words(core) if core else []
        if len(own) < least:
            continue
        at = piece.start() + piece.group().index(core[0])
        if len(own) <= most:
            found.append(Segment(at, at + len(core), core, own))
            continue
        spans = [m.span() for m in WORD.finditer(core)]  # of the raw text; composition can change their number
        step = max(1, most // 2)
        if not spans:
            continue
        last = max(0, -(-(len(spans) - most) // step))
        for k in range(last + 1):
            a, b = spans[k * step][0], spans[min(k * step + most, len(spans)) - 1][1]
            found.append(Segment(at + a, at + b, core[a:b], own[k * step : k * step + most]))
    if not found and (own := words(text)):
        core = text.strip()
        at = text.index(core)
        found.append(Segment(at, at + len(core), core, own))
    return found


@dataclass
class Bag:
    segment: np.ndarray
    key: np.ndarray
    count: np.ndarray
    n: int

    def squares(self) -> np.ndarray:
        return np.bincount(self.segment, weights=self.count.astype(float) ** 2, minlength=self.n)

    def totals(self) -> np.ndarray:
        return np.bincount(self.segment, weights=self.count, minlength=self.n)


def bag(segment: np.ndarray, key: np.ndarray, n: int) -> Bag:
    order = np.lexsort((segment, key))
    segment, key = segment[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])))) if len(key) else np.zeros(0, np.int64)
    return Bag(segment[first], key[first], np.diff(np.append(first, len(key))), n)


class Coder:
    """Codes of words and characters, shared by the bags that are to be compared."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def word_bags(self, lists: list[list[str]]) -> tuple[Bag, Bag]:
        """(single words and neighbours, words of more than two characters) of each list."""
        n = len(lists)
        seg = np.repeat(np.arange(n), [len(w) for w in lists])
        ids = np.array([self.ids.setdefault(w, len(self.ids)) for ws in lists for w in ws], np.int64)
        long = np.array([len(w) > 2 for ws in lists for w in ws], bool)
        same = np.flatnonzero(seg[1:] == seg[:-1])
        pairs = (ids[same] + 1 << 31) + ids[same + 1]
        return bag(np.concatenate((seg, seg[same])), np.concatenate((ids, pairs)), n), bag(seg[long], ids[long], n)

    @staticmethod
    def char_bags(sides: list[list[str]]) -> list[Bag]:
        """For each side the bag of the character runs of its texts; signs count as a blank, edge blanks too."""
        flat = [[SIGNS.sub(" ", normal(t)) for t in texts] for texts in sides]
        points = [np.frombuffer("".join(ts).encode("utf-32-le"), np.uint32) for ts in flat]
        alphabet = np.unique(np.concatenate(points)) if points else np.zeros(0, np.uint32)
        bits = max(1, int(len(alphabet)).bit_length())
        out = []
        for texts, chars in zip(flat, points, strict=True):
            seg = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            code = np.searchsorted(alphabet, chars).astype(np.uint64)
            keys, at = [], []
            for size in GRAM_SIZES:
                count = len(code) - size + 1
                if count <= 0:
                    continue
                key = np.zeros(count, np.uint64)
                for k in range(size):
                    if size * bits <= 62:
                        key = key << np.uint64(bits) | code[k : k + count]
                    else:  # thousands of different characters: a 62-bit hash of the run
                        key = ((key ^ code[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)) ^ (key >> np.uint64(29))
                inside = seg[:count] == seg[size - 1 :]
                keys.append((key[inside] & np.uint64((1 << 62) - 1)) | np.uint64(GRAM_SIZES.index(size) << 62))
                at.append(seg[:count][inside])
            out.append(bag(np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64), len(texts)))
        return out


def products(a: Bag, b: Bag, combine=np.multiply) -> np.ndarray:
    """The matrix of sums over common keys of combine(count in a, count in b); expansion is bounded, whatever the bags."""
    out = np.zeros(a.n * b.n)
    lo, hi = np.searchsorted(b.key, a.key, "left"), np.searchsorted(b.key, a.key, "right")
    some = np.flatnonzero(hi > lo)
    many = (hi - lo)[some]
    ends = np.cumsum(many)
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
        left = np.repeat(some[at:to], many[at:to])
        start = np.repeat(lo[some[at:to]] - np.concatenate(([0], np.cumsum(many[at:to])[:-1])), many[at:to])
        right = start + np.arange(len(left))
        out += np.bincount(a.segment[left] * b.n + b.segment[right], weights=combine(a.count[left], b.count[right]), minlength=a.n * b.n)
        at = to
    return out.reshape(a.n, b.n)


def cosines(a: Bag, b: Bag) -> np.ndarray:
    dot = products(a, b)
    norms = np.sqrt(a.squares())[:, None] * np.sqrt(b.squares())[None]
    return np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def containments(source: Bag, candidate: Bag) -> np.ndarray:
    """Share of the candidate's counts that the source holds, with multiplicity."""
    common = products(source, candidate, np.minimum)
    total = np.broadcast_to(candidate.totals()[None], common.shape)
    return np.divide(common, total, out=np.zeros_like(common), where=total > 0)


def codes(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes of the code points in their order, and the number of different ones."""
    top = int(points.max()) if len(points) else 0
    if top >= 1 << 12:
        alphabet, code = np.unique(points, return_inverse=True)
        return code.astype(np.uint64), len(alphabet)
    there = np.zeros(top + 1, bool)
    there[points] = True
    number = np.cumsum(there).astype(np.uint64)
    return (number - np.uint64(1))[points], int(number[-1])


def run_counts(code: np.ndarray, letters: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct run, count), in order of the runs, for the codes of a text."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits, place = max(1, (letters - 1).bit_length()), n.bit_length()
    if size * bits > 64:  # thousands of different characters
        _, first, count = np.unique(np.lib.stride_tricks.sliding_window_view(code, size), axis=0, return_index=True, return_counts=True)
        return first, count
    key = code[:n].copy()
    for k in range(1, size):
        key <<= np.uint64(bits)
        key |= code[k : k + n]
    if size * bits + place > 64:
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return first, count
    # the run and its place in one number: sorting plain numbers is several times faster than sorting places
    key <<= np.uint64(place)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    run = key >> np.uint64(place)
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    return (key[start] & np.uint64((1 << place) - 1)).astype(np.int64), np.diff(np.append(start, n))


def top_character_runs(text: str, k: int) -> tuple[int, int, list[tuple[str, int]]]:
    """(distinct runs, sum of squared counts, the k most frequent runs, shorter and lesser ones first among equals)."""
    flat = SIGNS.sub(" ", normal(text))
    code, letters = codes(np.frombuffer(flat.encode("utf-32-le"), np.uint32))
    distinct = squares = 0
    best = []
    for size in GRAM_SIZES:
        first, count = run_counts(code, letters, size)
        distinct += len(first)
        squares += int((count * count).sum())
        if len(first):
            # runs stand in their order, so of equal counts the first ones are the lesser
            least = np.partition(count, max(0, len(count) - k))[max(0, len(count) - k)]
            some = np.flatnonzero(count >= least)
            some = some[np.argsort(-count[some], kind="stable")[:k]]
            best += [(-int(count[i]), size, flat[first[i] : first[i] + size]) for i in some.tolist()]
    return distinct, squares, [(g, -c) for c, _, g in sorted(best)[:k]]


def top_word_grams(text: str, k: int) -> tuple[int, int, list[tuple[str, int]]]:
    """As above for single words (w:) and neighbours (b:)."""
    own = words(text)
    counts = Counter(f"w:{w}" for w in own)
    counts.update(f"b:{a}_{b}" for a, b in pairwise(own))
    return len(counts), sum(c * c for c in counts.values()), sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


def top_features(docs, kind: str, k: int = 5, id_col: str = "doc_id", text_col: str = "text"):
    """id, rank, feature, cnt, n_distinct, sum_squares: the k most frequent features of each text, counted inside its row (no exchange). Null texts count as empty and have no row."""
    from pyspark.sql import functions as F

    from loomtext.session import ship_package, spread

    ship_package(docs.sparkSession)
    of = {"words": top_word_grams, "characters": top_character_runs}[kind]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct, squares, best = of(text, k)
                for rank, (feature, n) in enumerate(best, 1):
                    for col, x in zip(cols, (i, rank, feature, n, distinct, squares), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "rank", "feature", "cnt", "n_distinct", "sum_squares"])

    return spread(base).mapInArrow(run, "id long, rank int, feature string, cnt long, n_distinct long, sum_squares long").withColumnRenamed("id", id_col)
