"""Benchmark decontamination by spaced-seed hashing.

A mask picks some positions of a window of words and ignores the others, so a window whose ignored
words were replaced still has the same hash. The hashes of all benchmark windows under all masks
form an index; the windows of every document are looked up in it. Around a hit the item and the
document are laid over each other, and of all stretches with at least four equal words in five the
one with the most equal words is taken: it is an overlap if these are at least ``min_words``, or four
fifths of the words of a shorter item.

Words are runs of ASCII letters and digits and of bytes of other letters, in lower case. The
benchmark is read in blocks of at most ``block_chars`` characters, each broadcast as its index; a
benchmark beyond that makes more passes over the documents, never a larger broadcast.

Defined cases: null or empty texts on either side overlap with nothing, and so do items without
words; items shorter than a mask are looked up as a whole, without gaps; a repeated document or item
gives repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.vectext import U, lowered, mix, slices, span_hashes, spans
from loomtext.session import ship_package

NO_WORD = np.ones(256, bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Window masks; each starts and ends with a position that counts.
MASKS = ("110110011011", "111010110111", "101101101101101", "11111111", "11011011", "1110111")
FILTER_BITS = 22
#: Hits expanded at a time.
EXPANDED = 1 << 20


def words_of(texts: pa.Array):
    """(first row, rows, word hashes, offsets by row) of each slice."""
    for first, to, data, offs in slices(texts):
        data = lowered(data, latin=True)
        s, e, row = spans(data, offs, NO_WORD)
        yield first, to - first, span_hashes(data, s, e), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=to - first))))


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for the window at each word from which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = np.zeros(n, U)
    for k, c in enumerate(mask):
        if c == "1":
            acc = (acc + words[k : k + n]) * U(0x9E3779B97F4A7C15 + 2 * k)
    return mix(acc ^ U(len(mask) * 1000003 + int(mask, 2)))


@dataclass
class SeedIndex:
    items: list  # item ids
    words: list[np.ndarray]
    masks: list[str]
    hashes: list[np.ndarray]  # sorted, by mask
    places: list[np.ndarray]  # (item, word) of each hash

    def filters(self) -> list[np.ndarray]:
        out = []
        for h in self.hashes:
            f = np.zeros(1 << FILTER_BITS, bool)
            f[h >> U(64 - FILTER_BITS)] = True
            out.append(f)
        return out


def build_index(items: list[tuple[object, str]], masks: tuple[str, ...] = MASKS) -> SeedIndex:
    ids, words = [], []
    for first, n, w, at in words_of(pa.array([t for _, t in items], pa.string())):
        for r in range(n):
            if at[r + 1] > at[r]:
                ids.append(items[first + r][0])
                words.append(w[at[r] : at[r + 1]])
    least = min(map(len, masks))
    every = [*masks, *("1" * n for n in sorted({len(w) for w in words if len(w) < least}))]
    hashes, places = [], []
    for mask in every:
        own = [(k, w) for k, w in enumerate(words) if (len(w) >= least if mask in masks else len(w) == len(mask))]
        hs = [masked(w, mask) for _, w in own]
        h = np.concatenate(hs) if hs else np.zeros(0, U)
        p = np.array([(k, i) for (k, _), x in zip(own, hs, strict=True) for i in range(len(x))], np.int64).reshape(-1, 2)
        order = np.argsort(h, kind="stable")
        hashes.append(h[order])
        places.append(p[order])
    return SeedIndex(ids, words, every, hashes, places)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(from, to, equal words) of the stretch with the most equal words of those with four equal in five; the shortest, then the first of such."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))  # not less at the end than at the start: four in five
    count = np.concatenate(([0], np.cumsum(equal)))
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums)  # for each end, the earliest such start
    first = np.searchsorted(count, count[start], "right") - 1  # words that differ there only lengthen it
    first = np.minimum(first, np.arange(len(sums)))
    found = count - count[first]
    to = int(np.lexsort((np.arange(len(sums)) - first, -found))[0])
    return int(first[to]), to, int(found[to])


def overlaps(texts: pa.Array, index: SeedIndex, filters: list[np.ndarray], min_words: int):
    """(row, item number, equal words, words compared, first word in the document, first word in the item), the best of each row and item."""
    for first, n, words, at in words_of(texts):
        row_of = np.repeat(np.arange(n), np.diff(at))
        found = [np.zeros(0, np.int64)]  # row, item and diagonal of the hits in one number, each once
        for mask, hashes, places, sieve in zip(index.masks, index.hashes, index.places, filters, strict=True):
            h = masked(words, mask)
            if not len(h) or not len(hashes):
                continue
            hit = np.flatnonzero(sieve[h >> U(64 - FILTER_BITS)])
            hit = hit[row_of[hit] == row_of[hit + len(mask) - 1]]
            lo, hi = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
            some = np.flatnonzero(hi > lo)
            ends = np.cumsum((hi - lo)[some])
            a = 0
            while a < len(some):  # a word that is repeated often on both sides meets itself in bounded parts
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPANDED, "right")))
                part = some[a:b]
                many = (hi - lo)[part]
                where = np.repeat(hit[part], many)
                which = places[np.repeat(lo[part], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                found.append(np.unique((row_of[where] * len(index.items) + which[:, 0] << 32) + (where - which[:, 1] + (1 << 31))))
                a = b
        codes = np.unique(np.concatenate(found))
        seen = zip((codes >> 32) // len(index.items), (codes >> 32) % len(index.items), (codes & 0xFFFFFFFF) - (1 << 31), strict=True) if len(codes) else ()
        seen = [(int(r), int(k), int(d)) for r, k, d in seen]
        best: dict[tuple[int, int], tuple] = {}
        for r, k, diagonal in seen:
            item = index.words[k]
            a, b = max(int(at[r]), diagonal), min(int(at[r + 1]), diagonal + len(item))
            s, e, equal = best_stretch(words[a:b] == item[a - diagonal : b - diagonal])
            if equal >= min(min_words, -(-4 * len(item) // 5)):
                found = (equal, e - s, a + s - int(at[r]), a + s - diagonal)
                if (r, k) not in best or (-found[0], found[1:]) < (-best[r, k][0], best[r, k][1:]):
                    best[r, k] = found
        for (r, k), found in sorted(best.items()):
            yield (first + r, k, *found)


def indexes(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The index of each block of the benchmark: blocks by the hash of the id, their number by a checked total."""
    some = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = some.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        part = some if blocks == 1 else some.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        yield build_index([(r[0], r[1]) for r in part.orderBy("i", "t").toLocalIterator()])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 3_000_000) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, n_equal, n_compared, doc_word, item_word."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_equal int, n_compared int, doc_word int, item_word int"
    out = None
    for index in indexes(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            filters = own.filters()
            for batch in batches:
                got = list(overlaps(batch.column(1), own, filters, min_words))
                if got:
                    cols = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([own.items[k] for k in cols[1]], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["doc_id", "item_id", "n_equal", "n_compared", "doc_word", "item_word"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 3_000_000) -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns, one pass for each block of the benchmark."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            filters = own.filters()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for found in overlaps(batch.column(at), own, filters, min_words):
                    clean[found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
