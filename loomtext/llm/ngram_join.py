"""N-gram Jaccard join over word shingles by prefix trees.

A document is the set of its distinct n-word shingles, as 64-bit hashes in ascending order (the
global order of the tries). Two documents link when den * |A & B| >= num * |A | B|.

1. *Blocks.* With H the largest symmetric difference that two linked sets of a size class can
   have, the hash space is cut into more than H parts, so linked sets agree in whole parts. A
   document emits one key for each part that isn't empty, for its own size class and for those of
   smaller partners. Documents that share a key are put in one block (connected components over
   stars, one edge for each document and key). No link can leave a block. A document with more
   empty parts than its class allows for emits keys of the empty parts too, which keeps this exact.
   Shingles of passages that very many documents share would chain unlike documents into huge
   blocks, so a first pass counts all shingles in a sketch of 2^20 buckets, and those in buckets far
   above the mean take no part in the keys: linked sets differ in at most H shingles, and so in at
   most H of any part of them, which leaves the argument as it was. In a large corpus every
   bucket holds many shingles, and a passage of some hundred documents doesn't show. So the sets
   of blocks over ``chunk_shingles`` are counted and given keys again, among themselves and with
   other hashes, as long as that makes their blocks smaller; links stay within the new blocks too.
2. *Prefix trees.* Each block's distinct sets go to one task and are stored in a compressed trie.
   A set walks the trie, carrying the overlap of the shared path, and leaves a subtree when the
   overlap so far plus the smaller remaining length can't reach the need. One walk finds all
   partners of a set; subtrees of sets known to be in its component are not entered, and the sets
   found walk next, so a group of near copies costs about one walk.
   Blocks that stay over ``chunk_shingles`` are cut into chunks and every pair of chunks gets a
   task of its own: nothing is capped. The pairs go in waves, each of which sends about as many
   shingles as the corpus has, so the disk they take doesn't grow with the number of chunks.
3. Sets with equal fingerprints (two 64-bit sums) count as one set throughout.

Defined cases: null or empty text, or white space only: no shingles, linked with nothing, its own
component. Fewer than n words: one shingle of the whole sequence. Null doc_id: component null,
linked with nothing. Repeated rows: equal results. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import connected_components
from loomtext.llm.vectext import SPACE, U, lowered, mix, shingles, slices, span_hashes, spans
from loomtext.session import cut, ship_package, tidy

#: Rows of block membership up to which they are broadcast (36 bytes each, 9 MB); beyond, the join shuffles.
BROADCAST_ROWS = 250_000
BUCKETS_PER_PARTITION = 4
#: Buckets at least, so that the packed pairs of one task and bucket stay small (16 MB over this).
LEAST_BUCKETS = 4096
SKETCH = 64
#: The counting sketch, and what counts as common in it: this many times the spread over the median of a bucket, and over this many, in the corpus and in large blocks.
SKETCH_BITS, SKETCH_SLICES = 20, 64
COMMON_SPREAD, COMMON_LEAST, COMMON_IN_BLOCKS = 8, 32, 8
#: Rounds of new keys for large blocks at most, and the share of their shingles that must leave for another.
ROUNDS, PROGRESS = 5, 0.1


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a = int(np.add.reduce(mix(s ^ U(0xA0761D6478BD642F)), dtype=U)) if len(s) else 0
    b = int(np.add.reduce(mix(s + U(0xE7037ED1A0B428DB)) * U(0x8EBC6AF09C88C6E3), dtype=U)) if len(s) else 0
    return a - (1 << 63), b - (1 << 63)


def document_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for first, to, data, offs in slices(texts):
        data = lowered(data)
        s, e, row = spans(data, offs, SPACE)
        hashes, at = shingles(span_hashes(data, s, e), row, to - first, n)
        for r in range(to - first):
            yield first + r, np.unique(hashes[at[r] : at[r + 1]])


class SizeClasses:
    """Classes of set sizes, and for each the number of parts and of empty parts allowed for."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ratio = 1.4 if 10 * num >= 9 * den else 1.25  # wider classes mean fewer keys, but fewer elements to a part
        self.low, self.parts, self.empty = [1], [0], [0]
        self._grow(64)

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            low = self.low[-1]
            high = max(low, int(low * self.ratio))
            h = (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            if not h:  # only equal sets link; one size to a class until there can be others
                high = low
                h = (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            k, e = (h + 1, 0) if h else (0, 0)
            if h:
                best = 2.0
                for extra in range(0, 2 * h + 8):
                    parts = h + 1 + extra
                    mean = parts * (1 - 1 / parts) ** low
                    p, term = 1.0, math.exp(-mean)
                    for i in range(extra + 1):
                        p -= term
                        term *= mean / (i + 1)
                    if p < best:
                        best, k, e = p, parts, extra
                    if best < 1e-4 or low < 40 and extra > 2:
                        break
            self.parts[-1], self.empty[-1] = k, e
            self.low.append(high + 1)
            self.parts.append(0)
            self.empty.append(0)

    def of(self, size: int) -> range:
        """The classes of all smaller or equal sizes that a set of this size can link with."""
        if self.low[-1] <= size:
            self._grow(size)
        least = -(-size * self.num // self.den)
        return range(bisect_left(self.low, least + 1) - 1, bisect_left(self.low, size + 1))

    def keys(self, s: np.ndarray, common: np.ndarray, turn: int = 0) -> np.ndarray:
        """The keys of a set; common marks the buckets whose shingles take no part. Every turn has other buckets and parts."""
        out = []
        rest = s[~common[sketch_bucket(s, turn)]]
        for c in self.of(len(s)):
            k = self.parts[c]
            if not k:
                continue
            part = ((mix(rest + U(0x632BE59BD9B4E019 + turn)) >> U(32)) * U(k) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            if len(first):
                sums = np.add.reduceat(mix(rest[order] + U(c)), first)
                out.append(mix(sums ^ mix(part[first].astype(U) + U(c << 32))))
            if k - len(first) > self.empty[c]:
                none = np.setdiff1d(np.arange(k), part[first]).astype(U)
                out.append(mix(mix(none + U(c << 32)) ^ U(0x5851F42D4C957F2D)))
        return np.concatenate(out) if out else np.zeros(0, U)


def sketch_bucket(s: np.ndarray, turn: int) -> np.ndarray:
    return ((mix(s + U(turn)) if turn else s) >> U(64 - SKETCH_BITS)).astype(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts of the elements by 64 hash classes, at most 255: their L1 distance bounds the symmetric difference from below."""
    return np.minimum(np.bincount((s >> U(58)).astype(np.int64), minlength=SKETCH), 255).astype(np.int16)


class PrefixTree:
    """A compressed trie over ascending sequences; its leaves, in order, are the sorted sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        shared = []
        for a, b in zip(sets, sets[1:], strict=False):
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[:m] != b[:m]) if m else ()
            shared.append(int(differs[0]) if len(differs) else m)
        # node: (first leaf, leaf after the last, depth where it starts, depth where it ends, children, starts of children)
        self.root = self._build(0, len(sets), 0, shared)

    def _build(self, lo: int, hi: int, depth: int, shared: list[int]):
        todo, made = [(lo, hi, depth, None)], None
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = len(self.sets[lo]) if hi - lo == 1 else min(min(shared[lo : hi - 1]), len(self.sets[lo]))
            node = [lo, hi, depth, end, [], []]
            if parent is None:
                made = node
            else:
                parent[4].append(node)
                parent[5].append(lo)
            if hi - lo > 1:
                cuts = [lo, *(i + 1 for i in range(lo, hi - 1) if shared[i] == end), hi]
                todo += [(a, b, end, node) for a, b in reversed(list(zip(cuts, cuts[1:], strict=False)))]
        return made

    def linked(self, x: int, wanted: np.ndarray, num: int, den: int) -> Iterator[int]:
        """Leaves among the wanted ones (ascending) that link with set x."""
        s, n, sizes = self.sets[x], len(self.sets[x]), self.size
        todo = [(self.root, wanted, 0, 0)]
        while todo:
            node, some, overlap, used = todo.pop()
            lo, hi, start, end, children, starts = node
            if end > start:
                part = self.sets[lo][start:end]
                to = int(np.searchsorted(s, part[-1], "right"))
                if to > used:
                    at = np.searchsorted(s[used:to], part)
                    overlap += int(np.count_nonzero(s[used:to][np.minimum(at, to - used - 1)] == part))
                used = to
            size = sizes[some]
            need = -(-num * (n + int(size.min())) // (num + den))
            if overlap + min(int(size.max()) - end, n - used) < need:
                continue
            if not children:
                if den * overlap >= num * (n + int(size[0]) - overlap):
                    yield lo
                continue
            cuts = np.searchsorted(some, [*starts, hi])
            todo += [(c, some[a:b], overlap, used) for c, a, b in zip(children, cuts, cuts[1:], strict=False) if b > a]


def link_sets(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component number of every set (sets must be distinct), found through a prefix tree.

    One walk gives all links of a set to sets outside its component, and the sets found walk next,
    so a group of near copies around one text is joined after a few walks.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    tree = PrefixTree([sets[i] for i in order])
    m = len(sets)
    comp, done = np.arange(m), np.zeros(m, bool)
    counts = np.stack([sketch(s) for s in tree.sets])
    size = tree.size
    for seed in range(m):
        todo = [seed]
        while todo:
            x = todo.pop()
            if done[x]:
                continue
            done[x] = True
            n = size[x]
            some = np.flatnonzero((comp != comp[x]) & ~done & (size * den >= n * num) & (size * num <= n * den))
            if len(some):
                far = np.abs(counts[some] - counts[x]).sum(1)
                some = some[far * (den + num) <= (n + size[some]) * (den - num)]
            found = list(tree.linked(x, some, num, den)) if len(some) else []
            if found:
                comp[np.isin(comp, comp[found])] = comp[x]
                todo += found
    out = np.empty(m, np.int64)
    out[order] = comp
    return out


PAIRS = "bucket int, doc_id long, n long, f1 long, f2 long, other long, ks binary, vs binary"
_TYPES = {"bucket": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "other": pa.int64(), "ks": pa.binary(), "vs": pa.binary()}


def _batch(names: list[str], rows: int, **columns) -> pa.RecordBatch:
    """A batch of the named columns; those not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[c]) if c in columns else pa.nulls(rows, _TYPES[c]) for c in names], names=names)


def _own_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(row, set, fingerprint) of every row; where the batch has fingerprints, of the rows that have theirs."""
    known = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("f1", "f2")] if batch.num_columns > 2 else None
    for r, s in document_sets(batch.column(1), n):
        a, b = fingerprint(s)
        if known is None or (a, b) == (known[0][r], known[1][r]):
            yield r, s, a, b


def _counted(batches, n: int, turn: int):
    """The counts of a task's shingles by bucket, in compressed slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        sets = [s for _, s, _, _ in _own_sets(batch, n)] if turn else [s for _, s in document_sets(batch.column(1), n)]
        if sets:
            counts += np.bincount(sketch_bucket(np.concatenate(sets), turn), minlength=len(counts))
    if counts.any():
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SKETCH_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _summed(batches):
    """Adds up the slices, which come sorted by their number."""
    at, total = None, None
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(zlib.decompress(raw.as_buffer()), np.int64)
            if k != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "counts"])
                at, total = k, counts.copy()
            else:
                total += counts
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def common_buckets(base: DataFrame, n: int, turn: int = 0) -> np.ndarray:
    """Which buckets of the sketch hold far more shingles of the corpus (from turn 1 on, of its distinct sets in large blocks) than most; the sketch has a fixed size, whatever the corpus."""
    kind = "slice int, counts binary"
    sums = base.mapInArrow(lambda it: _counted(it, n, turn), kind).repartition(SKETCH_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_summed, kind)
    counts = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.int64)
    for k, raw in sums.collect():
        counts[k] += np.frombuffer(zlib.decompress(raw), np.int64)
    counts = counts.ravel()
    # buckets of rare shingles alone lie close around the median, the closer the larger the corpus
    middle, upper = np.quantile(counts, (0.5, 0.84))
    return counts > max(middle + COMMON_SPREAD * (upper - middle), COMMON_IN_BLOCKS if turn else COMMON_LEAST)


def _key_blobs(batches, n: int, num: int, den: int, buckets: int, packed_common: bytes, round_: int = 0):
    """Rows of documents (in round 0), local edges, and packed (key, set) pairs for each bucket of keys. In later rounds no key holds for two blocks.

    Of all sets of a task that share a key only the least goes on under the key; the others get
    an edge to it here. So a key of many documents sends one pair from each task.
    """
    names = list(_TYPES)
    classes = SizeClasses(num, den)
    common = np.unpackbits(np.frombuffer(packed_common, np.uint8)).astype(bool)
    held: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    count, turn = 0, 0
    limits = np.array([(b << 64) // buckets for b in range(1, buckets)], U)

    def packed():
        nonlocal turn
        k, v = np.concatenate(held), np.concatenate(nodes)
        held.clear()
        nodes.clear()
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(v[first], np.diff(np.append(first, len(k))))
        some = v != least
        edges = np.unique(np.stack([v[some], least[some]], 1), axis=0)
        if len(edges):
            yield _batch(names, len(edges), bucket=((np.arange(len(edges)) + turn) % buckets).astype(np.int32), f1=edges[:, 0], other=edges[:, 1])
            turn += len(edges)
        k, v = k[first], v[first]
        cuts = np.concatenate(([0], np.searchsorted(k, limits), [len(k)]))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        for at in range(0, len(full), 1024):
            some = full[at : at + 1024]
            yield _batch(names, len(some), bucket=some.astype(np.int32), ks=[k[cuts[b] : cuts[b + 1]].tobytes() for b in some], vs=[v[cuts[b] : cuts[b + 1]].tobytes() for b in some])

    for batch in batches:
        sizes, f1, f2 = [], [], []
        block = batch.column("block").to_numpy(zero_copy_only=False).view(U) if round_ else None
        for r, s, a, b in _own_sets(batch, n):
            sizes.append(len(s))
            f1.append(a)
            f2.append(b)
            if len(s):
                ks = classes.keys(s, common, round_)
                if round_:
                    ks = mix(ks ^ mix(block[r : r + 1]))
                if len(ks):
                    held.append(ks)
                    nodes.append(np.full(len(ks), a, np.int64))
                    count += len(ks)
            if count > 1 << 20:
                yield from packed()
                count = 0
        rows = len(sizes)
        if round_:
            continue
        # documents go to any bucket: copies of one text would crowd one otherwise
        yield _batch(names, rows, bucket=((np.arange(rows) * 7919 + turn) % buckets).astype(np.int32), doc_id=batch.column(0).cast(pa.int64()), n=sizes, f1=f1, f2=f2)
        turn += rows
        pa.default_memory_pool().release_unused()
    if held:
        yield from packed()


def _stars(batches):
    """Documents and edges as they are, and an edge from each set under a shared key to the least one of them.

    Rows come sorted by bucket; the pairs of one bucket are held at a time.
    """
    names = ["doc_id", "n", "f1", "f2", "other"]
    bucket, keys, nodes = None, [], []
    out: list[np.ndarray] = []
    count = 0

    def close():
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(v[first], np.diff(np.append(first, len(k))))
        some = v != least
        return np.unique(np.stack([v[some], least[some]], 1), axis=0)

    def flush():
        edges = np.unique(np.concatenate(out), axis=0)
        out.clear()
        for at in range(0, len(edges), 10_000):
            part = edges[at : at + 10_000]
            yield _batch(names, len(part), f1=part[:, 0], other=part[:, 1])

    for batch in batches:
        packed = batch.column("ks").is_valid()
        plain = batch.filter(pa.compute.invert(packed))
        if plain.num_rows:
            yield plain.select(names)
        for b, k, v in zip(*(batch.filter(packed).column(c) for c in ("bucket", "ks", "vs")), strict=True):
            if b.as_py() != bucket:
                if keys:
                    out.append(close())
                    count += len(out[-1])
                    keys.clear(), nodes.clear()
                bucket = b.as_py()
            keys.append(np.frombuffer(k.as_buffer(), U).copy())
            nodes.append(np.frombuffer(v.as_buffer(), np.int64).copy())
        if count > 1 << 18:
            yield from flush()
            count = 0
        pa.default_memory_pool().release_unused()
    if keys:
        out.append(close())
    if out:
        yield from flush()


def _sets_of_members(batches, n: int):
    """The sets of the rows that stand for a fingerprint; other rows under their doc_id drop out."""
    for batch in batches:
        doc, f1, f2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "f1", "f2"))
        block = batch.column("block").to_numpy(zero_copy_only=False)
        chunks, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunks", "low", "high"))
        rows: list[tuple] = []
        held = 0
        names = ["block", "a", "b", "doc_id", "elements"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for r, s in document_sets(batch.column("text"), n):
            if fingerprint(s) != (f1[r], f2[r]):
                continue
            c = int(chunks[r])
            own = int(mix(np.array([f2[r]], np.int64).view(U))[0] % c)
            for other in {(own + way * far) % c for far in range(low[r], min(high[r], c // 2 + 1)) for way in (1, -1)} if c > 1 else (own,):
                rows.append((block[r], min(own, other), max(own, other), doc[r], s.tobytes()))
                held += s.nbytes
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _linked_members(batches, num: int, den: int):
    """Reads members sorted by block and pair of chunks; gives each the least doc_id of its component there."""
    key, docs, sets = None, [], []
    out: list[tuple[int, int]] = []

    def close():
        seen = {}
        for d, s in zip(docs, sets, strict=True):
            seen[s] = min(d, seen.get(s, d))
        arrays = [np.frombuffer(s, U) for s in seen]
        ids = np.array(list(seen.values()), np.int64)
        comp = link_sets(arrays, num, den) if len(arrays) > 1 else np.zeros(len(arrays), np.int64)
        least = np.full(len(arrays), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, ids)
        out.extend(zip(ids.tolist(), least[comp].tolist(), strict=True))

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["doc_id", "label"])
        out.clear()
        return batch

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        sets_here = batch.column(4)
        for i, at in enumerate(zip(cols[0], cols[1], cols[2], strict=True)):
            if at != key:
                if docs:
                    close()
                key, docs, sets = at, [], []
            docs.append(cols[3][i])
            sets.append(sets_here[i].as_py())
        if len(out) > 20_000:
            yield flush()
    if docs:
        close()
    if out:
        yield flush()


def _partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _keyed(base: DataFrame, n: int, num: int, den: int, round_: int = 0) -> DataFrame:
    """The documents (in round 0) and the edges of sets that share a key."""
    parts = _partitions(base.sparkSession)
    buckets = max(parts * BUCKETS_PER_PARTITION, LEAST_BUCKETS)
    common = np.packbits(common_buckets(base, n, round_)).tobytes()  # 128 KB
    blobs = base.mapInArrow(lambda it: _key_blobs(it, n, num, den, buckets, common, round_), PAIRS)
    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "doc_id long, n long, f1 long, f2 long, other long")


def _with_texts(base: DataFrame, side: DataFrame) -> DataFrame:
    """The rows of side with the texts of their rep, as doc_id and text before the other columns."""
    some = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    return base.join(some, F.col("doc_id") == F.col("rep")).select("doc_id", "text", *(c for c in side.columns if c != "rep"))


def _large(members: DataFrame, chunk_shingles: int) -> DataFrame:
    return cut(members.groupBy("block").agg(F.sum("n").alias("held")).where(F.col("held") > chunk_shingles).withColumn("chunks", F.ceil(F.col("held") / F.lit(chunk_shingles)).cast("int")))


def _beside(members: DataFrame, large: DataFrame, how: str) -> DataFrame:
    """Joins members with the few large blocks; as a broadcast they don't deal the members out by a hot block."""
    return members.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "block", how)


def smaller_blocks(base: DataFrame, members: DataFrame, n: int, num: int, den: int, chunk_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The members with the large blocks split by new keys as far as that goes, and (block, held, chunks) of the blocks that stay large.

    A member that shares no key with another in its block links with nothing, and drops out.
    """
    names = ["rep", "f1", "f2", "n", "block"]
    large = _large(members, chunk_shingles)
    held = large.agg(F.sum("held")).first()[0] or 0
    for round_ in range(1, ROUNDS + 1):
        if not held:
            break
        inside = cut(_beside(members, large, "left_semi").select(names))
        edges = cut(_keyed(_with_texts(base, inside.select("rep", "f1", "f2", "block")), n, num, den, round_))
        labels = connected_components(edges, "f1", "other")
        split = inside.drop("block").join(labels, F.col("f1") == F.col("node")).withColumn("block", F.col("label")).select(names)
        members = cut(_beside(members, large, "left_anti").select(names).unionByName(split))
        large = _large(members, chunk_shingles)
        before, held = held, large.agg(F.sum("held")).first()[0] or 0
        tidy(base.sparkSession)
        if held > (1 - PROGRESS) * before:
            break
    return members, large


def _waves(members: DataFrame, large: DataFrame, total: int) -> Iterator[DataFrame]:
    """rep, f1, f2, block, chunks, low, high of the members for one wave of pairs of chunks after the other.

    A wave has the pairs whose numbers lie low to high - 1 apart, around the circle of chunks; a member goes to two
    pairs for each distance, and a wave has as many distances as send about total shingles.
    """
    most, held = large.agg(F.max("chunks"), F.sum("held")).first()
    some = F.coalesce("chunks", F.lit(1)).alias("chunks")
    step = max(1, int(total // (2 * held))) if held else 1
    far = (most or 1) // 2 + 1
    for low in range(1, max(far, 2), step):
        side = _beside(members, large, "left" if low == 1 else "inner").select("rep", "f1", "f2", "block", some).withColumn("low", F.lit(low)).withColumn("high", F.lit(low + step))
        yield side if low == 1 else side.where(F.floor(F.col("chunks") / 2) >= low)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", chunk_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: see the module for the method and the defined cases.

    n words to a shingle and a similarity of num/den or more make a link; component_id is the
    smallest doc_id reachable by links. chunk_shingles bounds the shingles that a task holds (twice).
    """
    spark = docs.sparkSession
    ship_package(spark)
    # no column of docs but these two goes on, whatever the others are called
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = cut(_keyed(base, n, num, den))
    tidy(spark)  # the keys are the largest thing on disk, and done with
    rows = found.where("other is null").select("doc_id", "n", "f1", "f2")
    blocks = connected_components(found.where("other is not null"), "f1", "other")

    same = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    members = cut(same.join(blocks, same.f1 == blocks.node).select("rep", "f1", "f2", "n", F.col("label").alias("block")))
    members, large = smaller_blocks(base, members, n, num, den, chunk_shingles)
    links = None
    total = rows.agg(F.sum("n")).first()[0] or 0
    for side in _waves(members, large, total):
        joined = _with_texts(base, side)
        sets = joined.mapInArrow(lambda it: _sets_of_members(it, n), "block long, a int, b int, doc_id long, elements binary")
        some = cut(sets.repartition(_partitions(spark), "block", "a", "b").sortWithinPartitions("block", "a", "b").mapInArrow(lambda it: _linked_members(it, num, den), "doc_id long, label long"))
        links = some if links is None else links.unionByName(some)
        tidy(spark)
    merged = connected_components(links, "doc_id", "label")

    tidy(spark)
    linked = members.join(merged, members.rep == merged.node).select("f1", "f2", "label")
    known = same.join(linked, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("label", "rep").alias("component"))
    out = rows.join(known, ["f1", "f2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull() | alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id; all columns stay, whatever their names.

    Rows with a null id stay. Rows that share a doc_id share a fate: all go where one of them has a smaller partner.
    """
    found = jaccard_components(docs, id_col=id_col, **options)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
