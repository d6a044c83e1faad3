"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every distinct word is a row of symbols; the leaves of its segment tree hold rank * size + position
of the pair that starts there, or a value for "no merge", and inner nodes the least of their two
children. The root therefore names the leftmost lowest-rank merge; a merge changes at most three
leaves, whose paths to the root are recomputed, until the root says that no pair is left. The trees
of many words of one size class are worked on together as columns of arrays.

Around it stands what the vocabulary file states: special tokens are cut out first, then Unicode
composition, white space, lower case, word splitting and the byte alphabet. Defined cases: null text
counts as empty and gives no ids and an empty decoded text; any text length works; repeated rows
give equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import ship_package

NONE = np.int64(1) << 62
#: Chunks of a generation whose ids a worker keeps (two generations), and the longest kept; both cost or save time only.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: What str.split() takes for white space and the word rule doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class SegmentTreeBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library with a BPE model and word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        ids = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            ids[i] = token
        self.tokens = ids
        self.symbol = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        self.last = np.array([vocab[c + self.end] for _, c in sorted(byte_alphabet().items())], np.int64)
        self.base = len(ids)
        pairs = np.array([(vocab[a] * self.base + vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        order = np.lexsort((-rank, pairs[:, 0]))  # of a pair that is listed twice the last holds
        first = np.concatenate(([True], pairs[order, 0][1:] != pairs[order, 0][:-1]))
        order = order[first]
        self.pair, self.rank, self.merged = pairs[order, 0], rank[order], pairs[:, 1]
        self.digits = [str(i) for i in range(len(ids))]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.rank[at], NONE)

    def _merge_class(self, sym: np.ndarray, length: np.ndarray) -> list[tuple[int, ...]]:
        """Merges rows of symbols (padded to a power of two) until no pair of theirs is mergeable."""
        n, size = sym.shape
        cols = np.arange(size)
        tree = np.full((n, 2 * size), NONE)
        valid = cols[None, : size - 1] + 1 < length[:, None]
        ranks = np.where(valid, self._ranks(sym[:, :-1], sym[:, 1:]), NONE)
        tree[:, size : 2 * size - 1] = np.where(ranks < NONE, ranks * size + cols[: size - 1], NONE)
        width = size
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half
        # all flat from here on: slot r * size + i of symbol i in row r, node r * 2 * size + k of its tree
        slots = np.arange(n * size)
        sym, tree, alive = sym.ravel(), tree.ravel(), (cols[None] < length[:, None]).ravel()
        after, before = slots + 1, slots - 1
        first, stop = np.arange(n) * size, np.arange(n) * size + length

        def put(slot: np.ndarray, value: np.ndarray) -> None:
            root = slot // size * (2 * size)
            node = slot - root // 2 + size
            tree[root + node] = value
            for _ in range(size.bit_length() - 1):
                node >>= 1
                at = root + 2 * node
                tree[root + node] = np.minimum(tree[at], tree[at + 1])

        live = np.arange(n)
        top = tree[1 :: 2 * size]
        live = live[top < NONE]
        while len(live):
            top = tree[live * (2 * size) + 1]
            i = first[live] + top % size
            j = after[i]
            k = after[j]
            sym[i] = self.merged[top // size]
            alive[j] = False
            after[i] = k
            put(j, NONE)
            has = k < stop[live]
            a, b = i[has], k[has]
            before[b] = a
            right = np.full(len(live), NONE)
            got = self._ranks(sym[a], sym[b])
            right[has] = np.where(got < NONE, got * size + a % size, NONE)
            put(i, right)
            h = before[i]
            has = h >= first[live]
            a, b = h[has], i[has]
            got = self._ranks(sym[a], sym[b])
            put(a, np.where(got < NONE, got * size + a % size, NONE))
            live = live[tree[live * (2 * size) + 1] < NONE]
        flat, ends = sym[alive].tolist(), np.cumsum(alive.reshape(n, size).sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each of the words (no white space rule applies here: each is one word)."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        found: dict[str, tuple[int, ...]] = {}
        for w in words:
            raw = w.encode()
            classes.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((w, raw))
        for bits, members in classes.items():
            size = 1 << bits
            step = max(1, (1 << 17) >> bits)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                length = np.array([len(raw) for _, raw in part])
                sym = np.zeros((len(part), size), np.int64)
                flat = np.frombuffer(b"".join(raw for _, raw in part), np.uint8)
                sym[np.arange(size)[None] < length[:, None]] = self.symbol[flat]
                ends = np.cumsum(length) - 1
                sym[np.arange(len(part)), length - 1] = self.last[flat[ends]]
                found.update(zip((w for w, _ in part), self._merge_class(sym, length), strict=True))
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each character on its own: no final sigma
        return text.lower()

    def chunks(self, text: str) -> list[str | int]:
        """The blank-free chunks of a text in order, and the ids of special tokens; no word reaches over a chunk's end."""
        if self.cut is None or not self.cut.search(text):
            text = self.normal(text)
            return [text] if ODD_SPACE.search(text) else text.split()
        out: list[str | int] = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[piece])
            else:
                out += self.chunks(piece)
        return out

    def _known(self, chunks: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of all these chunks, from the two generations of the store or learned now."""
        known, new = {}, []
        for c in chunks:
            ids = self.young.get(c)
            if ids is None:
                ids = self.old.get(c)
                if ids is None:
                    new.append(c)
                    continue
                self.young[c] = ids
            known[c] = ids
        if new:
            words = list(map(self.words.findall, new))
            learned = self.learn({w for ws in words for w in ws})
            for c, ws in zip(new, words, strict=True):
                ids = learned[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(learned.__getitem__, ws)))
                known[c] = ids
                if len(c) <= CACHE_CHARS:
                    self.young[c] = ids
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return known

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        lists = [self.chunks(t) for t in texts]
        every: set = set()
        for chunks in lists:
            every.update(chunks)
        marks = {c: (c,) for c in every if isinstance(c, int)}
        get = (self._known(every - marks.keys()) | marks).__getitem__
        return [list(chain.from_iterable(map(get, chunks))) for chunks in lists]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks: the file names no decoder, and special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, SegmentTreeBpe] = {}


def loaded(path: str) -> SegmentTreeBpe:
    if path not in _loaded:
        _loaded[path] = SegmentTreeBpe(path)
    return _loaded[path]


def _groups(texts: pa.Array, max_chars: int = 1 << 20):
    """Runs of texts of about max_chars together; null is empty."""
    held, size = [], 0
    for t in texts:
        s = t.as_py() or ""
        held.append(s)
        size += len(s)
        if size > max_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (only with with_ids), ids_sha256, decoded_sha256 of every row; path names the vocabulary file on every machine."""
    ship_package(docs.sparkSession)

    def run(batches):
        coder = loaded(path)
        for batch in batches:
            done = 0
            for texts in _groups(batch.column(1)):
                rows: tuple[list, ...] = ([], [], [], [])
                for ids in coder.encode_batch(texts):
                    rows[0].append(len(ids))
                    rows[1].append(ids if with_ids else None)
                    rows[2].append(hashlib.sha256(" ".join(map(coder.digits.__getitem__, ids)).encode()).hexdigest())
                    rows[3].append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                cols = [batch.column(0).slice(done, len(texts)), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int32())), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())]
                done += len(texts)
                names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
                keep = [k for k, c in enumerate(names) if with_ids or c != "ids"]
                yield pa.RecordBatch.from_arrays([cols[k] for k in keep], names=[names[k] for k in keep])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")
