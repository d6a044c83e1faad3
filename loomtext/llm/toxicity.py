"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, their stems (the first 4, 6 and 8 bytes of longer
words, so that inflected forms share a weight), pairs of neighbours, and pairs with one or two words
between them. Each coordinate has its own learning rate, and the L1 term leaves most weights
at zero, so the model that goes to the executors is a short list of slots and weights.

Fitting uses at most ``per_class`` rows of each label (by hash of the id, within ``labelled``'s
bounds on rows and bytes, whole texts); the intercept is then moved to the shares of the labels over
all labelled ids. Defined cases: null or empty text: the score of a text without features; no
labelled rows: 0 everywhere; labels of one kind only: that label's share; repeated rows: an id counts
once in fitting, and each of its rows is scored; very long texts: read whole, in their own slice;
ties: equal texts have equal scores, a score equal to the threshold predicts 1; empty tables: no
rows; extra columns, whatever their names, are ignored, and pass through ``drop_toxic``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.labelled import held_out, known_labels, sample_texts
from loomtext.llm.vectext import U, lowered, mix, slices, span_hashes, spans
from loomtext.session import cut, ship_package, tidy

BITS = 20
SLOTS = 1 << BITS
#: Words are runs of ASCII letters and of bytes of other letters.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

STEMS = (4, 6, 8)
#: Bytes of text, and slots, that fitting works on at a time.
FIT_BYTES = 1 << 16


def gram_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, rows) of the words, neighbour pairs and skip-grams of one slice."""
    data = lowered(data, latin=True)
    s, e, row = spans(data, offs, NO_WORD)
    words = span_hashes(data, s, e)
    slots, rows = [words], [row]
    for size in STEMS:
        long = e - s > size
        slots.append(mix(span_hashes(data, s[long], s[long] + size) + U(size)))
        rows.append(row[long])
    for gap in (1, 2, 3):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            slots.append(mix(words[:-gap] * U(2 * gap + 1) + words[gap:])[same])
            rows.append(row[gap:][same])
    return (np.concatenate(slots) >> U(64 - BITS)).astype(np.int64), np.concatenate(rows)


@dataclass
class SparseModel:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float32)
        out[self.slots] = self.weights
        return out


class Ftrl:
    """FTRL-proximal: z and n hold the state of every coordinate; slot SLOTS is the intercept, without L1."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == SLOTS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
        g = p - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[str, int]], share: float, epochs: int = 4) -> SparseModel:
    """share: of label 1 among all labelled rows; the rows may hold another mixture."""
    empty = np.zeros(0, np.int64)
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        share = min(max(share, 1e-9), 1 - 1e-9)
        return SparseModel(empty, np.zeros(0, np.float32), math.log(share / (1 - share)))
    # the driver holds this: short slices, and the slots in 32 bits, as views of one array for a slice
    held: list[np.ndarray] = []
    for first, to, data, offs in slices(pa.array([t for t, _ in rows], pa.string()), FIT_BYTES):
        slot, row = gram_slots(data, offs)
        code = np.unique(row * SLOTS + slot)
        cuts = np.searchsorted(code // SLOTS, np.arange(to - first + 1))
        held += np.split((code % SLOTS).astype(np.int32), cuts[1:-1])
    model, order = Ftrl(), np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(np.append(held[i], SLOTS), float(rows[i][1]))
    w = np.concatenate([model.weights(np.arange(a, min(a + FIT_BYTES, SLOTS + 1))) for a in range(0, SLOTS + 1, FIT_BYTES)])
    used = np.flatnonzero(w[:SLOTS])
    odds = lambda p: math.log(p / (1 - p))
    return SparseModel(used, w[used].astype(np.float32), float(w[SLOTS]) + odds(share) - odds(ones / len(rows)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> SparseModel:
    """Fits on at most per_class labelled ids of each value that are not held out."""
    known = cut(known_labels(labels, label, id_col, "int").where(F.col("y").isin(0, 1)))
    share = known.agg(F.avg("y")).first()[0]
    model = fit(sample_texts(docs, known, per_class, id_col=id_col, text_col=text_col), share or 0.0)
    tidy(docs.sparkSession)  # the texts and their slots were the most that the driver holds
    return model


def score(docs: DataFrame, model: SparseModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(scorer(docs, model, threshold), "doc_id long, score double, predicted int")


def scorer(docs: DataFrame, model: SparseModel, threshold: float):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        table = own.table()
        for batch in batches:
            p = scores(batch.column(1), table, own.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def scores(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    for first, to, data, offs in slices(texts):
        slot, row = gram_slots(data, offs)
        some = table[slot] != 0
        code = np.unique(row[some] * SLOTS + slot[some])
        total[first:to] += np.bincount(code // SLOTS, weights=table[code % SLOTS], minlength=to - first)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def drop_toxic(docs: DataFrame, model: SparseModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns, in one pass."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        table = own.table()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), table, own.bias) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    return score(docs, learn(docs, labels, **options)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
