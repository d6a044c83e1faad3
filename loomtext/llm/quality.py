"""Document quality by Bradley-Terry pairwise ranking.

A document's utility is a weighted sum of measures of its text. Preference pairs (a document of
quality 1 over one of quality 0) give a logistic loss on the difference of their measures, whose
minimum Newton steps find. The cut is a quantile of the utilities: as many of the (label-weighted)
fitting rows fall below it as labelled ids are of quality 0. Scores are the logistic of
utility minus cut, moved so that the cut has the score ``threshold``.

Fitting uses every labelled id that is not held out, and all pairs of them. The measures of the
documents are taken once, written, and read by every pass. The loss of a pair depends on its two
utilities alone, so a step needs no pairs: the counts and sums of measures by a grid of utilities
(``STEP`` apart) give the gradient and the mixed part of the Hessian, a second pass gives the rest.
The driver holds such sums only. The cut is exact: counts narrow the interval that holds it.

Defined cases: null or empty text: the
score of measures that are all zero; labels of one kind or none: every score is that share (0 for
none); repeated rows: an id counts once in fitting, with the least of its texts' measures, and each of its rows is scored; very long texts:
read whole, in their own slice; ties: equal texts have equal scores, a score equal to the threshold
predicts 1; empty tables: no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.labelled import held_out, known_labels
from loomtext.llm.vectext import SPACE, U, lowered, slices, span_hashes, spans
from loomtext.session import cut, ship_package

CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence marks, 6 other ASCII signs, 7 line end
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 6
CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
CLASS[[32, 9, 11, 12, 13]], CLASS[10] = 4, 7
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
#: The grid of utilities that a step of fitting uses, labelled rows to a task of it, and rows that one look for the cut may bring.
STEP, REACH = 1 / 16, 20.0
ROWS_PER_TASK, TASKS, LOOK = 20_000, 64, 1000
NAMES = ["lower", "upper", "digit", "sentence marks", "signs", "lines", "shouting marks", "bars", "word length", "long words", "capital words", "signed words", "repeated neighbours", "distinct words", "distinct pairs", "repeated lines", "log words", "sentences"]


def measures(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), len(NAMES)))
    for first, to, data, offs in slices(texts):
        n = to - first
        if not len(data):
            continue
        row = np.repeat(np.arange(n), np.diff(offs))
        kind = CLASS[data]
        by = np.bincount(row * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
        size = np.maximum(by.sum(1), 1)
        s, e, wrow = spans(data, offs, SPACE)
        words = np.bincount(wrow, minlength=n).astype(float)
        some = np.maximum(words, 1)
        count = lambda r, w=None: np.bincount(r, weights=w, minlength=n)
        h = span_hashes(lowered(data), s, e)
        same = np.flatnonzero((h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])) if len(h) else np.zeros(0, int)
        inside = wrow[1:] == wrow[:-1]  # no pair reaches into the row before, which is another one in another batch
        pair = (h[1:] * U(3) + h[:-1])[inside]

        def distinct(rows, values):
            if not len(rows):
                return np.zeros(n)
            order = np.lexsort((values, rows))
            r, v = rows[order], values[order]
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])))
            return count(r[new])

        ls, le, lrow = spans(data, offs, NEWLINE)
        lines = np.maximum(count(lrow), 1)
        last = data[e - 1] if len(e) else data[:0]
        out[first:to] = np.stack([
            by[:, 1] / size, by[:, 2] / size, by[:, 3] / size, by[:, 5] / size, by[:, 6] / size, by[:, 7] / size,
            count(row[data == 33]) / size, count(row[data == 124]) / size,
            count(wrow, (e - s).astype(float)) / some / 10, count(wrow, (e - s > 20).astype(float)) / some,
            count(wrow, ((CLASS[data[s]] == 2) & (CLASS[data[np.minimum(s + 1, e - 1)]] == 2)).astype(float)) / some if len(s) else np.zeros(n),
            count(wrow, (CLASS[last] == 6).astype(float)) / some if len(s) else np.zeros(n),
            count(wrow[same]) / some, distinct(wrow, h) / some, distinct(wrow[1:][inside], pair) / some,
            1 - distinct(lrow, span_hashes(data, ls, le)) / lines, np.log1p(words) / 10, count(row[data == 46]) / some,
        ], 1)
    return out


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float
    fixed: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        u = ((x - self.mean) / self.scale) @ self.weights - self.cut + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the packed measures of every row, written once."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in measures(batch.column(1))], pa.binary())], names=["doc_id", "x"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(base.mapInArrow(run, "doc_id long, x binary"))


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), len(NAMES))


def partials(rows: DataFrame, f, join) -> list[np.ndarray]:
    """f(measures, labels) of the batches of rows, joined within each task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = f(unpacked(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False))
                total = v if total is None else join(total, v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], names=["s"])

    return [np.frombuffer(bytes(r[0])) for r in rows.mapInArrow(run, "s binary").collect()]


def summed(rows: DataFrame, f, *shape: int) -> np.ndarray:
    return sum(partials(rows, f, np.add), np.zeros(math.prod(shape))).reshape(shape)


def grid(u: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(u, -REACH, REACH) + REACH) / STEP).astype(np.int64)


def weighted_cut(rows: DataFrame, utility, weight: np.ndarray, share: float) -> float:
    """Midway between the first utility, in order, where the weights (by label) reach share, and the next one."""

    def ends(x, y):
        u = utility(x)
        return np.array([u.min(), -u.max()])

    lo, hi = np.min(partials(rows, ends, np.minimum), axis=0) * (1, -1)
    closed, below = True, 0.0
    inside = lambda u: (u >= lo) & ((u <= hi) if closed else (u < hi))
    for _ in range(8):
        edges = np.linspace(lo, hi, 1025)
        if not (np.diff(edges) > 0).all():
            break

        def counted(x, y, edges=edges, some=inside):
            u = utility(x)
            own = some(u)
            at = np.minimum(np.searchsorted(edges, u[own], "right") - 1, 1023)
            return np.bincount(at * 2 + y[own], minlength=2048).astype(float)

        by = summed(rows, counted, 1024, 2)
        reached = below + np.cumsum(by @ weight)
        j = min(int(np.searchsorted(reached, share - 1e-12)), 1023)
        below = reached[j - 1] if j else below
        lo, hi, closed = float(edges[j]), float(edges[j + 1]), closed and j == 1023
        inside = lambda u, lo=lo, hi=hi, closed=closed: (u >= lo) & ((u <= hi) if closed else (u < hi))
        if by[j].sum() <= LOOK:
            break

    def gathered(x, y, some=inside):
        u = utility(x)
        values, at = np.unique(u[some(u)], return_inverse=True)
        own = np.bincount(at * 2 + y[some(u)], minlength=2 * len(values)).reshape(-1, 2)
        beyond = np.min(u[~some(u) & (u >= hi)], initial=np.inf)
        return np.concatenate(([beyond, 0, 0], np.column_stack((values, own)).ravel()))

    found = [p.reshape(-1, 3) for p in partials(rows, gathered, lambda a, b: np.concatenate((a, b)))]
    found = np.concatenate(found)
    one = found[:, 1:].sum(1) > 0
    beyond = found[~one, 0].min()
    values, at = np.unique(found[one, 0], return_inverse=True)
    by = np.stack([np.bincount(at, weights=found[one, c], minlength=len(values)) for c in (1, 2)], 1)
    reached = below + np.cumsum(by @ weight)
    j = min(int(np.searchsorted(reached, share - 1e-12)), len(values) - 1)
    # another row of the same utility comes next if the share is reached before the last of them
    spare = reached[j] - share > min(w for w, n in zip(weight, by[j], strict=True) if n) * (1 - 1e-9)
    following = values[j] if spare else values[j + 1] if j + 1 < len(values) else beyond
    return float((values[j] + (following if math.isfinite(following) else values[j])) / 2)


def fit(rows: DataFrame, share: float, threshold: float, ridge: float = 1e-2) -> RankModel:
    """rows: y and x (packed measures); share: of quality 1 among all labelled ids."""
    d = len(NAMES)
    first = summed(rows, lambda x, y: np.concatenate(([len(y), y.sum()], x.sum(0))), d + 2)
    n, good = first[0], first[1]
    bad = n - good
    if not good or not bad:
        return RankModel(np.zeros(1), np.ones(1), np.zeros(1), 0.0, threshold, fixed=float(share))
    mean = first[2:] / n
    scale = np.maximum(np.sqrt(summed(rows, lambda x, y: np.square(x - mean).sum(0), d) / n), 1e-6)
    at = np.arange(-REACH, REACH + STEP / 2, STEP)
    wrong = 1 / (1 + np.exp(at[:, None] - at))  # the probability of the wrong order of a good and a bad one
    both = wrong * (1 - wrong)
    w = np.zeros(d)
    for _ in range(25):

        def by_grid(x, y, w=w):
            z = (x - mean) / scale
            k = y * len(at) + grid(z @ w)
            return np.stack([np.bincount(k, weights=v, minlength=2 * len(at)) for v in (np.ones(len(k)), *z.T)], 1).ravel()

        (nb, zb), (ng, zg) = ((s[:, 0], s[:, 1:]) for s in summed(rows, by_grid, 2, len(at), d + 1))
        weight = np.concatenate((both.T @ ng, both @ nb))

        def squares(x, y, w=w, weight=weight):
            z = (x - mean) / scale
            return ((z * weight[y * len(at) + grid(z @ w)][:, None]).T @ z).ravel()

        mixed = zg.T @ both @ zb
        hessian = (summed(rows, squares, d, d) - mixed - mixed.T) / (good * bad)
        step = np.linalg.solve(hessian + ridge * np.eye(d), (zg.T @ (wrong @ nb) - zb.T @ (wrong.T @ ng)) / (good * bad) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    middle = weighted_cut(rows, lambda x: ((x - mean) / scale) @ w, np.array([(1 - share) / bad, share / good]), 1 - share)
    return RankModel(mean, scale, w, middle, threshold)


def learn(table: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, id_col: str = "doc_id") -> RankModel:
    """Fits on all labelled ids of a table of measures that are not held out."""
    known = cut(known_labels(labels, label, id_col, "int").where(F.col("y").isin(0, 1)))
    n, share = known.agg(F.count("*"), F.avg("y")).first()
    own = table.join(known, F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    # in a fixed order, so that sums don't change from run to run
    parts = max(1, min(TASKS, -(-n // ROWS_PER_TASK)))
    return fit(cut(own.repartition(parts, "id").sortWithinPartitions("id").select("y", "x")), share or 0.0, threshold)


def score(table: DataFrame, model: RankModel) -> DataFrame:
    """doc_id, score and predicted (1 from the model's threshold on) of every row of a table of measures."""

    def run(batches):
        for batch in batches:
            p = model.scores(unpacked(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= model.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    table = measured(docs, id_col, text_col)
    return score(table, learn(table, labels, id_col=id_col, **options)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
