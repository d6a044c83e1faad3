"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One logistic classifier for each bit, over hashed byte
n-grams of one to three bytes, predicts that bit; decoding adds up, for each language, the logistic
loss of every bit against its codeword, weighted by how well the bit's classifier did on held-back
rows, and takes the least. A decision whose two best languages are closer than ``margin`` in loss is
marked ambiguous.

Fitting uses at most ``per_class`` rows of each language (by hash of the id, within ``labelled``'s
bounds on rows and bytes, whole texts). Defined cases: null text or a text without a letter: und,
score 0, not ambiguous; no labelled rows at all: und everywhere; one language: that one, score 1;
ties go to the language that is first in order; repeated rows: an id counts once in fitting, and each
of its rows is predicted; very long texts: read whole, in their own slice; empty tables: no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.labelled import held_out, known_labels, sample_texts
from loomtext.llm.vectext import U, lowered, mix, slices
from loomtext.session import cut, ship_package

BITS = 13
DIM = 1 << BITS
#: Digits, blanks, controls and ASCII signs count as one blank: they say little of a language.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: all splits of up to five classes, else random columns of both signs."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1.0] + [1.0 if c >> (i - 1) & 1 else -1.0 for i in range(1, k)] for c in range((1 << (k - 1)) - 1)]).T
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(50):
        code = np.where(rng.random((k, int(10 * np.log2(k)) + 1)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(0)) < k]
        least = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


def gram_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all n-grams, row by row, offsets by row); n-grams don't reach over a row's end."""
    data = FOLD[lowered(data, latin=True)]
    n = len(data)
    d = data.astype(np.uint32)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # bytes of the row from here on
    slots = np.full((n, 3), -1, np.int32)
    slots[:, 0] = (d * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    two = d[:-1] | d[1:] << np.uint32(8)
    slots[:-1, 1] = ((two + np.uint32(1 << 24)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    three = two[:-1] | d[2:] << np.uint32(16)
    slots[:-2, 2] = ((three + np.uint32(3 << 24)) * np.uint32(3266489917)) >> np.uint32(32 - BITS)
    keep = left[:, None] > np.arange(3)[None]
    sizes = np.minimum(left, 3)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return slots[keep], ends[offs]


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    for first, to, data, offs in slices(pa.array(texts, pa.string())):
        slot, at = gram_slots(data, offs)
        for r in range(to - first):
            out[first + r] = unit(slot[at[r] : at[r + 1]])
    return out


def unit(slots: np.ndarray) -> np.ndarray:
    x = np.sqrt(np.bincount(slots, minlength=DIM).astype(np.float32))
    norm = np.sqrt(float(x @ x))
    return x / norm if norm else x


@dataclass
class CodeModel:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, gap to the next) for rows of bit margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        rows = np.arange(len(loss))
        gap = loss[rows, order[:, 1]] - loss[rows, best] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / p.sum(1), gap


def fit(rows: list[tuple[str, str]], steps: int = 120) -> CodeModel:
    langs = sorted({y for _, y in rows})
    code = codewords(len(langs))
    bits = code.shape[1]
    if len(langs) < 2:
        return CodeModel(langs, code, np.zeros((DIM, bits), np.float32), np.zeros(bits), np.ones(bits))
    x = features([t for t, _ in rows])
    y = code[[langs.index(v) for _, v in rows]].astype(np.float32)
    back = np.arange(len(rows)) % 5 == 4  # for the trust in each bit
    weights, bias = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    xt, yt = x[~back], y[~back]
    for step in range(1, steps + 1):
        g = -yt / (1 + np.exp(yt * (xt @ weights + bias))) / len(xt)
        gw = xt.T @ g + 1e-6 * weights
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        weights -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 0.5 * g.sum(0)
    hit = ((x[back] @ weights + bias) * y[back] > 0).mean(0) if back.any() else np.full(bits, 0.9)
    hit = np.clip(hit, 0.5, 0.999)
    trust = np.log(hit / (1 - hit)) + 1e-3
    return CodeModel(langs, code, weights, bias, trust / trust.mean())


def learn(docs: DataFrame, per_class: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CodeModel:
    """Fits on at most per_class rows of each language that are not held out."""
    return fit(sample_texts(docs, cut(known_labels(docs, lang_col, id_col, "string")), per_class, id_col=id_col, text_col=text_col))


def predict(docs: DataFrame, model: CodeModel, margin: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            margins = np.zeros((batch.num_rows, own.code.shape[1] if own.langs else 1))
            letters = np.zeros(batch.num_rows, bool)
            for first, to, data, offs in slices(batch.column(1)):
                plain = np.concatenate(([0], np.cumsum(FOLD[data] != 32)))
                slot, at = gram_slots(data, offs)
                for r in range(to - first):
                    some = plain[offs[r + 1]] - plain[offs[r]]
                    if some and (data[offs[r] : offs[r + 1]] < 128).all() or some and any(c.isalpha() for c in batch.column(1)[first + r].as_py()):
                        letters[first + r] = True
                        if own.langs:
                            margins[first + r] = unit(slot[at[r] : at[r + 1]]) @ own.weights + own.bias
            if own.langs:
                best, score, gap = own.decode(margins)
                lang = [own.langs[b] if has else "und" for b, has in zip(best, letters, strict=True)]
            else:
                lang, score, gap = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.full(batch.num_rows, np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(letters & (gap < margin))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from the rows of docs that are not held out."""
    return predict(docs, learn(docs, **options)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
