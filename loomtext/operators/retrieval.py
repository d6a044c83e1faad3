"""Lexical, dense, fused and reranked retrieval over an index of passages.

``build_index`` reads the passages once: each keeps its length, its distinct terms (64-bit hashes)
with their counts, and its vector. A search sends blocks of queries (a bounded broadcast) over the
index, where both channels score every passage, so ranks are those of full rankings, zero scores
included. What leaves a task is bounded: its best passages of each channel for each query.

Fused ranks are exact without a table of queries x passages. With k results wanted, a passage whose
ranks both exceed m can't reach them once (lw + dw) / (c + m + 1) < max(lw, dw) / (c + k); so the m
best of each channel are all that can win, and a second pass over the index counts, for these few,
the passages before each of them.

Defined cases: null texts are empty; a passage without terms has BM25 score 0, one with a zero
vector cosine 0; ties go to the smaller passage id; a query without terms ranks by id; a null
passage or query id takes no part; repeated passage ids are an error in ``build_index(strict=True)``
and passages each otherwise; fewer passages than k give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import rounded, terms
from loomtext.operators import embedding
from loomtext.session import cut, ship_package, spread

#: Queries of one block: they and their terms are broadcast together.
QUERY_BLOCK = 256
#: Passages scored at a time, pairs of a term and a query expanded at a time, and pairs of a query and a passage held before all but the best of each query go.
TILE, EXPANDED, HELD = 1024, 1 << 18, 1 << 18
#: Terms of so many queries of a block count by a product of matrices.
SHARED_BY = 8


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(terms(F.col(text_col)))), F.lit(0.0)).alias("avg_len"))


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@lru_cache(1 << 16)
def term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def build_index(passages: DataFrame, id_col: str = "passage_id", text_col: str = "text", embedder=None, strict: bool = False) -> DataFrame:
    """passage, len, terms, counts, vector (null without an embedder) of every passage, checkpointed: searches read it twice."""
    ship_package(passages.sparkSession)
    base = passages.select(F.col(id_col).cast("long").alias("passage"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("passage is not null")
    if strict and not base.groupBy("passage").count().where("count > 1").isEmpty():
        raise ValueError("passage ids must be unique")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, keys, counts = [], [], []
            for t in texts:
                found = embedding.terms(t)
                sizes.append(len(found))
                own, n = np.unique(np.array([term_hash(x) for x in found], np.int64), return_counts=True)
                keys.append(own)
                counts.append(n.astype(np.int32))
            offs = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
            lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(flat(x, k))) for x, k in ((keys, np.int64), (counts, np.int32))]
            if embedder is None:
                vector = pa.nulls(len(texts), pa.list_(pa.float32()))
            else:
                made = np.concatenate([_vectors(embedder, texts[a : a + TILE]) for a in range(0, len(texts), TILE)])
                vector = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * embedder.dims), pa.array(made.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists, vector], names=["passage", "len", "terms", "counts", "vector"])

    return cut(spread(base).mapInArrow(run, "passage long, len int, terms array<long>, counts array<int>, vector array<float>"))


def _vectors(embedder, texts: list[str]) -> np.ndarray:
    made = np.asarray(embedder.vectors(texts), float)
    if made.shape != (len(texts), embedder.dims):
        raise ValueError(f"{embedder.name} gave vectors of shape {made.shape} for {len(texts)} texts of {embedder.dims} dimensions")
    return made


@dataclass
class QueryBlock:
    """Queries as columns: terms in order of their hash, and for each the queries that hold it."""

    ids: list
    keys: np.ndarray
    starts: np.ndarray
    holders: np.ndarray
    vectors: np.ndarray | None
    idf: np.ndarray | None = None
    mean: float = 1.0
    k1: float = 1.5
    b: float = 0.75

    @staticmethod
    def of(ids: list, texts: list[str], embedder) -> QueryBlock:
        pairs = sorted({(term_hash(t), q) for q, text in enumerate(texts) for t in embedding.terms(text)})
        keys, starts = np.unique(np.array([k for k, _ in pairs], np.int64), return_index=True)
        return QueryBlock(ids, keys, np.append(starts, len(pairs)), np.array([q for _, q in pairs], np.int64), None if embedder is None else _vectors(embedder, texts))

    def matched(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the list's values, term number) of the entries that are terms of a query."""
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        if not len(self.keys):
            return row[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        some = np.flatnonzero(self.keys[at] == flat)
        return row[some], some, at[some]

    def lexical(self, batch: pa.RecordBatch) -> np.ndarray:
        """BM25 in whole millionths, passages x queries."""
        row, place, term = self.matched(batch.column("terms"))
        tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False)[place].astype(float)
        size = batch.column("len").to_numpy(zero_copy_only=False)[row]
        part = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size / self.mean))
        many = np.diff(self.starts)
        shared = np.flatnonzero(many >= SHARED_BY)
        number = np.full(len(many), -1)
        number[shared] = np.arange(len(shared))
        holds = np.zeros((len(shared), len(self.ids)))
        for t in shared.tolist():
            holds[number[t], self.holders[self.starts[t] : self.starts[t + 1]]] = 1
        weights = np.zeros((batch.num_rows, len(shared)))
        common = number[term] >= 0
        weights[row[common], number[term[common]]] = part[common]
        sums = (weights @ holds).ravel()
        row, term, part = row[~common], term[~common], part[~common]
        ends = np.cumsum(many[term])
        at = 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
            n = many[term[at:to]]
            each = np.repeat(np.arange(at, to), n)
            q = self.holders[np.repeat(self.starts[term[at:to]] - (np.cumsum(n) - n), n) + np.arange(len(each))]
            sums += np.bincount(row[each] * len(self.ids) + q, weights=part[each], minlength=len(sums))
            at = to
        return np.rint(sums * 1e6).astype(np.int64).reshape(batch.num_rows, len(self.ids))

    def dense(self, batch: pa.RecordBatch) -> np.ndarray:
        """Cosines in whole millionths, passages x queries; 0 where a vector is zero."""
        v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        norms = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((self.vectors**2).sum(1))[None]
        dot = v @ self.vectors.T
        return np.rint(np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0) * 1e6).astype(np.int64)

    def channels(self, batch: pa.RecordBatch):
        """(ids, scores by channel) of each tile of a batch."""
        for at in range(0, batch.num_rows, TILE):
            tile = pa.RecordBatch.from_arrays([c if not isinstance(c, pa.ListArray) else pa.concat_arrays([c]) for c in batch.slice(at, TILE).columns], names=batch.schema.names)
            yield tile.column("passage").to_numpy(zero_copy_only=False), [self.lexical(tile), *([] if self.vectors is None else [self.dense(tile)])]


def _blocks(queries: DataFrame, id_col: str, text_col: str, embedder):
    """Blocks of queries, streamed to the driver one block at a time."""
    ids, texts = [], []
    for r in queries.select(F.col(id_col).cast("long").alias("q"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where("q is not null").orderBy("q").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield QueryBlock.of(ids, texts, embedder)
            ids, texts = [], []
    if ids:
        yield QueryBlock.of(ids, texts, embedder)


def _weighed(index: DataFrame, block: QueryBlock, k1: float, b: float, stats) -> QueryBlock:
    """Adds the corpus's weights of the block's terms: document frequencies are counted in the tasks and summed."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = shared.value
        df = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            df += np.bincount(own.matched(batch.column(0))[2], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["term", "df"])

    df = np.zeros(len(block.keys))
    for r in index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # bounded by the block's terms
        df[r[0]] = r[1]
    n, mean = stats
    block.idf = np.array([math.log(1 + (n - x + 0.5) / (x + 0.5)) for x in df])
    block.mean, block.k1, block.b = max(float(mean or 0.0), 1.0), k1, b
    return block


def _heads(index: DataFrame, block: QueryBlock, m: int) -> DataFrame:
    """query, passage, lexical, dense: the m best of each channel and query, with both scores and the rank in the channels where it is at most m."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = shared.value
        n = len(own.ids)
        floor, last = np.full((2, n), np.iinfo(np.int64).min), np.full((2, n), np.iinfo(np.int64).max)  # what a new pair must reach in a channel
        held: list[list] = []  # arrays (place of the query, passage, scores...)
        count = 0

        def trim():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            keep = np.zeros(len(cols[0]), bool)
            for c, score in enumerate(cols[2:]):
                order = np.lexsort((cols[1], -score, cols[0]))
                q = cols[0][order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                keep[order[rank < m]] = True
                at = order[rank == m - 1]
                floor[c, cols[0][at]], last[c, cols[0][at]] = score[at], cols[1][at]
            held[:] = [[c[keep] for c in cols]]
            return int(keep.sum())

        for batch in batches:
            for ids, scores in own.channels(batch):
                some = np.zeros((len(ids), n), bool)
                for c, s in enumerate(scores):
                    some |= (s > floor[c]) | (s == floor[c]) & (ids[:, None] <= last[c])
                row, q = np.nonzero(some)
                held.append([q, ids[row], *(s[row, q] for s in scores)])
                count += len(q)
                if count > max(HELD, 4 * m * n):
                    count = trim()
        if held:
            trim()
            q, passage, *scores = held[0]
            names = np.array(own.ids, np.int64)
            for at in range(0, len(q), 1 << 16):
                part = slice(at, at + (1 << 16))
                dense = pa.array(scores[1][part]) if len(scores) > 1 else pa.nulls(len(q[part]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names[q[part]]), pa.array(passage[part]), pa.array(scores[0][part]), dense], names=["query", "passage", "lexical", "dense"])

    found = index.mapInArrow(run, "query long, passage long, lexical long, dense long")
    by = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "passage"))
    ranked = found.withColumn("lexical_rank", by("lexical"))
    if block.vectors is None:
        return ranked.where(F.col("lexical_rank") <= m)
    return ranked.withColumn("dense_rank", by("dense")).where((F.col("lexical_rank") <= m) | (F.col("dense_rank") <= m))


def bm25(queries: DataFrame, passages: DataFrame, query_id: str, id_col: str, k: int, k1: float = 1.5, b: float = 0.75, index: DataFrame | None = None) -> DataFrame:
    """query, passage, score, rank: the k first of the full ranking of all passages, those of score 0 too. Query terms are a set."""
    index = build_index(passages, id_col) if index is None else index
    stats = index.agg(F.count("*"), F.avg("len")).first()
    out = None
    for block in _blocks(queries, query_id, "text", None):
        part = _heads(index, _weighed(index, block, k1, b, stats), k)
        part = part.select("query", "passage", (F.col("lexical") / 1e6).alias("score"), F.col("lexical_rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else index.sparkSession.createDataFrame([], "query long, passage long, score double, rank long")


class Reranker(Protocol):
    name: str

    def score(self, query: str, passages: list[str]) -> list[float]:
        """One number for each passage."""


def _exact_ranks(index: DataFrame, block: QueryBlock, heads: DataFrame) -> DataFrame:
    """heads with the rank of each row in the full ranking of both channels: the passages before it are counted in the tasks and summed."""
    spark = index.sparkSession
    rows = [[] for _ in block.ids]
    number = {q: i for i, q in enumerate(block.ids)}
    for r in heads.select("query", "passage", "lexical", "dense").collect():  # at most 2 m rows of each query of a block
        rows[number[r[0]]].append(r[1:])
    order = []  # for each query and channel: passages and negated scores in the order of the ranking
    for found in rows:
        cols = np.array(found, np.int64).reshape(-1, 3)
        order.append([(lambda o, c=c: (cols[o, 0], -cols[o, c]))(np.lexsort((cols[:, 0], -cols[:, c]))) for c in (1, 2)])
    shared = spark.sparkContext.broadcast((block, order))

    def run(batches):
        own, sought = shared.value
        before = [[np.zeros(len(ids) + 1, np.int64) for ids, _ in channels] for channels in sought]
        for batch in batches:
            for ids, scores in own.channels(batch):
                falling = [-x.T for x in scores]
                for q, channels in enumerate(sought):
                    for c, (cand, value) in enumerate(channels):
                        if not len(cand):
                            continue
                        s = np.ascontiguousarray(falling[c][q])
                        lo = np.searchsorted(value, s, "left")
                        tied = np.flatnonzero(value[np.minimum(lo, len(cand) - 1)] == s)
                        places = lo[tied]
                        for at in np.unique(places).tolist():  # equal scores stand in the order of their passages
                            here = tied[places == at]
                            lo[here] += np.searchsorted(cand[at : np.searchsorted(value, value[at], "right")], ids[here], "right")
                        before[q][c] += np.bincount(lo, minlength=len(cand) + 1)  # it stands before all candidates from lo on
        for q, channels in enumerate(sought):
            for c, (cand, _) in enumerate(channels):
                ahead = np.cumsum(before[q][c])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cand), own.ids[q])), pa.array(cand), pa.array(np.full(len(cand), c, np.int32)), pa.array(ahead)], names=["query", "passage", "channel", "ahead"])

    counted = index.mapInArrow(run, "query long, passage long, channel int, ahead long").groupBy("query", "passage").agg(*[F.sum(F.when(F.col("channel") == c, F.col("ahead"))).alias(n) for c, n in enumerate(("l", "d"))])
    return heads.select("query", "passage", "lexical", "dense").join(F.broadcast(counted), ["query", "passage"]).select("query", "passage", "lexical", "dense", (F.col("l") + 1).alias("lexical_rank"), (F.col("d") + 1).alias("dense_rank"))


@dataclass
class HybridRetriever:
    """BM25 and an embedder fused by reciprocal ranks, optionally reranked. Without an embedder the lexical ranks alone count."""

    embedder: object = None
    reranker: object = None
    lexical_weight: float = 1.0
    dense_weight: float = 1.0
    rrf_constant: int = 60
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        if min(self.lexical_weight, self.dense_weight) < 0 or self.lexical_weight + self.dense_weight == 0:
            raise ValueError("weights must not be negative, and one must be positive")
        if self.rrf_constant < 1:
            raise ValueError("rrf_constant must be positive")

    @property
    def method(self) -> str:
        return "+".join(["bm25", *(x.name for x in (self.embedder, self.reranker) if x is not None)])

    def index(self, passages: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
        return build_index(passages, id_col, text_col, self.embedder, strict=True)

    def search(self, index: DataFrame, queries: DataFrame, query_id: str = "query_id", top_k: int = 10, candidate_k: int = 50, passages: DataFrame | None = None, id_col: str = "passage_id") -> DataFrame:
        """query, passage, score, rank, lexical_rank, dense_rank, reranker_score, method; passages (with text) are needed to rerank."""
        if not 0 < top_k <= candidate_k:
            raise ValueError("0 < top_k <= candidate_k must hold")
        lw, dw, c = self.lexical_weight, self.dense_weight if self.embedder is not None else 0.0, self.rrf_constant
        m = max(candidate_k, math.ceil((lw + dw) / max(lw, dw, 1e-12) * (c + candidate_k)) - c + 1)
        stats = index.agg(F.count("*"), F.avg("len")).first()
        share = lambda w, col: F.lit(float(w)) / (F.col(col) + c)
        w = Window.partitionBy("query").orderBy(F.desc("score"), "passage")
        out = None
        for block in _blocks(queries, query_id, "text", self.embedder):
            heads = cut(_heads(index, _weighed(index, block, self.k1, self.b, stats), m))
            if block.vectors is None:
                fused = heads.select("query", "passage", "lexical_rank", F.lit(None).cast("long").alias("dense_rank"), rounded(share(lw, "lexical_rank"), 9).alias("score"))
            else:
                fused = _exact_ranks(index, block, heads).select("query", "passage", "lexical_rank", "dense_rank", rounded(share(lw, "lexical_rank") + share(dw, "dense_rank"), 9).alias("score"))
            part = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidate_k)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = index.sparkSession.createDataFrame([], "query long, passage long, lexical_rank long, dense_rank long, score double, rank int")
        if self.reranker is None:
            out = out.where(F.col("rank") <= top_k).withColumn("reranker_score", F.lit(None).cast("double"))
        else:
            out = rerank(out, reranked(out, queries, passages, self.reranker, query_id, id_col), top_k)
        return out.select("query", "passage", "score", F.col("rank").cast("long").alias("rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("dense_rank").cast("long").alias("dense_rank"), "reranker_score", F.lit(self.method).alias("method"))


def reranked(heads: DataFrame, queries: DataFrame, passages: DataFrame, reranker, query_id: str, id_col: str) -> DataFrame:
    """query, passage, again: the reranker's number for every candidate; a query's candidates are one bounded group."""
    texts = passages.select(F.col(id_col).cast("long").alias("passage"), F.coalesce("text", F.lit("")).alias("p_text"))
    asked = queries.select(F.col(query_id).cast("long").alias("query"), F.coalesce("text", F.lit("")).alias("q_text"))
    rows = heads.select("query", "passage").join(texts, "passage").join(asked, "query")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("passage")
        scores = list(reranker.score(group["q_text"].iloc[0], group["p_text"].tolist()))
        if len(scores) != len(group):
            raise ValueError(f"{reranker.name} gave {len(scores)} scores for {len(group)} passages")
        return pd.DataFrame({"query": group["query"], "passage": group["passage"], "again": np.asarray(scores, float)})

    return rows.groupBy("query").applyInPandas(run, "query long, passage long, again double")


def min_max(col: str, group: str):
    w = Window.partitionBy(group)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(col) - low) / (high - low))


def rerank(fused: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Orders the head by 0.35 of the scaled fused score and 0.65 of the scaled reranker score; the score shown is the reranker's own."""
    both = fused.withColumnRenamed("score", "fused").drop("rank").join(scores.select("query", "passage", "again"), ["query", "passage"])
    blend = both.withColumn("x", min_max("fused", "query")).withColumn("y", min_max("again", "query")).withColumn("blend", rounded(0.35 * F.col("x") + 0.65 * F.col("y")))
    w = Window.partitionBy("query").orderBy(F.desc("blend"), "passage")
    return blend.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*[c for c in fused.columns if c not in ("score", "rank")], F.col("again").alias("score"), F.col("again").alias("reranker_score"), "rank")


def fuse(lexical: DataFrame, dense: DataFrame, k: int, lexical_weight: float = 1.0, dense_weight: float = 1.0, constant: int = 60) -> DataFrame:
    """query, passage, score, rank by reciprocal rank fusion of two given rankings (query, passage, rank)."""
    a = lexical.select("query", "passage", F.col("rank").alias("lexical_rank"))
    b = dense.select("query", "passage", F.col("rank").alias("dense_rank"))
    share = lambda weight, c: F.coalesce(F.lit(weight) / (F.col(c) + constant), F.lit(0.0))
    both = a.join(b, ["query", "passage"], "full_outer").withColumn("score", rounded(share(lexical_weight, "lexical_rank") + share(dense_weight, "dense_rank"), 9))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "passage")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query, passage, score, rank by cosine of queries (query, q) and vectors (passage, v).

    Queries go over the vectors in blocks (a bounded broadcast); every task keeps k of each query.
    Vectors of a query must have its dimensions; a null or zero vector has cosine 0; a query is no
    result of its own.
    """
    ship_package(vectors.sparkSession)
    rows = queries.select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q")).where("query is not null").orderBy("query")
    base = vectors.select(F.col("passage").cast("long").alias("passage"), F.col("v").cast("array<double>").alias("v")).where("passage is not null")
    schema = "query long, passage long, score long"

    def searched(ids: list, qs: list) -> DataFrame:
        wide = max((len(q) for q in qs if q is not None), default=0)
        if any(q is not None and len(q) != wide for q in qs):
            raise ValueError("query vectors must have equal dimensions")
        q = np.array([x if x is not None else [0.0] * wide for x in qs], float).reshape(len(qs), wide)
        shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), q, np.sqrt((q * q).sum(1))))

        def run(batches):
            own, q, q_norm = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
            for batch in batches:
                lists = batch.column(1)
                size = np.diff(lists.offsets.to_numpy())
                if not np.isin(size[lists.is_valid().to_numpy(zero_copy_only=False)], (q.shape[1],)).all():
                    raise ValueError("vectors must have the dimensions of the queries")
                v = np.zeros((batch.num_rows, q.shape[1]))
                v[size > 0] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                norms = np.sqrt((v * v).sum(1))[:, None] * q_norm[None]
                dot = v @ q.T
                score = np.rint(np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0) * 1e6).astype(np.int64)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for i, mine in enumerate(own):
                    other = ids != mine
                    p, s = np.concatenate((best[i][0], ids[other])), np.concatenate((best[i][1], score[other, i]))
                    keep = np.lexsort((p, -s))[:k]
                    best[i] = p[keep], s[keep]
            for mine, (p, s) in zip(own, best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), mine)), pa.array(p), pa.array(s)], names=["query", "passage", "score"])

        return base.mapInArrow(run, schema)

    out, ids, qs = None, [], []
    for r in rows.toLocalIterator():
        ids.append(r[0])
        qs.append(r[1])
        if len(ids) == QUERY_BLOCK:
            out = searched(ids, qs) if out is None else out.unionByName(searched(ids, qs))
            ids, qs = [], []
    if ids:
        out = searched(ids, qs) if out is None else out.unionByName(searched(ids, qs))
    found = out if out is not None else vectors.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "passage")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query", "passage", (F.col("score") / 1e6).alias("score"), "rank")
