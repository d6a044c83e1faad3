"""Benchmarks of pair scorers: splits by group, thresholds from calibration, reports.

A scorer has a name and scores(pairs): the pairs with a column score. Reports are rows; write them with
``files.write_report``.
"""

from __future__ import annotations

import random
import time
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import rounded
from loomtext.operators import evaluation, pairwise, validation
from loomtext.operators.embedding import HashingEmbedder
from loomtext.session import cut, ship_package, spread

#: Groups that a shuffled split may have: their names go through the driver.
MOST_GROUPS = 1_000_000


class PairScorer(Protocol):
    name: str

    def scores(self, pairs: DataFrame) -> DataFrame:
        """pairs with score."""


def _scored(pairs: DataFrame, score) -> DataFrame:
    """pairs with score and latency_ms; score(source, candidate) runs inside the rows."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("score double, latency_ms double")
    def run(source: pd.Series, candidate: pd.Series) -> pd.DataFrame:
        out = []
        for s, c in zip(source, candidate, strict=True):
            start = time.perf_counter()
            x = float(score(s or "", c or ""))
            if not np.isfinite(x):
                raise ValueError("a scorer gave a number that is not finite")
            out.append((x, (time.perf_counter() - start) * 1000))
        return pd.DataFrame(out, columns=["score", "latency_ms"])

    return spread(pairs).withColumn("r", run("source", "candidate")).select(*[c for c in pairs.columns], "r.score", "r.latency_ms")


class AnalyzerScorer:
    """The similarity score of the pairwise analysis; invalid pairs score 0."""

    def __init__(self, config: pairwise.Config = pairwise.Config()) -> None:
        self.name, self.config = pairwise.METHOD, config

    def scores(self, pairs: DataFrame) -> DataFrame:
        return _scored(pairs, lambda s, c: pairwise.score_pair(s, c, self.config).get("score", 0.0))


class LexicalScorer:
    """Cosine of word and neighbour counts, rounded to six places."""

    name = "lexical"

    def scores(self, pairs: DataFrame) -> DataFrame:
        return _scored(pairs, lambda s, c: round(pairwise.lexical_similarity(s, c) * 1e6) / 1e6)


class EmbeddingScorer:
    """Cosine of the vectors of an embedder, with negative ones as 0."""

    def __init__(self, embedder=None) -> None:
        self.embedder = embedder or HashingEmbedder()
        self.name = f"cosine:{self.embedder.name}"

    def scores(self, pairs: DataFrame) -> DataFrame:
        def score(s, c):
            a, b = np.asarray(self.embedder.vectors([s, c]), float)
            norm = float(np.sqrt(a @ a) * np.sqrt(b @ b))
            return max(0.0, float(a @ b) / norm) if norm else 0.0

        return _scored(pairs, score)


def shuffled_split(rows: DataFrame, group: str, test_fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """rows with partition (train or test): the sorted group names shuffled by a Mersenne Twister, the first share to test.

    The generator is sequential, so the names pass through the driver; more than MOST_GROUPS are an
    error (``evaluation.group_split`` has no such bound).
    """
    names = [r[0] for r in rows.select(group).where(F.col(group).isNotNull()).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    names.sort()
    random.Random(seed).shuffle(names)
    chosen = rows.sparkSession.createDataFrame([(n,) for n in names[: max(1, round(len(names) * test_fraction))]], f"g {rows.schema[group].dataType.simpleString()}")
    joined = rows.join(chosen.withColumn("chosen", F.lit(True)), rows[group] == chosen["g"], "left")
    return joined.select(*[rows[c] for c in rows.columns], F.when(F.col("chosen"), "test").otherwise("train").alias("partition"))


def stored_split(rows: DataFrame, index: str, stored: DataFrame) -> DataFrame:
    """rows with the partition of a stored list (partition, index); rows that no list names are left out."""
    return rows.join(stored.select("partition", F.col("index").alias("stored_index")), F.col(index) == F.col("stored_index")).drop("stored_index")


def totals(pairs: DataFrame) -> DataFrame:
    """pairs, positive_pairs, negative_pairs, unique_source_groups."""
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positive_pairs"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).cast("long").alias("negative_pairs"), F.count_distinct("group_id").alias("unique_source_groups"))


def latency_summary(scored: DataFrame) -> DataFrame:
    """mean, p50 and p95 (nearest rank) of latency_ms."""
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by latency_ms)")
    return scored.agg(rounded(F.avg("latency_ms"), 3).alias("mean"), rounded(q(0.5), 3).alias("p50"), rounded(q(0.95), 3).alias("p95"))


def run_benchmark(pairs: DataFrame, scorers: list, seed: int = 42, calibration_fraction: float = 0.75) -> DataFrame:
    """One row for each scorer and category (null: all) of the test part: model, threshold, category, calibration and test metrics, average_precision, score summary.

    Pairs are checked, split by group, scored once; each scorer's threshold is the best one of its
    calibration part.
    """
    if not scorers:
        raise ValueError("a scorer is needed")
    if not 0.1 <= calibration_fraction <= 0.9:
        raise ValueError("calibration_fraction must lie in 0.1 to 0.9")
    if pairs.isEmpty():
        raise ValueError("pairs are needed")
    validation.require_none(validation.pairs(pairs))
    validation.require_none(validation.unique(pairs, "pair_id"))
    split = cut(evaluation.group_split(pairs, "group_id", calibration_fraction, seed))
    leaked = evaluation.leakage(split, "group_id").first()[0]
    if leaked:
        raise ValueError("groups in both parts")
    out = None
    for scorer in scorers:
        scored = cut(scorer.scores(split))
        validation.require_none(validation.finite(scored))
        part = {k: scored.where(F.col("partition") == k) for k in ("calibration", "test")}
        t = evaluation.choose_threshold(part["calibration"]).first()[0]
        known = evaluation.confusion_at(part["calibration"], t).select(*[F.col(c).alias(f"calibration_{c}") for c in ("precision", "recall", "f1", "accuracy")])
        names = ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy")
        whole = evaluation.confusion_at(part["test"], t).select(F.lit(None).cast("string").alias("category"), *names)
        each = evaluation.confusion_at(part["test"], t, ["category"]).select("category", *names)
        ap = evaluation.average_precision(part["test"]).select(rounded(F.col("average_precision"), 4).alias("average_precision"))
        one = known.join(ap).join(evaluation.score_summary(part["test"]).select("min_score", "max_score", "mean_score"))  # one row each
        rows = whole.unionByName(each).join(F.broadcast(one)).select(F.lit(scorer.name).alias("model"), rounded(F.lit(t)).alias("threshold"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def baseline_report(rows: DataFrame, seed: int = 42) -> DataFrame:
    """partition, rows, threshold and metrics of the analysis score on a shuffled split (source, candidate, label, group): the threshold is the best hundredth of train."""
    split = shuffled_split(rows, "group", seed=seed)
    scored = cut(AnalyzerScorer().scores(split))
    t = evaluation.choose_threshold_grid(scored.where("partition = 'train'")).first()[0]
    return evaluation.confusion_at(scored, t, ["partition"]).withColumn("threshold", F.lit(t))
