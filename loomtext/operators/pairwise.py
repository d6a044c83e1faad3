"""Pairwise text similarity with passage evidence, over a table of pairs.

A pair is scored inside its own row: both texts become sparse counts once, and all segments of one
side meet all segments of the other as one sparse matrix product. Nothing is exploded and nothing
is shuffled, so a plan over pairs is one Arrow stage after whatever made the pairs.

Defined cases: a pair with a null side, or with fewer than three words on a side, is invalid: it has
no row (``strict`` makes it an error); a repeated pair_id is scored once for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomtext.functions import features
from loomtext.session import ship_package, spread

METHOD = "pairwise_tfidf_style_v2"
MATCH = "array<struct<source_text:string,candidate_text:string,source_start:long,source_end:long,candidate_start:long,candidate_end:long,similarity:double,match_type:string>>"
RESULT = f"pair_id string, score double, verdict string, lexical double, chars double, containment double, coverage double, evidence {MATCH}, method string, error string"


@dataclass(frozen=True)
class Config:
    """The decision policy. Thresholds, limits and weights as they must be for equal results."""

    review_threshold: float = 0.36
    high_overlap_threshold: float = 0.64
    evidence_threshold: float = 0.30
    max_evidence: int = 8
    min_document_tokens: int = 3
    min_segment_tokens: int = 4
    max_segment_tokens: int = 80

    def __post_init__(self) -> None:
        if not 0 <= self.review_threshold < self.high_overlap_threshold <= 1:
            raise ValueError("0 <= review < high <= 1 must hold")
        if not 0 <= self.evidence_threshold <= 1:
            raise ValueError("evidence_threshold must lie in 0 to 1")
        if self.max_evidence < 1:
            raise ValueError("max_evidence must be at least 1")


NEAR_VERBATIM = 0.72
SEGMENT_WEIGHTS = (0.55, 0.30, 0.15)
GLOBAL_WEIGHTS = (0.68, 0.32)
EVIDENCE_WEIGHTS = (0.72, 0.28)


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def best_segments(source: str, candidate: str, config: Config) -> list[dict]:
    """For each candidate segment its best source segment from the evidence threshold on, the earliest of equal ones."""
    s, c = (features.segments(t, config.min_segment_tokens, config.max_segment_tokens) for t in (source, candidate))
    if not s or not c:
        return []
    coder = features.Coder()
    (sw, sl), (cw, cl) = coder.word_bags([x.words for x in s]), coder.word_bags([x.words for x in c])
    sc, cc = coder.char_bags([[x.text for x in s], [x.text for x in c]])
    a, b, d = SEGMENT_WEIGHTS
    score = np.clip(a * features.cosines(sw, cw) + b * features.cosines(sc, cc) + d * features.containments(sl, cl), 0.0, 1.0)
    best = score.argmax(0)
    out = []
    for j, i in enumerate(best):
        found = float(score[i, j])
        if found >= config.evidence_threshold:
            kind = "exact" if s[i].words == c[j].words else "near_verbatim" if found >= NEAR_VERBATIM else "lexical"
            out.append({"source_text": s[i].text, "candidate_text": c[j].text, "source_start": s[i].start, "source_end": s[i].end, "candidate_start": c[j].start, "candidate_end": c[j].end, "similarity": round(found, 4), "match_type": kind})
    return out


def select_evidence(matches: list[dict], limit: int) -> list[dict]:
    """Matches by falling similarity, each only if no better one overlaps it on the candidate's side."""
    taken: list[dict] = []
    for m in sorted(matches, key=lambda m: (-m["similarity"], m["candidate_start"], m["source_start"])):
        if len(taken) < limit and all(m["candidate_end"] <= t["candidate_start"] or t["candidate_end"] <= m["candidate_start"] for t in taken):
            taken.append(m)
    return taken


def lexical_similarity(source: str, candidate: str) -> float:
    """Cosine of the counts of words and neighbours of two whole texts."""
    coder = features.Coder()
    a, b = (coder.word_bags([features.words(t)])[0] for t in (source, candidate))
    return float(features.cosines(a, b)[0, 0])


def whole_similarities(source: str, candidate: str) -> tuple[float, float, float]:
    """(lexical, character, containment) of two whole texts."""
    coder = features.Coder()
    (sw, sl), (cw, cl) = coder.word_bags([features.words(source)]), coder.word_bags([features.words(candidate)])
    sc, cc = coder.char_bags([[source], [candidate]])
    return float(features.cosines(sw, cw)[0, 0]), float(features.cosines(sc, cc)[0, 0]), float(features.containments(sl, cl)[0, 0])


def invalid(source: str | None, candidate: str | None, config: Config) -> str | None:
    """Why a pair can't be scored."""
    if source is None or candidate is None:
        return "source and candidate must be strings"
    if not source.strip() or not candidate.strip():
        return "source and candidate must not be empty"
    if min(len(features.words(source)), len(features.words(candidate))) < config.min_document_tokens:
        return f"each document must contain at least {config.min_document_tokens} words"
    return None


def score_pair(source: str | None, candidate: str | None, config: Config) -> dict:
    if error := invalid(source, candidate, config):
        return {"error": error}
    lexical, chars, contained = whole_similarities(source, candidate)
    proof = select_evidence(best_segments(source, candidate, config), config.max_evidence)
    own = {w for w in features.words(candidate) if len(w) > 2}
    hit = {w for m in proof for w in features.words(m["candidate_text"]) if len(w) > 2}
    coverage = len(hit) / len(own) if own else 0.0
    best = proof[0]["similarity"] if proof else 0.0
    score = clamp(max(GLOBAL_WEIGHTS[0] * lexical + GLOBAL_WEIGHTS[1] * chars, EVIDENCE_WEIGHTS[0] * best + EVIDENCE_WEIGHTS[1] * coverage))
    verdict = "high_overlap" if score >= config.high_overlap_threshold else "review_recommended" if score >= config.review_threshold else "low_overlap"
    four = lambda x: round(clamp(x), 4)
    return {"score": four(score), "verdict": verdict, "lexical": four(lexical), "chars": four(chars), "containment": four(contained), "coverage": four(coverage), "evidence": proof, "method": METHOD}


def _rowwise(pairs: DataFrame, one, schema: str) -> DataFrame:
    """one(pair_id, source, candidate) gives the row of each pair as a dict, or None for no row."""
    ship_package(pairs.sparkSession)
    base = pairs.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("source").cast("string").alias("source"), F.col("candidate").cast("string").alias("candidate"))
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = [r for p, s, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if (r := one(p, s, c)) is not None]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return spread(base).mapInArrow(run, schema)


def analyze_all(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """Every pair's result, with the reason in ``error`` where it is invalid."""
    return _rowwise(pairs, lambda p, s, c: {"pair_id": p, **score_pair(s, c, config)}, RESULT)


def analyze(pairs: DataFrame, config: Config = Config(), strict: bool = False) -> DataFrame:
    """pair_id, score, verdict, lexical, chars, containment, coverage, evidence, method of every valid pair."""
    found = analyze_all(pairs, config)
    if strict:
        return found.withColumn("pair_id", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("pair_id"), F.lit(": "), F.col("error"))).cast("string")).otherwise(F.col("pair_id"))).drop("error")
    return found.where("error is null").drop("error")


def similarities(pairs: DataFrame) -> DataFrame:
    """pair_id, lexical, chars, containment of whole texts, unrounded; null sides count as empty texts."""

    def one(p, s, c):
        return dict(zip(("pair_id", "lexical", "chars", "containment"), (p, *whole_similarities(s or "", c or "")), strict=True))

    return _rowwise(pairs, one, "pair_id string, lexical double, chars double, containment double")


def best_matches(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """One row for each candidate segment of a valid pair that reaches the evidence threshold, with its best source segment."""
    made = _rowwise(pairs, lambda p, s, c: None if invalid(s, c, config) else {"pair_id": p, "m": best_segments(s, c, config)}, f"pair_id string, m {MATCH}")
    return made.select("pair_id", F.explode("m").alias("m")).select("pair_id", "m.*")


def evidence(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """pair_id, n (from 0, in order) and the fields of each selected match."""
    return analyze(pairs, config).select("pair_id", F.posexplode("evidence").alias("n", "m")).select("pair_id", F.col("n").cast("long").alias("n"), "m.*")
