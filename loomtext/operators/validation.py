"""Checks of rows before they are used: each gives the faulty rows with a reason, so a table is valid if its check is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def faulty(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """rows with error: the first rule (condition, reason) that a row breaks; a condition that is null counts as broken."""
    error = None
    for fine, reason in rules:
        bad = ~F.coalesce(fine, F.lit(False))
        error = F.when(bad, F.lit(reason)) if error is None else error.when(bad, F.lit(reason))
    return rows.withColumn("error", error).where("error is not null")


def require_none(found: DataFrame) -> None:
    """Fails with the first fault of a check."""
    first = found.first()
    if first is not None:
        raise ValueError(f"{first['error']}: {first.asDict()}")


def annotations(rows: DataFrame) -> DataFrame:
    """Candidate intervals must be proper; source intervals are both given or both not, and proper."""
    s, e = F.col("source_start"), F.col("source_end")
    return faulty(rows, (F.col("candidate_start") >= 0, "candidate_start must not be negative"), (F.col("candidate_end") > F.col("candidate_start"), "candidate interval must not be empty"), (s.isNull() == e.isNull(), "source interval must be whole"), (s.isNull() | ((s >= 0) & (e > s)), "source interval must be proper"))


def pairs(rows: DataFrame) -> DataFrame:
    """Labelled pairs: ids and texts that are not empty, label 0 or 1."""
    some = lambda c: F.length(F.trim(F.col(c))) > 0
    return faulty(rows, *[(some(c), f"{c} must not be empty") for c in ("pair_id", "group_id", "source", "candidate")], (F.col("label").isin(0, 1), "label must be 0 or 1"))


def finite(rows: DataFrame, col: str = "score") -> DataFrame:
    x = F.col(col)
    return faulty(rows, (~F.isnan(x) & (F.abs(x) < float("inf")), f"{col} must be finite"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    """key, n, error of keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("error", F.lit(f"{key} must be unique"))


#: Fixed value: what a request id may look like.
REQUEST_ID = r"(?U)^[\p{Alnum}._-]{1,64}$"


def valid_request_id(col: Column) -> Column:
    return F.coalesce(col.rlike(REQUEST_ID), F.lit(False))


# The bounds of requests, as (shortest, longest) of texts and (least, most) of numbers.
ANALYSIS = {"source": (10, 100_000), "candidate": (10, 100_000)}
CORPUS_DOCUMENT = {"document_id": (1, 200), "text": (10, 500_000)}
SEARCH = {"query": (3, 100_000)}
SEARCH_NUMBERS = {"top_k": (1, 100), "candidate_k": (1, 500)}
INDEX_NUMBERS = {"max_tokens": (8, 1_000), "overlap_tokens": (0, 500)}
DECISIONS = ("accepted_match", "dismissed", "properly_cited", "common_phrase")


def requests(rows: DataFrame, texts: dict[str, tuple[int, int]] = {}, numbers: dict[str, tuple[int, int]] = {}, choices: dict[str, tuple] = {}, known: set[str] | None = None) -> DataFrame:
    """Texts, without outer blanks, and numbers must lie in their bounds, choices in their sets; columns that aren't known are an error for all rows."""
    if known is not None and (other := set(rows.columns) - known):
        raise ValueError(f"unknown fields: {', '.join(sorted(other))}")
    size = lambda c: F.length(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    rules = [(size(c).between(*b), f"{c} must have {b[0]} to {b[1]} characters") for c, b in texts.items()]
    rules += [(F.col(c).between(*b), f"{c} must be {b[0]} to {b[1]}") for c, b in numbers.items()]
    rules += [(F.col(c).isin(*v), f"{c} must be one of {', '.join(v)}") for c, v in choices.items()]
    return faulty(rows, *rules)


class KeyTable:
    """API keys as digests: (digest, workspace) rows; the keys themselves are never stored."""

    def __init__(self, keys: DataFrame, key: str = "api_key", workspace: str = "workspace_id") -> None:
        short = F.raise_error(F.lit("API keys must have at least 20 characters"))
        own = F.when(F.length(key) >= 20, F.sha2(key, 256)).otherwise(short.cast("string"))
        self.digests = keys.select(own.alias("digest"), F.col(workspace).alias("workspace_id"))

    def authenticate(self, requests: DataFrame, key: str = "api_key") -> DataFrame:
        """requests with workspace_id in the key's place, null where the key is null or unknown: an equi-join of digests."""
        rest = [c for c in requests.columns if c != key]
        asked = requests.select(*rest, F.sha2(key, 256).alias("digest"))
        return asked.join(self.digests, "digest", "left").select(*rest, "workspace_id")
