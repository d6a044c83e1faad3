"""Deterministic hard cases from a text: five transformations that keep its content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names of the five cases, and the filler sentences.
PREFIX, SUFFIX = "Context before the reused material. ", " Additional context."


def suite(sources: DataFrame, id_col: str, text_col: str = "text", min_words: int = 8) -> DataFrame:
    """example_id, group_id, category, source, candidate and one annotation (candidate_start, candidate_end, source_start, source_end: both whole texts): five rows of every source of min_words or more. Null sources have no rows."""
    t = F.col(text_col)
    swap = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")
    trimmed = F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    turned = F.array_join(F.reverse(F.filter(trimmed, lambda s: s != "")), " ")
    cases = {"case_change": swap, "punctuation_noise": F.regexp_replace(t, r"\s+", " , "), "whitespace_noise": F.regexp_replace(t, r"\s+", " \n\t "), "sentence_reorder": turned, "filler_insertion": F.concat(F.lit(PREFIX), t, F.lit(SUFFIX))}
    some = sources.where(F.size(F.regexp_extract_all(t, F.lit(r"\S+"), 0)) >= min_words)
    made = some.select(F.col(id_col).cast("string").alias("g"), t.alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("candidate")) for k, v in cases.items()])).alias("c"))
    zero, size = F.lit(0).cast("long"), lambda c: F.length(c).cast("long")
    return made.select(F.concat_ws(":", "g", "c.category").alias("example_id"), F.col("g").alias("group_id"), "c.category", "source", "c.candidate", zero.alias("candidate_start"), size("c.candidate").alias("candidate_end"), zero.alias("source_start"), size("source").alias("source_end"))
