"""Segments, windows of tokens and chunks with code-point offsets.

Spark gives matched text but no positions, so the patterns tile the text and a running sum of
lengths is the offset, in one shuffle by document; chunks, which carry their text, are cut inside
the rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtext.functions.text import words
from loomtext.operators.embedding import TERM
from loomtext.session import ship_package, spread

# Sentences and lines (a newline is a tile of its own), and tokens with what lies between them.
SEGMENT = r"(?md)[^\n.!?]+(?:[.!?]+|$)|[^\n]+|\n"
TOKEN_TILE = r"(?U)[^\W_]+|[\W_]+"


def tiles(docs: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """keys, pos, tile, start of each piece of the text."""
    rows = docs.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("pos", "tile"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("tile")).over(before), F.lit(0)).cast("long"))


def segments(docs: DataFrame, keys: list[str], text_col: str = "text", min_tokens: int = 4) -> DataFrame:
    """keys, start, end, n_tokens, segment of the sentences and lines that have min_tokens; the whole stripped text where none has."""
    found = tiles(docs, keys, F.col(text_col), SEGMENT).where(F.col("tile") != "\n")
    inner = F.regexp_replace("tile", r"(?U)^\s+|\s+$", "")
    lead = F.length("tile") - F.length(F.regexp_replace("tile", r"(?U)^\s+", ""))
    found = found.select(*keys, (F.col("start") + lead).alias("start"), inner.alias("segment")).withColumn("n_tokens", F.size(words(F.col("segment"))).cast("long"))
    kept = found.where(F.col("n_tokens") >= min_tokens).select(*keys, "start", (F.col("start") + F.length("segment")).alias("end"), "n_tokens", "segment")
    whole = F.regexp_replace(text_col, r"(?U)^\s+|\s+$", "")
    start = F.length(text_col) - F.length(F.regexp_replace(text_col, r"(?U)^\s+", ""))
    rest = docs.join(kept.select(*keys).distinct(), keys, "left_anti").select(*keys, start.cast("long").alias("start"), (start + F.length(whole)).cast("long").alias("end"), F.size(words(whole)).cast("long").alias("n_tokens"), whole.alias("segment")).where("n_tokens > 0")
    return kept.unionByName(rest)


def token_windows(docs: DataFrame, keys: list[str], text_col: str, size: int, step: int) -> DataFrame:
    """keys, start, end of windows of size tokens every step tokens; the one that reaches the end is the last."""
    if not 0 < step <= size:
        raise ValueError("step must be between 1 and size")
    tokens = tiles(docs, keys, F.col(text_col), TOKEN_TILE).where(F.col("tile").rlike(r"(?U)^[^\W_]"))
    own = Window.partitionBy(*keys).orderBy("pos")
    every = Window.partitionBy(*keys)
    end = F.col("start") + F.length("tile")
    numbered = tokens.select(*keys, "start", (F.row_number().over(own) - 1).alias("i"), F.count("*").over(every).alias("n"), F.coalesce(F.lead(end, size - 1).over(own), F.max(end).over(every)).alias("end"))
    return numbered.where((F.col("i") % step == 0) & ((F.col("i") == 0) | (F.col("i") - step + size < F.col("n")))).select(*keys, "start", "end")


def passages(docs: DataFrame, keys: list[str], text_col: str = "text", max_tokens: int = 120, overlap: int = 24) -> DataFrame:
    """keys, start, end, text of the windows of a document's tokens, cut inside its row: nothing is shuffled. Null texts and texts without tokens have none."""
    if max_tokens < 1 or not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be under max_tokens")
    ship_package(docs.sparkSession)
    step = max_tokens - overlap
    base = docs.select(*keys, F.col(text_col).cast("string").alias("passage_text"))

    def run(batches):
        for batch in batches:
            row, starts, ends, texts = [], [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                spans = [m.span() for m in TERM.finditer(text or "")]
                for k in range(1 + max(0, -(-(len(spans) - max_tokens) // step)) if spans else 0):
                    a, b = spans[k * step][0], spans[min(k * step + max_tokens, len(spans)) - 1][1]
                    row.append(i)
                    starts.append(a)
                    ends.append(b)
                    texts.append(text[a:b])
            own = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], names=[*keys, "start", "end", "text"])

    fields = [base.schema[k] for k in keys] + [StructField("start", LongType()), StructField("end", LongType()), StructField("text", StringType())]
    return spread(base).mapInArrow(run, StructType(fields))


def passage_id(id_col: str):
    return F.concat_ws(":", F.col(id_col).cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 120, overlap: int = 24) -> DataFrame:
    """passage_id, id, start, end, text, for indexing."""
    found = passages(docs, [id_col], text_col, max_tokens, overlap)
    return found.select(passage_id(id_col).alias("passage_id"), F.col(id_col), "start", "end", "text")
