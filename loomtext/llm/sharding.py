"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over row numbers.

Rows get global numbers 0 to N-1: they are ordered by a hash bucket of (id, size, text crc) and by
these columns within it; bucket sizes are the only thing gathered, one number for ``BUCKET_ROWS`` rows
and at most ``MOST_BUCKETS``.
Equal rows are counted first and numbered as a run, so one key that holds much of the table makes no
large bucket. A keyed Feistel network permutes the smallest even or odd number of bits that holds N;
results of N or more walk on through it until they are below N. Position p is slot p // shards of
shard p % shards, so shards differ by at most one row and slots have no gaps (law ``rows``).

Defined cases: null text has size 1 and crc 0; null ids are numbered like a value of their own;
repeated rows get numbers of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.vectext import U, mix
from loomtext.session import ship_package

ROUNDS = 6
#: Rows to a bucket, and the most buckets: their sizes are what the driver gathers.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1_000_000


class FeistelPermutation:
    """A bijection of 0..n-1 for a key; forward gives the shuffled position of a row, backward the row at a position."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        bits = max(2, int(n - 1).bit_length()) if n > 1 else 2
        self.low, self.high = bits // 2, bits - bits // 2
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key))

    def _round(self, x: np.ndarray, k: int, bits: int) -> np.ndarray:
        return mix(x + self.keys[k]) & U((1 << bits) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> U(self.low), x & U((1 << self.low) - 1)  # high and low part; odd rounds change one, even rounds the other
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2:
                b = b ^ self._round(a, k, self.low)
            else:
                a = a ^ self._round(b, k, self.high)
        return a << U(self.low) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(U), back)
        out = np.flatnonzero(x >= U(self.n))
        while len(out):
            x[out] = self._once(x[out], back)
            out = out[x[out] >= U(self.n)]
        return x.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def backward(self, positions: np.ndarray) -> np.ndarray:
        return self._walk(positions, True)


def numbered(rows: DataFrame, columns: list[str], buckets: int) -> tuple[DataFrame, int]:
    """Distinct rows of the columns with their first global number and their count; and the number of all rows."""
    buckets = max(buckets, min(rows.count() // BUCKET_ROWS, MOST_BUCKETS))
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), F.lit(buckets)).alias("bucket")
    counted = rows.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("bucket", bucket)
    sizes = dict(rows.groupBy(bucket).count().collect())
    first, total = {}, 0
    for b in sorted(sizes):
        first[b], total = total, total + sizes[b]
    if not total:
        return counted.withColumn("number", F.lit(0).cast("long")), 0
    table = rows.sparkSession.createDataFrame(list(first.items()), "bucket long, base long")  # bounded by buckets
    within = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    out = counted.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(table), "bucket")
    return out.withColumn("number", F.col("base") + F.col("before")), total


def shard_rows(docs: DataFrame, shards: int = 16, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096, run: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    ship_package(docs.sparkSession)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, total = numbered(base, ["doc_id", "size", "text_crc32"], buckets)
    # equal rows: runs of at most `run` first, dealt anew where there is more than one, then single rows
    runs = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(run).cast("long"))))
    each = runs.withColumn("k", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + run, F.col("copies")) - 1))).withColumn("row", F.col("number") + F.col("k"))

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(FeistelPermutation(total, key).forward(row.to_numpy()))

    placed = each.withColumn("position", position("row"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
