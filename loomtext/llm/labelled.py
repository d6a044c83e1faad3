"""Bounded samples of labelled documents, by the hash of the id, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import cut


def remainder(col: str):
    """crc32 of the id as text, modulo 5; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5


def held_out(col: str):
    return remainder(col) == 0


def known_labels(labels: DataFrame, label: str, id_col: str = "doc_id", kind: str | None = None) -> DataFrame:
    """(id, y) of the ids that are not held out, once each: of several labels of an id the least counts. Rows with a null id or label don't count."""
    y = F.col(label) if kind is None else F.col(label).cast(kind)
    rows = labels.select(F.col(id_col).cast("long").alias("id"), y.alias("y")).where("id is not null and y is not null")
    return rows.where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"))


def _low_hashes(known: DataFrame, per_class: int, max_rows: int) -> DataFrame:
    """The rows of known whose hash is so low that they can be among the per_class least of their value, with room to spare; all rows where a value would get too few."""
    counts = known.groupBy("y").agg(F.count("*").alias("n")).orderBy("n", "y").limit(max_rows)
    share = F.least(F.lit(1.0), (4.0 * per_class + 50) / F.col("n"))
    limits = cut(counts.select(F.col("y").alias("ly"), "n", F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long")).alias("limit")))
    low = known.join(F.broadcast(limits), F.col("y") == F.col("ly")).where(F.xxhash64("id") <= F.col("limit")).select("id", "y", "n")
    short = low.groupBy("y").agg(F.count("*").alias("kept"), F.first("n").alias("n")).where(F.col("kept") < F.least(F.col("n"), F.lit(per_class)))
    return low.select("id", "y") if short.isEmpty() else known


def sample_texts(docs: DataFrame, known: DataFrame, per_class: int, max_rows: int = 20_000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, object]]:
    """(text, label) of a bounded sample of the rows (id, y) in known, whole texts all of them.

    Each label value gives its per_class ids of least hash; of these the first max_rows are taken, and
    of those the first whose texts fit in max_bytes, in the order of their rank within the value (so
    every value has its first row before any has a second), then by hash. The sample is the same
    wherever it is drawn. A repeated doc_id counts once, with its least text; null texts are empty.
    """
    by = [F.xxhash64("id"), F.col("id")]
    w = Window.partitionBy("y").orderBy(*by)
    ranked = _low_hashes(known, per_class, max_rows).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_class)
    chosen = ranked.orderBy("r", *by).limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most max_rows short rows are broadcast; the texts of these rows alone are kept
    rows = cut(text.join(F.broadcast(chosen), F.col("d") == F.col("id")).groupBy("id", "y", "r").agg(F.min("text").alias("text")))
    sizes = sorted(((r[1], r[2], r[0], r[3]) for r in rows.select("id", "r", F.xxhash64("id"), F.octet_length("text")).collect()))
    used, some = 0, []
    for _, _, i, size in sizes:
        if some and used + size > max_bytes:
            break
        used += size
        some.append(i)
    if not some:
        return []
    whole = rows if len(some) == len(sizes) else rows.where(F.col("id").isin(some))
    return [(r[0], r[1]) for r in whole.orderBy("r", *by).select("text", "y").collect()]
