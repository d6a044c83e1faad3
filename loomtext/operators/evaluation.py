"""Splits, thresholds, ranking metrics and interval metrics over scored rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import rounded
from loomtext.session import cut


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return [rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(share(2 * p * r, p + r), 4).alias("f1")]


def group_split(rows: DataFrame, group: str, fraction: float = 0.75, seed: int = 42) -> DataFrame:
    """rows with partition: whole groups go to calibration in the order of sha256 of seed:group, at least one to each side.

    Groups are counted by the first digits of their hash, so only the groups that share the digits
    of the last one taken are ordered. Null groups go to test.
    """
    groups = rows.select(F.col(group).alias("g")).where("g is not null").distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("g").cast("string")), 256))
    groups = cut(groups.withColumn("digits", F.substring("h", 1, 4)))
    counts = sorted(groups.groupBy("digits").count().collect())  # at most 65,536
    n = sum(c for _, c in counts)
    if n < 2:
        raise ValueError("two groups are needed")
    left, last = min(n - 1, max(1, round(n * fraction))), ""
    for last, c in counts:
        if left <= c:
            break
        left -= c
    border = groups.where(F.col("digits") == last).orderBy("h", "g").limit(left)
    taken = groups.where(F.col("digits") < last).unionByName(border).select("g", F.lit(True).alias("taken"))
    joined = rows.join(taken, rows[group] == taken["g"], "left")
    return joined.select(*[rows[c] for c in rows.columns], F.when(taken["taken"], "calibration").otherwise("test").alias("partition"))


def confusion_at(scored: DataFrame, threshold: float, keys: list[str] = ()) -> DataFrame:
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    counted = scored.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counted.select(*keys, tp, fp, tn, fn, *prf(tp, fp, fn), rounded(share(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"))


def by_threshold(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, fn and metrics at every distinct score and just above the largest: counts by score first, then one running sum over these."""
    per = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    # scores are rounded, so their number has a bound that doesn't grow with the rows
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    run = per.select(F.col("score").alias("threshold"), F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(every).alias("total"), (F.col("score") == F.max("score").over(every)).alias("top"))
    none = F.struct(F.expr("cast(reflect('java.lang.Math', 'nextUp', threshold) as double)").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    own = F.struct("threshold", "tp", "fp")
    at = run.select("total", F.explode(F.when(F.col("top"), F.array(own, none)).otherwise(F.array(own))).alias("t")).select("t.*", (F.col("total") - F.col("t.tp")).alias("fn"))
    return at.select("threshold", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def choose_threshold(scored: DataFrame) -> DataFrame:
    """The threshold with the best f1, then precision, recall and threshold."""
    best = by_threshold(scored).agg(F.max(F.struct("f1", "precision", "recall", "threshold")).alias("b"))
    return best.select("b.threshold", "b.f1", "b.precision", "b.recall")


def choose_threshold_grid(scored: DataFrame, low: int = 15, high: int = 85) -> DataFrame:
    """As above on a grid of hundredths: a row adds to the histogram cell of the last threshold that it reaches, so rows aren't multiplied."""
    near = F.floor(F.col("score") * 100)
    cell = F.when((near + 1) / 100.0 <= F.col("score"), near + 1).when(near / 100.0 > F.col("score"), near - 1).otherwise(near)
    cell = F.least(cell, F.lit(high))
    per = scored.groupBy(cell.alias("cell")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    grid = scored.sparkSession.range(low, high + 1).withColumnRenamed("id", "t")
    at = grid.join(F.broadcast(per)).groupBy("t").agg(F.sum(F.when(F.col("cell") >= F.col("t"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") >= F.col("t"), F.col("n")).otherwise(0)).alias("fp"), F.sum("p").alias("total"))
    scoredt = at.select((F.col("t") / 100.0).alias("threshold"), *prf(F.col("tp"), F.col("fp"), F.col("total") - F.col("tp")))
    return scoredt.agg(F.max(F.struct("f1", "precision", "threshold")).alias("b")).select("b.threshold", "b.f1", "b.precision")


def average_precision(scored: DataFrame) -> DataFrame:
    """Of the order by falling score, then pair_id. Ranks come from counts of the (rounded) scores and an order within each."""
    per = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("score", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"))
    own = Window.partitionBy("score").orderBy("pair_id")
    ranked = scored.withColumn("r", F.row_number().over(own)).withColumn("f", F.sum("label").over(own.rowsBetween(Window.unboundedPreceding, 0))).join(base, "score")
    gain = F.when(F.col("label") == 1, (F.col("f") + F.col("p0")) / (F.col("r") + F.col("n0"))).otherwise(0.0)
    return ranked.agg(rounded(share(F.sum(gain), F.sum("label"))).alias("average_precision"), F.sum("label").cast("long").alias("positives"))


def score_summary(scored: DataFrame) -> DataFrame:
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by score)")
    return scored.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), rounded(F.avg("score"), 6).alias("mean_score"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def dataset_fingerprint(pairs: DataFrame) -> DataFrame:
    """sha256 of the lines pair_id, group_id, label, category and the sha256 of source and candidate, in the order of pair_id.

    The hash is sequential by its definition: the lines stream to the driver one partition at a
    time, so this is for labelled sets; ``table_fingerprint`` is for tables of any size. Null fields
    count as empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("\0", text("pair_id"), text("group_id"), text("label"), text("category"), F.sha2(text("source"), 256), F.sha2(text("candidate"), 256))
    digest = hashlib.sha256()
    for r in pairs.select(text("pair_id").alias("pair_id"), line.alias("line")).orderBy("pair_id", "line").toLocalIterator():
        digest.update(f"{r[1]}\n".encode())
    return pairs.sparkSession.createDataFrame([(digest.hexdigest(),)], "fingerprint string")


def table_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """fingerprint, rows: a hash of the multiset of rows, whatever their order; sums of parts of the row digests combine in the tasks, nothing is gathered. A null differs from every text."""
    field = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    digest = F.sha2(F.concat_ws("\x1f", *[field(c) for c in columns]), 256)
    part = lambda k: F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.select(digest.alias("d")).agg(*[F.coalesce(F.sum(part(k)), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k in range(4)], F.count("*").alias("rows"))
    return sums.select(F.sha2(F.concat_ws(",", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"), "rows")


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of the unions of overlapping or touching intervals."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("top", F.max("end").over(w)).withColumn("new", F.when(F.col("top").isNull() | (F.col("start") > F.col("top")), 1).otherwise(0)).withColumn("island", F.sum("new").over(run))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def intersection_length(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, length of the common part of two interval tables, for keys that both have: one sweep over the ends of each key's merged intervals."""
    ends = lambda t, x, y: merge_intervals(t, keys).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(x).alias("a"), F.lit(y).alias("b")), F.struct(F.col("end").alias("at"), F.lit(-x).alias("a"), F.lit(-y).alias("b")))).alias("e")).select(*keys, "e.*")
    every = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max(F.abs("a")).alias("has_a"), F.max(F.abs("b")).alias("has_b"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = every.select(*keys, "has_a", "has_b", F.when((F.sum("a").over(run) > 0) & (F.sum("b").over(run) > 0), F.lead("at").over(w) - F.col("at")).otherwise(0).alias("size"))
    return swept.groupBy(*keys).agg(F.sum("size").cast("long").alias("length"), F.max("has_a").alias("x"), F.max("has_b").alias("y")).where("x > 0 and y > 0").drop("x", "y")


def passage_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """predicted_characters, annotated_characters, overlapping_characters, precision, recall, f1 over all keys together."""
    total = lambda t, name: merge_intervals(t, keys).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias(name))
    hit = intersection_length(predicted, truth, keys).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("overlapping_characters"))
    one = total(predicted, "predicted_characters").join(total(truth, "annotated_characters")).join(hit)  # one row each
    p, t, h = (F.col(c) for c in ("predicted_characters", "annotated_characters", "overlapping_characters"))
    return one.select(p, t, h, *prf(h, p - h, t - h))


def binary_report(outcomes: DataFrame) -> DataFrame:
    """category (null: all), examples, tp, fp, tn, fn and metrics of rows (label, verdict, category): a verdict other than low_overlap is a positive."""
    hit, pos = F.col("verdict") != "low_overlap", F.col("label") == 1
    counted = outcomes.groupingSets([[], [F.col("category")]], "category").agg(F.count("*").alias("examples"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    return counted.select("category", "examples", "tp", "fp", "tn", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def leakage(split: DataFrame, group: str) -> DataFrame:
    return split.groupBy(group).agg(F.count_distinct("partition").alias("sides")).agg(F.count_if(F.col("sides") > 1).alias("leaked_groups"), F.count("*").alias("groups"))
