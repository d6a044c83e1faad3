"""Connected components of an edge table by least neighbours and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import cut, tidy


#: Parts into which the nodes under one hub are dealt.
SALTS = 16


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; the label is the least node of its component.

    A row (u, v) with v < u says that v is a smaller neighbour of u. In a round every u keeps its
    least neighbour m, each other neighbour of it becomes (v, m), and (u, m) jumps to the least
    neighbour of m where there is one. Neither step splits a component, and both lower the second
    end, so in the end every node has one row, to its component's least node. A node has few
    smaller neighbours; the many nodes under one hub meet it only in a join, which is salted.

    Edges with a null end are ignored, loops and repeated edges change nothing, an empty table gives
    an empty result. Every round ends in a reliable checkpoint, so no lineage grows and nothing is
    collected but a count.
    """
    found = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    e = found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    w = Window.partitionBy("u").orderBy("v")
    while True:
        least = e.select("u", "v", F.first("v").over(w).alias("m"), F.lag("v").over(w).alias("before")).where("before is null or before <> v")
        up = least.where("v = m").select(F.col("u").alias("p"), F.col("m").alias("pm"))
        moved = least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("v") != F.col("m")).alias("changed"))
        # only ends that have a smaller neighbour themselves jump; a hub that is a component's least node drops out here
        jumps = up.join(moved.select("v").distinct(), up.p == F.col("v"), "left_semi").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = moved.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        e = cut(salted.join(jumps, (salted.v == jumps.p) & (salted.salt == jumps.s), "left").select("u", F.coalesce("pm", "v").alias("v"), (F.col("changed") | F.col("pm").isNotNull()).alias("changed")))
        more = e.agg(F.count_if("changed")).first()[0]
        tidy(edges.sparkSession)  # what the round before left in the driver and on disk
        if not more:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
