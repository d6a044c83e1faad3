"""Streaming forms of two operators; the reference semantics are those of the batch forms in ``operators.corpus``, the streams are an addition of this engine.

Counters are a plain streaming aggregate. The limiter keeps for each identity its accepted times
within the window (at most ``requests`` numbers) in the state store; rows of one micro-batch are taken
in the order of their time, rows of a later one come after them, and an identity's state goes when
its window has passed without a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators.corpus import Limiter


def counts(events: DataFrame, *labels: str) -> DataFrame:
    """labels, n so far; for the output modes complete and update."""
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *labels: str) -> DataFrame:
    """start, labels, n of windows of a width; rows later than late behind the latest are left out, and windows are final then."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *labels).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *labels, "n")


def limited(events: DataFrame, identity: str, at: str, order: str, requests: int, window_seconds: float) -> DataFrame:
    """order, identity, allowed for a stream of events; at is a time in seconds. Stateful, so identities should be many."""
    Limiter(requests, window_seconds)
    rows = events.select(F.col(identity).cast("string").alias("who"), F.col(at).cast("double").alias("t"), F.col(order).cast("long").alias("n"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(requests, window_seconds, state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["t", "n"])
        allowed = [limiter.allow(t) for t in rows["t"]]
        state.update((list(limiter.held),))
        state.setTimeoutDuration(int(window_seconds * 1000) + 1)
        yield pd.DataFrame({"n": rows["n"], "who": key[0], "allowed": allowed})

    out = rows.groupBy("who").applyInPandasWithState(run, "n long, who string, allowed boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.toDF(order, identity, "allowed")
