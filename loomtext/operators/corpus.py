"""Tenant-bound corpus tables, change operations as new tables, job logs, counters and rate limits."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


class Tenant:
    """Access to tables through a mandatory workspace filter, on reads and on writes."""

    def __init__(self, workspace, column: str = "workspace_id") -> None:
        if workspace is None or workspace == "":
            raise ValueError("a workspace is needed")
        self.workspace, self.column = workspace, column

    def of(self, table: DataFrame) -> DataFrame:
        return table.where(F.col(self.column) == F.lit(self.workspace))

    def checked(self, rows: DataFrame) -> DataFrame:
        """rows to be written; one of another workspace is an error when it is reached."""
        other = F.raise_error(F.concat(F.lit("row of another workspace: "), F.coalesce(F.col(self.column).cast("string"), F.lit("none"))))
        own = F.col(self.column).eqNullSafe(F.lit(self.workspace))
        return rows.withColumn(self.column, F.when(own, F.col(self.column)).otherwise(other.cast(rows.schema[self.column].dataType)))


def dedupe(docs: DataFrame, tenant: str, id_col: str, text_col: str = "text") -> DataFrame:
    """id, canonical_id, is_duplicate: the same text within a tenant is stored once. The minimum is taken before anything but hashes is shuffled.

    A row with a null tenant or text is no duplicate of anything; null ids stand behind all others.
    """
    keyed = docs.select(F.col(id_col), F.col(tenant), F.sha2(text_col, 256).alias("sha"))
    first = keyed.groupBy(tenant, "sha").agg(F.min(id_col).alias("canonical_id"))
    canonical = F.coalesce("canonical_id", F.col(id_col))
    return keyed.join(first, [tenant, "sha"], "left").select(id_col, canonical.alias("canonical_id"), (~F.col(id_col).eqNullSafe(canonical)).alias("is_duplicate"))


def find_by_hash(documents: DataFrame, wanted: DataFrame, tenant: str) -> DataFrame:
    """The stored documents of wanted (tenant, content_sha256)."""
    return documents.join(wanted.select(tenant, "content_sha256").distinct(), [tenant, "content_sha256"], "left_semi")


def missing(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys known lacks: what must exist before a write."""
    return wanted.join(known.select(*keys).distinct(), keys, "left_anti")


def ensure(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table with a row for each of the keys that it lacks; other columns of new rows are null."""
    return table.unionByName(missing(keys.distinct(), table, keys.columns), allowMissingColumns=True)


def latest_of(changes: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """One row of each key: the last in order, the greatest of equal ones."""
    rest = [c for c in changes.columns if c not in keys]
    top = changes.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("m"))
    return top.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest]).select(*changes.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """table with the rows of changes in the place of rows with the same keys, and new ones added.

    Of several changes of a key the last in order counts. The columns in keep are not changed in rows
    that were there (the content hash of a stored document). Null keys match nothing.
    """
    new = latest_of(changes, keys, order)
    if keep:
        old = table.select(*keys, *[F.col(c).alias(f"old_{c}") for c in keep], F.lit(True).alias("was_there"))
        new = new.join(old, keys, "left").select(*[F.when(F.col("was_there"), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in table.columns])
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_children(children: DataFrame, new: DataFrame, parent: list[str], parents: DataFrame | None = None, vector: str | None = None, dims: int = 256) -> DataFrame:
    """All children of the parents in new are replaced by those in new.

    With parents given, a new child without one is an error; with a vector column given, so is a
    vector of other dimensions. Both checks run with the rows, not before them.
    """
    checked = new
    if parents is not None:
        known = parents.select(*parent).distinct().withColumn("is_known", F.lit(True))
        lost = F.raise_error(F.lit("passage without a document")).cast(new.schema[parent[0]].dataType)
        checked = checked.join(known, parent, "left").withColumn(parent[0], F.when(F.col("is_known"), F.col(parent[0])).otherwise(lost)).select(*new.columns)
    if vector is not None:
        wrong = F.raise_error(F.lit(f"vector of other than {dims} dimensions")).cast(new.schema[vector].dataType)
        checked = checked.withColumn(vector, F.when(F.size(vector) == dims, F.col(vector)).otherwise(wrong))
    return children.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(checked)


def delete_cascade(parents: DataFrame, children: list[DataFrame], gone: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """parents and child tables without the keys in gone."""
    dead = gone.select(*keys).distinct()
    return parents.join(dead, keys, "left_anti"), [c.join(dead, keys, "left_anti") for c in children]


def violations(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children that name a parent which isn't there; one with a null in its keys names none."""
    named = children.where(" and ".join(f"`{k}` is not null" for k in keys))
    return named.join(parents.select(*keys), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of the keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum by struct, so that the log combines before its exchange."""
    return latest_of(log, keys, order).select(*keys, *[c for c in log.columns if c not in keys])


def counters(events: DataFrame, name: str, *labels: str) -> DataFrame:
    """n (from 1, in the order of the lines), line: counters in the text format of metric scrapers; labels in the order of their names, null as empty."""
    clean = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), clean(c), F.lit('"')) for c in sorted(labels)])
    counted = events.groupBy(*labels).agg(F.count("*").alias("n")) if labels else events.agg(F.count("*").alias("n"))
    key = F.concat(F.lit(name), F.when(shown != "", F.concat(F.lit("{"), shown, F.lit("}"))).otherwise(""))
    lines = counted.groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
    return lines.select(F.row_number().over(Window.orderBy("key")).alias("n"), F.concat("key", F.lit(" "), F.col("n").cast("string")).alias("line"))


class Limiter:
    """The accepted times of one identity within the window; a time at or before its start has expired."""

    def __init__(self, requests: int, window_seconds: float, times=()) -> None:
        if requests < 1 or window_seconds <= 0:
            raise ValueError("requests and window_seconds must be positive")
        self.requests, self.window, self.held = requests, window_seconds, deque(times)

    def allow(self, now: float) -> bool:
        while self.held and now - self.held[0] >= self.window:
            self.held.popleft()
        fits = len(self.held) < self.requests
        if fits:
            self.held.append(now)
        return fits


def rate_limit(events: DataFrame, identity: str, at: str, order: str, requests: int, window_seconds: float) -> DataFrame:
    """order, identity, allowed: at most requests accepted ones in a window; rejected ones don't count.

    The decision needs the accepted ones before it, so identities are streamed in order through
    partitions: state is one deque of at most `requests` times, never an identity's whole log.
    Identities keep their type; null is an identity of its own; ties go by order.
    """
    Limiter(requests, window_seconds)
    rows = events.select(F.col(order).alias("n"), F.col(identity).alias("who"), F.col(at).cast("double").alias("t"))
    schema = StructType([rows.schema["n"], rows.schema["who"], StructField("allowed", BooleanType())])

    def run(batches):
        who, limiter = None, None
        for batch in batches:
            ids, times = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for w, t in zip(ids, times, strict=True):
                if limiter is None or w != who:
                    who, limiter = w, Limiter(requests, window_seconds)
                out.append(limiter.allow(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["n", "who", "allowed"])

    return rows.repartition("who").sortWithinPartitions("who", "t", "n").mapInArrow(run, schema).toDF(order, identity, "allowed")
