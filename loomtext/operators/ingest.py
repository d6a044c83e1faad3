"""Batch ingestion into tenant tables: extract, deduplicate, chunk, store, and the log of jobs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import corpus, segments
from loomtext.sources import files

# The states of a job, and what is told of a failure.
STATES = ("queued", "processing", "ready", "failed")
EXTRACTION_FAILED = "document_extraction_failed"


@dataclass(frozen=True)
class CorpusTables:
    """documents (workspace_id, document_id, content_sha256, filename, character_count, status) and passages (workspace_id, document_id, passage_id, start, end); every change gives new tables."""

    documents: DataFrame
    passages: DataFrame

    def find_document_by_hash(self, wanted: DataFrame) -> DataFrame:
        return corpus.find_by_hash(self.documents, wanted, "workspace_id")

    def save_documents(self, rows: DataFrame) -> CorpusTables:
        """Conflicts update all but the content hash."""
        return replace(self, documents=corpus.upsert(self.documents, rows, ["workspace_id", "document_id"], keep=["content_sha256"]))

    def replace_passages(self, rows: DataFrame) -> CorpusTables:
        return replace(self, passages=corpus.replace_children(self.passages, rows, ["workspace_id", "document_id"], self.documents))

    def delete_documents(self, gone: DataFrame) -> CorpusTables:
        d, (p,) = corpus.delete_cascade(self.documents, [self.passages], gone, ["workspace_id", "document_id"])
        return CorpusTables(d, p)

    def _placed(self, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The rows of the batch that count, who owns each text, and the rows without their texts beside the owner."""
        keyed = batch.where("text is not null and workspace_id is not null").withColumn("content_sha256", F.sha2("text", 256))
        own = ["workspace_id", "content_sha256"]
        stored = self.documents.groupBy(*own).agg(F.min("document_id").alias("old_id"))
        first = keyed.groupBy(*own).agg(F.min("document_id").alias("first_id"))
        owner = first.join(stored, own, "left").select(*own, F.coalesce("old_id", "first_id").alias("stored_id"), F.col("old_id").isNull().alias("is_new"))
        placed = keyed.drop("text").join(owner, own)
        return keyed, owner, placed

    def stored_ids(self, batch: DataFrame) -> DataFrame:
        """workspace_id, document_id, stored_id of the rows that ``ingest`` tells of, without cutting a passage."""
        return self._placed(batch)[2].select("workspace_id", "document_id", "stored_id")

    def ingest(self, batch: DataFrame, max_tokens: int = 120, overlap: int = 24) -> tuple[CorpusTables, DataFrame]:
        """New tables and, for each row (workspace_id, document_id, filename, text) of the batch, document_id, stored_id, duplicate, passages.

        A text that the workspace has already, or that an earlier row (by document_id) of the batch
        has, is a duplicate of it and adds nothing: only new texts are chunked. Rows without a text or
        a workspace are left out.
        """
        keyed, owner, placed = self._placed(batch)
        new = keyed.join(owner.where("is_new").select("workspace_id", "content_sha256", F.col("stored_id").alias("document_id")), ["workspace_id", "content_sha256", "document_id"], "left_semi").dropDuplicates(["workspace_id", "document_id"])
        passages = segments.passages(new, ["workspace_id", "document_id"], "text", max_tokens, overlap).withColumn("passage_id", segments.passage_id("document_id"))
        rows = new.select("workspace_id", "document_id", "content_sha256", "filename", F.length("text").cast("long").alias("character_count"), F.lit("ready").alias("status"))
        tables = CorpusTables(self.documents.unionByName(rows), self.passages.unionByName(passages.select(*self.passages.columns)))
        counted = passages.groupBy("workspace_id", F.col("document_id").alias("stored_id")).agg(F.count("*").alias("n"))
        duplicate = ~(F.col("is_new") & (F.col("document_id") == F.col("stored_id")))
        told = placed.join(counted, ["workspace_id", "stored_id"], "left").select("workspace_id", "document_id", "stored_id", duplicate.alias("duplicate"), F.when(duplicate, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("passages"))
        return tables, told


@dataclass(frozen=True)
class JobLog:
    """An append-only log (workspace_id, job_id, filename, status, document_id, error_code, step); the last step of a job is its state."""

    log: DataFrame

    def create(self, jobs: DataFrame) -> JobLog:
        """Jobs with a key that is there already are an error when they are reached."""
        keys = ["workspace_id", "job_id"]
        there = self.log.select(*keys).distinct().withColumn("there", F.lit(True))
        again = F.raise_error(F.lit("job exists")).cast("string")
        fresh = jobs.join(there, keys, "left").withColumn("status", F.when(F.col("there"), again).otherwise(F.lit("queued")))
        rows = fresh.select(*keys, "filename", "status", F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("string").alias("error_code"), F.lit(0).alias("step"))
        return JobLog(self.log.unionByName(rows))

    def update(self, changes: DataFrame) -> JobLog:
        """changes (workspace_id, job_id, status, document_id, error_code, step) of jobs that must be there."""
        names = self.log.select("workspace_id", "job_id", "filename").distinct()
        lost = F.raise_error(F.lit("no such job")).cast("string")
        rows = changes.join(names.withColumn("there", F.lit(True)), ["workspace_id", "job_id"], "left").withColumn("status", F.when(F.col("there"), F.col("status")).otherwise(lost))
        return JobLog(self.log.unionByName(rows.select(*self.log.columns)))

    def get(self, workspace_id: str, job_id) -> DataFrame:
        """The state of one job; no row where the workspace has no such job."""
        return JobLog(corpus.Tenant(workspace_id).of(self.log).where(F.col("job_id") == F.lit(job_id))).state()

    def state(self) -> DataFrame:
        return corpus.latest(self.log, ["workspace_id", "job_id"], ["step"])


def run_jobs(tables: CorpusTables, uploads: DataFrame, max_tokens: int = 120, overlap: int = 24) -> tuple[CorpusTables, DataFrame]:
    """New tables and the log of the jobs of uploads (workspace_id, job_id, filename, content): queued, processing, then ready or failed."""
    found = files.extract(uploads)
    fine = found.where("error is null").select("workspace_id", F.col("job_id").alias("document_id"), "filename", "text")
    new = tables.ingest(fine, max_tokens, overlap)[0]
    told = tables.stored_ids(fine)  # the log needs no passages
    ended = found.drop("text").join(told.select("workspace_id", F.col("document_id").alias("job_id"), "stored_id"), ["workspace_id", "job_id"], "left")
    none = F.lit(None).cast("string")
    step = lambda n, status, document, error: F.struct(F.lit(n).alias("step"), status.alias("status"), document.alias("document_id"), error.alias("error_code"))
    failed = F.col("error").isNotNull()
    last = step(2, F.when(failed, "failed").otherwise("ready"), F.when(~failed, F.col("stored_id").cast("string")), F.when(failed, EXTRACTION_FAILED))
    log = ended.select("workspace_id", "job_id", "filename", F.explode(F.array(step(0, F.lit("queued"), none, none), step(1, F.lit("processing"), none, none), last)).alias("s"))
    return new, log.select("workspace_id", "job_id", "filename", "s.status", "s.document_id", "s.error_code", "s.step")


def add_feedback(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with new rows of feedback; a feedback_id that is there already is an error when it is reached."""
    there = table.select("workspace_id", "feedback_id").distinct().withColumn("there", F.lit(True))
    again = F.raise_error(F.lit("feedback exists")).cast("string")
    return table.unionByName(rows.join(there, ["workspace_id", "feedback_id"], "left").withColumn("decision", F.when(F.col("there"), again).otherwise(F.col("decision"))).select(*table.columns))
