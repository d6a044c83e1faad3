"""All registered queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import features
from loomtext.functions.text import content_key, fold, rounded, terms, words
from loomtext.operators import adversarial, benchmark, corpus, embedding, evaluation, ingest, legacy, pairwise, retrieval, segments, validation
from loomtext.plans.oracles import ORACLES
from loomtext.session import cut, spread
from loomtext.sources import files


#: Rows of (query, passage) up to which they are broadcast.
PAIR_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _items(spark, sf):
    return table(spark, sf, "benchmark")


def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.size(terms(F.col("text"))).cast("long").alias("n_terms"))


def normalized_hash_groups(spark, sf):
    return _docs(spark, sf).select("doc_id", content_key(F.col("text")).alias("content_key")).groupBy("content_key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def content_dedupe(spark, sf):
    return corpus.dedupe(_docs(spark, sf), "source", "doc_id")


def segment_spans(spark, sf):
    return segments.segments(_docs(spark, sf), ["doc_id"]).select("doc_id", "start", "end", "n_tokens")


def chunk_spans(spark, sf):
    return segments.chunks(_docs(spark, sf)).select("passage_id", "doc_id", "start", "end", F.sha2("text", 256).alias("text_sha"))


def segment_windows(spark, sf):
    return segments.token_windows(_items(spark, sf), ["item_id"], "text", 16, 8)


def word_features(spark, sf):
    return features.top_features(_docs(spark, sf), "words")


def char_features(spark, sf):
    return features.top_features(_docs(spark, sf), "characters")


def document_frequency(spark, sf):
    return retrieval.document_frequency(_docs(spark, sf))


def corpus_stats(spark, sf):
    return retrieval.corpus_stats(_docs(spark, sf)).select("n", rounded(F.col("avg_len")).alias("avg_len"))


def bm25_topk(spark, sf):
    return retrieval.bm25(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", 10)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage"), F.col("embedding").cast("array<double>").alias("v"))


def dense_topk(spark, sf):
    v = _vectors(spark, sf)
    q = v.where("passage % 50 = 0").select(F.col("passage").alias("query"), F.col("v").alias("q"))
    return retrieval.dense_topk(q, v, 5)


def _pairs(spark, sf):
    """Each benchmark item with its three best documents: a bounded few rows, whose side of the join is broadcast while they are few."""
    found = retrieval.bm25(_items(spark, sf), _docs(spark, sf), "item_id", "doc_id", 3)
    found = cut(found.select("query", "passage"))
    found = F.broadcast(found) if found.count() <= PAIR_ROWS else found
    sources = _items(spark, sf).select(F.col("item_id").alias("query"), F.col("text").alias("source"))
    candidates = _docs(spark, sf).select(F.col("doc_id").alias("passage"), F.col("text").alias("candidate"))
    return found.join(sources, "query").join(candidates, "passage").select(F.concat_ws("-", F.col("query").cast("string"), F.col("passage").cast("string")).alias("pair_id"), "source", "candidate")


def pair_similarities(spark, sf):
    found = pairwise.similarities(_pairs(spark, sf))
    return found.select("pair_id", *[rounded(F.col(c)).alias(c) for c in ("lexical", "chars", "containment")])


def segment_best_match(spark, sf):
    return pairwise.best_matches(_pairs(spark, sf)).select("pair_id", "source_start", "source_end", "candidate_start", "candidate_end", "similarity", "match_type")


def evidence_spans(spark, sf):
    return pairwise.evidence(_pairs(spark, sf)).select("pair_id", "n", "source_start", "source_end", "candidate_start", "candidate_end", "similarity", "match_type")


def retrieve_then_analyze(spark, sf):
    found = pairwise.analyze(_pairs(spark, sf))
    return found.select("pair_id", "score", "verdict", "lexical", "chars", "containment", "coverage", F.size("evidence").cast("long").alias("n_evidence"), "method")


def _hybrid(spark, sf, top_k, reranker=None):
    """BM25 and md5-hashed embeddings of all documents, ranks of full rankings."""
    found = retrieval.HybridRetriever(embedding.HashingEmbedder(256, "md5"), reranker)
    index = found.index(_docs(spark, sf), "doc_id")
    return found.search(index, _items(spark, sf), "item_id", top_k, 50, passages=_docs(spark, sf), id_col="doc_id")


def rrf_hybrid(spark, sf):
    return _hybrid(spark, sf, 10).select("query", "passage", "lexical_rank", "dense_rank", "score", "rank")


class LexicalReranker:
    """A reranker of the engine's own: the lexical similarity of query and passage."""

    name = "lexical"

    def score(self, query: str, passages: list[str]) -> list[float]:
        return [round(pairwise.lexical_similarity(query, p) * 1e6) / 1e6 for p in passages]


def rerank_blend(spark, sf):
    return _hybrid(spark, sf, 10, LexicalReranker()).select("query", "passage", "lexical_rank", "dense_rank", "reranker_score", "rank", "method")


def hash_embed_md5(spark, sf):
    v = spread(_docs(spark, sf)).select("doc_id", embedding.encoder(embedding.HashingEmbedder(256, "md5"))(F.col("text")).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("bucket", "w")).where("w > 0").select("doc_id", "bucket", rounded(F.col("w")).alias("weight"))


def hash_embed_blake2b(spark, sf):
    return spread(_docs(spark, sf)).select("doc_id", embedding.encoder(embedding.HashingEmbedder())(F.col("text")).alias("embedding"))


def _scored(spark, sf):
    """pair_id, group, category, label, score: labelled documents scored by their share of distinct terms."""
    t = terms(F.col("text"))
    score = F.when(F.size(t) > 0, rounded(F.size(F.array_distinct(t)) / F.size(t), 4)).otherwise(0.0)
    return _docs(spark, sf).select("doc_id", F.col("source").alias("group"), F.col("lang").alias("category"), score.alias("score")).join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label")), "doc_id").withColumnRenamed("doc_id", "pair_id")


def group_split(spark, sf):
    return evaluation.group_split(_scored(spark, sf), "group").select("pair_id", "group", "partition")


def split_leakage(spark, sf):
    return evaluation.leakage(evaluation.group_split(_scored(spark, sf), "group"), "group")


def threshold_metrics(spark, sf):
    return evaluation.confusion_at(_scored(spark, sf), 0.5)


def metrics_by_category(spark, sf):
    return evaluation.confusion_at(_scored(spark, sf), 0.5, ["category"])


def thresholds_distinct(spark, sf):
    return evaluation.by_threshold(_scored(spark, sf))


def choose_threshold_distinct(spark, sf):
    return evaluation.choose_threshold(_scored(spark, sf))


def choose_threshold_grid(spark, sf):
    return evaluation.choose_threshold_grid(_scored(spark, sf))


def average_precision(spark, sf):
    return evaluation.average_precision(_scored(spark, sf))


def score_summary(spark, sf):
    return evaluation.score_summary(_scored(spark, sf))


def dataset_fingerprint(spark, sf):
    return evaluation.dataset_fingerprint(_labelled(spark, sf))


def table_fingerprint(spark, sf):
    return evaluation.table_fingerprint(_docs(spark, sf), ["doc_id", "source", "text"])


def _labelled(spark, sf):
    """The derived pairs with label (the document holds the item), group (hash of the item) and category (the document's language)."""
    pairs = _pairs(spark, sf)
    d = _docs(spark, sf).select(F.col("doc_id").alias("d"), F.col("lang").alias("category"))
    labelled = pairs.join(d, F.element_at(F.split("pair_id", "-"), -1).cast("long") == F.col("d")).drop("d")
    return labelled.withColumn("label", F.contains("candidate", "source").cast("int")).withColumn("group_id", content_key(F.col("source")))


def _outcomes(spark, sf):
    pairs = _labelled(spark, sf)
    return pairwise.analyze(pairs).join(pairs, "pair_id")


def evaluate_report(spark, sf):
    return evaluation.binary_report(_outcomes(spark, sf))


def passage_metrics(spark, sf):
    found = cut(_outcomes(spark, sf))
    span = found.select("pair_id", F.explode("evidence").alias("e")).select("pair_id", F.col("e.candidate_start").alias("start"), F.col("e.candidate_end").alias("end"))
    at = F.expr("locate(source, candidate)").cast("long") - 1
    truth = found.where("label = 1").select("pair_id", at.alias("start"), (at + F.length("source")).alias("end"))
    return evaluation.passage_metrics(span, truth, ["pair_id"])


def _intervals(spark, sf):
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select("user_id", seconds.alias("start"), (seconds + F.floor("value").cast("long") % 7200).alias("end"), "event_type")


def interval_merge(spark, sf):
    return evaluation.merge_intervals(_intervals(spark, sf).drop("event_type"), ["user_id"])


def interval_intersection(spark, sf):
    i = _intervals(spark, sf)
    side = lambda k: i.where(F.col("event_type") == k).drop("event_type")
    return evaluation.intersection_length(side("click"), side("view"), ["user_id"])


def adversarial_suite(spark, sf):
    return adversarial.suite(_docs(spark, sf).where("n_chars <= 100000"), "doc_id").select("example_id", "category", F.sha2("candidate", 256).alias("candidate_sha"), "candidate_end", "source_end")


def adversarial_scores(spark, sf):
    made = adversarial.suite(_items(spark, sf), "item_id")
    pairs = made.select(F.col("example_id").alias("pair_id"), "source", "candidate")
    return pairwise.similarities(pairs).select("pair_id", rounded(F.col("lexical")).alias("lexical"))


def _tenant(spark, sf):
    """The least source: one of the bounded set of tenants of the workload."""
    return corpus.Tenant(_docs(spark, sf).agg(F.min("source")).first()[0], "source")


def tenant_documents(spark, sf):
    return _tenant(spark, sf).of(_docs(spark, sf)).select("doc_id", "source", F.sha2("text", 256).alias("sha"))


def tenant_search(spark, sf):
    """Vectors of one tenant (label 1) for the queries of that tenant."""
    v = corpus.Tenant(1, "label").of(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("passage"), F.col("embedding").alias("v"))
    return retrieval.dense_topk(v.where("passage % 20 = 0").select(F.col("passage").alias("query"), F.col("v").alias("q")), v, 5)


def lsh_candidates(spark, sf):
    v = _vectors(spark, sf)
    return legacy.cosine_neighbours(v, v.where("passage % 50 = 0").select(F.col("passage").alias("query"), F.col("v").alias("q")), 5)


def _stored(spark, sf):
    """Tables that hold the even documents of each source."""
    d = _docs(spark, sf).where("doc_id % 2 = 0").select(F.col("source").alias("workspace_id"), F.col("doc_id").alias("document_id"), F.lit("f").alias("filename"), "text")
    none = spark.createDataFrame([], "workspace_id string, document_id long, content_sha256 string, filename string, character_count long, status string")
    return ingest.CorpusTables(none, spark.createDataFrame([], "workspace_id string, document_id long, passage_id string, start long, end long")).ingest(d)[0]


def ingest_batch(spark, sf):
    batch = _docs(spark, sf).select(F.col("source").alias("workspace_id"), F.col("doc_id").alias("document_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")
    return _stored(spark, sf).ingest(batch)[1]


def lookup_by_hash(spark, sf):
    d = _docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("content_sha256"))
    return corpus.find_by_hash(d, d.where("doc_id % 5 = 0"), "source").select("doc_id", "source")


def replace_passages(spark, sf):
    d = _docs(spark, sf)
    return corpus.replace_children(segments.chunks(d), segments.chunks(d.where("doc_id % 10 = 0"), max_tokens=60, overlap=12), ["doc_id"], d).drop("text")


def cascade_delete(spark, sf):
    d = _docs(spark, sf)
    documents, (passages,) = corpus.delete_cascade(d.select("doc_id"), [segments.chunks(d)], d.where("doc_id % 9 = 0"), ["doc_id"])
    return passages.join(documents, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


def ensure_workspaces(spark, sf):
    d = _docs(spark, sf)
    known = d.where("doc_id % 40 = 0").select(F.col("source").alias("workspace_id")).distinct().withColumn("origin", F.lit("known"))
    return corpus.ensure(known, d.select(F.col("source").alias("workspace_id")))


def upsert_documents(spark, sf):
    d = _docs(spark, sf).select("doc_id", "n_chars", F.lit("stored").alias("status"))
    return corpus.upsert(d, d.where("doc_id % 7 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit("changed").alias("status")), ["doc_id"])


def referential_violations(spark, sf):
    return corpus.violations(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).where("o_custkey % 10 <> 0"), ["o_custkey"]).select("o_orderkey", "o_custkey")


def missing_parents(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    return corpus.missing(wanted, table(spark, sf, "customer").where("c_custkey % 3 = 0"), ["c_custkey"])


def repeated_texts(spark, sf):
    return corpus.repeated(_docs(spark, sf).select(F.sha2("text", 256).alias("sha")), ["sha"])


def job_latest_status(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return corpus.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def counters_prometheus(spark, sf):
    return corpus.counters(table(spark, sf, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even")), "events_total", "event_type", "side")


def rate_limiter(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6)
    return corpus.rate_limit(e, "user_id", "t", "event_id", 2, 86400.0)


#: The reviewers' decisions that the kinds of events stand for.
DECISION_OF = {"click": "accepted_match", "view": "dismissed", "purchase": "properly_cited", "signup": "common_phrase"}


def feedback_by_decision(spark, sf):
    e = table(spark, sf, "events")
    of = F.create_map(*[F.lit(x) for kv in DECISION_OF.items() for x in kv])
    rows = e.select(F.lit("w").alias("workspace_id"), F.col("event_id").alias("feedback_id"), of[F.col("event_type")].alias("decision")).where("decision is not null")
    stored = ingest.add_feedback(rows.where("feedback_id % 2 = 0"), rows.where("feedback_id % 2 = 1"))
    return stored.groupBy("decision").agg(F.count("*").alias("n"))


def job_states(spark, sf):
    """One job for each document; those whose id is divisible by 5 came as bytes of no known kind."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".bin").otherwise(".txt"))
    uploads = _docs(spark, sf).select(F.col("source").alias("workspace_id"), F.col("doc_id").alias("job_id"), name.alias("filename"), F.encode("text", "utf-8").alias("content"))
    log = ingest.run_jobs(ingest.CorpusTables(spark.createDataFrame([], "workspace_id string, document_id long, content_sha256 string, filename string, character_count long, status string"), spark.createDataFrame([], "workspace_id string, document_id long, passage_id string, start long, end long")), uploads)[1]
    return ingest.JobLog(log).state().select("workspace_id", "job_id", "status", "document_id", "error_code")


def extract_text(spark, sf):
    uploads = _docs(spark, sf).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".pdf").otherwise(".txt")).alias("filename"), F.encode("text", "utf-8").alias("content"))
    return files.extract(uploads).select("doc_id", F.sha2("text", 256).alias("text_sha"), "error")


def request_ids(spark, sf):
    ids = table(spark, sf, "events").select("event_id", F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " ").otherwise("-"), F.col("user_id").cast("string")).alias("request_id"))
    return ids.select("event_id", validation.valid_request_id(F.col("request_id")).alias("valid"))


def invalid_requests(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), F.substring("text", 1, 300).alias("query"), (F.col("doc_id") % 120).alias("top_k"), F.col("source").alias("decision"))
    return validation.requests(rows, validation.SEARCH, {"top_k": validation.SEARCH_NUMBERS["top_k"]}).select("document_id", "error")


def invalid_annotations(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("event_id", (F.col("event_id") % 10 - 1).cast("int").alias("candidate_start"), (F.col("event_id") % 7).cast("int").alias("candidate_end"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 5).cast("int")).alias("source_start"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 6).cast("int")).alias("source_end"))
    return validation.annotations(rows).select("event_id", "error")


def invalid_pairs(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("pair_id"), F.when(F.col("doc_id") % 6 > 0, F.col("source")).otherwise(" ").alias("group_id"), F.substring("text", 1, 20).alias("source"), F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("candidate"), (F.col("quality") + F.col("toxic")).alias("label"))
    return validation.pairs(rows).select("pair_id", "error")


def invalid_scores(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("score"))
    return validation.finite(rows).select("event_id", "error")


def api_key_lookup(spark, sf):
    key = lambda c: F.concat(F.lit("key-of-customer-00000"), F.col(c).cast("string"))
    keys = table(spark, sf, "customer").select(key("c_custkey").alias("api_key"), F.col("c_nationkey").alias("workspace_id"))
    return validation.KeyTable(keys).authenticate(table(spark, sf, "events").select("event_id", key("user_id").alias("api_key")))


def dataset_totals(spark, sf):
    return benchmark.totals(_labelled(spark, sf))


def report_counts(spark, sf):
    """examples, groups, and the sorted sets of categories and methods."""
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return _outcomes(spark, sf).agg(F.count("*").alias("examples"), F.count_distinct("group_id").alias("unique_groups"), sets("category").alias("categories"), sets("method").alias("methods"))


def model_benchmark(spark, sf):
    """Columns that time and hardware can't change."""
    return benchmark.run_benchmark(_labelled(spark, sf), [benchmark.LexicalScorer()], calibration_fraction=0.5)


def model_benchmark_all(spark, sf):
    return benchmark.run_benchmark(_labelled(spark, sf), [benchmark.AnalyzerScorer(), benchmark.EmbeddingScorer(embedding.HashingEmbedder())])


def baseline_report(spark, sf):
    return benchmark.baseline_report(_labelled(spark, sf).withColumnRenamed("group_id", "group"))


def score_union(spark, sf):
    """Percentiles over both parts of a split together."""
    split = evaluation.group_split(_scored(spark, sf), "group")
    both = split.where("partition = 'calibration'").unionByName(split.where("partition = 'test'"))
    return benchmark.latency_summary(both.withColumnRenamed("score", "latency_ms"))


def group_split_shuffle(spark, sf):
    return benchmark.shuffled_split(_scored(spark, sf), "group").select("pair_id", "group", "partition")


def stored_split(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    stored = d.where("doc_id % 5 < 4").select(F.lit("train").alias("partition"), F.col("doc_id").alias("index")).unionByName(d.where("doc_id % 5 = 4").select(F.lit("test").alias("partition"), F.col("doc_id").alias("index")))
    return benchmark.stored_split(d, "doc_id", stored)


def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(legacy.clean_text(F.col("text")), 256).alias("clean_sha"))


def sentence_blocks(spark, sf):
    return legacy.sentence_blocks(_docs(spark, sf)).select("doc_id", "block", F.sha2("text", 256).alias("text_sha"))


def chunk_verdicts(spark, sf):
    blocks = legacy.sentence_blocks(_docs(spark, sf))
    return legacy.chunk_verdicts(blocks.select("doc_id", (F.length("text") % 101).cast("double").alias("p")), "doc_id", "p")


def classifier_metrics(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", legacy.clean_text(F.col("text")).alias("clean"), F.col("quality").cast("double").alias("label")).where("clean <> ''")
    return legacy.classifier_metrics(rows.where("doc_id % 5 < 4"), rows.where("doc_id % 5 = 4"), 2000, 20)


def code_normalize(spark, sf):
    code = F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("(a):\n    b"), F.col("item_id").cast("string"), F.lit(" = a + 1\n    return b\n"))
    return _items(spark, sf).select("item_id", F.sha2(legacy.code_key(code), 256).alias("code_sha"))


def null_counts(spark, sf):
    return legacy.null_counts(table(spark, sf, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even")))


def text_size(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("character_count"))


def corpus_service(spark, sf):
    """Chunks of all documents as passages, numbered by document and place; BM25 over them."""
    d = _docs(spark, sf)
    texts = segments.chunks(d).select((F.col("doc_id") * 1_000_000 + F.col("start")).alias("passage_id"), "text")
    found = retrieval.HybridRetriever()
    return found.search(found.index(texts), _items(spark, sf), "item_id", 5, 50).select("query", "passage", "lexical_rank", "score", "rank", "method")


def label_distribution(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def text_length_summary(spark, sf):
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min_words"), F.max(n).cast("long").alias("max_words"), F.sum(n).alias("sum_words"))


def folded_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded_sha"))


QUERIES = [retrieve_then_analyze, bm25_topk, token_counts, normalized_hash_groups, content_dedupe, segment_spans, chunk_spans, segment_windows, word_features, char_features, document_frequency, corpus_stats, dense_topk, pair_similarities, segment_best_match, evidence_spans, rrf_hybrid, rerank_blend, hash_embed_md5, hash_embed_blake2b, group_split, split_leakage, threshold_metrics, metrics_by_category, thresholds_distinct, choose_threshold_distinct, choose_threshold_grid, average_precision, score_summary, dataset_fingerprint, table_fingerprint, evaluate_report, passage_metrics, interval_merge, interval_intersection, adversarial_suite, tenant_documents, upsert_documents, referential_violations, job_latest_status, counters_prometheus, rate_limiter, label_distribution, text_length_summary, folded_text, adversarial_scores, tenant_search, lsh_candidates, ingest_batch, lookup_by_hash, replace_passages, cascade_delete, ensure_workspaces, missing_parents, repeated_texts, feedback_by_decision, job_states, extract_text, request_ids, invalid_requests, invalid_annotations, invalid_pairs, invalid_scores, api_key_lookup, dataset_totals, report_counts, model_benchmark, model_benchmark_all, baseline_report, score_union, group_split_shuffle, stored_split, clean_text, sentence_blocks, chunk_verdicts, classifier_metrics, code_normalize, null_counts, text_size, corpus_service]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve_then_analyze(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
