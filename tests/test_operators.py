import hashlib
import importlib.util
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomtext.functions import features
from loomtext.operators import adversarial, benchmark, corpus, embedding, evaluation, ingest, legacy, pairwise, retrieval, segments, validation
from loomtext.plans import registry
from loomtext.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels", "events", "orders", "customer")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, SF), duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*[f"`{n}`" for n in names]).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_identical_pair_has_exact_evidence(spark):
    text = "The engine compares two documents carefully. Every passage keeps its offsets in the source text."
    pairs = spark.createDataFrame([("same", text, text), ("other", text, "Tomatoes grow best in warm sunny gardens with daily water."), ("short", "a b", text), ("null", None, text), ("blank", " ", text)], "pair_id string, source string, candidate string")
    got = {r.pair_id: r for r in pairwise.analyze(pairs).collect()}
    assert got["same"].score == 1.0 and got["same"].coverage == 1.0 and len(got["same"].evidence) == 2
    first = got["same"].evidence[0]
    assert first.match_type == "exact" and text[first.candidate_start : first.candidate_end] == first.candidate_text
    assert got["other"].score < 0.2 and got["other"].verdict == "low_overlap" and not got["other"].evidence
    assert set(got) == {"same", "other"}
    errors = {r.pair_id: r.error for r in pairwise.analyze_all(pairs).collect()}
    assert "3 words" in errors["short"] and "strings" in errors["null"] and "empty" in errors["blank"]
    with pytest.raises(Exception, match="3 words"):
        pairwise.analyze(pairs.where("pair_id = 'short'"), strict=True).collect()
    with pytest.raises(ValueError):
        pairwise.Config(review_threshold=0.7)


def test_embedded_sentence_is_found(spark):
    copied = "The careful engine compares every passage with its source text."
    pairs = spark.createDataFrame([("p", f"Intro words come first here. {copied} Closing words follow then.", f"Nothing alike stands in front of it. {copied} Other things end the page.")], "pair_id string, source string, candidate string")
    r = pairwise.analyze(pairs).first()
    assert r.evidence[0].match_type == "exact" and r.evidence[0].candidate_text == copied and r.verdict != "low_overlap"


def test_scores_equal_a_plain_model():
    """Counters instead of sorted codes, on random text with letters of several scripts."""
    rng = random.Random(3)
    letters = "abcdeéß漢字ſıİ "
    text = lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(4, 30))) + rng.choice([".", "!", "", "\n"])

    def cosine(a, b):
        dot = sum(n * b[k] for k, n in a.items())
        return dot / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))) if a and b else 0.0

    def grams(w):
        return Counter([f"w:{x}" for x in w] + [f"b:{x}_{y}" for x, y in zip(w, w[1:], strict=False)])

    def runs(t):
        flat = re.sub(r"[^\w]+", " ", features.normal(t))
        return Counter((n, flat[i : i + n]) for n in (3, 4, 5) for i in range(len(flat) - n + 1))

    for _ in range(60):
        s, c = text() + text(), text() + text()
        ws, wc = features.words(s), features.words(c)
        long_s, long_c = (Counter(x for x in w if len(x) > 2) for w in (ws, wc))
        share = sum((long_s & long_c).values()) / sum(long_c.values()) if long_c else 0.0
        assert pairwise.whole_similarities(s, c) == pytest.approx((cosine(grams(ws), grams(wc)), cosine(runs(s), runs(c)), share))


def test_long_segments_become_windows():
    text = " ".join(f"w{i}" for i in range(200))
    got = features.segments(text)
    assert [len(s.words) for s in got] == [80, 80, 80, 80] and all(text[s.start : s.end] == s.text for s in got) and got[-1].words[-1] == "w199"
    assert [s.text for s in features.segments("one two. three")] == ["one two. three"] and features.segments(" .!? ") == []


def test_chunks_of_thirty_tokens(spark):
    text = " ".join(f"token{i}" for i in range(30))
    rows = sorted((r.start, r.end) for r in segments.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), max_tokens=10, overlap=2).collect())
    assert len(rows) == 4 and text[rows[1][0] :].startswith("token8 ") and rows[-1][1] == len(text)


def test_rate_limit_counts_accepted_only(spark):
    e = spark.createDataFrame([(i, 1, float(t)) for i, t in enumerate((0, 1, 2, 11))], "event_id long, user_id long, t double")
    assert [r.allowed for r in corpus.rate_limit(e, "user_id", "t", "event_id", 2, 10).orderBy("event_id").collect()] == [True, True, False, True]


def test_average_precision_of_three(spark):
    s = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 0), ("c", 0.7, 1)], "pair_id string, score double, label long")
    assert evaluation.average_precision(s).first()[0] == pytest.approx(0.833333)


def test_touching_intervals_merge(spark):
    i = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10)], "k long, start long, end long")
    assert sorted((r.start, r.end) for r in evaluation.merge_intervals(i, ["k"]).collect()) == [(0, 7), (9, 10)]


def test_suite_and_embedder(spark):
    rows = spark.createDataFrame([(1, "One two three four. Five six seven eight nine!"), (2, "too short"), (3, None)], "id long, text string")
    made = {r.category: r for r in adversarial.suite(rows, "id").collect()}
    assert len(made) == 5 and made["sentence_reorder"].candidate == "Five six seven eight nine! One two three four."
    assert made["filler_insertion"].candidate_end == len(made["filler_insertion"].candidate) and made["case_change"].source_end == len(made["case_change"].source)
    v = {r.id: r.v for r in rows.select("id", embedding.encoder(embedding.HashingEmbedder(32))(rows.text).alias("v")).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1.0) and v[3] is None
    e, text = embedding.HashingEmbedder(16), "Ab-cd é"
    plain = [0.0] * 16
    flat = "ab cd é"
    for n in (3, 4, 5):
        for i in range(len(flat) - n + 1):
            plain[int.from_bytes(hashlib.blake2b(flat[i : i + n].encode(), digest_size=8).digest(), "big") % 16] += 1
    assert e.vectors([text, ""]).tolist() == [plain, [0.0] * 16]


def test_every_passage_has_a_rank(spark):
    p = spark.createDataFrame([(1, "cars and roads"), (2, None), (3, "a garden"), (4, "machine learning of cars")], "passage_id long, text string")
    q = spark.createDataFrame([(7, "cars cars"), (8, "")], "query_id long, text string")
    got = [(r.query, r["rank"], r.passage) for r in retrieval.bm25(q, p, "query_id", "passage_id", 3).orderBy("query", "rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 4), (7, 3, 2), (8, 1, 1), (8, 2, 2), (8, 3, 3)]


def test_fused_ranks_equal_full_rankings(spark):
    """Exact fused ranks against a table of all queries and passages, with few candidates kept."""
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 20)))) for i in range(300)]
    asked = [(i, " ".join(rng.choice(vocabulary, 6))) for i in range(5)]
    p, q = spark.createDataFrame(rows, "passage_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    found = retrieval.HybridRetriever(embedding.HashingEmbedder(64), lexical_weight=1.0, dense_weight=0.5, rrf_constant=5)
    got = found.search(found.index(p), q, top_k=8, candidate_k=8).collect()
    e = embedding.HashingEmbedder(64)
    vectors = e.encode([t for _, t in rows])
    lexical = {(r.query, r.passage): r["rank"] for r in retrieval.bm25(q, p, "query_id", "passage_id", 300).collect()}
    assert len(lexical) == 1500
    for i, text in asked:
        score = np.rint(vectors @ e.encode([text])[0] * 1e6)
        dense = {k: n + 1 for n, k in enumerate(sorted(range(300), key=lambda k: (-score[k], k)))}
        fused = sorted((-round((1 / (lexical[i, k] + 5) + 0.5 / (dense[k] + 5)) * 1e9), k) for k in range(300))[:8]
        mine = sorted((r["rank"], r.passage, r.lexical_rank, r.dense_rank) for r in got if r.query == i)
        assert mine == [(n + 1, k, lexical[i, k], dense[k]) for n, (_, k) in enumerate(fused)]
    assert got[0].method == "bm25+hashing-ngram-64"


def test_reranker_orders_the_head(spark):
    class Reverse:
        name = "reverse"

        def score(self, query, passages):
            return [float(p.split()[-1]) for p in passages]

    p = spark.createDataFrame([(i, f"cars number {i}") for i in range(6)], "passage_id long, text string")
    q = spark.createDataFrame([(1, "cars")], "query_id long, text string")
    found = retrieval.HybridRetriever(reranker=Reverse())
    got = found.search(found.index(p), q, top_k=3, candidate_k=6, passages=p).orderBy("rank").collect()
    assert [r.passage for r in got] == [5, 4, 3] and got[0].score == 5.0 and got[0].method == "bm25+reverse"
    with pytest.raises(ValueError):
        found.search(found.index(p), q, top_k=0)
    with pytest.raises(ValueError):
        found.index(p.union(p))


def test_dense_search_checks_dimensions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "passage long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, q array<double>")
    assert [(r.passage, r.score) for r in retrieval.dense_topk(q, v, 3).orderBy("rank").collect()] == [(3, 0.707107), (2, 0.0), (4, 0.0)]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.dense_topk(q, spark.createDataFrame([(1, [1.0])], "passage long, v array<double>"), 1).collect()


def test_thresholds_and_fingerprints(spark):
    s = spark.createDataFrame([(str(i), x, y) for i, (x, y) in enumerate([(0.29, 0), (0.57, 0), (0.58, 1), (0.9, 1)])], "pair_id string, score double, label long")
    assert evaluation.choose_threshold(s).first().threshold == 0.58 and evaluation.choose_threshold_grid(s).first().threshold == 0.58
    none = s.withColumn("label", s.label * 0)
    assert evaluation.choose_threshold(none).first().threshold == math.nextafter(0.9, math.inf)
    rows = spark.createDataFrame([(None, "p", "q"), ("p", None, "q"), ("p", "q", None)], "a string, b string, c string")
    assert len({evaluation.table_fingerprint(rows.limit(3).where(w), ["a", "b", "c"]).first().fingerprint for w in ("a is null", "b is null", "c is null")}) == 3


def test_dedupe_upsert_and_violations(spark):
    d = spark.createDataFrame([(1, "t", None), (2, None, "x"), (3, "t", "x"), (4, "t", "x"), (5, "u", "x")], "id long, tenant string, text string")
    assert {r.id: r.canonical_id for r in corpus.dedupe(d, "tenant", "id").collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    t = spark.createDataFrame([(1, "a", "h")], "k long, v string, sha string")
    c = spark.createDataFrame([(1, "b", "i"), (1, "c", "j"), (2, "d", "k")], "k long, v string, sha string")
    assert sorted(map(tuple, corpus.upsert(t, c, ["k"], keep=["sha"]).collect())) == [(1, "c", "h"), (2, "d", "k")]
    assert corpus.violations(spark.createDataFrame([(1,), (None,), (9,)], "k long"), t.select("k"), ["k"]).collect() == [(9,)]
    with pytest.raises(Exception, match="without a document"):
        corpus.replace_children(c, c, ["k"], t).collect()
    with pytest.raises(Exception, match="another workspace"):
        corpus.Tenant("t", "tenant").checked(d).collect()


def test_limiter_of_text_identities(spark):
    e = spark.createDataFrame([(i, w, float(t)) for i, (w, t) in enumerate([("a", 0), ("a", 1), ("a", 2), ("b", 2), (None, 3), ("a", 10)])], "n long, who string, t double")
    assert [r.allowed for r in corpus.rate_limit(e, "who", "t", "n", 2, 10).orderBy("n").collect()] == [True, True, False, True, True, True]


def test_jobs_and_feedback(spark):
    none = ingest.CorpusTables(spark.createDataFrame([], "workspace_id string, document_id long, content_sha256 string, filename string, character_count long, status string"), spark.createDataFrame([], "workspace_id string, document_id long, passage_id string, start long, end long"))
    text = " ".join(f"token{i}" for i in range(12))
    up = spark.createDataFrame([("w", 1, "a.txt", text.encode()), ("w", 2, "b.txt", text.encode()), ("v", 3, "c.txt", text.encode()), ("w", 4, "d.exe", b"x"), ("w", 5, "e.txt", None)], "workspace_id string, job_id long, filename string, content binary")
    tables, log = ingest.run_jobs(none, up, 8, 2)
    assert ingest.JobLog(log).get("w", 4).first().status == "failed" and ingest.JobLog(log).get("v", 4).isEmpty()
    state = {r.job_id: (r.status, r.document_id, r.error_code) for r in ingest.JobLog(log).state().collect()}
    assert state == {1: ("ready", "1", None), 2: ("ready", "1", None), 3: ("ready", "3", None), 4: ("failed", None, "document_extraction_failed"), 5: ("failed", None, "document_extraction_failed")}
    assert tables.documents.count() == 2 and tables.passages.where("workspace_id = 'w'").count() == 2
    again, told = tables.ingest(spark.createDataFrame([("w", 8, "a.txt", text)], "workspace_id string, document_id long, filename string, text string"))
    assert tuple(told.first()) == ("w", 8, 1, True, 0) and again.documents.count() == 2
    f = spark.createDataFrame([("w", 1, "dismissed")], "workspace_id string, feedback_id long, decision string")
    with pytest.raises(Exception, match="feedback exists"):
        ingest.add_feedback(f, f).collect()
    with pytest.raises(Exception, match="no such job"):
        ingest.JobLog(log).update(spark.createDataFrame([("w", 77, "ready", "1", None, 3)], "workspace_id string, job_id long, status string, document_id string, error_code string, step int")).state().collect()


def test_api_keys(spark):
    keys = spark.createDataFrame([("k" * 20, "w")], "api_key string, workspace_id string")
    asked = spark.createDataFrame([(1, "k" * 20), (2, "x"), (3, None)], "id long, api_key string")
    assert {r.id: r.workspace_id for r in validation.KeyTable(keys).authenticate(asked).collect()} == {1: "w", 2: None, 3: None}
    with pytest.raises(Exception, match="20 characters"):
        validation.KeyTable(keys.selectExpr("'short' as api_key", "workspace_id")).authenticate(asked).collect()


def test_benchmark_refuses_bad_tables(spark):
    p = spark.createDataFrame([(str(i), f"g{i % 4}", f"source words number {i}", f"source words number {i if i % 2 else 99}", i % 2, "c") for i in range(12)], "pair_id string, group_id string, source string, candidate string, label int, category string")
    rows = benchmark.run_benchmark(p, [benchmark.AnalyzerScorer(), benchmark.EmbeddingScorer()], calibration_fraction=0.5).collect()
    assert {r.model for r in rows} == {"pairwise_tfidf_style_v2", "cosine:hashing-ngram-256"} and all(0 <= r.f1 <= 1 for r in rows)
    for bad in (lambda: benchmark.run_benchmark(p, []), lambda: benchmark.run_benchmark(p.union(p), [benchmark.LexicalScorer()]), lambda: benchmark.run_benchmark(p.withColumn("label", p.label + 5), [benchmark.LexicalScorer()]), lambda: benchmark.run_benchmark(p, [benchmark.LexicalScorer()], calibration_fraction=0.95)):
        with pytest.raises(ValueError):
            bad()
    split = benchmark.shuffled_split(p, "group_id")
    names = sorted({r.group_id for r in p.collect()})
    random.Random(42).shuffle(names)
    assert {r.group_id for r in split.where("partition = 'test'").collect()} == {names[0]}


def test_code_is_normalised():
    a, b = "def f(x, y):\n    total = x + y\n    return total", "def g(a, b):\n    s = a + b\n    return s"
    assert legacy.normalised_code(a) == legacy.normalised_code(b) and legacy.normalised_code("class {") == "class {"


def test_artifacts_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"alpha beta w{i % 3}", i % 2) for i in range(8)], "id long, clean string, label int")
    model = legacy.tfidf(50).fit(rows)
    split = spark.createDataFrame([("train", 1), ("test", 2)], "partition string, index long")
    legacy.save_artifacts(str(tmp_path / "a"), model, rows, split)
    again, back, parts = legacy.load_artifacts(spark, str(tmp_path / "a"))
    key = lambda m: [str(r.features) for r in m.transform(rows).orderBy("id").collect()]
    assert key(again) == key(model) and back.count() == 8 and sorted(map(tuple, parts.collect())) == [("test", 2), ("train", 1)]


def test_optional_models_load_late():
    import pickle

    e, r = embedding.TransformerEmbedder("some-model", 8), embedding.TransformerReranker("other-model")
    assert pickle.loads(pickle.dumps(e)).name == "some-model" and pickle.loads(pickle.dumps(r)).name == "other-model"
    if importlib.util.find_spec("sentence_transformers") is None:
        with pytest.raises(ModuleNotFoundError):
            e.vectors(["text"])


def test_most_similar_code(spark):
    s = spark.createDataFrame([("def f(x):\n    return x + 1",), ("print('other')",), (None,)], "code string")
    assert legacy.most_similar_code("def g(y):\n    return y + 1", s).first().is_copy


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "n long, who string, t double, kind string"
    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("one", [(0, "a", 0.0, "x"), (1, "a", 1.0, "y")])
    put("two", [(2, "a", 2.0, "x"), (3, "b", 2.0, "x"), (4, "a", 11.0, "x")])
    def run(make, mode, name):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()
    allowed = {r.n: r.allowed for r in run(lambda s: events.limited(s, "who", "t", "n", 2, 10.0), "append", "limited")}
    assert allowed == {0: True, 1: True, 2: False, 3: True, 4: True}
    assert {(r.kind, r.n) for r in run(lambda s: events.counts(s, "kind"), "complete", "counted")} == {("x", 4), ("y", 1)}


def test_approximate_neighbours_equal_the_pairs_that_share_a_bucket_and_join_nothing(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    monkeypatch.setattr(legacy, "NEIGHBOUR_BLOCK", 7, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) if i % 9 else np.ones(8)).tolist()) for i in range(90)] + [(5, [0.0] * 8), (9, [1.0] * 8)]
    v = spark.createDataFrame(rows, "passage long, v array<double>")
    q = v.where("passage % 5 = 0").select(F.col("passage").alias("query"), F.col("v").alias("q"))
    got = legacy.cosine_neighbours(v, q, 4, 0.1, 2)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan
    unit = Normalizer(inputCol="raw", outputCol="unit")
    a, b = unit.transform(v.withColumn("raw", array_to_vector("v"))), unit.transform(q.withColumn("raw", array_to_vector("q")))
    met = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=0.1, numHashTables=2, seed=7).fit(a).approxSimilarityJoin(b, a, 2.0, distCol="d")
    best = {}
    for x, y, d in met.select("datasetA.query", "datasetB.passage", "d").collect():
        if x != y:
            best.setdefault(x, set()).add((-round((1 - d * d / 2) * 1e6) / 1e6, y))
    expected = {(x, y, -s, i) for x, found in best.items() for i, (s, y) in enumerate(sorted(found)[:4], 1)}
    assert 0 < len(expected) and {tuple(r) for r in got.collect()} == expected


def test_job_log_is_made_without_cutting_passages(spark):
    rows = spark.createDataFrame([("w", 1, "a.txt", b"some words here"), ("w", 2, "b.txt", b"some words here"), ("w", 3, "c.bin", b"x"), ("v", 4, "d.txt", None)], "workspace_id string, job_id long, filename string, content binary")
    none = ingest.CorpusTables(spark.createDataFrame([], "workspace_id string, document_id long, content_sha256 string, filename string, character_count long, status string"), spark.createDataFrame([], "workspace_id string, document_id long, passage_id string, start long, end long"))
    tables, log = ingest.run_jobs(none, rows)
    plan = log._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    assert {(r.job_id, r.status, r.document_id, r.error_code) for r in ingest.JobLog(log).state().collect()} == {(1, "ready", "1", None), (2, "ready", "1", None), (3, "failed", None, "document_extraction_failed"), (4, "failed", None, "document_extraction_failed")}
    assert tables.passages.count() == 1


def test_embedding_holds_little_memory_and_hashes_a_run_once(spark, monkeypatch):
    import tracemalloc

    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 9))) for _ in range(120_000))
    one = embedding.HashingEmbedder(64, "md5")
    tracemalloc.start()
    got = one.vectors([text, "", "ab", text[:50]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    flat = " ".join(embedding.terms(text))
    runs = Counter(flat[i : i + n] for n in (3, 4, 5) for i in range(len(flat) - n + 1))
    expected = np.zeros(64)
    for r, n in runs.items():
        expected[int(hashlib.md5(r.encode()).hexdigest()[:8], 16) % 64] += n
    assert (got[0] == expected).all() and not got[1].any() and not got[2].any() and (got[3] == one.vectors([text[:50]])[0]).all()
    with monkeypatch.context() as m:
        m.setattr(embedding._memo(64, "md5"), "number", lambda raw: 1 / 0)
        assert (one.vectors([text[:50]])[0] == got[3]).all()
    found = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "i long, t string").select("i", embedding.encoder(one)(F.col("t")).alias("v")).orderBy("i").collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    assert found[0].v == one.encode(["some words"])[0].tolist() and found[1].v is None and found[2].v == [0.0] * 64


def test_shared_terms_of_a_block_take_bounded_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = [" ".join(vocabulary[:100]) + f" w{100 + i % 20}" for i in range(64)]
    block = retrieval.QueryBlock.of(list(range(64)), texts, None)
    block.idf, block.mean = rng.random(len(block.keys)), 90.0
    docs = [sorted(retrieval.term_hash(w) for w in vocabulary if rng.random() < 0.9) for _ in range(512)]
    counts = [rng.integers(1, 9, len(d)).astype(np.int32) for d in docs]
    batch = pa.RecordBatch.from_arrays([pa.array([len(d) for d in docs], pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))], names=["len", "terms", "counts"])
    tracemalloc.start()
    got = block.lexical(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    monkeypatch.setattr(retrieval, "EXPANDED", 50, raising=False)
    for shared in (1, 1000):
        monkeypatch.setattr(retrieval, "SHARED_BY", shared, raising=False)
        assert (block.lexical(batch) == got).all()
    idf = dict(zip(block.keys.tolist(), block.idf.tolist(), strict=True))
    for d in (0, 300):
        for q in (0, 63):
            own = {retrieval.term_hash(w) for w in texts[q].split()}
            assert abs(sum(idf[t] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(docs[d]) / 90.0)) for t, n in zip(docs[d], counts[d].tolist(), strict=True) if t in own) * 1e6 - got[d, q]) < 0.51


def test_character_runs_equal_a_plain_count_and_sort_plain_numbers(monkeypatch):
    rng = random.Random(8)
    texts = ["", "a", "ab  c", "x" * 500, " ".join(rng.choice(["Ähre", "der", "die", "es"]) for _ in range(400)), "漢字" * 40 + "".join(chr(0x4E00 + i) for i in range(9000)) * 2]
    for text in texts:
        if text.isascii() or "Ä" in text:
            monkeypatch.setattr(np, "unique", lambda *a, **b: 1 / 0)
        got = features.top_character_runs(text, 5)
        monkeypatch.undo()
        flat = features.SIGNS.sub(" ", features.normal(text))
        runs = Counter(flat[i : i + n] for n in (3, 4, 5) for i in range(len(flat) - n + 1))
        best = sorted((-n, len(g), g) for g, n in runs.items())[:5]
        assert got == (len(runs), sum(n * n for n in runs.values()), [(g, -n) for n, _, g in best])


def test_classifiers_clean_each_text_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def clean(t):
        seen.add(1)
        return t

    slow = F.udf(clean, "string")
    rows = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text number w{i % 3}", float(i % 2)) for i in range(40)], "i long, t string, label double").select("i", slow("t").alias("clean"), "label")
    got = legacy.classifier_metrics(rows.where("i % 5 < 4"), rows.where("i % 5 = 4"), 20, 3).collect()
    assert len(got) == 4 and seen.value == 40 and all(r.accuracy == 1.0 for r in got if r.model in ("naive_bayes", "linear_svc"))
