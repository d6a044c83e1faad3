"""DuckDB SQL for the registered queries; it shares constants with the engine, no code."""

FOLD = "lower(replace(text, 'ß', 'ss'))"
TERMS = rf"regexp_extract_all({FOLD}, '[\p{{L}}\p{{N}}]+')"
WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*')"
NORMAL = rf"trim(regexp_replace({FOLD}, '\s+', ' ', 'g'))"
R = "round_even(CAST({} AS DOUBLE) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE"
R4 = "round_even(CAST({} AS DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE"

SCORED = f"""scored AS (SELECT doc_id AS pair_id, source AS "group", lang AS category, CAST(quality AS BIGINT) AS label,
  CASE WHEN len(t) > 0 THEN {R4.format("CAST(len(list_distinct(t)) AS DOUBLE) / len(t)")} ELSE 0.0 END AS score
  FROM (SELECT doc_id, source, lang, {TERMS} AS t FROM documents) JOIN labels USING (doc_id))"""


def _prf(tp: str, fp: str, fn: str) -> str:
    p = f"(CASE WHEN ({tp}) + ({fp}) > 0 THEN CAST({tp} AS DOUBLE) / (({tp}) + ({fp})) ELSE 0.0 END)"
    r = f"(CASE WHEN ({tp}) + ({fn}) > 0 THEN CAST({tp} AS DOUBLE) / (({tp}) + ({fn})) ELSE 0.0 END)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return f"{R4.format(p)} AS precision, {R4.format(r)} AS recall, {R4.format(f)} AS f1"


def _confusion(key: str = "") -> str:
    by = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""WITH {SCORED}, c AS (SELECT {by} count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
 count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored {group})
SELECT {by} tp, fp, tn, fn, {_prf("tp", "fp", "fn")}, {R4.format("CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn)")} AS accuracy FROM c"""


def _bm25(k: int, full: bool = True) -> str:
    """Full rankings: every passage has a rank, those of score 0 too."""
    return f"""dt AS MATERIALIZED (SELECT doc_id AS passage, {TERMS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM dt),
tf AS (SELECT passage, l, term, count(*) AS tf FROM (SELECT passage, len(t) AS l, unnest(t) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT item_id AS query, unnest(list_distinct({TERMS})) AS term FROM benchmark),
sc AS (SELECT query, passage, {R.format("sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / greatest(a, 1.0::DOUBLE))))")} AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
al AS (SELECT item_id AS query, dt.passage, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN dt LEFT JOIN sc ON sc.query = item_id AND sc.passage = dt.passage),
bm AS (SELECT query, passage, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM al QUALIFY rank <= {k})"""


#: Counts of hashed character runs (md5) of a table with id and text, by bucket.
def _buckets(name: str, table: str, key: str) -> str:
    three, four, five = (f"list_transform(range(1, length(f) - {n - 2}), lambda i: substring(f, CAST(i AS INTEGER), {n}))" for n in (3, 4, 5))
    runs = f"list_concat(list_concat({three}, {four}), {five})"
    return f"""{name} AS MATERIALIZED (SELECT k, b, count(*) AS c FROM (SELECT k, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 256 AS b FROM (SELECT k, unnest({runs}) AS g FROM (SELECT {key} AS k, array_to_string({TERMS}, ' ') AS f FROM {table}))) GROUP BY ALL)"""


_HYBRID = f"""{_bm25(1 << 40)}, {_buckets("db", "documents", "doc_id")}, {_buckets("qb", "benchmark", "item_id")},
dn AS (SELECT k, sqrt(sum(c * c)) AS n FROM db GROUP BY k), qn AS (SELECT k, sqrt(sum(c * c)) AS n FROM qb GROUP BY k),
dp AS (SELECT q.k AS query, d.k AS passage, sum(q.c * d.c) AS dot FROM qb q JOIN db d USING (b) GROUP BY ALL),
ds AS (SELECT bm.query, bm.passage, bm.rank AS lexical_rank, row_number() OVER (PARTITION BY bm.query ORDER BY {R.format("coalesce(dot / (dn.n * qn.n), 0.0)")} DESC, bm.passage) AS dense_rank
 FROM bm LEFT JOIN dp ON dp.query = bm.query AND dp.passage = bm.passage LEFT JOIN dn ON dn.k = bm.passage LEFT JOIN qn ON qn.k = bm.query),
fu AS (SELECT *, round_even((1.0::DOUBLE / (lexical_rank + 60) + 1.0::DOUBLE / (dense_rank + 60)) * 1000000000.0::DOUBLE, 0) / 1000000000.0::DOUBLE AS score FROM ds),
hy AS (SELECT query, passage, lexical_rank, dense_rank, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM fu QUALIFY rank <= 50)"""


def _top(grams: str, order: str) -> str:
    return f"""WITH g AS (SELECT doc_id, unnest({grams}) AS feature FROM (SELECT doc_id, {WORDS.format(NORMAL)} AS w, regexp_replace({NORMAL}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') AS f FROM documents)),
c AS (SELECT doc_id, feature, count(*) AS cnt FROM g GROUP BY ALL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, {order}feature) AS INTEGER) AS rank, count(*) OVER (PARTITION BY doc_id) AS n_distinct, CAST(sum(cnt * cnt) OVER (PARTITION BY doc_id) AS BIGINT) AS sum_squares FROM c)
SELECT doc_id, rank, feature, cnt, n_distinct, sum_squares FROM t WHERE rank <= 5"""


def _windows(name: str, key: str, size: int, step: int) -> str:
    return rf"""{name} AS (SELECT {key}, start, "end" FROM (SELECT {key}, start, i, count(*) OVER (PARTITION BY {key}) AS n,
 coalesce(lead(e, {size - 1}) OVER (PARTITION BY {key} ORDER BY i), max(e) OVER (PARTITION BY {key})) AS "end"
 FROM (SELECT {key}, start, start + length(tile) AS e, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS i FROM tiles WHERE regexp_matches(tile, '^[\p{{L}}\p{{N}}]')))
 WHERE i % {step} = 0 AND (i = 0 OR i - {step} + {size} < n))"""


def _tiles(key: str, table: str, pattern: str) -> str:
    return f"""tiles AS (SELECT {key}, pos, tile, CAST(coalesce(sum(length(tile)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
 FROM (SELECT {key}, unnest(t) AS tile, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, regexp_extract_all(text, '{pattern}') AS t FROM {table})))"""


_TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
_SEGMENTS = "(?m)[^\\n.!?]+(?:[.!?]+|$)|[^\\n]+|\\n"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_N = "CAST(len(" + WORDS.format(NORMAL.replace("text", "seg")) + ") AS BIGINT)"
_IV = "iv AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value) AS BIGINT) % 7200 AS e, event_type FROM events)"


def _merged(name: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT user_id, s, e, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM iv WHERE {where})) GROUP BY user_id, island)"""


_BY_THRESHOLD = f"""{SCORED}, per AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score),
run AS (SELECT score AS threshold, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS total FROM per),
every AS (SELECT threshold, tp, fp, total FROM run UNION ALL SELECT nextafter(max(threshold), CAST('infinity' AS DOUBLE)), 0, 0, max(total) FROM run),
th AS (SELECT threshold, tp, fp, total - tp AS fn, {_prf("tp", "fp", "total - tp")} FROM every)"""
_SPLIT = f"""{SCORED}, g AS (SELECT "group", row_number() OVER (ORDER BY sha256('42:' || "group"), "group") AS r, count(*) OVER () AS n FROM (SELECT DISTINCT "group" FROM scored)),
sp AS (SELECT scored.*, CASE WHEN r <= least(n - 1, greatest(1, round_even(n * 0.75, 0))) THEN 'calibration' ELSE 'test' END AS partition FROM scored JOIN g USING ("group"))"""


def norm_of(text: str) -> str:
    return NORMAL.replace("text", text)


_WORD_TILE = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*|[^\p{L}\p{N}]+"
_LONG = "list_filter({}, lambda x: length(x) > 2)"
_WORD_GRAMS = "list_concat(list_transform({0}, lambda x: 'w:' || x), list_transform(range(1, len({0})), lambda i: 'b:' || {0}[i] || '_' || {0}[i + 1]))"


def _flat(text: str) -> str:
    return rf"regexp_replace({norm_of(text)}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')"


def _runs(f: str) -> str:
    """Character runs of a column; of an expression, every lambda would compute it anew."""
    three, four, five = (f"list_transform(range(1, length({f}) - {n - 2}), lambda i: substring({f}, CAST(i AS INTEGER), {n}))" for n in (3, 4, 5))
    return f"list_concat(list_concat({three}, {four}), {five})"


def _counts(name: str, table: str, key: str, grams: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {key}, g, count(*) AS c FROM (SELECT {key}, unnest({grams}) AS g FROM {table}) GROUP BY ALL), {name}_n AS (SELECT {key}, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n, sum(c) AS total FROM {name} GROUP BY {key})"


def _cosine(name: str, a: str, b: str, a_key: str, b_key: str) -> str:
    """Of the count tables a and b: joined by the gram, so only combinations with a common gram have a row."""
    of = lambda t, keys: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    return f"""{name} AS MATERIALIZED (SELECT {a_key}, {b_key}, CAST(dot AS DOUBLE) / (x.n * y.n) AS v FROM (SELECT p.pair_id, {of("a", a_key)}, {of("b", b_key)}, sum(a.c * b.c) AS dot FROM pr p JOIN {a} a ON a.query = p.query JOIN {b} b ON b.passage = p.passage AND a.g = b.g GROUP BY ALL) JOIN {a}_n x USING ({a_key}) JOIN {b}_n y USING ({b_key}))"""


def _segments(name: str, table: str, key: str) -> str:
    """(key, start, end, seg, w) of the segments of a table (key, text), windows for those of over 80 words."""
    return rf"""{name}_t AS (SELECT {key}, tile, pos, coalesce(sum(length(tile)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (SELECT {key}, unnest(t) AS tile, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, regexp_extract_all(text, '{_SEGMENTS}') AS t FROM {table}))),
{name}_k AS MATERIALIZED (SELECT {key}, CAST(st + length(tile) - length(regexp_replace(tile, '^\s+', '')) AS BIGINT) AS st, {_STRIP.format("tile")} AS seg, {WORDS.format(norm_of(_STRIP.format("tile")))} AS w FROM {name}_t WHERE tile <> chr(10) AND len(w) >= 4),
{name}_l AS (SELECT {key}, st, seg, w, tile, pos, coalesce(sum(length(tile)) OVER (PARTITION BY {key}, st ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT {key}, st, seg, w, unnest(t) AS tile, generate_subscripts(t, 1) AS pos FROM (SELECT *, regexp_extract_all(seg, '{_WORD_TILE}') AS t FROM {name}_k WHERE len(w) > 80))),
{name}_w AS (SELECT {key}, st, seg, w, s, i, n, coalesce(lead(e, 79) OVER (PARTITION BY {key}, st ORDER BY i), max(e) OVER (PARTITION BY {key}, st)) AS e FROM (SELECT {key}, st, seg, w, s, s + length(tile) AS e, row_number() OVER (PARTITION BY {key}, st ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY {key}, st) AS n FROM {name}_l WHERE regexp_matches(tile, '^[\p{{L}}\p{{N}}]'))),
{name} AS MATERIALIZED (SELECT {key}, st AS "start", st + length(seg) AS "end", seg, w FROM {name}_k WHERE len(w) <= 80
 UNION ALL SELECT {key}, CAST(st + s AS BIGINT), CAST(st + e AS BIGINT), substring(seg, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), list_slice(w, i + 1, i + 80) FROM {name}_w WHERE i % 40 = 0 AND (i = 0 OR i - 40 + 80 < n)
 UNION ALL SELECT {key}, length(text) - length(regexp_replace(text, '^\s+', '')), length(text) - length(regexp_replace(text, '^\s+', '')) + length({_STRIP.format("text")}), {_STRIP.format("text")}, {WORDS.format(NORMAL)} FROM {table} WHERE {key} NOT IN (SELECT {key} FROM {name}_k) AND len({WORDS.format(NORMAL)}) > 0)"""


_PAIRS = f"""{_bm25(3)}, pr AS MATERIALIZED (SELECT query || '-' || passage AS pair_id, query, passage FROM bm),
src AS MATERIALIZED (SELECT item_id AS query, text FROM benchmark WHERE item_id IN (SELECT query FROM pr)), cnd AS MATERIALIZED (SELECT doc_id AS passage, text FROM documents WHERE doc_id IN (SELECT passage FROM pr))"""
_WHOLE = f"""{_counts("sw", f"(SELECT query, {WORDS.format(NORMAL)} AS w FROM src)", "query", _WORD_GRAMS.format("w"))}, {_counts("cw", f"(SELECT passage, {WORDS.format(NORMAL)} AS w FROM cnd)", "passage", _WORD_GRAMS.format("w"))},
{_counts("sh", f"(SELECT query, {_flat('text')} AS f FROM src)", "query", _runs("f"))}, {_counts("ch", f"(SELECT passage, {_flat('text')} AS f FROM cnd)", "passage", _runs("f"))},
{_counts("sl", f"(SELECT query, {WORDS.format(NORMAL)} AS w FROM src)", "query", _LONG.format("w"))}, {_counts("cl", f"(SELECT passage, {WORDS.format(NORMAL)} AS w FROM cnd)", "passage", _LONG.format("w"))},
{_cosine("xw", "sw", "cw", "query", "passage")}, {_cosine("xh", "sh", "ch", "query", "passage")},
xl AS (SELECT query, passage, CAST(m AS DOUBLE) / total AS v FROM (SELECT p.query, p.passage, sum(least(a.c, b.c)) AS m FROM pr p JOIN sl a ON a.query = p.query JOIN cl b ON b.passage = p.passage AND a.g = b.g GROUP BY ALL) JOIN cl_n USING (passage)),
sim AS MATERIALIZED (SELECT pair_id, query, passage, coalesce(xw.v, 0.0) AS lexical, coalesce(xh.v, 0.0) AS chars, coalesce(xl.v, 0.0) AS containment FROM pr LEFT JOIN xw USING (query, passage) LEFT JOIN xh USING (query, passage) LEFT JOIN xl USING (query, passage))"""


def _seg_counts(p: str, table: str, key: str) -> str:
    k = f"{key}, {p}i"
    t = f"(SELECT *, start * 1000000 + \"end\" AS {p}i, {_flat('seg')} AS f FROM {table})"
    return f"""{_counts(p + "w", t, k, _WORD_GRAMS.format("w"))}, {_counts(p + "h", t, k, _runs("f"))}, {_counts(p + "l", t, k, _LONG.format("w"))}"""


_KEYS = "query, sgi, passage, cgi"
_SEG_SCORES = f"""{_segments("sseg", "src", "query")}, {_segments("cseg", "cnd", "passage")}, {_seg_counts("sg", "sseg", "query")}, {_seg_counts("cg", "cseg", "passage")},
{_cosine("gw", "sgw", "cgw", "query, sgi", "passage, cgi")}, {_cosine("gh", "sgh", "cgh", "query, sgi", "passage, cgi")},
gl AS (SELECT {_KEYS}, CAST(m AS DOUBLE) / total AS v FROM (SELECT p.query, sgi, p.passage, cgi, sum(least(a.c, b.c)) AS m FROM pr p JOIN sgl a ON a.query = p.query JOIN cgl b ON b.passage = p.passage AND a.g = b.g GROUP BY ALL) JOIN cgl_n USING (passage, cgi)),
ok AS MATERIALIZED (SELECT pair_id, pr.query, pr.passage FROM pr JOIN src USING (query) JOIN cnd USING (passage) WHERE len({WORDS.format(norm_of("src.text"))}) >= 3 AND len({WORDS.format(norm_of("cnd.text"))}) >= 3),
sco AS MATERIALIZED (SELECT pair_id, query, sgi, passage, cgi, greatest(0.0, least(1.0, 0.55::DOUBLE * coalesce(gw.v, 0.0) + 0.30::DOUBLE * coalesce(gh.v, 0.0) + 0.15::DOUBLE * coalesce(gl.v, 0.0))) AS score FROM gh FULL JOIN gw USING ({_KEYS}) FULL JOIN gl USING ({_KEYS}) JOIN ok USING (query, passage)),
bst AS MATERIALIZED (SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY pair_id, cgi ORDER BY score DESC, sgi) = 1 AND score >= 0.30),
mat AS MATERIALIZED (SELECT pair_id, s."start" AS source_start, s."end" AS source_end, c."start" AS candidate_start, c."end" AS candidate_end, {R4.format("score")} AS similarity,
 CASE WHEN s.w = c.w THEN 'exact' WHEN score >= 0.72 THEN 'near_verbatim' ELSE 'lexical' END AS match_type, {WORDS.format(norm_of("c.seg"))} AS cw
 FROM bst JOIN sseg s ON s.query = bst.query AND s."start" * 1000000 + s."end" = sgi JOIN cseg c ON c.passage = bst.passage AND c."start" * 1000000 + c."end" = cgi)"""
_GREEDY = """ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY similarity DESC, candidate_start, source_start) AS r FROM mat),
rec AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(r BIGINT, a BIGINT, b BIGINT)[]) AS taken FROM ord
 UNION ALL SELECT o.pair_id, o.r, CASE WHEN len(taken) < 8 AND len(list_filter(taken, lambda t: o.candidate_start < t.b AND t.a < o.candidate_end)) = 0 THEN list_append(taken, {'r': o.r, 'a': o.candidate_start, 'b': o.candidate_end}) ELSE taken END FROM rec JOIN ord o ON o.pair_id = rec.pair_id AND o.r = rec.r + 1),
sel AS (SELECT pair_id, unnest(list_transform(taken, lambda t: t.r)) AS r FROM rec QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY rec.r DESC) = 1),
evi AS MATERIALIZED (SELECT ord.*, row_number() OVER (PARTITION BY ord.pair_id ORDER BY ord.r) - 1 AS n FROM ord JOIN sel ON sel.pair_id = ord.pair_id AND sel.r = ord.r)"""
_ANALYSIS = f"""WITH RECURSIVE {_PAIRS}, {_WHOLE}, {_SEG_SCORES}, {_GREEDY},
own AS MATERIALIZED (SELECT passage, list_distinct({_LONG.format(WORDS.format(NORMAL))}) AS own FROM cnd),
hit AS MATERIALIZED (SELECT pair_id, list_distinct(flatten(list(list_filter(cw, lambda x: length(x) > 2)))) AS hit, count(*) AS n_evidence, max(similarity) AS best FROM evi GROUP BY pair_id),
res AS (SELECT sim.*, coalesce(n_evidence, 0) AS n_evidence, coalesce(best, 0.0) AS best, CASE WHEN len(own) > 0 THEN coalesce(CAST(len(hit) AS DOUBLE) / len(own), 0.0) ELSE 0.0 END AS coverage FROM sim JOIN ok USING (pair_id) JOIN own ON own.passage = sim.passage LEFT JOIN hit USING (pair_id)),
fin AS (SELECT *, greatest(0.0, least(1.0, greatest(0.68::DOUBLE * lexical + 0.32::DOUBLE * chars, 0.72::DOUBLE * best + 0.28::DOUBLE * coverage))) AS raw FROM res)
SELECT pair_id, {R4.format("raw")} AS score, CASE WHEN raw >= 0.64 THEN 'high_overlap' WHEN raw >= 0.36 THEN 'review_recommended' ELSE 'low_overlap' END AS verdict, {R4.format("lexical")} AS lexical, {R4.format("chars")} AS chars, {R4.format("containment")} AS containment, {R4.format("coverage")} AS coverage, n_evidence, 'pairwise_tfidf_style_v2' AS method FROM fin"""
_RERANK = f"""WITH {_HYBRID}, hw AS (SELECT query, passage, fu_rank, lexical_rank, dense_rank, score FROM (SELECT *, rank AS fu_rank FROM hy)),
{_counts("sw", f"(SELECT item_id AS query, {WORDS.format(NORMAL)} AS w FROM benchmark)", "query", _WORD_GRAMS.format("w"))}, {_counts("cw", f"(SELECT doc_id AS passage, {WORDS.format(NORMAL)} AS w FROM documents WHERE doc_id IN (SELECT passage FROM hy))", "passage", _WORD_GRAMS.format("w"))},
pr AS (SELECT query || '-' || passage AS pair_id, query, passage FROM hy), {_cosine("xw", "sw", "cw", "query", "passage")},
bl AS (SELECT hw.*, {R.format("coalesce(v, 0.0)")} AS again FROM hw LEFT JOIN xw USING (query, passage)),
sc2 AS (SELECT *, CASE WHEN max(score) OVER q = min(score) OVER q THEN 1.0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END AS x, CASE WHEN max(again) OVER q = min(again) OVER q THEN 1.0 ELSE (again - min(again) OVER q) / (max(again) OVER q - min(again) OVER q) END AS y FROM bl WINDOW q AS (PARTITION BY query)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {R.format("0.35::DOUBLE * x + 0.65::DOUBLE * y")} DESC, passage) AS rank FROM sc2)
SELECT query, passage, lexical_rank, dense_rank, again AS reranker_score, rank, 'bm25+hashing-ngram-256-md5+lexical' AS method FROM rk WHERE rank <= 10"""

_LABELLED = rf"""{_PAIRS}, lab AS MATERIALIZED (SELECT pair_id, sha256(trim(regexp_replace({FOLD.replace("text", "src.text")}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) AS group_id, src.text AS source, cnd.text AS candidate, CAST(contains(cnd.text, src.text) AS BIGINT) AS label, lang AS category, pr.query, pr.passage
 FROM pr JOIN src USING (query) JOIN cnd USING (passage) JOIN documents ON doc_id = pr.passage)"""
_OUTCOMES = f"""res2 AS MATERIALIZED ({_ANALYSIS})"""
_BINARY = """SELECT {0}, count(*) AS examples, count(*) FILTER (label = 1 AND verdict <> 'low_overlap') AS tp, count(*) FILTER (label = 0 AND verdict <> 'low_overlap') AS fp, count(*) FILTER (label = 0 AND verdict = 'low_overlap') AS tn, count(*) FILTER (label = 1 AND verdict = 'low_overlap') AS fn FROM oc {1}"""
_EVALUATE = f"""WITH {_LABELLED}, {_OUTCOMES}, oc AS (SELECT lab.*, verdict FROM lab JOIN res2 USING (pair_id)), b AS ({_BINARY.format("CAST(NULL AS VARCHAR) AS category", "")} UNION ALL {_BINARY.format("category", "GROUP BY category")})
SELECT category, examples, tp, fp, tn, fn, {_prf("tp", "fp", "fn")} FROM b"""
_PASSAGES = f"""WITH RECURSIVE {_LABELLED}, {_SEG_SCORES}, {_GREEDY},
p AS (SELECT pair_id, candidate_start AS s, candidate_end AS e FROM evi), t AS (SELECT pair_id, CAST(instr(candidate, source) - 1 AS BIGINT) AS s, CAST(instr(candidate, source) - 1 + length(source) AS BIGINT) AS e FROM lab JOIN ok USING (pair_id) WHERE label = 1),
n AS (SELECT (SELECT coalesce(sum(e - s), 0) FROM p) AS pc, (SELECT coalesce(sum(e - s), 0) FROM t) AS tc, (SELECT coalesce(sum(greatest(0, least(p.e, t.e) - greatest(p.s, t.s))), 0) FROM p JOIN t USING (pair_id)) AS oc)
SELECT CAST(pc AS BIGINT) AS predicted_characters, CAST(tc AS BIGINT) AS annotated_characters, CAST(oc AS BIGINT) AS overlapping_characters, {_prf("oc", "pc - oc", "tc - oc")} FROM n"""

_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
_BLOCKS = rf"""st AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format("s")}), lambda s: s <> '') AS s FROM documents),
b AS (SELECT doc_id, block, array_to_string(list_slice(s, block * 4 + 1, block * 4 + 4), ' ') AS text FROM (SELECT doc_id, s, unnest(range(0, CAST(ceil(len(s) / 4.0) AS BIGINT))) AS block FROM st))"""
_METRICS = f"""{_prf("tp", "fp", "fn")}, {R4.format("CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn)")} AS accuracy"""
_CONFUSED = "count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 0) AS tn, count(*) FILTER (score < t AND label = 1) AS fn"
_BENCHMARK = f"""WITH {_LABELLED}, {_WHOLE}, sx AS MATERIALIZED (SELECT lab.pair_id, group_id, category, label, {R.format("lexical")} AS score FROM lab JOIN sim USING (pair_id)),
g AS (SELECT group_id, row_number() OVER (ORDER BY sha256('42:' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM sx)),
sp AS MATERIALIZED (SELECT sx.*, r <= least(n - 1, greatest(1, round_even(n * 0.5, 0))) AS cal FROM sx JOIN g USING (group_id)),
ct AS (SELECT DISTINCT score AS t FROM sp WHERE cal UNION ALL SELECT nextafter(max(score), CAST('infinity' AS DOUBLE)) FROM sp WHERE cal),
cm AS (SELECT t, {_CONFUSED} FROM ct CROSS JOIN sp WHERE cal GROUP BY t), best AS (SELECT t, {_METRICS} FROM cm ORDER BY f1 DESC, precision DESC, recall DESC, t DESC LIMIT 1),
te AS (SELECT sp.*, best.t FROM sp, best WHERE NOT cal),
rk AS (SELECT label, row_number() OVER (ORDER BY score DESC, pair_id) AS r, sum(label) OVER (ORDER BY score DESC, pair_id) AS f FROM te),
ap AS (SELECT {R.format("coalesce(sum(CASE WHEN label = 1 THEN CAST(f AS DOUBLE) / r ELSE 0 END) / nullif(sum(label), 0), 0.0)")} AS ap FROM rk),
ss AS (SELECT min(score) AS min_score, max(score) AS max_score, {R.format("avg(score)")} AS mean_score FROM te),
cx AS (SELECT CAST(NULL AS VARCHAR) AS category, {_CONFUSED} FROM te UNION ALL SELECT category, {_CONFUSED} FROM te GROUP BY category)
SELECT 'lexical' AS model, (SELECT {R.format("t")} FROM best) AS threshold, category, tp, fp, tn, fn, {_METRICS}, b.precision AS calibration_precision, b.recall AS calibration_recall, b.f1 AS calibration_f1, b.accuracy AS calibration_accuracy, {R4.format("ap")} AS average_precision, min_score, max_score, mean_score FROM cx, best b, ap, ss"""

ORACLES = {
    "token_counts": f"SELECT doc_id, CAST(len({WORDS.format(NORMAL)}) AS BIGINT) AS n_words, CAST(len({TERMS}) AS BIGINT) AS n_terms FROM documents",
    "normalized_hash_groups": rf"SELECT content_key, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(trim(regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) AS content_key FROM documents) GROUP BY content_key",
    "content_dedupe": "SELECT doc_id, canonical_id, doc_id <> canonical_id AS is_duplicate FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS canonical_id FROM documents)",
    "segment_spans": f"""WITH {_tiles("doc_id", "documents", _SEGMENTS)}, s AS (SELECT doc_id, start + length(tile) - length(regexp_replace(tile, '^\\s+', '')) AS start, {_STRIP.format("tile")} AS seg FROM tiles WHERE tile <> chr(10)),
k AS (SELECT doc_id, start, start + length(seg) AS "end", {_N} AS n_tokens FROM s WHERE {_N} >= 4),
w AS (SELECT doc_id, length(text) - length(regexp_replace(text, '^\\s+', '')) AS start, {_STRIP.format("text")} AS seg FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT * FROM k UNION ALL SELECT doc_id, start, start + length(seg), {_N} FROM w WHERE {_N} > 0""",
    "chunk_spans": f"""WITH {_tiles("doc_id", "documents", _TOKENS)}, {_windows("win", "doc_id", 120, 96)} SELECT doc_id || ':' || start || ':' || "end" AS passage_id, doc_id, start, "end", sha256(substring(text, start + 1, "end" - start)) AS text_sha FROM win JOIN documents USING (doc_id)""",
    "corpus_service": f"""WITH {_tiles("doc_id", "documents", _TOKENS)}, {_windows("win", "doc_id", 120, 96)}, pas AS (SELECT doc_id * 1000000 + start AS doc_id, substring(text, start + 1, "end" - start) AS text FROM win JOIN documents USING (doc_id)),
{_bm25(5).replace("FROM documents", "FROM pas")} SELECT query, passage, rank AS lexical_rank, round_even(1.0::DOUBLE / (rank + 60) * 1000000000.0::DOUBLE, 0) / 1000000000.0::DOUBLE AS score, rank, 'bm25' AS method FROM bm""",
    "segment_windows": f"""WITH {_tiles("item_id", "benchmark", _TOKENS)}, {_windows("win", "item_id", 16, 8)} SELECT item_id, start, "end" FROM win""",
    "word_features": _top("list_concat(list_transform(w, lambda x: 'w:' || x), list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || '_' || w[i + 1]))", ""),
    "char_features": _top("list_concat(list_concat(list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3)), list_transform(range(1, length(f) - 2), lambda i: substring(f, i, 4))), list_transform(range(1, length(f) - 3), lambda i: substring(f, i, 5)))", "length(feature), "),
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TERMS})) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, {R.format(f'avg(len({TERMS}))')} AS avg_len FROM documents",
    "bm25_topk": f"WITH {_bm25(10)} SELECT query, passage, score, rank FROM bm",
    "dense_topk": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, c.vec_id AS passage, {R.format("list_cosine_similarity(q.v, c.v)")} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, passage, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM s QUALIFY rank <= 5""",
    "rrf_hybrid": f"WITH {_HYBRID} SELECT query, passage, lexical_rank, dense_rank, score, rank FROM hy WHERE rank <= 10",
    "hash_embed_md5": f"WITH {_buckets('db', 'documents', 'doc_id')} SELECT k AS doc_id, CAST(b AS INTEGER) AS bucket, {R.format('c / sqrt(sum(c * c) OVER (PARTITION BY k))')} AS weight FROM db",
    "pair_similarities": f"WITH {_PAIRS}, {_WHOLE} SELECT pair_id, {R.format('lexical')} AS lexical, {R.format('chars')} AS chars, {R.format('containment')} AS containment FROM sim",
    "segment_best_match": f"WITH {_PAIRS}, {_SEG_SCORES} SELECT pair_id, source_start, source_end, candidate_start, candidate_end, similarity, match_type FROM mat",
    "evidence_spans": f"WITH RECURSIVE {_PAIRS}, {_SEG_SCORES}, {_GREEDY} SELECT pair_id, n, source_start, source_end, candidate_start, candidate_end, similarity, match_type FROM evi",
    "retrieve_then_analyze": _ANALYSIS,
    "rerank_blend": _RERANK,
    "group_split": f"""WITH {_SPLIT} SELECT pair_id, "group", partition FROM sp""",
    "split_leakage": f"""WITH {_SPLIT}, x AS (SELECT "group", count(DISTINCT partition) AS n FROM sp GROUP BY "group") SELECT count(*) FILTER (n > 1) AS leaked_groups, count(*) AS groups FROM x""",
    "evaluate_report": _EVALUATE,
    "passage_metrics": _PASSAGES,
    "threshold_metrics": _confusion(),
    "metrics_by_category": _confusion("category"),
    "thresholds_distinct": f"WITH {_BY_THRESHOLD} SELECT threshold, tp, fp, fn, precision, recall, f1 FROM th",
    "choose_threshold_distinct": f"WITH {_BY_THRESHOLD} SELECT threshold, f1, precision, recall FROM th ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1",
    "choose_threshold_grid": f"""WITH {SCORED}, g AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (score >= t / 100.0::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= t / 100.0::DOUBLE AND label = 0) AS fp, count(*) FILTER (label = 1) AS total FROM range(15, 86) r(t), scored GROUP BY t),
th AS (SELECT threshold, {_prf("tp", "fp", "total - tp")} FROM g) SELECT threshold, f1, precision FROM th ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1""",
    "average_precision": f"""WITH {SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, pair_id) AS r, sum(label) OVER (ORDER BY score DESC, pair_id) AS f FROM scored)
SELECT {R.format("sum(CASE WHEN label = 1 THEN CAST(f AS DOUBLE) / r ELSE 0 END) / sum(label)")} AS average_precision, CAST(sum(label) AS BIGINT) AS positives FROM r""",
    "score_summary": f"WITH {SCORED} SELECT min(score) AS min_score, max(score) AS max_score, {R.format('avg(score)')} AS mean_score, quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95 FROM scored",
    "dataset_fingerprint": f"WITH {_LABELLED} SELECT sha256(string_agg(pair_id || chr(0) || group_id || chr(0) || label || chr(0) || category || chr(0) || sha256(source) || chr(0) || sha256(candidate) || chr(10), '' ORDER BY pair_id)) AS fingerprint FROM lab",
    "table_fingerprint": "WITH d AS (SELECT sha256(doc_id || chr(31) || '=' || source || chr(31) || '=' || text) AS d FROM (SELECT '=' || doc_id AS doc_id, source, text FROM documents)) SELECT sha256(concat_ws(',', " + ", ".join(f"CAST(sum(CAST(('0x' || substr(d, {1 + 15 * k}, 15)) AS BIGINT)) AS VARCHAR)" for k in range(4)) + ")) AS fingerprint, count(*) AS rows FROM d",
    "interval_merge": f"""WITH {_IV}, {_merged("m")} SELECT user_id, s AS start, e AS "end" FROM m""",
    "interval_intersection": f"""WITH {_IV}, {_merged("a", "event_type = 'click'")}, {_merged("b", "event_type = 'view'")} SELECT user_id, CAST(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS BIGINT) AS length FROM a JOIN b USING (user_id) GROUP BY user_id""",
    "adversarial_suite": rf"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS g, text AS t FROM documents WHERE n_chars <= 100000 AND len(regexp_extract_all(text, '\S+')) >= 8),
c AS (SELECT g, t, 'case_change' AS category, array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = upper(c) AND c <> 'ß' THEN lower(c) WHEN c = 'ß' THEN 'SS' ELSE upper(c) END), '') AS x FROM d
 UNION ALL SELECT g, t, 'punctuation_noise', regexp_replace(t, '\s+', ' , ', 'g') FROM d UNION ALL SELECT g, t, 'whitespace_noise', regexp_replace(t, '\s+', ' ' || chr(10) || chr(9) || ' ', 'g') FROM d
 UNION ALL SELECT g, t, 'sentence_reorder', array_to_string(list_reverse(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format("s")}), lambda s: s <> '')), ' ') FROM d
 UNION ALL SELECT g, t, 'filler_insertion', 'Context before the reused material. ' || t || ' Additional context.' FROM d)
SELECT g || ':' || category AS example_id, category, sha256(x) AS candidate_sha, length(x) AS candidate_end, length(t) AS source_end FROM c""",
    "adversarial_scores": rf"""WITH d AS (SELECT CAST(item_id AS VARCHAR) AS g, text AS t FROM benchmark WHERE len(regexp_extract_all(text, '\S+')) >= 8),
c AS (SELECT g || ':' || category AS pair_id, t, x FROM (SELECT g, t, 'case_change' AS category, array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = upper(c) AND c <> 'ß' THEN lower(c) WHEN c = 'ß' THEN 'SS' ELSE upper(c) END), '') AS x FROM d
 UNION ALL SELECT g, t, 'punctuation_noise', regexp_replace(t, '\s+', ' , ', 'g') FROM d UNION ALL SELECT g, t, 'whitespace_noise', regexp_replace(t, '\s+', ' ' || chr(10) || chr(9) || ' ', 'g') FROM d
 UNION ALL SELECT g, t, 'sentence_reorder', array_to_string(list_reverse(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format("s")}), lambda s: s <> '')), ' ') FROM d
 UNION ALL SELECT g, t, 'filler_insertion', 'Context before the reused material. ' || t || ' Additional context.' FROM d)),
{_counts("aw", f"(SELECT pair_id, {WORDS.format(norm_of('t'))} AS w FROM c)", "pair_id", _WORD_GRAMS.format("w"))}, {_counts("bw", f"(SELECT pair_id, {WORDS.format(norm_of('x'))} AS w FROM c)", "pair_id", _WORD_GRAMS.format("w"))},
dd AS (SELECT pair_id, sum(aw.c * bw.c) AS dot FROM aw JOIN bw USING (pair_id, g) GROUP BY pair_id)
SELECT c.pair_id, {R.format("coalesce(dot / (aw_n.n * bw_n.n), 0.0)")} AS lexical FROM c LEFT JOIN dd USING (pair_id) LEFT JOIN aw_n USING (pair_id) LEFT JOIN bw_n USING (pair_id)""",
    "tenant_search": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 1), s AS (SELECT q.vec_id AS query, c.vec_id AS passage, {R.format("list_cosine_similarity(q.v, c.v)")} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, passage, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank FROM s QUALIFY rank <= 5""",
    "ingest_batch": f"""WITH {_tiles("doc_id", "documents", _TOKENS)}, {_windows("win", "doc_id", 120, 96)}, n AS (SELECT doc_id, count(*) AS n FROM win GROUP BY doc_id),
h AS (SELECT source AS workspace_id, doc_id AS document_id, sha256(text) AS sha FROM documents),
o AS (SELECT workspace_id, sha, min(document_id) FILTER (document_id % 2 = 0) AS old, min(document_id) AS first FROM h GROUP BY ALL)
SELECT workspace_id, document_id, coalesce(old, first) AS stored_id, NOT (old IS NULL AND document_id = first) AS duplicate, CASE WHEN old IS NULL AND document_id = first THEN coalesce(n, 0) ELSE 0 END AS passages FROM h JOIN o USING (workspace_id, sha) LEFT JOIN n ON n.doc_id = document_id""",
    "lookup_by_hash": "SELECT doc_id, source FROM documents WHERE (source, sha256(text)) IN (SELECT (source, sha256(text)) FROM documents WHERE doc_id % 5 = 0)",
    "replace_passages": f"""WITH {_tiles("doc_id", "documents", _TOKENS)}, {_windows("w1", "doc_id", 120, 96)}, {_windows("w2", "doc_id", 60, 48)} SELECT doc_id || ':' || start || ':' || "end" AS passage_id, doc_id, start, "end" FROM (SELECT * FROM w1 WHERE doc_id % 10 <> 0 OR doc_id NOT IN (SELECT doc_id FROM w2) UNION ALL SELECT * FROM w2 WHERE doc_id % 10 = 0)""",
    "cascade_delete": f"""WITH {_tiles("doc_id", "documents", _TOKENS)}, {_windows("win", "doc_id", 120, 96)} SELECT doc_id, count(*) AS n FROM win WHERE doc_id % 9 <> 0 GROUP BY doc_id""",
    "ensure_workspaces": "SELECT source AS workspace_id, CASE WHEN count(*) FILTER (doc_id % 40 = 0) > 0 THEN 'known' END AS origin FROM documents GROUP BY source",
    "missing_parents": "SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
    "repeated_texts": "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1",
    "feedback_by_decision": "SELECT CASE event_type WHEN 'click' THEN 'accepted_match' WHEN 'view' THEN 'dismissed' WHEN 'purchase' THEN 'properly_cited' WHEN 'signup' THEN 'common_phrase' END AS decision, count(*) AS n FROM events GROUP BY 1 HAVING decision IS NOT NULL",
    "job_states": r"""WITH d AS (SELECT source AS workspace_id, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), f AS (SELECT *, doc_id % 5 = 0 OR t = '' OR length(t) > 500000 AS failed FROM d), m AS (SELECT workspace_id, t, min(doc_id) AS stored FROM f WHERE NOT failed GROUP BY ALL)
SELECT workspace_id, doc_id AS job_id, CASE WHEN failed THEN 'failed' ELSE 'ready' END AS status, CASE WHEN NOT failed THEN CAST(stored AS VARCHAR) END AS document_id, CASE WHEN failed THEN 'document_extraction_failed' END AS error_code FROM f LEFT JOIN m USING (workspace_id, t)""",
    "extract_text": r"""SELECT doc_id, CASE WHEN doc_id % 7 > 0 AND t <> '' THEN sha256(t) END AS text_sha, CASE WHEN doc_id % 7 = 0 AND length(text) = 0 THEN 'document is empty' WHEN doc_id % 7 = 0 THEN 'file extension does not match PDF content' WHEN text = '' THEN 'document is empty' WHEN t = '' THEN 'document contains no extractable text' END AS error FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
    "request_ids": r"SELECT event_id, regexp_full_match(event_type || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '-' END || user_id, '[\p{L}\p{N}._-]{1,64}') AS valid FROM events",
    "invalid_requests": r"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN NOT length(regexp_replace(substring(text, 1, 300), '^\s+|\s+$', '', 'g')) BETWEEN 3 AND 100000 THEN 'query must have 3 to 100000 characters' ELSE 'top_k must be 1 to 100' END AS error FROM documents WHERE NOT length(regexp_replace(substring(text, 1, 300), '^\s+|\s+$', '', 'g')) BETWEEN 3 AND 100000 OR NOT doc_id % 120 BETWEEN 1 AND 100""",
    "invalid_annotations": """WITH a AS (SELECT event_id, event_id % 10 - 1 AS cs, event_id % 7 AS ce, CASE WHEN event_id % 4 > 0 THEN event_id % 5 END AS ss, CASE WHEN event_id % 3 > 0 THEN event_id % 6 END AS se FROM events),
b AS (SELECT event_id, CASE WHEN cs < 0 THEN 'candidate_start must not be negative' WHEN ce <= cs THEN 'candidate interval must not be empty' WHEN (ss IS NULL) <> (se IS NULL) THEN 'source interval must be whole' WHEN se <= ss THEN 'source interval must be proper' END AS error FROM a) SELECT * FROM b WHERE error IS NOT NULL""",
    "invalid_pairs": """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, doc_id % 6 > 0 AND source <> '' AS g, trim(substring(text, 1, 20), ' ') <> '' AS s, doc_id % 9 > 0 AS c, quality + toxic IN (0, 1) AS l FROM documents JOIN labels USING (doc_id)),
b AS (SELECT pair_id, CASE WHEN NOT g THEN 'group_id must not be empty' WHEN NOT s THEN 'source must not be empty' WHEN NOT c THEN 'candidate must not be empty' WHEN NOT l THEN 'label must be 0 or 1' END AS error FROM a) SELECT * FROM b WHERE error IS NOT NULL""",
    "invalid_scores": "SELECT event_id, 'score must be finite' AS error FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0",
    "api_key_lookup": "SELECT event_id, c_nationkey AS workspace_id FROM events LEFT JOIN customer ON c_custkey = user_id",
    "dataset_totals": f"WITH {_LABELLED} SELECT count(*) AS pairs, CAST(sum(label) AS BIGINT) AS positive_pairs, CAST(sum(1 - label) AS BIGINT) AS negative_pairs, count(DISTINCT group_id) AS unique_source_groups FROM lab",
    "report_counts": f"WITH {_LABELLED}, ok AS (SELECT lab.* FROM lab WHERE len({WORDS.format(norm_of('source'))}) >= 3 AND len({WORDS.format(norm_of('candidate'))}) >= 3) SELECT count(*) AS examples, count(DISTINCT group_id) AS unique_groups, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, 'pairwise_tfidf_style_v2' AS methods FROM ok",
    "model_benchmark": _BENCHMARK,
    "score_union": f"WITH {SCORED} SELECT round_even(avg(score) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS mean, round_even(quantile_disc(score, 0.5) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS p50, round_even(quantile_disc(score, 0.95) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS p95 FROM scored",
    "stored_split": "SELECT doc_id, lang, CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'test' END AS partition FROM documents",
    "clean_text": rf"""SELECT doc_id, sha256(array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+'), lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in _STOP)})), ' ')) AS clean_sha FROM documents""",
    "sentence_blocks": rf"""WITH {_BLOCKS} SELECT doc_id, block, sha256(text) AS text_sha FROM b""",
    "chunk_verdicts": f"WITH {_BLOCKS}, p AS (SELECT doc_id, CAST(length(text) % 101 AS DOUBLE) AS p FROM b), a AS (SELECT doc_id, avg(p) AS mean, median(p) AS median, avg(CASE WHEN p >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM p GROUP BY doc_id) SELECT doc_id, {R.format('mean')} AS mean, {R.format('median')} AS median, {R.format('share')} AS share, mean >= 60 OR median >= 60 OR share >= 0.4::DOUBLE AS detected FROM a",
    "null_counts": "SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'side']) AS \"column\", unnest([count(*) FILTER (event_id IS NULL), count(*) FILTER (ts IS NULL), count(*) FILTER (user_id IS NULL), count(*) FILTER (event_type IS NULL), count(*) FILTER (value IS NULL), count(*) FILTER (props IS NULL), count(*) FILTER (user_id % 2 <> 0 OR user_id IS NULL)]) AS nulls FROM events",
    "text_size": "SELECT doc_id, length(text) AS character_count FROM documents",
    "rate_limiter": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS r FROM events),
l AS (SELECT user_id, event_id, r, true AS allowed, [t] AS held FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.event_id, e.r, len(list_filter(held, lambda x: e.t - x < 86400.0::DOUBLE)) < 2, CASE WHEN len(list_filter(held, lambda x: e.t - x < 86400.0::DOUBLE)) < 2 THEN list_append(list_filter(held, lambda x: e.t - x < 86400.0::DOUBLE), e.t) ELSE list_filter(held, lambda x: e.t - x < 86400.0::DOUBLE) END FROM l JOIN e ON e.user_id = l.user_id AND e.r = l.r + 1)
SELECT event_id, user_id, allowed FROM l""",
    "tenant_documents": "SELECT doc_id, source, sha256(text) AS sha FROM documents WHERE source = (SELECT min(source) FROM documents)",
    "upsert_documents": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'stored' END AS status FROM documents",
    "referential_violations": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)",
    "job_latest_status": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "counters_prometheus": """WITH c AS (SELECT 'events_total{event_type="' || event_type || '",side="' || CASE WHEN user_id % 2 = 0 THEN 'even' ELSE '' END || '"}' AS key, count(*) AS c FROM events GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS n, key || ' ' || c AS line FROM c""",
    "label_distribution": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "text_length_summary": r"SELECT lang, count(*) AS n, CAST(min(w) AS BIGINT) AS min_words, CAST(max(w) AS BIGINT) AS max_words, CAST(sum(w) AS BIGINT) AS sum_words FROM (SELECT lang, len(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY lang",
    "folded_text": f"SELECT doc_id, sha256({FOLD}) AS folded_sha FROM documents",
}
