"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

1. *Entities.* E-mail addresses, IP addresses, card and phone numbers are found by fixed patterns;
   each distinct value is a protected entity.
2. *Disclosure.* Over all documents, c(t) counts those that hold term t, c(e) those that hold entity
   e, c(t,e) those where t stands within ``reach`` characters of e, and N all of them. A term's
   disclosure of an entity is its pointwise mutual information over the entity's information:
   ln(p N / c(e)) / ln(N / c(e)), where p estimates how often the entity stands beside the term. It is
   smoothed by ``prior`` documents in which the entity is as frequent as in all of them, p =
   (c(t,e) + prior c(e) / N) / (c(t) + prior): a term that occurs beside the entity only nears 1 as
   it is seen more often, and a pair seen once counts, too, with what one document shows.
3. *Sanitising.* In the documents that hold the entity, every occurrence of a term is generalised
   from a disclosure of ``generalise_at`` on and removed from ``remove_at`` on. Base spans are always
   kept.

Terms are runs of four or more letters, in lower case. Offsets are code points, ends exclusive.
Defined cases: null text counts as empty; an entity in every document has no information to lose
(disclosure 0); overlapping terms inside base spans are not added; equal rows get equal results, each
its own row; very long texts are read whole; a term that several entities of a document share takes
the highest disclosure; empty tables give no rows; null ids stay null; extra columns, whatever their
names, pass through ``sanitise`` and are ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.session import cut, tidy

# The base kinds in their order, and the two kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "removed", "general")
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[REMOVED]", "[WORD]")
#: As the base patterns, but without a second look at characters that can't start a match: a run
#: starts where the last match ended or where no character of its class stands before it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPAN = "struct<start:int,end:int,value:string>"
#: Flagged documents up to which their spans are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 10_000


def _matches(text: Column, pattern: str | Column, ask: Column | None = None) -> Column:
    """array of (start, end, value) of the leftmost matches in turn; ask: a cheap test that they need."""
    # what follows the last match is one more piece, up to the end: else every character of it would be tried as a start
    whole = F.concat(F.lit("(?s)(.*?)(?:("), pattern, F.lit(r")|\z)")) if isinstance(pattern, Column) else F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    pieces = F.zip_with(F.regexp_extract_all(text, whole, 1), F.regexp_extract_all(text, whole, 2), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    pieces = F.filter(pieces, lambda x: x["size"] > 0)
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value")))).alias("found"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    return found if ask is None else F.when(ask, found).otherwise(empty)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def digit(i):
        d = F.ascii(F.substring(digits, i + 1, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + digit(i))
    return F.length(digits).between(13, 19) & (F.when(F.length(digits).between(13, 19), total).otherwise(1) % 10 == 0)


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, value) of the base kinds, by kind and start; kind is its number."""
    octet = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
    size = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    found = [
        _matches(text, EMAIL, text.contains("@")),
        F.filter(_matches(text, IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(octet))),
        F.filter(_matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda s: _luhn(s["value"])),
        F.filter(_matches(text, PHONE, text.contains("+")), lambda s: size(s["value"]).between(9, 15)),
    ]
    return F.concat(*[_kinded(a, k) for k, a in enumerate(found)])


def _kinded(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _beside(text: Column, span: Column, reach: int) -> Column:
    """The distinct whole terms within reach of a span."""
    start, end = span["start"], span["end"]
    left = F.concat(F.when(start <= reach, F.lit(" ")).otherwise(F.lit("")), F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach))))
    right = F.concat(F.substring(text, end + 1, F.lit(reach)), F.when(F.length(text) - end <= reach, F.lit(" ")).otherwise(F.lit("")))
    term = r"(?<=\P{L})\p{L}{4,}(?=\P{L})"
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(left), F.lit(term), 0), F.regexp_extract_all(F.lower(right), F.lit(term), 0)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def added_spans(docs: DataFrame, marked: DataFrame, prior: float, reach: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(doc_id, key, added): the spans of disclosing terms, for the documents that have any. marked: doc_id, key, text and spans of the documents with entities."""
    mentions = marked.select("doc_id", "key", F.explode("spans").alias("s"), "text").select("doc_id", "key", F.xxhash64("s.kind", F.lower("s.value")).alias("entity"), F.explode(_beside(F.col("text"), F.col("s"), reach)).alias("term"))
    mentions = cut(mentions.distinct())
    pairs = mentions.groupBy("entity", "term").agg(F.count("*").alias("c_te"))
    holders = cut(marked.select("doc_id", "key", F.explode("spans").alias("s")).select("doc_id", "key", F.xxhash64("s.kind", F.lower("s.value")).alias("entity")).distinct())
    entities = holders.groupBy("entity").agg(F.count("*").alias("c_e"))
    pairs = cut(pairs.join(entities, "entity"))
    tidy(docs.sparkSession)  # the plans and shuffles of a step are garbage by the next one
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))).alias("term")).where(F.length("term") >= 4)
    # counted before they meet the pairs: map-side sums leave one row for a word and task, however common the word is
    counts = words.groupBy("term").agg(F.count("*").alias("c_t"))
    total = docs.count()
    share = F.col("c_e") / F.lit(float(total))
    beside = (F.col("c_te") + prior * share) / (F.col("c_t") + prior)
    disclosure = F.when(share < 1, F.log(beside / share) / -F.log(share)).otherwise(0.0)
    flagged = pairs.join(counts, "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= generalise_at)
    flagged = cut(flagged.select("entity", "term", "disclosure"))
    tidy(docs.sparkSession)
    side = F.broadcast(flagged) if flagged.count() <= BROADCAST_ROWS else flagged
    # by the term first: a common entity with many terms would meet every one of its documents with every term
    held = marked.select("doc_id", "key", F.explode(F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))).alias("term")).where(F.length("term") >= 4).distinct()
    where = held.join(side, "term").alias("w").join(holders.alias("h"), F.expr("w.entity = h.entity and w.key = h.key and w.doc_id <=> h.doc_id"))
    where = where.groupBy("w.doc_id", "w.key", "w.term").agg(F.max("disclosure").alias("disclosure"))
    remove = F.col("disclosure") >= remove_at
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("term")))), "|")
    terms = where.groupBy("doc_id", "key").agg(listed(remove).alias("removed"), listed(~remove).alias("general"))
    places = terms.alias("w").join(marked.dropDuplicates(["doc_id", "key"]).alias("m"), F.expr("w.doc_id <=> m.doc_id and w.key = m.key")).select("m.doc_id", "m.key", "w.removed", "w.general", "m.text", "m.spans")
    found = [_kinded(_matches(F.col("text"), F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col(c), F.lit(r")(?!\p{L})")), F.col(c) != ""), KINDS.index(c)) for c in ("removed", "general")]
    free = F.filter(F.concat(*found), lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return places.select("doc_id", "key", F.sort_array(F.array_distinct(free)).alias("added")).where(F.size("added") > 0)


def _analysed(docs: DataFrame, id_col: str, text_col: str, prior: float, reach: int, generalise_at: float, remove_at: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, spans, and the text where there are spans) of every row; the added spans."""
    keyed = _keyed(docs, id_col, text_col)
    based = keyed.withColumn("spans", base_spans(F.col("text"))).withColumn("text", F.when(F.size("spans") > 0, F.col("text")))
    based = cut(based)
    tidy(docs.sparkSession)
    marked = based.where("text is not null").select("doc_id", "key", "text", "spans")
    return based, added_spans(keyed, marked, prior, reach, generalise_at, remove_at)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5, reach: int = 80, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """doc_id, counts of the kinds, base_sha256, spans and n_terms of every row of docs."""
    based, added = _analysed(docs, id_col, text_col, prior, reach, generalise_at, remove_at)
    extra = added.select(F.col("doc_id").alias("a_id"), F.col("key").alias("a_key"), "added")
    rows = based.drop("text").join(extra, F.expr("doc_id <=> a_id and key = a_key"), "left")
    every = F.concat("spans", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", count(0), count(1), count(2), count(3), F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(every).alias("spans"), (F.size(every) - F.size("spans")).cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5, reach: int = 80, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """docs with every span in the text replaced by its tag (overlapping ones by the first's) and n_chars, if there, set anew; other rows are as they were."""
    fresh = lambda name: next(n for n in (name + "_" * k for k in range(len(docs.columns) + 1)) if n.lower() not in {c.lower() for c in docs.columns})
    a_id, a_key, a_spans, base, made = (fresh(x) for x in ("a_id", "a_key", "a_spans", "base_spans", "made_text"))
    _, added = _analysed(docs, id_col, text_col, prior, reach, generalise_at, remove_at)
    added = cut(added)
    tidy(docs.sparkSession)
    side = added.select(F.col("doc_id").alias(a_id), F.col("key").alias(a_key), F.col("added").alias(a_spans))
    if added.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(base, base_spans(text))
    on = (F.col(id_col).cast("long").eqNullSafe(F.col(a_id))) & (F.xxhash64(text) == F.col(a_key))
    rows = rows.join(side, on, "left")
    tag = F.array(*[F.lit(t) for t in TAGS])
    every = F.concat(base, F.coalesce(a_spans, F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")))
    marks = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(tag, s["kind"]).alias("tag"))))

    def step(acc, s):
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["tag"]).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    new = F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn(made, F.when(F.size(every) > 0, new).otherwise(F.col(text_col).cast("string")))
    out = []
    for c in names:
        if c == text_col:
            out.append(F.col(made).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(made).isNull(), F.col(c)).otherwise(F.length(made)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)
