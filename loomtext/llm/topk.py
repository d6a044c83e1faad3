"""Exact top-k inner products by columnar branch-and-bound.

Vectors lie in blocks, component by component (vertical layout). For a block of queries the scores
of a block of candidates are accumulated over one group of components after the other; after each
group a candidate stays only if its sum so far plus the largest possible rest (the product of both
remaining norms) can reach the k-th best score, and the survivors are compacted before the next
group. Groups are ordered by falling mass, so bounds tighten early. In sums that a floating-point
number holds exactly, a tile of queries meets a tile of candidates at a time: the bound is the
tile's, a candidate stays if it can reach any of its queries, and groups whose bounds drop little
are tried rarely.

Blocks of queries meet blocks of candidates on the pair of their numbers, so every meeting can be a
task of its own; each gives at most k rows for each query, and a ranking over those gives the
result. Neither side is broadcast; blocks hold the floored values, in two bytes each where they fit.
Sums are floats or doubles where every partial sum of a meeting stays below 2^24 or 2^53 (no partial
sum exceeds the product of the norms), else 64-bit integers, else integers without a bound: scores
are exact and ranked exactly. A
score outside the range of long is shown as the nearest long.

Defined cases: vectors that are null, or hold null or non-finite components, or whose id is null
take no part; a candidate with the query's own id is never returned; shorter vectors count as padded
with zeros; ties go to the smaller id; fewer candidates than k give fewer rows; repeated ids are
candidates each (the query of a repeated id is its least vector in order); empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import ship_package

GROUP = 16


#: Queries searched at a time within a meeting, and candidates.
TILE, WIDTH = 256, 4096
#: A group's bound is tried again after so many tiles, and at once where it dropped this share.
AGAIN, PAYS = 32, 0.25
#: Rows and bytes of a block at most; a block of candidates has fewer rows where there would be fewer than MEETINGS blocks, down to LEAST_ROWS.
BLOCK_ROWS, BLOCK_BYTES, MEETINGS, LEAST_ROWS = 1 << 16, 8 << 20, 64, 4096


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * v) as doubles; as Python integers where a product has no finite double."""
    with np.errstate(over="ignore"):
        out = np.floor(v * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[int(x) * int(scale) if abs(x) > 1e300 else int(np.floor(x * scale)) for x in r] for r in v], object).reshape(v.shape)


def doubles(m: np.ndarray) -> np.ndarray:
    """The nearest doubles, infinite where none is near."""
    if m.dtype != object:
        return m.astype(np.float64)
    near = [float(x) if -(1 << 1023) < x < 1 << 1023 else np.inf * (1 if x > 0 else -1) for x in m.ravel()]
    return np.array(near, np.float64).reshape(m.shape)


def stored(v: np.ndarray, scale: float) -> bytes:
    """The floored values in 2 or 4 bytes where they fit, else v itself in 8."""
    with np.errstate(over="ignore"):
        w = np.floor(v * scale)
    top = np.abs(w).max(initial=0)
    return (w.astype(np.int16) if top < 1 << 15 else w.astype(np.int32) if top < 1 << 31 else v).tobytes()


def restored(raw, wide: int, rows: int, scale: float) -> np.ndarray:
    """The floored values of a block, components x rows."""
    size = len(raw) // max(1, wide * rows)
    if size == 8 or not wide:
        return whole(np.frombuffer(raw).reshape(wide, rows), scale)
    return np.frombuffer(raw, np.int16 if size == 2 else np.int32).reshape(wide, rows)


def packed(batches, rows: int, wide: int, numbers, scale: float):
    """Packs rows (id, v[, number]) into blocks (number, ids, vertical values); numbers gives the next block's where there is no third column."""
    number, ids, vs = None, [], []

    def block():
        i, v = np.concatenate(ids), np.concatenate(vs)
        ids.clear(), vs.clear()
        parts = [(i[a : a + rows], v[a : a + rows]) for a in range(0, len(i), rows)]
        at = [number if number is not None else numbers() for _ in parts]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x, _ in parts], pa.binary()), pa.array([stored(np.ascontiguousarray(y.T), scale) for _, y in parts], pa.binary())], names=["number", "ids", "values"])

    for batch in batches:
        lists = batch.column(1)
        dense = np.zeros((batch.num_rows, wide))
        dense[np.arange(wide)[None] < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        own = batch.column(0).to_numpy(zero_copy_only=False)
        if batch.num_columns == 2:
            ids.append(own), vs.append(dense)
            if sum(map(len, ids)) >= rows:
                yield block()
            continue
        of = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if of[a] != number and ids:
                yield block()
            number = int(of[a])
            ids.append(own[a:b]), vs.append(dense[a:b])
    if ids:
        yield block()


def search_tiles(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search_block, in the floating-point kind of q and c, which holds all sums exactly; as arrays."""
    by_id = np.argsort(cid, kind="stable")  # a later candidate of an equal score never replaces an earlier one
    cid = cid[by_id]
    mass = np.array([np.dot(r.astype(np.float64), r) for r in c])
    order = np.argsort(-mass, kind="stable")
    ends = [*range(0, len(q), GROUP), len(q)]
    c, q = np.ascontiguousarray(c[order][:, by_id]), np.ascontiguousarray(q[order].T)

    def rests(m):
        out = [np.zeros(m.shape[1])]
        for a, b in reversed(list(zip(ends, ends[1:], strict=False))):
            out.append(out[-1] + np.square(m[a:b], dtype=np.float64).sum(0))
        return [np.sqrt(x) * (1 + 1e-6) + 1e-6 for x in reversed(out)]  # rounding can only keep more

    rest_c, rest_q = rests(c), rests(q.T)
    low = -np.inf
    out = []
    last_group = len(ends) - 1
    share, turn = np.ones(last_group), 0
    for at in range(0, len(qid), TILE):
        tq = slice(at, min(at + TILE, len(qid)))
        n = tq.stop - at
        best, who = np.full((n, k), low), np.zeros((n, k), np.int64)  # descending, then by id
        for lo in range(0, len(cid), WIDTH):
            turn += 1
            hi = min(lo + WIDTH, len(cid))
            last = best[:, -1]
            tried = {g for g in range(1, last_group) if share[g] >= PAYS or turn % AGAIN == 0} if np.isfinite(last).all() else set()
            alive, sums, g = None, None, 0
            while g < last_group:
                h = min((x for x in tried if x > g), default=last_group)
                more = c[ends[g] : ends[h], lo:hi]
                x = q[tq, ends[g] : ends[h]] @ (more if alive is None else more[:, alive])
                sums, g = x if sums is None else sums + x, h
                if g < last_group:
                    spare = rest_c[g][lo:hi] if alive is None else rest_c[g][lo + alive]
                    stay = np.flatnonzero((sums + rest_q[g][tq][:, None] * spare > last[:, None]).any(0))
                    share[g] = 1 - len(stay) / max(1, len(spare))
                    if len(stay) < len(spare):
                        alive, sums = stay if alive is None else alive[stay], sums[:, stay]
                    if not len(stay):
                        break
            if not sums.shape[1]:
                continue
            ids = cid[lo:hi] if alive is None else cid[lo + alive]
            own = np.flatnonzero((qid[tq] >= ids[0]) & (qid[tq] <= ids[-1]))
            for i in own:
                sums[i, slice(*np.searchsorted(ids, (qid[at + i], qid[at + i] + 1)))] = low
            for i in np.flatnonzero(sums.max(1) > last):
                some = np.flatnonzero(sums[i] > last[i])
                s = sums[i, some]
                if len(s) > k:  # nothing under the k-th best of these alone can stay
                    some, s = (x[s >= np.partition(s, len(s) - k)[len(s) - k]] for x in (some, s))
                s, w = np.concatenate((best[i], s)), np.concatenate((who[i], ids[some]))
                first = np.argsort(-s, kind="stable")[:k]
                best[i], who[i] = s[first], w[first]
        r, j = np.nonzero(best > low)
        out.append((qid[at + r], who[r, j], best[r, j].astype(np.int64)))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))


def exact_kind(q: np.ndarray, c: np.ndarray):
    """float32 or float64 where it holds every partial sum of products of the columns of q and c, else None."""
    if q.dtype == object or c.dtype == object:
        return None
    norm = lambda m: math.sqrt(np.square(m, dtype=np.float64).sum(0).max(initial=0))
    with np.errstate(over="ignore"):
        most, top = norm(q) * norm(c) * (1 + 1e-6) + 1, max(float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (q, c))
    return np.float32 if max(most, top) < 1 << 24 else np.float64 if max(most, top) < 1 << 53 else None


def search_block(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best of each query; q and c are vertical (components x rows) and hold whole numbers."""
    wide = len(q)
    top = lambda m: max((abs(int(x)) for x in (m.min(initial=0), m.max(initial=0))), default=0)
    most = top(q) * top(c) * max(wide, 1)
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    qf, cf = doubles(q), doubles(c)
    if kind is object:
        q, c = (np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object) for m in (q, c))
    else:
        q, c = q.astype(kind), c.astype(kind)
    with np.errstate(over="ignore"):
        order = np.argsort(-(cf * cf).sum(1), kind="stable")
        groups = [order[a : a + GROUP] for a in range(0, wide, GROUP)]
        rest_c, rest_q = np.zeros((len(groups) + 1, c.shape[1])), np.zeros((len(groups) + 1, q.shape[1]))
        for g in reversed(range(len(groups))):
            rest_c[g] = rest_c[g + 1] + (cf[groups[g]] ** 2).sum(0)
            rest_q[g] = rest_q[g + 1] + (qf[groups[g]] ** 2).sum(0)
    rest_c, rest_q = np.sqrt(rest_c), np.sqrt(rest_q)
    tiles = [np.ascontiguousarray(c[g].T) for g in groups]
    out = []
    for at in range(0, q.shape[1], TILE):
        first = q[groups[0], at : at + TILE].T @ c[groups[0]] if groups else np.zeros((min(TILE, q.shape[1] - at), c.shape[1]), kind)
        for i in range(at, min(at + TILE, q.shape[1])):
            alive = np.flatnonzero(cid != qid[i])
            if not len(alive):
                continue
            sums = first[i - at][alive]
            for g in range(1, len(groups) + 1):
                near = doubles(sums)
                with np.errstate(invalid="ignore", over="ignore"):
                    spare = np.nan_to_num(rest_q[g, i] * rest_c[g, alive] * (1 + 1e-9) + np.abs(near) * 1e-12 + 1e-6, nan=np.inf, posinf=np.inf)  # rounding can only keep more
                    if len(alive) > k:
                        least = np.nan_to_num(near - spare, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                        stay = ~(near + spare < np.partition(least, len(alive) - k)[len(alive) - k])
                        alive, sums = alive[stay], sums[stay]
                if g < len(groups):
                    sums = sums + tiles[g][alive] @ q[groups[g], i]
            scored = sorted(((-int(s), int(cid[a])) for s, a in zip(sums, alive, strict=True))) if kind is object else [(-int(sums[b]), int(cid[alive[b]])) for b in np.lexsort((cid[alive], -sums))[:k]]
            out += [(int(qid[i]), v, -s) for s, v in scored[:k]]
    return out


def top_inner_products(table: DataFrame, k: int = 5, modulus: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int | None = None, candidate_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by modulus. query_rows and candidate_rows: of a block; by default they follow the table.

    Components are floored after scaling; scores are sums of their products.
    """
    spark = table.sparkSession
    ship_package(spark)
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & fine)
    every, n, wide = (lambda r: (r[0], r[1], r[2] or 0))(rows.agg(F.count("*"), F.count_if(F.col("id") % modulus == 0), F.max(F.size("v"))).first())
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (2 * max(1, wide))))
    query_rows = query_rows or most
    candidate_rows = candidate_rows or min(most, max(LEAST_ROWS, every // MEETINGS))
    q_blocks, c_blocks = max(1, -(-n // query_rows)), max(1, -(-every // candidate_rows))
    block = "number int, ids binary, values binary"

    def candidates(batches):
        seq = iter(range(TaskContext.get().partitionId() * 7919, 1 << 62))
        return packed(batches, candidate_rows, wide, lambda: next(seq) % c_blocks, scale)

    # each query id once; a query's block comes from its hash
    asked = rows.where(F.col("id") % modulus == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("number", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
    asked = asked.repartition("number").sortWithinPartitions("number", "id").mapInArrow(lambda it: packed(it, query_rows, wide, None, scale), block)
    c = rows.mapInArrow(candidates, block).select(F.col("number").alias("c"), F.col("ids").alias("c_ids"), F.col("values").alias("c_values"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    q = asked.select(F.col("number").alias("q"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"))
    met = c.join(q, ["q", "c"]).select("c_ids", "c_values", "q_ids", "q_values")

    def search(batches):
        low, high = -(1 << 63), (1 << 63) - 1
        for batch in batches:
            for r in range(batch.num_rows):
                cid, qid = (np.frombuffer(batch.column(j)[r].as_buffer(), np.int64) for j in (0, 2))
                cv, qv = (restored(batch.column(j)[r].as_buffer(), wide, len(i), scale) for j, i in ((1, cid), (3, qid)))
                kind = exact_kind(qv, cv) if wide else None
                if kind is not None:
                    got = search_tiles(qv.astype(kind), qid, cv.astype(kind), cid, k)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in got), pa.nulls(len(got[0]), pa.string())], names=["query_id", "vec_id", "score", "wide"])
                    continue
                got = search_block(qv, qid, cv, cid, k)
                cols = [[x[0] for x in got], [x[1] for x in got], [min(max(x[2], low), high) for x in got], [f"{x[2] + (1 << 2200):0700x}" if not low < x[2] < high else None for x in got]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], names=["query_id", "vec_id", "score", "wide"])

    # wide: the order of scores that the nearest long can't tell apart
    found = met.mapInArrow(search, "query_id long, vec_id long, score long, wide string")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
