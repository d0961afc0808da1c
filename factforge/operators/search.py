"""Retrieval: a postings table, keyword scores, vector similarity. Queries and chunks meet on tokens, never in a cross join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.sources.tables import durable


def tokens(text: Column) -> Column:
    """Runs of latin letters, digits and _.+- and of two Han characters or more, in lower case and with repeats; runs of more than four Han
    characters give their pairs besides."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_.+\-]+|[\u4e00-\u9fff]{2,}"), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    long = F.regexp_extract_all(text, F.lit(r"[\u4e00-\u9fff]{5,}"), F.lit(0))
    return F.concat(runs, F.flatten(F.transform(long, pairs)))


def postings(chunks: DataFrame, id_col: str, text: str) -> DataFrame:
    """token, id, count, and the number of chunks that hold the token. The number is counted over whole rows, so that both sides of the join
    read one shuffle and chunks are split once."""
    rows = chunks.select(id_col, F.explode(tokens(F.col(text))).alias("token")).groupBy("token", id_col).agg(F.count("*").alias("n"))
    frequency = rows.groupBy("token").agg(F.count_if(F.col("n") > 0).alias("n_chunks"))
    return rows.join(frequency, "token")


#: Tokens in no more chunks than this propose candidates in the first round; a round that can't tell goes on with tokens so many times as frequent.
RARE, WIDER = 10_000, 16


def score_topk(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, chunk_id: str, rare: int = RARE) -> DataFrame:
    """Best k chunks of each query: 8 + the query's tokens (repeats count) that the chunk holds; ties by chunk id.

    Rare tokens propose candidates with a partial score; frequent ones can add no more than their weights' sum. A query is done when that sum
    is below the partial score of its k-th candidate, so that no other chunk can come in; candidates that may reach it are scored
    in full, each with its own tokens alone. Other queries take more frequent tokens into the next round, in the end all of them. So a
    word that is in most chunks makes pairs only for queries that nothing else decides."""
    q = queries.select(query_id, F.explode(tokens(F.col("text"))).alias("token")).groupBy(query_id, "token").agg(F.count("*").alias("repeats"))
    index = chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"), chunk_id)
    index = durable(index.join(q.select("token").distinct(), "token", "left_semi"))
    q = durable(q.join(index.groupBy("token").agg(F.count("*").alias("n_chunks")), "token"))
    most = q.agg(F.max("n_chunks")).first()[0] or 0
    first, c, out = Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id), F.col, None
    while True:
        rest = q.groupBy(query_id).agg(F.coalesce(F.sum(F.when(c("n_chunks") > rare, c("repeats"))), F.lit(0)).alias("rest"))
        part = durable(q.where(c("n_chunks") <= rare).join(index, "token").groupBy(query_id, chunk_id).agg(F.sum("repeats").alias("score")))
        ranked = part.withColumn("rank", F.row_number().over(first)).where(c("rank") == k).select(query_id, c("score").alias("least"))
        state = durable(rest.join(ranked, query_id, "left").withColumn("done", (c("rest") == 0) | F.coalesce(c("rest") < c("least"), F.lit(False))))
        near = part.join(state.where("done"), query_id).where(F.coalesce(c("score") + c("rest") >= c("least"), F.lit(True))).select(query_id, chunk_id, "score")
        more = near.select(query_id, chunk_id).join(q.where(c("n_chunks") > rare), query_id).join(index, ["token", chunk_id]).select(query_id, chunk_id, c("repeats").alias("score"))
        full = near.unionByName(more).groupBy(query_id, chunk_id).agg((F.lit(8.0) + F.sum("score")).alias("score"))
        best = full.withColumn("rank", F.row_number().over(first).cast("long")).where(c("rank") <= k)
        out = best if out is None else out.unionByName(best)
        if rare >= most or state.where("not done").isEmpty():
            return out
        q, rare = durable(q.join(state.where("not done").select(query_id), query_id, "left_semi")), rare * WIDER


def first_match(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str) -> DataFrame:
    """The least chunk id that shares a token with a query: least ids of tokens first, so pairs are never made."""
    least = chunks.select(chunk_id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.min(chunk_id).alias(chunk_id))
    q = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return q.join(least, "token").groupBy(query_id).agg(F.min(chunk_id).alias(chunk_id))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows, summed as doubles in order; NaN of a vector without length."""
    with np.errstate(all="ignore"):
        return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out = out + a[:, i].astype("f8") * b[:, i].astype("f8")
    return out


#: Bytes of vectors and of queries that a task holds against each other; vectors and queries of one matrix product; pairs of a task.
VECTOR_BYTES, QUERY_BYTES, VECTOR_ROWS, QUERY_ROWS, TASK_PAIRS = 32 << 20, 4 << 20, 16_384, 256, 1 << 28
#: Similarities count by nine digits; a product of matrices and the sum in order differ by less than what is left of this.
SLACK = 2e-9


def _matrices(rows: pa.Table, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the positions and vectors of the rows that hold vectors without nulls."""
    lists = rows.column(column).combine_chunks()
    lengths, values = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    ends = lengths.cumsum()
    bad = np.concatenate([[0], pc.is_null(values).to_numpy(zero_copy_only=False).cumsum()])
    fine = bad[ends] == bad[ends - lengths]
    flat = values.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[fine & (lengths > 0)]):
        at = np.flatnonzero(fine & (lengths == n))
        out[int(n)] = at, flat[(ends[at] - n)[:, None] + np.arange(n)]
    return out


def _first(keys: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group in order of the keys (the last one counts most)."""
    order = np.lexsort((*keys, group))
    g = group[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0)) if len(g) else g
    return order[np.arange(len(g)) - start < k]


def _near(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and vectors, and the cosines, of all pairs that can be among a query's best k. A product of matrices tells, in blocks,
    which pairs come near the k-th best so far; those alone are summed in order."""
    most = k + int(np.unique(ids, return_counts=True)[1].max())  # so many of equal vectors are enough, whichever a query has to leave out
    same = np.unique(np.ascontiguousarray(v).view(f"V{v.dtype.itemsize * v.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    kept = _first([ids], same, most)
    kept = kept[np.argsort(ids[kept], kind="stable")]
    with np.errstate(all="ignore"):
        unit = lambda x: x.astype("f8") / np.sqrt(np.einsum("ij,ij->i", x, x, dtype="f8"))[:, None]
        left, right = unit(q), unit(v[kept])
    odd, lost = ~np.isfinite(left).all(1), ~np.isfinite(right).all(1)  # NaN with every vector, NaN with every query
    left[odd], right[lost] = 0, 0
    vid, out_q, out_v = ids[kept], [], []
    own_low, own_high = np.searchsorted(vid, query_ids, "left"), np.searchsorted(vid, query_ids, "right")
    first = np.argsort(ids, kind="stable")[:most]
    out_q.append(np.repeat(np.flatnonzero(odd), len(first)))
    out_v.append(np.tile(first, odd.sum()))
    for a in range(0, len(q), QUERY_ROWS):
        rows = np.flatnonzero(~odd[a : a + QUERY_ROWS]) + a
        if not len(rows):
            continue
        bar = np.full(len(rows), least)
        r, c, s = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
        for b in range(0, len(vid), VECTOR_ROWS):
            score = left[rows] @ right[b : b + VECTOR_ROWS].T
            score[:, lost[b : b + VECTOR_ROWS]] = 2
            for i in np.flatnonzero((own_high[rows] > b) & (own_low[rows] < b + score.shape[1]) & (own_high[rows] > own_low[rows])):
                score[i, max(0, own_low[rows[i]] - b) : own_high[rows[i]] - b] = -2
            if b == 0 and score.shape[1] > k:
                bar = np.maximum(bar, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
            i, j = np.nonzero(score >= (bar - SLACK)[:, None])
            r, c, s = np.concatenate([r, i]), np.concatenate([c, j + b]), np.concatenate([s, score[i, j]])
            best = _first([-s], r, k)
            full = np.bincount(r[best], minlength=len(rows)) == k
            low = np.full(len(rows), np.inf)
            np.minimum.at(low, r[best], s[best])
            bar = np.where(full, np.maximum(bar, low), bar)
            near = s >= bar[r] - SLACK
            r, c, s = r[near], c[near], s[near]
        out_q.append(rows[r])
        out_v.append(kept[c])
    at_q, at_v = np.concatenate(out_q), np.concatenate(out_v)
    return at_q, at_v, np.concatenate([cosine(v[at_v[a : a + VECTOR_ROWS]], q[at_q[a : a + VECTOR_ROWS]]) for a in range(0, max(1, len(at_q)), VECTOR_ROWS)])


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, group: str, least: float = 0.1, weight: float = 0.3) -> DataFrame:
    """Best k vectors of the query's own group by similarity, at least `least`; the score is weighted as in hybrid retrieval. All pairs of a group
    are compared: its vectors are dealt over slots and its queries over chunks, each slot meets each chunk in one task of bounded size."""
    c, ids = F.col, {n: t.schema["vec_id"].dataType.simpleString() for n, t in (("query_id", queries), ("vec_id", vectors))}
    v = vectors.select("vec_id", "embedding", c(group).alias("g")).dropna()
    q = queries.select(c("vec_id").alias("query_id"), c("embedding").alias("q"), c(group).alias("g")).dropna()
    some = lambda column, most: F.greatest(F.lit(1), F.ceil(F.sum(F.size(column)) * 4 / most)).cast("long")
    sizes = v.groupBy("g").agg(some("embedding", VECTOR_BYTES).alias("slots"), F.count("*").alias("n"))
    sizes = durable(sizes.join(q.groupBy("g").agg(some("q", QUERY_BYTES).alias("chunks"), F.count("*").alias("m")), "g"))
    total = sizes.agg(F.sum(c("slots") * c("chunks")).alias("groups"), F.sum(c("n").cast("double") * c("m")).alias("pairs")).first()  # one row
    tasks = max(1, min(total.groups or 1, max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total.pairs or 0) / TASK_PAIRS))))
    one_of, each_of = lambda column, n: F.pmod(F.xxhash64(column), n), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), c(n) - 1))
    keys, sizes = ["g", "slot", "chunk"], sizes.select("g", "slots", "chunks")
    v = v.join(sizes, "g").select("g", "vec_id", "embedding", one_of("vec_id", c("slots")).alias("slot"), each_of("chunks").alias("chunk"))
    q = q.join(sizes, "g").select("g", "query_id", "q", one_of("query_id", c("chunks")).alias("chunk"), each_of("slots").alias("slot"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        out, some_v = [], _matrices(b, "embedding") if b.num_rows else {}
        for n, (at_q, x) in (_matrices(a, "q") if a.num_rows and some_v else {}).items():
            if n in some_v:
                at_v, y = some_v[n]
                query_ids, vec_ids = (t.column(name).to_numpy()[at] for t, name, at in ((a, "query_id", at_q), (b, "vec_id", at_v)))
                i, j, s = _near(vec_ids, y, query_ids, x, k, least)
                other = query_ids[i] != vec_ids[j]
                out.append((query_ids[i][other], vec_ids[j][other], s[other]))
        whole = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)]
        return pa.table({"query_id": pa.array(whole[0], a.schema.field("query_id").type), "vec_id": pa.array(whole[1], b.schema.field("vec_id").type), "s": whole[2]})

    pairs = q.repartition(tasks, *keys).groupBy(*keys).cogroup(v.repartition(tasks, *keys).groupBy(*keys))
    both = pairs.applyInArrow(near, ", ".join(f"{n} {t}" for n, t in ids.items()) + ", s double").withColumn("similarity", F.round("s", 9)).where(c("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(c("rank") <= k).select("query_id", "vec_id", "rank", F.round(c("similarity") * weight, 6).alias("score"))


def fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Primary rows; for keys without any, secondary ones, with the reason."""
    missing = secondary.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(missing.withColumn("origin", F.lit("fallback")))
