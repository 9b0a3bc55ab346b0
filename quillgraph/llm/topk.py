"""Exact top-k search by inner product with bounds from segment statistics, coarse to fine.

Over a segment of L components, the inner product of two vectors is at most L (m m' + s s'), with their means m and
deviations s (Cauchy-Schwarz on what is left after the means). With the vectors' norms this is the lower bound of the
distance from segment means and deviations, turned around. Bounds over 1, 4 and 16 segments prune candidates that
can't reach a query's k-th best exact score so far; only survivors get exact inner products, in whole numbers.

Rows and queries are cut into blocks of a bounded size, and each pair of blocks is a group of its own: the queries grow
with the rows, so neither side is broadcast. Each group returns at most k rows for each of its queries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash, table

LEVELS = (1, 4, 16)
_EXACT = 2.0**52  # float64 holds whole numbers up to here


def whole_components(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double; null for a null array or one with a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, each times the root of its segment's length."""
    ends = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        if b > a:
            part = x[:, a:b]
            mean = part.mean(1)
            out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, in whole numbers; past the range of a long they stop at its ends."""
    size = max(1, q.shape[1])
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * size
    if top < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    least, most = -(1 << 63), (1 << 63) - 1
    return np.array([min(most, max(least, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q.tolist(), x.tolist(), strict=True)], np.int64)


def products(q: np.ndarray, at: np.ndarray, x: np.ndarray, to: np.ndarray, by=exact, slice_: int = 1 << 16) -> np.ndarray:
    """``by`` of the chosen rows, a slice at a time."""
    parts = [by(q[at[i : i + slice_]], x[to[i : i + slice_]]) for i in range(0, len(at), slice_)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def search(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, copies: np.ndarray, k: int, chunk: int = 128):
    """Per query, the k best rows but for one copy of itself: places in q and x, scores, how many copies count.

    Rows are distinct pairs of id and vector, sorted by id with nulls last, and ``copies`` says how often each stands in
    the table. Also returns the share of pairs that got an exact score.
    """
    out, pairs = [], 0
    small_ = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < _EXACT  # sums are exact in doubles
    q_stats, x_stats = zip(*((statistics(q, s), statistics(x, s)) for s in LEVELS), strict=True)
    for a in range(0, len(q), chunk):
        b = min(a + chunk, len(q))
        bound = q_stats[0][a:b] @ x_stats[0].T
        slack = 1e-9 * (np.abs(q[a:b]).sum(1)[:, None] * np.abs(x).max(initial=0)) + 1e-6
        n = min(len(x), 4 * k + 1)
        seeds = np.argpartition(-bound, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(len(x)), (b - a, 1))
        rows = np.repeat(np.arange(b - a), n)
        scores = products(q, a + rows, x, seeds.ravel()).reshape(b - a, n)
        same = (x_id[seeds] == q_id[a:b, None]) & (x[seeds] == q[a:b, None, :]).all(2)
        mine = np.where(same & (copies[seeds] == 1), np.iinfo(np.int64).min, scores)
        least = np.sort(mine, axis=1)[:, -k] if n >= k else np.full(b - a, np.iinfo(np.int64).min)
        open_ = bound + slack >= least[:, None]
        for fine in range(1, len(LEVELS)):
            if 20 * np.count_nonzero(open_) > open_.size:  # many are left: all of them at once
                open_ &= q_stats[fine][a:b] @ x_stats[fine].T + slack >= least[:, None]
            else:
                at, to = np.nonzero(open_)
                open_[at, to] = products(q_stats[fine], a + at, x_stats[fine], to, lambda u, v: np.einsum("ij,ij->i", u, v)) + slack[at, 0] >= least[at]
        pairs += np.count_nonzero(open_)
        if small_ and 20 * np.count_nonzero(open_) > open_.size:
            dense = q[a:b] @ x.T
            at, to = np.nonzero(open_ & (dense >= least[:, None]))
            scores = dense[at, to].astype(np.int64)
        else:
            at, to = np.nonzero(open_)
            scores = products(q, a + at, x, to)
            keep = scores >= least[at]
            at, to, scores = at[keep], to[keep], scores[keep]
        left = copies[to] - ((x_id[to] == q_id[a + at]) & products(q, a + at, x, to, lambda u, v: (u == v).all(1)).astype(bool))
        keep = left > 0
        at, to, scores, left = at[keep], to[keep], scores[keep], left[keep]
        order = np.lexsort((to, -scores, at))
        at, to, scores, left = at[order], to[order], scores[order], left[order]
        start = np.searchsorted(at, at)
        keep = np.arange(len(at)) - start < k
        out.append((a + at[keep], to[keep], scores[keep], np.minimum(left[keep], k)))
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4, pairs


def top_k(vectors: DataFrame, queries: Column, k: int = 5, row_block: int = 16_384, query_block: int = 2_048) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: each query's k highest whole-number inner products.

    ``vectors`` has ``vec_id`` and ``embedding``; rows for which ``queries`` holds are the queries, and every row but the
    query's own is a candidate. Ties go to the smaller ``vec_id``, null ids last. Null vectors and those with a null or
    non-finite component take no part; vectors of different lengths aren't compared. Rows that agree in id and vector
    are kept once with their number and counted as often, so repeated queries return their rows as often. An empty table
    gives an empty result; other columns are ignored.
    """
    x = vectors.select("vec_id", whole_components(F.col("embedding")).alias("x"), queries.alias("_query")).where("x is not null")
    x = stash(x.groupBy("vec_id", "x").agg(F.count("*").alias("copies"), F.max("_query").alias("_query")).withColumn("size", F.size("x")))
    counts = x.agg(F.count("*").alias("n"), F.count_if("_query").alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts["n"] // row_block)), max(1, -(-counts["q"] // query_block))
    place = F.xxhash64("vec_id", "x")
    asked = x.where("_query").select("vec_id", "x", "copies", "size", F.lit(True).alias("asks"), F.pmod(place, F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"))
    held = x.select("vec_id", "x", "copies", "size", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"), F.pmod(place, F.lit(row_blocks)).alias("rb"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", na_position="last", kind="stable")
        q, rows = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        columns = ["query_id", "query_hash", "query_copies", "vec_id", "score", "copies"]
        if not len(q) or not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        qx, xx = np.stack(q["x"].to_list()).astype(float).reshape(len(q), -1), np.stack(rows["x"].to_list()).astype(float).reshape(len(rows), -1)
        # null ids are no queries; as candidates they equal no query's id
        ids = [f["vec_id"].astype("Int64").fillna(np.iinfo(np.int64).min).to_numpy(np.int64) for f in (q, rows)]
        absent = rows["vec_id"].isna().to_numpy()
        copies = rows["copies"].to_numpy(np.int64)
        (at, to, scores, left), _ = search(qx, ids[0], xx, ids[1], copies, k)
        return pd.DataFrame(
            {
                "query_id": ids[0][at],
                "query_hash": [int.from_bytes(hashlib.blake2b(qx[i].tobytes(), digest_size=8).digest(), "little", signed=True) for i in at],
                "query_copies": q["copies"].to_numpy(np.int64)[at],
                "vec_id": pd.Series(ids[1][to], dtype="Int64").mask(absent[to]),
                "score": scores,
                "copies": left,
            },
            columns=columns,
        )

    found = asked.unionByName(held).groupBy("qb", "rb", "size").applyInPandas(one, "query_id long, query_hash long, query_copies long, vec_id long, score long, copies long")
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    # k rows from each block at most: the best k of them, then each as often as it stands in the table
    found = found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    ranked = Window.partitionBy("query_id", "query_hash").orderBy("_place", "_copy")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "query_copies"))).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


QUERIES = {"op4_topk_search": op4_topk_search}
ORACLES = {
    "op4_topk_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
}
