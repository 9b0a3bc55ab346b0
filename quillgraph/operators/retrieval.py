"""Search: lexical, by vectors, by n-grams; fusion of channels.

Questions are a table. Lexical searches stream the corpus past blocks of questions, dense ones compare blocks of both;
no table of questions by documents exists outside a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import stash
from . import blocks
from .identity import small


def top_k(scored: DataFrame, query: str | list[str], k: int, score: str = "score", tie: str = "doc_id", digits: int = 9) -> DataFrame:
    """The k best of each query, ``rank`` from 1; scores rounded so that engines agree on ties, then the smaller ``tie``."""
    w = Window.partitionBy(*([query] if isinstance(query, str) else query)).orderBy(F.desc("_rounded"), tie)
    ranked = scored.withColumn("_rounded", F.round(score, digits)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).drop("_rounded")


def bm25(questions: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, zeros: bool = False) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank`` of the ``k`` best documents of each question.

    ``questions`` has query_id and tokens, ``corpus`` doc_id and tokens (arrays). idf = ln(N - df + .5) - ln(df + .5); a negative one is
    ``epsilon`` times the mean over the vocabulary. Each occurrence of a token in a question counts. Documents without
    tokens are no part of N. Scores that round to 0 appear only with ``zeros``. The corpus is tokenised once and written.
    """
    sized = stash(corpus.select("doc_id", F.col("tokens").alias("items"), F.size("tokens").alias("size"), F.lit(0.0).alias("bonus")).where("size > 0"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    # a document counts a token once, so partial counts are all that is shuffled
    df = sized.select(F.explode(F.array_distinct("items")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = stash(df.select("token", (F.ln(F.lit(stats["n"]) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw")))
    mean = idf.agg(F.avg("raw").alias("m")).first()["m"] or 0.0
    asked = questions.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    weighed = asked.join(idf, "token").select("query_id", "token", (F.col("qf") * F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw"))).alias("w"))
    held = weighed.groupBy("query_id").agg(F.collect_list("token").alias("items"), F.collect_list("w").alias("weights"))  # a question's own tokens
    if zeros:
        none = questions.select("query_id").distinct().join(held, "query_id", "left_anti")
        held = held.unionByName(none.select("query_id", F.array().cast("array<string>").alias("items"), F.array().cast("array<double>").alias("weights")))
    found = blocks.top_k(held.withColumn("parts", F.lit(1.0)), sized, k, blocks.saturated(k1, b, stats["mean"] or 1.0), zeros)
    return found if zeros else found.where(F.round("score", 9) > 0)


def ngram_containment(questions: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the documents that hold the largest share of a question's grams. Both have ``grams`` (sets)."""
    asked = questions.where(F.size("grams") > 0).select("query_id", F.col("grams").alias("items"), F.transform("grams", lambda g: F.lit(1.0)).alias("weights"), F.size("grams").cast("double").alias("parts"))
    return blocks.top_k(asked, corpus.where(F.size("grams") > 0).select("doc_id", F.col("grams").alias("items"), F.lit(0.0).alias("size"), F.lit(0.0).alias("bonus")), k)


def reciprocal_rank_fusion(channels: list[tuple[str, DataFrame]], constant: int = 60) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` (sum of 1 / (constant + rank)) and ``channels`` from tables with query_id, doc_id, rank."""
    union = None
    for name, df in channels:
        part = df.select("query_id", "doc_id", F.lit(name).alias("channel"), (1.0 / (constant + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def scope_blocks(queries: DataFrame, vectors: DataFrame, row_block: int, query_block: int) -> DataFrame:
    """``scope``, ``rows``, ``row_blocks``, ``query_blocks`` for each scope that has both rows and queries; written."""
    counted = lambda d, name: d.where("scope is not null").groupBy("scope").agg(F.count("*").alias(name))
    both = counted(vectors, "rows").join(counted(queries, "asks"), "scope")
    needed = lambda name, size: F.ceil(F.col(name) / size).cast("long")
    return stash(both.select("scope", (F.col("rows") + F.col("asks")).alias("rows"), needed("rows", row_block).alias("row_blocks"), needed("asks", query_block).alias("query_blocks")))


def placed_in_blocks(queries: DataFrame, vectors: DataFrame, row_block: int, query_block: int, most: int = 100_000) -> DataFrame:
    """Queries (``asks``) and rows with ``cell``, ``qb`` and ``rb``: rows that agree in the three meet.

    Every scope is counted and only one of more than a block is cut: its queries are copied to its own row blocks, its rows
    to its own query blocks. Small scopes share cells of about a block, uncut, so a query is copied as often as its scope
    has blocks, however large the table is. Rows of scopes without a query, and queries of scopes without a row, stay away.
    Cut scopes number at most a row or query block's share of the tables; the table of scopes is broadcast only up to ``most`` rows.
    """
    counted = scope_blocks(queries, vectors, row_block, query_block)
    cut = (F.col("row_blocks") > 1) | (F.col("query_blocks") > 1)
    cells = max(1, -(-(counted.where(~cut).agg(F.sum("rows")).first()[0] or 0) // row_block))
    # a cut scope is a cell of its own; negative numbers are those of shared cells
    large = small(counted.where(cut).select("scope", "row_blocks", "query_blocks", F.monotonically_increasing_id().alias("cell")), most)
    held = small(counted.select("scope"), most)

    def placed(rows: DataFrame, asks: bool) -> DataFrame:
        own, other = ("query_blocks", "row_blocks") if asks else ("row_blocks", "query_blocks")
        joined = rows.join(held, "scope", "left_semi").join(large, "scope", "left")
        one = F.lit(1).cast("long")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1))
        dealt = joined.withColumn("_own", F.pmod(F.xxhash64("id"), F.coalesce(own, one))).withColumn("_other", every)
        cell = F.coalesce("cell", -1 - F.pmod(F.xxhash64("scope"), F.lit(cells)))
        qb, rb = ("_own", "_other") if asks else ("_other", "_own")
        return dealt.select(*rows.columns, F.lit(asks).alias("asks"), cell.alias("cell"), F.col(qb).alias("qb"), F.col(rb).alias("rb"))

    return placed(queries, True).unionByName(placed(vectors, False))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, scopes: bool = False, exclude_self: bool = True, keep_scope: bool = False, row_block: int = 16_384, query_block: int = 2_048) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: exact cosine search (0 for a zero norm), the smaller doc_id first in ties.

    ``queries`` has query_id and v, ``vectors`` doc_id and v (arrays of one length), with ``scopes`` both a column scope: then
    only rows of the query's scope count, and blocks are made scope by scope, which restricts before anything is scored.
    With ``keep_scope`` a query may ask in several scopes and has ``k`` rows in each, which ``scope`` tells; a null scope holds
    nothing. Neither side is broadcast: pairs of blocks of bounded size are groups, and each returns k rows a query at most.
    With scopes both tables are counted first, so they should be stashed where they are costly.
    """
    of = lambda d, name: d.select(F.col(name).alias("id"), "v", *(["scope"] if scopes else [F.lit(0).alias("scope")]))
    placed = placed_in_blocks(of(queries, "query_id"), of(vectors, "doc_id"), row_block, query_block)

    def scored(asks: pd.DataFrame, rows: pd.DataFrame, out: dict) -> None:
        def unit(part):
            x = np.stack(part["v"].to_list()).astype(float)
            norms = np.sqrt((x * x).sum(1))
            return x / np.where(norms > 0, norms, 1.0)[:, None], part["id"].to_numpy()

        (qx, qid), (rx, rid) = unit(asks), unit(rows.sort_values("id", kind="stable"))
        for a in range(0, len(qx), 256):
            scores = np.round(qx[a : a + 256] @ rx.T, 9)
            if exclude_self:
                scores[qid[a : a + 256, None] == rid[None, :]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            for i, row in enumerate(best):
                row = row[np.isfinite(scores[i, row])]
                out["query_id"] += [qid[a + i]] * len(row)
                out["doc_id"] += rid[row].tolist()
                out["score"] += scores[i, row].tolist()
                if keep_scope:
                    out["scope"] += [asks["scope"].iloc[0]] * len(row)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"scope": [], "query_id": [], "doc_id": [], "score": []} if keep_scope else {"query_id": [], "doc_id": [], "score": []}
        for _, of_scope in pdf.groupby("scope", sort=False):
            asks = of_scope["asks"].to_numpy(bool)
            if asks.any() and not asks.all():
                scored(of_scope[asks], of_scope[~asks], out)
        return pd.DataFrame(out)

    kind = f"scope {vectors.schema['scope'].dataType.simpleString()}, " if keep_scope else ""
    found = placed.groupBy("cell", "qb", "rb").applyInPandas(block, kind + "query_id long, doc_id long, score double")
    return top_k(found, ["query_id", "scope"] if keep_scope else ["query_id"], k)


def thresholded(ranked: DataFrame, least: float, caps: Column) -> DataFrame:
    """After top-k: scores of at least ``least``, and at most ``caps`` rows of each question."""
    w = Window.partitionBy("query_id").orderBy("rank")
    kept = ranked.where(F.round("score", 9) >= least).withColumn("rank", F.row_number().over(w))
    return kept.where(F.col("rank") <= caps)
