"""Refinement of retrieved passages: how relevant a passage is to a question, and the strip of it that is most so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunk
from ..functions import questions as q
from ..functions import text


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"([{text.CJK}]+|[A-Za-z0-9]+)"), 1))


def relevance(question: Column, passage: Column) -> Column:
    """Shared words over those of the shorter set, 0.6 times for fewer than 40 characters; 0 without words."""
    a, b = _words(question), _words(passage)
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    score = F.when(F.length(passage) < 40, shared * 0.6).otherwise(shared)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(score, F.lit(1.0)))


def refined(found: DataFrame, questions: DataFrame, corpus: DataFrame, most: int = 20, long_text: int = 800) -> DataFrame:
    """``query_id``, ``doc_id``, ``text``, ``score``, ``rank``: passages by their most relevant strip; irrelevant ones drop.

    A strip is the whole passage, or, beyond ``long_text`` characters without white space and without a formula, one of its sentences, the
    first of equally relevant ones. Where nothing is relevant the passages come back as they were.
    """
    passages = found.select("query_id", "doc_id", F.col("rank").alias("_r")).join(corpus.select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("text")), "doc_id").where("text <> ''")
    asked = passages.join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    whole = asked.select("query_id", "doc_id", "_r", F.lit(-1).alias("_i"), "text", F.round(relevance(F.col("_q"), F.col("text")), 9).alias("score"))
    long_ = corpus.join(found.select("doc_id").distinct(), "doc_id", "left_semi").where((F.length(q.packed(F.col("text"))) > long_text) & ~text.has_formula(F.col("text"))).select("doc_id", "text")
    cut = chunk.sentences(long_, "doc_id", "text")
    strips = asked.drop("text").join(cut, "doc_id").select("query_id", "doc_id", "_r", F.col("part_index").alias("_i"), F.col("sentence").alias("text"), F.round(relevance(F.col("_q"), F.col("sentence")), 9).alias("score"))
    best = whole.unionByName(strips).groupBy("query_id", "doc_id", "_r").agg(F.max(F.struct("score", (-F.col("_i")).alias("i"), "text")).alias("m"))
    rows = best.select("query_id", "doc_id", "_r", F.col("m.text").alias("text"), F.col("m.score").alias("score"))
    good = rows.where("score > 0")
    none = whole.join(good.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "_r", "text", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "_r", "doc_id")
    return good.unionByName(none).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_r")
