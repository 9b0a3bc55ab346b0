"""Reordering and budgets of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Evidence budgets by question type.
BUDGETS = {"single": 10, "cross": 10, "correlation": 20}


def boosted(similarity: Column, rerank: Column, eligible: Column, beta: float = 1.5) -> Column:
    """Rerank score, or the similarity where that is 0 or missing, times ``beta`` for eligible rows; a negative score isn't boosted."""
    base = F.when(F.coalesce(rerank, F.lit(0.0)) != 0, rerank).otherwise(F.coalesce(similarity, F.lit(0.0)))
    return F.when(eligible & (base > 0), base * beta).otherwise(base)


def within_budget(df: DataFrame, kind: str, score: str, *ties: str, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """The best candidates of each question up to its type's budget, ``position`` from 1; an unknown type counts as single."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), *ties)
    budget = F.coalesce(*(F.when(F.col(kind) == k, n) for k, n in budgets.items()), F.lit(budgets["single"]))
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= budget)


def best_tier(df: DataFrame, tier: Column, key: str = "query_id") -> DataFrame:
    """Rows of the lowest tier that a question has."""
    w = Window.partitionBy(key)
    tiered = df.withColumn("_tier", tier)
    return tiered.withColumn("_best", F.min("_tier").over(w)).where("_tier = _best").drop("_tier", "_best")


def mixed_with_prior(df: DataFrame, alpha: float, score: str = "score", rank: str = "rank") -> DataFrame:
    """``mixed``: alpha times the score scaled to its question's range, and the rest a prior of 1 - rank / (n - 1)."""
    w = Window.partitionBy("query_id")
    low, high, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    scaled = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    prior = F.when(n > 1, 1 - (F.col(rank) - 1) / (n - 1)).otherwise(1.0)
    return df.withColumn("mixed", alpha * scaled + (1 - alpha) * prior)


def matched_first(df: DataFrame, matched: Column, most: int, *order: str) -> DataFrame:
    """Matched rows, then others, up to ``most`` a question."""
    w = Window.partitionBy("query_id").orderBy(matched.cast("int").desc(), *order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
