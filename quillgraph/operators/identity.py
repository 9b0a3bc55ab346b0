"""Deduplication by identity, always with a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import stash


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A broadcast hint only for a side counted to have at most ``most`` rows. What was counted is written, so it is what is sent."""
    df = stash(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key. ``order`` must be total, or ties go either way."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def best_of_each(df: DataFrame, keys: list[str], score: Column, tie: str) -> DataFrame:
    """The row of each key with the highest ``score``, then the smallest ``tie``, a unique number.

    Only keys, scores and ties are aggregated, with partial maxima; the other columns join in for the rows that won. Keys may be null.
    """
    scored = df.withColumns({"_score": score, "_tie": -F.col(tie)})
    best = scored.groupBy(*keys).agg(F.max(F.struct("_score", "_tie"))["_tie"].alias("_best")).select((-F.col("_best")).alias("_winner"))
    return df.join(best, F.col(tie) == F.col("_winner"), "left_semi")


def keep_longest(df: DataFrame, keys: list[str], text: str, tie: str) -> DataFrame:
    """The row with the longest text of each key; blank texts are dropped. ``tie`` is a unique number, the smallest wins."""
    return best_of_each(df.where(F.trim(F.col(text)) != ""), keys, F.length(text), tie)


def clause_quality(text: Column) -> Column:
    """Length up to 6,000, less for tables of contents and dot leaders."""
    contents = F.when(F.regexp_like(text, F.lit("目次|目录|(?i)table of contents")), 1200).otherwise(0)
    return F.least(F.length(text), F.lit(6000)) - contents - F.least(F.lit(800), 80 * F.regexp_count(text, F.lit("…|\\.{4,}")))


def keep_best(df: DataFrame, keys: list[str], quality: Column, tie: str) -> DataFrame:
    return best_of_each(df, keys, quality, tie)


def merge_channels(channels: list[tuple[str, DataFrame]], keys: list[str], rank: str = "rank") -> DataFrame:
    """Union of channels in order of priority; of rows with one identity the first stays. Adds ``channel`` and ``position``."""
    union = None
    for place, (name, df) in enumerate(channels):
        part = df.withColumns({"channel": F.lit(name), "_channel": F.lit(place)})
        union = part if union is None else union.unionByName(part)
    kept = first_by(union, keys, "_channel", rank)
    w = Window.partitionBy(keys[0]).orderBy("_channel", rank, *keys[1:])
    return kept.withColumn("position", F.row_number().over(w)).drop("_channel")


def three_tier_lookup(rows: DataFrame, corpus: DataFrame, tiers: list[list[str]], value: str, position: str) -> DataFrame:
    """``value`` of the corpus by the first tier of key columns that finds it. A key of several corpus rows takes the longest
    value, and of equally long ones the one with the greatest ``position``, a unique number. Rows with a null in a tier's keys
    don't match there. Only lengths and positions are aggregated; values join in for the positions that won."""
    for k, keys in enumerate(tiers):
        best = corpus.groupBy(*keys).agg(F.max(F.struct(F.length(value).alias("n"), F.col(position).alias("p")))["p"].alias(f"_hit{k}"))
        rows = rows.join(best, keys, "left")
    hits = [F.col(f"_hit{k}") for k in range(len(tiers))]
    tier = F.coalesce(*(F.when(hit.isNotNull(), k + 1) for k, hit in enumerate(hits)))
    chosen = rows.withColumns({"_won": F.coalesce(*hits), "tier": tier}).drop(*(f"_hit{k}" for k in range(len(tiers))), value)
    values = corpus.select(F.col(position).alias("_won"), value)
    return chosen.join(values, "_won", "left").drop("_won")
