"""Entities of a dictionary: matching them to questions, boosts by them, and what the graph holds of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.files import stash
from . import retrieval
from .containment import contained


def match_entities(questions: DataFrame, entities: DataFrame, least: float = 0.5, few: int = 5, pool: int = 50, most: int = 20) -> DataFrame:
    """``query_id``, ``entity_id``, ``similarity``, ``match``, ``rank``: the ``most`` entities most similar to a question.

    ``questions``: query_id, keywords (array), v; ``entities``: entity_id (a number), name, v. Entities whose name holds a keyword, in any case,
    count if their cosine is above ``least``. A question with fewer than ``few`` such (keyword, entity) pairs also gets those
    of the ``pool`` most similar entities that are above it. An entity counts once, as what it was found first.
    """
    words = questions.select("query_id", F.explode("keywords").alias("w")).select("query_id", F.lower("w").alias("w")).where("w <> ''")
    named = stash(entities.where("name <> ''"))
    pairs = contained(words.select(F.col("w").alias("nid"), F.col("w").alias("needle")), named.select(F.col("entity_id").alias("hid"), F.lower("name").alias("hay")))
    hits = words.join(pairs.withColumnRenamed("nid", "w"), "w").select("query_id", "w", F.col("hid").alias("entity_id"))
    scored = hits.join(questions.select("query_id", F.col("v").alias("_q")), "query_id").join(named.select("entity_id", "v"), "entity_id")
    good = stash(scored.select("query_id", "w", "entity_id", F.round(text.cosine(F.col("_q"), F.col("v")), 9).alias("similarity")).where(F.col("similarity") > least))
    enough = good.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= few)
    open_ = questions.join(enough, "query_id", "left_anti").select("query_id", "v")
    near = retrieval.dense_top_k(open_, named.select(F.col("entity_id").alias("doc_id"), "v"), pool, exclude_self=False).where(F.col("score") > least)
    union = good.select("query_id", "entity_id", "similarity", F.lit("keyword").alias("match")).unionByName(near.select("query_id", F.col("doc_id").alias("entity_id"), F.round("score", 9).alias("similarity"), F.lit("semantic").alias("match")))
    once = union.groupBy("query_id", "entity_id").agg(F.max("similarity").alias("similarity"), F.min("match").alias("match"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entity_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def enhanced_query(question: Column, routed: Column, known: Column, most: int = 5) -> Column:
    """The question with the first entities of the router and of the graph behind it."""
    none = F.array().cast("array<string>")
    return F.concat_ws(" ", question, F.slice(F.coalesce(routed, none), 1, most), F.slice(F.coalesce(known, none), 1, most))


def entity_boost(body: Column, routed: Column, known: Column, first: int = 3) -> Column:
    """0.15 for each of the router's first entities that a text holds and 0.2 for each of the graph's; 0.5 at most."""
    low = F.lower(F.coalesce(body, F.lit("")))
    held = lambda names: F.size(F.filter(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, first), lambda n: (F.length(n) >= 2) & F.contains(low, F.lower(n))))
    return F.least(0.15 * held(routed) + 0.2 * held(known), F.lit(0.5))


def boosted_dense(questions: DataFrame, corpus: DataFrame, top: int = 20, least: float = 0.6, caps: dict[str, int] | None = None) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the 3 * ``top`` most similar texts, scored again with the entities they hold, cut to ``top``, then to scores of ``least`` and to the type's cap.

    ``questions``: query_id, v, kind, routed, known (arrays of names); ``corpus``: doc_id, v, text.
    """
    caps = caps or {"single": 15, "cross": 20, "correlation": 20}
    near = retrieval.dense_top_k(questions.select("query_id", "v"), corpus.select("doc_id", "v"), 3 * top, exclude_self=False)
    full = near.select("query_id", "doc_id", "score").join(questions.drop("v"), "query_id").join(corpus.select("doc_id", "text"), "doc_id")
    again = full.withColumn("score", F.round(F.col("score") * (1.0 + entity_boost(F.col("text"), F.col("routed"), F.col("known"))), 9)).drop("text", "routed", "known")
    ranked = retrieval.top_k(again, "query_id", top).where(F.col("score") >= least)
    cap = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in caps.items()), F.lit(20))
    return ranked.where(F.col("rank") <= cap).drop("kind")


# What a graph holds of the entities asked for


def entities_named(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``entities`` (name, ...) for each (query_id, name) of ``asked``."""
    return asked.select("query_id", "name").distinct().join(entities, "name")


def relations_of(relations: DataFrame, asked: DataFrame) -> DataFrame:
    """Relations (triple_id, head, tail, ...) that have an asked name at an end, once for each question."""
    ends = relations.select("triple_id", F.explode(F.array_distinct(F.array("head", "tail"))).alias("name"))
    return asked.select("query_id", "name").distinct().join(ends, "name").select("query_id", "triple_id").distinct().join(relations, "triple_id")


def units_of(units: DataFrame, asked: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Text units (doc_id, text, names) that hold an asked name in their text or among their entities: ``query_id``, ``doc_id``. ``listed`` (name, doc_id) may stand for ``names``."""
    wanted = asked.select("query_id", "name").distinct()
    inside = contained(wanted.select(F.col("name").alias("nid"), F.col("name").alias("needle")), units.select(F.col("doc_id").alias("hid"), F.col("text").alias("hay"))).select(F.col("nid").alias("name"), F.col("hid").alias("doc_id"))
    listed = units.select(F.explode("names").alias("name"), "doc_id") if listed is None else listed.select("name", "doc_id")
    return wanted.join(inside.unionByName(listed).distinct(), "name").select("query_id", "doc_id").distinct()


def communities_of(communities: DataFrame, asked: DataFrame) -> DataFrame:
    """Communities (community_id, nodes, ...) that have an asked name among their nodes: ``query_id``, ``community_id``."""
    nodes = communities.select("community_id", F.explode("nodes").alias("name"))
    return asked.select("query_id", "name").distinct().join(nodes, "name").select("query_id", "community_id").distinct()
