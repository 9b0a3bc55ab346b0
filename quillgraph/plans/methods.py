"""Methods by name: each takes all questions at once and returns ranked evidence, ``query_id``, ``doc_id``, ``rank``, ``score``.

A method gets ``questions`` (query_id, text, kind, names) and ``corpus`` (doc_id, text, source, clause_id), and where it
uses a graph ``triples`` (see ``operators.triples``). Loops of methods that ask a model again are unrolled to two rounds; the
model's part is a plug-in, whose stand-in here is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, rank, refine, retrieval, scoped, triples
from ..sources.files import stash

METHODS: dict[str, Callable[..., DataFrame]] = {}
COLUMNS = ["query_id", "doc_id", "rank", "score"]


def method(f):
    METHODS[f.__name__] = f
    return f


def overlap(question: Column, body: Column) -> Column:
    """Stand-in for a reranker: the share of a question's tokens that a text holds."""
    asked = F.array_distinct(text.search_tokens(F.coalesce(question, F.lit(""))))
    return F.size(F.array_intersect(asked, text.search_tokens(F.coalesce(body, F.lit(""))))) / F.greatest(F.size(asked), F.lit(1))


@method
def bm25(questions: DataFrame, corpus: DataFrame, k: int = 20, **_) -> DataFrame:
    """Lexical search; documents that share nothing with a question follow with a score of 0."""
    q = questions.select("query_id", text.mixed_tokens(F.col("text")).alias("tokens"))
    c = corpus.select("doc_id", text.mixed_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return retrieval.bm25(q, c, k, zeros=True).select(*COLUMNS)


@method
def dense(questions: DataFrame, corpus: DataFrame, k: int = 20, embed: scoped.Embed = scoped.default_embed, **_) -> DataFrame:
    found = retrieval.dense_top_k(questions.select("query_id", embed(F.col("text")).alias("v")), corpus.select("doc_id", embed(F.col("text")).alias("v")), k, exclude_self=False)
    return found.select(*COLUMNS)


@method
def within_scope(questions: DataFrame, corpus: DataFrame, k: int = 20, embed: scoped.Embed = scoped.default_embed, **_) -> DataFrame:
    """Dense search among the documents of a question's standards only."""
    return scoped.within_standard(questions, corpus, k, embed=embed).select(*COLUMNS)


@method
def hybrid(questions: DataFrame, corpus: DataFrame, k: int = 20, **options) -> DataFrame:
    q = questions.select("query_id", text.mixed_tokens(F.col("text")).alias("tokens"))
    c = corpus.select("doc_id", text.mixed_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    fused = retrieval.reciprocal_rank_fusion([("sparse", retrieval.bm25(q, c, k)), ("dense", dense(questions, corpus, k, **options))])
    return retrieval.top_k(fused, "query_id", k).select(*COLUMNS)


@method
def community(questions: DataFrame, corpus: DataFrame, k: int = 20, triples_: DataFrame | None = None, **_) -> DataFrame:
    """Search in the communities of a question: the texts of their triples, by shared words."""
    found = stash(triples.community_search(questions, triples_).where("evidence_id is not null").select("query_id", F.col("evidence_id").cast(corpus.schema["doc_id"].dataType).alias("doc_id")).distinct())
    return triples.rank_text_units(questions, found.join(triples.texts_of(corpus.select("doc_id", "text", "clause_id"), found), "doc_id")).where(F.col("rank") <= k).select(*COLUMNS)


def _graph_texts(questions: DataFrame, corpus: DataFrame, triples_: DataFrame) -> DataFrame:
    """Texts that a question's triples come from, by the first of them, with the larger of 0.05 and its confidence."""
    ranked = triples.rank_triples(questions, triples_).select("query_id", "triple_id", "rank").join(triples_.select("triple_id", "evidence_id", "confidence"), "triple_id").where("evidence_id is not null")
    first = ranked.groupBy("query_id", F.col("evidence_id").cast(corpus.schema["doc_id"].dataType).alias("doc_id")).agg(F.min(F.struct("rank", "confidence")).alias("m"))
    return first.select("query_id", "doc_id", "m.rank", F.greatest(F.lit(0.05), F.coalesce("m.confidence", F.lit(0.0))).alias("score"))


@method
def clause_graph(questions: DataFrame, corpus: DataFrame, k: int = 20, triples_: DataFrame | None = None, scorer=overlap, beta: float = 1.5, embed: scoped.Embed = scoped.default_embed, **_) -> DataFrame:
    """The main method: texts within standards, those that standards give directly, texts of triples and of their files, each
    once in this order; reranked, those of the question's standards boosted, cut to the budget of the type.

    Without ``scorer`` the similarity stays; ``beta`` of 1 boosts nothing.
    """
    graph = stash(_graph_texts(questions, corpus, triples_))
    within = scoped.within_standard(questions, corpus, k, embed=embed).select(*COLUMNS)
    direct = scoped.std_direct(questions, corpus, k, embed).withColumn("score", F.lit(1.0)).select(*COLUMNS)
    of_files = graph.join(corpus.select("doc_id", "source"), "doc_id").select("query_id", "rank", "source")
    several = questions.where("kind <> 'single'")
    injected = scoped.inject_sources(graph.limit(0), of_files.join(several.select("query_id"), "query_id", "left_semi"), questions, corpus).select("query_id", "doc_id", F.col("position").alias("rank"), F.lit(1.0).alias("score"))
    pool = stash(identity.merge_channels([("within", within), ("direct", direct), ("graph", graph.select(*COLUMNS)), ("files", injected)], ["query_id", "doc_id"]))
    keys = stash(scoped.keys_of(questions))
    own = keys.join(scoped.matched_sources(keys, corpus), "key").select("query_id", "source").distinct().withColumn("_own", F.lit(True))
    full = pool.join(questions.select("query_id", F.col("text").alias("_q"), "kind"), "query_id").join(corpus.select("doc_id", "text", "source"), "doc_id").join(own, ["query_id", "source"], "left")
    body = F.col("text")
    eligible = F.coalesce("_own", F.lit(False)) & text.quality_ok(body) & ~text.forward_reference(body)
    reranked = full.withColumn("_r", scorer(F.col("_q"), body).cast("double") if scorer else F.lit(0.0)).withColumn("_final", F.round(rank.boosted(F.col("score"), F.col("_r"), eligible, beta), 9))
    kept = rank.within_budget(reranked.drop("rank").withColumnRenamed("position", "_place"), "kind", "_final", "_place", "doc_id")
    return kept.select("query_id", "doc_id", F.col("position").alias("rank"), F.col("_final").alias("score"))


def _second_round(questions: DataFrame, corpus: DataFrame, first: DataFrame, k: int, ask: Column, **options) -> DataFrame:
    """Search again for the questions that ``ask`` holds for, with the best text of the first round added to the question."""
    best = first.where("rank = 1").join(corpus.select("doc_id", F.col("text").alias("_t")), "doc_id").select("query_id", "_t", F.col("score").alias("_best"))
    again = questions.join(best, "query_id").where(ask).withColumn("text", F.concat_ws(" ", "text", F.substring("_t", 1, 200))).drop("_t", "_best")
    return dense(again, corpus, k, **options)


def _merged(parts: list[tuple[str, DataFrame]], k: int) -> DataFrame:
    merged = identity.merge_channels([(n, df.select(*COLUMNS)) for n, df in parts], ["query_id", "doc_id"]).where(F.col("position") <= k)
    return merged.select("query_id", "doc_id", F.col("position").alias("rank"), "score")


@method
def adaptive(questions: DataFrame, corpus: DataFrame, k: int = 20, **options) -> DataFrame:
    """One search for single questions; for the others a second one, whose new hits follow those of the first. ``kind`` is the router's."""
    first = stash(dense(questions, corpus, k, **options))
    more = _second_round(questions.where("kind <> 'single'"), corpus, first, k, F.lit(True), **options)
    return _merged([("first", first), ("second", more)], k)


@method
def self_reflective(questions: DataFrame, corpus: DataFrame, k: int = 20, supported: float = 0.8, most: int = 8, **options) -> DataFrame:
    """Irrelevant hits drop (if that leaves any, the first ``most``); a question whose best hit is below ``supported`` searches again with its first words; the best score of a text stays."""

    def relevant(found: DataFrame) -> DataFrame:
        judged = found.join(questions.select("query_id", F.col("text").alias("_q")), "query_id").join(corpus.select("doc_id", "text"), "doc_id").withColumn("_rel", F.when(refine.relevance(F.col("_q"), F.col("text")) > 0, 0).otherwise(1))
        kept = rank.best_tier(judged, F.col("_rel")).select(*COLUMNS, "_rel")
        return retrieval.top_k(kept, "query_id", k).where((F.col("_rel") == 1) | (F.col("rank") <= most)).select(*COLUMNS)

    first = stash(relevant(dense(questions, corpus, k, **options)))
    weak = first.groupBy("query_id").agg(F.max("score").alias("_best")).where(F.col("_best") < supported).select("query_id")
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: F.length(w) > 1)
    again = questions.join(weak, "query_id").withColumn("text", F.array_join(F.slice(words, 1, 8), " "))
    second = relevant(dense(again, corpus, k, **options))
    both = first.unionByName(second).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return retrieval.top_k(both, "query_id", k).select(*COLUMNS)


@method
def corrective(questions: DataFrame, corpus: DataFrame, k: int = 20, high: float = 0.65, low: float = 0.35, **options) -> DataFrame:
    """Refines the first round where its best scores are high, replaces it where they are low, and merges both in between."""
    first = stash(dense(questions, corpus, k, **options))
    level = first.where("rank <= 3").groupBy("query_id").agg(F.avg("score").alias("_level"))
    second = _second_round(questions, corpus, first, k, F.lit(True), **options).join(level, "query_id").where(F.col("_level") < high).select(*COLUMNS)
    kept = first.join(level, "query_id").where(F.col("_level") > low).select(*COLUMNS)
    found = stash(_merged([("first", kept), ("second", second)], k))
    return refine.refined(found, questions, corpus, k).select(*COLUMNS)


@method
def forward_looking(questions: DataFrame, corpus: DataFrame, k: int = 20, confidence: float = 0.99, **options) -> DataFrame:
    """Where (cosine + 1) / 2 of the best hit is below ``confidence`` a second search follows; the best score of an identity stays."""
    first = stash(dense(questions, corpus, k, **options))
    second = _second_round(questions, corpus, first, k, (F.col("_best") + 1) / 2 < confidence, **options)
    both = first.select("query_id", "doc_id", "score").union(second.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return retrieval.top_k(both, "query_id", k).select(*COLUMNS)


@method
def closed_book(questions: DataFrame, corpus: DataFrame, k: int = 20, **_) -> DataFrame:
    """No evidence at all."""
    return questions.select("query_id").limit(0).select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"))


#: Variants of the main method for ablations, and values for sensitivity runs.
VARIANTS: dict[str, dict] = {"full": {}, "no_rerank": {"scorer": None}, "no_boost": {"beta": 1.0}, "beta_2": {"beta": 2.0}}
