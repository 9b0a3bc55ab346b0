"""Retrieval within the standards that a question names.

A question has keys (comparison ids or document keys), a corpus has file names. Matching is done once for the distinct
keys and file names; lists of a standard's best texts are made once for each key and not for each question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as q
from ..functions import text
from ..sources.files import stash
from . import retrieval
from .containment import contained
from .rank import best_tier

#: Words of covers and contents, for whole texts and for their beginnings.
COVER_WORDS = ("目次", "目录", "书号", "定价", "北京1665信箱")
HEAD_WORDS = ("目次", "目录", "书号", "定价", "规范性引用文件")

Embed = Callable[[Column], Column]


def default_embed(c: Column) -> Column:
    return text.hash_embedding(text.search_tokens(F.coalesce(c, F.lit(""))))


def keys_of(questions: DataFrame, entities: str | None = None) -> DataFrame:
    """``query_id``, ``place``, ``key``: the standards that each question names, else those that its entities name."""
    found = q.keys_or_of_entities(F.col("text"), F.col(entities)) if entities else q.standard_keys(F.col("text"))
    return questions.select("query_id", F.posexplode(found).alias("place", "key"))


def matched_sources(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """``key``, ``source`` pairs that mean one standard: one comparison id; the same without a part, whatever the year; or a name that lies in the other."""
    core = lambda c: F.regexp_replace(text.document_key(c), r"\.md", "")
    k = stash(keys.select("key").distinct().withColumns({"id": F.when(F.contains("key", F.lit(":")), F.col("key")).otherwise(text.comparison_id(F.col("key"))), "core": core(F.col("key"))}))
    s = stash(sources.select("source").where("source is not null").distinct().withColumns({"id": text.comparison_id(F.col("source")), "core": core(F.col("source"))}))
    same = k.where("id <> ''").join(s.select("source", "id"), "id").select("key", "source")
    partless = lambda df, name: df.where(F.contains("id", F.lit("::"))).select(name, F.element_at(F.split("id", "::"), 1).alias("stem"))
    years = partless(k, "key").join(partless(s, "source"), "stem").select("key", "source")
    inside = contained(k.select(F.col("key").alias("nid"), F.col("core").alias("needle")), s.select(F.col("source").alias("hid"), F.col("core").alias("hay"))).select(F.col("nid").alias("key"), F.col("hid").alias("source"))
    around = contained(s.select(F.col("source").alias("nid"), F.col("core").alias("needle")), k.select(F.col("key").alias("hid"), F.col("core").alias("hay"))).select(F.col("hid").alias("key"), F.col("nid").alias("source"))
    return same.union(years).union(inside).union(around).distinct()


def usable(c: Column, least: int, words: tuple[str, ...], head: int | None = None) -> Column:
    """Long enough, and no cover or contents."""
    compact = q.packed(F.coalesce(c, F.lit("")))
    looked = F.substring(compact, 1, head) if head else compact
    return (F.length(compact) >= least) & ~F.regexp_like(looked, F.lit("|".join(words)))


def _lists(of: DataFrame, corpus: DataFrame, by: str, limit: int) -> DataFrame:
    """``by``, ``doc_id``, ``size``: the ``limit`` longest usable texts of each ``by``, from (by, source)."""
    good = corpus.where(usable(F.col("text"), 20, COVER_WORDS)).select("source", "doc_id", F.length(F.trim("text")).alias("size"))
    w = Window.partitionBy(by).orderBy(F.desc("size"), "doc_id")
    return of.join(good, "source").select(by, "doc_id", "size").distinct().withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= limit).drop("_i")


def by_standard(keys: DataFrame, matches: DataFrame, corpus: DataFrame, limit: int = 12) -> DataFrame:
    """``query_id``, ``doc_id``, ``rank``: the longest usable texts of the standards that a question names."""
    lists = _lists(matches, corpus, "key", limit)
    found = keys.select("query_id", "key").join(lists, "key").select("query_id", "doc_id", "size").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("size"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("size")


def by_source(asked: DataFrame, matches: DataFrame, corpus: DataFrame, per_source: int = 3) -> DataFrame:
    """``query_id``, ``source_place``, ``doc_id``, ``rank``: the longest texts of each source in ``asked`` (query_id, place, source); a text may come under several.

    ``matches`` is ``matched_sources`` with the asked sources as keys.
    """
    lists = _lists(matches, corpus, "key", per_source)
    w = Window.partitionBy("query_id", "place").orderBy(F.desc("size"), "doc_id")
    found = asked.join(lists.withColumnRenamed("key", "source"), "source")
    return found.select("query_id", F.col("place").alias("source_place"), "doc_id", F.row_number().over(w).alias("rank"))


def by_clause(questions: DataFrame, corpus: DataFrame, limit: int = 12) -> DataFrame:
    """``query_id``, ``doc_id``, ``rank``: texts of the (standard, clause) pairs that a question names. ``corpus`` has clause_id."""
    refs = questions.select("query_id", F.explode(q.clause_references(F.col("text"))).alias("r")).select("query_id", F.col("r.standard").alias("key"), q.clause_form(F.col("r.clause")).alias("clause")).where("clause <> ''")
    refs = stash(refs.distinct())
    own = corpus.select("doc_id", "source", "clause_id", q.clause_form(F.col("clause_id")).alias("clause"))
    found = refs.join(matched_sources(refs, corpus), "key").join(own, ["source", "clause"]).select("query_id", "doc_id", "source", "clause_id").distinct()
    w = Window.partitionBy("query_id").orderBy("source", "clause_id", "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "doc_id", "rank")


def dense_within(asked: DataFrame, matches: DataFrame, corpus: DataFrame, limit: int, embed: Embed = default_embed, least: int = 24) -> DataFrame:
    """``query_id``, ``key``, ``doc_id``, ``score``, ``rank``: for each (query_id, key, text) of ``asked`` the most similar texts of that standard.

    ``query_id`` is a number and unique with its key. The key is the block's scope, so only texts of one standard meet.
    Texts of fewer than ``least`` characters without white space and those that begin with a table of contents don't count.
    """
    rows = matches.join(corpus.where(usable(F.col("text"), least, HEAD_WORDS, 80)).select("source", "doc_id", embed(F.col("text")).alias("v")), "source").select(F.col("key").alias("scope"), "doc_id", "v")
    # several files of one standard may hold a text: once for each key
    rows = stash(rows.dropDuplicates(["scope", "doc_id"]))
    found = retrieval.dense_top_k(asked.select("query_id", F.col("key").alias("scope"), embed(F.col("text")).alias("v")), rows, limit, scopes=True, exclude_self=False, keep_scope=True)
    return found.withColumnRenamed("scope", "key")


def std_direct(questions: DataFrame, corpus: DataFrame, limit: int = 20, embed: Embed = default_embed) -> DataFrame:
    """``query_id``, ``doc_id``, ``origin``, ``rank``: texts that the standards in a question give directly.

    Named clauses if there are any; else the most similar texts of each standard, ``limit`` over their number but eight at
    least; else the longest ones. Of what is found the usable clauses count; without one, what is no preamble; else all.
    """
    keys = stash(keys_of(questions))
    matches = stash(matched_sources(keys, corpus))
    named = by_clause(questions, corpus, limit).select("query_id", "doc_id", F.lit("clause").alias("origin"), F.col("rank").alias("_o"), F.lit(0).alias("_place"))
    per = F.greatest(F.lit(8), F.floor(F.lit(limit) / F.count("*").over(Window.partitionBy("query_id"))).cast("int"))
    allowed = keys.withColumn("_per", per)
    similar = dense_within(allowed.join(questions.select("query_id", "text"), "query_id"), matches, corpus, max(8, limit), embed)
    similar = similar.join(allowed, ["query_id", "key"]).where(F.col("rank") <= F.col("_per")).select("query_id", "doc_id", F.lit("dense").alias("origin"), F.col("rank").alias("_o"), F.col("place").alias("_place"))
    longest = by_standard(keys, matches, corpus, limit).select("query_id", "doc_id", F.lit("longest").alias("origin"), F.col("rank").alias("_o"), F.lit(0).alias("_place"))
    order = F.when(F.col("origin") == "clause", 0).when(F.col("origin") == "dense", 1).otherwise(2)
    first = best_tier(named.union(similar).union(longest), order)
    c = F.col("text")
    tier = F.when(text.quality_ok(c) & ~text.forward_reference(c), 0).when(~text.preamble(c), 1).otherwise(2)
    kept = best_tier(first.join(corpus.select("doc_id", "text"), "doc_id").withColumn("_quality", tier), F.col("_quality"))
    once = kept.groupBy("query_id", "doc_id").agg(F.min(F.struct("_place", "_o", "origin")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m._place", "m._o", "doc_id")
    return once.select("query_id", "doc_id", "m.origin", F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


def subqueries(questions: DataFrame) -> DataFrame:
    """``query_id``, ``sub``, ``key``, ``text``, ``most``: what is asked within which standard, by the type of the question (``kind``).

    Single: the question, and the first standard with the topic and with one of its terms, within all standards. Cross: the
    question and, for two standards, the standard with its side within all; and each side within its own. Correlation: the
    topic with its terms, and two terms, within each of the first four.
    """
    question = F.col("text")
    keys, subject = q.standard_keys(question), q.topic(question)
    rows = questions.select("query_id", "kind", "text", keys.alias("keys"), subject.alias("topic"), F.filter(q.topic_terms(subject), lambda x: F.length(x) >= 3).alias("terms")).where(F.size("keys") > 0)
    n = F.size("keys")
    item = lambda key, what: F.struct(key.alias("key"), what.alias("text"))
    none = F.array().cast("array<struct<key:string,text:string>>")
    everywhere = lambda what: F.transform("keys", lambda k: item(k, what))
    joined = lambda *parts: F.concat_ws(" ", *parts)
    first = F.get("keys", 0)
    single = F.concat(
        everywhere(question),
        F.when(F.length("topic") >= 6, everywhere(joined(first, F.substring("topic", 1, 48)))).otherwise(none),
        F.when((F.length("topic") >= 6) & (F.size("terms") > 0), everywhere(joined(first, F.get("terms", 0)))).otherwise(none),
    )
    side = lambda i: q.side_topic(question, F.lit(i))
    cross = F.concat(
        everywhere(question),
        *(F.when((n > i) & (side(i) != question), everywhere(joined(F.get("keys", i), side(i)))).otherwise(none) for i in range(2)),
        F.transform("keys", lambda k, i: item(k, F.coalesce(*(F.when(i == j, side(j)) for j in range(4)), question))),
    )
    whole = F.when(F.trim(F.concat_ws(" ", "topic", F.slice("terms", 1, 4))) != "", F.trim(F.concat_ws(" ", "topic", F.slice("terms", 1, 4)))).otherwise(question)
    four = F.slice("keys", 1, 4)
    correlation = F.flatten(F.transform(four, lambda k: F.concat(F.array(item(k, whole)), F.transform(F.slice("terms", 1, 2), lambda x: item(k, x)))))
    asked = F.when(F.col("kind") == "single", single).when(F.col("kind") == "cross", cross).otherwise(correlation)
    found = rows.select("query_id", "keys", F.posexplode(F.array_distinct(asked)).alias("sub", "s"))
    return found.select("query_id", "sub", "s.key", "s.text").where(q.packed(F.col("text")) != "")


def within_standard(questions: DataFrame, corpus: DataFrame, limit: int = 20, per_sub: int = 24, embed: Embed = default_embed) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the best texts over all subqueries of a question, each text by its best score."""
    asked = stash(subqueries(questions).withColumn("_id", F.monotonically_increasing_id()))
    matches = stash(matched_sources(asked, corpus))
    found = dense_within(asked.select(F.col("_id").alias("query_id"), "key", "text"), matches, corpus, per_sub, embed).withColumnRenamed("query_id", "_id")
    best = found.join(asked.select("_id", "query_id"), "_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return retrieval.top_k(best, "query_id", limit)


def inject_sources(hits: DataFrame, triples: DataFrame, questions: DataFrame, corpus: DataFrame, per_source: int = 3, most: int = 40) -> DataFrame:
    """``query_id``, ``doc_id``, ``position``: texts of the files that a question's triples come from, in front of ``hits`` (query_id, doc_id, rank).

    ``triples``: query_id, rank, source. With standards in the question only files of those count.
    """
    keys = stash(keys_of(questions))
    first = stash(triples.where("source is not null").groupBy("query_id", "source").agg(F.min("rank").alias("place")))
    allowed = keys.select("query_id", "key").join(matched_sources(keys, first), "key").select("query_id", "source").distinct()
    named = keys.select("query_id").distinct()
    inside = first.join(allowed, ["query_id", "source"], "left_semi").unionByName(first.join(named, "query_id", "left_anti"))
    texts = by_source(inside, matched_sources(first.select(F.col("source").alias("key")), corpus), corpus, per_source)
    # what is put in front comes last source first
    new = texts.groupBy("query_id", "doc_id").agg(F.min(F.struct(F.col("source_place"), F.col("rank"))).alias("m")).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    front = new.select("query_id", "doc_id", F.lit(0).alias("_c"), (-F.col("m.source_place")).alias("_a"), (-F.col("m.rank")).alias("_b"))
    union = front.unionByName(hits.select("query_id", "doc_id", F.lit(1).alias("_c"), F.col("rank").alias("_a"), F.lit(0).alias("_b")))
    w = Window.partitionBy("query_id").orderBy("_c", "_a", "_b", "doc_id")
    return union.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("query_id", "doc_id", "position")


# Sentences


def sentences_within(asked: DataFrame, matches: DataFrame, sentences: DataFrame, limit: int = 36, per_text: int = 12, embed: Embed = default_embed) -> DataFrame:
    """``query_id``, ``doc_id``, ``part_index``, ``score``, ``rank``: the most similar sentences of the standards that a question asks in.

    ``asked``: query_id, key, text, a row for each standard. ``sentences``: doc_id, source, part_index, sentence; the first ``per_text`` of a text count. Of sentences of a standard
    that agree in 240 characters without white space the first one stands for all. All texts of a standard take part.
    """
    rows = matches.join(sentences.where(F.col("part_index") < per_text), "source")
    w = Window.partitionBy("key", F.substring(q.packed(F.col("sentence")), 1, 240)).orderBy("doc_id", "part_index")
    once = stash(rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").select("key", "doc_id", "part_index", "sentence", F.monotonically_increasing_id().alias("_id")))
    own = once.select(F.col("key").alias("source"), F.col("_id").alias("doc_id"), F.col("sentence").alias("text"))
    found = dense_within(asked, once.select("key", F.col("key").alias("source")).distinct(), own, limit, embed, least=1)
    # a sentence that two standards of a question hold is one hit
    named = found.select("query_id", F.col("doc_id").alias("_id"), "score").join(once, "_id").groupBy("query_id", "doc_id", "part_index").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id", "part_index")
    return named.select("query_id", "doc_id", "part_index", "score", F.row_number().over(by_score).alias("rank")).where(F.col("rank") <= limit)


def with_neighbours(hits: DataFrame, sentences: DataFrame, width: int) -> DataFrame:
    """``hits`` (with doc_id, part_index) and ``window``: the sentence with ``width`` ones before and behind it."""
    w = Window.partitionBy("doc_id").orderBy("part_index").rowsBetween(-width, width)
    around = sentences.select("doc_id", "part_index", F.array_join(F.collect_list("sentence").over(w), " ").alias("window"))
    return hits.join(around, ["doc_id", "part_index"])


def with_parents(hits: DataFrame, corpus: DataFrame, most: int = 2000, more: int = 4) -> DataFrame:
    """``hits`` (query_id, doc_id, text) with the whole text where that is longer by more than ``more`` characters without white space and at most ``most``."""
    size = lambda c: F.length(q.packed(c))
    joined = hits.join(corpus.select("doc_id", F.col("text").alias("_whole")), "doc_id", "left")
    grows = (size(F.col("_whole")) > size(F.col("text")) + more) & (size(F.col("_whole")) <= most)
    return joined.withColumns({"origin": F.when(grows, "parent").otherwise("hit"), "text": F.when(grows, F.col("_whole")).otherwise(F.col("text"))}).drop("_whole")
