"""Pairs for training rerankers: positives, sentences of them and of the corpus, clauses of plain Markdown, tiers of negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunk
from ..functions import questions as q
from ..sources.files import stash
from . import retrieval, splits


def positives(facts: DataFrame, least: int = 8) -> DataFrame:
    """``query_id``, ``question``, ``source``, ``text``: supporting facts with a text of ``least`` characters, each (source, text) once for a question.

    ``facts``: query_id, question, source, text, place, and ``side``, the place of the source's standard in the question, or null. The question gets its side in front.
    """
    good = facts.withColumns({"text": F.trim("text"), "source": q.base_name(F.col("source"))}).where((F.length("text") >= least) & (F.trim(F.coalesce("question", F.lit(""))) != ""))
    first = good.groupBy("query_id", "source", "text").agg(F.min(F.struct("place", "question", "side")).alias("m"))
    asked = F.when(F.col("m.side").isNull(), F.trim("m.question")).otherwise(q.query_for_side(F.col("m.question"), F.col("m.side")))
    return first.select("query_id", asked.alias("question"), "source", "text", F.col("m.place").alias("place"))


def positive_sentences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (query_id, question, source, text) cut into evidence sentences, each once; a text without any stays if it has twelve characters."""
    keyed = stash(pairs.select("query_id", "question", "source", "text").withColumn("_id", F.monotonically_increasing_id()))
    cut = keyed.drop("text").join(chunk.sentences(keyed, "_id", "text"), "_id").select("query_id", "question", "source", F.col("sentence").alias("text"), "_id", "part_index")
    rest = keyed.join(cut.select("_id").distinct(), "_id", "left_anti").where(F.length(q.packed(F.col("text"))) >= 12).select("query_id", "question", "source", "text", "_id", F.lit(0).alias("part_index"))
    first = cut.unionByName(rest).groupBy("query_id", "question", "source", "text").agg(F.min(F.struct("_id", "part_index")).alias("_m"))
    return first.drop("_m")


def corpus_sentences(corpus: DataFrame, sentences: DataFrame) -> DataFrame:
    """``doc_id``, ``part_index``, ``source``, ``text``: sentences of the corpus, or its texts without any; of those of a source that agree in 240 characters the first stays."""
    cut = sentences.join(corpus.select("doc_id", "source"), "doc_id").select("doc_id", "part_index", "source", F.col("sentence").alias("text"))
    whole = corpus.join(sentences.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("part_index"), "source", "text")
    compact = q.packed(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("source", F.substring(compact, 1, 240)).orderBy("doc_id", "part_index")
    union = cut.unionByName(whole).where(F.length(compact) >= 12)
    return union.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


#: Fixed value: a line that is only the code of a standard.
ONLY_CODE = r"(?i)^(?:HB|GJB|GB/T|GB|QJ|SJ)[A-Z0-9＋+\-—－./（）() ]{2,}$"
#: Words of covers.
COVER = ("目录", "前言", "出版", "发行", "书号", "定价")


def markdown_clauses(c: Column, least: int = 18, most: int = 620, packed_to: int = 520) -> Column:
    """Array of clauses of a Markdown text: cut behind marks and at lines, ``least`` to ``most`` characters; longer ones are packed again at commas, up to ``packed_to``."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[.*?\]\([^)]*\)", " "), r"<[^>]+>", " "), "#+", " ")
    ends = "^[ ；;，,。]+|[ ；;，,。]+$"
    parts = F.transform(F.split(s, r"(?<=[。；;])|\n+"), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), ends, ""))
    none = F.array().cast("array<string>")
    state = F.struct(F.lit("").alias("buf"), none.alias("out"))
    good = lambda t: (F.length(F.trim(t)) >= least) & (F.length(F.trim(t)) <= most)
    take = lambda out, t: F.when(good(t), F.concat(out, F.array(F.regexp_replace(t, ends, "")))).otherwise(out)
    step = lambda a, x: F.when(F.length(a["buf"]) + F.length(x) <= packed_to, F.struct(F.concat(a["buf"], x).alias("buf"), a["out"].alias("out"))).otherwise(F.struct(x.alias("buf"), take(a["out"], a["buf"]).alias("out")))
    pack = lambda p: F.aggregate(F.split(p, r"(?<=[，,、])"), state, step, lambda a: take(a["out"], a["buf"]))
    found = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > most, pack(p)).when(F.length(p) >= least, F.array(p)).otherwise(none)))
    compact = lambda p: F.regexp_replace(p, r"\s+", "")
    cover = lambda p: F.regexp_like(compact(p), F.lit("|".join(COVER))) & (F.length(compact(p)) < 420)
    return F.filter(found, lambda p: (F.length(compact(p)) >= least) & ~F.regexp_like(compact(p), F.lit(ONLY_CODE)) & ~cover(p))


def tiered_negatives(asked: DataFrame, corpus: DataFrame, per_positive: int = 6, same_share: float = 0.85, near: int = 2) -> DataFrame:
    """``query_id``, ``doc_id``, ``origin``, ``rank``: negatives in tiers: neighbours in the source, the most similar rows of the source, rows of others.

    ``asked``: query_id, doc_id, source, pos, text, v; ``corpus``: doc_id, source, pos, text, v. At most ``same_share`` of the
    negatives come from neighbours and as many from similar rows before other sources fill up. No row whose text
    contains the positive's, or lies in it, is one.
    """
    same = max(1, round(per_positive * same_share))
    base = splits.negatives(asked, corpus, 4 * per_positive, near, text="text")
    around = base.where((F.col("origin") == "neighbour") & (F.col("rank") <= same)).select("query_id", "doc_id", F.lit("neighbour").alias("origin"), F.lit(0).alias("_t"), F.col("rank").alias("_r"))
    away = base.where("origin = 'random'").select("query_id", "doc_id", "origin", F.lit(2).alias("_t"), F.col("rank").alias("_r"))
    found = retrieval.dense_top_k(asked.select("query_id", F.col("source").alias("scope"), "v"), corpus.select("doc_id", F.col("source").alias("scope"), "v"), same + 1 + 2 * near, scopes=True, exclude_self=False)
    pairs = found.select("query_id", "doc_id", "rank").join(asked.select("query_id", F.col("text").alias("_gold"), F.col("doc_id").alias("_own")), "query_id").join(corpus.select("doc_id", "text"), "doc_id")
    inside = F.contains(q.packed(F.coalesce("text", F.lit(""))), q.packed(F.coalesce("_gold", F.lit("")))) | F.contains(q.packed(F.coalesce("_gold", F.lit(""))), q.packed(F.coalesce("text", F.lit(""))))
    similar = pairs.where((F.col("doc_id") != F.col("_own")) & ~inside).select("query_id", "doc_id", F.lit("similar").alias("origin"), F.lit(1).alias("_t"), F.col("rank").alias("_r"))
    by_tier = Window.partitionBy("query_id", "_t").orderBy("_r", "doc_id")
    union = around.unionByName(similar.withColumn("_i", F.row_number().over(by_tier)).where(F.col("_i") <= same).drop("_i")).unionByName(away)
    once = union.groupBy("query_id", "doc_id").agg(F.min(F.struct("_t", "_r", "origin")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m._t", "m._r", "doc_id")
    return once.select("query_id", "doc_id", "m.origin", F.row_number().over(w).alias("rank")).where(F.col("rank") <= per_positive)
