"""Retrieval among the passages that a question brings along, and the graph of those passages.

Everything joins on the question first, so names are compared only within one question's few passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as q
from ..functions import text
from ..sources.files import stash
from .triples import LOCAL_CAPS

#: Words that are no name in a question of several hops.
NO_ENTITY = ("which", "what", "where", "when", "whose", "whom", "both", "were", "with", "from", "that", "this", "among", "after", "before", "about")
#: Most passages by type of question.
PASSAGE_CAPS = {"single": 15, "cross": 20, "correlation": 10}

#: What stands before a passage's source in its evidence id.
PREFIX = "passage::"


def with_identity(chunks: DataFrame, source: str | None = None) -> DataFrame:
    """``chunks`` (query_id, idx, ...) with ``source``, where it is missing the question and the place, and the ids of a passage made from it."""
    own = text.blank_to_null(F.col(source)) if source else F.lit(None).cast("string")
    named = chunks.withColumn("source", F.coalesce(own, F.concat_ws("_", F.col("query_id").cast("string"), F.col("idx").cast("string"))))
    return named.withColumns({"passage_id": F.col("source"), "clause_id": F.col("source"), "evidence_id": F.when(F.col("source").startswith(PREFIX), F.col("source")).otherwise(F.concat(F.lit(PREFIX), "source"))})


def infer_gold(questions: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """``query_id``, ``idx``: gold passages of questions (query_id, text, answer) that have none.

    For yes and no the first ``most`` passages that hold a name of the question; else those that hold the answer; else the first.
    """
    answer = F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    names = F.filter(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"(?U)(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b)"), 1), lambda n: F.length(n) > 3)
    asked = questions.select("query_id", answer.alias("_a"), names.alias("_names"), answer.isin("yes", "no").alias("_word"))
    joined = chunks.select("query_id", "idx", F.coalesce("text", F.lit("")).alias("_t")).join(asked, "query_id")
    named = F.exists("_names", lambda n: F.contains("_t", n))
    held = (F.col("_a") != "") & F.contains(F.lower("_t"), F.col("_a"))
    w = Window.partitionBy("query_id").orderBy("idx")
    good = joined.withColumn("_good", F.when(F.col("_word"), named).otherwise(held))
    placed = good.withColumns({"_n": F.sum(F.col("_good").cast("int")).over(w), "_any": F.max("_good").over(Window.partitionBy("query_id")), "_first": F.row_number().over(w) == 1})
    kept = F.when(F.col("_any"), F.col("_good") & (~F.col("_word") | (F.col("_n") <= most))).otherwise(F.col("_first"))
    return placed.where(kept).select("query_id", "idx")


def local_bm25(questions: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``query_id``, ``idx``, ``score``, ``rank``: BM25 with the statistics of each question's own passages. Scores of 0 stay, in order of place."""
    sized = chunks.select("query_id", "idx", text.english_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    stats = sized.groupBy("query_id").agg(F.count("*").alias("_n"), F.avg(F.size("tokens")).alias("_mean")).where("_mean > 0")
    tf = stash(sized.select("query_id", "idx", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).groupBy("query_id", "idx", "dl", "token").agg(F.count("*").alias("tf")))
    df = tf.groupBy("query_id", "token").agg(F.count("*").alias("_df")).join(stats, "query_id")
    raw = df.select("query_id", "token", "_mean", (F.ln(F.col("_n") - F.col("_df") + 0.5) - F.ln(F.col("_df") + 0.5)).alias("_raw"))
    mean = raw.groupBy("query_id").agg(F.avg("_raw").alias("_avg"))
    asked = questions.select("query_id", F.explode(text.english_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    weights = raw.join(asked, ["query_id", "token"]).join(mean, "query_id")
    part = F.col("qf") * F.when(F.col("_raw") < 0, epsilon * F.col("_avg")).otherwise(F.col("_raw")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("_mean")))
    scored = tf.join(weights, ["query_id", "token"]).groupBy("query_id", "idx").agg(F.sum(part).alias("score"))
    known = sized.select("query_id", "idx").join(stats.select("query_id"), "query_id").join(asked.select("query_id").distinct(), "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "idx")
    return known.join(scored, ["query_id", "idx"], "left").na.fill(0.0, ["score"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_dense(questions: DataFrame, chunks: DataFrame, embed, k: int = 10) -> DataFrame:
    """``query_id``, ``idx``, ``score``, ``rank``: cosine of each question with its own passages; blank ones don't count."""
    asked = questions.select("query_id", embed(F.col("text")).alias("_q"))
    rows = chunks.where(F.trim("text") != "").select("query_id", "idx", embed(F.col("text")).alias("_v")).join(asked, "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
    return rows.select("query_id", "idx", F.round(text.cosine(F.col("_q"), F.col("_v")), 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged_hits(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``idx``, ``channel``, ``score``, ``position``: both channels, the dense one first where source and 200 characters agree, by their raw scores."""
    own = chunks.select("query_id", "idx", "source", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("_head"))
    parts = [df.select("query_id", "idx", "score", "rank").withColumns({"channel": F.lit(name), "_c": F.lit(c)}) for c, (name, df) in enumerate((("dense", dense), ("bm25", lexical)))]
    union = parts[0].unionByName(parts[1]).join(own, ["query_id", "idx"])
    first = Window.partitionBy("query_id", "source", "_head").orderBy("_c", "rank")
    once = union.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "_c", "rank")
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("query_id", "idx", "channel", "score", "position")


def question_entities(question: Column) -> Column:
    """Names of a question, the longest first; one inside a longer one doesn't count."""
    s = F.coalesce(question, F.lit(""))
    found = [F.regexp_extract_all(s, F.lit(p), 1) for p in (r"(?U)(\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)+\b)", r"(?U)(\b[A-Z][a-zA-Z0-9]*(?:\s+\d+)\b)", r"(?U)(\b[A-Z][a-zA-Z]{3,}\b)")]
    single = F.filter(found[2], lambda w: ~F.lower(w).isin(*NO_ENTITY))
    ordered = F.array_sort(F.transform(F.array_distinct(F.concat(found[0], found[1], single)), lambda n: F.struct((-F.length(n)).alias("n"), F.lower(n).alias("k"))))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: F.contains(k, x["k"])) | (F.length(x["k"]) < 3), kept).otherwise(F.concat(kept, F.array(x["k"])))
    return F.aggregate(ordered, F.array().cast("array<string>"), step)


def boosted_hits(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id``, ``idx``, ``score``, ``cover``, ``phrases``, ``rank``: hits (query_id, idx, score) that hold more of a question's names first.

    A name of several words or with a digit counts 0.35, another one 0.15, in the title 0.25 more. Two names or more add
    0.70 and 0.35 for each of the former; one of several adds 0.05; each word of five letters or more that the passage
    holds 0.01. The bonus is 2.5 at most. ``chunks`` has title and text.
    """
    asked = questions.select("query_id", question_entities(F.col("text")).alias("_e"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]{5,})"), 1).alias("_w"))
    title = F.lower(F.coalesce("title", F.lit("")))
    blob = F.concat(title, F.lit("\n"), F.lower(F.coalesce("text", F.lit(""))))
    rows = hits.select("query_id", "idx", "score").join(chunks.select("query_id", "idx", title.alias("_t"), blob.alias("_b")), ["query_id", "idx"]).join(asked, "query_id")
    rows = rows.withColumn("_in", F.filter("_e", lambda n: F.contains("_b", n)))
    phrase = lambda n: F.regexp_like(n, F.lit(r"[ \d]"))
    rows = rows.withColumns({"cover": F.size("_in"), "phrases": F.size(F.filter("_in", phrase))})
    named = 0.35 * F.col("phrases") + 0.15 * (F.col("cover") - F.col("phrases")) + 0.25 * F.size(F.filter("_in", lambda n: F.contains("_t", n)))
    more = F.when(F.col("cover") >= 2, 0.70 + 0.35 * F.col("phrases")).when((F.col("cover") == 1) & (F.size("_e") >= 2), 0.05).otherwise(0.0)
    words = 0.01 * F.size(F.filter("_w", lambda x: F.contains("_b", x)))
    scored = rows.withColumn("score", F.round(F.col("score") + F.least(named + more + words, F.lit(2.5)), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("phrases"), F.desc("cover"), "idx")
    return scored.select("query_id", "idx", "score", "cover", "phrases", F.row_number().over(w).alias("rank"))


# The graph of a question's passages


def seeds(questions: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """``query_id``, ``name``: entities that the question means.

    Each of its names takes the entity of that name, else up to three that mean the same, in order of appearance; titles that
    the question holds, or that mean one of its names, come in too. ``mentions``: query_id, idx, name; ``questions`` has ``names``.
    """
    known = mentions.where("name <> ''").groupBy("query_id", "name").agg(F.min("idx").alias("_at"))
    asked = questions.select("query_id", F.posexplode("names").alias("_place", "_asked"), F.lower(F.coalesce("text", F.lit(""))).alias("_q"))
    pairs = asked.join(known, "query_id").where(q.same_name(F.col("_asked"), F.col("name"))).withColumn("_equal", F.lower("_asked") == F.lower("name"))
    of_name = Window.partitionBy("query_id", "_asked")
    pairs = pairs.withColumn("_exact", F.max("_equal").over(of_name)).where("_equal or not _exact")
    first = pairs.withColumn("_i", F.row_number().over(of_name.orderBy(F.desc("_equal"), "_at", "name"))).where((F.col("_i") <= F.when(F.col("_exact"), 1).otherwise(3))).select("query_id", "name")
    titles = chunks.where(F.trim(F.coalesce("title", F.lit(""))) != "").select("query_id", F.trim("title").alias("_title")).distinct()
    in_question = titles.join(questions.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("_q")), "query_id").where(F.contains("_q", F.lower("_title"))).select("query_id", "_title")
    alike = titles.join(asked.select("query_id", F.col("_asked").alias("_n")).unionByName(first.select("query_id", F.col("name").alias("_n"))).distinct(), "query_id").where(q.same_name(F.col("_title"), F.col("_n"))).select("query_id", "_title")
    by_title = in_question.union(alike).distinct().join(known, "query_id").where(F.lower("_title") == F.lower("name")).select("query_id", "name")
    return first.union(by_title).distinct()


def local_graph(questions: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame, hops: int = 2, most_names: int = 24) -> DataFrame:
    """``query_id``, ``head``, ``relation``, ``tail``, ``idx``, ``confidence``, ``rank``: triples of a question's passages around the entities that it means.

    ``edges``: query_id, head, tail, relation, idx (the passage), paragraph. From the seeds, ``hops`` steps over edges whose end
    means the same reach more names, ``most_names`` in all, nearest first. An edge at a seed has 1.15, with one of the
    question's names in its paragraph or ends 1.35, with two 1.5, and 0.15 more if both ends are seeds; one at a reached name 0.9, with
    a name 1.05; without any name matched every edge 0.75. Fewer than four triples: passages that hold a matched name
    follow as context with 0.75. The cap is that of the question's type.
    """
    seed = stash(seeds(questions, chunks, mentions).withColumn("depth", F.lit(0)))
    reached, front = seed, seed
    for depth in range(1, hops + 1):
        touching = front.select("query_id", F.col("name").alias("_from")).join(edges.select("query_id", "head", "tail"), "query_id")
        ahead = touching.where(q.same_name(F.col("_from"), F.col("head"))).select("query_id", F.explode(F.array("tail", "head")).alias("name"))
        back = touching.where(q.same_name(F.col("_from"), F.col("tail")) & ~q.same_name(F.col("_from"), F.col("head"))).select("query_id", F.explode(F.array("head", "tail")).alias("name"))
        new = ahead.union(back).where("name <> ''").distinct().withColumn("_low", F.lower("name"))
        front = stash(new.join(reached.select("query_id", F.lower("name").alias("_low")), ["query_id", "_low"], "left_anti").select("query_id", "name", F.lit(depth).alias("depth")))
        reached = reached.unionByName(front)
    w = Window.partitionBy("query_id").orderBy("depth", "name")
    reached = stash(reached.groupBy("query_id", "name").agg(F.min("depth").alias("depth")).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most_names).drop("_i"))
    of = reached.groupBy("query_id").agg(F.collect_list(F.when(F.col("depth") == 0, F.col("name"))).alias("_seeds"), F.collect_list("name").alias("_all"))  # ``most_names`` at most
    asked = questions.select("query_id", "kind", "names")
    rows = edges.join(asked, "query_id").join(of, "query_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_seeds": F.coalesce("_seeds", none), "_all": F.coalesce("_all", none)})
    at = lambda end, names: F.exists(names, lambda n: q.same_name(F.col(end), n))
    rows = rows.withColumns({"_hs": at("head", "_seeds"), "_ts": at("tail", "_seeds"), "_x": at("head", "_all") | at("tail", "_all")})
    ends, paragraph = F.lower(F.concat_ws(" ", "head", "tail")), F.lower(F.coalesce("paragraph", F.lit("")))
    rows = rows.withColumn("_told", F.size(F.filter("names", lambda n: q.name_in(n, paragraph) | q.name_in(n, ends))))
    seeded = F.col("_hs") | F.col("_ts")
    told = F.col("_told")
    value = (
        F.when(seeded, F.when(told >= 2, 1.5).when(told >= 1, 1.35).otherwise(1.15) + F.when(F.col("_hs") & F.col("_ts"), 0.15).otherwise(0.0))
        .when(F.col("_x"), F.when(told >= 1, 1.05).otherwise(0.9))
        .otherwise(0.75)
    )
    kept = rows.where((F.size("_all") == 0) | seeded | F.col("_x")).select("query_id", "kind", "head", "relation", "tail", "idx", F.round(value, 9).alias("confidence"))
    kept = stash(kept)
    few = questions.select("query_id", "kind").join(kept.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").where(F.coalesce("_n", F.lit(0)) < 4)
    held = chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(few.select("query_id", "kind"), "query_id").join(of, "query_id").where(F.exists("_all", lambda n: q.name_in(n, F.lower("text")) | q.same_name(F.col("title"), n)))
    context = held.select("query_id", "kind", F.get("_all", 0).alias("head"), F.lit("context").alias("relation"), F.coalesce(text.blank_to_null(F.col("title")), F.col("source")).alias("tail"), "idx", F.lit(0.75).alias("confidence"))
    union = kept.unionByName(context)
    once = union.groupBy("query_id", "kind", "head", "relation", "tail").agg(F.max(F.struct("confidence", (-F.col("idx")).alias("i"))).alias("m"))
    out = once.select("query_id", "kind", "head", "relation", "tail", (-F.col("m.i")).alias("idx"), "m.confidence")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "idx", "head", "relation", "tail")))
    cap = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in LOCAL_CAPS.items()), F.lit(20))
    return ranked.where(F.col("rank") <= cap).drop("kind")


def injected_passages(found: DataFrame, chunks: DataFrame, units: int = 12, fallback: int = 8) -> DataFrame:
    """``query_id``, ``idx``, ``origin``, ``score``, ``position``: passages of the triples found, in order, 1 less 0.02 a place; a question with fewer than four also gets other passages of its own (0.55), ``fallback`` in all."""
    firsts = found.groupBy("query_id", "idx").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("query_id").orderBy("_r", "idx")
    own = stash(firsts.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= units).select("query_id", "idx", F.lit("unit").alias("origin"), F.round(1.0 - 0.02 * (F.col("_p") - 1), 9).alias("score"), "_p"))
    n = own.groupBy("query_id").agg(F.count("*").alias("_n"))
    rest = chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("query_id", "idx").join(own, ["query_id", "idx"], "left_anti").join(n, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < 4)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("idx")) + F.coalesce("_n", F.lit(0))
    more = rest.withColumn("_p", place).where(F.col("_p") <= fallback).select("query_id", "idx", F.lit("fallback").alias("origin"), F.lit(0.55).alias("score"), "_p")
    return own.unionByName(more).withColumnRenamed("_p", "position")


def promoted(hits: DataFrame, preferred: DataFrame) -> DataFrame:
    """``hits`` (query_id, idx, score, rank) with those in ``preferred`` (query_id, idx) in front, at 0.95 less 0.01 a place at least; ``position``."""
    marked = hits.join(preferred.select("query_id", "idx").distinct().withColumn("_p", F.lit(1)), ["query_id", "idx"], "left")
    front = F.col("_p").isNotNull()
    place = F.row_number().over(Window.partitionBy("query_id", front).orderBy("rank"))
    scored = marked.withColumn("score", F.when(front, F.greatest(F.col("score"), 0.95 - 0.01 * (place - 1))).otherwise(F.col("score")))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(front, 0).otherwise(1), "rank"))).drop("_p")
