"""Metrics of retrieval, citations and answers, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity
from ..functions.text import CJK, same_document
from ..sources.files import stash


def at_k(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``query_id``, ``hit_k``, ``recall_k``, ``precision_k`` and ``mrr`` of every question with gold.

    ``retrieved``: query_id, key, rank; ``gold``: query_id, key. Repeated keys count at their first rank and ranks close up;
    the precision's denominator is the number of distinct keys in the top k.
    """
    w = Window.partitionBy("query_id").orderBy("rank", "key")
    ranked = retrieved.groupBy("query_id", "key").agg(F.min("rank").alias("rank")).withColumn("rank", F.row_number().over(w))
    gold = gold.select("query_id", "key").distinct()
    marked = ranked.join(gold.withColumn("good", F.lit(True)), ["query_id", "key"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    return flagged_at_k(marked, gold.groupBy("query_id").agg(F.count("*").alias("relevant")), ks)


def flagged_at_k(retrieved: DataFrame, totals: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The same from ``retrieved`` (query_id, key, rank, good) and ``totals`` (query_id, relevant): gold is counted, not listed."""
    w = Window.partitionBy("query_id").orderBy("rank", "key")
    ranked = retrieved.groupBy("query_id", "key").agg(F.min("rank").alias("rank"), F.max("good").alias("good")).withColumn("rank", F.row_number().over(w))
    aggs = [F.coalesce(F.max(F.when(F.col("good"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        aggs += [F.count_if((F.col("rank") <= k) & F.col("good")).alias(f"found_{k}"), F.count_if(F.col("rank") <= k).alias(f"shown_{k}")]
    joined = totals.join(ranked.groupBy("query_id").agg(*aggs), "query_id", "left").na.fill(0)
    shares = []
    for k in ks:
        found, shown = F.col(f"found_{k}"), F.col(f"shown_{k}")
        shares += [(found > 0).cast("double").alias(f"hit_{k}"), (found / F.col("relevant")).alias(f"recall_{k}"), F.when(shown > 0, found / shown).otherwise(0.0).alias(f"precision_{k}")]
    return joined.select("query_id", *shares, "mrr")


def set_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall, F1 and exact match of two sets; two empty ones agree."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    empty = (F.size(p) == 0) & (F.size(g) == 0)
    precision = F.when(empty, 1.0).when(F.size(p) > 0, both / F.size(p)).otherwise(0.0)
    recall = F.when(empty, 1.0).when(F.size(g) > 0, both / F.size(g)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    exact = F.when((F.size(p) == F.size(g)) & (both == F.size(p)), 1.0).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": f1, "exact": exact}


def token_scores(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """``key``, ``precision``, ``recall``, ``f1`` of token multisets from columns ``predicted`` and ``gold`` (arrays); both empty: 1.

    Rows of one key add up, so a long answer may come in parts; only counts of tokens are shuffled.
    """
    empty_ = F.array().cast("array<string>")
    counted = rows.select(key, F.posexplode_outer(F.array(*(F.coalesce(side, empty_) for side in ("predicted", "gold")))).alias("side", "tokens"))
    counted = counted.select(key, "side", F.explode_outer("tokens").alias("token")).groupBy(key, "token").agg(*(F.count_if((F.col("side") == i) & F.col("token").isNotNull()).alias(n) for i, n in enumerate("pg")))
    n = F.col("shared")
    sized = counted.groupBy(key).agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.least("p", "g")).alias("shared"))
    empty = (F.col("p") == 0) & (F.col("g") == 0)
    scored = sized.select(key, F.when(empty, 1.0).when(F.col("p") > 0, n / F.col("p")).otherwise(0.0).alias("precision"), F.when(empty, 1.0).when(F.col("g") > 0, n / F.col("g")).otherwise(0.0).alias("recall"))
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def penalised_accuracy(answer: Column, exact: Column) -> Column:
    return F.least(F.greatest(answer, F.lit(0.0)), F.lit(1.0)) * (exact == 1.0).cast("double")


def error_class(recall: Column, exact: Column, answer: Column, threshold: float = 0.8) -> Column:
    return F.when(recall < 1, "retrieval").when(exact < 1, "citation").when(answer < threshold, "generation").otherwise("none")


def normal_answer(c: Column) -> Column:
    """Lower case without citation marks, the phrase of refusal and punctuation; single blanks."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\[\d+\]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "unable to answer based on the provided information", " "), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def answer_score(predicted: Column, gold: Column) -> Column:
    """Short answers: 0 for a refusal; yes and no as words; 1 for containment; else F1 of token sets. Both are normalised."""
    p, g = normal_answer(predicted), normal_answer(gold)
    scores = set_scores(F.split(p, " "), F.split(g, " "))
    refusal = (p == "") | (g == "") | F.contains(F.lower(F.coalesce(predicted, F.lit(""))), F.lit("unable to answer"))
    word = F.when(F.array_contains(F.regexp_extract_all(p, F.lit(r"(?U)(\w+)"), 1), g), 1.0).otherwise(0.0)
    return F.when(refusal, 0.0).when(g.isin("yes", "no"), word).when(F.contains(p, g) | F.contains(g, p), 1.0).otherwise(scores["f1"])


def means(rows: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of every metric with missing ones as 0, and the number of rows."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names))


# Documents, paragraphs and standards


def document_metrics(retrieved: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``query_id``, ``doc_hit_k``, ``doc_recall_k``, ``doc_mrr`` and ``context_precision`` by names that mean one document.

    ``retrieved``: query_id, rank (from 1, without gaps), doc; ``relevant``: query_id, doc. Every question of either side has a
    row. Without relevant documents all are 0. Lists of a question are short: they were cut to a budget.
    """
    gold = relevant.select("query_id", F.col("doc").alias("_gold")).withColumn("_g", F.monotonically_increasing_id())
    pairs = stash(retrieved.select("query_id", "rank", "doc").join(gold, "query_id").where(same_document(F.col("doc"), F.col("_gold"))).select("query_id", "rank", "_g"))
    everyone = retrieved.select("query_id").union(relevant.select("query_id")).distinct()
    shown = retrieved.groupBy("query_id").agg(F.count("*").alias("_shown"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("_wanted"))
    firsts = pairs.groupBy("query_id", "_g").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"_found_{k}") for k in ks), F.min("rank").alias("_first"))
    good = pairs.select("query_id", "rank").distinct().groupBy("query_id").agg(F.count("*").alias("_good"))
    joined = everyone
    for part in (shown, wanted, firsts, good):
        joined = joined.join(part, "query_id", "left")
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    out = []
    for k in ks:
        out += [F.coalesce((F.col(f"_found_{k}") > 0).cast("double"), F.lit(0.0)).alias(f"doc_hit_{k}"), share(f"_found_{k}", "_wanted").alias(f"doc_recall_{k}")]
    return joined.select("query_id", *out, F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("doc_mrr"), share("_good", "_shown").alias("context_precision"))


def same_standard_metrics(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id``, ``same_std_recall_1``, ``same_std_mrr``, ``gold_all_in_context`` for questions with gold.

    ``retrieved``: query_id, rank, key, standard; ``gold``: query_id, key, standard. A gold clause is ranked among the retrieved ones
    of its standard (one name inside the other); if there are none, or it has no standard, among all.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\+", " "), r"\.md", "")))
    first = retrieved.where("key is not null").groupBy("query_id", "key").agg(F.min(F.struct("rank", "standard")).alias("m")).select("query_id", "key", "m.rank", name(F.col("m.standard")).alias("_std"))
    g = gold.where("key is not null").select("query_id", F.col("key").alias("_gold"), name(F.col("standard")).alias("_gstd")).withColumn("_g", F.monotonically_increasing_id())
    pairs = g.join(first, "query_id", "left")
    same = (F.col("_gstd") == "") | ((F.col("_std") != "") & (F.contains("_std", "_gstd") | F.contains("_gstd", "_std")))
    pairs = pairs.withColumn("_same", F.coalesce(same, F.lit(False)))
    of_gold = Window.partitionBy("query_id", "_g")
    pairs = pairs.withColumn("_any", F.max("_same").over(of_gold)).where("_same or not _any")
    placed = pairs.withColumn("_place", F.row_number().over(of_gold.orderBy("rank", "key")))
    hit = F.when(F.col("key") == F.col("_gold"), F.col("_place"))
    one = placed.groupBy("query_id", "_g").agg(F.min(hit).alias("_at"))
    return one.groupBy("query_id").agg(
        (F.count_if(F.col("_at") == 1) / F.count("*")).alias("same_std_recall_1"), (F.sum(F.coalesce(1.0 / F.col("_at"), F.lit(0.0))) / F.count("*")).alias("same_std_mrr")
    ).join(
        g.select("query_id", F.col("_gold").alias("key")).distinct().join(first.select("query_id", "key", F.lit(1).alias("_in")), ["query_id", "key"], "left").groupBy("query_id").agg((F.count("_in") == F.count("*")).cast("double").alias("gold_all_in_context")),
        "query_id",
    )


#: Words that say nothing about a paragraph.
GENERIC = ("根据", "标准", "要求", "规定", "进行", "采用", "设计", "检验", "试验", "应当", "应", "可", "或", "及", "与", "的", "和", "等", "下列", "以下")
#: Fixed value: codes of standards, which don't count for a match.
NAMED_STANDARD = r"(?i)(?:GB/T|GBT|GB|HB(?:/Z)?|HB_Z|GJB|QJ|SJ)[\s+]*[\d\-—－/.A-Za-z（）()]+"


def paragraph_tokens(c: Column) -> Column:
    """Set of words of two characters or more, CJK runs and, of runs of four or more, their pairs and triples; no codes, no numbers."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), NAMED_STANDARD, " ")
    words = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,}}|[A-Za-z0-9]{{2,}})"), 1)
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{4,}})"), 1)
    cut = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(cut(r, 2), cut(r, 3))))
    return F.filter(F.array_distinct(F.concat(words, grams)), lambda w: ~w.isin(*GENERIC) & ~F.regexp_like(w, F.lit(r"^\d+$")))


def same_paragraph(a: str, b: str, with_ratio: bool = True) -> Column:
    """Whether two paragraphs match, from columns ``{a}_tokens``, ``{b}_tokens`` and ``{a}_bare``, ``{b}_bare`` (texts without codes)."""
    x, y = F.col(f"{a}_tokens"), F.col(f"{b}_tokens")
    both = F.size(F.array_intersect(x, y))
    tokens = (both >= 3) & (both >= 0.35 * F.least(F.size(x), F.size(y)))
    known = (F.size(x) > 0) & (F.size(y) > 0)
    if not with_ratio:
        return known & tokens
    p, q = F.col(f"{a}_bare"), F.col(f"{b}_bare")
    # the ratio can't exceed what the lengths allow, and isn't asked where words decide
    possible = known & ~tokens & (2.0 * F.least(F.length(p), F.length(q)) >= 0.62 * (F.length(p) + F.length(q)))
    return known & (tokens | (similarity.sequence_ratio(F.when(possible, p), F.when(possible, q), popular_rule=True, least=0.62) >= 0.62))


def _paragraphs(df: DataFrame, side: str, *extra: str) -> DataFrame:
    return df.select("query_id", *extra, paragraph_tokens(F.col("text")).alias(f"{side}_tokens"), F.regexp_replace(F.coalesce("text", F.lit("")), NAMED_STANDARD, " ").alias(f"{side}_bare"))


def paragraph_metrics(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), with_ratio: bool = True) -> DataFrame:
    """``query_id``, ``para_hit_k``, ``para_recall_k`` of questions with gold, from (query_id, rank, text) and (query_id, text)."""
    g = _paragraphs(gold.withColumn("_g", F.monotonically_increasing_id()), "gold", "_g")
    pairs = g.join(_paragraphs(retrieved.where(F.col("rank") <= max(ks)), "got", "rank"), "query_id").where(same_paragraph("got", "gold", with_ratio))
    firsts = pairs.groupBy("query_id", "_g").agg(F.min("rank").alias("rank"))
    found = firsts.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"_found_{k}") for k in ks))
    joined = gold.groupBy("query_id").agg(F.count("*").alias("_wanted")).join(found, "query_id", "left").na.fill(0)
    return joined.select("query_id", *(c for k in ks for c in ((F.col(f"_found_{k}") > 0).cast("double").alias(f"para_hit_{k}"), (F.col(f"_found_{k}") / F.col("_wanted")).alias(f"para_recall_{k}"))))


def context_metrics(retrieved: DataFrame, gold: DataFrame, first: int = 5) -> DataFrame:
    """``query_id``, ``context_recall``, ``context_relevance``: the mean over gold texts of their best ratio with a retrieved text, and the mean over
    the first ``first`` retrieved texts of their best ratio with a gold one, codes apart. Without texts on a side: 0.

    Where no retrieved text of a question has more than 30 characters, they count as ids, and recall is the share of the
    distinct gold ones among them. Popular characters of the retrieved text start no block of a ratio.
    """
    of = lambda: similarity.sequence_ratio("_gold", "_got", popular_rule=True)
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), NAMED_STANDARD, " "))
    g = gold.select("query_id", F.col("text").alias("_gold"), F.monotonically_increasing_id().alias("_g"))
    r = retrieved.select("query_id", "rank", F.col("text").alias("_got"))
    pairs = stash(g.join(r, "query_id").select("query_id", "_g", "rank", "_gold", "_got"))
    ids = retrieved.groupBy("query_id").agg((F.max(F.length(F.coalesce("text", F.lit("")))) <= 30).alias("_ids"))
    texts = pairs.join(ids.where("not _ids"), "query_id", "left_semi")
    recall = texts.groupBy("query_id", "_g").agg(F.max(of()).alias("b")).groupBy("query_id").agg(F.sum("b").alias("_sum"))
    distinct = gold.select("query_id", F.coalesce("text", F.lit("")).alias("_id")).distinct().join(ids.where("_ids").select("query_id"), "query_id")
    known = retrieved.select("query_id", F.coalesce("text", F.lit("")).alias("_id"), F.lit(1).alias("_known")).distinct()
    shares = distinct.join(known, ["query_id", "_id"], "left").groupBy("query_id").agg((F.count("_known") / F.count("*")).alias("_share"))
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("_wanted"))
    spoken = pairs.withColumns({"_gold": bare(F.col("_gold")), "_got": bare(F.col("_got"))}).where("_gold <> '' and _got <> ''")
    best = spoken.groupBy("query_id", "rank").agg(F.max(of()).alias("b"))
    w = Window.partitionBy("query_id").orderBy("rank")
    relevance = best.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= first).groupBy("query_id").agg(F.avg("b").alias("_relevance"))
    joined = wanted.join(recall, "query_id", "left").join(shares, "query_id", "left").join(relevance, "query_id", "left")
    return joined.select("query_id", F.coalesce("_share", F.col("_sum") / F.col("_wanted"), F.lit(0.0)).alias("context_recall"), F.coalesce("_relevance", F.lit(0.0)).alias("context_relevance"))


def answer_entities(c: Column) -> Column:
    """Set of kinds of standards named with number and year, material codes and numbers of a text."""
    s = F.coalesce(c, F.lit(""))
    found = [F.regexp_extract_all(s, F.lit(p), 1) for p in (r"(HB|GB/T|GJB)\s*\d+[-\s]\d{4}", r"([A-Z]{2,}\d+[A-Z]*)", r"(\d+\.?\d*)")]
    return F.array_distinct(F.concat(*found))


def key_phrases(c: Column) -> Column:
    """Set of units of measured values, kinds of standards and material codes of a text."""
    s = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(s, F.lit(p), 1) for p in (r"\d+\.?\d*\s*(mm|MPa|℃|°C|g/cm³|kN|小时|分钟)", r"(HB|GB/T|GJB)\s*\d+[-\s]\d{4}", r"([A-Z]{2,}\d+[A-Z]*)"))))


def hallucination_rate(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``query_id``, ``hallucination_rate``: the share of an answer's entities that no retrieved text of its question holds; 0 without entities."""
    asked = answers.select("query_id", F.explode_outer(answer_entities(F.col("text"))).alias("entity"))
    known = retrieved.select("query_id", F.explode(answer_entities(F.col("text"))).alias("entity")).distinct().withColumn("_known", F.lit(1))
    joined = asked.join(known, ["query_id", "entity"], "left").groupBy("query_id").agg(F.count("entity").alias("n"), F.count("_known").alias("k"))
    return joined.select("query_id", F.when(F.col("n") > 0, (F.col("n") - F.col("k")) / F.col("n")).otherwise(0.0).alias("hallucination_rate"))


def per_question(questions: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One wide row for each question with the columns of all ``parts``; a question that a part misses has 0 there."""
    for part in parts:
        questions = questions.join(part, "query_id", "left")
    return questions.na.fill(0.0)


def means_with_coverage(rows: DataFrame, names: list[str], judge: str, by: list[str] | None = None) -> DataFrame:
    """Means with missing metrics as 0, the judge's mean over the rows it judged, and ``judge_coverage``, their share."""
    spoken = F.count(judge)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names), F.coalesce(F.avg(judge), F.lit(0.0)).alias(judge), (spoken / F.count("*")).alias("judge_coverage"))
