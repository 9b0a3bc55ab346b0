"""Results as tables: channels put together, nested documents, logs, reports, variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .rank import best_tier


def first_channel(channels: list[tuple[str, DataFrame]]) -> DataFrame:
    """``query_id``, ``doc_id``, ``rank``, ``channel``: the rows of the first channel that has any for a question."""
    parts = [df.select("query_id", "doc_id", "rank", F.lit(name).alias("channel"), F.lit(i).alias("_c")) for i, (name, df) in enumerate(channels)]
    return best_tier(reduce(DataFrame.unionByName, parts), F.col("_c")).drop("_c")


def nested(triples: DataFrame) -> DataFrame:
    """``query_id``, ``groups``: for each question its triples by source and paragraph, all in order of ``rank``.

    ``triples``: query_id, rank, source, paragraph, head, relation, tail, confidence, standard_id, clause_id, evidence_id. They were cut to the cap of
    the question's type, so a document holds few.
    """
    item = F.struct("rank", "head", "relation", "tail", "confidence", "standard_id", "clause_id", "evidence_id")
    ordered = lambda c: F.array_sort(F.collect_list(c))
    source = F.coalesce(text.blank_to_null(F.col("source")), F.lit("unknown"))
    paragraphs = triples.withColumns({"source": source, "paragraph": F.coalesce("paragraph", F.lit(""))}).groupBy("query_id", "source", "paragraph").agg(ordered(item).alias("triples"))
    of = paragraphs.withColumn("_first", F.get("triples", 0)["rank"]).groupBy("query_id", "source").agg(F.min("_first").alias("_first"), ordered(F.struct(F.col("_first").alias("first"), F.col("paragraph").alias("text"), F.col("triples"))).alias("paragraphs"))
    return of.groupBy("query_id").agg(ordered(F.struct(F.col("_first").alias("first"), F.col("source"), F.col("paragraphs"))).alias("groups"))


def flattened(nested_results: DataFrame) -> DataFrame:
    """``query_id``, ``identity``, ``position``, ``text``: the evidence of nested results in order, each identity once; triples without one drop."""
    groups = nested_results.select("query_id", F.posexplode("groups").alias("_g", "g"))
    paragraphs = groups.select("query_id", "_g", F.posexplode("g.paragraphs").alias("_p", "p"))
    rows = paragraphs.select("query_id", "_g", "_p", F.col("p.text").alias("text"), F.posexplode("p.triples").alias("_t", "x"))
    named = rows.withColumn("identity", text.identity(F.col("x.evidence_id"), F.col("x.standard_id"), F.col("x.clause_id"), F.lit(None).cast("string"))).where("identity is not null")
    first = named.groupBy("query_id", "identity").agg(F.min(F.struct("_g", "_p", "_t", "text")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m._g", "m._p", "m._t")
    return first.select("query_id", "identity", F.row_number().over(w).alias("position"), F.col("m.text").alias("text"))


def documents(questions: DataFrame, retrieved: DataFrame, answers: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """One document for each question: ``router``, ``retrieval``, ``generation`` and ``performance`` as structs.

    ``questions``: query_id, text, kind; ``retrieved``: query_id, rank, doc_id, score (within the budget); ``answers``: query_id, answer, citations,
    retrieval_seconds, generation_seconds.
    """
    hits = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("vector_results"))
    joined = questions.join(hits, "query_id", "left").join(answers, "query_id", "left")
    joined = joined.join(graph, "query_id", "left") if graph is not None else joined.withColumn("groups", F.lit(None))
    total = F.coalesce("retrieval_seconds", F.lit(0.0)) + F.coalesce("generation_seconds", F.lit(0.0))
    return joined.select(
        "query_id", F.col("text").alias("question"), F.struct(F.col("kind").alias("type")).alias("router"),
        F.struct(F.coalesce("vector_results", F.array().cast(hits.schema["vector_results"].dataType)).alias("vector_results"), F.col("groups").alias("kg_results")).alias("retrieval"),
        F.struct("answer", F.coalesce("citations", F.array().cast("array<string>")).alias("citations")).alias("generation"),
        F.struct(F.col("retrieval_seconds").alias("retrieval"), F.col("generation_seconds").alias("generation"), total.alias("total")).alias("performance"),
    )


def last_of(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Of rows with one key the last in ``order``: how a later answer to a question replaces an earlier one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def with_logs(evaluated: DataFrame, logs: DataFrame, key: str, order: str) -> DataFrame:
    """Evaluated rows with the last log of their ``key``, null where there is none."""
    return evaluated.join(last_of(logs, key, order), key, "left")


def newest(files: DataFrame) -> DataFrame:
    """Rows of the file whose name comes last; ``files`` has ``path``."""
    last = files.agg(F.max("path").alias("_last"))
    return files.join(F.broadcast(last), F.col("path") == F.col("_last"), "left_semi")


def patched(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``scores``, joined on the question's id; a column of both takes the score where there is one."""
    new = [c for c in scores.columns if c != key]
    joined = rows.join(scores.select(key, *(F.col(c).alias(f"_new_{c}") for c in new)), key, "left")
    out = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns]
    return joined.select(*out, *(F.col(f"_new_{c}").alias(c) for c in new if c not in rows.columns))


def report(means: DataFrame, names: list[str], by: str = "kind") -> DataFrame:
    """``section``, ``metric``, ``value``, ``line``: means of each type and overall (a null type), a Markdown line each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("p")
    rows = means.select(F.coalesce(F.col(by).cast("string"), F.lit("overall")).alias("section"), pairs).select("section", "p.metric", "p.value")
    return rows.withColumn("line", F.concat(F.lit("| "), "section", F.lit(" | "), "metric", F.lit(" | "), F.format_number("value", 4), F.lit(" |")))


def variants(results: list[tuple[str, DataFrame]], names: list[str]) -> DataFrame:
    """One row for each variant with the means of ``names`` over its questions."""
    parts = [df.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names)).select(F.lit(name).alias("variant"), "*") for name, df in results]
    return reduce(DataFrame.unionByName, parts)


def latencies(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean seconds of retrieval, generation and in all; a missing part is what the total leaves."""
    total = F.coalesce("total", F.coalesce("retrieval", F.lit(0.0)) + F.coalesce("generation", F.lit(0.0)))
    generation = F.coalesce("generation", F.lit(0.0))
    retrieval = F.coalesce("retrieval", F.greatest(total - generation, F.lit(0.0)))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(retrieval).alias("retrieval"), F.avg(generation).alias("generation"), F.avg(total).alias("total"))
