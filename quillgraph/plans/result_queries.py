r"""Queries that put results together: channels, nested documents, logs, reports; and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunk, text
from ..operators import identity, metrics, results, scoped, training
from .catalogue import _BM25, _SENTENCES, _bm25
from .evaluation_queries import _DOCS, _HITS, _document_metrics
from .graph_queries import _RANKED, _named_questions, _triples, triples
from .registry import query, t
from .scoped_queries import _E9, _QS, _WORDS, _corpus, _questions


@query(f"WITH {_QS}, {_E9}, {_BM25.replace('{p}', _WORDS)} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, 'clause' AS channel FROM e9 UNION ALL SELECT query_id, doc_id, CAST(rank AS INTEGER), 'bm25' FROM bt WHERE query_id NOT IN (SELECT query_id FROM e9)")
def first_channel(spark, sf):
    """Named clauses where a question names some, else lexical hits."""
    clauses = scoped.by_clause(_questions(spark, sf), _corpus(spark, sf))
    return results.first_channel([("clause", clauses), ("bm25", _bm25(spark, sf, text.search_tokens))]).select("query_id", "doc_id", "rank", "channel")


_KEPT = _RANKED + ", kp AS (SELECT rk.query_id, rk.rank, tr.* FROM rk JOIN tr USING (tid) WHERE rk.rank <= CASE kind WHEN 'single' THEN 10 WHEN 'cross' THEN 20 ELSE 15 END)"


def _ranked(spark, sf):
    found = triples.rank_triples(_named_questions(spark, sf), _triples(spark, sf))
    return found.select("query_id", "triple_id", "rank").join(_triples(spark, sf), "triple_id")


@query(_KEPT + ", so AS (SELECT query_id, k, min(rank) AS r, count(DISTINCT para) AS p, count(*) AS n FROM kp GROUP BY ALL) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS INTEGER) AS place, CAST(p AS INTEGER) AS paragraphs, CAST(n AS BIGINT) AS triples FROM so")
def nested_results(spark, sf):
    """Triples of a question by source and paragraph: the size of each group, in order."""
    groups = results.nested(_ranked(spark, sf)).select("query_id", F.posexplode("groups").alias("place", "g"))
    return groups.select("query_id", "place", F.size("g.paragraphs").alias("paragraphs"), F.aggregate("g.paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.size(p["triples"])).alias("triples"))


@query(_KEPT + """, sg AS (SELECT query_id, k, min(rank) AS s FROM kp GROUP BY ALL), pg AS (SELECT query_id, k, para, min(rank) AS p FROM kp GROUP BY ALL),
fl AS (SELECT kp.query_id, doc_id, min(row(s, p, rank)) AS m FROM kp JOIN sg USING (query_id, k) JOIN pg USING (query_id, k, para) GROUP BY ALL)
SELECT query_id, doc_id || '' AS identity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m) AS INTEGER) AS position FROM fl""")
def flattened_results(spark, sf):
    """The evidence of nested results in their order, each once."""
    return results.flattened(results.nested(_ranked(spark, sf))).select("query_id", "identity", "position")


@query(f"""WITH {_QS}, {_BM25.replace('{p}', _WORDS)} SELECT query_id, kind AS type, count(doc_id) AS hits, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY rank)) AS hits_md5, CAST(any_value(query_id) / 10 AS DOUBLE) AS total FROM qs LEFT JOIN bt USING (query_id) GROUP BY query_id, kind""")
def result_documents(spark, sf):
    """One document for each question; here its type, its hits and its seconds."""
    questions = _questions(spark, sf)
    answers = questions.select("query_id", F.lit("").alias("answer"), F.array().cast("array<string>").alias("citations"), (F.col("query_id") / 20).alias("retrieval_seconds"), (F.col("query_id") / 20).alias("generation_seconds"))
    docs = results.documents(questions, _bm25(spark, sf, text.search_tokens), answers)
    hits = F.col("retrieval.vector_results")
    return docs.select("query_id", F.col("router.type").alias("type"), F.size(hits).cast("long").alias("hits"), F.md5(F.array_join(F.transform(hits, lambda x: x["doc_id"].cast("string")), ",").cast("binary")).alias("hits_md5"), F.col("performance.total").alias("total"))


@query("""WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT c_custkey, l.event_id, l.value FROM customer LEFT JOIN l ON user_id = c_custkey""")
def last_logs(spark, sf):
    """The last event of each customer, as a later log of a question replaces an earlier one."""
    logs = t(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return results.with_logs(t(spark, sf, "customer").select("c_custkey"), logs, "c_custkey", "at").select("c_custkey", "event_id", "value")


@query("SELECT doc_id, lang, coalesce(CAST(q.quality AS BIGINT), n_chars) AS n_chars, q.toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) q USING (doc_id)")
def patched_scores(spark, sf):
    """Labels merged into documents by id: one column replaces, the other comes along."""
    scores = t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("n_chars"), F.max("toxic").alias("toxic"))
    return results.patched(t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), scores, "doc_id")


@query(f"""{_HITS}, {_DOCS}, al_ AS (SELECT kind, coalesce(doc_hit_5, 0) AS h, coalesce(doc_mrr, 0) AS m FROM qs LEFT JOIN dm USING (query_id)), me AS (SELECT kind AS section, avg(h) AS h, avg(m) AS m FROM al_ GROUP BY 1 UNION ALL SELECT 'overall', avg(h), avg(m) FROM al_)
SELECT section, 'doc_hit_5' AS metric, round(h, 6) AS value FROM me UNION ALL SELECT section, 'doc_mrr', round(m, 6) FROM me""")
def report_lines(spark, sf):
    """Means by type and overall, a line each."""
    rows = identity.stash(metrics.per_question(_questions(spark, sf).select("query_id", "kind"), [_document_metrics(spark, sf)]))
    names = ["doc_hit_5", "doc_mrr"]
    means = metrics.means(rows, names, ["kind"]).unionByName(metrics.means(rows, names).withColumn("kind", F.lit(None).cast("string")))
    return results.report(means, names).select("section", "metric", F.round("value", 6).alias("value"))


@query(f"""{_HITS}, {_DOCS}, v AS (SELECT 'all' AS variant, coalesce(doc_hit_5, 0) AS h, coalesce(doc_mrr, 0) AS m FROM qs LEFT JOIN dm USING (query_id) UNION ALL SELECT 'scoped', coalesce(doc_hit_5, 0), coalesce(doc_mrr, 0) FROM qs LEFT JOIN dm USING (query_id) WHERE kind <> 'single')
SELECT variant, count(*) AS n, round(avg(h), 6) AS doc_hit_5, round(avg(m), 6) AS doc_mrr FROM v GROUP BY 1""")
def variant_table(spark, sf):
    rows = identity.stash(metrics.per_question(_questions(spark, sf).select("query_id", "kind"), [_document_metrics(spark, sf)]))
    out = results.variants([("all", rows), ("scoped", rows.where("kind <> 'single'"))], ["doc_hit_5", "doc_mrr"])
    return out.select("variant", "n", *(F.round(c, 6).alias(c) for c in ("doc_hit_5", "doc_mrr")))


@query("""WITH p AS (SELECT event_type, value AS total, CASE WHEN event_id % 3 <> 0 THEN value / 4 END AS generation FROM events)
SELECT event_type, count(*) AS n, round(avg(greatest(total - coalesce(generation, 0), 0)), 6) AS retrieval, round(avg(coalesce(generation, 0)), 6) AS generation, round(avg(total), 6) AS total FROM p GROUP BY 1""")
def latency_means(spark, sf):
    """Mean seconds by type; what isn't generation is retrieval."""
    e = t(spark, sf, "events").select("event_type", F.col("value").alias("total"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 4).alias("generation"), F.lit(None).cast("double").alias("retrieval"))
    out = results.latencies(e, ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("retrieval", "generation", "total")))


# Training pairs


@query("""WITH f AS (SELECT conv_id AS query_id, turn, trim(text) AS text, 'c' || conv_id || '.md' AS source FROM conversations WHERE role = 'assistant'), q AS (SELECT conv_id AS query_id, trim(arg_min(text, turn)) AS question FROM conversations GROUP BY 1)
SELECT query_id, md5(question) AS question_md5, source, md5(text) AS text_md5, min(turn) AS place FROM f JOIN q USING (query_id) WHERE length(text) >= 8 AND coalesce(question, '') <> '' GROUP BY query_id, question, source, text""")
def positive_pairs(spark, sf):
    """Supporting facts of each question, each once."""
    pairs = training.positives(_facts(spark, sf))
    return pairs.select("query_id", F.md5(F.col("question").cast("binary")).alias("question_md5"), "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), "place")


def _facts(spark, sf):
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", "text")
    first = c.groupBy("query_id").agg(F.min_by("text", "turn").alias("question"))
    facts = c.where("role = 'assistant'").select("query_id", "text", F.concat(F.lit("corpus/c"), F.col("query_id").cast("string"), F.lit(".md")).alias("source"), F.col("turn").alias("place"))
    return facts.join(first, "query_id").withColumn("side", F.lit(None).cast("int"))


@query(f"""WITH {_SENTENCES}, sq AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS part_index, sentence FROM se),
un AS (SELECT doc_id, part_index, source, sentence AS text FROM sq JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 0, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sq))
SELECT doc_id, part_index, md5(text) AS text_md5 FROM un WHERE length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) >= 12 QUALIFY row_number() OVER (PARTITION BY source, substr(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 1, 240) ORDER BY doc_id, part_index) = 1""")
def corpus_sentences(spark, sf):
    """Sentences of the corpus, each once for a source."""
    docs = t(spark, sf, "documents").select("doc_id", "source", "text")
    found = training.corpus_sentences(docs, identity.stash(chunk.sentences(docs, "doc_id", "text")))
    return found.select("doc_id", "part_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def positive_sentences(spark, sf):
    """Sentences of supporting facts; a test compares them with a plain version."""
    out = training.positive_sentences(training.positives(_facts(spark, sf)))
    return out.select("query_id", "source", "text")


@query()
def plain_markdown_clauses(spark, sf):
    """Clauses of pages read as Markdown; a test compares them with a plain version."""
    pages = t(spark, sf, "pages").select("page_id", training.markdown_clauses(F.col("html")).alias("c"))
    return pages.select("page_id", F.posexplode("c").alias("part_index", "clause"))


def _tiers(spark, sf):
    w = Window.partitionBy("source").orderBy("pos")
    c = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("source"), F.col("turn").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("v", scoped.default_embed(F.col("text")))
    return c.where((F.col("role") == "assistant") & (F.length("text") >= 8)).withColumn("query_id", F.col("doc_id")), c


@query()
def tiered_negatives(spark, sf):
    """Neighbours, similar rows of the source and rows of others; a test compares them with a plain version."""
    return training.tiered_negatives(*_tiers(spark, sf)).select("query_id", "doc_id", "origin", "rank")
