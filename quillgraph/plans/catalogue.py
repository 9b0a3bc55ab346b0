"""Registered queries over the given tables, each with its equivalent SQL where SQL can express it.

Roles of the tables: ``benchmark`` holds questions; ``documents`` and ``pages`` are corpora, ``documents.source`` is the scope a
standard has elsewhere; ``embeddings`` is the vector index with ``label`` as relevance, and searches ask with every vector
whose id is divisible by 50; ``conversations`` pair questions and answers; ``labels`` are gold categories.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunk, similarity, text
from ..operators import align, blocks, clauses, graph, identity, metrics, rank, retrieval, router, splits
from .registry import ORACLES, QUERIES, query, t

__all__ = ["ORACLES", "QUERIES"]

# Vector search

_COS = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, e.vec_id AS doc_id, q.label AS ql, e.label AS dl,
        round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score
      FROM q JOIN embeddings e ON e.vec_id <> query_id),
top AS (SELECT query_id, doc_id, ql, dl, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10)
"""
_SCOPED = _COS.replace("e.vec_id <> query_id", "e.vec_id <> query_id AND e.label = q.label")


def _vectors(spark, sf, scopes=False):
    e = t(spark, sf, "embeddings")
    extra = [F.col("label").alias("scope")] if scopes else []
    vectors = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), *extra)
    return vectors.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id"), vectors


def _dense(spark, sf, scopes=False):
    return retrieval.dense_top_k(*_vectors(spark, sf, scopes), 10, scopes)


def _labelled(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "label")
    ranked = _dense(spark, sf)
    ranked = ranked.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return ranked.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id")


@query(f"WITH {_COS} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top")
def dense_topk(spark, sf):
    return _dense(spark, sf).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_COS} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top WHERE score >= 0.2 AND rank <= 5")
def dense_threshold(spark, sf):
    return retrieval.thresholded(_dense(spark, sf), 0.2, F.lit(5)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_SCOPED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top")
def within_group_topk(spark, sf):
    return _dense(spark, sf, scopes=True).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_COS}, rel AS (SELECT q.query_id, count(*) AS relevant FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.query_id GROUP BY 1),
m AS (SELECT query_id, count(*) FILTER (rank <= 5 AND ql = dl) AS f5, count(*) FILTER (rank <= 5) AS s5,
        count(*) FILTER (ql = dl) AS f10, count(*) AS s10, coalesce(max(1.0 / rank) FILTER (ql = dl), 0) AS mrr FROM top GROUP BY 1)
SELECT query_id, CAST(f5 > 0 AS INTEGER)::DOUBLE AS hit_5, round(f5 / relevant, 6) AS recall_5, round(f5 / s5, 6) AS precision_5,
  CAST(f10 > 0 AS INTEGER)::DOUBLE AS hit_10, round(f10 / relevant, 6) AS recall_10, round(f10 / s10, 6) AS precision_10, round(mrr, 6) AS mrr
FROM rel JOIN m USING (query_id)""")
def retrieval_metrics(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "label")
    of_label = e.groupBy("label").agg((F.count("*") - 1).alias("relevant"))  # all but the query itself
    totals = e.where(F.col("vec_id") % 50 == 0).join(of_label, "label").where("relevant > 0").select(F.col("vec_id").alias("query_id"), "relevant")
    out = metrics.flagged_at_k(_labelled(spark, sf).select("query_id", F.col("doc_id").alias("key"), "rank", (F.col("ql") == F.col("dl")).alias("good")), totals, (5, 10))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"""WITH {_COS}, b AS (SELECT *, round(CASE WHEN ql = dl THEN greatest(score, 0) * 1.5 + least(score, 0) ELSE score END, 9) AS boosted,
  CASE ql % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'cross' ELSE 'correlation' END AS kind FROM top)
SELECT query_id, doc_id, kind, CAST(position AS INTEGER) AS position, round(boosted, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id) AS position FROM b)
WHERE position <= CASE kind WHEN 'single' THEN 3 WHEN 'cross' THEN 5 ELSE 8 END""")
def standard_boost_budget(spark, sf):
    kind = F.when(F.col("ql") % 3 == 0, "single").when(F.col("ql") % 3 == 1, "cross").otherwise("correlation")
    rows = _labelled(spark, sf).withColumns({"boosted": F.round(rank.boosted(F.col("score"), F.lit(0.0), F.col("ql") == F.col("dl")), 9), "kind": kind})
    kept = rank.within_budget(rows, "kind", "boosted", "doc_id", budgets={"single": 3, "cross": 5, "correlation": 8})
    return kept.select("query_id", "doc_id", "kind", "position", F.round("boosted", 6).alias("score"))


@query(f"""WITH {_COS}, x AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM top WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(0.7 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END + 0.3 * CASE WHEN n > 1 THEN 1 - (rank - 1) / (n - 1) ELSE 1.0 END, 6) AS mixed FROM x""")
def rerank_prior_mix(spark, sf):
    return rank.mixed_with_prior(_dense(spark, sf), 0.7).select("query_id", "doc_id", F.round("mixed", 6).alias("mixed"))


@query(f"""WITH {_COS} SELECT query_id, doc_id, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(ql = dl AS INTEGER) DESC, rank) AS position FROM top) WHERE position <= 6""")
def prioritise_matched(spark, sf):
    return rank.matched_first(_labelled(spark, sf), F.col("ql") == F.col("dl"), 6, "rank").select("query_id", "doc_id", "position")


@query(f"""WITH {_COS}, tiered AS (SELECT *, CASE WHEN ql = dl AND score >= 0.2 THEN 0 WHEN score >= 0.2 THEN 1 ELSE 2 END AS tier FROM top),
m AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM tiered)
SELECT query_id, doc_id FROM m WHERE tier = best""")
def tiered_preference(spark, sf):
    tier = F.when((F.col("ql") == F.col("dl")) & (F.col("score") >= 0.2), 0).when(F.col("score") >= 0.2, 1).otherwise(2)
    return rank.best_tier(_labelled(spark, sf), tier).select("query_id", "doc_id")


# Lexical search and fusion

_BM25 = """
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{p}')) AS token FROM benchmark),
qf AS (SELECT query_id, token, count(*) AS qf FROM qt GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{p}') AS tokens FROM documents),
z AS (SELECT doc_id, tokens, len(tokens) AS dl FROM d WHERE len(tokens) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM z),
p AS (SELECT token, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS token FROM z) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
i AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w) ELSE raw END AS idf FROM w),
bm AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM p JOIN i USING (token) JOIN qf USING (token), st GROUP BY ALL),
bt AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
       FROM bm WHERE round(score, 9) > 0) WHERE rank <= 20)
"""
_SEARCH = _BM25.replace("{p}", r"[\x{4e00}-\x{9fff}]|[a-z]+|[0-9]+(?:\.[0-9]+)*")
_ENGLISH = _BM25.replace("{p}", "[a-z0-9]+")


def _bm25(spark, sf, tokens):
    questions = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("tokens"))
    corpus = t(spark, sf, "documents").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return retrieval.bm25(questions, corpus, 20)


@query(f"WITH {_SEARCH} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM bt")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, text.search_tokens).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25.replace("{p}", "[A-Za-z0-9]+").replace("lower(text)", "text")}, al AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT item_id AS query_id FROM benchmark) CROSS JOIN z LEFT JOIN bm USING (query_id, doc_id))
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM al) WHERE rank <= 20""")
def bm25_with_zeros(spark, sf):
    """The baseline's variant: case counts, and documents that share nothing follow with a score of 0."""
    questions = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.mixed_tokens(F.col("text")).alias("tokens"))
    corpus = t(spark, sf, "documents").where(F.regexp_like("text", F.lit("[A-Za-z0-9]"))).select("doc_id", text.mixed_tokens(F.col("text")).alias("tokens"))
    return retrieval.bm25(questions, corpus, 20, zeros=True).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_ENGLISH} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM bt")
def bm25_english_topk(spark, sf):
    return _bm25(spark, sf, text.english_tokens).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_GRAMS = """
ng AS (SELECT item_id AS query_id, unnest(list_distinct([substr(c, i, 4) FOR i IN range(1, length(c) - 2)])) AS gram
       FROM (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z]+', '', 'g') AS c FROM benchmark) WHERE length(c) > 4),
na AS (SELECT query_id, count(*) AS asked FROM ng GROUP BY 1),
dg AS (SELECT doc_id, unnest(list_distinct([substr(c, i, 4) FOR i IN range(1, length(c) - 2)])) AS gram
       FROM (SELECT doc_id, regexp_replace(lower(text), '[^0-9a-z]+', '', 'g') AS c FROM documents) WHERE length(c) > 4),
nc AS (SELECT query_id, doc_id, count(*) / any_value(asked) AS score FROM ng JOIN na USING (query_id) JOIN dg USING (gram) GROUP BY ALL),
nt AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM nc) WHERE rank <= 20)
"""


def _plain(c):
    return F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")


def _containment(spark, sf):
    grams = lambda c: F.when(F.length(_plain(c)) > 4, text.char_ngrams(_plain(c)))
    questions = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), grams(F.col("text")).alias("grams"))
    corpus = t(spark, sf, "documents").select("doc_id", grams(F.col("text")).alias("grams"))
    return retrieval.ngram_containment(questions, corpus, 20)


@query(f"WITH {_GRAMS} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM nt")
def ngram_blocking(spark, sf):
    return _containment(spark, sf).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_RRF = f"""WITH {_SEARCH}, {_GRAMS}, u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part, 'bm25' AS channel FROM bt UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank), 'grams' FROM nt),
f AS (SELECT query_id, doc_id, CAST(sum(CAST(part AS DOUBLE)) AS DOUBLE) AS score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM u GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)"""


def _fused(spark, sf):
    fused = retrieval.reciprocal_rank_fusion([("bm25", _bm25(spark, sf, text.search_tokens)), ("grams", _containment(spark, sf))])
    return retrieval.top_k(fused, "query_id", 10)


@query(f"{_RRF} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, channels FROM fr WHERE rank <= 10")
def rrf_hybrid(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"))


@query(f"""{_RRF} SELECT query_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg('[' || rank || '] ' || d.source || ': ' || d.text, chr(10) ORDER BY rank)) AS context_md5
FROM fr JOIN documents d USING (doc_id) WHERE rank <= 10 GROUP BY 1""")
def context_render(spark, sf):
    """Numbered evidence of each question; texts join in only after ranking."""
    hits = _fused(spark, sf).select("query_id", "doc_id", "rank").join(t(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(": "), "text")
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))  # ten a question
    return gathered.select("query_id", F.size("lines").cast("long").alias("n"), F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n").cast("binary")).alias("context_md5"))


@query(f"""WITH {_SEARCH}, {_GRAMS}, u AS (SELECT query_id, doc_id, rank, 0 AS c FROM bt WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, rank, 1 FROM nt WHERE rank <= 5),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY c, rank) AS r FROM u) WHERE r = 1)
SELECT query_id, doc_id, CASE c WHEN 0 THEN 'bm25' ELSE 'grams' END AS channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c, rank, doc_id) AS INTEGER) AS position FROM k""")
def merge_channels(spark, sf):
    parts = [(name, df.where("rank <= 5").select("query_id", "doc_id", "rank")) for name, df in (("bm25", _bm25(spark, sf, text.search_tokens)), ("grams", _containment(spark, sf)))]
    return identity.merge_channels(parts, ["query_id", "doc_id"]).select("query_id", "doc_id", "channel", "position")


# Alignment


def _pairs_of_turns(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role", _plain(F.coalesce("text", F.lit(""))).alias("c"))
    paragraphs = c.where("role = 'user'").select(F.col("conv_id").alias("source"), F.col("turn").alias("pid"), F.col("c").alias("p_text"))
    return paragraphs, c.where("role = 'assistant'").select(F.col("conv_id").alias("source"), F.col("turn").alias("cid"), F.col("c").alias("c_text"))


_ALIGN = """WITH c AS (SELECT conv_id AS source, turn, role, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', '', 'g') AS c FROM conversations),
g AS (SELECT *, CASE WHEN length(c) = 0 THEN [] WHEN length(c) <= 4 THEN [c] ELSE list_distinct([substr(c, i, 4) FOR i IN range(1, length(c) - 2)]) END AS grams FROM c),
pr AS (SELECT p.source, p.turn AS pid, k.turn AS cid, p.c AS gold, k.c AS clause, len(list_intersect(p.grams, k.grams)) AS shared, len(p.grams) AS ng, len(k.grams) AS nk
  FROM g p JOIN g k ON p.source = k.source AND p.role = 'user' AND k.role = 'assistant'),
fi AS (SELECT *, (contains(gold, clause) OR contains(clause, gold)) AS inside, row_number() OVER (PARTITION BY source, pid ORDER BY shared DESC, cid) AS r
  FROM pr WHERE shared > 0 OR ((contains(gold, clause) OR contains(clause, gold)) AND (length(gold) BETWEEN 1 AND 3 OR length(clause) BETWEEN 1 AND 3))),
f AS (SELECT *, shared / greatest(ng, 1) AS rec, shared / greatest(nk, 1) AS prec, least(length(gold), length(clause)) / greatest(length(gold), length(clause)) AS cover FROM fi WHERE r <= 12 OR inside),
s AS (SELECT *, round(CASE WHEN gold = '' OR clause = '' THEN 0.0 WHEN contains(clause, gold) THEN 0.92 + 0.08 * cover WHEN contains(gold, clause) THEN least(0.91, 0.72 + 0.19 * cover)
    ELSE 0.72 * rec + 0.18 * CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END END, 9) AS sc FROM f),
x AS (SELECT *, row_number() OVER w AS k, coalesce(lead(sc) OVER w, 0) AS runner FROM s WINDOW w AS (PARTITION BY source, pid ORDER BY sc DESC, cid)),
a AS (SELECT source, pid, cid, sc AS score, runner, round(sc - runner, 9) AS margin FROM x WHERE k = 1),
al AS (SELECT *, CASE WHEN score >= 0.90 AND margin >= 0.02 THEN 'accepted_high' WHEN score >= 0.65 AND margin >= 0.01 THEN 'accepted_medium' ELSE 'needs_review' END AS status FROM a)
"""


def _aligned(spark, sf):
    paragraphs, answers = _pairs_of_turns(spark, sf)
    pairs = align.candidates(paragraphs, answers)
    value, method = align.score(F.col("p_text"), F.col("c_text"), counted=align.COUNTED)
    return align.best_with_margin(pairs.withColumns({"score": value, "method": method}), ["source", "pid"], align.GRAPH_GATES)


@query(_ALIGN + "SELECT source, pid, cid, round(score, 6) AS score, round(runner, 6) AS runner_up_score, round(margin, 6) AS margin, status FROM al")
def alignment_argmax_margin(spark, sf):
    return _aligned(spark, sf).select("source", "pid", "cid", *(F.round(c, 6).alias(c) for c in ("score", "runner_up_score", "margin")), "status")


@query(_ALIGN + "SELECT status, count(*) AS n FROM al GROUP BY 1")
def alignment_status_counts(spark, sf):
    return _aligned(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query()
def alignment_with_sequence_ratio(spark, sf):
    """The full score, with the ratio of matching blocks of the first 4,000 and 8,000 characters as the rule has it."""
    paragraphs, answers = _pairs_of_turns(spark, sf)
    pairs = align.candidates(paragraphs, answers).withColumn("ratio", similarity.sequence_ratio(F.substring("p_text", 1, 4000), F.substring("c_text", 1, 8000)))
    value, method = align.score(F.col("p_text"), F.col("c_text"), F.col("ratio"), counted=align.COUNTED)
    best = align.best_with_margin(pairs.withColumns({"score": value, "method": method}), ["source", "pid"], align.ANSWER_GATES)
    return best.select("source", "pid", "cid", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "method", "status")


# Text


@query("""SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS part_index, CAST(len(chunks) AS INTEGER) AS part_count, unnest(chunks) AS chunk FROM (
  SELECT doc_id, [substr(text, i, 1200) FOR i IN range(1, greatest(length(text) - 120, 1) + 1, 1080)] AS chunks FROM documents WHERE length(text) > 0)""")
def chunk_fixed_stride(spark, sf):
    chunks = t(spark, sf, "documents").select("doc_id", chunk.fixed_chunks(F.col("text"), 1200, 120).alias("chunks"))
    return chunks.select("doc_id", F.size("chunks").alias("part_count"), F.posexplode("chunks").alias("part_index", "chunk"))


def _cuts(size: int, overlap: int, half: int) -> str:
    """Chunks of texts without CJK marks: the window's last line break in its second half ends a chunk."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, 0 AS i, 0 AS b, CASE WHEN length(t) <= {size} THEN length(t) ELSE coalesce(nullif(CASE WHEN length(regexp_extract(substr(t, 1, {size}), '^(?s:.*)\n')) >= {half} THEN length(regexp_extract(substr(t, 1, {size}), '^(?s:.*)\n')) END, 0), {size}) END AS e FROM d WHERE t <> ''
  UNION ALL SELECT doc_id, i + 1, nb, CASE WHEN nb + {size} >= n THEN n WHEN length(regexp_extract(substr(t, nb + 1, {size}), '^(?s:.*)\n')) >= {half} THEN nb + length(regexp_extract(substr(t, nb + 1, {size}), '^(?s:.*)\n')) ELSE nb + {size} END
  FROM (SELECT doc_id, i, greatest(b + 1, e - {overlap}) AS nb, length(t) AS n, t FROM c JOIN d USING (doc_id) WHERE e < length(t))),
p AS (SELECT doc_id, i, regexp_replace(substr(t, b + 1, e - b), '^\\s+|\\s+$', '', 'g') AS chunk FROM c JOIN d USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS part_index, chunk FROM p WHERE chunk <> ''"""


@query(_cuts(1500, 100, 750))
def chunk_boundary(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.posexplode(chunk.boundary_chunks(F.col("text"))).alias("part_index", "chunk"))


@query("WITH x AS (" + _cuts(1200, 120, 601) + ") SELECT *, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS part_count, row_number() OVER (ORDER BY doc_id, part_index) - 1 AS global_index FROM x")
def chunk_ordinals(spark, sf):
    """Chunks of clauses with their place in their text and in the whole corpus."""
    d = t(spark, sf, "documents")
    return chunk.placed_chunks(d, chunk.clause_chunks(F.col("text")), ["doc_id"], ["doc_id"]).select("doc_id", "part_index", "part_count", "global_index", "chunk")


_SENTENCES = r"""q AS (SELECT doc_id, text, string_split(text, '$$') AS m, len(string_split(text, '$$')) - CASE WHEN len(string_split(text, '$$')) % 2 = 0 THEN 1 ELSE 0 END AS closed FROM documents),
v AS (SELECT doc_id, flatten([CASE WHEN i % 2 = 0 THEN ['$$' || m[i] || '$$'] ELSE string_split(regexp_replace(regexp_replace(replace(CASE WHEN i = closed AND len(m) % 2 = 0 THEN m[i] || '$$' || m[i + 1] ELSE m[i] END, '##', chr(10) || '##'), '([;\n])', '\1' || chr(1), 'g'), chr(1) || '+', chr(1), 'g'), chr(1)) END FOR i IN range(1, closed + 1)]) AS parts FROM q),
sp AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, regexp_replace(regexp_replace(regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g'), '^#{1,4}\s*', ''), '^\s+|\s+$', '', 'g') AS s FROM v),
g AS (SELECT doc_id, pos, s, regexp_replace(s, '\s+', '', 'g') AS z FROM sp),
k AS (SELECT * FROM g WHERE length(s) >= 12 AND length(z) BETWEEN 12 AND CASE WHEN regexp_matches(s, '\$\$(?s:.){6,}\$\$|\$[^$]{8,}\$') THEN 900 ELSE 480 END AND NOT (regexp_matches(s, '\\mathrm|\\frac|\$\s*\\') AND NOT regexp_matches(s, '\$\$|式中|='))
  AND NOT regexp_matches(s, '(?i)Requirements\s+for|ARINC\s*\d+|Air\s+transport\s+avionics') AND NOT regexp_matches(z, 'HB[xX]{2,}')),
o AS (SELECT doc_id, z, min(pos) AS pos, arg_min(s, pos) AS sentence FROM k GROUP BY ALL),
sw AS (SELECT doc_id, 0 AS pos, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS sentence FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o)),
se AS (SELECT doc_id, pos, sentence FROM o UNION ALL SELECT doc_id, pos, sentence FROM sw WHERE length(regexp_replace(sentence, '\s+', '', 'g')) BETWEEN 12 AND 480
  AND NOT regexp_matches(sentence, '(?i)Requirements\s+for|ARINC\s*\d+|Air\s+transport\s+avionics'))"""


@query(f"WITH {_SENTENCES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS part_index, sentence FROM se")
def sentence_split(spark, sf):
    """Evidence sentences; the texts hold no CJK, whose rules tests check."""
    return chunk.sentences(t(spark, sf, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+')) AS INTEGER) AS mixed,
  CAST(len(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[a-z]+|[0-9]+(?:\.[0-9]+)*')) AS INTEGER) AS search, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS english
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]')""")
def token_counts(spark, sf):
    d = t(spark, sf, "documents").where(F.regexp_like("text", F.lit("[A-Za-z0-9]")))
    return d.select("doc_id", *(F.size(f(F.col("text"))).alias(n) for n, f in (("mixed", text.mixed_tokens), ("search", text.search_tokens), ("english", text.english_tokens))))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(html), '<[^>]+>', ' ', 'g'), '\\[a-zA-Z]+', '', 'g'), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g')) AS compact_md5 FROM pages""")
def compact_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(text.compact(F.col("html")).cast("binary")).alias("compact_md5"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_replace(text, '\s+', '', 'g') AS z FROM documents)
SELECT doc_id, round(len(regexp_extract_all(text, '(?i)(?:HB|GB/T|GBT|GB|GJB|QJ)\s*\d')) / greatest(1.0, length(z) / 40.0), 6) AS density,
  regexp_matches(text, '\$\$(?s:.){6,}\$\$|\$[^$]{8,}\$|式中|[ηη]\s*=|\\eta\s*\{?\s*=') AS formula,
  length(z) >= 12 AND length(trim(substr(text, 1, 480))) >= 8 AND NOT regexp_matches(text, '(?i)Requirements\s+for|ARINC\s*\d+|Air\s+transport\s+avionics')
    AND len(regexp_extract_all(text, '(?i)(?:HB|GB/T|GBT|GB|GJB|QJ)\s*\d')) / greatest(1.0, length(z) / 40.0) < 0.42
    AND NOT (regexp_matches(substr(text, 1, 480), '\\mathrm|\\frac|\$\s*\\') AND NOT regexp_matches(substr(text, 1, 480), '\$\$|式中|=')) AS usable
FROM s""")
def quality_filters(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", F.round(text.reference_density(c), 6).alias("density"), text.has_formula(c).alias("formula"), text.quality_ok(c).alias("usable"))


_NAME = "'GB/T ' || (o_orderkey % 90000 + 10) || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '.' || (o_custkey % 5) END || '-' || year(o_orderdate)"


@query(f"""WITH n AS (SELECT o_orderkey, {_NAME} AS name, (o_orderkey % 90000 + 10) || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '_' || (o_custkey % 5) END || '-' || year(o_orderdate) || '-gbt-e-300.md' AS file FROM orders)
SELECT o_orderkey, regexp_replace(name, 'GB/T (\\d+)(?:\\.(\\d+))?-(\\d+)', 'gbt:\\1:\\2:\\3') AS comparison_id, true AS same FROM n""".replace("\\\\", "\\"))
def standard_ids(spark, sf):
    """Display names and file names of one standard meet in one comparison id."""
    o = t(spark, sf, "orders")
    part = lambda mark: F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(mark), (F.col("o_custkey") % 5).cast("string")))
    number, year = (F.col("o_orderkey") % 90000 + 10).cast("string"), F.year("o_orderdate").cast("string")
    names = o.select("o_orderkey", F.concat(F.lit("GB/T "), number, part("."), F.lit("-"), year).alias("name"), F.concat(number, part("_"), F.lit("-"), year, F.lit("-gbt-e-300.md")).alias("file"))
    return names.select("o_orderkey", text.comparison_id(F.col("name")).alias("comparison_id"), text.same_document(F.col("name"), F.col("file")).alias("same"))


@query("""SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_parse_props(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", "user_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT event_id, CAST(2 AS INTEGER) AS n, props AS first FROM events""")
def llm_json_repair(spark, sf):
    """Damaged replies made of event properties: thinking, a trailing comma, a cut-off last object."""
    reply = F.concat(F.lit("<think>[1]</think> ["), "props", F.lit(", "), F.regexp_replace("props", "}$", ",}"), F.lit(', {"k": '))
    found = t(spark, sf, "events").select("event_id", text.salvage_objects(reply).alias("objects"))
    return found.select("event_id", F.size("objects").alias("n"), F.get("objects", 0).alias("first"))


# Entities and graphs

_ENT = r"""WITH m AS (SELECT doc_id, source, regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_''.-]*(?:\s+(?:of|the|and|de|[A-Z][A-Za-z0-9_''.-]*)){0,5})', 1) AS f FROM documents),
l AS (SELECT doc_id, source, [regexp_replace(regexp_replace(x, '^[ ,.;:()]+', ''), '[ ,.;:()]+$', '') FOR x IN f IF length(trim(x)) >= 3] AS names FROM m),
n AS (SELECT doc_id, source, names, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM l),
o AS (SELECT doc_id, source, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS pos FROM n GROUP BY doc_id, source, name),
e AS (SELECT * FROM o WHERE pos <= 32)
"""


def _entities(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", "source", text.capitalised_phrases(F.lit(""), F.col("text")).alias("names"))


@query(_ENT + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, name FROM e")
def entity_extract(spark, sf):
    return _entities(spark, sf).select("doc_id", F.posexplode("names").alias("p", "name")).select("doc_id", (F.col("p") + 1).alias("pos"), "name")


@query(_ENT + "SELECT name, doc_id // 4096 AS block, count(DISTINCT doc_id) AS n, md5(array_to_string(list_sort(list(DISTINCT doc_id)), ',')) AS units_md5 FROM e GROUP BY ALL")
def inverted_index(spark, sf):
    found = graph.postings(_entities(spark, sf).select(F.col("doc_id").alias("unit"), F.explode("names").alias("name")))
    return found.select("name", "block", F.size("units").cast("long").alias("n"), F.md5(F.array_join(F.transform("units", lambda x: x.cast("string")), ",").cast("binary")).alias("units_md5"))


_EDGES = _ENT + ", h AS (SELECT doc_id, name AS head FROM e WHERE pos = 1), g AS (SELECT DISTINCT head, name AS tail, doc_id FROM h JOIN e USING (doc_id) WHERE pos BETWEEN 2 AND 12)"


def _edges(spark, sf):
    return graph.cooccurrence(_entities(spark, sf).select(F.col("doc_id").alias("unit"), "names"))


@query(_EDGES + " SELECT head, tail, doc_id FROM g")
def cooccurrence_edges(spark, sf):
    return _edges(spark, sf).select("head", "tail", F.col("unit").alias("doc_id"))


@query(_ENT + """, ev AS (SELECT name, 'evidence' AS field, doc_id::VARCHAR AS id, min(doc_id) AS p FROM e GROUP BY ALL UNION ALL SELECT name, 'standard', source, min(doc_id) FROM e WHERE source IS NOT NULL GROUP BY ALL)
SELECT substr(sha256(name), 1, 16) AS entity_id, name, field, p // 4096 AS block, string_agg(id, ',' ORDER BY p, id) AS ids FROM ev GROUP BY ALL""")
def entity_rollup(spark, sf):
    mentions = _entities(spark, sf).select(F.explode("names").alias("name"), F.col("doc_id").alias("evidence"), F.col("source").alias("standard"), F.col("doc_id").alias("pos"))
    return graph.entity_rollup(mentions).select("entity_id", "name", "field", "block", F.array_join("ids", ",").alias("ids"))


_PLACES = """ed AS (SELECT 's' || s_suppkey AS head, 'n' || s_nationkey AS tail FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
bo AS (SELECT head AS a, tail AS b FROM ed UNION SELECT tail, head FROM ed)"""


def _places(spark, sf):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return t(spark, sf, "supplier").select(tag("s", "s_suppkey").alias("head"), tag("n", "s_nationkey").alias("tail")).union(t(spark, sf, "nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))


@query(f"""WITH RECURSIVE {_PLACES}, w AS (SELECT r_regionkey AS query_id, 'r' || r_regionkey AS node, 0 AS depth FROM region
  UNION SELECT query_id, b, depth + 1 FROM w JOIN bo ON a = node WHERE depth < 2)
SELECT CAST(query_id AS BIGINT) AS query_id, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL""")
def graph_two_hops(spark, sf):
    seeds = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.expand(_places(spark, sf), seeds, 2)


_TRIPLES = _EDGES + r""", q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark), qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
c AS (SELECT head, tail, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS n FROM g GROUP BY ALL),
fp AS (SELECT item_id AS query_id, token, min(i) AS place FROM (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)) GROUP BY ALL),
pl AS (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM fp),
hit AS (SELECT query_id, head, tail, doc_id, c.n, max(CASE WHEN lower(head) = token THEN 0.5 * (1 - (place - 1) / qn.n) ELSE 0.0 END) AS early, count(*) / any_value(qn.n) AS lexical FROM (
  SELECT head, tail, doc_id, n, unnest(list_distinct(regexp_extract_all(lower(head || ' ' || tail), '[a-z0-9]+'))) AS token FROM c) c JOIN q USING (token) JOIN qn USING (query_id) JOIN pl USING (query_id, token) GROUP BY ALL),
sc AS (SELECT *, 1.5 * lexical + early + 0.05 * least(n / 10.0, 1.0) AS score, CASE query_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'cross' ELSE 'correlation' END AS kind FROM hit),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, head, tail) AS rank FROM sc)
SELECT query_id, head, tail, kind, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= CASE kind WHEN 'single' THEN 10 WHEN 'cross' THEN 20 ELSE 15 END"""


@query(_TRIPLES)
def triple_score_rank(spark, sf):
    """Triples by the words they share with a question, how early it names their head, and how often they occur; capped by type."""
    edges = _edges(spark, sf).groupBy("head", "tail").agg(F.count_distinct("unit").alias("n"))
    # a head named by the question is an item of its own, so that products of weights give the whole score
    rows = edges.select(
        F.concat("head", F.lit("\x00"), "tail").alias("doc_id"), F.concat(F.array_distinct(text.english_tokens(F.concat_ws(" ", "head", "tail"))), F.array(F.concat(F.lit("^"), F.lower("head")))).alias("items"),
        F.lit(0.0).alias("size"), (0.05 * F.least(F.col("n") / 10.0, F.lit(1.0))).alias("bonus"),
    )
    words = F.array_distinct(text.english_tokens(F.col("text")))
    n = F.size("w")
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).where(n > 0)
    asked = asked.select(
        "query_id", F.concat("w", F.transform("w", lambda x: F.concat(F.lit("^"), x))).alias("items"),
        F.concat(F.transform("w", lambda x: 1.5 / n), F.transform("w", lambda x, i: 0.5 * (1 - i / n))).alias("weights"), F.lit(1.0).alias("parts"),
    )
    found = blocks.top_k(asked, rows, 20)
    kind = F.when(F.col("query_id") % 3 == 0, "single").when(F.col("query_id") % 3 == 1, "cross").otherwise("correlation")
    pair = F.split("doc_id", "\x00")
    kept = found.withColumn("kind", kind).where(F.col("rank") <= F.when(F.col("kind") == "single", 10).when(F.col("kind") == "cross", 20).otherwise(15))
    return kept.select("query_id", pair[0].alias("head"), pair[1].alias("tail"), "kind", F.round("score", 6).alias("score"), "rank")


# Identity


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents WHERE trim(text) <> '') WHERE r = 1")
def keep_longest(spark, sf):
    return identity.keep_longest(t(spark, sf, "documents"), ["source", "lang"], "text", "doc_id").select("source", "lang", "doc_id")


@query(r"""SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY least(length(text), 6000)
  - CASE WHEN regexp_matches(text, '目次|目录|(?i:table of contents)') THEN 1200 ELSE 0 END - least(800, 80 * len(regexp_extract_all(text, '…|\.{4,}'))) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def keep_best_quality(spark, sf):
    return identity.keep_best(t(spark, sf, "documents"), ["source", "lang"], identity.clause_quality(F.col("text")), "doc_id").select("source", "lang", "doc_id")


@query("""WITH c AS (SELECT doc_id, source, lang, text, length(text) AS n FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)),
a AS (SELECT doc_id, max(row(n, doc_id, text)) AS m FROM c GROUP BY 1), b AS (SELECT source, lang, max(row(n, doc_id, text)) AS m FROM c GROUP BY ALL)
SELECT d.doc_id, CAST(CASE WHEN a.m IS NOT NULL THEN 1 WHEN b.m IS NOT NULL THEN 2 END AS INTEGER) AS tier, md5(coalesce(a.m[3], b.m[3])) AS text_md5
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b ON b.source = d.source AND b.lang = d.lang""")
def identity_lookup_tiers(spark, sf):
    """Each document's text by its id, else by source and language, from the documents that have a label."""
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    labelled = d.join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    found = identity.three_tier_lookup(d.drop("text"), labelled, [["doc_id"], ["source", "lang"]], "text", "doc_id")
    return found.select("doc_id", "tier", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ',') AS around FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf, "conversations")
    around = F.array_join(F.transform(F.collect_list("turn").over(w.rowsBetween(-1, 1)), lambda x: x.cast("string")), ",")
    return c.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"), around.alias("around"))


_CLAUSES = r"""ln AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
hd AS (SELECT *, length(line) % 3 + 1 AS k, repeat('#', CAST(length(line) % 3 + 1 AS INTEGER)) || ' ' || i || '.' || (length(line) % 3 + 1) || ' Part' AS head FROM ln),
st AS (SELECT *, coalesce(sum(length(head) + length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset, i || '.' || k || ' Part' AS name FROM hd),
an AS (SELECT *, last_value(CASE WHEN k <= 1 THEN name END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN k <= 2 THEN struct_pack(k := k, n := name) END IGNORE NULLS) OVER w AS a2,
  lead(start_offset) OVER w AS nx FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cl AS (SELECT doc_id, 'HB+' || doc_id || '-2013.md' AS source, 'HB ' || doc_id || '-2013' AS standard_id, i || '.' || k AS clause_id, 'Part' AS clause_title,
  CASE WHEN k > 1 AND a1 IS NOT NULL THEN a1 || ' / ' ELSE '' END || CASE WHEN k > 2 AND a2.k = 2 THEN a2.n || ' / ' ELSE '' END || name AS clause_path, CAST(start_offset AS BIGINT) AS start_offset,
  CAST(coalesce(nx, start_offset + length(head) + 1 + length(line)) AS BIGINT) AS end_offset, regexp_replace(head || chr(10) || line, '\s+$', '') AS raw_text FROM an)"""


def _clauses(spark, sf):
    """Clauses of documents read as Markdown: each line gets a numbered heading of one of three levels."""
    line = lambda x, i: F.concat(F.repeat(F.lit("#"), F.length(x) % 3 + 1), F.lit(" "), (i + 1).cast("string"), F.lit("."), (F.length(x) % 3 + 1).cast("string"), F.lit(" Part\n"), x)
    docs = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("HB+"), F.col("doc_id").cast("string"), F.lit("-2013.md")).alias("source"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return clauses.parse(docs, key="doc_id")


@query(f"WITH {_CLAUSES} SELECT doc_id, clause_id, clause_title, clause_path, start_offset, end_offset, 'ev_' || substr(sha256(standard_id || '|' || clause_id || '|clause-v1'), 1, 20) AS evidence_id, md5(raw_text) AS raw_md5 FROM cl")
def markdown_clauses(spark, sf):
    return _clauses(spark, sf).select("doc_id", "clause_id", "clause_title", F.array_join("clause_path", " / ").alias("clause_path"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), "evidence_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"))


# Answers and evaluation

_TURNS = """c AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) FILTER (role = 'user') AS u, string_agg(coalesce(text, ''), ' ' ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)"""


def _sides(spark, sf):
    """User and assistant text of each conversation; turns of a conversation are few."""
    side = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("x"))))), lambda s: s["x"]), " ")
    return t(spark, sf, "conversations").groupBy("conv_id").agg(side("user").alias("u"), side("assistant").alias("a"))


@query(rf"""WITH {_TURNS}, x AS (SELECT conv_id, regexp_extract_all(lower(coalesce(u, '')), '[a-z0-9]+') AS g, regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9]+') AS p FROM c),
pt AS (SELECT conv_id, token, count(*) AS k FROM (SELECT conv_id, unnest(p) AS token FROM x) GROUP BY ALL), gt AS (SELECT conv_id, token, count(*) AS k FROM (SELECT conv_id, unnest(g) AS token FROM x) GROUP BY ALL),
s AS (SELECT conv_id, sum(least(pt.k, gt.k)) AS shared FROM pt JOIN gt USING (conv_id, token) GROUP BY 1),
r AS (SELECT conv_id, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) > 0 THEN coalesce(shared, 0) / len(p) ELSE 0.0 END AS pr, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(g) > 0 THEN coalesce(shared, 0) / len(g) ELSE 0.0 END AS re FROM x LEFT JOIN s USING (conv_id))
SELECT conv_id AS query_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r""")
def token_f1(spark, sf):
    turns = t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), text.english_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), "role")
    out = metrics.token_scores(turns.select("query_id", *(F.when(F.col("role") == role, F.col("tokens")).otherwise(F.array().cast("array<string>")).alias(side) for role, side in (("assistant", "predicted"), ("user", "gold")))))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_CITES = f"""WITH {_SEARCH}, {_GRAMS}, pv AS (SELECT query_id, list(DISTINCT source) AS p0 FROM bt JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1), gv AS (SELECT query_id, list(DISTINCT source) AS g0 FROM nt JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1),
cw AS (SELECT item_id AS query_id, coalesce(p0, []) AS p, coalesce(g0, []) AS g FROM benchmark LEFT JOIN pv ON pv.query_id = item_id LEFT JOIN gv ON gv.query_id = item_id), k AS (SELECT *, len(list_intersect(p, g)) AS b FROM cw),
s AS (SELECT query_id, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) > 0 THEN b / len(p) ELSE 0 END AS precision, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(g) > 0 THEN b / len(g) ELSE 0 END AS recall,
  CASE WHEN len(p) = len(g) AND b = len(p) THEN 1.0 ELSE 0.0 END AS exact FROM k),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)
"""


def _citations(spark, sf):
    """Sources of the five best lexical hits as what an answer cites, those of the five best by n-grams as gold."""
    sources = t(spark, sf, "documents").select("doc_id", "source")
    cited = lambda hits, name: hits.where("rank <= 5").join(sources, "doc_id").groupBy("query_id").agg(F.collect_set("source").alias(name))
    sets = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(cited(_bm25(spark, sf, text.search_tokens), "p"), "query_id", "left").join(cited(_containment(spark, sf), "g"), "query_id", "left")
    none = F.array().cast("array<string>")
    return sets.select("query_id", *(c.alias(n) for n, c in metrics.set_scores(F.coalesce("p", none), F.coalesce("g", none)).items()))


@query(_CITES + "SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, exact FROM f")
def citation_prf(spark, sf):
    return _citations(spark, sf).select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact")))


@query(_CITES + """SELECT query_id, round(least(greatest(f1, 0), 1) * CAST(exact = 1 AS INTEGER), 6) AS penalised,
  CASE WHEN recall < 1 THEN 'retrieval' WHEN exact < 1 THEN 'citation' WHEN f1 < 0.8 THEN 'generation' ELSE 'none' END AS error FROM f""")
def error_taxonomy(spark, sf):
    s = _citations(spark, sf)
    return s.select("query_id", F.round(metrics.penalised_accuracy(F.col("f1"), F.col("exact")), 6).alias("penalised"), metrics.error_class(F.col("recall"), F.col("exact"), F.col("f1")).alias("error"))


@query(_CITES + "SELECT query_id % 3 AS kind, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f GROUP BY 1")
def metric_means_per_type(spark, sf):
    out = metrics.means(_citations(spark, sf).withColumn("kind", F.col("query_id") % 3), ["precision", "recall", "f1"], ["kind"])
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT lang, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def confusion_pivot(spark, sf):
    joined = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return joined.groupBy("lang").pivot("toxic", [0, 1]).count().na.fill(0).select("lang", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query(r"""WITH r AS (SELECT conv_id, turn, 'see [' || (turn + 1) || '] and [' || (turn % 3 + 1) || '.2] also [9]' AS reply FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn AS slot_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot FROM conversations),
n AS (SELECT conv_id, turn, unnest([1, 2, 3]) AS p, CAST(unnest(regexp_extract_all(reply, '\[(\d+)(?:\.\d+)?\]', 1)) AS INTEGER) AS number FROM r),
d AS (SELECT conv_id, turn, number, min(p) AS p FROM n GROUP BY ALL)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) AS INTEGER) AS position, slot_turn FROM d JOIN s ON s.conv_id = d.conv_id AND s.slot = d.number""".replace("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn", "SELECT d.conv_id, turn, CAST(row_number() OVER (PARTITION BY d.conv_id, turn"))
def citation_resolve(spark, sf):
    """Cited numbers of each reply to slots of the context; numbers without a slot drop, repeated ones count once, in order."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role")
    turn = F.col("turn")
    replies = c.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("see ["), (turn + 1).cast("string"), F.lit("] and ["), (turn % 3 + 1).cast("string"), F.lit(".2] also [9]")).alias("reply"))
    slots = c.select("conv_id", F.col("turn").alias("slot_turn"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("number"))
    cited = replies.select("conv_id", "turn", F.posexplode(text.cited_numbers(text.answer_part(F.col("reply")))).alias("p", "number")).groupBy("conv_id", "turn", "number").agg(F.min("p").alias("p"))
    w = Window.partitionBy("conv_id", "turn").orderBy("p")
    return cited.join(slots, ["conv_id", "number"]).select("conv_id", "turn", F.row_number().over(w).alias("position"), "slot_turn")


# Splits and training pairs

_SPLIT = """h AS (SELECT doc_id, source, md5('42|' || doc_id) AS h FROM documents),
pl AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM h),
sp AS (SELECT doc_id, source, CASE WHEN p * 8 < n * 5 THEN 'train' WHEN p * 8 < n * 6 THEN 'dev' ELSE 'test' END AS split FROM pl)"""


def _split(spark, sf):
    return splits.stratified_split(t(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", {"train": 5, "dev": 1, "test": 2})


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM sp")
def stratified_split(spark, sf):
    return _split(spark, sf).select("doc_id", "split")


@query(f"WITH {_SPLIT} SELECT split, source, count(*) AS n FROM sp GROUP BY ALL")
def split_histogram(spark, sf):
    return _split(spark, sf).groupBy("split", "source").agg(F.count("*").alias("n"))


@query(f"""WITH {_SPLIT}, k AS (SELECT DISTINCT split, md5(coalesce(text, '')) AS key FROM sp JOIN documents USING (doc_id))
SELECT a.split AS "left", b.split AS "right", count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.split < b.split GROUP BY ALL""")
def overlap_audit(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    return splits.overlaps(_split(spark, sf).join(d, "doc_id"), "key")


@query(r"""SELECT conv_id, sha256(trim(regexp_replace(coalesce(u, ''), '\s+', ' ', 'g')) || ' ' || trim(regexp_replace(coalesce(a, ''), '\s+', ' ', 'g'))) AS key FROM (WITH """ + _TURNS + " SELECT * FROM c)")
def dedup_keys(spark, sf):
    return _sides(spark, sf).select("conv_id", text.dedup_key(F.col("u"), F.col("a")).alias("key"))


@query("""SELECT count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS missing_text, count(*) FILTER (trim(coalesce(source, '')) = '') AS missing_source,
  count(*) FILTER (lang NOT IN ('en', 'fr')) AS bad_type, count(*) - count(DISTINCT doc_id) AS repeated FROM documents""")
def validate_gate(spark, sf):
    return splits.gate(t(spark, sf, "documents").withColumn("type", F.col("lang")), ["text", "source"], ("en", "fr"), "doc_id")


@query(r"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id AS source, turn AS pos, role, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS z FROM conversations),
h AS (SELECT *, md5('42|' || doc_id) AS h, CAST('0x' || substr(md5('42|' || doc_id), 1, 13) AS BIGINT) AS place, CAST('0x' || substr(md5('42|start|' || doc_id), 1, 13) AS BIGINT) AS start FROM c),
p AS (SELECT * FROM h WHERE role = 'assistant' AND length(text) >= 8),
o AS (SELECT p.doc_id AS query_id, l.doc_id, CASE WHEN p.source <> l.source THEN 'random' WHEN abs(p.pos - l.pos) <= 2 THEN 'neighbour' ELSE 'same_source' END AS origin, abs(p.pos - l.pos) AS off, (l.place - p.start + 4503599627370496) % 4503599627370496 AS gap, l.h
  FROM p JOIN h l ON p.doc_id <> l.doc_id WHERE NOT (contains(l.z, p.z) OR contains(p.z, l.z))),
n AS (SELECT query_id, doc_id, origin, CASE origin WHEN 'random' THEN 4 WHEN 'same_source' THEN 3 ELSE off END AS d, CASE WHEN origin = 'neighbour' THEN 0 ELSE gap END AS gap, CASE WHEN origin = 'neighbour' THEN h ELSE '' END AS h FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, gap, h, doc_id) AS rank FROM n)
SELECT query_id, doc_id, origin, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def negative_mining(spark, sf):
    c = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("source"), F.col("turn").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))
    positives = c.where((F.col("role") == "assistant") & (F.length("text") >= 8)).select(F.col("doc_id").alias("query_id"), "doc_id", "source", "pos", "text")
    return splits.negatives(positives, c.select("doc_id", "source", "pos", "text"), text="text")


@query("""SELECT count(DISTINCT conv_id) AS questions, count(DISTINCT conv_id) FILTER (role = 'assistant' AND length(text) >= 8) AS usable,
  count(*) FILTER (role = 'assistant' AND length(text) >= 8) AS positives, 6 * count(*) FILTER (role = 'assistant' AND length(text) >= 8) AS negatives FROM conversations""")
def pair_inventory(spark, sf):
    good = (F.col("role") == "assistant") & (F.length("text") >= 8)
    return t(spark, sf, "conversations").agg(F.count_distinct("conv_id").alias("questions"), F.count_distinct(F.when(good, F.col("conv_id"))).alias("usable"), F.count_if(good).alias("positives"), (6 * F.count_if(good)).alias("negatives"))


@query()
def lr_router(spark, sf):
    """Question types from embeddings by logistic regression, predicted for rows that training left out."""
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).cast("double").alias("label"))
    return router.train_and_predict(e, "vec_id", "embedding", "label")
