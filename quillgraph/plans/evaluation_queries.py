"""Queries of metrics over whole result sets: documents, paragraphs, standards, answers; and of alignments and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import align, identity, metrics, scoped
from .catalogue import _ALIGN, _BM25, _aligned, _bm25, _pairs_of_turns
from .registry import query, t
from .scoped_queries import _DENSE, _DIRECT, _E8, _E9, _QS, _WITHIN, _WORDS, _corpus, _file, _questions

_HITS = f"WITH {_QS}, {_BM25.replace('{p}', _WORDS)}, hd AS (SELECT query_id, rank, k FROM bt JOIN cp USING (doc_id)), al AS (SELECT hd.query_id, hd.rank, ks.k FROM hd JOIN ks USING (query_id, k))"
_DOCS = """wn AS (SELECT query_id, count(*) AS w FROM ks GROUP BY 1), sh AS (SELECT query_id, count(*) AS s FROM hd GROUP BY 1), fr AS (SELECT query_id, k, min(rank) AS rank FROM al GROUP BY ALL),
fo AS (SELECT query_id, count(*) FILTER (rank <= 1) AS f1, count(*) FILTER (rank <= 3) AS f3, count(*) FILTER (rank <= 5) AS f5, min(rank) AS first FROM fr GROUP BY 1), gd AS (SELECT query_id, count(DISTINCT rank) AS g FROM al GROUP BY 1),
dm AS (SELECT query_id, CAST(coalesce(f1, 0) > 0 AS INTEGER)::DOUBLE AS doc_hit_1, coalesce(f1, 0) / w AS doc_recall_1, CAST(coalesce(f3, 0) > 0 AS INTEGER)::DOUBLE AS doc_hit_3, coalesce(f3, 0) / w AS doc_recall_3, CAST(coalesce(f5, 0) > 0 AS INTEGER)::DOUBLE AS doc_hit_5, coalesce(f5, 0) / w AS doc_recall_5,
  coalesce(1.0 / first, 0) AS doc_mrr, coalesce(g / s, 0) AS context_precision FROM wn LEFT JOIN sh USING (query_id) LEFT JOIN fo USING (query_id) LEFT JOIN gd USING (query_id))"""
_DOC_NAMES = ("doc_hit_1", "doc_recall_1", "doc_hit_3", "doc_recall_3", "doc_hit_5", "doc_recall_5", "doc_mrr", "context_precision")


def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _relevant(spark, sf):
    i = F.col("query_id")
    both = F.array_distinct(F.when(i % 3 == 0, F.array(_file(i % 20))).otherwise(F.array(_file(i % 20), _file((i * 7 + 3) % 20))))
    return _questions(spark, sf).select("query_id", F.explode(both).alias("doc"))


def _document_metrics(spark, sf):
    hits = _bm25(spark, sf, text.search_tokens).join(_corpus(spark, sf).select("doc_id", F.col("source").alias("doc")), "doc_id").select("query_id", "rank", "doc")
    return metrics.document_metrics(identity.stash(hits), _relevant(spark, sf))


@query(f"{_HITS}, {_DOCS} SELECT query_id, {_rounded(_DOC_NAMES)} FROM dm")
def document_metrics(spark, sf):
    """Hits by document name: lexical hits against the standards that a question names."""
    out = _document_metrics(spark, sf)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in _DOC_NAMES))


_STD = f"""WITH {_QS}, {_E8}, {_E9}, {_DENSE}, {_DIRECT}, {_WITHIN}, rt AS (SELECT query_id, wi.doc_id, rank, k FROM wi JOIN cp USING (doc_id)), go AS (SELECT query_id, sd.doc_id, k FROM sd JOIN cp USING (doc_id) WHERE rank <= 3),
pa AS (SELECT go.query_id, go.doc_id AS gold, rt.doc_id, rank, coalesce(rt.k = go.k, false) AS same FROM go LEFT JOIN rt USING (query_id)), pb AS (SELECT * FROM pa QUALIFY same OR NOT bool_or(same) OVER (PARTITION BY query_id, gold)),
pc AS (SELECT *, row_number() OVER (PARTITION BY query_id, gold ORDER BY rank, doc_id) AS place FROM pb), pd AS (SELECT query_id, gold, min(place) FILTER (doc_id = gold) AS p FROM pc GROUP BY ALL),
sm AS (SELECT query_id, count(*) FILTER (p = 1) / count(*) AS same_std_recall_1, sum(coalesce(1.0 / p, 0)) / count(*) AS same_std_mrr, CAST(bool_and(EXISTS (SELECT 1 FROM rt WHERE rt.query_id = pd.query_id AND rt.doc_id = gold)) AS INTEGER)::DOUBLE AS gold_all_in_context FROM pd GROUP BY 1)"""
_STD_NAMES = ("same_std_recall_1", "same_std_mrr", "gold_all_in_context")


@query(f"{_STD} SELECT query_id, {_rounded(_STD_NAMES)} FROM sm")
def same_standard_metrics(spark, sf):
    """Whether what the standards give directly is ranked first within its standard."""
    questions, corpus = _questions(spark, sf), _corpus(spark, sf)
    named = lambda df: df.join(corpus.select("doc_id", F.col("source").alias("standard")), "doc_id").select("query_id", "rank", F.col("doc_id").alias("key"), "standard")
    got = named(scoped.within_standard(questions, corpus))
    gold = named(scoped.std_direct(questions, corpus).where("rank <= 3"))
    out = metrics.same_standard_metrics(identity.stash(got), identity.stash(gold))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in _STD_NAMES))


_PARA = r"""WITH c AS (SELECT conv_id, turn, role, list_distinct([w FOR w IN regexp_extract_all(regexp_replace(coalesce(text, ''), '(?i)(?:GB/T|GBT|GB|HB(?:/Z)?|HB_Z|GJB|QJ|SJ)[\s+]*[\d\-—－/.A-Za-z（）()]+', ' ', 'g'), '[A-Za-z0-9]{2,}') IF NOT regexp_matches(w, '^\d+$')]) AS w FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM c WHERE role = 'assistant'), g AS (SELECT * FROM c WHERE role = 'user'),
p AS (SELECT g.conv_id, g.turn, min(rank) AS rank FROM g JOIN r ON g.conv_id = r.conv_id AND rank <= 10 WHERE len(list_intersect(g.w, r.w)) >= 3 AND len(list_intersect(g.w, r.w)) >= 0.35 * least(len(g.w), len(r.w)) GROUP BY ALL),
f AS (SELECT conv_id, count(*) FILTER (rank <= 1) AS f1, count(*) FILTER (rank <= 5) AS f5, count(*) FILTER (rank <= 10) AS f10 FROM p GROUP BY 1), n AS (SELECT conv_id, count(*) AS n FROM g GROUP BY 1)
SELECT conv_id AS query_id, CAST(coalesce(f1, 0) > 0 AS INTEGER)::DOUBLE AS para_hit_1, round(coalesce(f1, 0) / n, 6) AS para_recall_1, CAST(coalesce(f5, 0) > 0 AS INTEGER)::DOUBLE AS para_hit_5, round(coalesce(f5, 0) / n, 6) AS para_recall_5,
  CAST(coalesce(f10, 0) > 0 AS INTEGER)::DOUBLE AS para_hit_10, round(coalesce(f10, 0) / n, 6) AS para_recall_10 FROM n LEFT JOIN f USING (conv_id)"""


def _turns(spark, sf):
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", "text")
    w = Window.partitionBy("query_id").orderBy("turn")
    return c.where("role = 'assistant'").select("query_id", F.row_number().over(w).alias("rank"), "text"), c.where("role = 'user'").select("query_id", "text")


@query(_PARA)
def paragraph_metrics(spark, sf):
    """Assistant turns against user turns of their conversation, by words alone."""
    out = metrics.paragraph_metrics(*_turns(spark, sf), with_ratio=False)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query()
def paragraph_metrics_with_ratio(spark, sf):
    """The same, where also the ratio of matching blocks may decide; a test compares it with a plain version."""
    out = metrics.paragraph_metrics(*_turns(spark, sf))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query()
def context_metrics(spark, sf):
    """Best ratios of user and assistant turns; a test compares them with a plain version."""
    out = metrics.context_metrics(*_turns(spark, sf))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(r"""WITH e AS (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(text, '(HB|GB/T|GJB)\s*\d+[-\s]\d{4}', 1) || regexp_extract_all(text, '[A-Z]{2,}\d+[A-Z]*') || regexp_extract_all(text, '\d+\.?\d*'))) AS x, source FROM documents),
k AS (SELECT DISTINCT d.doc_id AS query_id, unnest(regexp_extract_all(b.url, '(HB|GB/T|GJB)\s*\d+[-\s]\d{4}', 1) || regexp_extract_all(b.url, '[A-Z]{2,}\d+[A-Z]*') || regexp_extract_all(b.url, '\d+\.?\d*')) AS x FROM documents d JOIN pages b ON b.page_id = d.doc_id),
n AS (SELECT query_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.query_id = e.query_id AND k.x = e.x)) AS h FROM e GROUP BY 1)
SELECT doc_id AS query_id, round(coalesce((n - h) / n, 0), 6) AS hallucination_rate FROM documents LEFT JOIN n ON query_id = doc_id""")
def hallucination_rate(spark, sf):
    """Numbers and codes of each document that the page of its number doesn't name."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    out = metrics.hallucination_rate(d, t(spark, sf, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("text")))
    return out.select("query_id", F.round("hallucination_rate", 6).alias("hallucination_rate"))


@query(f"{_HITS}, {_DOCS}, qd AS (SELECT query_id, kind, coalesce(doc_hit_5, 0) AS doc_hit_5, coalesce(doc_mrr, 0) AS doc_mrr, CASE WHEN (SELECT count(*) FROM hd WHERE hd.query_id = qs.query_id AND hd.k = k1) > 0 THEN doc_recall_5 END AS judge FROM qs LEFT JOIN dm USING (query_id))"
       " SELECT kind, count(*) AS n, round(avg(doc_hit_5), 6) AS doc_hit_5, round(avg(doc_mrr), 6) AS doc_mrr, round(coalesce(avg(judge), 0), 6) AS judge, round(count(judge) / count(*), 6) AS judge_coverage FROM qd GROUP BY 1")  # fmt: skip
def evaluation_report(spark, sf):
    """Wide rows of all questions, and their means by type; the judge stands in as a score that only some questions have."""
    questions = _questions(spark, sf)
    rows = metrics.per_question(questions.select("query_id", "kind"), [_document_metrics(spark, sf)])
    hits = _bm25(spark, sf, text.search_tokens).join(_corpus(spark, sf).select("doc_id", "source"), "doc_id")
    judged = hits.where(F.col("source") == _file(F.col("query_id") % 20)).select("query_id").distinct().withColumn("_judged", F.lit(True))
    rows = rows.join(judged, "query_id", "left").withColumn("judge", F.when(F.col("_judged"), F.col("doc_recall_5")))
    out = metrics.means_with_coverage(rows, ["doc_hit_5", "doc_mrr"], "judge", ["kind"])
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("doc_hit_5", "doc_mrr", "judge", "judge_coverage")))


# Alignment audits

_AUDIT = _ALIGN + r""", tk AS (SELECT conv_id AS source, turn AS pid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM conversations WHERE role = 'user'),
tr AS (SELECT source, pid, w[1] AS head, w[2] AS tail FROM tk WHERE len(w) >= 2),
bk AS (SELECT tr.source, tr.pid, head, tail, CASE WHEN status <> 'needs_review' THEN cid END AS cid, coalesce(status, 'unresolved') AS status FROM tr LEFT JOIN al USING (source, pid))"""


def _triples_of_turns(spark, sf):
    w = text.english_tokens(F.coalesce("text", F.lit("")))
    u = t(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("source"), F.col("turn").alias("pid"), w.alias("w")).where(F.size("w") >= 2)
    return u.select("source", "pid", F.get("w", 0).alias("head"), F.get("w", 1).alias("tail"))


@query(_AUDIT + " SELECT source, pid, head, tail, cid, status FROM bk")
def alignment_backjoin(spark, sf):
    """Triples with the clause of their paragraph where the alignment is accepted."""
    return align.linked(_triples_of_turns(spark, sf), _aligned(spark, sf), ["source", "pid"], ["cid"]).select("source", "pid", "head", "tail", "cid", "status")


@query(_AUDIT + " SELECT count(*) AS triples, count(DISTINCT source) AS sources, count(DISTINCT (source, pid)) AS paragraphs, count(*) FILTER (cid IS NOT NULL) AS accepted, count(*) FILTER (status = 'needs_review') AS review, count(*) FILTER (status = 'unresolved') AS unresolved FROM bk")
def alignment_manifest(spark, sf):
    return align.manifest(align.linked(_triples_of_turns(spark, sf), _aligned(spark, sf), ["source", "pid"], ["cid"]), "source", ["source", "pid"], "cid")


@query(_ALIGN + " SELECT source, pid, cid, CAST(k AS INTEGER) AS place, round(sc, 6) AS score FROM x WHERE k <= 5")
def alignment_audit(spark, sf):
    """The five best clauses of each paragraph."""
    paragraphs, answers = _pairs_of_turns(spark, sf)
    value, method = align.score(F.col("p_text"), F.col("c_text"), counted=align.COUNTED)
    out = align.best_few(align.candidates(paragraphs, answers).withColumns({"score": value, "method": method}), ["source", "pid"], 5)
    return out.select("source", "pid", "cid", "place", F.round(F.round("score", 9), 6).alias("score"))
