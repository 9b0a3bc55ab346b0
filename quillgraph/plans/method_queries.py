"""The methods by name over the questions and the corpus of ``scoped_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, refine
from . import methods
from .catalogue import _BM25, _SENTENCES, _bm25
from .graph_queries import _COMMUNITY, _LEX, _named_questions, _triples
from .registry import query, t
from .scoped_queries import _COS, _QS, _VECTOR, _WITHIN, _WORDS, _corpus, _questions

_MIXED = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+"
_ASKED = _BM25.replace("lower(text)", "text").replace("item_id AS query_id", "query_id").replace("FROM benchmark", "FROM qs").replace("{p}", _MIXED)
_DN = f"vq AS (SELECT query_id, {_VECTOR.format(c='text')} AS v FROM qs), vd AS (SELECT doc_id, {_VECTOR.format(c='text')} AS v FROM cp), dq AS (SELECT query_id, doc_id, {_COS.format(a='vq.v', b='vd.v')} AS score FROM vq CROSS JOIN vd), dt AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dq QUALIFY rank <= 20)"
_OUT = "SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM "


def _run(name, spark, sf, **options):
    found = methods.METHODS[name](_named_questions(spark, sf), _corpus(spark, sf), **options)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_QS}, {_ASKED}, al AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM qs CROSS JOIN z LEFT JOIN bm USING (query_id, doc_id)), rk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM al QUALIFY rank <= 20) {_OUT} rk")
def method_bm25(spark, sf):
    return _run("bm25", spark, sf)


@query(f"WITH {_QS}, {_DN} {_OUT} dt")
def method_dense(spark, sf):
    return _run("dense", spark, sf)


@query(f"WITH {_QS}, {_WITHIN} {_OUT} wi")
def method_within_scope(spark, sf):
    return _run("within_scope", spark, sf)


@query(f"""WITH {_QS}, {_ASKED}, {_DN}, u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part FROM bt UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM dt), f AS (SELECT query_id, doc_id, CAST(sum(CAST(part AS DOUBLE)) AS DOUBLE) AS score FROM u GROUP BY ALL),
fr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 20) {_OUT} fr""")
def method_hybrid(spark, sf):
    return _run("hybrid", spark, sf)


@query(_COMMUNITY + f", us AS (SELECT DISTINCT query_id, doc_id FROM cm), ut AS (SELECT query_id, doc_id, round({_LEX.format(c='cp.text')} / greatest(len(q), 1), 9) AS score FROM us JOIN cp USING (doc_id) JOIN tk USING (query_id)), ur AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ut QUALIFY rank <= 20) {_OUT} ur")
def method_community(spark, sf):
    return _run("community", spark, sf, triples_=_triples(spark, sf))


_BEST = "bs AS (SELECT query_id, substr(cp.text, 1, 200) AS b, score AS best FROM dt JOIN cp USING (doc_id) WHERE rank = 1)"


def _again(where: str) -> str:
    """Dense hits of the questions that ask again with the best text behind them."""
    return f"va AS (SELECT query_id, {_VECTOR.format(c='x')} AS v FROM (SELECT query_id, text || ' ' || b AS x FROM qs JOIN bs USING (query_id) WHERE {where})), da AS (SELECT query_id, doc_id, {_COS.format(a='va.v', b='vd.v')} AS score FROM va CROSS JOIN vd), dr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM da QUALIFY rank <= 20)"


@query(f"""WITH {_QS}, {_DN}, {_BEST}, {_again("kind <> 'single'")}, u AS (SELECT *, 0 AS c FROM dt UNION ALL SELECT *, 1 FROM dr), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY c, rank) = 1),
pp AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY c, k.rank, doc_id) AS rank FROM k) {_OUT} pp WHERE rank <= 20""")
def method_adaptive(spark, sf):
    return _run("adaptive", spark, sf)


@query(f"""WITH {_QS}, {_DN}, {_BEST}, {_again("(best + 1) / 2 < 0.99")}, u AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM dt UNION ALL SELECT * FROM dr) GROUP BY ALL),
pp AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u QUALIFY rank <= 20) {_OUT} pp""")
def method_forward_looking(spark, sf):
    return _run("forward_looking", spark, sf)


@query("SELECT item_id AS query_id, CAST(0 AS BIGINT) AS n_lines, 'No relevant context.' AS context FROM benchmark")
def method_closed_book(spark, sf):
    """Every question with the context that it is asked with: none."""
    evidence = _run("closed_book", spark, sf).select("query_id", "doc_id", "rank").join(t(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    found = context.contexts([(context.passages(evidence, "query_id"), "\n")], "query_id")
    return context.with_default(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), found, "query_id").select("query_id", "n_lines", "context")


@query()
def method_self_reflective(spark, sf):
    """Hits that share words, with a second search where the first is weak; a test checks it on a small corpus."""
    return _run("self_reflective", spark, sf)


@query()
def method_corrective(spark, sf):
    """Refined, replaced or merged by how good the first round is; a test checks it on a small corpus."""
    return _run("corrective", spark, sf)


@query()
def method_clause_graph(spark, sf):
    """The main method; its parts have SQL of their own, a test checks the whole on a small corpus."""
    return _run("clause_graph", spark, sf, triples_=_triples(spark, sf))


_REL = "len(list_intersect({q}, {p})) / greatest(least(len({q}), len({p})), 1)"
_W = r"list_distinct(regexp_extract_all({c}, '[\x{{4e00}}-\x{{9fff}}]+|[A-Za-z0-9]+'))"


@query(f"""WITH {_QS}, {_BM25.replace('{p}', _WORDS)}, {_SENTENCES}, qw AS (SELECT query_id, {_W.format(c="text")} AS q FROM qs),
wh AS (SELECT query_id, doc_id, rank AS r, -1 AS i, regexp_replace(cp.text, '^ +| +$', '', 'g') AS s FROM bt JOIN cp USING (doc_id) WHERE trim(cp.text) <> ''),
sx AS (SELECT query_id, bt.doc_id, bt.rank AS r, row_number() OVER (PARTITION BY query_id, bt.doc_id ORDER BY pos) - 1 AS i, sentence AS s FROM bt JOIN cp USING (doc_id) JOIN se USING (doc_id) WHERE cp.z > 800 AND NOT regexp_matches(cp.text, '\\$\\$(?s:.){{6,}}\\$\\$|\\$[^$]{{8,}}\\$|式中|[ηη]\\s*=|\\\\eta\\s*\\{{?\\s*=')),
al AS (SELECT query_id, doc_id, r, i, s, q, {_W.format(c="s")} AS p FROM (SELECT * FROM wh UNION ALL SELECT * FROM sx) JOIN qw USING (query_id)),
sc AS (SELECT query_id, doc_id, r, i, s, round(CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0 ELSE least(1.0, {_REL.format(q="q", p="p")} * CASE WHEN length(s) < 40 THEN 0.6 ELSE 1 END) END, 9) AS score FROM al),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, i) = 1), go AS (SELECT * FROM be WHERE score > 0)
SELECT query_id, doc_id, md5(s) AS text_md5, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, doc_id) AS INTEGER) AS rank FROM go QUALIFY rank <= 20""")
def knowledge_refinement(spark, sf):
    """Lexical hits by their most relevant strip."""
    found = refine.refined(_bm25(spark, sf, text.search_tokens), _questions(spark, sf), t(spark, sf, "documents").select("doc_id", "text"))
    return found.select("query_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 6).alias("score"), "rank")
