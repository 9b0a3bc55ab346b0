"""Queries of contexts: the five renderings of what searches found, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, triples
from .catalogue import _SEARCH, _bm25
from .graph_queries import _RANKED, _named_questions, _triples
from .registry import query, t
from .scoped_queries import _NAME

_LONG = "CASE WHEN length(c) > 24000 THEN substr(c, 1, 24000) || chr(10) || '…[上下文已截断]' ELSE c END"
_OUT = f"SELECT query_id, length(c) > 24000 AS trimmed, CAST(length({_LONG}) AS BIGINT) AS chars, md5({_LONG}) AS context_md5 FROM j"
_HITS = f"""WITH {_SEARCH}, h AS (SELECT query_id, rank, doc_id, source, source || '; Clause ' || lang || '; Evidence ' || doc_id AS ident, coalesce(text, '') AS whole,
regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS x, n_chars FROM bt JOIN documents USING (doc_id)),"""


def _hits(spark, sf):
    """What a lexical search found, with its texts, as clauses of a source in a language."""
    d = t(spark, sf, "documents")
    of = context.identity_line(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return _bm25(spark, sf, text.search_tokens).select("query_id", "doc_id", "rank").join(d, "doc_id").select("query_id", "rank", "source", "text", of.alias("identity"), F.concat(F.lit("n_chars:"), F.col("n_chars").cast("string")).alias("notes"))


def _digest(found):
    return found.select("query_id", "trimmed", F.length("context").cast("long").alias("chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(f"""{_HITS} n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h WHERE x <> ''),
j AS (SELECT query_id, string_agg('[' || i || '] 来源: ' || source || ' | ' || ident || chr(10) || '条款身份: ' || ident || chr(10) || x, chr(10) || chr(10) ORDER BY i) AS c FROM n GROUP BY 1) {_OUT}""")
def context_clauses(spark, sf):
    """Numbered clauses with their identity."""
    return _digest(context.contexts([(context.clause_blocks(_hits(spark, sf), "query_id", 20), "\n\n")], "query_id"))


@query(f"""{_HITS} n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h WHERE rank <= 10 AND x <> ''),
f AS (SELECT query_id, string_agg('[' || i || '] source: ' || source || chr(10) || x || chr(10) || '---', chr(10) ORDER BY i) AS c FROM n GROUP BY 1),
j AS (SELECT item_id AS query_id, coalesce(c, 'No relevant context.') AS c FROM benchmark LEFT JOIN f ON item_id = query_id) {_OUT}""")
def context_passages(spark, sf):
    """Numbered passages with their source, a note for questions that found none."""
    found = context.contexts([(context.passages(_hits(spark, sf), "query_id"), "\n")], "query_id")
    return _digest(context.with_default(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), found, "query_id"))


@query(f"""{_HITS} j AS (SELECT query_id, chr(10) || '【相关文档段落】' || chr(10) || string_agg('[' || rank || '] 来源: ' || source || ' | ' || ident || chr(10) || '内容: ' || CASE WHEN length(whole) > 2000 THEN substr(whole, 1, 2000) || '…' ELSE whole END
 || chr(10) || '条款身份: ' || ident || chr(10) || '元信息: n_chars:' || n_chars || chr(10) || '---', chr(10) ORDER BY rank) AS c FROM h GROUP BY 1) {_OUT}""")
def context_evidence(spark, sf):
    """Evidence with texts cut at 2,000 characters."""
    return _digest(context.contexts([(context.evidence_blocks(_hits(spark, sf), "query_id"), "\n")], "query_id"))


_FILE = "CASE WHEN {k} % 2 = 0 THEN 'HB+' || (8000 + {k}) || '-' || (1990 + {k}) || '.md' ELSE (20000 + {k}) || '_' || ({k} % 3 + 1) || '-' || (2000 + {k}) || '-gbt-e-300.md' END"
_FOUND = f"""{_RANKED}, tf AS (SELECT query_id, rank, head, tail, {_FILE.format(k="k")} AS source, para, conf, {_NAME.format(k="k")} || '; Clause ' || clause_id || '; Evidence ' || doc_id AS ident
FROM rk JOIN tr USING (tid) WHERE rank <= CASE kind WHEN 'single' THEN 10 WHEN 'cross' THEN 20 ELSE 15 END),"""


def _found(spark, sf):
    asked, all_ = _named_questions(spark, sf), _triples(spark, sf)
    ranked = triples.rank_triples(asked, all_).select("query_id", "triple_id", "rank")
    of = context.identity_line(F.col("standard_id"), F.col("clause_id"), F.col("evidence_id"))
    return ranked.join(all_, "triple_id").withColumn("identity", of)


@query(f"""{_FOUND} g AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS s, min(rank) OVER (PARTITION BY query_id, source, para) AS p, max(rank) OVER (PARTITION BY query_id, source, para) AS l FROM tf),
j AS (SELECT query_id, '【知识图谱信息】' || chr(10) || string_agg(CASE WHEN rank = s THEN 'KG来源: ' || source || chr(10) ELSE '' END || CASE WHEN rank = p AND para <> '' THEN '段落: ' || para || chr(10) ELSE '' END
 || '- ' || head || ' | related_to | ' || tail || ' (confidence=' || round(conf, 4) || ') [条款身份: ' || ident || ']' || CASE WHEN rank = l THEN chr(10) ELSE '' END, chr(10) ORDER BY s, p, rank) AS c FROM g GROUP BY 1) {_OUT}""")
def context_graph(spark, sf):
    """Triples of a question by source and paragraph."""
    found = _found(spark, sf).withColumn("confidence", F.round("confidence", 4))
    return _digest(context.contexts([(context.graph_blocks(found, "query_id"), "\n")], "query_id"))


@query(f"""{_FOUND} j AS (SELECT query_id, '## Knowledge Graph Facts' || chr(10) || string_agg('K' || rank || '. ' || regexp_replace(head || ' --related_to--> ' || tail, '^[ -]+|[ -]+$', '', 'g') || ' (source: ' || source || ')'
 || CASE WHEN para <> '' THEN chr(10) || '   evidence: ' || substr(para, 1, 240) ELSE '' END, chr(10) ORDER BY rank) AS c FROM tf WHERE rank <= 12 GROUP BY 1) {_OUT}""")
def context_facts(spark, sf):
    """Triples of a question as facts."""
    return _digest(context.contexts([(context.fact_lines(_found(spark, sf), "query_id"), "\n")], "query_id"))
