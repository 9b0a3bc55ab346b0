"""Queries over triples and entities. Triples are pairs of phrases of one document; standards and questions are those of ``scoped_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import entities, graph, triples
from ..operators.identity import small
from ..sources.files import stash
from .catalogue import _ENT, _PLACES, _entities, _places
from .registry import query, t
from .scoped_queries import _COS, _NAME, _QS, _VECTOR, _corpus, _file, _name, _number, _questions

_QN = r"""
qp AS (SELECT query_id, regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_''.-]*(?:\s+(?:of|the|and|de|[A-Z][A-Za-z0-9_''.-]*)){0,5})', 1) AS f FROM qs),
ql AS (SELECT query_id, [regexp_replace(regexp_replace(x, '^[ ,.;:()]+', ''), '[ ,.;:()]+$', '') FOR x IN f IF length(trim(x)) >= 3] AS l FROM qp),
qu AS (SELECT query_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM ql),
qo AS MATERIALIZED (SELECT query_id, name, count(*) OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS place FROM qu GROUP BY query_id, name),
qc AS (SELECT query_id, count(*) AS names FROM qo GROUP BY 1)"""
_TR = _ENT.replace("WITH m AS", f"WITH {_QS}, {_QN}, m AS") + """,
tr AS (SELECT e.doc_id * 16 + e.pos AS tid, h.name AS head, e.name AS tail, e.doc_id, cp.k, cp.clause_id, substr(cp.text, 1, 200) AS para, e.pos / 12 AS conf FROM e h JOIN e ON h.doc_id = e.doc_id AND h.pos = 1 AND e.pos BETWEEN 2 AND 12 JOIN cp ON cp.doc_id = e.doc_id),
tk AS (SELECT query_id, list_distinct(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9]+')) AS q FROM qs)"""


def _named_questions(spark, sf):
    return _questions(spark, sf).withColumn("names", text.capitalised_phrases(F.lit(""), F.col("text")))


def _triples(spark, sf):
    found = _entities(spark, sf).select("doc_id", "source", F.get("names", 0).alias("head"), F.posexplode(F.slice("names", 2, 11)).alias("p", "tail"))
    k = _number(F.col("source"))
    full = found.join(_corpus(spark, sf).select("doc_id", "clause_id", F.substring("text", 1, 200).alias("paragraph")), "doc_id")
    return stash(full.select(
        (F.col("doc_id") * 16 + F.col("p") + 2).alias("triple_id"), "head", F.lit("related_to").alias("relation"), "tail", "paragraph", _file(k).alias("source"),
        ((F.col("p") + 2) / 12).alias("confidence"), "clause_id", _name(k).alias("standard_id"), F.col("doc_id").cast("string").alias("evidence_id"),
    ))


_LEX = "len(list_intersect(q, regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]|[A-Za-z0-9]+')))"
_RANKED = (
    _TR
    + f""", em AS (SELECT query_id, tid, min(place) AS place FROM qo JOIN tr ON place < 10 AND (contains(head, name) OR contains(tail, name)) GROUP BY ALL), an AS (SELECT query_id, tid FROM ks JOIN tr USING (k)),
ca AS (SELECT an.query_id, an.tid, place FROM an LEFT JOIN em USING (query_id, tid)),
cb AS (SELECT ca.*, tr.* EXCLUDE (tid), q, kind, names FROM ca JOIN tr USING (tid) JOIN tk USING (query_id) JOIN qs USING (query_id) LEFT JOIN qc USING (query_id)),
cc AS (SELECT *, round(3.0 + 1.5 * {_LEX.format(c="head || ' related_to ' || tail || ' ' || para")} / greatest(len(q), 1) + CASE WHEN place IS NOT NULL THEN 0.5 * (1 - place / greatest(least(names, 10), 1)) ELSE 0.0 END + 0.05 * conf, 9) AS score FROM cb
  WHERE place IS NOT NULL OR kind <> 'correlation' OR {_LEX.format(c="head || ' ' || tail || ' ' || para")} > 0),
nd AS (SELECT DISTINCT query_id, unnest([head, tail]) AS node FROM cc WHERE kind = 'correlation'),
to_ AS (SELECT an.query_id, head, tail, min(an.tid) AS tid FROM an JOIN tr USING (tid) JOIN tk USING (query_id) JOIN qs USING (query_id) WHERE kind = 'correlation'
  AND EXISTS (SELECT 1 FROM nd WHERE nd.query_id = an.query_id AND nd.node IN (head, tail)) AND NOT EXISTS (SELECT 1 FROM cc WHERE cc.query_id = an.query_id AND cc.head = tr.head AND cc.tail = tr.tail)
  AND {_LEX.format(c="head || ' ' || tail || ' ' || para")} > 0 GROUP BY ALL),
h2 AS (SELECT query_id, tid FROM to_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tid) <= 20),
al AS (SELECT query_id, tid, score, 'hop1' AS origin FROM cc UNION ALL SELECT query_id, tid, 2.0, 'hop2' FROM h2),
rk AS (SELECT al.*, kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, origin, tid) AS rank FROM al JOIN qs USING (query_id))"""
)


@query(_RANKED + " SELECT query_id, tid AS triple_id, round(score, 6) AS score, origin, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= CASE kind WHEN 'single' THEN 10 WHEN 'cross' THEN 20 ELSE 15 END")
def clause_graph_search(spark, sf):
    """Triples within the standards of a question, by standard, words, names and confidence."""
    found = triples.rank_triples(_named_questions(spark, sf), _triples(spark, sf))
    return found.select("query_id", "triple_id", F.round("score", 6).alias("score"), "origin", "rank")


_COMMUNITY = (
    _TR
    + f""", an AS (SELECT query_id, tid FROM ks JOIN tr USING (k)), em AS (SELECT query_id, tid, min(place) AS place FROM qo JOIN tr ON place < 12 AND (contains(head, name) OR contains(tail, name) OR contains(para, name)) GROUP BY ALL),
lo AS (SELECT an.query_id, an.tid, head, tail, doc_id, k, clause_id, para, place, {_LEX.format(c="head || ' ' || tail || ' ' || para")} / greatest(len(q), 1) AS lex, q FROM an JOIN tr USING (tid) JOIN tk USING (query_id) LEFT JOIN em USING (query_id, tid)),
lc AS (SELECT *, round(2.2 * lex + 0.8 * coalesce(1.0 - 0.05 * place, 0), 9) AS score FROM lo),
be AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tid) AS i FROM lc WHERE place IS NOT NULL OR lex > 0 QUALIFY i <= 50),
nd AS (SELECT DISTINCT query_id, unnest([head, tail]) AS node FROM be WHERE i <= 40),
to_ AS (SELECT query_id, head, tail, min(tid) AS tid FROM lc WHERE EXISTS (SELECT 1 FROM nd WHERE nd.query_id = lc.query_id AND nd.node IN (head, tail)) AND NOT EXISTS (SELECT 1 FROM be WHERE i <= 40 AND be.query_id = lc.query_id AND be.head = lc.head AND be.tail = lc.tail) AND lex > 0 GROUP BY ALL),
h2 AS (SELECT query_id, tid FROM to_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tid) <= 30),
un AS (SELECT query_id, tid, score, 0 AS o, doc_id, head, tail, k, clause_id FROM be UNION ALL SELECT query_id, tid, round(score + 0.15, 9), 1, doc_id, head, tail, k, clause_id FROM lc JOIN h2 USING (query_id, tid)),
on_ AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, o, tid) = 1),
cm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, tid) AS rank FROM on_ QUALIFY rank <= 40)"""
)


@query(_COMMUNITY + " SELECT query_id, tid AS triple_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM cm")
def community_search(spark, sf):
    found = triples.community_search(_named_questions(spark, sf), _triples(spark, sf))
    return found.select("query_id", "triple_id", F.round("score", 6).alias("score"), "rank")


@query(_COMMUNITY + f""", tp AS (SELECT *, {_NAME.format(k="k")} AS standard_id, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS i FROM cm QUALIFY i <= 8), fc AS (SELECT query_id, standard_id, clause_id, min(i) AS i FROM tp GROUP BY ALL),
ff AS (SELECT query_id, standard_id, string_agg(clause_id, ', ' ORDER BY i) AS c FROM fc GROUP BY ALL)
SELECT query_id, standard_id, md5('社区 ' || standard_id || '：条款 ' || any_value(c) || '；关系：' || string_agg(head || ' -related_to-> ' || tail, '；' ORDER BY i) FILTER (i <= 6)) AS report_md5 FROM tp JOIN ff USING (query_id, standard_id) GROUP BY query_id, standard_id""")
def community_reports(spark, sf):
    reports = triples.community_reports(triples.community_search(_named_questions(spark, sf), _triples(spark, sf)))
    return reports.select("query_id", "standard_id", F.md5(F.col("report").cast("binary")).alias("report_md5"))


@query(_COMMUNITY + f", us AS (SELECT DISTINCT query_id, doc_id FROM cm), ut AS (SELECT query_id, doc_id, round({_LEX.format(c='cp.text')} / greatest(len(q), 1), 9) AS score FROM us JOIN cp USING (doc_id) JOIN tk USING (query_id)) SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ut")
def community_units(spark, sf):
    """Texts of the triples that a community search found, by the words they share with the question."""
    found = stash(triples.community_search(_named_questions(spark, sf), _triples(spark, sf)).select("query_id", F.col("evidence_id").cast("long").alias("doc_id")).distinct())
    ranked = triples.rank_text_units(_questions(spark, sf), found.join(triples.texts_of(_corpus(spark, sf), found), "doc_id"))
    return ranked.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_TR + """, em AS (SELECT query_id, tid, conf, head, tail FROM qo JOIN tr ON place < 10 AND (contains(head, name) OR contains(tail, name)) GROUP BY ALL),
ps AS (SELECT query_id, doc_id * 16 + place AS tid, 0.8 AS conf, name AS head, doc_id || '' AS tail FROM qo JOIN cp ON place < 10 AND contains(cp.text, name) WHERE query_id NOT IN (SELECT query_id FROM em)),
un AS (SELECT query_id, tid, conf, head, 'related_to' AS relation, tail FROM em UNION ALL SELECT query_id, tid, conf, head, 'appears_in', tail FROM ps),
rk AS (SELECT un.*, kind, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, tid) AS rank FROM un JOIN qs USING (query_id))
SELECT query_id, head, relation, tail, round(conf, 6) AS confidence, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= CASE kind WHEN 'single' THEN 20 WHEN 'cross' THEN 15 ELSE 10 END""")
def graph_file_triples(spark, sf):
    """Relations that hold a name of the question, or else texts that do."""
    units = t(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("title"))
    found = triples.graph_triples(_named_questions(spark, sf), _triples(spark, sf), units)
    return found.select("query_id", "head", "relation", "tail", F.round("confidence", 6).alias("confidence"), "rank")


_DICT = _TR + f", di AS (SELECT name, min(doc_id * 32 + pos) AS id FROM e GROUP BY 1), dv AS (SELECT id, name, {_VECTOR.format(c='name')} AS v FROM di), vq AS (SELECT query_id, {_VECTOR.format(c='text')} AS v FROM qs)"


def _dictionary(spark, sf):
    rows = _entities(spark, sf).select("doc_id", F.posexplode("names").alias("p", "name")).groupBy("name").agg(F.min(F.col("doc_id") * 32 + F.col("p") + 1).alias("entity_id"))
    return rows.select("entity_id", "name", text.hash_embedding(text.search_tokens(F.col("name"))).alias("v"))


@query(_DICT + f""", kw AS (SELECT qo.query_id, lower(qo.name) AS w, id, {_COS.format(a="vq.v", b="dv.v")} AS s FROM qo JOIN vq USING (query_id) JOIN dv ON place < 5 AND contains(lower(dv.name), lower(qo.name))), kg AS (SELECT * FROM kw WHERE s > 0.5),
op AS (SELECT query_id FROM vq WHERE query_id NOT IN (SELECT query_id FROM kg GROUP BY 1 HAVING count(*) >= 5)),
sm AS (SELECT query_id, id, {_COS.format(a="vq.v", b="dv.v")} AS s FROM op JOIN vq USING (query_id) CROSS JOIN dv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 50),
un AS (SELECT query_id, id, s, 'keyword' AS m FROM kg UNION ALL SELECT query_id, id, s, 'semantic' FROM sm WHERE s > 0.5), on_ AS (SELECT query_id, id, max(s) AS s, min(m) AS m FROM un GROUP BY ALL)
SELECT query_id, id AS entity_id, round(s, 6) AS similarity, m AS match, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM on_ QUALIFY rank <= 20""")
def entity_match(spark, sf):
    """Entities of the dictionary for each question, by keyword and by similarity."""
    asked = _named_questions(spark, sf).select("query_id", F.slice("names", 1, 5).alias("keywords"), text.hash_embedding(text.search_tokens(F.col("text"))).alias("v"))
    found = entities.match_entities(asked, _dictionary(spark, sf))
    return found.select("query_id", "entity_id", F.round("similarity", 6).alias("similarity"), "match", "rank")


@query(_TR + """, as_ AS (SELECT query_id, name FROM qo WHERE place < 3), rl AS (SELECT DISTINCT query_id, tid FROM as_ JOIN tr ON name IN (head, tail)), un AS (SELECT DISTINCT query_id, cp.doc_id FROM as_ JOIN cp ON contains(cp.text, name)),
en AS (SELECT DISTINCT query_id, name FROM as_ WHERE name IN (SELECT name FROM e)), co AS (SELECT DISTINCT query_id, k FROM as_ JOIN e USING (name) JOIN cp USING (doc_id)),
al AS (SELECT query_id, 'e' AS w FROM en UNION ALL SELECT query_id, 'r' FROM rl UNION ALL SELECT query_id, 'u' FROM un UNION ALL SELECT query_id, 'c' FROM co)
SELECT qs.query_id, count(*) FILTER (w = 'e') AS entities, count(*) FILTER (w = 'r') AS relations, count(*) FILTER (w = 'u') AS units, count(*) FILTER (w = 'c') AS communities FROM qs LEFT JOIN al USING (query_id) GROUP BY qs.query_id""")
def graph_lookups(spark, sf):
    """How many entities, relations, text units and communities the first names of each question have."""
    asked = stash(_named_questions(spark, sf).select("query_id", F.explode(F.slice("names", 1, 3)).alias("name")))
    names = stash(_entities(spark, sf))  # names are cut once for all parts
    wanted = small(asked.select("name").distinct())
    mentions = stash(names.select("doc_id", "source", F.explode("names").alias("name")).join(wanted, "name", "left_semi"))
    members = mentions.select(_number(F.col("source")).alias("community_id"), F.col("name").alias("node")).distinct()
    listed = members.select("community_id", F.array("node").alias("nodes"))  # a row for each member: no list grows with a community
    edges = names.select("doc_id", F.get("names", 0).alias("head"), F.posexplode(F.slice("names", 2, 11)).alias("p", "tail")).select((F.col("doc_id") * 16 + F.col("p") + 2).alias("triple_id"), "head", "tail")
    ends = [edges.join(wanted.select(F.col("name").alias(c)), c, "left_semi") for c in ("head", "tail")]
    parts = {
        "entities": entities.entities_named(mentions.select("name").distinct(), asked), "relations": entities.relations_of(stash(ends[0].unionByName(ends[1]).distinct()), asked),
        "units": entities.units_of(t(spark, sf, "documents").select("doc_id", "text"), asked, mentions), "communities": entities.communities_of(listed, asked),
    }
    out = _questions(spark, sf).select("query_id")
    for name, rows in parts.items():
        out = out.join(rows.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left")
    return out.na.fill(0)


@query(_DICT + f""", cv AS (SELECT doc_id, text, {_VECTOR.format(c="cp.text")} AS v FROM cp), nr AS (SELECT query_id, doc_id, {_COS.format(a="vq.v", b="cv.v")} AS s FROM vq CROSS JOIN cv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 60),
bo AS (SELECT nr.query_id, nr.doc_id, round(s * (1.0 + least(0.15 * (SELECT count(*) FROM qo WHERE qo.query_id = nr.query_id AND place < 3 AND length(name) >= 2 AND contains(lower(cv.text), lower(name))) + 0.2 * (SELECT count(*) FROM qo WHERE qo.query_id = nr.query_id AND place BETWEEN 3 AND 5 AND length(name) >= 2 AND contains(lower(cv.text), lower(name))), 0.5)), 9) AS score FROM nr JOIN cv USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bo QUALIFY rank <= 20)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk JOIN qs USING (query_id) WHERE score >= 0.6 AND rank <= CASE kind WHEN 'single' THEN 15 ELSE 20 END""")
def dense_entity_boost(spark, sf):
    """Dense search, three times as deep, scored again with the entities that a text holds."""
    vector = text.hash_embedding(text.search_tokens(F.coalesce("text", F.lit(""))))
    asked = _named_questions(spark, sf).select("query_id", "kind", vector.alias("v"), F.slice("names", 1, 3).alias("routed"), F.slice("names", 4, 3).alias("known"))
    found = entities.boosted_dense(asked, t(spark, sf, "documents").select("doc_id", "text", vector.alias("v")))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_TR + " SELECT head, 'related_to' AS relation, tail, min(tid) AS triple_id, arg_min(conf, tid) AS confidence FROM tr GROUP BY head, tail")
def distinct_triples(spark, sf):
    """Of triples of one head, relation and tail the first."""
    return triples.distinct_triples(_triples(spark, sf)).select("head", "relation", "tail", "triple_id", "confidence")


@query(f"""WITH RECURSIVE {_PLACES}, w AS (SELECT r_regionkey AS query_id, 'r' || r_regionkey AS node, 0 AS depth FROM region
  UNION SELECT query_id, b, depth + 1 FROM w JOIN bo ON a = node WHERE depth < 4)
SELECT CAST(query_id AS BIGINT) AS query_id, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL""")
def graph_four_hops(spark, sf):
    seeds = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.expand(_places(spark, sf), seeds, 4)
