"""Queries within standards. Sources of documents play the standards: ``srcK`` is the standard of number K.

File names and names of standards come from K, questions are the benchmark texts behind the names of one or two standards,
every fourth with a clause. Texts lose letter pairs that would read as codes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunk
from ..functions import questions as q
from ..operators import identity, scoped
from .catalogue import _BM25, _SENTENCES, _bm25
from .registry import query, t

_WORDS = r"[\x{4e00}-\x{9fff}]|[a-z]+|[0-9]+(?:\.[0-9]+)*"
_NAME = "CASE WHEN {k} % 2 = 0 THEN 'HB ' || (8000 + {k}) || '-' || (1990 + {k}) ELSE 'GB/T ' || (20000 + {k}) || '.' || ({k} % 3 + 1) || '-' || (2000 + {k}) END"
_KEY = "CASE WHEN {k} % 2 = 0 THEN 'hb:' || (8000 + {k}) || '::' || (1990 + {k}) ELSE 'gbt:' || (20000 + {k}) || ':' || ({k} % 3 + 1) || ':' || (2000 + {k}) END"
_WORDS_ = _WORDS.replace("{", "{{").replace("}", "}}")
_VECTOR = "[CAST(len([x FOR x IN [CAST('0x' || substr(md5(w), 1, 1) AS INTEGER) FOR w IN regexp_extract_all(lower({c}), '" + _WORDS_ + "')] IF x = d]) AS DOUBLE) FOR d IN range(0, 16)]"
_TOPIC = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:GB/T|GBT|GB|HB(?:/Z)?|GJB|QJ)[\s+]*[\d\-—－/.A-Za-z（）()]+', ' ', 'g'), '综合参考|综合', ' ', 'g'), '\s+', ' ', 'g'), '^[ ，,？?。]+|[ ，,？?。]+$', '', 'g')"
_QS = f"""
q0 AS (SELECT item_id AS query_id, item_id % 20 AS k1, (item_id * 7 + 3) % 20 AS k2, CASE item_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'cross' ELSE 'correlation' END AS kind, regexp_replace(text, '(?i)gb|hb|qj|iso', 'x', 'g') AS t, item_id % 4 = 0 AS named FROM benchmark),
qs AS (SELECT *, {_NAME.format(k="k1")} || CASE WHEN named THEN ' 第 ' || (query_id % 9 + 1) || '.' || (query_id % 4 + 1) || ' 条' ELSE '' END || CASE WHEN kind <> 'single' THEN ' 与 ' || {_NAME.format(k="k2")} ELSE '' END || ' ' || t AS text FROM q0),
ks AS (SELECT query_id, k1 AS k, 0 AS place FROM qs UNION ALL SELECT query_id, k2, 1 FROM qs WHERE kind <> 'single' AND k1 <> k2),
cp AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS k, (doc_id % 9 + 1) || '.' || (doc_id % 4 + 1) AS clause_id, text, length(regexp_replace(text, '\\s+', '', 'g')) AS z FROM documents)"""
_COS = "round(coalesce(nullif(list_cosine_similarity({a}, {b}), 'NaN'::DOUBLE), 0), 9)"


def _number(c):
    return F.regexp_extract(c, r"(\d+)", 1).cast("long")


def _name(k):
    return F.when(k % 2 == 0, F.concat(F.lit("HB "), (k + 8000).cast("string"), F.lit("-"), (k + 1990).cast("string"))).otherwise(F.concat(F.lit("GB/T "), (k + 20000).cast("string"), F.lit("."), (k % 3 + 1).cast("string"), F.lit("-"), (k + 2000).cast("string")))


def _file(k):
    return F.when(k % 2 == 0, F.concat(F.lit("HB+"), (k + 8000).cast("string"), F.lit("-"), (k + 1990).cast("string"), F.lit(".md"))).otherwise(F.concat((k + 20000).cast("string"), F.lit("_"), (k % 3 + 1).cast("string"), F.lit("-"), (k + 2000).cast("string"), F.lit("-gbt-e-300.md")))


def _questions(spark, sf):
    i = F.col("item_id")
    kind = F.when(i % 3 == 0, "single").when(i % 3 == 1, "cross").otherwise("correlation")
    clause = F.when(i % 4 == 0, F.concat(F.lit(" 第 "), (i % 9 + 1).cast("string"), F.lit("."), (i % 4 + 1).cast("string"), F.lit(" 条"))).otherwise("")
    second = F.when(i % 3 != 0, F.concat(F.lit(" 与 "), _name((i * 7 + 3) % 20))).otherwise("")
    text = F.concat(_name(i % 20), clause, second, F.lit(" "), F.regexp_replace("text", "(?i)gb|hb|qj|iso", "x"))
    return t(spark, sf, "benchmark").select(i.alias("query_id"), text.alias("text"), kind.alias("kind"))


def _corpus(spark, sf):
    i = F.col("doc_id")
    return t(spark, sf, "documents").select("doc_id", _file(_number(F.col("source"))).alias("source"), F.concat((i % 9 + 1).cast("string"), F.lit("."), (i % 4 + 1).cast("string")).alias("clause_id"), "text")


_LONGEST = "length(trim(text)) DESC, doc_id"
_E8 = f"e8 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_LONGEST}) AS rank FROM ks JOIN cp USING (k) WHERE z >= 20 QUALIFY rank <= 12)"


@query(f"WITH {_QS}, {_E8} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM e8")
def chunks_by_standard(spark, sf):
    corpus = _corpus(spark, sf)
    keys = scoped.keys_of(_questions(spark, sf))
    return scoped.by_standard(keys, scoped.matched_sources(keys, corpus), corpus)


_E9 = "e9 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY clause_id, doc_id) AS rank FROM qs JOIN cp ON named AND cp.k = k1 AND clause_id = (query_id % 9 + 1) || '.' || (query_id % 4 + 1) QUALIFY rank <= 12)"


@query(f"WITH {_QS}, {_E9} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM e9")
def chunks_by_clause(spark, sf):
    return scoped.by_clause(_questions(spark, sf), _corpus(spark, sf))


@query(f"WITH {_QS} SELECT query_id, place AS source_place, doc_id, CAST(row_number() OVER (PARTITION BY query_id, place ORDER BY {_LONGEST}) AS INTEGER) AS rank FROM ks JOIN cp USING (k) WHERE z >= 20 QUALIFY rank <= 3")
def chunks_by_source(spark, sf):
    corpus = _corpus(spark, sf)
    i = F.col("query_id")
    asked = _questions(spark, sf).select("query_id", F.posexplode(F.array_distinct(F.when(i % 3 == 0, F.array(_file(i % 20))).otherwise(F.array(_file(i % 20), _file((i * 7 + 3) % 20))))).alias("place", "source"))
    return scoped.by_source(asked, scoped.matched_sources(asked.select(F.col("source").alias("key")), corpus), corpus)


_USABLE = r"""z >= 12 AND length(trim(substr(text, 1, 480))) >= 8 AND NOT regexp_matches(substr(text, 1, 480), '(?i)ARINC\s*\d+|Air\s+transport\s+avionics') AND NOT regexp_matches(text, '(?i)Requirements\s+for')
  AND len(regexp_extract_all(text, '(?i)(?:HB|GB/T|GBT|GB|GJB|QJ)\s*\d')) / greatest(1.0, z / 40.0) < 0.42
  AND NOT (regexp_matches(substr(text, 1, 480), '\\mathrm|\\frac|\$\s*\\') AND NOT regexp_matches(substr(text, 1, 480), '\$\$|式中|='))"""
_DENSE = f"""qv AS (SELECT query_id, k, place, {_VECTOR.format(c="text")} AS v FROM qs JOIN ks USING (query_id)), cv AS (SELECT doc_id, k, {_VECTOR.format(c="text")} AS v FROM cp WHERE z >= 24),
dn AS (SELECT query_id, k, place, doc_id, {_COS.format(a="qv.v", b="cv.v")} AS score, row_number() OVER (PARTITION BY query_id, k ORDER BY {_COS.format(a="qv.v", b="cv.v")} DESC, doc_id) AS rank FROM qv JOIN cv USING (k) QUALIFY rank <= 20)"""
_DIRECT = f"""nk AS (SELECT query_id, greatest(8, 20 // count(*)) AS per FROM ks GROUP BY 1),
al AS (SELECT query_id, doc_id, 'clause' AS origin, rank AS o, 0 AS place FROM e9 UNION ALL SELECT query_id, doc_id, 'dense', rank, place FROM dn JOIN nk USING (query_id) WHERE rank <= per UNION ALL SELECT query_id, doc_id, 'longest', rank, 0 FROM e8),
fi AS (SELECT * FROM al QUALIFY min(CASE origin WHEN 'clause' THEN 0 WHEN 'dense' THEN 1 ELSE 2 END) OVER (PARTITION BY query_id) = CASE origin WHEN 'clause' THEN 0 WHEN 'dense' THEN 1 ELSE 2 END),
ti AS (SELECT fi.*, CASE WHEN {_USABLE} THEN 0 WHEN z > 0 THEN 1 ELSE 2 END AS tier FROM fi JOIN cp USING (doc_id)), be AS (SELECT * FROM ti QUALIFY tier = min(tier) OVER (PARTITION BY query_id)),
on_ AS (SELECT query_id, doc_id, min(row(place, o, origin)) AS m FROM be GROUP BY ALL),
sd AS (SELECT query_id, doc_id, m[3] AS origin, row_number() OVER (PARTITION BY query_id ORDER BY m, doc_id) AS rank FROM on_ QUALIFY rank <= 20)"""


@query(f"WITH {_QS}, {_E8}, {_E9}, {_DENSE}, {_DIRECT} SELECT query_id, doc_id, origin, CAST(rank AS INTEGER) AS rank FROM sd")
def standard_direct(spark, sf):
    return scoped.std_direct(_questions(spark, sf), _corpus(spark, sf))


_WITHIN = f"""tp AS (SELECT *, {_TOPIC} AS topic FROM qs),
sub AS (SELECT query_id, k1 AS k, text FROM tp WHERE kind = 'single' UNION ALL SELECT query_id, k1, {_KEY.format(k="k1")} || ' ' || substr(topic, 1, 48) FROM tp WHERE kind = 'single' AND length(topic) >= 6
  UNION ALL SELECT query_id, k, text FROM tp JOIN ks USING (query_id) WHERE kind = 'cross' UNION ALL SELECT query_id, k, topic FROM tp JOIN ks USING (query_id) WHERE kind = 'correlation'),
sv AS (SELECT row_number() OVER () AS s, query_id, k, {_VECTOR.format(c="text")} AS v FROM sub), wv AS (SELECT doc_id, k, {_VECTOR.format(c="text")} AS v FROM cp WHERE z >= 24),
ws AS (SELECT s, query_id, doc_id, {_COS.format(a="sv.v", b="wv.v")} AS score FROM sv JOIN wv USING (k)), wt AS (SELECT * FROM ws QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, doc_id) <= 24),
wi AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM wt GROUP BY ALL) QUALIFY rank <= 20)"""


@query(f"WITH {_QS}, {_WITHIN} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM wi")
def within_standard(spark, sf):
    return scoped.within_standard(_questions(spark, sf), _corpus(spark, sf)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_QS}, {_E8}, {_E9}, {_DENSE}, {_DIRECT}, {_WITHIN}, un AS (SELECT query_id, doc_id, 'within' AS channel, 0 AS c, rank FROM wi UNION ALL SELECT query_id, doc_id, 'direct', 1, rank FROM sd),
kp AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY c, rank) = 1)
SELECT query_id, doc_id, channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c, rank, doc_id) AS INTEGER) AS position FROM kp""")
def scoped_pool(spark, sf):
    """Texts within standards in front of those that standards give directly, each once."""
    questions, corpus = _questions(spark, sf), _corpus(spark, sf)
    parts = [(n, df.select("query_id", "doc_id", "rank")) for n, df in (("within", scoped.within_standard(questions, corpus)), ("direct", scoped.std_direct(questions, corpus)))]
    return identity.merge_channels(parts, ["query_id", "doc_id"]).select("query_id", "doc_id", "channel", "position")


@query(f"""WITH {_QS}, {_BM25.replace("{p}", _WORDS)}, tr AS (SELECT query_id, rank, cp.k FROM bt JOIN cp USING (doc_id)), fs AS (SELECT query_id, k, min(rank) AS place FROM tr GROUP BY ALL),
il AS (SELECT query_id, k, fs.place FROM fs JOIN ks USING (query_id, k)), ls AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY {_LONGEST}) AS rank FROM cp WHERE z >= 20 QUALIFY rank <= 3),
nw AS (SELECT il.query_id, doc_id, 0 AS c, -place AS a, -ls.rank AS b FROM il JOIN ls USING (k) WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.query_id = il.query_id AND bt.doc_id = ls.doc_id)),
u AS (SELECT * FROM nw UNION ALL SELECT query_id, doc_id, 1, rank, 0 FROM bt)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c, a, b, doc_id) AS INTEGER) AS position FROM u QUALIFY position <= 40""")
def source_injection(spark, sf):
    """Lexical hits, and in front of them texts of the files where hits of the question's own standards come from."""
    from ..functions import text

    corpus = _corpus(spark, sf)
    hits = identity.stash(_bm25(spark, sf, text.search_tokens).select("query_id", "doc_id", "rank"))
    triples = hits.join(corpus.select("doc_id", "source"), "doc_id").select("query_id", "rank", "source")
    return scoped.inject_sources(hits, triples, _questions(spark, sf), corpus)


_SENT = f"""{_SENTENCES}, sq AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS part_index, sentence FROM se),
s1 AS (SELECT k, doc_id, part_index, sentence FROM sq JOIN cp USING (doc_id) WHERE part_index < 12 AND cp.z >= 24 QUALIFY row_number() OVER (PARTITION BY k, substr(regexp_replace(sentence, '\\s+', '', 'g'), 1, 240) ORDER BY doc_id, part_index) = 1),
s2 AS (SELECT k, doc_id, part_index, sentence, {_VECTOR.format(c="sentence")} AS v FROM s1), qv AS (SELECT query_id, k, {_VECTOR.format(c="text")} AS v FROM qs JOIN ks USING (query_id)),
sh AS (SELECT query_id, doc_id, part_index, sentence, {_COS.format(a="qv.v", b="s2.v")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS.format(a="qv.v", b="s2.v")} DESC, doc_id, part_index) AS rank FROM qv JOIN s2 USING (k) QUALIFY rank <= 8)"""


def _sentence_hits(spark, sf):
    corpus = _corpus(spark, sf)
    good = corpus.where(scoped.usable(F.col("text"), 24, scoped.HEAD_WORDS, 80)).select("doc_id", "source")
    sentences = identity.stash(chunk.sentences(t(spark, sf, "documents"), "doc_id", "text").join(good, "doc_id"))
    asked = _questions(spark, sf).select("query_id", F.explode(q.standard_keys(F.col("text"))).alias("key"), "text")
    return scoped.sentences_within(asked, scoped.matched_sources(asked, corpus), sentences, 8), sentences


@query(f"WITH {_QS}, {_SENT} SELECT query_id, doc_id, part_index, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM sh")
def sentence_level_search(spark, sf):
    return _sentence_hits(spark, sf)[0].select("query_id", "doc_id", "part_index", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_QS}, {_SENT}, wn AS (SELECT a.query_id, a.doc_id, a.part_index, string_agg(b.sentence, ' ' ORDER BY b.part_index) AS w FROM sh a JOIN sq b ON a.doc_id = b.doc_id AND b.part_index BETWEEN a.part_index - 1 AND a.part_index + 1 GROUP BY ALL)
SELECT query_id, doc_id, part_index, md5(w) AS window_md5 FROM wn""")
def sentence_windows(spark, sf):
    hits, sentences = _sentence_hits(spark, sf)
    return scoped.with_neighbours(hits, sentences, 1).select("query_id", "doc_id", "part_index", F.md5(F.col("window").cast("binary")).alias("window_md5"))


@query(f"""WITH {_QS}, {_SENT} SELECT query_id, doc_id, part_index, CASE WHEN cp.z > length(regexp_replace(sentence, '\\s+', '', 'g')) + 4 AND cp.z <= 2000 THEN 'parent' ELSE 'hit' END AS origin,
  md5(CASE WHEN cp.z > length(regexp_replace(sentence, '\\s+', '', 'g')) + 4 AND cp.z <= 2000 THEN cp.text ELSE sentence END) AS text_md5 FROM sh JOIN cp USING (doc_id)""")
def parent_clauses(spark, sf):
    """Sentences that were hit, with their whole text where that isn't too long."""
    hits, sentences = _sentence_hits(spark, sf)
    named = hits.join(sentences.select("doc_id", "part_index", F.col("sentence").alias("text")), ["doc_id", "part_index"])
    return scoped.with_parents(named, t(spark, sf, "documents")).select("query_id", "doc_id", "part_index", "origin", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {_QS} SELECT query_id, {_NAME.format(k="k1")} || CASE WHEN kind <> 'single' AND k1 <> k2 THEN '|' || {_NAME.format(k="k2")} ELSE '' END AS standards, {_KEY.format(k="k1")} || CASE WHEN kind <> 'single' AND k1 <> k2 THEN '|' || {_KEY.format(k="k2")} ELSE '' END AS keys,
  CASE WHEN named THEN {_NAME.format(k="k1")} || '#' || (query_id % 9 + 1) || '.' || (query_id % 4 + 1) ELSE '' END AS clauses, md5({_TOPIC}) AS topic_md5, regexp_replace(text, '^(\\S+ \\S+)(.*)$', '\\1', 's') || ' applies' AS answer FROM qs""")
def question_analysis(spark, sf):
    """Standards, keys, clauses and topic of each question, and an answer with a slot filled from it."""
    c = F.col("text")
    return _questions(spark, sf).select(
        "query_id", F.array_join(q.standard_ids(c), "|").alias("standards"), F.array_join(q.standard_keys(c), "|").alias("keys"),
        F.array_join(F.transform(q.clause_references(c), lambda r: F.concat(r["standard"], F.lit("#"), r["clause"])), "|").alias("clauses"),
        F.md5(q.topic(c).cast("binary")).alias("topic_md5"), q.with_surfaces(c, F.lit("{标准A} applies")).alias("answer"),
    )
