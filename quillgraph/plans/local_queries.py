"""Queries among a question's own passages: the first turn of a conversation asks, the others are its passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as q
from ..functions import text
from ..operators import identity, local
from ..operators.scoped import default_embed
from .registry import query, t
from .scoped_queries import _COS, _VECTOR

# In the SQL letters with accents become underscores: they are part of a word, which RE2's word boundaries don't know.
_PHRASE = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_''.-]*(?:\s+(?:of|the|and|de|[A-Z][A-Za-z0-9_''.-]*)){0,5})"
_BASE = rf"""WITH tu AS (SELECT conv_id AS query_id, turn AS idx, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
qs AS (SELECT query_id, text, CASE query_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'cross' ELSE 'correlation' END AS kind, CASE WHEN query_id % 5 = 0 THEN 'yes' ELSE (SELECT any_value(regexp_extract(b.text, '[A-Za-z0-9]+')) FROM tu b WHERE b.query_id = tu.query_id AND b.n = 2) END AS answer FROM tu WHERE n = 1),
ch AS (SELECT query_id, idx, text, query_id || '_' || idx AS source, coalesce(regexp_replace(regexp_replace([x FOR x IN regexp_extract_all(text, '{_PHRASE}', 1) IF length(trim(x)) >= 3][1], '^[ ,.;:()]+', ''), '[ ,.;:()]+$', ''), '') AS title FROM tu WHERE n > 1)"""
_LB = r""", ct AS (SELECT query_id, idx, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM ch), st AS (SELECT query_id, count(*) AS n, avg(len(w)) AS m FROM ct GROUP BY 1 HAVING avg(len(w)) > 0),
tf AS (SELECT query_id, idx, dl, token, count(*) AS tf FROM (SELECT query_id, idx, len(w) AS dl, unnest(w) AS token FROM ct) GROUP BY ALL), df AS (SELECT query_id, token, count(*) AS df FROM tf GROUP BY ALL),
rw AS (SELECT query_id, token, m, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING (query_id)), av AS (SELECT query_id, avg(raw) AS a FROM rw GROUP BY 1),
qt AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM qs) GROUP BY ALL),
sc AS (SELECT query_id, idx, sum(qf * CASE WHEN raw < 0 THEN 0.25 * a ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) AS score FROM tf JOIN rw USING (query_id, token) JOIN qt USING (query_id, token) JOIN av USING (query_id) GROUP BY ALL),
lb AS (SELECT ct.query_id, ct.idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY ct.query_id ORDER BY round(coalesce(score, 0), 9) DESC, ct.idx) AS rank FROM ct JOIN st USING (query_id) LEFT JOIN sc USING (query_id, idx) WHERE ct.query_id IN (SELECT query_id FROM qt) QUALIFY rank <= 10)"""
_LD = f""", ld AS (SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM (SELECT ch.query_id, ch.idx, {_COS.format(a="qv", b="cv")} AS score FROM (SELECT query_id, idx, text, {_VECTOR.format(c="text")} AS cv FROM ch) ch JOIN (SELECT query_id, {_VECTOR.format(c="text")} AS qv FROM qs) USING (query_id) WHERE trim(text) <> '') QUALIFY rank <= 10),
mu AS (SELECT query_id, idx, score, rank, 'dense' AS channel, 0 AS c FROM ld UNION ALL SELECT query_id, idx, score, rank, 'bm25', 1 FROM lb),
mo AS (SELECT mu.* FROM mu JOIN ch USING (query_id, idx) QUALIFY row_number() OVER (PARTITION BY query_id, source, substr(text, 1, 200) ORDER BY c, rank) = 1),
mh AS (SELECT query_id, idx, channel, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, c, rank) AS position FROM mo QUALIFY position <= 5)"""


def _local(spark, sf):
    from pyspark.sql.window import Window

    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("idx")))
    i = F.col("query_id")
    kind = F.when(i % 3 == 0, "single").when(i % 3 == 1, "cross").otherwise("correlation")
    second = c.where("n = 2").select("query_id", F.regexp_extract("text", "([A-Za-z0-9]+)", 1).alias("second"))
    asked = c.where("n = 1").join(second, "query_id", "left").select("query_id", "text", kind.alias("kind"), F.when(i % 5 == 0, "yes").otherwise(F.col("second")).alias("answer"), q.names(F.col("text")).alias("names"))
    title = F.coalesce(F.get(text.capitalised_phrases(F.lit(""), F.col("text")), 0), F.lit(""))
    return asked, local.with_identity(c.where("n > 1").select("query_id", "idx", "text", title.alias("title")))


@query(_BASE + " SELECT query_id, idx, source, 'passage::' || source AS evidence_id FROM ch")
def local_passages(spark, sf):
    return _local(spark, sf)[1].select("query_id", "idx", "source", "evidence_id")


@query(_BASE + r""", nm AS (SELECT query_id, lower(trim(coalesce(answer, ''))) AS a, [x FOR x IN regexp_extract_all(regexp_replace(text, '[\x{00C0}-\x{024F}]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') IF length(x) > 3] AS names FROM qs),
gd AS (SELECT ch.query_id, idx, a IN ('yes', 'no') AS w, CASE WHEN a IN ('yes', 'no') THEN len([x FOR x IN names IF contains(text, x)]) > 0 ELSE a <> '' AND contains(lower(text), a) END AS good FROM ch JOIN nm USING (query_id)),
pl AS (SELECT *, sum(good::INTEGER) OVER (PARTITION BY query_id ORDER BY idx) AS n, bool_or(good) OVER (PARTITION BY query_id) AS any_, row_number() OVER (PARTITION BY query_id ORDER BY idx) AS r FROM gd)
SELECT query_id, idx FROM pl WHERE CASE WHEN any_ THEN good AND (NOT w OR n <= 4) ELSE r = 1 END""")
def local_gold(spark, sf):
    """Gold passages inferred from answers, names or place."""
    return local.infer_gold(*_local(spark, sf))


@query(_BASE + _LB + " SELECT query_id, idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM lb")
def local_bm25(spark, sf):
    return local.local_bm25(*_local(spark, sf)).select("query_id", "idx", "rank", F.round("score", 6).alias("score"))


def _merged(spark, sf):
    asked, chunks = _local(spark, sf)
    return local.merged_hits(local.local_dense(asked, chunks, default_embed), local.local_bm25(asked, chunks), chunks, 5), asked, chunks


@query(_BASE + _LB + _LD + " SELECT query_id, idx, channel, CAST(position AS INTEGER) AS position, round(score, 6) AS score FROM mh")
def local_merge(spark, sf):
    """Dense and lexical hits among a question's passages, by their raw scores."""
    return _merged(spark, sf)[0].select("query_id", "idx", "channel", "position", F.round("score", 6).alias("score"))


@query(_BASE + _LB + _LD + r""", en AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(regexp_replace(text, '[\x{00C0}-\x{024F}]', '_', 'g'), '\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)+\b') || regexp_extract_all(regexp_replace(text, '[\x{00C0}-\x{024F}]', '_', 'g'), '\b[A-Z][a-zA-Z0-9]*(?:\s+\d+)\b') ||
  [x FOR x IN regexp_extract_all(regexp_replace(text, '[\x{00C0}-\x{024F}]', '_', 'g'), '\b[A-Z][a-zA-Z]{3,}\b') IF lower(x) NOT IN ('which', 'what', 'where', 'when', 'whose', 'whom', 'both', 'were', 'with', 'from', 'that', 'this', 'among', 'after', 'before', 'about')])) AS e FROM qs),
ek AS (SELECT query_id, e FROM en a WHERE length(e) >= 3 AND NOT EXISTS (SELECT 1 FROM en b WHERE b.query_id = a.query_id AND b.e <> a.e AND contains(b.e, a.e))), ec AS (SELECT query_id, count(*) AS n FROM ek GROUP BY 1),
bl AS (SELECT mh.query_id, mh.idx, mh.score, lower(title) AS t, lower(title) || chr(10) || lower(ch.text) AS b FROM mh JOIN ch USING (query_id, idx)),
cv AS (SELECT bl.query_id, idx, count(*) AS cover, count(*) FILTER (regexp_matches(e, '[ \d]')) AS phrases, count(*) FILTER (contains(t, e)) AS titles FROM bl JOIN ek ON ek.query_id = bl.query_id AND contains(b, e) GROUP BY ALL),
wd AS (SELECT bl.query_id, idx, len([x FOR x IN regexp_extract_all(lower(qs.text), '[a-z0-9]{5,}') IF contains(b, x)]) AS words FROM bl JOIN qs USING (query_id)),
bo AS (SELECT bl.query_id, bl.idx, coalesce(cover, 0) AS cover, coalesce(phrases, 0) AS phrases, round(score + least(0.35 * coalesce(phrases, 0) + 0.15 * (coalesce(cover, 0) - coalesce(phrases, 0)) + 0.25 * coalesce(titles, 0)
  + CASE WHEN coalesce(cover, 0) >= 2 THEN 0.70 + 0.35 * phrases WHEN cover = 1 AND n >= 2 THEN 0.05 ELSE 0.0 END + 0.01 * words, 2.5), 9) AS score FROM bl JOIN wd USING (query_id, idx) LEFT JOIN cv USING (query_id, idx) LEFT JOIN ec USING (query_id))
SELECT query_id, idx, CAST(cover AS INTEGER) AS cover, CAST(phrases AS INTEGER) AS phrases, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, phrases DESC, cover DESC, idx) AS INTEGER) AS rank FROM bo""")
def local_boost(spark, sf):
    """Merged hits again, those that hold more of the question's names first."""
    hits, asked, chunks = _merged(spark, sf)
    return local.boosted_hits(hits, asked, chunks).select("query_id", "idx", "cover", "phrases", F.round("score", 6).alias("score"), "rank")


@query(_BASE + _LB + _LD + r""", gd AS (SELECT query_id, idx FROM ld WHERE rank <= 2), pm AS (SELECT mh.query_id, mh.idx, score, position AS r, EXISTS (SELECT 1 FROM gd WHERE gd.query_id = mh.query_id AND gd.idx = mh.idx) AS f FROM mh),
pp AS (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY r) AS place FROM pm)
SELECT query_id, idx, round(CASE WHEN f THEN greatest(score, 0.95 - 0.01 * (place - 1)) ELSE score END, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN f THEN 0 ELSE 1 END, r) AS INTEGER) AS position FROM pp""")
def local_promotion(spark, sf):
    """Merged hits with the two most similar passages in front."""
    hits, asked, chunks = _merged(spark, sf)
    preferred = local.local_dense(asked, chunks, default_embed, 2)
    return local.promoted(hits.withColumnRenamed("position", "rank"), preferred).select("query_id", "idx", F.round("score", 6).alias("score"), "position")


def _graph(spark, sf):
    asked, chunks = _local(spark, sf)
    names = chunks.select("query_id", "idx", "text", text.capitalised_phrases(F.lit(""), F.col("text")).alias("names"))
    mentions = identity.stash(names.select("query_id", "idx", F.explode("names").alias("name")))
    edges = identity.stash(names.where(F.size("names") > 1).select("query_id", F.get("names", 0).alias("head"), F.explode(F.slice("names", 2, 11)).alias("tail"), F.lit("with").alias("relation"), "idx", F.substring("text", 1, 800).alias("paragraph")))
    return local.local_graph(asked, chunks, mentions, edges), chunks


@query()
def local_graph(spark, sf):
    """Triples of a question's passages around the names it means; a test compares it with a plain version."""
    return _graph(spark, sf)[0].select("query_id", "head", "relation", "tail", "idx", "confidence", "rank")


@query()
def local_injection(spark, sf):
    """Passages of those triples, with others where they are few; a test compares it with a plain version."""
    return local.injected_passages(*_graph(spark, sf)).select("query_id", "idx", "origin", "score", "position")
