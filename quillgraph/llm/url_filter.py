"""URL filter by the log-likelihood ratio of two character language models.

Host rules judge what they fit. The URLs that they judge also train two Markov models of variable order, one for allowed
and one for blocked URLs: the probability of a symbol after its ``order`` predecessors is interpolated with the one after
fewer (Witten-Bell), down to a uniform one. URLs without a rule are judged by the difference of the two log-likelihoods
for each symbol, against a threshold calibrated on judged URLs that training left out. Columns and SQL functions only.

Symbols are letters, a digit, four marks and "other", 32 with the padding, so a model has at most 32 ** (order + 1)
entries (1,048,576 at order 3) whatever the number of URLs. The ratio of the models is a written table of that size at
most, which scoring broadcasts after counting it; nothing of it passes through the driver's plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, small, stash, table

#: (verdict, host and path prefix), as the contract of the query states them.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
SYMBOLS = 32
SCALE = 1000  # ratios are thousandths of a nat
PAD, OTHER = "`", "\x7f"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: then up to "?", "#" or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def symbols(host: Column, path: Column) -> Column:
    text = F.translate(F.concat(host, path), UPPER, LOWER)
    return F.translate(F.regexp_replace(text, r"[^a-z0-9./-]", OTHER), "0123456789./-", "{{{{{{{{{{|}~")


def windows(rows: DataFrame, order: int, *carry: str) -> DataFrame:
    """``carry`` and ``window``: each symbol of ``symbols`` and the end, behind its ``order`` predecessors, as bytes."""
    padded = F.concat(F.lit(PAD * order), "symbols", F.lit(PAD)).cast("binary")  # bytes: each window costs the same anywhere
    return rows.select(*carry, F.explode(F.transform(F.sequence(F.lit(1), F.length("symbols") + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))).alias("window"))


def ratio_table(urls: DataFrame, order: int) -> DataFrame:
    """``window`` and ``ratio``, its log ratio in thousandths of a nat, for each window of ``urls`` (``symbols``, ``allowed``, ``blocked``).

    At most SYMBOLS ** (order + 1) rows. Those with counts of 0 are there for the URLs that the models will score.
    """
    size = order + 1
    seen = windows(urls, order, "allowed", "blocked").groupBy("window").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    code = F.lit(0)
    for k in range(size):
        code = code * SYMBOLS + F.ascii(F.substring("window", k + 1, 1).cast("string")) - 96
    seen = stash(seen.select("window", code.cast("int").alias("code"), "allowed", "blocked"))
    lower = None
    for k in range(size):
        # the last level has one window for each code
        here = seen if k == order else seen.groupBy((F.col("code") % SYMBOLS ** (k + 1)).alias("code")).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
        context = Window.partitionBy((F.col("code") / SYMBOLS).cast("int"))  # SYMBOLS rows each at most
        here = here.select(*here.columns, (F.col("code") % SYMBOLS**k).alias("shorter"), *(f(n).alias(f"{tag}_{n}") for n in ("allowed", "blocked") for tag, f in (("all", lambda c: F.sum(c).over(context)), ("kinds", lambda c: F.count_if(F.col(c) > 0).over(context)))))
        if lower is None:
            here = here.withColumns({f"q_{n}": F.lit(1.0 / SYMBOLS) for n in ("allowed", "blocked")})
        else:
            here = here.join(lower, "shorter")
        smooth = lambda n: F.when(F.col(f"all_{n}") > 0, (F.col(n) + F.col(f"kinds_{n}") * F.col(f"q_{n}")) / (F.col(f"all_{n}") + F.col(f"kinds_{n}"))).otherwise(F.col(f"q_{n}"))
        if k == order:
            return here.select("window", F.round(SCALE * F.ln(smooth("allowed") / smooth("blocked"))).cast("int").alias("ratio"))
        lower = here.select(F.col("code").alias("shorter"), *(smooth(n).alias(f"q_{n}") for n in ("allowed", "blocked")))


def scores(rows: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """``_row`` and ``score``, the mean log ratio of a symbol in nats. Windows add up where they arise: a row is shuffled once."""
    found = windows(rows, order, "_row").join(small(ratios, SYMBOLS ** (order + 1)), "window")
    return found.groupBy("_row").agg((F.sum("ratio") / F.lit(float(SCALE)) / F.count("*")).alias("score"))


def threshold(held: DataFrame) -> DataFrame:
    """One row, ``least``: the hundredth of a nat with the fewest wrong verdicts over ``held`` (``score``, ``_by_rule``), 0 without both classes.

    A cut at a bin blocks the allowed URLs below it and lets the blocked ones from it on pass; each class weighs the same;
    the lowest of equal cuts counts. There are a few hundred bins: a mean log ratio lies between the extremes of the table.
    """
    bins = held.groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin")).agg(*(F.count_if(F.col("_by_rule") == kind).alias(kind) for kind in ("allow", "block")))
    below, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = {f"all_{kind}": F.sum(kind).over(all_) for kind in ("allow", "block")}
    passed = {f"below_{kind}": F.coalesce(F.sum(kind).over(below), F.lit(0)) for kind in ("allow", "block")}
    wrong = F.col("below_allow") / F.col("all_allow") + (F.col("all_block") - F.col("below_block")) / F.col("all_block")
    judged = bins.withColumns(totals | passed).where("all_allow > 0 and all_block > 0")
    return judged.agg(F.coalesce(F.min(F.struct(F.round(wrong, 12).alias("wrong"), "bin"))["bin"] / 100.0, F.lit(0.0)).alias("least"))


def fold(url: Column, folds: int) -> Column:
    """A number below ``folds`` from the URL's MD5, alike in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % folds


def url_filter(pages: DataFrame, order: int = 3, holdout: int = 5, url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule judged) of each row.

    One in ``holdout`` of the URLs that rules judge, by hash, is kept for calibration: the threshold is the hundredth of
    a nat with the fewest wrong verdicts there (each class weighing the same; ties: the lowest). Without held-out URLs of
    both classes it is 0. Null URLs and those without "://" have an empty host and path, no rule and a score of their
    own. Rows are never merged or dropped: repeated rows and null ids come back as they are; an empty table gives an
    empty result; other columns are ignored. Texts of any length are scored whole.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), fold(F.col(url), holdout).alias("_fold"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    # written once with a number for each row: rows that agree in all columns stay apart
    rows = stash(rows.select("*", rule.alias("rule"), verdict.alias("_by_rule"), symbols(F.col("host"), F.col("path")).alias("symbols"), F.monotonically_increasing_id().alias("_row")))
    trains = (F.col("_fold") != 0) & F.col("_by_rule").isNotNull()
    ratios = stash(ratio_table(rows.select("symbols", *((trains & (F.col("_by_rule") == kind)).cast("int").alias(name) for kind, name in (("allow", "allowed"), ("block", "blocked")))).na.fill(0), order))
    asked = rows.where(F.col("rule").isNull() | (F.col("_fold") == 0))
    scored = stash(rows.drop("symbols").join(scores(asked, ratios, order), "_row", "left"))
    least = threshold(scored.where(F.col("rule").isNotNull() & (F.col("_fold") == 0))).first()["least"]
    score_column = F.when(F.col("rule").isNull(), F.col("score"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"), score_column.alias("score")
    )


def _sql(order: int = 3, holdout: int = 5) -> str:
    """The same over ``pages`` in plain SQL: back-off levels are unrolled."""
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = []
    for _, text in rules:
        name, slash, start = text.partition("/")
        fits.append(f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}')")
    rule = " ".join(f"WHEN {f} THEN '{r[1]}'" for f, r in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r[0]}'" for f, r in zip(fits, rules, strict=True))
    levels = []
    for k in range(order + 1):
        smooth = lambda n: f"CASE WHEN sum(h.{n}) OVER c > 0 THEN (h.{n} + count(*) FILTER (h.{n} > 0) OVER c * {'l.p_' + n if k else 1 / SYMBOLS}) / (sum(h.{n}) OVER c + count(*) FILTER (h.{n} > 0) OVER c) ELSE {'l.p_' + n if k else 1 / SYMBOLS} END"  # noqa: E731, B023
        levels.append(
            f"l{k} AS (SELECT h.w, {smooth('a')} AS p_a, {smooth('b')} AS p_b FROM (SELECT right(w, {k + 1}) AS w, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM seen GROUP BY 1) h "
            + (f"JOIN l{k - 1} l ON l.w = right(h.w, {k}) " if k else "")
            + f"WINDOW c AS (PARTITION BY left(h.w, {k})))"
        )
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
x AS (SELECT r, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
y AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {holdout} AS fold FROM x),
z AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS by_rule,
  translate(regexp_replace(translate(host || path, '{UPPER}', '{LOWER}'), '[^a-z0-9./-]', chr(127), 'g'), '0123456789./-', repeat(chr(123), 10) || chr(124) || chr(125) || chr(126)) AS s FROM y),
p AS (SELECT *, repeat('{PAD}', {order}) || s || '{PAD}' AS padded FROM z),
n AS MATERIALIZED (SELECT r, fold, by_rule, unnest([substr(padded, i, {order + 1}) FOR i IN range(1, length(s) + 2)]) AS w FROM p),
seen AS MATERIALIZED (SELECT w, count(*) FILTER (fold <> 0 AND by_rule = 'allow') AS a, count(*) FILTER (fold <> 0 AND by_rule = 'block') AS b FROM n GROUP BY 1),
{", ".join(levels)},
t AS (SELECT w, round({SCALE} * ln(p_a / p_b)) AS ratio FROM l{order}),
sc AS MATERIALIZED (SELECT r, sum(ratio) / {float(SCALE)} / count(*) AS score FROM n JOIN t USING (w) GROUP BY 1),
bins AS (SELECT floor(score * 100) AS bin, CAST(count(*) FILTER (by_rule = 'allow') AS DOUBLE) AS a, CAST(count(*) FILTER (by_rule = 'block') AS DOUBLE) AS b FROM z JOIN sc USING (r) WHERE fold = 0 AND rule IS NOT NULL GROUP BY 1),
cuts AS (SELECT bin, sum(a) OVER () AS aa, sum(b) OVER () AS bb, coalesce(sum(a) OVER o, 0) AS la, coalesce(sum(b) OVER o, 0) AS lb FROM bins WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least_ AS (SELECT coalesce((SELECT bin / 100.0 FROM cuts WHERE aa > 0 AND bb > 0 ORDER BY round(la / aa + (bb - lb) / bb, 12), bin LIMIT 1), 0.0) AS least)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN round(score, 9) END AS score
FROM z JOIN sc USING (r), least_
"""


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 9))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": _sql()}
