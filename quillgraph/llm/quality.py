"""Quality rules whose cutoffs control the risk of rejecting good documents.

Each rule gives a document a whole number, higher for worse. Labelled documents are the holdout. Within a stratum
(a language), among those that pass the base rule, a rule's cutoff moves from "rejects nothing" to stricter values for as long as an exact binomial test
shows that at most a share ``risk / rules`` of good documents is rejected: P(Binomial(n, risk / rules) <= k) is at most
alpha / (strata * rules), for k of n good labelled documents rejected. Testing nested cutoffs in a fixed order and
stopping at the first failure needs no correction for their number; the division corrects for strata and rules (Bonferroni).
By the union bound a good document then passes all rules of its stratum with probability 1 - ``risk`` at least, in all
strata at once, with confidence 1 - ``alpha``. A cutoff is only used if it rejects bad documents far more often than good.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stash, table, texts

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Whole numbers from the counts, 0 to 400; higher is worse.
RULES = {
    "symbols": "least(400, 100 * n_symbols div n_words)",
    "dup_lines": "100 * n_dup_lines div n_lines",
    "repeats": "100 * n_repeat_words div n_words",
    "long_words": "least(400, 10 * word_chars div n_words)",
    "short_words": "400 - least(400, 10 * word_chars div n_words)",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first included. Hashes propose, the words themselves decide."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    proposed = np.flatnonzero(np.isin(rolled, twice)).tolist()
    seen: dict[tuple, list[int]] = {}
    for i in proposed:
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    starts = [i for places in seen.values() if len(places) > 1 for i in places]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.array(starts, np.int64) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    words = raw.split()
    text = raw.decode("utf-8", "replace")
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(raw.count(s) for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_counts(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``COUNTS`` as longs, prefixed with ``_q_``."""
    names = [f"_q_{c}" for c in COUNTS]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        import pyarrow as pa

        for batch, rows in texts(batches, "_q_text"):
            counts = list(zip(*map(counts_of, rows), strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(c, pa.int64()) for c in counts)], [*carry, *names])

    return docs.select(*carry, F.col(text).cast("string").alias("_q_text")).mapInArrow(run, schema)


def _log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) <= k), summed exactly."""
    i = np.arange(k + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    terms = choose + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))


def cutoff(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, alpha: float, lift: float) -> int | None:
    """Lowest certified cutoff (reject from it on) that rejects bad documents ``lift`` times as often as good ones."""
    order = np.argsort(-bins)
    bins, n_good, n_bad = bins[order], good.sum(), bad.sum()
    rejected_good, rejected_bad = np.cumsum(good[order]), np.cumsum(bad[order])
    best = None
    for b, k, hit in zip(bins.tolist(), rejected_good.tolist(), rejected_bad.tolist(), strict=True):
        if k >= n_good * risk or _log_binomial_tail(int(k), int(n_good), risk) > math.log(alpha):
            break
        if hit and hit * n_good >= lift * k * n_bad:
            best = b
    return best


def base_failed(prefix: str = "", min_words: int = 20, max_repeat: int = 30):
    """Too few words, or too many of them in repeated windows."""
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < min_words) | (100 * repeated > max_repeat * n)


def risk_controlled_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str, risk: float, alpha: float, lift: float) -> DataFrame:
    """``_stratum`` and a column for each rule: the cutoff, or null, from labelled documents that pass the base rule. At most a few hundred bins of a rule come together."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    rules = ", ".join(f"'{name}', cast({rule} as int)" for name, rule in RULES.items())
    plain = counted.where(~base_failed("_q_")).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("_stratum"), *(F.col(f"_q_{c}").alias(c) for c in COUNTS))
    held = plain.join(labels, "doc_id").selectExpr("_stratum", "_quality", f"stack({len(RULES)}, {rules}) as (rule, bin)")
    bins = held.groupBy("_stratum", "rule", "bin").agg(F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_quality") == 0).alias("bad"))
    tests = bins.select(F.count_distinct("_stratum").alias("n")).first()["n"] * len(RULES)

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"_stratum": key[0]}
        for name, rows in pdf.groupby("rule"):
            row[name] = cutoff(*(rows[c].to_numpy() for c in ("bin", "good", "bad")), risk / len(RULES), alpha / max(1, tests), lift)
        return pd.DataFrame([row]).reindex(columns=["_stratum", *RULES])

    return bins.groupBy("_stratum").applyInPandas(choose, "_stratum string, " + ", ".join(f"{r} int" for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], stratum: str = "lang", risk: float = 0.02, alpha: float = 0.05, lift: float = 5.0) -> DataFrame:
    """The columns ``carry`` of each row of ``docs`` and, prefixed with ``_q_``: ``COUNTS``, ``base_failed``, ``failed_rules``, ``kept``.

    ``carry`` must name doc_id and the stratum. A null text has no words and fails the base rule; a null stratum is the
    stratum of the empty string; a stratum without enough labels gets no cutoffs, so only the base rule rejects there.
    Several labels of a document count once, as good if one says so; labels without a document have no effect. Rows are
    never merged: repeated rows are judged alike, rows with a null id by the rules but never by labels. Rules that reach
    their cutoff exactly reject. An empty table gives an empty result; columns beside ``carry`` are ignored, and names clash
    only with those that begin with ``_q_``. Texts of any length count whole, one at a time.
    """
    counted = stash(with_counts(docs, carry))
    cutoffs = stash(risk_controlled_cutoffs(counted, labels, stratum, risk, alpha, lift))
    cutoffs = cutoffs.select(F.col("_stratum").alias("_q_stratum"), *(F.col(r).alias(f"_q_cut_{r}") for r in RULES))
    joined = counted.withColumn("_q_stratum", F.coalesce(F.col(stratum), F.lit(""))).join(small(cutoffs, 10_000), "_q_stratum", "left")
    base = base_failed("_q_")
    values = {name: F.expr(re.sub(r"\b(n_|word_)", r"_q_\1", rule)) for name, rule in RULES.items()}
    failed = F.array_compact(F.array(*(F.when(~base & (value >= F.col(f"_q_cut_{name}")), name) for name, value in values.items())))
    out = joined.withColumns({"_q_base_failed": base, "_q_failed_rules": failed})
    out = out.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.size("_q_failed_rules") == 0))
    return out.select(*carry, *(f"_q_{c}" for c in (*COUNTS, "base_failed", "failed_rules", "kept")))


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, as they are. ``docs`` may have any other columns: a row travels as one value."""
    stratum = settings.get("stratum", "lang")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.col(stratum).alias(stratum), "text")
    return judged(packed, labels, ["_row", "doc_id", stratum], **settings).where("_q_kept").select("_row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return rows.select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in (*COUNTS[:-1], "base_failed", "kept")))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {
    "op7_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS st, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), rp AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY 1
), b AS (
  SELECT doc_id, st, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM w
), f AS (
  SELECT doc_id, st, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(r, 0) > 30 * n_words AS base_failed
  FROM b LEFT JOIN rp USING (doc_id)
), v AS (
  SELECT doc_id, st, unnest(['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words']) AS rule,
    unnest([least(400, 100 * n_symbols // n_words), 100 * n_dup_lines // n_lines, 100 * n_repeat_words // n_words, least(400, 10 * word_chars // n_words), 400 - least(400, 10 * word_chars // n_words)]) AS bin
  FROM f WHERE NOT base_failed
), l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
bn AS (SELECT st, rule, bin, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 0) AS bad FROM v JOIN l USING (doc_id) GROUP BY ALL),
cu AS (
  SELECT st, rule, bin, sum(good) OVER o AS k, sum(bad) OVER o AS h, sum(good) OVER a AS ng, sum(bad) OVER a AS nb, (SELECT count(DISTINCT st) * 5 FROM bn) AS m
  FROM bn WINDOW o AS (PARTITION BY st, rule ORDER BY bin DESC), a AS (PARTITION BY st, rule)
), te AS (
  SELECT *, CASE WHEN k >= ng * 0.004 THEN false ELSE
    ln(list_sum([exp(lgamma(ng + 1) - lgamma(i + 1) - lgamma(ng - i + 1) + i * ln(0.004) + (ng - i) * ln(1 - 0.004)) FOR i IN range(0, CAST(k AS BIGINT) + 1)])) <= ln(0.05 / m) END AS ok FROM cu
), va AS (SELECT *, bool_and(ok) OVER (PARTITION BY st, rule ORDER BY bin DESC) AS valid FROM te),
ct AS (SELECT st, rule, min(bin) AS cut FROM va WHERE valid AND h > 0 AND h * ng >= 5 * k * nb GROUP BY ALL),
rj AS (SELECT DISTINCT doc_id FROM v JOIN ct USING (st, rule) WHERE bin >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rj) AS kept FROM f
"""
}
