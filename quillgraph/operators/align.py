"""Fuzzy alignment of paragraphs to clauses of the same source: blocking, scores, argmax with a margin, gates."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.files import stash


def grams_of(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


class Block:
    """The texts of a block by gram. Searches walk from rare grams to common ones and stop when no other text can enter."""

    def __init__(self, texts: list[str], n: int):
        self.texts, self.n, self.grams = texts, n, [grams_of(t, n) for t in texts]
        self.postings, self.rarest, self.short = defaultdict(list), defaultdict(list), defaultdict(list)
        for row, own in enumerate(self.grams):
            for gram in own:
                self.postings[gram].append(row)
        for row, (text_, own) in enumerate(zip(texts, self.grams, strict=True)):
            if len(text_) < n:
                self.short[text_].append(row)
            else:  # a text that lies in another brings its rarest gram along
                self.rarest[min(own, key=lambda g: (len(self.postings[g]), g))].append(row)

    def most_shared(self, own: set[str], limit: int) -> list[int]:
        """The ``limit`` rows that share most of the grams ``own``, ties to the earlier row; rows that share none stay out."""
        known = sorted((g for g in own if g in self.postings), key=lambda g: (len(self.postings[g]), g))
        counts: Counter = Counter()
        for place, gram in enumerate(known):
            left = len(known) - place
            if place % 16 == 0 and len(counts) >= limit:
                least = heapq.nlargest(limit, counts.values())[-1]
                if least > left:  # a row not met yet shares at most ``left`` grams
                    rest = set(known[place:])
                    counts = Counter({row: n + len(rest & self.grams[row]) for row, n in counts.items() if n + left >= least})
                    break
            counts.update(self.postings[gram])
        return heapq.nsmallest(limit, counts, key=lambda row: (-counts[row], row))

    def inside(self, text: str, own: set[str]) -> set[int]:
        """The rows that contain ``text`` or lie in it."""
        if len(text) < self.n:
            holding = {row for gram, rows in self.postings.items() if text in gram for row in rows}
        elif own <= self.postings.keys():
            holding = {row for row in self.postings[min(own, key=lambda g: (len(self.postings[g]), g))] if text in self.texts[row]}
        else:
            holding = set()
        held = {row for gram in own & self.rarest.keys() for row in self.rarest[gram] if self.texts[row] in text}
        return holding | held | {row for short, rows in self.short.items() if short in text for row in rows}


def candidates(paragraphs: DataFrame, clauses: DataFrame, limit: int = 12, n: int = 4, block: int = 512) -> DataFrame:
    """``source``, ``pid``, ``p_text``, ``cid``, ``c_text``: clauses that contain the paragraph or lie in it, and the ``limit`` that share most of its grams.

    ``paragraphs`` has source, pid, p_text, ``clauses`` source, cid, c_text, both compacted; ``shared``, ``p_grams`` and ``c_grams``
    count the grams of a pair for ``score``. A null source and empty texts have no candidates; ties go to the smaller cid.

    Both sides of a source are dealt into blocks of about ``block`` texts. A pair of blocks meets in one task, small sources share
    one, and a paragraph takes from a block ``limit`` rows and the contained ones. Within a block postings of grams, rare ones
    first, with a bound on what is left decide which clauses are looked at.
    """
    sides = ((paragraphs, "pid", "p_text", True), (clauses, "cid", "c_text", False))
    counts = [df.where(F.length(text_) > 0).groupBy("source").agg(F.ceil(F.count("*") / block).alias(f"_n_{id_}"), F.count("*").alias(f"_all_{id_}")) for df, id_, text_, _ in sides]
    blocks = stash(counts[0].join(counts[1], "source"))
    rows = blocks.agg(F.sum(F.col("_all_pid") * F.col("_n_cid") + F.col("_all_cid") * F.col("_n_pid"))).first()[0] or 0
    groups = 1 + rows // (4 * block)
    dealt = None
    for df, id_, text_, asks in sides:
        own, other = ("_pb", "_cb") if asks else ("_cb", "_pb")
        n_other = "_n_cid" if asks else "_n_pid"
        part = df.where(F.length(text_) > 0).join(blocks, "source").select(
            "source", F.col(id_).cast("long").alias("id"), F.col(text_).alias("text"), F.lit(asks).alias("asks"),
            F.pmod(F.xxhash64(id_), F.col(f"_n_{id_}")).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1)).alias(other),
        )
        dealt = part if dealt is None else dealt.unionByName(part)

    def compare(pdf):
        import pandas as pd

        out = []
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
        asks, ids, texts, sources = pdf["asks"].tolist(), pdf["id"].tolist(), pdf["text"].tolist(), pdf["source"].tolist()
        for places in pdf.groupby(["source", "_pb", "_cb"], sort=False).indices.values():
            c = [k for k in places if not asks[k]]
            if not c or len(c) == len(places):
                continue
            known = Block([texts[k] for k in c], n)
            for k in places:
                if asks[k]:
                    own = grams_of(texts[k], n)
                    inside = known.inside(texts[k], own)
                    for row in inside.union(known.most_shared(own, limit)):
                        of = known.grams[row]
                        out.append((sources[k], ids[k], ids[c[row]], len(own & of), len(own), len(of), row in inside))
        return pd.DataFrame(out, columns=["source", "pid", "cid", "shared", "p_grams", "c_grams", "inside"])

    kind = paragraphs.schema["source"].dataType.simpleString()
    schema = f"source {kind}, pid long, cid long, shared long, p_grams long, c_grams long, inside boolean"
    found = dealt.withColumn("_group", F.pmod(F.xxhash64("source", "_pb", "_cb"), F.lit(groups))).groupBy("_group").applyInPandas(compare, schema)
    w = Window.partitionBy("source", "pid").orderBy(F.desc("shared"), "cid")
    kept = found.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") <= limit) | F.col("inside")).drop("_rank", "inside")
    return kept.join(paragraphs, ["source", "pid"]).join(clauses, ["source", "cid"])


def score(gold: Column, clause: Column, sequence: Column | None = None, n: int = 4, counted: tuple[str, str, str] | None = None) -> tuple[Column, Column]:
    """Score in [0, 1] and method of compacted texts. ``sequence`` is a sequence ratio; without it that tenth is 0.

    ``counted`` names columns with the numbers of shared grams, of the paragraph's and of the clause's, where they are known.
    """
    if counted:
        shared, n_gold, n_clause = (F.col(c) for c in counted)
    else:
        grams, of = text.char_ngrams(gold, n), text.char_ngrams(clause, n)
        shared, n_gold, n_clause = F.size(F.array_intersect(grams, of)), F.size(grams), F.size(of)
    recall, precision = shared / F.greatest(n_gold, F.lit(1)), shared / F.greatest(n_clause, F.lit(1))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    cover = F.least(F.length(gold), F.length(clause)) / F.greatest(F.length(gold), F.length(clause))
    fuzzy = 0.72 * recall + 0.18 * f1 + 0.10 * (F.lit(0.0) if sequence is None else sequence)
    empty = (F.length(gold) == 0) | (F.length(clause) == 0)
    value = F.when(empty, 0.0).when(F.contains(clause, gold), 0.92 + 0.08 * cover).when(F.contains(gold, clause), F.least(F.lit(0.91), 0.72 + 0.19 * cover)).otherwise(fuzzy)
    method = F.when(empty, "empty").when(F.contains(clause, gold), "gold_in_clause").when(F.contains(gold, clause), "clause_in_gold").otherwise("fuzzy")
    return value, method


def best_with_margin(scored: DataFrame, keys: list[str], gates: tuple[tuple[float, float, str], ...], digits: int = 9) -> DataFrame:
    """The best clause of each paragraph, ``runner_up_score``, ``margin`` and ``status`` by (least score, least margin, status) in turn.

    Ties go to the smaller cid. Without a candidate a paragraph has no row here.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), "cid")
    ranked = scored.withColumn("_s", F.round("score", digits)).withColumns({"_rank": F.row_number().over(w), "runner_up_score": F.coalesce(F.lead("_s").over(w), F.lit(0.0))})
    best = ranked.where("_rank = 1").withColumn("margin", F.round(F.col("_s") - F.col("runner_up_score"), digits))
    status = F.lit("needs_review")
    for least, margin, name in reversed(gates):
        status = F.when((F.col("_s") >= least) & (F.col("margin") >= margin), name).otherwise(status)
    return best.withColumn("status", status).drop("_rank", "_s")


def best_few(scored: DataFrame, keys: list[str], most: int, digits: int = 9) -> DataFrame:
    """The ``most`` best clauses of each paragraph, ``place`` from 1, for an audit."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", digits)), "cid")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def linked(triples: DataFrame, aligned: DataFrame, keys: list[str], identity: list[str], always: bool = False) -> DataFrame:
    """``triples`` with ``status`` and the columns ``identity`` of their paragraph's clause, null unless it is accepted (or ``always``).

    A paragraph without any candidate is ``unresolved``.
    """
    accepted = F.lit(True) if always else F.col("status") != "needs_review"
    one = aligned.select(*keys, "status", *(F.when(accepted, F.col(c)).alias(c) for c in identity))
    return triples.join(one, keys, "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))


def manifest(rows: DataFrame, source: str, paragraph: list[str], identity: str) -> DataFrame:
    """One row of counts: triples, sources, distinct paragraphs, accepted, to review, unresolved."""
    return rows.agg(
        F.count("*").alias("triples"), F.count_distinct(source).alias("sources"), F.count_distinct(*paragraph).alias("paragraphs"),
        F.count(identity).alias("accepted"), F.count_if(F.col("status") == "needs_review").alias("review"), F.count_if(F.col("status") == "unresolved").alias("unresolved"),
    )


#: Columns of ``candidates`` for ``counted`` of ``score``.
COUNTED = ("shared", "p_grams", "c_grams")
GRAPH_GATES = ((0.90, 0.02, "accepted_high"), (0.65, 0.01, "accepted_medium"))
ANSWER_GATES = ((0.90, 0.03, "accepted_high"), (0.72, 0.015, "accepted_medium"))
