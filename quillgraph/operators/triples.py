"""Triples of a graph: what a question makes of them, within standards and communities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as q
from ..functions import text
from ..sources.files import stash
from . import retrieval
from .containment import contained
from .identity import small
from .scoped import keys_of, matched_sources

#: Parts of relations that questions ask for: facts, logic, meaning.
RELATIONS = (
    "is_a", "has", "has_parameter", "has_value", "has_standard", "has_property", "has_method", "has_test", "has_test_method", "has_requirement", "has_component",
    "has_part", "has_material", "has_condition", "has_version", "has_result", "has_output", "has_input", "has_function", "has_subsystem", "has_subcomponent",
    "has_definition", "has_structure", "has_type", "has_formula", "has_format", "has_step", "has_process", "has_service", "has_equipment", "has_behavior",
    "provided_by", "produced_by", "published_by", "issued_by", "organized_by", "developed_by", "drafted_by", "administered_by", "responsible_for",
    "requires", "require", "depends_on", "depends", "affects", "affect", "causes", "leads_to", "influences", "interfere_with", "prevent", "protect", "replace",
    "combine", "combine_with", "combined_with", "follow", "should_follow", "must_follow", "not_require", "not_required", "not_recommended", "prefer", "allow", "access",
    "connect_to", "connects_to", "connected_to", "connects_with", "call_service", "transmit_by", "transmit", "output_to", "output", "return_value", "return_type",
    "calculate_by", "calculate", "calculated_by",
    "related_to", "similar_to", "part_of", "belongs_to", "associated_with", "compatible_with", "used_with", "used_by", "used_in", "used_for", "representation",
    "representation_of", "representation_in", "representation_to", "equivalent", "matches_with", "equal_to", "based_on", "constitute", "contribute_to", "related",
    "belongs", "associated",
)
#: Most triples by type of question, from the cache, the graph file, and the passages of a question.
CAPS = {"single": 10, "cross": 20, "correlation": 15}
GRAPH_CAPS = {"single": 20, "cross": 15, "correlation": 10}
LOCAL_CAPS = {"single": 24, "cross": 20, "correlation": 16}
#: Questions for definitions and for formulas, and what answers them.
ASKS_DEFINITION, ASKS_FORMULA = "何谓|是什么|定义|指什么", "公式|式中|附录|计算|η"
DEFINITION_CLAUSE, FORMULA_TEXT = r"^3(\.|$)", r"(?i)C\.|附录|公式|\\\\frac|η"


def relevant_relation(c: Column) -> Column:
    """Whether a relation holds one of the known parts; the same for all types of questions."""
    return F.regexp_like(F.lower(F.coalesce(c, F.lit(""))), F.lit("|".join(RELATIONS)))


def _cap(kind: str, caps: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(F.col(kind) == k, n) for k, n in caps.items()), F.lit(min(caps.values())))


def distinct_triples(triples: DataFrame, order: str = "triple_id") -> DataFrame:
    """Of triples of one head, relation and tail the first in ``order``; to be shown by ``confidence``, highest first."""
    columns = [c for c in triples.columns]
    return triples.groupBy("head", "relation", "tail").agg(F.min_by(F.struct(*columns), order).alias("x")).select("x.*")


def entity_hits(questions: DataFrame, triples: DataFrame, most: int) -> DataFrame:
    """``query_id``, ``triple_id``, ``place``: the first of a question's names (array ``names``) that lies in head or tail."""
    names = questions.select("query_id", F.posexplode(F.slice("names", 1, most)).alias("place", "name")).where("name <> ''")
    sides = [triples.select("triple_id", F.explode(F.array("head", "tail")).alias("hay"))]
    hays = sides[0].where("hay is not null").groupBy("hay").agg(F.count("*").alias("_n")).select(F.xxhash64("hay").alias("hid"), "hay")  # each text once
    found = contained(names.select(F.col("name").alias("nid"), F.col("name").alias("needle")), hays)
    of_hay = sides[0].where("hay is not null").select("triple_id", F.xxhash64("hay").alias("hid"))
    pairs = names.join(found.withColumnRenamed("nid", "name"), "name").join(of_hay, "hid")
    return pairs.groupBy("query_id", "triple_id").agg(F.min("place").alias("place"))


def names_held(questions: DataFrame, triples: DataFrame, most: int) -> DataFrame:
    """``triple_id``, ``named``: those of the questions' first ``most`` names that lie in head, tail or paragraph, for triples with one.

    A list holds names of all questions, so it is bounded by its triple's own text and no table of questions by triples is made.
    """
    names = questions.select(F.explode(F.slice("names", 1, most)).alias("name")).where("name <> ''").distinct()
    sides = triples.select("triple_id", F.explode(F.array("head", "tail", "paragraph")).alias("hay")).where("hay is not null").select("triple_id", "hay", F.xxhash64("hay").alias("hid"))
    hays = stash(sides.select("hid", "hay").distinct())  # each text once
    of_hay = contained(names.select(F.col("name").alias("nid"), F.col("name").alias("needle")), hays).groupBy("hid").agg(F.collect_set("nid").alias("found"))
    return sides.select("triple_id", "hid").join(of_hay, "hid").groupBy("triple_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("named"))


def _prepared(triples: DataFrame, relation: bool) -> DataFrame:
    """Triples with ``standard`` (else the source), ``unit`` (of source and standard), ``sid`` (comparison id), ``held`` (distinct tokens,
    of the relation too with ``relation``) and ``apart`` (tokens that only the relation gives), without the paragraph. Tokens are cut once and written."""
    named = F.coalesce(text.blank_to_null(F.col("standard_id")), F.col("source")) if "standard_id" in triples.columns else F.col("source")
    tokens = lambda *parts: F.array_distinct(text.mixed_tokens(F.concat_ws(" ", *parts)))
    whole = triples.withColumn("standard", named).withColumn("unit", F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("standard", F.lit(""))))
    whole = whole.withColumn("shares", tokens("head", "tail", "paragraph"))
    whole = whole.withColumn("held", tokens("head", "relation", "tail", "paragraph") if relation else F.col("shares"))
    # a standard's id takes many patterns, so it is made once for each standard
    sids = small(whole.select("standard").distinct().withColumn("sid", text.comparison_id(F.col("standard"))))
    return stash(whole.withColumn("apart", F.array_except("held", "shares")).drop("shares", "paragraph").join(sids, "standard", "left"))


def scope_units(questions: DataFrame, triples: DataFrame) -> DataFrame:
    """``query_id``, ``unit`` of the prepared triples whose source or standard is one that a question names."""
    keys = stash(keys_of(questions))
    units = stash(triples.select("unit", "source", "standard").distinct())
    by_name = units.select("unit", F.explode(F.array_distinct(F.array("source", "standard"))).alias("source")).where("source <> ''")
    of = matched_sources(keys, by_name)
    return stash(keys.join(of, "key").select("query_id", "source").distinct().join(by_name, "source").select("query_id", "unit").distinct())


def _best_rows(scores: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Those of ``rows`` (in order of their ids) that can be among the ``most`` best once scores are rounded to nine digits."""
    if len(rows) <= most:
        return rows
    own = scores[rows]
    near = own >= np.partition(own, len(own) - most)[len(own) - most] - 2e-9
    rows, own = rows[near], own[near]
    order = np.argsort(-own, kind="stable")
    rows, own = rows[order], own[order]
    # of equal scores the first ids are enough, so a tie of a whole block doesn't leave the task
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
    return rows[place < most]


def best_in_units(asks: DataFrame, rows: DataFrame, judge: Callable, row_block: int = 16_384, query_block: int = 1_024) -> DataFrame:
    """``query_id``, ``triple_id``, ``both`` (tokens shared), ``place`` and ``near`` of the triples that may be a question's best, judged in blocks of one unit.

    ``asks``: id, scope (unit), tokens, most, and what ``judge`` reads; ``rows``: id, scope, tokens, apart, and what it reads. ``judge(both,
    shared, ask, rows)`` gets the tokens that a question shares with each row of a block, with and without the relation's, and returns
    scores, which rows count, and rows to return as ``near`` beside the best. With ``names`` in ``asks`` and ``named`` in ``rows`` (lists of
    strings) the rows that it gets have ``place``: that of the question's first name among the row's, else -1. A unit is cut only if it
    is larger than a block; pairs of a question and a triple exist only inside tasks, and each block returns ``most`` rows a question, and
    ties by rounding.
    """
    every = {f.name: f.dataType for f in [*asks.schema.fields, *rows.schema.fields]}
    full = lambda d: d.select(*(F.col(c) if c in d.columns else F.lit(None).cast(kind).alias(c) for c, kind in every.items()))
    placed = retrieval.placed_in_blocks(full(asks), full(rows), row_block, query_block)
    types = {"query_id": every["id"].simpleString(), "triple_id": rows.schema["id"].dataType.simpleString()}
    by_name = "names" in asks.columns

    def lists(column: pd.Series, index: pd.Index) -> tuple[np.ndarray, np.ndarray]:
        """Places of known tokens and the rows that hold them, by place."""
        sizes = column.map(len).to_numpy()
        place = index.get_indexer(np.concatenate([np.zeros(0, object), *column])) if sizes.sum() else np.zeros(0, int)
        row = np.repeat(np.arange(len(column)), sizes)[place >= 0]
        order = np.argsort(place[place >= 0], kind="stable")
        return place[place >= 0][order], row[order]

    def in_unit(questions: pd.DataFrame, held: pd.DataFrame, out: list) -> None:
        held = held.sort_values("id", kind="stable", ignore_index=True)
        index = pd.Index(pd.unique(np.concatenate([np.zeros(0, object), *questions["tokens"]])))
        posts = [lists(held[c], index) for c in ("tokens", "apart")]
        starts = [np.searchsorted(place, np.arange(len(index) + 1)) for place, _ in posts]
        ids = held["id"].to_numpy()
        if by_name:
            names = pd.Index(pd.unique(np.concatenate([np.zeros(0, object), *questions["names"]])))
            of_name, row_of_name = lists(held["named"], names)
            name_starts = np.searchsorted(of_name, np.arange(len(names) + 1))
        places = np.full(len(held), -1)
        for ask in questions.itertuples():
            if by_name:
                places = np.full(len(held), -1)
                for i, n in reversed(list(enumerate(names.get_indexer(ask.names).tolist()))):
                    places[row_of_name[name_starts[n] : name_starts[n + 1]]] = i
                held["place"] = places
            asked = index.get_indexer(ask.tokens)
            both, apart = (np.bincount(np.concatenate([np.zeros(0, int), *(row[at[t] : at[t + 1]] for t in asked)]), minlength=len(held)) for (_, row), at in zip(posts, starts, strict=True))
            scores, counts, near = judge(both, both - apart, ask, held)
            best = _best_rows(scores, np.flatnonzero(counts), int(ask.most))
            for chosen, mark in ((best, False), (np.flatnonzero(near), True)):
                out.append(pd.DataFrame({"query_id": ask.id, "triple_id": ids[chosen], "both": both[chosen], "place": places[chosen], "near": mark}))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pdf["id"][:0], "triple_id": pdf["id"][:0], "both": np.zeros(0, int), "place": np.zeros(0, int), "near": np.zeros(0, bool)})]
        for _, of_unit in pdf.groupby("scope", sort=False):
            asking = of_unit["asks"].to_numpy(bool)
            if asking.any() and not asking.all():
                in_unit(of_unit[asking], of_unit[~asking], out)
        return pd.concat([d for d in out if len(d)] or out[:1])

    return placed.groupBy("cell", "qb", "rb").applyInPandas(block, f"query_id {types['query_id']}, triple_id {types['triple_id']}, both int, place int, near boolean")


def _in_units(pairs: DataFrame, scope: DataFrame, triples: DataFrame) -> DataFrame:
    """The (query_id, triple_id, ...) pairs whose triple lies in a unit of the question."""
    return pairs.join(triples.select("triple_id", "unit"), "triple_id").join(scope, ["query_id", "unit"], "left_semi").drop("unit")


def _shared(tokens: str, held: str) -> Column:
    return F.size(F.array_intersect(tokens, held))


def rank_triples(questions: DataFrame, triples: DataFrame, two_hops: int = 20) -> DataFrame:
    """``query_id``, ``triple_id``, ``score``, ``rank``, ``origin``: triples for each question, up to the cap of its type.

    ``questions``: query_id, text, kind, names; ``triples``: triple_id, head, relation, tail, paragraph, source, confidence, and standard_id if
    it isn't the source. A question that names standards gets triples of those alone, another one those that hold one of its first ten
    names. A triple is anchored if its standard has the very id that is named; a standard that only matches (another year, a name
    within the other) gives triples with a name. Score: 3 if anchored, 1.5 times the share of its tokens that the triple holds, 0.5
    times how early its name comes, 0.05 times the confidence. The relation must be relevant, but for correlations within standards;
    there an anchored triple without a name must share a token, and ``two_hops`` triples of its standards that touch one found and
    share a token follow with a score of 2.

    Triples with a name are pairs; all others are scored in blocks by standard, from which only the best of each question come.
    """
    triples = _prepared(triples, True)
    asked = questions.select("query_id", "kind", "names", F.array_distinct(text.mixed_tokens(F.coalesce("text", F.lit("")))).alias("tokens"), q.standard_keys(F.coalesce("text", F.lit(""))).alias("keys"))
    asked = stash(asked.withColumn("strict", (F.col("kind") == "correlation") & (F.size("keys") > 0)))
    scope = scope_units(questions, triples)
    anchored = F.coalesce((F.col("sid") != "") & F.array_contains("keys", F.col("sid")), F.lit(False))
    hits = stash(entity_hits(questions, triples, 10))
    hits = stash(_in_units(hits, scope, triples).unionByName(hits.join(asked.where(F.size("keys") == 0).select("query_id"), "query_id", "left_semi")))
    named = hits.join(asked, "query_id").join(triples, "triple_id").where(relevant_relation(F.col("relation")) | F.col("strict"))
    named = named.select("query_id", "triple_id", "place", _shared("tokens", "held").alias("both"), anchored.alias("anchored"))

    def judge(both, shared, ask, rows):
        own = rows["sid"].isin([k for k in ask.keys if k]).to_numpy(bool)
        counts = own & (shared > 0) if ask.strict else own & rows["ok"].to_numpy(bool)
        return 1.5 * both / max(len(ask.tokens), 1) + rows["base"].to_numpy(float), counts, ~own & (shared > 0) & bool(ask.strict)

    asks = scope.join(asked, "query_id").select(F.col("query_id").alias("id"), F.col("unit").alias("scope"), "tokens", "keys", "strict", _cap("kind", CAPS).alias("most"))
    rows = triples.select(F.col("triple_id").alias("id"), F.col("unit").alias("scope"), F.col("held").alias("tokens"), "apart", "sid", relevant_relation(F.col("relation")).alias("ok"), (0.05 * F.coalesce("confidence", F.lit(0.0))).alias("base"))
    judged = stash(best_in_units(asks, rows, judge).join(hits.select("query_id", "triple_id"), ["query_id", "triple_id"], "left_anti"))
    others = judged.where("not near").select("query_id", "triple_id", F.lit(None).cast("int").alias("place"), "both", F.lit(True).alias("anchored"))
    full = named.unionByName(others).join(asked.select("query_id", "kind", F.size("tokens").alias("n"), F.size("names").alias("named")), "query_id").join(triples.select("triple_id", "confidence"), "triple_id")
    place = F.when(F.col("place").isNotNull(), 1 - F.col("place") / F.greatest(F.least(F.col("named"), F.lit(10)), F.lit(1))).otherwise(0.0)
    score = 3.0 * F.col("anchored").cast("double") + 1.5 * (F.col("both") / F.greatest("n", F.lit(1))) + 0.5 * place + 0.05 * F.coalesce("confidence", F.lit(0.0))
    first = full.select("query_id", "triple_id", "kind", F.round(score, 9).alias("score"), F.lit("hop1").alias("origin"))
    near = judged.where("near").select("query_id", "triple_id")
    if not near.isEmpty():
        more = _second_hop(near, hits, scope, asked, triples, anchored, two_hops)
        first = first.unionByName(more.join(asked.select("query_id", "kind"), "query_id").select("query_id", "triple_id", "kind", F.lit(2.0).alias("score"), F.lit("hop2").alias("origin")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "origin", "triple_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= _cap("kind", CAPS)).drop("kind")


def _ends(triples: DataFrame) -> DataFrame:
    return triples.select("unit", "triple_id", F.explode(F.array_distinct(F.array("head", "tail"))).alias("node")).where("node <> ''")


def _second_hop(near: DataFrame, hits: DataFrame, scope: DataFrame, asked: DataFrame, triples: DataFrame, anchored: Column, most: int) -> DataFrame:
    """Those of ``near`` that have a node in common with a triple found and differ from all found: the first ``most`` in order of their ids.

    Found triples are looked up from the nodes of ``near``, so what no candidate touches isn't asked for.
    """
    edge = ["query_id", "head", "relation", "tail"]
    candidates = stash(near.join(triples.select("triple_id", "head", "relation", "tail"), "triple_id").withColumn("node", F.explode(F.array_distinct(F.array("head", "tail")))).where("node <> ''"))
    around = candidates.select("query_id", "node").distinct().join(scope, "query_id").join(_ends(triples), ["unit", "node"]).select("query_id", "node", "triple_id")
    judged = around.join(hits.select("query_id", "triple_id", F.lit(True).alias("hit")), ["query_id", "triple_id"], "left").join(asked.select("query_id", "tokens", "keys"), "query_id").join(triples, "triple_id")
    found = stash(judged.where(F.col("hit").isNotNull() | (anchored & (F.size(F.array_except(F.array_intersect("tokens", "held"), "apart")) > 0))).select("node", *edge))
    touching = candidates.join(found.select("query_id", "node").distinct(), ["query_id", "node"], "left_semi").join(found.select(*edge).distinct(), edge, "left_anti")
    return _first_ids(touching, edge, most)


def _first_ids(pairs: DataFrame, edge: list[str], most: int) -> DataFrame:
    once = pairs.groupBy(*edge).agg(F.min("triple_id").alias("triple_id"))
    w = Window.partitionBy("query_id").orderBy("triple_id")
    return once.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).select("query_id", "triple_id")


def _touching(best: DataFrame, asks: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """``query_id``, ``triple_id``, ``both``: rows (with head, relation, tail) that touch a node of ``best``, aren't among them and share a token: the first ``most`` in order of their ids.

    Of an edge the first id counts. A block returns its first ``most`` edges, which hold all that can be among the first of all blocks.
    """
    edge = F.to_json(F.array("head", "relation", "tail"))
    # as in joins, an edge with a null is none of those found
    known = F.when(F.col("head").isNotNull() & F.col("relation").isNotNull() & F.col("tail").isNotNull(), edge)
    around = best.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array("head", "tail"), lambda x: x != "")))).alias("names"), F.collect_set(known).alias("edges"))

    def judge(both, shared, ask, rows):
        near, seen = np.zeros(len(both), bool), set(ask.edges)
        candidates, more = np.flatnonzero((rows["place"].to_numpy() >= 0) & ((both > 0) | (len(ask.tokens) == 0))), 0
        for row, key in zip(candidates.tolist(), rows["edge"].to_numpy()[candidates].tolist(), strict=True):
            if more == most:
                break
            if key not in seen:
                seen.add(key)
                near[row], more = True, more + 1
        return np.zeros(len(both)), np.zeros(len(both), bool), near

    asked = asks.select("id", "scope", "tokens", "most").join(around, F.col("id") == F.col("query_id")).drop("query_id")
    held = rows.select("id", "scope", "tokens", "apart", F.filter(F.array("head", "tail"), lambda x: x != "").alias("named"), edge.alias("edge"))
    found = stash(best_in_units(asked, held, judge).select("query_id", "triple_id", "both"))
    edges = _of_ids(rows.select(F.col("id").alias("triple_id"), "head", "relation", "tail"), found)
    return _first_ids(found.drop("both").join(edges, "triple_id"), ["query_id", "head", "relation", "tail"], most).join(found, ["query_id", "triple_id"])


def _of_ids(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """The triples of ``pairs``; where their ids are few, the others drop out before any shuffle."""
    return triples.join(small(pairs.select("triple_id").distinct()), "triple_id", "left_semi")


def community_search(questions: DataFrame, triples: DataFrame, most: int = 40, pool: int = 50, two_hops: int = 30) -> DataFrame:
    """``query_id``, ``triple_id``, ``score``, ``rank``: the neighbourhood of a question in the communities (standards) that it names.

    Score: 2.2 times the share of tokens, 0.8 times 1 - 0.05 * place of the first of twelve names in it, 0.35 for a clause of
    definitions and 0.45 for formulas where the question asks for those. A triple needs a name, a shared token or, with
    them, such a clause. Triples that touch the best 40 follow with 0.15 more; one triple of each evidence stays.
    ``triples`` also has clause_id, standard_id, evidence_id. Triples are scored in blocks by standard, names and all; each triple has the
    names that lie in it as a list, so neither those with a name nor those near the best are pairs outside a task.
    """
    c = F.coalesce(F.col("text"), F.lit(""))
    asked = stash(questions.select("query_id", F.array_distinct(text.mixed_tokens(c)).alias("tokens"), F.coalesce(F.slice("names", 1, 12), F.array().cast("array<string>")).alias("names"), F.regexp_like(c, F.lit(ASKS_DEFINITION)).alias("defs"), F.regexp_like(c, F.lit(ASKS_FORMULA)).alias("fors")))
    clause = F.coalesce("clause_id", F.lit(""))
    is_def, is_for = F.regexp_like(clause, F.lit(DEFINITION_CLAUSE)), F.regexp_like(F.concat(F.coalesce("paragraph", F.lit("")), clause), F.lit(FORMULA_TEXT))
    named = names_held(questions, triples, 12)
    triples = _prepared(triples.withColumns({"is_def": is_def, "is_for": is_for}).join(named, "triple_id", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>"))), False)
    scope = scope_units(questions, triples)
    columns = ["query_id", "triple_id", "head", "relation", "tail", "standard_id", "clause_id", "evidence_id"]

    def judge(both, shared, ask, rows):
        defines, formula, place = rows["is_def"].to_numpy(bool) & bool(ask.defs), rows["is_for"].to_numpy(bool) & bool(ask.fors), rows["place"].to_numpy()
        scores = 2.2 * (both / max(len(ask.tokens), 1)) + 0.8 * np.where(place >= 0, 1.0 - 0.05 * place, 0.0) + 0.35 * defines + 0.45 * formula
        return scores, (both > 0) | (place >= 0) | defines | formula, np.zeros(len(both), bool)

    asks = stash(scope.join(asked, "query_id").select(F.col("query_id").alias("id"), F.col("unit").alias("scope"), "tokens", "names", "defs", "fors", F.lit(pool).alias("most")))
    rows = triples.select(F.col("triple_id").alias("id"), F.col("unit").alias("scope"), F.col("held").alias("tokens"), "apart", "named", "is_def", "is_for")
    judged = stash(best_in_units(asks, rows, judge).select("query_id", "triple_id", "both", F.when(F.col("place") >= 0, F.col("place")).alias("place")))

    def scored(pairs: DataFrame) -> DataFrame:
        """``columns`` and score of pairs with ``place`` and ``both``."""
        of = pairs.join(asked.select("query_id", F.size("tokens").alias("n"), "defs", "fors"), "query_id").join(_of_ids(triples.select(*columns[1:], "is_def", "is_for"), pairs), "triple_id")
        value = 2.2 * (F.col("both") / F.greatest("n", F.lit(1))) + 0.8 * F.coalesce(1.0 - 0.05 * F.col("place"), F.lit(0.0))
        value = value + F.when(F.col("defs") & F.col("is_def"), 0.35).otherwise(0.0) + F.when(F.col("fors") & F.col("is_for"), 0.45).otherwise(0.0)
        return of.select(*columns, F.round(value, 9).alias("score"))

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "triple_id")
    best = stash(scored(judged).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= pool))
    edges = triples.select(F.col("triple_id").alias("id"), F.col("unit").alias("scope"), F.col("held").alias("tokens"), "apart", "head", "relation", "tail")
    around = stash(_touching(best.where("_i <= 40"), asks, edges, two_hops))
    first = F.array_min(F.transform("names", lambda x, i: F.when(F.array_contains("named", x), i)))
    placed = around.join(asked.select("query_id", "names"), "query_id").join(_of_ids(triples.select("triple_id", "named"), around), "triple_id").select("query_id", "triple_id", first.alias("place"), "both")
    extra = scored(placed).withColumn("score", F.round(F.col("score") + 0.15, 9))
    union = best.select(*columns, "score", F.lit(0).alias("_o")).unionByName(extra.withColumn("_o", F.lit(1)))
    key = F.coalesce(text.blank_to_null(F.col("evidence_id").cast("string")), F.concat_ws("::", F.coalesce("standard_id", F.lit("")), clause, "head"))
    by_key = Window.partitionBy("query_id", key).orderBy(F.desc("score"), "_o", "triple_id")
    once = union.withColumn("_k", F.row_number().over(by_key)).where("_k = 1")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "_o", "triple_id")
    return once.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= most).select(*columns, "score", "rank")


def community_reports(found: DataFrame, most_triples: int = 8, most_relations: int = 6) -> DataFrame:
    """``query_id``, ``standard_id``, ``report``: clauses and relations of the best triples of each standard that a question reached."""
    w = Window.partitionBy("query_id", "standard_id").orderBy("rank")
    top = found.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most_triples)
    gathered = F.array_sort(F.collect_list(F.struct("_i", F.concat(F.col("head"), F.lit(" -"), F.col("relation"), F.lit("-> "), F.col("tail")).alias("r"), F.coalesce("clause_id", F.lit("")).alias("c"))))
    rows = top.groupBy("query_id", "standard_id").agg(gathered.alias("g"))
    of = F.array_distinct(F.filter(F.transform("g", lambda x: x["c"]), lambda c: c != ""))
    report = F.concat(F.lit("社区 "), F.col("standard_id"), F.lit("：条款 "), F.when(F.size(of) > 0, F.array_join(of, ", ")).otherwise("-"), F.lit("；关系："), F.array_join(F.slice(F.transform("g", lambda x: x["r"]), 1, most_relations), "；"))
    return rows.select("query_id", "standard_id", report.alias("report"))


def _lexical(tokens: Column, *parts: Column) -> Column:
    of = F.array_distinct(text.mixed_tokens(F.concat_ws(" ", *parts)))
    return F.size(F.array_intersect(tokens, of)) / F.greatest(F.size(tokens), F.lit(1))


def texts_of(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``corpus`` that were found (query_id, doc_id, written before); where those are few, other texts drop out before any shuffle."""
    return corpus.join(small(found.select("doc_id").distinct()), "doc_id", "left_semi")


def rank_text_units(questions: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank`` of the units of each question (query_id, doc_id, text, clause_id): the share of tokens, 0.4 for a definition and 0.5 for a formula where they are asked for."""
    c = F.coalesce(F.col("_q"), F.lit(""))
    joined = units.join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    body, clause = F.coalesce("text", F.lit("")), F.coalesce("clause_id", F.lit(""))
    defines = F.regexp_like(c, F.lit(ASKS_DEFINITION)) & F.regexp_like(clause, F.lit(DEFINITION_CLAUSE)) & F.regexp_like(body, F.lit("指|定义为|是由"))
    formula = F.regexp_like(c, F.lit(ASKS_FORMULA)) & F.regexp_like(body, F.lit(r"(?i)C\.|\\\\frac|η\s*=|公式"))
    score = _lexical(F.array_distinct(text.mixed_tokens(c)), body) + F.when(defines, 0.4).otherwise(0.0) + F.when(formula, 0.5).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return joined.select("query_id", "doc_id", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(w))


def graph_triples(questions: DataFrame, relations: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id``, ``head``, ``relation``, ``tail``, ``source``, ``confidence``, ``rank``: relations that hold one of ten names; for a question without any, units that hold one (``appears_in``, 0.8)."""
    names = questions.select("query_id", F.explode(F.slice("names", 1, 10)).alias("name")).where("name <> ''").distinct()
    relations = relations.select("triple_id", "head", "relation", "tail", "source", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    sides = relations.select("triple_id", "confidence", F.explode(F.array("head", "tail")).alias("hay")).where("hay is not null").withColumn("hid", F.xxhash64("hay"))
    found = contained(names.select(F.col("name").alias("nid"), F.col("name").alias("needle")), stash(sides.select("hid", "hay").distinct()))
    # a question's best are among the best of its names, so no table of questions by relations is made
    of_name = Window.partitionBy("name").orderBy(F.desc("confidence"), "triple_id")
    best = found.withColumnRenamed("nid", "name").join(sides.select("hid", "triple_id", "confidence"), "hid").select("name", "triple_id", "confidence").distinct()
    best = best.withColumn("_i", F.row_number().over(of_name)).where(F.col("_i") <= max(GRAPH_CAPS.values())).select("name", "triple_id")
    hits = stash(names.join(best, "name").select("query_id", "triple_id").distinct())
    own = hits.join(_of_ids(relations, hits), "triple_id").select("query_id", "triple_id", "head", "relation", "tail", "source", "confidence")
    none = questions.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    names = none.select("query_id", F.posexplode(F.slice("names", 1, 10)).alias("place", "name")).where("name <> ''")
    inside = contained(names.select(F.col("name").alias("nid"), F.col("name").alias("needle")), units.select(F.col("doc_id").alias("hid"), F.col("text").alias("hay")))
    pseudo = names.join(inside.withColumnRenamed("nid", "name"), "name").join(units.select(F.col("doc_id").alias("hid"), "title"), "hid")
    pseudo = pseudo.select("query_id", (F.col("hid") * 16 + F.col("place")).alias("triple_id"), F.col("name").alias("head"), F.lit("appears_in").alias("relation"), F.col("title").alias("tail"), F.lit("text_unit").alias("source"), F.lit(0.8).alias("confidence"))
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "triple_id")
    ranked = own.unionByName(pseudo).join(questions.select("query_id", "kind"), "query_id").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= _cap("kind", GRAPH_CAPS)).drop("kind")
