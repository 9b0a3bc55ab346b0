"""Entities, their edges and bounded expansion over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stash

def postings(mentions: DataFrame, span: int = 4096) -> DataFrame:
    """``name``, ``block``, ``units`` from name, unit (a number): distinct units in order, in blocks of ``span`` ids, so no row grows with a name's fame."""
    of = mentions.select("name", "unit", F.floor(F.col("unit") / span).alias("block")).distinct()
    return of.groupBy("name", "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))


def cooccurrence(entities: DataFrame, most: int = 11) -> DataFrame:
    """``head``, ``tail``, ``unit``: from the first entity of each unit to the next ``most``."""
    tails = F.slice("names", 2, most)
    return entities.where(F.size("names") > 1).select(F.get("names", 0).alias("head"), F.explode(tails).alias("tail"), "unit").distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``query_id``, ``node``, ``depth``: nodes within ``hops`` of the seeds (query_id, node), edges taken both ways, least depth.

    The edges both ways and each hop's new nodes are written before the next hop reads them, so the plan grows by one step a hop.
    """
    both = edges.select(F.col("head").alias("node"), F.col("tail").alias("next")).union(edges.select(F.col("tail").alias("node"), F.col("head").alias("next"))).distinct()
    both = stash(both)
    seen = stash(seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, hops + 1):
        new = front.join(both, "node").select("query_id", F.col("next").alias("node")).distinct()
        front = stash(new.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen


def entity_rollup(mentions: DataFrame, span: int = 4096) -> DataFrame:
    """``entity_id``, ``name``, ``field`` (evidence or standard), ``block`` and ``ids``: the distinct ids of each entity in order of first appearance.

    ``mentions``: name, evidence, standard, pos (a number). An id stands in the block of its first ``pos``, ``span`` places wide.
    """
    firsts = None
    for field in ("evidence", "standard"):
        part = mentions.where(F.col(field).isNotNull()).groupBy("name", F.col(field).cast("string").alias("id")).agg(F.min("pos").alias("pos")).withColumn("field", F.lit(field))
        firsts = part if firsts is None else firsts.unionByName(part)
    gathered = F.array_sort(F.collect_list(F.struct("pos", "id")))
    blocks = firsts.groupBy("name", "field", F.floor(F.col("pos") / span).alias("block")).agg(F.transform(gathered, lambda x: x["id"]).alias("ids"))
    return blocks.select(F.substring(F.sha2("name", 256), 1, 16).alias("entity_id"), "name", "field", "block", "ids")
