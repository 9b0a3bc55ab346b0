"""Mixing sources to token targets by entropy balancing.

Among all rates r between 0 and ``most`` that give each source its target of words, entropy balancing takes the ones of
least sum of r log r - r over the source's documents. By the convex dual these are r = min(most, exp(lambda x)), with x the
document's size over its source's mean size and one multiplier lambda for each source, found by Newton steps on the dual:
its gradient is the words that the rates take less the target, its Hessian the sum of size * x * r below the cap. A step that leaves the
bracket of the root is replaced by halving it. Documents of a source and a size share a rate, so the steps run over
counts of (source, size) and not over documents. Sums are of whole numbers, so reruns agree to the bit.

Rates become copies by rounding with a common threshold for each source: of the documents with a fractional rate, those
with the lowest "hash minus fraction" get the extra copy, as many as stay within the source's target. The threshold comes
from sums over bins of that number, then over finer bins within the bin it falls into. One more document, the one whose
size is nearest what is then missing, follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, small, stash, table

MOST = 3
UNIT = 1 << 20  # rates are whole multiples of 1 / UNIT
_X_MAX = 1e6


def sizes(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns ``carry``, ``_key`` and ``size``, the number of words (null: 0). The key of a source orders by code point, null last."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    return docs.select("doc_id", *(carry or []), key.alias("_key"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(hist: DataFrame, weights=(5, 2, 1), most: int = MOST) -> DataFrame:
    """``_key``, ``source_size``, ``source_docs``, ``target`` from ``_key``, ``size``, ``n``.

    Sources in order weigh ``weights`` in turn and share all words; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight, until none is above. Each round is one sum over the sources.
    """
    s = hist.groupBy("_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    # places of sources in order, without a window over all: each range of keys counts, and starts behind the ranges before it
    ranged = stash(s.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_in"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("_part", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    placed = ranged.join(F.broadcast(starts), "_part").withColumn("_place", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1)
    placed = placed.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("double"))
    placed = stash(placed.withColumn("_cap", (most * F.col("source_size")).cast("double")))
    # the share of a weight rises as sources stop at their caps, until none is above
    share, stopped = -1.0, None
    while True:
        over = F.col("_weight") * F.lit(share) > F.col("_cap")
        sums = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("_cap"))).alias("capped"), F.sum(F.when(~over, F.col("_weight"))).alias("free"), F.count_if(over).alias("stopped")).first()
        if not sums["free"] or sums["stopped"] == stopped:
            break
        share, stopped = (sums["all"] - (sums["capped"] or 0.0)) / sums["free"], sums["stopped"]
    return placed.select("_key", "source_size", "source_docs", F.least("_cap", F.col("_weight") * F.lit(float(share))).alias("target"))


def rate(size: Column, mean: Column, multiplier: Column, most: int = MOST) -> Column:
    """The tilted rate in whole units of 1 / UNIT."""
    power = F.least(multiplier * size / mean, F.lit(50.0))
    return F.round(F.least(F.exp(power), F.lit(float(most))) * UNIT).cast("long")


def multipliers(hist: DataFrame, targets: DataFrame, most: int = MOST, steps: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """``targets`` with ``mean`` and ``multiplier``, by distributed Newton steps over (source, size) counts.

    Ends when each source is within ``tolerance`` of its target's words, or after ``steps``. A target at its cap or at
    nothing needs no step: its multiplier is at the end of the range.
    """
    low, high = F.lit(-_X_MAX), F.lit(_X_MAX)
    at_end = F.when(F.col("target") >= most * F.col("source_size"), high).when(F.col("target") <= 0, low)
    state = stash(
        targets.withColumn("mean", F.greatest(F.col("source_size") / F.col("source_docs"), F.lit(1e-9))).select(
            "*", F.coalesce(at_end, F.lit(0.0)).alias("multiplier"), low.alias("_low"), high.alias("_high"), at_end.isNotNull().alias("_done")
        )
    )
    for _ in range(steps):
        open_ = state.where("not _done")
        if open_.isEmpty():
            break
        r = rate(F.col("size"), F.col("mean"), F.col("multiplier"), most)
        words = F.col("size") * F.col("n")
        taken = r.cast("decimal(20,0)") * words.cast("decimal(18,0)")
        slope = F.when(r < most * UNIT, F.round(r * (F.col("size") / F.col("mean"))).cast("decimal(20,0)") * words.cast("decimal(18,0)")).otherwise(0)
        sums = hist.join(small(open_, 10_000), "_key").groupBy("_key").agg((F.sum(taken).cast("double") / UNIT).alias("_taken"), (F.sum(slope).cast("double") / UNIT).alias("_slope"))
        gap = F.col("target") - F.col("_taken")
        new_low, new_high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("_low")), F.when(gap > 0, F.col("_high")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") + gap / F.when(F.col("_slope") > 0, F.col("_slope"))
        # away from an open end of the bracket, double the distance from 0
        middle = F.when(new_high >= _X_MAX, F.greatest(new_low * 2, new_low + 1)).when(new_low <= -_X_MAX, F.least(new_high * 2, new_high - 1)).otherwise((new_low + new_high) / 2)
        bounded = F.when((newton > new_low) & (newton < new_high) & (F.abs(newton - F.col("multiplier")) <= F.abs(F.col("multiplier")) + 4), newton).otherwise(middle)
        stays = F.coalesce(F.col("_done") | (F.abs(gap) <= tolerance * F.col("target")), F.lit(True))
        state = stash(
            state.join(sums, "_key", "left").select(
                *targets.columns, "mean",
                F.when(stays, F.col("multiplier")).otherwise(bounded).alias("multiplier"),
                F.when(stays, F.col("_low")).otherwise(new_low).alias("_low"),
                F.when(stays, F.col("_high")).otherwise(new_high).alias("_high"),
                stays.alias("_done"),
            )
        )
    return state.drop("_low", "_high", "_done")


def copies(rows: DataFrame, weights=(5, 2, 1), most: int = MOST, seed: int = 1) -> DataFrame:
    """``rows`` (stashed, with ``doc_id``, ``_key``, ``size``) and ``source_size``, ``target`` and ``copies``."""
    hist = stash(rows.groupBy("_key", "size").agg(F.count("*").alias("n")))
    targets = multipliers(hist, stash(source_targets(hist, weights, most)), most)
    rated = rows.join(small(targets.select("_key", "source_size", "target", "mean", "multiplier"), 10_000), "_key")
    rated = rated.withColumns(_rated(most, seed))
    cut = cuts(rated.select("_key", "size", "_whole", "_order"), targets)
    extra = F.when((F.col("_order") < F.col("_cut")) | ((F.col("_order") == F.col("_pick_order")) & (F.col("size") == F.col("_pick_size"))), 1).otherwise(0)
    return rated.join(small(cut, 10_000), "_key").select(*rows.columns, "source_size", "target", (F.col("_whole") + extra).cast("long").alias("copies"))


def _rated(most: int, seed: int) -> dict[str, Column]:
    """``_whole``, the sure copies, and ``_order``, hash minus fraction: how early the row gets one more; null if it can't."""
    r = F.when(F.col("size") > 0, rate(F.col("size"), F.col("mean"), F.col("multiplier"), most)).otherwise(0)
    whole = F.floor(r / UNIT)
    fraction = r - whole * UNIT
    return {"_whole": whole, "_order": F.when(fraction > 0, F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(UNIT)) - fraction)}


def cuts(rated: DataFrame, targets: DataFrame, bits: int = 10) -> DataFrame:
    """For each source the ``_order`` below which extra copies bring its words nearest the target. ``_order`` spans two UNITs:
    bins of 2 ** ``bits`` values first, then the values within the bin in which the target falls. Also the one row picked on top."""
    bin_ = F.shiftright("_order", bits).alias("_bin")
    # rows without an order make a bin of null, so one pass over the rows gives both the sure words and the bins
    coarse = stash(rated.groupBy("_key", bin_).agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure"), F.sum("size").alias("_words")))
    need = coarse.groupBy("_key").agg(F.sum("_sure").alias("_sure")).join(targets, "_key").select("_key", (F.col("target") - F.col("_sure")).alias("_need"))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # 2,048 bins at most
    below = coarse.where("_bin is not null").select("_key", "_bin", "_words", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_below"))
    falls = stash(below.join(need, "_key").where("_below <= _need and _need < _below + _words").select("_key", "_bin", "_below", "_need"))
    fine = rated.where("_order is not null").select("_key", bin_, "_order", "size").join(small(falls, 10_000), ["_key", "_bin"])
    fine = fine.groupBy("_key", "_order", "_below", "_need").agg(F.sum("size").alias("_words"))  # 2 ** bits orders at most
    to_here = F.sum("_words").over(Window.partitionBy("_key").orderBy("_order")) + F.col("_below")
    fine = fine.withColumn("_reached", F.when(to_here <= F.col("_need"), to_here)).withColumn("_last", F.when(to_here <= F.col("_need"), F.col("_order") + 1))
    inside = fine.groupBy("_key").agg(F.coalesce(F.max("_last"), F.min("_order")).alias("_cut"), F.coalesce(F.max("_reached"), F.min("_below")).alias("_reached"))
    # where the need lies outside all bins nobody or everybody gets the extra copy
    edge = F.when(F.col("_need") > 0, F.lit(2 * UNIT)).otherwise(F.lit(-2 * UNIT))
    cut = stash(need.join(inside, "_key", "left").select("_key", F.coalesce("_cut", edge).alias("_cut"), (F.col("_need") - F.col("_reached")).alias("_gap")))
    # one more row behind the threshold, the one whose size is nearest what is missing
    miss = F.abs(F.col("size") - F.col("_gap"))
    pick = rated.where("_order is not null").select("_key", "_order", "size").join(small(cut.where("_gap > 0"), 10_000), "_key")
    pick = pick.where((F.col("_order") >= F.col("_cut")) & (miss < F.col("_gap"))).groupBy("_key").agg(F.min(F.struct(miss.alias("miss"), "_order", "size")).alias("p"))
    return stash(cut.join(pick, "_key", "left").select("_key", "_cut", F.col("p._order").alias("_pick_order"), F.col("p.size").alias("_pick_size")))


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = MOST, seed: int = 1, text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size) of each row of ``docs``.

    Documents without words take nothing. A null source is a source of its own, last in order. Which documents get an
    extra copy depends on a hash of the id, the size and ``seed``; identical rows share it and get the same copies,
    whichever brings the source nearer its target. An empty table gives an empty result; other columns are ignored.
    """
    out = copies(stash(sizes(docs, text)), weights, most, seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    own = docs.columns
    packed = docs.select(F.struct(*own).alias("_row"), "doc_id", "source", F.col(text).alias("text"))
    rows = stash(sizes(packed, "text", ["_row"]))
    taken = copies(rows, **settings).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op5_source_mix": op5_source_mix}
ORACLES: dict[str, str] = {}
