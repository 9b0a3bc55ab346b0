"""Splits, their gates, and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import stash
from .identity import small


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that every engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stratified_split(rows: DataFrame, key: str, kind: str, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """``split`` for each row: within each ``kind``, by hash order, in proportion to ``shares``. A null kind is one of its own.

    The first three hex digits of the hash make 4,096 bins of a kind. Counts of bins tell which split a bin belongs to;
    only the rows of bins that a border cuts are ranked.
    """
    order = hash_order(F.col(key), seed)
    own = F.coalesce(F.concat(F.lit("k"), F.col(kind).cast("string")), F.lit("-"))
    placed = rows.withColumns({"_kind": own, "_hash": order, "_bin": F.substring(order, 1, 3)})
    before = Window.partitionBy("_kind").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 bins at most
    bins = placed.groupBy("_kind", "_bin").agg(F.count("*").alias("_in"))
    bins = bins.withColumns({"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_n": F.sum("_in").over(Window.partitionBy("_kind"))})
    total, upto, cases = sum(shares.values()), 0, []
    for name, share in shares.items():
        upto += share
        cases.append((name, upto))

    def split_at(place: Column) -> Column:
        split = F.lit(cases[-1][0])
        for name, border in reversed(cases[:-1]):
            split = F.when(place * total < F.col("_n") * border, name).otherwise(split)
        return split

    low, high = split_at(F.col("_before")), split_at(F.col("_before") + F.col("_in") - 1)
    known = placed.join(small(bins.withColumns({"_low": low, "_cut": low != high})), ["_kind", "_bin"])
    whole = known.where("not _cut").withColumn("split", F.col("_low"))
    w = Window.partitionBy("_kind", "_bin").orderBy("_hash", key)
    ranked = known.where("_cut").withColumn("split", split_at(F.col("_before") + F.row_number().over(w) - 1))
    return whole.unionByName(ranked).select(*rows.columns, "split")


def overlaps(splits: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split: ``left``, ``right``, ``shared`` of each pair of splits that shares some."""
    kept = splits.select(key, "split").distinct()
    pairs = kept.withColumnRenamed("split", "left").join(kept.withColumnRenamed("split", "right"), key).where("left < right")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("shared"))


def gate(rows: DataFrame, required: list[str], kinds: tuple[str, ...], key: str) -> DataFrame:
    """Counts of what a data set must not have: missing fields, unknown kinds, repeated keys."""
    missing = [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"missing_{c}") for c in required]
    return rows.agg(F.count("*").alias("n"), *missing, F.count_if(~F.col("type").isin(*kinds)).alias("bad_type"), (F.count("*") - F.count_distinct(key)).alias("repeated"))


#: Places on the circle of a hash order.
CIRCLE = 1 << 52


def circle_place(key: Column, seed: int) -> Column:
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("long")


def _arc(place: Column, arcs: Column) -> Column:
    return F.least(F.floor(place.cast("double") / CIRCLE * arcs), arcs - 1)


def draw(asks: DataFrame, rows: DataFrame, fits: Column, arc: int = 8) -> DataFrame:
    """``query_id``, ``doc_id``, ``_gap``: for each of ``asks`` (query_id, circle, start, need) the next ``need`` rows of its circle that ``fits`` accepts.

    ``rows``: circle, doc_id, place. A circle of n rows is cut into n / ``arc`` arcs of equal length, and an ask meets rows
    by an equi-join on arcs: first the one of its start and the next, then, if it isn't served, four times as many further
    on, until it is or has been around. ``fits`` may use all columns of both sides.
    """
    sizes = stash(rows.groupBy("circle").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / arc)).alias("_arcs")))
    dealt = stash(rows.join(sizes, "circle").withColumn("_arc", _arc(F.col("place"), F.col("_arcs"))).drop("_arcs"))
    left = stash(asks.where("need > 0").join(sizes, "circle"))
    found, done, width = None, 0, 2
    while not left.isEmpty():
        offsets = F.sequence(F.lit(done).cast("long"), F.least(F.lit(done + width - 1).cast("long"), F.col("_arcs")))
        asked = left.withColumn("_o", F.explode(offsets)).withColumn("_arc", F.pmod(_arc(F.col("start"), F.col("_arcs")) + F.col("_o"), F.col("_arcs")))
        # the arc of the start comes first with what lies behind the start and last with what lies before it
        ahead = ((F.col("_o") > 0) | (F.col("place") >= F.col("start"))) & ((F.col("_o") < F.col("_arcs")) | (F.col("place") < F.col("start")))
        met = asked.join(dealt, ["circle", "_arc"]).where(ahead & fits).withColumn("_gap", F.pmod(F.col("place") - F.col("start"), F.lit(CIRCLE)))
        w = Window.partitionBy("query_id").orderBy("_gap", "doc_id")
        new = stash(met.withColumn("_i", F.row_number().over(w)).where("_i <= need").select("query_id", "doc_id", "_gap"))
        found = new if found is None else found.unionByName(new)
        done, width = done + width, 4 * width
        got = new.groupBy("query_id").agg(F.count("*").alias("_got"))
        left = left.where(F.col("_arcs") >= done).join(got, "query_id", "left").withColumn("need", F.col("need") - F.coalesce("_got", F.lit(0))).where("need > 0").drop("_got")
        left = stash(left)
    return asks.sparkSession.createDataFrame([], "query_id long, doc_id long, _gap long") if found is None else found


def negatives(positives: DataFrame, corpus: DataFrame, per_positive: int = 6, near: int = 2, seed: int = 42, text: str | None = None) -> DataFrame:
    """``query_id``, ``doc_id``, ``origin``, ``rank``: for each positive the neighbours within ``near`` of its source, then others of the source, then rows of other sources.

    ``positives``: query_id, doc_id, source, pos; ``corpus``: doc_id, source, pos (and ``text``, which both need if it is named).
    The positive itself is never one, nor, with ``text``, a row whose text contains the positive's or lies in it. Neighbours
    come from an equi-join on places. Others are drawn: rows stand on a circle by their hash, and each positive takes
    those that follow a place of its own, first on the circle of its source, then on that of the other sources. A source
    with over an eighth of all rows (there are fewer than eight) leaves a circle of the others for its own positives; a
    positive of any other source goes around with all rows and meets few of its own.
    """
    carry = [text] if text else []
    packed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    gold = [packed(F.col(c)).alias("_gold") for c in carry]
    p = stash(positives.select("query_id", F.col("doc_id").alias("_own"), F.col("source").alias("_source"), F.col("pos").alias("_pos"), circle_place(F.concat(F.lit("start|"), F.col("query_id").cast("string")), seed).alias("start"), *gold))
    c = stash(corpus.select("doc_id", "source", "pos", circle_place(F.col("doc_id"), seed).alias("place"), hash_order(F.col("doc_id"), seed).alias("_h"), *(packed(F.col(x)).alias("_text") for x in carry)))
    other = F.col("doc_id") != F.col("_own")
    if text:
        other = other & ~(F.contains("_text", "_gold") | F.contains("_gold", "_text"))
    around = p.withColumn("_place", F.explode(F.transform(F.sequence(F.lit(-near), F.lit(near)), lambda d: F.col("_pos") + d))).where("_place <> _pos")
    side = around.join(c, (F.col("_source") == F.col("source")) & (F.col("_place") == F.col("pos"))).where(other)
    parts = [stash(side.select("query_id", "doc_id", F.lit("neighbour").alias("origin"), F.abs(F.col("_place") - F.col("_pos")).cast("long").alias("_d"), F.lit(0).cast("long").alias("_gap"), "_h"))]

    def tier(circle: Column, rows: DataFrame, fits: Column, origin: str, place: int) -> DataFrame:
        have = None
        for part in parts:
            have = part.select("query_id") if have is None else have.union(part.select("query_id"))
        got = have.groupBy("query_id").agg(F.count("*").alias("_n"))
        asks = p.withColumn("circle", circle).join(got, "query_id", "left").withColumn("need", F.lit(per_positive) - F.coalesce("_n", F.lit(0))).drop("_n")
        return draw(asks, rows, fits).select("query_id", "doc_id", F.lit(origin).alias("origin"), F.lit(place).cast("long").alias("_d"), "_gap", F.lit("").alias("_h"))

    parts.append(tier(F.col("_source"), c.withColumn("circle", F.col("source")), other & (F.abs(F.col("pos") - F.col("_pos")) > near), "same_source", near + 1))
    heavy = [r["source"] for r in c.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") * 8 > c.count()).select("source").collect()]
    # circle 0 holds all rows, circle i those outside of the i-th large source
    number = F.coalesce(*(F.when(F.col("_source").eqNullSafe(F.lit(x)), i) for i, x in enumerate(heavy, 1)), F.lit(0))
    on = F.array(F.lit(0), *(F.when(~F.col("source").eqNullSafe(F.lit(x)), i) for i, x in enumerate(heavy, 1)))
    copies = c.withColumn("circle", F.explode(F.array_compact(on)))
    parts.append(tier(number, copies, other & (F.col("source") != F.col("_source")), "random", near + 2))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = Window.partitionBy("query_id").orderBy("_d", "_gap", "_h", "doc_id")
    return union.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_positive).select("query_id", "doc_id", "origin", "rank")
