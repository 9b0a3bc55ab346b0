"""Self-join of documents on the Jaccard coefficient of their word n-grams, by grouped prefixes.

All n-grams have one order, the rarer first: counts over all documents are kept in a table of fixed width, and n-grams of
one count class follow their hash. A document's prefix holds the first of its n-grams, so many that documents which link
share one of their prefixes. Texts with the same set form a class, and classes with the same prefix and size a group.

Groups meet in the lists of their prefix n-grams, within steps of size that allow a link. Sizes, places in the prefixes
and what one prefix holds and the other lacks rule out most pairs of groups; what remains is expanded to its classes and
verified on full sets. Each group first meets its list's first group, and the classes of a group their first class, which
links most copies with few rows. Pairs of different components then follow: those of short lists as rows, those of
crowded lists and groups inside tasks in blocks of a bounded number of members, where only links come out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import heaviest, join_spread, small, small_batches, stash, table, texts
from .near_dedup import PLACES, _ordered, components, confirmed, shingles

BITS, BLOCK = 20, 4096  # of the table of counts, which has 2 ** BITS places
MARKS = 1 << 25  # bits of the table of ids whose texts are asked for


def count_classes(docs: DataFrame, shingle: int) -> np.ndarray:
    """Classes of size (quarters of a power of two) of the counts of n-grams over all documents, by the upper bits of their hashes.

    N-grams that share a place add up, so the order is a matter of speed alone. The table goes to the driver in
    2 ** BITS bytes, however many documents there are.
    """

    def count(batches):
        import pyarrow as pa

        held = np.zeros(1 << BITS, np.int64)
        for _, raws in texts(batches):
            places = np.concatenate([shingles(raw, shingle) for raw in raws]) >> np.uint64(64 - BITS)
            held += np.bincount(places.astype(np.int64), minlength=len(held))
        numbers, blocks = [], []
        for k, part in enumerate(held.reshape(-1, BLOCK)):
            at = np.flatnonzero(part)
            if len(at):
                numbers.append(k)
                blocks.append(at.astype("<u2").tobytes() + part[at].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], ["block", "held"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(raw) // 10
                total = sums.setdefault(k, np.zeros(BLOCK, np.int64))
                total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<i8", n, 2 * n)
        classes = [np.minimum(255, 4 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], ["block", "classes"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "block int, held binary")
    out = np.zeros(1 << BITS, np.uint8).reshape(-1, BLOCK)
    with small_batches(docs.sparkSession):
        summed = counted.repartition("block").mapInArrow(add, "block int, classes binary").collect()
    for row in summed:
        out[row["block"]] = np.frombuffer(row["classes"], np.uint8)
    return out.reshape(-1)


def prefix_size(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` of which one lies in every set that links with it, in any order."""
    return n + percent * n // -100 + 1


def prefixes(docs: DataFrame, shingle: int, percent: int, classes) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``set_hash``, ``grp`` (of prefix and size) and ``prefix`` of each row; nulls and no prefix for an empty set.

    An n-gram is a number below 2 ** 63: its count class, then its hash.
    """
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("text_hash bigint, n_shingles bigint, set_hash binary, grp binary, prefix array<bigint>").fields])

    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        rank = classes.value.astype(np.int64) << 55
        for batch, raws in texts(batches):
            sizes, sets, groups, kept = [], [], [], [np.zeros(0, np.int64)]
            for raw in raws:
                values = shingles(raw, shingle)
                n = len(values)
                sizes.append(n)
                if not n:
                    sets.append(None)
                    groups.append(None)
                    kept.append(kept[0])
                    continue
                keys = rank[(values >> np.uint64(64 - BITS)).astype(np.int64)] | (values >> np.uint64(9)).astype(np.int64)
                first = np.sort(np.partition(keys, size - 1)[:size] if (size := prefix_size(n, percent)) < n else keys)
                sets.append(blake2b(values.tobytes(), digest_size=16).digest())
                groups.append(blake2b(first.tobytes() + str(n).encode(), digest_size=16).digest())
                kept.append(first)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(k) for k in kept]), pa.int32()), pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(groups, pa.binary()), lists], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def prefixes_allow(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (g, h) of groups whose sizes allow a link and where neither lacks too much of what the other's prefix holds.

    What comes before the end of a prefix and isn't in it isn't in the set. Prefixes travel as the upper halves of their
    n-grams: those that fall together count as shared, so no pair is lost.
    """
    held = groups.select("gid", "n", F.transform("prefix", lambda t: F.shiftright(t, 32).cast("int")).alias("prefix"))
    both = pairs.join(held.toDF("g", "n1", "p1"), "g").join(held.toDF("h", "n2", "p2"), "h")
    shared = _least_shared("n1", "n2", percent)
    lacks = lambda p, q: F.size(F.filter(F.array_except(p, q), lambda t: t < F.element_at(q, -1)))
    return both.where(_sizes_allow("n1", "n2", percent)).where((lacks("p1", "p2") <= F.col("n1") - shared) & (lacks("p2", "p1") <= F.col("n2") - shared)).select("g", "h")


def _sizes_allow(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _least_shared(x: str, y: str, percent: int) -> Column:
    """The fewest n-grams that linked sets of these sizes share."""
    return F.ceil((F.col(x) + F.col(y)) * percent / F.lit(100 + percent) - 1e-9)


def _first_shared(n1: str, pos1: str, n2: str, pos2: str, percent: int) -> Column:
    """Whether an n-gram at these places can be the first that linked sets of these sizes share: nothing before it is shared."""
    left = F.lit(1) + F.least(F.col(n1) - F.col(pos1) - 1, F.col(n2) - F.col(pos2) - 1)
    return _sizes_allow(n1, n2, percent) & (left >= _least_shared(n1, n2, percent))


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("g"), F.greatest(x, y).alias("h")]


def marked(ids: DataFrame) -> np.ndarray:
    """A table of ``MARKS`` bits where those at the hashes of the ``ids`` (doc_id, text_hash) are set; 4 MB, however many ids there are."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            blocks = []
            for places in batch.column(1):
                bits = np.zeros(8 * BLOCK, bool)
                bits[places.values.to_numpy()] = True
                blocks.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.binary())], ["block", "bits"])

    place = ids.select(_place().alias("place"))
    blocks = place.groupBy(F.expr(f"place div {8 * BLOCK}").cast("int").alias("block")).agg(F.collect_set((F.col("place") % (8 * BLOCK)).cast("int")).alias("places"))
    out = np.zeros(MARKS // 8, np.uint8).reshape(-1, BLOCK)
    for row in blocks.mapInArrow(pack, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(MARKS))


def asked_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``text`` of the rows of ``docs`` that the ``ids`` (doc_id, text_hash) name, and of some others whose marks fall together.

    Rows drop out where they lie, so what joins or groups the result shuffles hardly any text that isn't asked for,
    whether the ids fit a broadcast or not.
    """
    marks = docs.sparkSession.sparkContext.broadcast(marked(ids))
    return _placed(docs).mapInArrow(lambda batches: _asked(batches, marks.value), "doc_id long, text_hash long, text string")


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").withColumn("place", _place())


def _asked(batches, marks: np.ndarray):
    import pyarrow as pa

    for batch in batches:
        place = batch.column(3).to_numpy()
        yield batch.select([0, 1, 2]).filter(pa.array(marks[place >> 3] >> (place & 7) & 1 == 1))


def _linked(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``confirmed``, for which texts travel once by their id and once to their pairs; rows that agree in id and text are one."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select("id.*")
    held = asked_rows(docs, ids).groupBy(F.struct("doc_id", "text_hash").alias("id")).agg(F.min("text").alias("_t"))
    return confirmed(pairs, docs, shingle, percent, held=held)


def asked_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``held`` (the sorted hashes of the shingles) of the rows of ``docs`` that the ``ids`` name, each once.

    Marks are looked up and sets made in one function, since each of two in a task would have a Python worker of its own.
    """
    marks = docs.sparkSession.sparkContext.broadcast(marked(ids))

    def run(batches):
        import pyarrow as pa

        for batch, raws in texts(_asked(batches, marks.value)):
            held = [shingles(raw, shingle).tobytes() for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], ["doc_id", "text_hash", "held"])

    made = _placed(docs).mapInArrow(run, "doc_id long, text_hash long, held binary")
    return made.join(ids.distinct(), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])


def links_in_blocks(open_: DataFrame, percent: int, blocks: DataFrame, across: bool, block: int = 512) -> DataFrame:
    """Pairs (a, b) of members of one group that are links, as many as join what links join: a forest in each block or pair of blocks.

    ``open_``: grp, doc_id, text_hash, lab (known component), n (the set's size) and held. Full sets decide, for every pair of
    different components whose sizes allow a link; pairs that share too few places of a table, which is never less than
    they share of their sets, need no exact count. Members are dealt by size, each to its own step of sizes and to the
    next one, since sizes two steps apart allow no link; ``blocks`` has the members of steps with more than ``block`` of
    them. Those are compared block by block: each block within itself or, with ``across``, each with every other.
    """

    def compare(rows):
        import pyarrow as pa

        held = [np.frombuffer(h, np.uint64) for h in rows["held"].to_pylist()]
        sizes = np.array([len(h) for h in held])
        order = np.argsort(sizes, kind="stable")
        held, sizes = [held[k] for k in order.tolist()], sizes[order]
        label, block_, home, ids, hashes = (rows[c].to_numpy()[order] for c in ("lab", "blk", "home", "doc_id", "text_hash"))
        kinds, counts = np.unique(label, return_counts=True)
        odd = (label != kinds[counts.argmax()]) | across  # two blocks may have different largest components
        places = (np.concatenate(held) & np.uint64(PLACES - 1)).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        marked = np.zeros(PLACES, np.int8)
        x, y = [], []
        for r in np.flatnonzero(odd).tolist():
            # partners: of a size that allows a link, of another component, each pair once, across the blocks if there are two
            first, last = np.searchsorted(100 * sizes, percent * sizes[r], "left"), np.searchsorted(percent * sizes, 100 * sizes[r], "right")
            near = np.arange(first, last)
            ask = (label[near] != label[r]) & ~(odd[near] & (near < r)) & (home[near] | home[r])
            if across:
                ask &= block_[near] != block_[r]
            if not ask.any():
                continue
            first, last = near[ask][0], near[ask][-1] + 1
            mine = places[starts[r] : starts[r + 1]]
            marked[mine] = 1
            most = np.add.reduceat(marked[places[starts[first] : starts[last]]], starts[first:last] - starts[first], dtype=np.int64)
            marked[mine] = 0
            to = near[ask]
            for c in to[100 * most[to - first] >= percent * (sizes[r] + sizes[to] - most[to - first])].tolist():
                if label[c] == label[r]:
                    continue
                both = len(np.intersect1d(held[r], held[c], assume_unique=True))
                if 100 * both >= percent * (sizes[r] + sizes[c] - both):
                    x.append(r)
                    y.append(c)
                    label[label == label[c]] = label[r]
        return pa.table({"xi": ids[x], "xh": hashes[x], "yi": ids[y], "yh": hashes[y]})

    own = _step(percent)
    dealt = open_.withColumn("step", F.explode(F.array(own, own + 1))).withColumn("home", F.col("step") == own)
    dealt = dealt.join(small(blocks, 100_000), ["grp", "step"], "inner" if across else "left").withColumn("nb", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("nb")).cast("int"))
    others = F.explode(F.expr("filter(sequence(0, nb - 1), k -> k <> blk)")) if across else F.col("blk")
    dealt = dealt.withColumn("k", others).select("grp", "step", F.least("blk", "k").alias("lo"), F.greatest("blk", "k").alias("hi"), "blk", "home", "doc_id", "text_hash", "lab", "held")
    found = dealt.groupBy("grp", "step", "lo", "hi").applyInArrow(compare, "xi long, xh long, yi long, yh long")
    return _ordered(found.select(F.struct(F.col("xi").alias("doc_id"), F.col("xh").alias("text_hash")).alias("x"), F.struct(F.col("yi").alias("doc_id"), F.col("yh").alias("text_hash")).alias("y")))


def _step(percent: int) -> Column:
    """Number of the step of sizes that ``n`` is in; linked sets are at most one step apart."""
    return F.floor(F.log("n") / (-math.log(percent / 100) * 1.001 if percent < 100 else 1.0)).cast("int")


def links_in_groups(here: DataFrame, docs: DataFrame, shingle: int, percent: int, links: DataFrame, block: int = 512) -> DataFrame:
    """Links that join the components of all members of each group that links join, beside the known ``links``.

    ``here``: grp, doc_id, text_hash, n and lab, stashed. Crowded groups first find the links inside their blocks; only
    groups that then still hold several components go through pairs of blocks.
    """
    id_ = ["doc_id", "text_hash"]
    sets = lambda rows: rows.join(asked_sets(docs, rows.select(id_), shingle), id_)
    own = _step(percent)
    blocks = here.select("grp", F.explode(F.array(own, own + 1)).alias("step")).groupBy("grp", "step").agg(F.count("*").alias("members")).where(F.col("members") > block)
    blocks = stash(blocks)
    found = stash(links_in_blocks(sets(here), percent, blocks, False, block))
    if blocks.isEmpty():
        return found
    labels = stash(components(links.unionByName(found))).select("id.*", F.xxhash64("label").alias("new"))
    # ids without a link keep a label of their own
    here = stash(here.join(labels, id_, "left").select("grp", *id_, "n", F.coalesce("new", F.xxhash64(F.struct(*id_))).alias("lab")))
    several = here.groupBy("grp").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo < hi").select("grp")
    here = stash(here.join(several, "grp", "left_semi"))
    return found if here.isEmpty() else stash(found.unionByName(links_in_blocks(sets(here), percent, blocks, True, block)).distinct())


def of_rows(signed: DataFrame, final: DataFrame, hot_copies: int = 10_000) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles`` and ``component_id`` of each signed row, from the components of its class."""
    # a class with very many copies is sent to them; the other copies go to their classes
    hot = final.where(F.col("copies") > hot_copies).select("set_hash", F.col("component_id").alias("_hot"))
    rows_ = signed.select("doc_id", "text_hash", "n_shingles", "set_hash").join(small(hot, 10_000), "set_hash", "left")
    at_home = F.col("_hot").isNull() & F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull()
    near = rows_.where(at_home).join(final.select("set_hash", "component_id"), "set_hash").select("doc_id", "text_hash", "n_shingles", "component_id")
    rest = rows_.where(~at_home).select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_hot", "doc_id")).alias("component_id"))
    return near.union(rest)


def linked_documents(docs: DataFrame, shingle: int = 3, percent: int = 90, crowd: int = 64, block: int = 512, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Documents link where 100 * intersection >= ``percent`` * union of their sets of ``shingle``-word n-grams;
    ``component_id`` is the smallest doc_id reachable. A text with fewer words has them all as one n-gram. Null, empty and
    blank texts have none and link with nothing. A row with a null doc_id takes no part and its component is null. Rows of
    one doc_id with different texts are documents of their own; identical rows stay repeated. Pairs exactly at the limit
    link. Texts count whole at any length. An empty table gives an empty result; other columns are ignored. Ids are cast
    to long. ``crowd``: groups of a list whose pairs come as rows; longer lists are compared inside tasks, ``block`` members at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    classes_of = docs.sparkSession.sparkContext.broadcast(count_classes(docs, shingle))
    signed = stash(prefixes(docs, shingle, percent, classes_of))
    known = signed.where("doc_id is not null and set_hash is not null")
    groups = known.groupBy("grp").agg(F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
    groups = stash(groups.withColumn("gid", F.monotonically_increasing_id()))
    classes = known.groupBy("set_hash", "grp").agg(F.min(F.struct("doc_id", "text_hash")).alias("id"), F.count("*").alias("copies"))
    classes = stash(classes.join(groups.select("grp", "gid", "n"), "grp").drop("grp"))
    heads = stash(classes.groupBy("gid").agg(F.min("id").alias("head"), F.count("*").alias("members")))
    # lists of n-grams with company: every group meets the list's first one
    posts = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = posts.groupBy("token").agg(F.count("*").alias("groups"), F.min("gid").alias("first")).where("groups > 1")
    lists = stash(lists.join(groups.select(F.col("gid").alias("first"), F.col("n").alias("first_n")), "first"))
    met = stash(join_spread(posts, lists, "token", heaviest(lists, "token", "groups")))
    # sizes rule out most of these pairs before prefixes are sent to them
    first = prefixes_allow(met.where("gid <> first").where(_sizes_allow("n", "first_n", percent)).select(*_pairs("gid", "first")).distinct(), groups, percent)
    head = heads.select("gid", "head")
    tops = first.join(head.toDF("g", "x"), "g").join(head.toDF("h", "y"), "h").select("x", "y")
    within = classes.join(heads.where("members > 1"), "gid").select(F.col("id").alias("x"), F.col("head").alias("y"))
    links = stash(_linked(stash(_ordered(tops.unionByName(within))), docs, shingle, percent))
    labels = stash(components(links))
    labelled = stash(classes.select("gid", "n", "id").join(labels, "id", "left").select("gid", "n", "id", F.coalesce("label", "id").alias("label")))
    # a group of one component goes by its label, any other by a label of its own
    marks = labelled.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
    marks = stash(marks.select("gid", "members", (F.col("lo") < F.col("hi")).alias("open"), F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).otherwise(F.xxhash64("gid", F.lit(1))).alias("lab")))
    # lists that still hold several components, dealt by steps of size: a group stands in its own and in the next
    of_list = met.select("token", "gid", "n", "pos").join(marks.select("gid", "lab"), "gid")
    several = of_list.groupBy("token").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    several = stash(several.select("token", "lo", "size"))
    of_list = join_spread(of_list, several, "token", heaviest(several, "token", "size"))
    own = _step(percent)
    here = stash(of_list.withColumn("step", F.explode(F.array(own, own + 1))).withColumn("home", F.col("step") == own))
    steps = here.groupBy("token", "step").agg(F.count("*").alias("in_step"), F.min("lab").alias("least"), F.max("lab").alias("greatest")).where("least < greatest")
    steps = stash(steps.select("token", "step", "in_step"))
    x = here.join(steps.where(F.col("in_step") <= crowd), ["token", "step"]).select("token", "step", "gid", "n", "pos", "lab", "home")
    y = x.toDF("token", "step", "gid2", "n2", "pos2", "lab2", "home2")
    pairs = x.join(y, ["token", "step"]).where("gid < gid2 and lab <> lab2 and (home or home2)").where(_first_shared("n", "pos", "n2", "pos2", percent))
    pairs = stash(prefixes_allow(pairs.select(*_pairs("gid", "gid2")).distinct(), groups, percent))
    sizes = marks.select("gid", "members")
    expanded = pairs.join(sizes.toDF("g", "m1"), "g").join(sizes.toDF("h", "m2"), "h").withColumn("many", F.col("m1") * F.col("m2") > crowd)
    of = labelled.select("gid", "id", "label")
    second = expanded.where("not many").join(of.toDF("g", "x", "l1"), "g").join(of.toDF("h", "y", "l2"), "h").where("l1 <> l2").select("x", "y")
    found = stash(_linked(stash(_ordered(second)), docs, shingle, percent))
    # what is compared inside tasks: crowded lists by their least label, open groups, and pairs of large groups
    asked = here.join(small(steps.where(F.col("in_step") > crowd).select("token", "step"), 100_000), ["token", "step"], "left_semi").select(F.xxhash64("lo").alias("grp"), "gid")
    large = expanded.where("many").select(F.xxhash64("g", "h").alias("grp"), F.explode(F.array("g", "h")).alias("gid"))
    asked = asked.unionByName(large).unionByName(marks.where("open").select(F.xxhash64("gid").alias("grp"), "gid")).distinct()
    crowded = stash(asked.join(labelled, "gid").select("grp", "id.doc_id", "id.text_hash", "n", F.xxhash64("label").alias("lab")).distinct())
    if not crowded.isEmpty():
        found = found.unionByName(links_in_groups(crowded, docs, shingle, percent, links.unionByName(found), block))
    labels = stash(components(links.unionByName(found)))
    joined = classes.join(labels, "id", "left")
    final = stash(joined.select("set_hash", "copies", F.coalesce("label.doc_id", "id.doc_id").alias("component_id")))
    return of_rows(signed, final).select("doc_id", "n_shingles", "component_id")


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_ngram_join": op12_ngram_join}
ORACLES = {
    "op12_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)])
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
k AS (SELECT u, min(v) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id FROM documents d JOIN k ON k.u = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
}
