"""Near-duplicates by circulant MinHash, with every link confirmed on full shingle sets.

Signatures: a first permutation (a mixing hash of the shingle, modulo D) gives each shingle a place; a second, fixed
permutation of D numbers is read circularly from there. The k-th coordinate is the least number found k steps on over all
shingles of the document, so two permutations give all coordinates and a shingle costs one contiguous read.

Banding: ``bands`` bands of ``rows`` coordinates. A pair at the limit of 0.8 shares no band with probability
(1 - 0.8 ** rows) ** bands, 2e-6 for 7 rows and 56 bands, and pairs below half hardly ever meet.

Texts with the same set of shingles form a class first and only its smallest id goes on. In each bucket of a band every
member is paired with the bucket's smallest id; the pairs are confirmed with the exact Jaccard coefficient of their full
sets, and links make components. That is a row for each member of a bucket, never all pairs. Where buckets then still
hold several components, all their members outside the largest one are compared with all others of other components,
inside tasks and in blocks of a bounded number of members: their sets alone decide there, and rows come out only for
links, which are confirmed like the first. So no link is missed because a bucket is large.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, fresh, heaviest, join_spread, small, stash, table, texts

D = 1 << 20
PLACES = 1 << 20  # of the table that bounds what two sets share
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; the memory is bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        import xxhash

        self.most, self.hash = most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hash(word)
        return value


_hashes = None


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, A-Z lower-cased; of the whole text if it has fewer words."""
    global _hashes
    if _hashes is None:
        _hashes = WordHashes()
    words = raw.translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size_here = min(size, len(words))
    n = len(words) - size_here + 1
    rolled = np.full(n, size_here, np.uint64)
    for k in range(size_here):
        rolled = mixed(rolled * _A + values[k : k + n])
    return np.unique(rolled)


class Signer:
    def __init__(self, rows: int, bands: int, seed: int = 7):
        self.rows, self.bands = rows, bands
        second = np.random.default_rng(seed).permutation(D).astype(np.int32)
        circle = np.concatenate([second, second[: rows * bands]])
        self.windows = np.lib.stride_tricks.sliding_window_view(circle, rows * bands)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _A)

    def signature(self, values: np.ndarray) -> np.ndarray:
        places = (mixed(values) & np.uint64(D - 1)).astype(np.int64)
        least = self.windows[places[:256]].min(axis=0)
        for at in range(256, len(places), 256):
            np.minimum(least, self.windows[places[at : at + 256]].min(axis=0), out=least)
        return least

    def buckets(self, values: np.ndarray) -> np.ndarray:
        parts = self.signature(values).astype(np.uint64).reshape(self.bands, self.rows)
        key = self.salt.copy()
        for k in range(self.rows):
            key = mixed(key * _A + parts[:, k])
        return key.view(np.int64)


_signers: dict[tuple[int, int], Signer] = {}


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``set_hash`` (128 bits; null for an empty set) and ``buckets`` of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batches):
        import hashlib

        import pyarrow as pa

        signer = _signers.get((rows, bands)) or _signers.setdefault((rows, bands), Signer(rows, bands))
        for batch, raws in texts(batches):
            sizes, hashes, keys = [], [], []
            for raw in raws:
                values = shingles(raw, shingle)
                sizes.append(len(values))
                hashes.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                if len(values):
                    keys.append(signer.buckets(values))
            ends = np.cumsum([0] + [bands if n else 0 for n in sizes]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), lists], ["doc_id", "text_hash", "n_shingles", "set_hash", "buckets"])

    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, schema)


def held_sets(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``held`` (sorted low 32 bits of the shingles' hashes)."""

    def run(batches):
        import pyarrow as pa

        for batch, raws in texts(batches):
            held = [np.unique(shingles(raw, shingle).astype(np.uint32)).tobytes() for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], ["doc_id", "text_hash", "held"])

    made = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, text_hash long, held binary")
    return made.dropDuplicates(["doc_id", "text_hash"])


def near_limit(open_: DataFrame, percent: int, block: int = 512, groups: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of members of one group in different components that are links or all but links.

    ``open_``: grp, doc_id, text_hash, lab, held. The 32-bit hashes of the sets decide, with a hundredth to spare for hashes
    that fall together, for every pair whose sizes allow a link; pairs that share too few places of a table, which is never
    less than they share of their sets, need no exact count. Only members outside the group's largest component ask.
    Groups of more than ``block`` members are compared block by block. ``groups`` has a grp for each row of ``open_``, to count
    without its sets.
    """
    limit = percent / 100 - 0.01

    def compare(pdf):
        import pandas as pd

        held = [np.frombuffer(h, np.uint32) for h in pdf["held"]]
        sizes = np.array([len(h) for h in held])
        order = np.argsort(sizes, kind="stable")
        pdf, held, sizes = pdf.iloc[order], [held[k] for k in order.tolist()], sizes[order]
        label, block_ = pdf["lab"].to_numpy(), pdf["blk"].to_numpy()
        two = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        kinds, counts = np.unique(label, return_counts=True)
        odd = (label != kinds[counts.argmax()]) | two  # two blocks may have different largest components
        places = np.concatenate(held) & np.uint32(PLACES - 1)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        marked = np.zeros(PLACES, np.int8)
        x, y = [], []
        for r in np.flatnonzero(odd).tolist():
            # partners: of a size that allows a link, of another component, each pair once, across the blocks if there are two
            first, last = np.searchsorted(sizes, limit * sizes[r], "left"), np.searchsorted(sizes, sizes[r] / limit, "right")
            near = np.arange(first, last)
            ask = (label[near] != label[r]) & ~(odd[near] & (near < r))
            if two:
                ask &= block_[near] != block_[r]
            if not ask.any():
                continue
            first, last = near[ask][0], near[ask][-1] + 1
            mine = places[starts[r] : starts[r + 1]]
            marked[mine] = 1
            most = np.add.reduceat(marked[places[starts[first] : starts[last]]], starts[first:last] - starts[first], dtype=np.int64)
            marked[mine] = 0
            to = near[ask]
            for c in to[most[to - first] >= limit * (sizes[r] + sizes[to] - most[to - first])].tolist():
                both = len(np.intersect1d(held[r], held[c], assume_unique=True))
                if both >= limit * (sizes[r] + sizes[c] - both):
                    x.append(r)
                    y.append(c)
        ids, hashes = pdf["doc_id"].to_numpy(), pdf["text_hash"].to_numpy()
        return pd.DataFrame({"xi": ids[x], "xh": hashes[x], "yi": ids[y], "yh": hashes[y]}) if x else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("xi", "xh", "yi", "yh")})

    counts = (open_ if groups is None else groups).groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block)
    dealt = open_.join(F.broadcast(heaviest(counts, "grp")), "grp", "left").withColumn("nb", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("nb")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("grp", F.least("blk", "k").alias("lo"), F.greatest("blk", "k").alias("hi"), "blk", "doc_id", "text_hash", "lab", "held")
    found = dealt.groupBy("grp", "lo", "hi").applyInPandas(compare, "xi long, xh long, yi long, yh long")
    return _ordered(found.select(F.struct(F.col("xi").alias("doc_id"), F.col("xh").alias("text_hash")).alias("x"), F.struct(F.col("yi").alias("doc_id"), F.col("yh").alias("text_hash")).alias("y")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, text: str = "text", block: int = 250, held: DataFrame | None = None) -> DataFrame:
    """The ``pairs`` (a, b) of representatives, structs of doc_id and text_hash, with 100 * intersection >= percent * union of their full sets.

    Texts stream through tasks, each ``b`` followed by its partners; the partners of a ``b`` with very many of them are
    dealt into blocks of about ``block``, each with a copy of its text. ``held``: one text (``_t``) for each ``id`` of the
    pairs and maybe others, from a caller that gathers them in its own way.
    """

    def run(batches):
        import pyarrow as pa

        pivot = None
        for batch in batches:
            b, a, of = (batch.column(i) for i in range(3))
            keep, partner = [], a.is_valid()
            for i, raw in enumerate(of.cast(pa.binary())):
                values = shingles(raw.as_py() or b"", shingle)
                if not partner[i].as_py():
                    pivot = values
                    continue
                if 100 * min(len(values), len(pivot)) < percent * max(len(values), len(pivot)):
                    continue
                both = len(np.intersect1d(values, pivot, assume_unique=True))
                if 100 * both >= percent * (len(values) + len(pivot) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], ["a", "b"])

    if held is None:
        id_ = F.struct("doc_id", F.xxhash64(text).alias("text_hash"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # rows that agree in id and text are one; a copy of it is enough
        held = docs.select(id_.alias("id"), F.col(text).alias("_t")).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("_t").alias("_t"))
    hot = heaviest(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > block), "b")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    dealt = pairs.join(F.broadcast(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), blocks).alias("blk"))
    pivots = pairs.select("b").distinct().join(F.broadcast(hot), "b", "left").select("b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"))
    partners = dealt.join(held.withColumnRenamed("id", "a"), "a").select("b", "blk", "a", "_t")
    heads = pivots.join(held.withColumnRenamed("id", "b"), "b").select("b", "blk", F.lit(None).cast(pairs.schema["a"].dataType).alias("a"), "_t")
    rows = heads.unionByName(partners).repartition("b", "blk").sortWithinPartitions("b", "blk", F.asc_nulls_first("a"))
    return rows.select("b", "a", "_t").mapInArrow(run, pairs.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """``id``, ``label``: the smallest id reachable over ``links`` (a, b), for ids with a link.

    Alternating stars: each id points its larger neighbours, then its smaller ones, at the smallest id around it, until
    every id points at one that points nowhere; a few rounds for any shape, and each written out.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).union(edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u", F.lit(1).cast("long").alias("n")).limit(1)).isEmpty():
        both = edges.union(edges.select("v", "u"))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # the middle of a large star has very many edges
        large = join_spread(both, least, "u", heaviest(least.where("n > 1000"), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = stash(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _classified(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 7, bands: int = 56, hot_copies: int = 10_000, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles`` and ``component_id`` of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed, final = _components_of_classes(docs, shingle, percent, rows, bands)
    # a class with very many copies is sent to them; the other copies go to their classes
    hot = final.where(F.col("copies") > hot_copies).select("set_hash", F.col("component_id").alias("_hot"))
    rows_ = signed.select("doc_id", "text_hash", "n_shingles", "set_hash").join(small(hot, 10_000), "set_hash", "left")
    at_home = F.col("_hot").isNull() & F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull()
    near = rows_.where(at_home).join(final.select("set_hash", "component_id"), "set_hash").select("doc_id", "text_hash", "n_shingles", "component_id")
    rest = rows_.where(~at_home).select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_hot", "doc_id")).alias("component_id"))
    return near.union(rest)


def _components_of_classes(docs: DataFrame, shingle: int, percent: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows; ``set_hash``, ``copies`` and ``component_id`` of all classes of one set. Both written out."""
    signed = stash(signatures(docs, shingle, rows, bands))
    known = signed.where("doc_id is not null and set_hash is not null").select(F.struct("doc_id", "text_hash").alias("id"), "set_hash", "buckets")
    # classes of one shingle set: partial aggregation, so thousands of copies shuffle as a few rows
    classes = stash(known.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("buckets").alias("buckets"), F.count("*").alias("copies")))
    # buckets with company; the pivot of a bucket is its smallest id, so near copies of one text mostly share theirs
    members = classes.select(F.explode("buckets").alias("bucket"), "rep.doc_id", "rep.text_hash")
    rep = F.struct("doc_id", "text_hash")
    buckets = stash(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(rep).alias("pivot")).where("n > 1"))
    heavy = heaviest(buckets, "bucket")
    crowded = stash(join_spread(members, buckets, "bucket", heavy))
    links = stash(confirmed(_ordered(crowded.select(rep.alias("x"), F.col("pivot").alias("y"))), docs, shingle, percent))
    labels = stash(components(links))
    # buckets that still hold several components, grouped by the smallest of them: a member stands in a group once
    flat = labels.select("id.doc_id", "id.text_hash", "label")
    here = crowded.where("n > 2").select("bucket", "doc_id", "text_hash").join(flat, ["doc_id", "text_hash"], "left").withColumn("label", F.coalesce("label", rep))
    here = stash(here.select("bucket", "doc_id", "text_hash", "label"))
    mixed_ = stash(here.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi"))
    if not mixed_.isEmpty():
        here = join_spread(here, mixed_, "bucket", heaviest(mixed_, "bucket"))
        here = stash(here.select(F.xxhash64("lo").alias("grp"), "doc_id", "text_hash", F.xxhash64("label").alias("lab")).distinct())
        asked = here.select("doc_id", "text_hash").distinct()
        of = docs.withColumn("text_hash", F.xxhash64("text")).join(asked, ["doc_id", "text_hash"], "left_semi").select("doc_id", "text")
        found = stash(near_limit(here.join(held_sets(of, shingle), ["doc_id", "text_hash"]), percent, groups=here))
        found = stash(confirmed(found, docs, shingle, percent)) if not found.isEmpty() else found
        if not found.isEmpty():
            labels = stash(components(links.union(found)))
    joined = classes.select("set_hash", "copies", F.col("rep").alias("id")).join(labels, "id", "left")
    return signed, stash(joined.select("set_hash", "copies", F.coalesce("label.doc_id", "id.doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, **settings) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    Documents whose sets of ``shingle``-word shingles overlap by ``percent`` or more are linked; ``component_id`` is the
    smallest doc_id reachable and one document of each component, that one, is kept. Null, empty and blank texts have no
    shingles and are linked with nothing. A row with a null doc_id takes no part: its component is null and it is kept.
    Rows of one doc_id with different texts are documents of their own; identical rows stay repeated. An empty table
    gives an empty result; other columns are ignored. Ids are cast to long.
    """
    found = _classified(docs, shingle, percent, **settings)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` but for those that another document stands for; of rows that agree in id and text one stays.

    Rows with a null id and texts without words all stay. ``docs`` may have any other columns, which come back as they are.
    """
    found = stash(_classified(docs, shingle, percent, text=text, **settings).where("doc_id is not null"))
    own_id, own_hash = fresh("_id", docs.columns), fresh("_hash", docs.columns)
    id_ = [F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).eqNullSafe(F.col(own_hash))]
    named = lambda df: df.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    gone = stash(named(found.where("doc_id <> component_id")).distinct())
    kept = docs.join(small(gone, 100_000), id_[0] & id_[1], "left_anti")
    again = stash(named(found.where("doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")))
    if again.isEmpty():
        return kept
    repeated = kept.join(small(again, 100_000), id_[0] & id_[1], "left_semi").dropDuplicates(["doc_id", text])
    return kept.join(small(again, 100_000), id_[0] & id_[1], "left_anti").unionByName(repeated)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES = {
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 2 THEN list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) ELSE words END) AS shingle FROM w
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
k AS (SELECT u, min(v) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN k ON k.u = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
}
