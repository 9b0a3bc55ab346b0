"""Best documents of many questions by a stored index of postings, with exact early stop.

The index is written once: documents form blocks where they lie, some blocks a shard of a bounded number of items, and a
row holds a term's postings in a block with the greatest value among them. The greatest values bound what any
document of a block can score for a question, so a block whose bound is below the k-th best score so far isn't looked at.

Questions are dealt into blocks of bounded bytes, which travel to the tasks as sparse rows; a task scores one shard for
one block of questions and returns k rows a question at most. No pair of a question and a document exists outside a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import stash

MOST_TERMS = 1_000_000  # of all questions: up to here the index holds only terms that a question has


class Best:
    """The ``k`` best documents of each question so far, by score and then by the smaller id."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.kept: list = [(np.zeros(0), np.zeros(0, object), np.zeros(0))] * n  # rounded scores, ids, scores
        self.least = np.full(n, -np.inf)  # what a rounded score must reach to stay

    def add(self, which: np.ndarray, raw: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Scores of the questions ``which`` (rows) for documents ``ids`` (columns, ascending)."""
        scores = np.round(raw, self.digits)
        open_ = valid & (scores >= self.least[which, None])
        for row in np.flatnonzero(open_.any(1)).tolist():
            q = which[row]
            old_scores, old_ids, old_raw = self.kept[q]
            here = np.flatnonzero(open_[row])
            # of a block only its k best can stay
            here = here[np.argsort(-scores[row, here], kind="stable")[: self.k]]
            s, i, r = np.concatenate([old_scores, scores[row, here]]), np.concatenate([old_ids, ids[here]]), np.concatenate([old_raw, raw[row, here]])
            by_id = np.argsort(i, kind="stable")
            best = by_id[np.argsort(-s[by_id], kind="stable")][: self.k]
            self.kept[q] = s[best], i[best], r[best]
            if len(best) == self.k:
                self.least[q] = s[best[-1]]


def saturated(k1: float, b: float, mean: float) -> Callable:
    """BM25's value of a token with frequency ``n`` in a document of ``size`` tokens."""
    return lambda n, size: n * (k1 + 1) / (n + k1 * (1 - b + b * size / mean))


def present(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (n > 0).astype(float)


def postings(corpus: DataFrame, value: Callable, terms: DataFrame | None = None, per_block: int = 256, per_shard: int = 2_000_000) -> DataFrame:
    """The stored index of ``corpus`` (see ``top_k``): shard, block, term, most, docs, weights; and for each block a row without a term with ids and bonus.

    ``docs`` are places in ``ids``, which ascend; ``most`` is the greatest of ``weights``. With ``terms`` (a column term, at
    most ``MOST_TERMS`` rows) others are left out. Blocks are made where the documents lie; a shard has up to 64 of them and
    about ``per_shard`` items.
    """
    spark, id_type = corpus.sparkSession, corpus.schema["doc_id"].dataType
    wanted = spark.sparkContext.broadcast(terms.toArrow().column("term").combine_chunks() if terms is not None else None)
    schema = T.StructType([T.StructField("shard", T.LongType()), *T._parse_datatype_string("block int, term string, most double, docs array<int>, weights array<double>").fields, T.StructField("ids", T.ArrayType(id_type)), T.StructField("bonus", T.ArrayType(T.DoubleType()))])

    def rows_of(part, number: int, b: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        part = part.take(pc.sort_indices(part.column(0)))
        ids, items, size, bonus = (part.column(c) for c in range(4))
        flat, owner = pc.list_flatten(items), pc.list_parent_indices(items).to_numpy(zero_copy_only=False)
        keep = flat.is_valid() if wanted.value is None else pc.is_in(flat, value_set=wanted.value, skip_nulls=True)
        flat, owner = flat.filter(keep), owner[keep.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        cells, n = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * part.num_rows + owner, return_counts=True)
        of_term, of_doc = cells // part.num_rows, cells % part.num_rows
        weights = value(n.astype(float), size.fill_null(0.0).to_numpy(zero_copy_only=False)[of_doc]).astype(float)
        starts = np.flatnonzero(np.diff(of_term, prepend=-1))
        ends, k = pa.array(np.append(starts, len(cells)), pa.int32()), len(starts)
        whole = pa.array([0, len(ids)], pa.int32())
        lists = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(ends, values), pa.nulls(1, pa.list_(values.type))])
        last = lambda values: pa.concat_arrays([pa.nulls(k, pa.list_(values.type)), pa.ListArray.from_arrays(whole, values)])
        columns = [
            pa.array([number] * (k + 1), pa.int64()), pa.array([b] * (k + 1), pa.int32()),
            pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.concat_arrays([pa.array(np.maximum.reduceat(weights, starts) if k else np.zeros(0)), pa.nulls(1, pa.float64())]),
            lists(pa.array(of_doc, pa.int32())), lists(pa.array(weights)), last(ids), last(bonus.fill_null(0.0)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def build(batches):
        from pyspark import TaskContext

        shard, block, items = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                yield rows_of(part, shard, block)
                block, items = block + 1, items + len(part.column(1).flatten())
                if block == 64 or items >= per_shard:
                    shard, block, items = shard + 1, 0, 0

    columns = corpus.select("doc_id", "items", F.col("size").cast("double").alias("size"), F.col("bonus").cast("double").alias("bonus"))
    return stash(columns.mapInArrow(build, schema))


class Asked:
    """A block of questions as sparse rows: for each term the questions that have it and their weights."""

    def __init__(self, rows):
        self.ids = rows.column("query_id").combine_chunks()
        self.parts = np.array([float(p or 1.0) for p in rows.column("parts").to_pylist()])
        import pyarrow.compute as pc

        items, weights = rows.column("items").combine_chunks(), rows.column("weights").combine_chunks()
        of, flat = pc.list_parent_indices(items).to_numpy(zero_copy_only=False), pc.list_flatten(items)
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        self.terms = coded.dictionary
        term, weight = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), pc.list_flatten(weights).to_numpy(zero_copy_only=False)
        order = np.argsort(term[known], kind="stable")
        self.question, self.weight = of[known][order], weight[known][order].astype(float)
        self.first = np.searchsorted(term[known][order], np.arange(len(self.terms) + 1))

    def having(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the places of ``terms``: which of them, and which entry, for each question that has it."""
        n = self.first[terms + 1] - self.first[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.first[terms][which]


def best_of_shard(shard, asked: Asked, k: int, digits: int, zeros: bool) -> tuple[Best, int, int]:
    """The best documents of a shard for each question; how many pairs of a question and a block were looked at, and how many there are."""
    import pyarrow.compute as pc

    shard = shard.combine_chunks()
    column = lambda name: shard.column(name).combine_chunks()
    block, term, most = column("block").to_numpy(), pc.index_in(column("term"), value_set=asked.terms).fill_null(-1).to_numpy(zero_copy_only=False), column("most").fill_null(0.0).to_numpy(zero_copy_only=False)
    no_term = column("term").is_null().to_numpy(zero_copy_only=False)
    n, n_blocks = len(asked.ids), int(block.max()) + 1
    if not n:
        return Best(0, k, digits), 0, 0
    used = np.flatnonzero((term >= 0) & ~no_term)
    which, entry = asked.having(term[used])
    bounds = np.full(n * n_blocks, 0.0 if zeros else -np.inf)
    cell = asked.question[entry] * n_blocks + block[used][which]
    gains = np.maximum(asked.weight[entry], 0.0) * most[used][which]
    held = np.bincount(cell, minlength=len(bounds)) > 0
    bounds[held] = np.bincount(cell, gains, len(bounds))[held]
    of_block = {int(block[r]): r for r in np.flatnonzero(no_term).tolist()}
    bonus = {b: shard.column("bonus")[r].values.to_numpy() for b, r in of_block.items()}
    extra = np.array([max(0.0, bonus[b].max(initial=0.0)) if b in bonus else 0.0 for b in range(n_blocks)])
    bounds = bounds.reshape(n, n_blocks) / asked.parts[:, None] + extra
    best, looked = Best(n, k, digits), 0
    rows_of = {b: np.flatnonzero(block[used] == b) for b in of_block}
    # each question's two most promising blocks first, so that most others can be skipped
    turn = np.minimum(np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1, kind="stable"), 2)
    by_bound = np.argsort(-bounds.max(axis=0), kind="stable").tolist()
    starts = column("docs").offsets.to_numpy()
    all_docs, all_weights = column("docs").flatten().to_numpy(), column("weights").flatten().to_numpy()
    for t, b in [(t, b) for t in range(3) for b in by_bound]:
        open_ = np.isfinite(bounds[:, b]) & (turn[:, b] == t) & (np.round(bounds[:, b] + 1e-9, digits) >= best.least)
        if not open_.any():
            continue
        which_q = np.flatnonzero(open_)
        looked += len(which_q)
        values_ids = shard.column("ids")[of_block[b]].values
        ids = np.empty(len(values_ids), object)
        ids[:] = values_ids.to_pylist()
        rows = used[rows_of[b]]
        values = np.zeros((len(rows), len(ids)))
        sizes = starts[rows + 1] - starts[rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        held_at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[rows][row]
        values[row, all_docs[held_at]] = all_weights[held_at]
        at, entries = asked.having(term[rows])
        mine = open_[asked.question[entries]]
        order = np.argsort(asked.question[entries[mine]], kind="stable")
        at, entries = at[mine][order], entries[mine][order]
        place = np.searchsorted(which_q, asked.question[entries])
        raw, shared = np.zeros((len(which_q), len(ids))), np.zeros((len(which_q), len(ids)), bool)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        for start in range(0, len(cuts), 64):  # questions at a time
            first, stop = cuts[start], cuts[start + 64] if start + 64 < len(cuts) else len(place)
            here, own = values[at[first:stop]], asked.weight[entries[first:stop], None]
            inside = cuts[start : start + 64] - first
            raw[place[cuts[start : start + 64]]] = np.add.reduceat(here * own, inside, axis=0)
            shared[place[cuts[start : start + 64]]] = np.logical_or.reduceat((here != 0) & (own != 0), inside, axis=0)
        scores = raw / asked.parts[which_q, None] + np.where(shared, bonus[b], 0.0)
        best.add(which_q, scores, ids, np.ones_like(shared) if zeros else shared)
    return best, looked, n * len(of_block)


def top_k(questions: DataFrame, corpus: DataFrame, k: int, value: Callable = None, zeros: bool = False, digits: int = 9, block: int = 4096, most_bytes: int = 32_000_000, per_block: int = 256) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the ``k`` best documents of each question.

    ``questions``: query_id, items (distinct strings), weights (as many numbers), parts (the score is divided by it).
    ``corpus``: doc_id, items (strings, repeated as often as they occur), size, bonus (added where an item is shared).
    An item shared counts its weight times ``value`` (occurrences, size), which is positive. Documents without a shared item
    appear only with ``zeros``, and then with their score of 0. Scores are compared rounded to ``digits``; the smaller doc_id
    wins ties. Null items and ids of questions drop. A block of questions has about ``block`` of them and ``most_bytes`` of items.
    """
    spark, value = questions.sparkSession, value or present
    asked = stash(questions.where("query_id is not null").select("query_id", "items", "weights", "parts"))
    bytes_ = F.coalesce(F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
    total = asked.agg(F.count("*").alias("n"), F.sum(bytes_).alias("bytes")).first()
    n_blocks = max(1, -(-total["n"] // block), -(-(total["bytes"] or 0) // most_bytes))
    terms = stash(asked.select(F.explode("items").alias("term")).where("term is not null").distinct())
    index = postings(corpus.where("doc_id is not null"), value, terms if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else None, per_block)
    id_type = corpus.schema["doc_id"].dataType
    schema = T.StructType([asked.schema["query_id"], T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])

    def scorer(packed):
        def score(shard):
            import pyarrow as pa

            best, *_ = best_of_shard(shard, packed.value, k, digits, zeros)
            kept = [(q, i, s) for q, (_, docs, scores) in enumerate(best.kept) for s, i in zip(scores.tolist(), docs.tolist(), strict=True)]
            ids = packed.value.ids.take(pa.array([r[0] for r in kept], pa.int64()))
            return pa.Table.from_arrays([ids, pa.array([r[1] for r in kept], shard.schema.field("ids").type.value_type), pa.array([r[2] for r in kept], pa.float64())], schema.names)

        return score

    found = None
    for b in range(n_blocks):
        # bounded in rows and bytes: a part of the questions on its way to the tasks
        packed = spark.sparkContext.broadcast(Asked(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toArrow()))
        here = index.groupBy("shard").applyInArrow(scorer(packed), schema)
        if n_blocks > 1:  # its questions aren't needed any more
            here = stash(here)
            packed.destroy()
        found = here if found is None else found.unionByName(here)
    from .retrieval import top_k as ranked

    return ranked(found, "query_id", k, digits=digits)
