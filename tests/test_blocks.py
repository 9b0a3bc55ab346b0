"""Blocks of searches: how often rows and questions travel, and results against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import blocks, retrieval


@pytest.fixture(scope="module")
def scoped(spark):
    """Scope 0 holds 400 rows, 1 to 40 hold 5 each, 41 holds rows nobody asks for; scope 50 is asked but empty; null scopes."""
    rng = np.random.default_rng(5)
    sizes = [(0, 400), *((s, 5) for s in range(1, 41)), (41, 300), (None, 7)]
    rows, n = [], 0
    for scope, size in sizes:
        for _ in range(size):
            rows.append((n, scope, [float(x) for x in rng.integers(-2, 3, 4)]))
            n += 1
    asks = [(10_000 + i, scope, [float(x) for x in rng.integers(-2, 3, 4)]) for i, scope in enumerate([*[0] * 30, *range(1, 41), 50, None])]
    asks += [(10_000, 3, asks[0][2])]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, scope long, v array<double>").repartition(3)
    return rows, asks, df(rows, "doc_id"), df(asks, "query_id")


@pytest.mark.parametrize(("row_block", "query_block"), [(100, 10), (16_384, 2_048), (3, 2)])
def test_copies_follow_the_scope_and_not_the_table(scoped, row_block, query_block):
    rows, asks, vectors, queries = scoped
    of = lambda d, name: d.select(F.col(name).alias("id"), "v", "scope")
    placed = retrieval.placed_in_blocks(of(queries, "query_id"), of(vectors, "doc_id"), row_block, query_block)
    size = lambda table, scope: sum(r[1] == scope for r in table)
    got = {(r["asks"], r["id"], r["scope"]): r["n"] for r in placed.groupBy("asks", "id", "scope").agg(F.count("*").alias("n")).collect()}
    number = lambda n, block: -(-n // block)
    want = {(True, i, s): number(size(rows, s), row_block) for i, s, _ in asks if s is not None and size(rows, s)}
    want |= {(False, i, s): number(size(asks, s), query_block) for i, s, _ in rows if s is not None and size(asks, s)}
    assert got == want
    # a pair of one scope meets once
    cells = placed.where("asks").alias("q").join(placed.where("not asks").alias("r"), ["cell", "qb", "rb", "scope"])
    assert cells.count() == sum(size(rows, s) for _, s, _ in asks if s is not None)


@pytest.mark.parametrize(("row_block", "query_block"), [(100, 10), (16_384, 2_048), (3, 2)])
def test_scoped_search_equals_a_plain_one(scoped, row_block, query_block):
    rows, asks, vectors, queries = scoped
    got = retrieval.dense_top_k(queries, vectors, 4, scopes=True, exclude_self=False, keep_scope=True, row_block=row_block, query_block=query_block)
    want = []
    for i, scope, v in asks:
        scored = []
        for j, s, x in rows:
            if s == scope and scope is not None:
                norms = np.linalg.norm(v) * np.linalg.norm(x)
                scored.append((-round(float(np.dot(v, x) / norms) if norms else 0.0, 9), j))
        want += [(i, scope, j, rank) for rank, (_, j) in enumerate(sorted(scored)[:4], 1)]
    assert sorted((r["query_id"], r["scope"], r["doc_id"], r["rank"]) for r in got.collect()) == sorted(want)
    assert got.columns == ["scope", "query_id", "doc_id", "score", "rank"]


def test_unscoped_search_in_blocks(scoped):
    rows, asks, vectors, queries = scoped
    one = queries.dropDuplicates(["query_id"])
    whole = retrieval.dense_top_k(one, vectors, 3).collect()
    cut = retrieval.dense_top_k(one, vectors, 3, row_block=50, query_block=7).collect()
    assert len(whole) == 3 * one.count() and sorted(map(str, whole)) == sorted(map(str, cut))
    assert retrieval.dense_top_k(one, vectors.limit(0), 3).count() == 0


# Lexical search


def lexical(spark, seed, n=600, asks=40):
    rng = np.random.default_rng(seed)
    word = lambda size: [f"t{int(x)}" for x in np.minimum(rng.zipf(1.3, size), 400)]
    docs = [(i, word(rng.integers(0, 30)), 0.0) for i in rng.permutation(n).tolist()]
    docs = [(i, w + [None] * (i % 2), float(len(w)), 0.05 * (i % 3)) for i, w, _ in docs]
    questions = [(1000 + i, sorted(set(word(8))), i % 4 + 1.0) for i in range(asks)] + [(5000, [], 1.0), (5001, None, 1.0), (5002, ["nowhere"], None), (None, ["t1"], 1.0)]
    questions = [(i, w, [round(float(x), 3) for x in rng.normal(1, 1, len(w or []))], p) for i, w, p in questions]
    corpus = spark.createDataFrame(docs, "doc_id long, items array<string>, size double, bonus double").repartition(3)
    return docs, questions, corpus, spark.createDataFrame(questions, "query_id long, items array<string>, weights array<double>, parts double")


@pytest.mark.parametrize("zeros", [False, True])
@pytest.mark.parametrize("settings", [{}, {"block": 7, "per_block": 16}, {"most_bytes": 500, "per_block": 1}])
def test_lexical_search_equals_a_plain_one(spark, zeros, settings):
    docs, questions, corpus, asked = lexical(spark, 3)
    value = blocks.saturated(1.5, 0.75, 10.0)
    got = blocks.top_k(asked, corpus, 5, value, zeros=zeros, **settings)
    want = []
    for i, items, weights, parts in questions:
        if i is None:
            continue
        scored = []
        for j, held, size, bonus in docs:
            shared = [(w, held.count(t)) for t, w in zip(items or [], weights, strict=True) if t in held and w]
            if shared or zeros:
                scored.append((-round(sum(w * value(n, size) for w, n in shared) / (parts or 1.0) + (bonus if shared else 0.0), 9), j))
        want += [(i, j, rank) for rank, (_, j) in enumerate(sorted(scored)[:5], 1)]
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()) == sorted(want)
    assert blocks.top_k(asked, corpus.limit(0), 5, value, zeros=zeros).count() == 0 == blocks.top_k(asked.limit(0), corpus, 5, value, zeros=zeros).count()


def test_bounds_skip_blocks_and_lose_nothing(spark):
    """Rare words decide: most blocks can't reach the k-th best score and aren't looked at."""
    docs = [(i, ["common"] * (1 + i % 3) + [f"rare{i}", f"group{i // 40}"], 4.0, 0.0) for i in range(4000)]
    corpus = spark.createDataFrame(docs, "doc_id long, items array<string>, size double, bonus double")
    asked = spark.createDataFrame([(q, ["common", f"rare{37 * q}", f"group{q}"], [0.01, 5.0, 2.0], 1.0) for q in range(50)], "query_id long, items array<string>, weights array<double>, parts double")
    index = blocks.postings(corpus.coalesce(1), blocks.present, per_block=64, per_shard=1_000_000)
    shards = [index.where(F.col("shard") == r["shard"]).toArrow() for r in index.select("shard").distinct().collect()]
    packed, looked, pairs = blocks.Asked(asked.toArrow()), 0, 0
    for shard in shards:
        best, here, there = blocks.best_of_shard(shard, packed, 5, 9, False)
        looked, pairs = looked + here, pairs + there
    assert pairs == 50 * -(-4000 // 64) and looked < 0.25 * pairs
    for q, (scores, ids, _) in enumerate(best.kept if len(shards) == 1 else []):
        want = sorted((-round(0.01 + 5.0 * (i == 37 * packed.ids[q].as_py()) + 2.0 * (i // 40 == packed.ids[q].as_py()), 9), i) for i in range(4000))[:5]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_many_long_questions_stay_sparse():
    """4,096 questions of 200 words out of 50,000: a matrix of both would hold 1.6 GB."""
    import pickle

    import pyarrow as pa

    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(50_000)]
    items = [[names[j] for j in rng.choice(50_000, 200, replace=False)] for _ in range(4096)]
    rows = pa.table({"query_id": list(range(4096)), "items": items, "weights": [[1.0] * 200] * 4096, "parts": [1.0] * 4096})
    asked = blocks.Asked(rows)
    assert len(pickle.dumps(asked)) < 20_000_000 and len(asked.weight) == 4096 * 200
    which, entry = asked.having(np.arange(len(asked.terms)))
    assert sorted(entry.tolist()) == list(range(4096 * 200)) and (np.diff(which) >= 0).all()
