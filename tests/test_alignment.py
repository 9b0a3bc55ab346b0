"""Candidates of paragraphs and their scores against plain versions that compare every pair of a source."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillgraph.functions import similarity
from quillgraph.operators import align


def _texts(rng, n):
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(25)]
    return ["".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 8, 20]))) for _ in range(n)]


def _plain(gold, clauses, limit, n=4):
    """Rows of (cid, shared) by comparing every clause."""
    own = align.grams_of(gold, n)
    shared = {cid: len(own & align.grams_of(t, n)) for cid, t in clauses if t}
    best = sorted((c for c in shared if shared[c]), key=lambda c: (-shared[c], c))[:limit]
    return {c: shared[c] for c in {*best, *(c for c, t in clauses if t and (gold in t or t in gold))}}


def test_block_against_every_pair():
    rng = random.Random(3)
    for _ in range(40):
        texts = [t for t in _texts(rng, 60) if t]
        block = align.Block(texts, 4)
        for gold in [t for t in _texts(rng, 20) if t] + texts[:5] + ["a", "abc", "zzzzz"]:
            own = align.grams_of(gold, 4)
            shared = [len(own & align.grams_of(t, 4)) for t in texts]
            assert block.most_shared(own, 7) == sorted((k for k in range(len(texts)) if shared[k]), key=lambda k: (-shared[k], k))[:7]
            assert block.inside(gold, own) == {k for k, t in enumerate(texts) if gold in t or t in gold}


def test_search_stops_before_common_grams():
    """Clauses that share only what all texts share are not looked at."""
    rng = random.Random(4)
    common = "".join(rng.choices("abcdefgh", k=60))
    texts = [common] * 400 + ["".join(rng.choices("uvwxyz", k=300)) + common for _ in range(20)]
    block, walked = align.Block(texts, 4), []

    class Watched(dict):
        def __getitem__(self, gram):
            walked.append(gram)
            return dict.__getitem__(self, gram)

    own = align.grams_of("".join(t[:300] for t in texts[400:]) + common, 4)
    everything = sum(len(block.postings[g]) for g in own)
    sizes = {g: len(block.postings[g]) for g in own}
    full = sorted(range(len(texts)), key=lambda k: (-len(own & block.grams[k]), k))[:12]
    block.postings = Watched(block.postings)
    assert block.most_shared(own, 12) == full
    seen = [g for g in set(walked) if walked.count(g) > 2]  # once to sort by size and once more where it is walked
    assert sum(sizes[g] for g in seen) < everything / 2


def test_candidates_over_blocks(spark):
    rng = random.Random(5)
    sides = {}
    for side, n in (("p", 150), ("c", 260)):
        sides[side] = [(rng.choice(["big", "big", "big", "one", "two", None]), i, t) for i, t in enumerate(_texts(rng, n))] + [("empty" + side, 9000, "abcd")]
    p = spark.createDataFrame(sides["p"], "source string, pid long, p_text string")
    c = spark.createDataFrame(sides["c"], "source string, cid long, c_text string")
    want = {}
    for source, pid, gold in sides["p"]:
        if source and gold:
            for cid, n in _plain(gold, [(k, t) for s, k, t in sides["c"] if s == source], 12).items():
                want[source, pid, cid] = n
    for block in (16, 512):
        got = align.candidates(p, c, block=block).collect()
        assert {(r["source"], r["pid"], r["cid"]): r["shared"] for r in got} == want and len(got) == len(want)
    value, _ = align.score(F.col("p_text"), F.col("c_text"))
    quick, _ = align.score(F.col("p_text"), F.col("c_text"), counted=align.COUNTED)
    assert align.candidates(p, c).where(F.abs(value - quick) > 1e-12).count() == 0
    assert align.candidates(p.limit(0), c).count() == 0 and align.candidates(p, c.limit(0)).count() == 0


def test_full_score_with_ratio(spark):
    """The score with its tenth of matching blocks, the best clause and its margin, for all pairs of a source."""
    rng = random.Random(6)
    ps, cs = ([("s", i, t) for i, t in enumerate(_texts(rng, n)) if t] for n in (15, 25))
    pairs = align.candidates(spark.createDataFrame(ps, "source string, pid long, p_text string"), spark.createDataFrame(cs, "source string, cid long, c_text string"))
    value, method = align.score(F.col("p_text"), F.col("c_text"), F.col("ratio"), counted=align.COUNTED)
    scored = pairs.withColumn("ratio", similarity.sequence_ratio("p_text", "c_text")).withColumns({"score": value, "method": method})
    got = {r["pid"]: r for r in align.best_with_margin(scored, ["source", "pid"], align.ANSWER_GATES).collect()}

    def plain(a, b):
        cover = min(len(a), len(b)) / max(len(a), len(b))
        if a in b:
            return 0.92 + 0.08 * cover
        if b in a:
            return min(0.91, 0.72 + 0.19 * cover)
        x, y = align.grams_of(a, 4), align.grams_of(b, 4)
        r, q = len(x & y) / len(x), len(x & y) / len(y)
        return 0.72 * r + 0.18 * (2 * r * q / (r + q) if r + q else 0) + 0.10 * SequenceMatcher(None, a, b, autojunk=False).ratio()

    for _, pid, gold in ps:
        ranked = sorted(((-round(plain(gold, dict((k, t) for _, k, t in cs)[c]), 9), c) for c in _plain(gold, [(k, t) for _, k, t in cs], 12)))
        if not ranked:
            assert pid not in got
            continue
        runner = -ranked[1][0] if len(ranked) > 1 else 0.0
        assert got[pid]["cid"] == ranked[0][1] and abs(got[pid]["score"] + ranked[0][0]) < 1e-8 and abs(got[pid]["margin"] - (-ranked[0][0] - runner)) < 1e-8
