"""Metrics whose ratio SQL doesn't express, against plain versions on the smallest tables."""

import difflib
import os
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import metrics
from quillgraph.plans import evaluation_queries

SF = "/root/testdata/sf0.001"
CODE = re.compile(r"(?:GB/T|GBT|GB|HB(?:/Z)?|HB_Z|GJB|QJ|SJ)[\s+]*[\d\-—－/.A-Za-z（）()]+", re.I)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def words(s):
    return {w for w in re.findall("[A-Za-z0-9]{2,}", CODE.sub(" ", s)) if not w.isdigit()}


def matches(a, b):
    x, y = words(a), words(b)
    if not x or not y:
        return False
    both = len(x & y)
    return (both >= 3 and both / min(len(x), len(y)) >= 0.35) or ratio(CODE.sub(" ", a), CODE.sub(" ", b)) >= 0.62


@pytest.fixture(scope="module")
def turns(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    out = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r["conv_id"], {"user": [], "assistant": []}).setdefault(r["role"], []).append(r["text"] or "")
    return out


def test_paragraphs_with_ratio(spark, turns):
    got = {r["query_id"]: r for r in evaluation_queries.paragraph_metrics_with_ratio(spark, SF).collect()}
    assert set(got) == {c for c, t in turns.items() if t["user"]}
    for c, r in got.items():
        gold, found = turns[c]["user"], turns[c]["assistant"]
        for k in (1, 5, 10):
            n = sum(any(matches(p, g) for p in found[:k]) for g in gold)
            assert (r[f"para_hit_{k}"], r[f"para_recall_{k}"]) == (float(n > 0), round(n / len(gold), 6))


def test_context(spark, turns):
    for r in evaluation_queries.context_metrics(spark, SF).collect():
        gold, found = turns[r["query_id"]]["user"], turns[r["query_id"]]["assistant"]
        recall = sum(max((ratio(g, p) for p in found), default=0.0) for g in gold) / len(gold)
        if found and max(map(len, found)) <= 30:
            recall = len(set(gold) & set(found)) / len(set(gold))
        bare = lambda s: CODE.sub(" ", s).strip()
        best = [max(ratio(bare(g), bare(p)) for g in gold if bare(g)) for p in found if bare(p)][:5]
        assert r["context_recall"] == pytest.approx(recall, abs=1e-6) and r["context_relevance"] == pytest.approx(sum(best) / len(best) if best else 0.0, abs=1e-6)


def test_short_contexts_are_ids(spark):
    got = spark.createDataFrame([(1, 1, "d1"), (1, 2, "d3"), (2, 1, "x" * 31), (2, 2, "d1"), (4, 1, None)], "query_id long, rank int, text string")
    gold = spark.createDataFrame([(1, "d1"), (1, "d1"), (1, "d2"), (2, "d1"), (2, "d2"), (3, "d1"), (4, "d1")], "query_id long, text string")
    rows = {r["query_id"]: r["context_recall"] for r in metrics.context_metrics(got, gold).collect()}
    assert rows == {1: 0.5, 2: pytest.approx((1.0 + ratio("d2", "d1")) / 2), 3: 0.0, 4: 0.0}


def test_cjk_paragraphs(spark):
    text = "根据HB 8364-2013的规定，密封圈应进行检验 123 ok x"
    got = spark.createDataFrame([(text,)], "t string").select(metrics.paragraph_tokens(F.col("t")).alias("v")).first()["v"]
    assert "密封" in got and "密封圈" in got and "检验" not in got and "123" not in got and "ok" in got and "x" not in got and "根据" not in got


def test_same_standard_falls_back_to_all(spark):
    got = spark.createDataFrame([(1, 1, "a", "HB+1-2000.md"), (1, 2, "b", "HB+2-2000.md"), (1, 3, "c", "HB 2-2000")], "query_id long, rank int, key string, standard string")
    gold = spark.createDataFrame([(1, "c", "HB 2-2000"), (1, "a", "GJB 9-1999"), (2, "z", "")], "query_id long, key string, standard string")
    rows = {r["query_id"]: r for r in metrics.same_standard_metrics(got, gold).collect()}
    assert (rows[1]["same_std_recall_1"], rows[1]["same_std_mrr"], rows[1]["gold_all_in_context"]) == (0.5, 0.75, 1.0) and rows[2]["same_std_mrr"] == 0 == rows[2]["gold_all_in_context"]


@pytest.mark.parametrize("p, g, score", [("It is Paris [1].", "paris", 1.0), ("Unable to answer based on the provided information", "x", 0.0), ("No, never", "no", 1.0), ("a b", "b c", 0.5), ("nothing", "no", 0.0)])
def test_answer_score(spark, p, g, score):
    assert spark.createDataFrame([(p, g)], "p string, g string").select(metrics.answer_score(F.col("p"), F.col("g")).alias("v")).first()["v"] == score


def test_entities(spark):
    r = spark.createDataFrame([("HB 8364-2013 uses TC4 at 3.5 mm",)], "t string").select(metrics.answer_entities(F.col("t")).alias("e"), metrics.key_phrases(F.col("t")).alias("k")).first()
    assert set(r["e"]) == {"HB", "TC4", "8364", "2013", "4", "3.5"} and set(r["k"]) == {"mm", "HB", "TC4"}
