"""Training pairs and methods that SQL doesn't express, against plain versions."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import scoped, splits, training
from quillgraph.plans import methods, result_queries

SF = "/root/testdata/sf0.001"


def plain_clauses(html):
    s = re.sub(r"!\[.*?\]\([^)]*\)", " ", html or "")
    s = re.sub("#+", " ", re.sub(r"<[^>]+>", " ", s))
    out = []
    for part in re.split(r"(?<=[。；;])|\n+", s):
        part = re.sub(r"\s+", " ", part).strip(" ；;，,。")
        pieces = [part]
        if len(part) > 620:
            pieces, buf = [], ""
            for sub in re.split(r"(?<=[，,、])", part):
                if len(buf) + len(sub) > 520:
                    pieces.append(buf)
                    buf = ""
                buf += sub
            pieces = [p for p in [*pieces, buf] if 18 <= len(p.strip()) <= 620]
            pieces = [p.strip(" ；;，,。") for p in pieces]
        elif len(part) < 18:
            pieces = []
        out += pieces
    return [p for p in out if len(re.sub(r"\s+", "", p)) >= 18]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_clauses_of_pages(spark):
    got = {}
    for r in result_queries.plain_markdown_clauses(spark, SF).orderBy("page_id", "part_index").collect():
        got.setdefault(r["page_id"], []).append(r["clause"])
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got.get(r["page_id"], []) == plain_clauses(r["html"])


def test_clauses_of_a_text(spark):
    of = lambda body: spark.createDataFrame([(body,)], "t string").select(training.markdown_clauses(F.col("t")).alias("c")).first()["c"]
    assert of("GB/T 28878.1-2012 (2017)-ABCDEF\n## 密封圈应符合设计图样的要求并进行检验和试验。短。") == ["密封圈应符合设计图样的要求并进行检验和试验"]
    assert of("前言 本标准由某某单位负责起草和归口管理工作") == [] and of(None) == []
    long = "，".join("零件表面应保持清洁无油污" for _ in range(80))
    assert all(18 <= len(c) <= 520 for c in of(long)) and "".join(of(long)).replace("，", "") == long.replace("，", "")


def test_tiers(spark):
    rows = [(i, f"s{i // 10}", i % 10, f"text number {i} of its source", [float(i % 7), 1.0]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, source string, pos long, text string, v array<double>")
    asked = corpus.where("doc_id in (5, 22)").withColumn("query_id", F.col("doc_id"))
    got = {}
    for r in training.tiered_negatives(asked, corpus).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["origin"], r["doc_id"]))
    assert [d for o, d in got[5] if o == "neighbour"] and {d for o, d in got[5] if o == "neighbour"} == {3, 4, 6, 7}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    near = sorted((d for d in range(10) if d != 5), key=lambda d: (-round(cosine(rows[5][4], rows[d][4]), 9), d))
    assert [d for o, d in got[5] if o == "similar"] == [d for d in near[:5] if d not in (3, 4, 6, 7)][:2] and len(got[5]) == len(got[22]) == 6


def test_drawn_negatives(spark):
    """Against a plain walk around the circle, with a source of most rows, many copies of a text and more asked for than there is."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c"]), i, rng.choice(["same text", f"own {i}"])) for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id long, source string, pos long, text string")
    asked = corpus.where("doc_id % 10 = 3").withColumn("query_id", F.col("doc_id"))
    place = lambda key: int(hashlib.md5(f"42|{key}".encode()).hexdigest()[:13], 16)

    def plain(own, most):
        out, (_, source, pos, text) = [], rows[own]
        for d, s, p, x in rows:
            if d != own and (text := text.replace(" ", "")) not in (x := x.replace(" ", "")) and x not in text:
                gap = (place(d) - place(f"start|{own}")) % 2**52
                out.append((4, gap, "", d, "random") if s != source else (abs(p - pos), 0, hashlib.md5(f"42|{d}".encode()).hexdigest(), d, "neighbour") if abs(p - pos) <= 2 else (3, gap, "", d, "same_source"))
        return [(o, d) for *_, d, o in sorted(out)[:most]]

    for most in (6, 90, 400):
        got = {}
        for r in splits.negatives(asked, corpus, most, text="text").orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["origin"], r["doc_id"]))
        assert got == {q: plain(q, most) for q in range(3, 300, 10)}
    drawn = splits.negatives(asked.where("source = 'a'"), corpus, 200, text="text").where("origin = 'random'").groupBy("query_id").agg(F.min(F.struct("rank", "doc_id"))["doc_id"].alias("d"))
    assert drawn.select("d").distinct().count() > 1
    assert splits.negatives(asked.limit(0), corpus, 6).count() == 0


def test_positives(spark):
    facts = spark.createDataFrame([(1, "在密封与标识方面有何异同", "a/f.md", "密封圈应符合设计图样的要求。并按规定进行检验和试验工作。", 0, 1), (1, "q", "f.md", "short", 1, None), (1, "在密封与标识方面有何异同", "b/f.md", "密封圈应符合设计图样的要求。并按规定进行检验和试验工作。", 2, 1)], "query_id long, question string, source string, text string, place long, side int")
    pairs = training.positives(facts)
    assert [(r["question"].split("\n")[0], r["source"], r["place"]) for r in pairs.collect()] == [("关注：标识", "f.md", 0)]
    assert sorted(r["text"] for r in training.positive_sentences(pairs).collect()) == sorted(["密封圈应符合设计图样的要求。", "并按规定进行检验和试验工作。"])


@pytest.fixture(scope="module")
def small(spark):
    corpus = spark.createDataFrame([(i, f"HB+{8000 + i % 2}-1990.md", f"1.{i}", f"the valve number {i} should be tested with {'oil' if i % 2 else 'water'} before use in service") for i in range(12)], "doc_id long, source string, clause_id string, text string")
    asked = spark.createDataFrame([(1, "HB 8001-1990 which valve is tested with oil", "single", ["Valve"]), (2, "HB 8000-1990 and HB 8001-1990 valve water", "cross", []), (3, "zz", "correlation", [])], "query_id long, text string, kind string, names array<string>")
    triples = spark.createDataFrame([(i, f"valve {i}", "has_test", "oil", "the valve", f"HB+{8000 + i % 2}-1990.md", 0.9, f"1.{i}", f"HB {8000 + i % 2}-1990", str(i)) for i in range(12)], "triple_id long, head string, relation string, tail string, paragraph string, source string, confidence double, clause_id string, standard_id string, evidence_id string")
    return asked, corpus, triples


def test_main_method_stays_within_standards_and_budgets(small):
    asked, corpus, triples = small
    rows = methods.METHODS["clause_graph"](asked, corpus, triples_=triples).collect()
    of = {q: [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert of[1] and all(d % 2 == 1 for d in of[1]) and len(of[1]) <= 10 and len(of[2]) == len(set(of[2])) == 10 and of[3] == []
    plain = methods.METHODS["clause_graph"](asked, corpus, triples_=triples, **methods.VARIANTS["no_boost"]).where("query_id = 1").collect()
    full = {r["doc_id"]: r["score"] for r in rows if r["query_id"] == 1}
    assert all(full[r["doc_id"]] == pytest.approx(1.5 * r["score"]) for r in plain)


def test_corrective_and_reflective(small):
    asked, corpus, _ = small
    for name in ("corrective", "self_reflective"):
        rows = methods.METHODS[name](asked, corpus, k=4).collect()
        assert {r["query_id"] for r in rows} >= {1, 2} and max(r["rank"] for r in rows) <= 4
    # nothing is relevant to the third question: its passages come back as they were
    assert methods.METHODS["self_reflective"](asked, corpus, k=4).where("query_id = 3").count() == 4


def test_embedding_counts_tokens(spark):
    import hashlib

    v = spark.createDataFrame([("a b a",)], "t string").select(scoped.default_embed(F.col("t")).alias("v")).first()["v"]
    at = {c: int(hashlib.md5(c.encode()).hexdigest()[0], 16) for c in "ab"}
    assert v[at["a"]] == (3 if at["a"] == at["b"] else 2) and sum(v) == 3
