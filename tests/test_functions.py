import pytest
from pyspark.sql import functions as F

from quillgraph.functions import chunk, similarity, text
from quillgraph.operators import align, clauses, graph, identity, metrics, rank, retrieval, router, splits
from quillgraph.plans import methods, plugins
from quillgraph.sources import files


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, expected",
    [("GB/T 28878.1-2012", "gbt:28878:1:2012"), ("28878_1-2012-gbt-e-300.md", "gbt:28878:1:2012"), ("HB_Z+415-2014(2017).md", "hbz:415::2014"), ("HB 8364-2013", "hb:8364::2013"), ("GB 1234", ""), (None, ""), ("", "")],
)
def test_comparison_id(spark, name, expected):
    assert one(spark, text.comparison_id(F.col("n")), n=name) == expected


def test_same_document(spark):
    same = lambda a, b: one(spark, text.same_document(F.col("a"), F.col("b")), a=a, b=b)
    assert same("HB+8364-2013(2017).md", "HB 8364-2013.md") and not same("28878", "28878.10") and not same("", "HB 1-2000")


def test_tokens(spark):
    assert one(spark, text.mixed_tokens(F.col("x")), x="应A1 b") == ["应", "A1", "b"]
    assert one(spark, text.mixed_tokens(F.col("x")), x="。!") == ["。", "!"]
    assert one(spark, text.search_tokens(F.col("x")), x="Ab 3.2.1 应") == ["ab", "3.2.1", "应"]
    assert one(spark, text.char_ngrams(F.col("x")), x="abcdab") == ["abcd", "bcda", "cdab"]
    assert one(spark, text.char_ngrams(F.col("x")), x="abc") == ["abc"] and one(spark, text.char_ngrams(F.col("x")), x="") == []
    assert one(spark, text.compact(text.nfkc_udf(F.col("x"))), x="<b>Ａb</b> \\frac 应。1") == "ab应1"


@pytest.mark.parametrize("title, number", [("## 3.2 Range", "3.2"), ("A.1 Foo", "A.1"), ("附录B 说明", "Annex B"), ("Appendix C x", "Annex C"), ("plain", None), ("4", "4")])
def test_clause_number(spark, title, number):
    assert one(spark, text.clause_number(F.col("x")), x=title) == number


def test_quality(spark):
    assert not one(spark, text.quality_ok(F.col("x")), x="目录 第一章 范围和引用文件") and not one(spark, text.quality_ok(F.col("x")), x=None)
    assert one(spark, text.quality_ok(F.col("x")), x="零件表面粗糙度应不大于 3.2 微米,并按规定检验")
    assert one(spark, text.forward_reference(F.col("x")), x="应符合 3.2 的规定") and not one(spark, text.forward_reference(F.col("x")), x="应符合 3.2 的规定,不小于 5 mm")


def test_replies(spark):
    rows = one(spark, text.parse_triples(F.col("x")), x='<think>[x]</think> so: [{"head":{"name":"a"},"relation":"r","tail":{"name":"b"}}] end')
    assert rows[0]["head"]["name"] == "a" and rows[0]["confidence"] == 0.5
    assert one(spark, text.salvage_objects(F.col("x")), x='[{"a":1,}, {"b": [2,], "d": {"e": "}"}}, {"c"') == ['{"a":1}', '{"b": [2], "d": {"e": "}"}}']
    assert one(spark, text.router_reply(F.col("x")), x='hm {"type_id": 7, "entities": [" a ", ""]}')["type_id"] == 1
    assert one(spark, text.judge_score(F.col("x")), x="score: 0.8") == 0.8 and one(spark, text.judge_score(F.col("x")), x="none") == -1.0
    assert one(spark, text.cited_numbers(text.answer_part(F.col("x"))), x="【答案】a [2] b [3.1]【证据】1. ev [9]") == [2, 3]


def test_chunks():
    cut = chunk.running_chunks
    assert cut("", 10, 2) == [] == cut(None, 10, 2) and cut("abcdefghij", 10, 2) == ["abcdefghij"]
    assert cut("aaaaaa\r\nbbbbbb", 10, 0) == ["aaaaaa", "bbbbbb"]
    assert cut("a\nbbbbbbbbbbbbb", 10, 0)[0] == "a\nbbbbbbbb"
    # a boundary exactly at half the window counts, so do blank lines with blanks and all four marks
    assert cut("abcd\nefghijkl", 10, 0) == ["abcd", "efghijkl"] and cut("abcdef\n  \nghijklmn", 10, 0) == ["abcdef", "ghijklmn"]
    for mark in "。！？；":
        assert cut(f"abcdef{mark}  ghijklm", 10, 0) == [f"abcdef{mark}", "ghijklm"]
    assert cut("abcdefgh；    ijklmnop", 10, 3) == ["abcdefgh；", "h；", "ijklmno", "mnop"]
    # clauses: the mark itself lies in the second half, and only three marks count
    part = chunk.parts_of_clause
    assert part("abcd\nefghijkl", 10, 0) == ["abcd\nefghi", "jkl"] and part("abcde\nfghijkl", 10, 0) == ["abcde", "fghijkl"]
    assert part("abcdef！ghijklm", 10, 0) == ["abcdef！ghi", "jklm"] and part("x" * 10, 10, 2) == ["x" * 10] and part(" ", 10, 2) == []
    with pytest.raises(ValueError):
        chunk.boundary_chunks(F.lit(""), 10, 10)


def test_sentences(spark):
    def of(body):
        rows = chunk.sentences(spark.createDataFrame([(1, body)], "k long, t string"), "k", "t")
        return [r["sentence"] for r in rows.orderBy("part_index").collect()]

    assert of("这一条要求零件表面应保持清洁。第二条要求设备应定期进行检查；太短。") == ["这一条要求零件表面应保持清洁。", "第二条要求设备应定期进行检查；"]
    # clause numbers and headings begin sentences; the heading's mark goes
    assert of("651贮存条件应符合环境要求规定值652板级组件应符合安装要求规定值") == ["651贮存条件应符合环境要求规定值", "652板级组件应符合安装要求规定值"]
    assert of("这一条要求零件表面应保持清洁## 检验方法和检验规则的说明") == ["这一条要求零件表面应保持清洁", "检验方法和检验规则的说明"]
    # a formula is whole whatever it holds, and joins the sentence that announces it
    assert of("零件的效率应按公式(1)计算如下：$$\\eta = a；b\nc + 12345$$\n其余部分应符合设计图样的要求。") == ["零件的效率应按公式(1)计算如下：\n$$\\eta = a；b\nc + 12345$$", "其余部分应符合设计图样的要求。"]
    assert of("本部分应重复出现的一句说明文字。本部分应重复出现的一句说明文字。") == ["本部分应重复出现的一句说明文字。"]
    assert of("abc def; ghi jkl; mno") == ["abc def; ghi jkl; mno"] and of("short") == [] and of(None) == []
    assert of("one $$ alone stays text of its own") == ["one $$ alone stays text of its own"]


def test_matching_blocks():
    import difflib
    import random

    random.seed(3)
    for _ in range(500):
        a, b = ("".join(random.choice("abcd") for _ in range(random.randint(0, 30))) for _ in "ab")
        assert similarity.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0)
    # from 200 characters on popular ones start no block; they still lengthen one, also an empty one at the beginning
    alphabets = ["ab", "abcdefghij klmnop", "".join(chr(0x4E00 + i) for i in range(300)) + "  aaaa"]
    for k in range(400):
        a, b = ("".join(random.choice(alphabets[k % 3]) for _ in range(random.choice([1, 40, 199, 200, 201, 500]))) for _ in "ab")
        b = b[: len(b) // 2] + a[len(a) // 3 : len(a) // 3 + random.randint(0, 80)] + b[len(b) // 2 :]
        for rule in (False, True):
            want = difflib.SequenceMatcher(None, a, b, autojunk=rule).ratio()
            assert similarity.ratio(a, b, rule) == want and (similarity.ratio(a, b, rule, 0.62) >= 0.62) == (want >= 0.62)


@pytest.mark.parametrize("rule", [False, True])
def test_matching_blocks_of_long_texts(rule):
    import difflib
    import random
    import time

    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))[:n]
    a, b = text(20_000), text(20_000)
    rare = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))  # characters that aren't popular
    a, b = a[:9000] + rare + a[9000:17_000], b[:5000] + rare[:2000] + b[5000:9000] + rare[1500:] + b[9000:14_500]
    began = time.time()
    got = similarity.ratio(a, b, rule)
    assert time.time() - began < 20
    if rule:
        assert got == difflib.SequenceMatcher(None, a, b).ratio() > 0.1
    else:  # the plain way takes minutes here: shorter ones are compared, and repeats of one character stay linear
        assert similarity.ratio(a[8000:11_000], b[4000:8000]) == difflib.SequenceMatcher(None, a[8000:11_000], b[4000:8000], autojunk=False).ratio()
        assert similarity.ratio("a" * 20_000, "a" * 10_000) == 2 / 3


def test_display_id(spark):
    def of(file, body=""):
        name, year = text.display_id(F.col("f"), F.col("b"))
        r = spark.createDataFrame([(file, body)], "f string, b string").select(name.alias("n"), year.alias("y")).first()
        return r["n"], r["y"]

    assert of("28878_1-2012-gbt-e-300.md") == ("GB/T 28878.1-2012", "2012") and of("HB+8364-2013.md") == ("HB 8364-2013", "2013")
    assert of("GBT+1.1.md", "本标准代替 GB / T 1.1 － 2000") == ("GB/T 1.1-2000", "2000") and of("GJB 150 - 1986.md") == ("GJB 150-1986", "1986")


def test_alignment(spark):
    p = spark.createDataFrame([("s", 1, "abcdefgh"), ("s", 2, "zz"), ("s", 3, "qwertyui")], "source string, pid long, p_text string")
    c = spark.createDataFrame([("s", 1, "xxabcdefghyy"), ("s", 2, "bcdefg"), ("s", 3, "aazzbb"), ("s", 4, "qwertyuX"), ("s", 5, "qwertyuX")], "source string, cid long, c_text string")
    value, method = align.score(F.col("p_text"), F.col("c_text"))
    best = {r["pid"]: r for r in align.best_with_margin(align.candidates(p, c).withColumns({"score": value, "method": method}), ["source", "pid"], align.GRAPH_GATES).collect()}
    assert (best[1]["cid"], best[1]["status"], best[1]["method"]) == (1, "accepted_high", "gold_in_clause")
    assert best[2]["cid"] == 3 and (best[3]["cid"], best[3]["margin"], best[3]["status"]) == (4, 0.0, "needs_review")


def test_metrics(spark):
    got = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id long, key string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "z")], "query_id long, key string")
    rows = {r["query_id"]: r for r in metrics.at_k(got, gold, (1, 2)).collect()}
    assert rows[1]["hit_1"] == 0 and rows[1]["hit_2"] == 1 and rows[1]["precision_2"] == 0.5 and rows[1]["mrr"] == 0.5 and rows[2]["mrr"] == 0
    scores = lambda a, b: spark.range(1).select(*(c.alias(n) for n, c in metrics.set_scores(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")).items())).first()
    assert scores([], [])["f1"] == 1 and scores(["a"], [])["precision"] == 0 and scores(["a", "b"], ["a"])["recall"] == 1
    assert one(spark, metrics.answer_score(F.col("p"), F.col("g")), p="Yes, it is", g="yes") == 1.0
    assert one(spark, metrics.answer_score(F.col("p"), F.col("g")), p="", g="yes") == 0.0


def test_boost_and_budget(spark):
    b = lambda s, r, e: spark.range(1).select(rank.boosted(F.lit(s), F.lit(r).cast("double"), F.lit(e)).alias("v")).first()["v"]
    assert b(0.4, 0.0, True) == pytest.approx(0.6) and b(0.4, -1.0, True) == -1.0 and b(0.4, None, False) == 0.4


def test_fusion_ignores_channel_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    c = spark.createDataFrame([(1, 11, 1)], "query_id long, doc_id long, rank int")
    key = lambda d: sorted((r["doc_id"], round(r["score"], 12)) for r in d.collect())
    assert key(retrieval.reciprocal_rank_fusion([("a", a), ("c", c)])) == key(retrieval.reciprocal_rank_fusion([("c", c), ("a", a)]))


def test_graph_and_identity(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "head string, tail string")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, node string")
    assert {r["node"]: r["depth"] for r in graph.expand(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    rows = spark.createDataFrame([("k", "aa", 1), ("k", "aaa", 2), ("k", " ", 3)], "k string, text string, p int")
    assert [r["p"] for r in identity.keep_longest(rows, ["k"], "text", "p").collect()] == [2]


def test_clauses(spark):
    body = "# 1 Scope\nWords.\n## 1.1 Parts\nMore words here.\n2\n\nText before\n# References\nText 2\n# Annex A Notes\nend\n7\n8 Last one\n#### 652 Lost dots"
    rows = clauses.parse(spark.createDataFrame([("f.md", body)], "source string, text string")).orderBy("start_offset").collect()
    assert [r["clause_id"] for r in rows] == ["1", "1.1", "2", "Annex A", "8", "6.5.2"]
    assert [r["parse_method"] for r in rows] == ["markdown_heading", "markdown_heading", "split_number_heading", "markdown_heading", "plain_number_heading", "markdown_heading:ocr_compact_id_repaired"]
    two = spark.createDataFrame([("a/f.md", "f.md", body), ("b/f.md", "f.md", "# 1 Other\nx")], "path string, source string, text string")
    assert clauses.parse(two, key="path").groupBy("path").count().orderBy("path").collect() == [("a/f.md", 6), ("b/f.md", 1)]
    assert rows[1]["clause_path"] == ["1 Scope", "1.1 Parts"] and rows[2]["clause_title"] == "References"
    assert all(body[r["start_offset"] : r["end_offset"]].strip() == r["raw_text"] for r in rows)


def test_splits(spark):
    rows = spark.range(80).withColumn("kind", F.when(F.col("id") < 40, "a").otherwise("b"))
    out = splits.stratified_split(rows, "id", "kind", {"train": 5, "dev": 1, "test": 2})
    assert {(r["kind"], r["split"]): r["count"] for r in out.groupBy("kind", "split").count().collect()} == {(k, s): n for k in "ab" for s, n in (("train", 25), ("dev", 5), ("test", 10))}
    assert splits.overlaps(out, "id").isEmpty()


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\n\ntwo\n \nthree")
    assert [r["paragraph"] for r in files.paragraphs(files.markdown(spark, str(tmp_path))).orderBy("position").collect()] == ["one", "two", "three"]
    for body, expected in (('[{"id":"1","q":"a"},{"id":"2","q":"b"}]', {"1", "2"}), ('{"id":"7","q":"a"}', {"7"}), ('{"k1":{"q":"a"},"k2":{"q":"b"}}', {"k1", "k2"})):
        (tmp_path / "i.json").write_text(body)
        assert {r["id"] for r in files.json_items(spark, str(tmp_path / "i.json"), "id string, q string").collect()} == expected


def test_writers_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "source string, position long, status string")
    files.write_new(rows, str(tmp_path / "new"), by=["source"])
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_new(rows, str(tmp_path / "new"))
    files.write_new(rows.limit(1), str(tmp_path / "new"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "new")).count() == 1
    for _ in range(2):
        files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_alignment(rows.withColumn("status", F.when(F.col("position") == 1, "needs_review").otherwise("accepted_high")), str(tmp_path / "aligned"))
    assert spark.read.parquet(str(tmp_path / "aligned/alignments")).count() == 2 and spark.read.json(str(tmp_path / "aligned/review")).count() == 1
    edges = spark.createDataFrame([("h", "r", "t", 2), ("h", "r", "t", 1), ("h", "s", "t", 3)], "head string, relation string, tail string, position long")
    edges.write.parquet(str(tmp_path / "edges"))
    assert sorted(r["position"] for r in files.read_edges(spark, str(tmp_path / "edges")).collect()) == [1, 3]
    assert [r["position"] for r in files.last_of_each(edges, "relation", "position").orderBy("relation").collect()] == [2, 3]
    corpus = spark.createDataFrame([("e1", 1, "a"), (" ", 2, "b"), (None, 3, " ")], "evidence_id string, row_id long, text string")
    assert [r["doc_id"] for r in files.corpus(corpus).orderBy("row_id").collect()] == ["e1", "2"]


def test_plug_ins(spark):
    rows = spark.createDataFrame([(1, "the valve opens", "the valve opens at 5 mm\nsecond")], "id long, q string, t string")
    out = rows.select(plugins.embed(plugins.HashEmbedder(8), F.col("q")).alias("v"), plugins.score(plugins.OverlapScorer(), F.col("q"), F.col("t")).alias("s"), plugins.generate(plugins.FirstLineGenerator(), F.col("q"), F.col("t")).alias("a")).first()
    assert len(out["v"]) == 8 and sum(x * x for x in out["v"]) == pytest.approx(1.0) and out["s"] == 1.0
    answer = spark.createDataFrame([(out["a"],)], "a string").select(text.cited_numbers(text.answer_part(F.col("a"))).alias("n"), text.clean_answer(F.col("a")).alias("c")).first()
    assert answer["n"] == [1] and answer["c"] == "the valve opens at 5 mm"
    corpus = spark.createDataFrame([(1, "the valve opens"), (2, "nothing alike")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "valve opens")], "query_id long, text string")
    found = methods.METHODS["dense"](asked, corpus, k=1, embed=lambda c: plugins.embed(plugins.HashEmbedder(), c)).collect()
    assert [r["doc_id"] for r in found] == [1]


def test_router_learns(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), 0.01 * (i % 7)], float(i % 3)) for i in range(300)]
    out = router.train_and_predict(spark.createDataFrame(rows, "id long, v array<double>, label double"), "id", "v", "label").collect()
    assert 30 < len(out) < 90 and sum(r["label"] == r["predicted"] for r in out) >= 0.95 * len(out)


def test_sequence_ratio_in_the_score(spark):
    import difflib

    a, b = "abcdefghij" * 25, "abcdefghxj" * 25
    rows = spark.createDataFrame([("s", 1, a)], "source string, pid long, p_text string"), spark.createDataFrame([("s", 1, b), ("s", 2, "zzzz")], "source string, cid long, c_text string")
    pairs = align.candidates(*rows).withColumn("ratio", similarity.sequence_ratio("p_text", "c_text"))
    value, method = align.score(F.col("p_text"), F.col("c_text"), F.col("ratio"))
    grams = lambda s: {s[i : i + 4] for i in range(len(s) - 3)}
    both, x, y = len(grams(a) & grams(b)), len(grams(a)), len(grams(b))
    r, p = both / x, both / y
    want = 0.72 * r + 0.18 * 2 * r * p / (r + p) + 0.10 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    best = align.best_with_margin(pairs.withColumns({"score": value, "method": method}), ["source", "pid"], align.ANSWER_GATES).first()
    assert (best["cid"], best["method"]) == (1, "fuzzy") and best["score"] == pytest.approx(want)
