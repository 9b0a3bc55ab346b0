import pytest
from pyspark.sql import functions as F

from quillgraph.functions import questions as q


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("v")).first()["v"]



def test_standards(spark):
    text = "根据GB/T 28878.1—2012和 hb 8364 - 2013(2017)，以及HB/Z+415-2014、gb / t 28878.1-2012的要求"
    assert one(spark, q.standard_ids(F.col("x")), x=text) == ["GB/T 28878.1-2012", "HB 8364-2013(2017)", "HB/Z 415-2014"]
    assert one(spark, q.standard_keys(F.col("x")), x="按 GB/T 28878.1-2012 与 GB 1234 及 HB 8364-2013") == ["gbt:28878:1:2012", "gb1234", "hb:8364::2013"]
    assert one(spark, q.standard_keys(F.col("x")), x=None) == []
    assert one(spark, q.keys_or_of_entities(F.col("x"), F.col("e")), x="没有标准", e=["密封 HB 8364-2013", "螺栓"]) == ["hb:8364::2013"]
    assert one(spark, q.cited_standards(F.col("x")), x="HB 8364-2013; GB/T 1.1-2000; GB/T  1.1-2000; GJB 150-1986") == ["GB/T 1.1-2000", "HB 8364-2013", "GJB 150-1986"]
    assert one(spark, q.surfaces(F.col("x")), x="HB 8364-2013，HB  8364-2013；GB 1") == ["HB 8364-2013"]
    assert one(spark, q.clause_references(F.col("x")), x="HB 8364-2013 第 3.2.1 条与GB/T 1.1-2000第A1条") == [("HB 8364-2013", "3.2.1"), ("GB/T 1.1-2000", "A1")]
    assert one(spark, q.clause_form(F.col("x")), x="第 3.2.1 条。") != "" and one(spark, q.clause_form(F.col("x")), x="第 3.2.1 条") == "3.2.1"


def test_entities_of_a_question(spark):
    got = one(spark, q.grounded_entities(F.col("x"), F.col("s"), F.col("e")), x="HB 8364-2013 对密封 圈的要求", s=["HB 8364-2013"], e=["密封圈", "HB 9999-2000", "螺栓", " ", "密封 圈"])
    assert got == ["HB 8364-2013", "密封圈"]


def test_answers_get_the_questions_spelling(spark):
    rewrite = lambda question, answer: one(spark, q.with_surfaces(F.col("q"), F.col("x")), q=question, x=answer)
    question = "HB 8364-2013 与 GB/T 28878.1-2012 有何不同"
    assert rewrite(question, "{标准A}要求甲，{标准 2}要求乙；{标准…}") == "HB 8364-2013要求甲，GB/T 28878.1-2012要求乙；HB 8364-2013、GB/T 28878.1-2012"
    assert rewrite(question, "见 gbt:28878:1:2012 和 {hb:8364::2013；说明} {无关的内容文字}") == "见 GB/T 28878.1-2012 和 HB 8364-2013、说明 {无关的内容文字}"
    assert rewrite(question, "qj:123:4:2001") == "QJ 123.4-2001" and rewrite("没有标准", "{标准A}") == "{标准A}" and rewrite(question, "") == ""


def test_topics_and_dimensions(spark):
    assert one(spark, q.topic(F.col("x")), x="综合参考 HB 8364-2013，密封圈应如何安装？") == "密封圈应如何安装"
    assert one(spark, q.topic_terms(F.col("x")), x="HB 8364-2013 密封圈 要求") == ["密封圈", "密封", "封圈"]
    assert one(spark, q.dimensions(F.col("x")), x="两项标准在密封圈安装与 标识方法方面有何异同") == ["密封圈安装", "标识方法"]
    assert one(spark, q.dimensions(F.col("x")), x="A和B对传感器安装位置的要求有何不同") == ["传感器安装位置"] and one(spark, q.dimensions(F.col("x")), x="随便") == []
    both = "两项标准在密封圈安装与标识方法方面有何异同"
    assert [one(spark, q.side_topic(F.col("x"), F.lit(i)), x=both) for i in range(3)] == ["密封圈安装", "标识方法", both]
    assert one(spark, q.query_for_side(F.col("x"), F.lit(1)), x=both) == f"关注：标识方法\n{both}" and one(spark, q.query_for_side(F.col("x"), F.lit(0)), x="随便") == "随便"


@pytest.mark.parametrize("a, b, same", [("Rex Maughan", "Rex G. Maughan", True), ("Scream", "Scream 2", True), ("Rex", "Rex Maughan", False), ("Maughan", "Mr Maughan", True), ("", "x", False), ("New York", "New Jersey", False), ("Paris", "paris", True)])
def test_same_name(spark, a, b, same):
    assert one(spark, q.same_name(F.col("a"), F.col("b")), a=a, b=b) is same


def test_names(spark):
    assert one(spark, q.names(F.col("x"), F.col("e")), x="Which film did Rex Maughan see after Scream 2 and Roseanne?", e=["aloe vera", "rex maughan"]) == ["Rex Maughan", "Scream 2", "Maughan", "Scream", "Roseanne", "aloe vera"]
    assert one(spark, q.entity_form(F.col("x")), x="  hb8364 - 2013   密封 ") == "HB 8364-2013 密封" and one(spark, q.base_name(F.col("x")), x="a\\b/c.md ") == "c.md" and one(spark, q.slug(F.col("x")), x="a b/c") == "a_b_c"
    assert one(spark, q.source_list(F.col("s")), s=[" a ", "", None]) == ["a"] and one(spark, q.source_list(F.col("s")), s=[]) == ["unknown"]
    assert one(spark, q.id_list(F.col("x")), x="['a', \"b\"]") == ["a", "b"] and one(spark, q.id_list(F.col("x")), x="z_1") == ["z_1"] and one(spark, q.id_list(F.col("x")), x=None) == []
    assert one(spark, q.passage_ids(F.col("x")), x=f"see {'a' * 24}_3 and {'a' * 24}_3, {'b' * 23}_1") == ["a" * 24 + "_3"]
    assert one(spark, q.name_in(F.col("n"), F.col("x")), n="Maughan", x="rex maughan") and not one(spark, q.name_in(F.col("n"), F.col("x")), n="Rex", x="rex maughan")
