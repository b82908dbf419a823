import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import lexicon as X
from textloom.operators import prose as P

CASES = {
    "He said so. She left! Did it work?": ["He said so.", "She left!", "Did it work?"],
    "As Smith et al. reported in Fig. 3, it rose by 3.14 percent. J. Smith agreed.": ["As Smith et al. reported in Fig. 3, it rose by 3.14 percent.", "J. Smith agreed."],
    "1. Introduction text here. More.": ["1. Introduction text here.", "More."],
    "It holds for vs. this. See (e.g. here) now.": ["It holds for vs. this.", "See (e.g. here) now."],
    "这是第一句。这是第二句！！第三句……好。」第四": ["这是第一句。", "这是第二句！！", "第三句……", "好。」", "第四"],
    "值为3.14。采用K-means算法.下一句。": ["值为3.14。", "采用K-means算法.", "下一句。"],
    "Keywords: a. b. c.\nThe text starts. $x. y.$ is fine. 12. 13.\n\n$z.$ Good.": ["The text starts. $x. y.$ is fine.", "Good."],
    "": [], "   ": [], "12. 34!": [], "no stop": ["no stop"],
}


def test_sentences(spark):
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(CASES)] + [(99, None, "s")], "id int, t string, sentence string")
    got = {i: [] for i in range(len(CASES))}
    for r in P.sentence_table(d, "id", "t").orderBy("id", "sentence_index").collect():
        text = list(CASES)[r.id]
        assert text[r.start_pos : r.end_pos] == r.sentence
        got[r.id].append(r.sentence)
    assert got == dict(enumerate(CASES.values()))


def test_long_texts_are_linear(spark):
    d = spark.createDataFrame([(1, "Eins ist das. " * 20_000), (2, "(" * 5000 + "a. b" + ")" * 5000)], "id int, t string")
    assert P.sentence_table(d, "id", "t").groupBy("id").count().collect()[0]["count"] == 20_000


@pytest.mark.parametrize("sentence, n", [("因此，我们采用方法（甲，乙；丙），结果好。", 3), ("没有分隔", 1), ("，；：", 0), ("他说“一，二，三”后离开", 1), ("a, b; c: d", 4), ("", 0)])
def test_clauses(spark, sentence, n):
    assert spark.range(1).select(P.clause_count(F.lit(sentence)).alias("n")).first().n == n


def test_phrases(spark):
    one = lambda text, entries, spaced=True: spark.range(1).select(P.phrase_count(P.spaced_tokens(F.lit(text)) if spaced else F.lit(text), entries, spaced).alias("n")).first().n
    assert one("As a result of this, as a result it grew.", ["as a result", "as a result of"]) == 2
    assert one("may may may", ["may"]) == 3 and one("maybe not", ["may"]) == 0 and one("anything", []) == 0
    assert one("At least it is, at-least so", ["at least"]) == 1
    assert one("由此可见，由此", ["由此", "由此可见"], False) == 2


def test_lexicons(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "hedge", "version": "1", "entries": ["may", " may ", "", "at least"]}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "connectors", "version": "2", "groups": {"causal": ["because", "but"], "contrastive": ["but", "42"]}}))
    lexicons = X.read_lexicons(spark, {"en": str(tmp_path)})
    assert X.as_lists(lexicons) == {("en", "connectors", "causal"): ["because", "but"], ("en", "connectors", "contrastive"): ["42", "but"], ("en", "hedge", ""): ["at least", "may"]}
    assert sorted((r.problem, r.entry) for r in X.problems(lexicons).collect()) == [("in_two_groups", "but"), ("no_letter", "42"), ("versions_differ", None)]
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(Exception, match="no JSON object"):
        X.read_lexicons(spark, {"en": str(tmp_path)}).collect()


def test_adapters_are_an_extension_point(spark):
    from textloom.functions import adapters as A

    d = spark.createDataFrame([(1, "One two. Three.", "x"), (2, "这是第一句。", "x"), (3, "12", "x"), (4, None, "x")], "id int, t string, language string")
    providers = {"units": lambda a, t: a.units(t), "sentences": lambda a, t: F.size(a.sentences(t))}
    got = {(r.id, r.metric): r.value for r in A.measure(d, "id", "t", providers).collect()}
    assert got == {(1, "units"): 3, (1, "sentences"): 2, (2, "units"): 5, (2, "sentences"): 1, (3, "units"): None, (3, "sentences"): None, (4, "units"): None, (4, "sentences"): None}
    A.register("xx", A.Adapter(P.sentences, lambda s: F.length(s), lambda s, entries: F.lit(0)))
    assert A.languages() == ["en", "xx", "zh"]
    only = A.measure(d, "id", "t", {"units": providers["units"]}, detect=lambda t: F.lit("xx")).collect()
    assert {r.id: r.value for r in only} == {1: 15, 2: 6, 3: 2, 4: None}
    A._ADAPTERS.pop("xx")
