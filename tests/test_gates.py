"""Gates on model outputs, printed ids and lines, by example."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.sql import register
from quillspark.operators import gates

PROSE = "We show that the proposed method works well on many tasks and that it needs less data than earlier ones, which is of use in practice and in teaching, and above all where little is known."
CHINESE = "我们证明所提出的方法在许多任务上表现良好，并且比以前的方法需要更少的数据，这在实践和教学中都很有用。"


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    ("source", "out", "lang", "rejected"),
    [
        (PROSE, CHINESE, "zh", False), (PROSE, "", "zh", True), (PROSE, PROSE, "zh", True), (PROSE, f"{PROSE} 中文", "zh", True), (PROSE, "<think>hm", "fr", True), ("Short.", "Short.", "zh", False),
        ("[12] " + PROSE, PROSE, "zh", False), (", ".join(f"Ann Other{i}" for i in range(20)), "Ann Other", "zh", False), (CHINESE, "Nous montrons que la méthode marche bien et demande moins.", "fr", False),
        (CHINESE, CHINESE, "fr", True), (PROSE, PROSE, "ja", True), (PROSE, "これはとても役に立つ方法であることをしめします", "ja", False), (PROSE, PROSE, "ko", True),
    ],
)
def test_not_translation(spark, source, out, lang, rejected):
    assert one(spark, lambda s, o: gates.not_translation(s, o, lang), source, out) is rejected


@pytest.mark.parametrize(
    ("out", "text"),
    [("plain", "plain"), ("<think>a\nb</think> said", "said"), ("rest</think>said", "said"), ("I see. Translation: one\n- 译文：two", "two"), ("Bold: word", "word"), ("", "")],
)
def test_without_meta(spark, out, text):
    assert one(spark, gates.without_meta, out) == text


def test_titles_and_digests(spark):
    assert one(spark, lambda s, o: gates.title_translation(s, o, "zh"), "A title", "标题") and not one(spark, lambda s, o: gates.title_translation(s, o, "zh"), "A title", "a  TITLE!")
    assert not one(spark, lambda s, o: gates.title_translation(s, o, "fr"), "A ⟦f1⟧", "Un titre") and one(spark, lambda s, o: gates.title_translation(s, o, "fr"), "A ⟦f1⟧", "Un ⟦f1⟧ titre")
    assert one(spark, lambda x, c: gates.digest(x, c, "zh"), CHINESE, PROSE) and not one(spark, lambda x, c: gates.digest(x, c, "zh"), CHINESE, "前言 " + CHINESE)
    assert not one(spark, lambda x, c: gates.echoes(x, c), " ", "a") and one(spark, lambda x, c: gates.echoes(x, c), "b  c", "a b c")


def test_printed_ids(spark):
    papers = spark.createDataFrame([("p", None), ("q", "2401.00001"), ("r", "2402.00002v1"), ("s", None)], "id string, arxiv_id string")
    blocks = spark.createDataFrame([("p", 1, 2, "arXiv:2403.00003v2 [cs.CL]"), ("p", 1, 1, "see 10.1000/ab.c). and 10.1/x"), ("p", 2, 3, "arXiv:2404.00004"), ("q", 1, 1, "arXiv:2403.00003"), ("r", 1, 1, "arXiv: 2402.00002v3")], "paper_id string, page int, block_order int, text string")
    got = {r["id"]: (r["arxiv_id"], r["stamped"], r["doi"]) for r in gates.printed_ids(papers, blocks).collect()}
    assert got == {"p": ("2403.00003v2", True, "10.1000/ab.c"), "q": ("2401.00001", False, None), "r": ("2402.00002v3", False, None), "s": (None, False, None)}


def test_paragraphs(spark):
    ys = [700, 688, 676, 640, 628, 700]
    lines = spark.createDataFrame([(1, i, "line of text", 10.1 if i else 14.0, float(y), i == 0, 50.0, 60.0, 10.0) for i, y in enumerate(ys)], "doc long, block_order int, text string, size double, y double, heading boolean, x double, width double, height double")
    told = gates.paragraphs(lines, ["doc"])
    assert [r["paragraph"] for r in told.orderBy("block_order").collect()] == [1, 2, 2, 3, 3, 4]
    assert gates.body_size(lines, ["doc"]).first()["body"] == 10.0
    box = gates.boxes(told, ["doc", "paragraph"]).where("paragraph = 2").first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"], box["n"]) == (50.0, 676.0, 110.0, 698.0, 2)


def test_sql_function(spark):
    register(spark)
    assert spark.sql("SELECT inline_content_matches('a ⟦f01⟧ ^2^', '^2^ b ⟦f1⟧') AS y, inline_content_matches('a ⟦f1⟧', 'a') AS n").first() == (True, False)
