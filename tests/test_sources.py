"""Sources by slug, glossary files."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import adapters as ad
from quillspark.sources.files import glossary_terms


def test_adapters(spark):
    atom = spark.createDataFrame([(1, "<entry><id>http://arxiv.org/abs/2401.00001v2</id><title>On\n  A &amp; B</title></entry>")], "doc_id long, xml string")
    graph = spark.createDataFrame([('{"paperId": "x", "title": "T", "year": 2020, "externalIds": {"DOI": "10.1/a"}, "citationCount": 3}',), ('{"paperId": "y"}',)], "json string")
    out = ad.all_records({"arxiv": atom, "s2": graph})
    assert list(ad.RECORD) == out.columns
    assert {(r["source"], r["id"], r["title"], r["year"], r["doi"], r["citations"]) for r in out.collect()} == {("arXiv", "2401.00001", "On A & B", None, None, None), ("S2", "s2:x", "T", 2020, "10.1/a", 3)}
    ad.register(ad.Adapter("own", "Own", 2, lambda raw: raw.select(F.col("n").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("more").alias("extra"))))
    assert [tuple(r) for r in ad.records("own", spark.range(2).withColumnRenamed("id", "n")).collect()] == [("Own", str(i), "t", None, None, None, None) for i in range(2)]
    assert ad.adapter("own").version == 2
    with pytest.raises(KeyError, match="no source none"):
        ad.records("none", graph)


def test_glossaries(spark):
    files = {
        "a": "# mine\nterms:\n  attention: 注意力\n  'self attention': \"自 \\\"注意\\\" 力\"\n  \"a: b\": c\n  n: 5\n  yes: true\n  list: [x]\n\n  last: '最''后'\n  attention: 关注\nother: x\n  not: this\n",
        "b": "no terms", "c": "terms:\n", "d": "terms: {}\n", "e": "", "f": None,
    }
    got = {(r["path"], r["term"]): r["target"] for r in glossary_terms(spark.createDataFrame(list(files.items()), "path string, content string")).collect()}
    assert got == {("a", "attention"): "关注", ("a", "self attention"): '自 "注意" 力', ("a", "a: b"): "c", ("a", "last"): "最'后"}
