"""Rules on chunks as streams: results of many small batches are those of the table."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import memory as tm
from quillspark.streaming import answers as ans

ANSWERS = {
    1: "Hello <think>one\n</think>there <thin air> <think>two</think>!", 2: "Well\n【1】 a <b\n【2】\n【3】x 【4】 y\nz\n【12】 last", 3: "<think>never closed 【1】", 4: "", 5: "【1】 one\n【2】 two<", 6: "</think> stray <think",
}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    rng, rows = random.Random(3), []
    for key, text in ANSWERS.items():
        at = seq = 0
        while at < len(text) or seq == 0:
            size = rng.randint(1, 9)
            rows.append((key, seq, text[at : at + size], at + size >= len(text)))
            at, seq = at + size, seq + 1
    folder = tmp_path_factory.mktemp("chunks")
    schema = "key long, seq long, chunk string, last boolean"
    rows.sort(key=lambda r: r[1])
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    out = {}
    for name, rule in (("text", ans.without_thinking), ("parts", ans.finished_parts)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = rule(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path_factory.mktemp(name))).trigger(availableNow=True).start()
        query.awaitTermination(90)
        out[name] = spark.table(name).collect()
    return spark.createDataFrame(rows, schema), out


def test_thinking(results):
    chunks, out = results
    streamed = {k: "".join(r["text"] for r in sorted(out["text"], key=lambda r: r["seq"]) if r["key"] == k) for k in ANSWERS}
    assert streamed == {r["key"]: r["text"] for r in ans.whole_answers(chunks).collect()}
    assert streamed[1] == "Hello there <thin air> !" and streamed[3] == "" and streamed[6] == "</think> stray <think"


def test_parts(results):
    _, out = results
    assert sorted((r["key"], r["n"], r["text"]) for r in out["parts"]) == [(2, 1, "a <b"), (2, 3, "x 【4】 y\nz"), (2, 12, "last"), (5, 1, "one"), (5, 2, "two<")]


def test_parts_of_tables(results):
    chunks, out = results
    assert {(r["key"], r["n"], r["text"]) for r in ans.whole_parts(chunks).collect()} == {(r["key"], r["n"], r["text"]) for r in out["parts"]}


@pytest.mark.parametrize(
    ("source", "out", "want"),
    [("a^1^ b^1^ c~i~", "x^1^ y^2^ z.", "x^1^ y2 z^1^~i~."), ("a", "x^1^^1^", "x11"), ("a^1^", "x^1^^1^！ ", "x^1^1！ "), ("a^1^", "", "^1^"), ("a", "x", "x")],
)
def test_marks(spark, source, out, want):
    assert spark.createDataFrame([(source, out)], "s string, o string").select(tm.repaired_marks(F.col("s"), F.col("o"))).first()[0] == want
