"""The engine's operators on literal rows, and a few registered queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import plans
from quillspark.functions import text as tx
from quillspark.operators import biblio, fingerprint, library, memory, retrieval, structure

SF = "/root/testdata/sf0.001"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "lang"),
    [
        ("we show that the model is good on all of these tasks et al. 2017", "en"), ("der Hund und die Katze ist nicht mit dem Ball auf der Wiese", "de"),
        ("le chat est dans la maison avec les enfants et une table", "fr"), ("el perro y los gatos en la casa para una fiesta", "es"),
        ("我们提出了一个新的模型 Transformer", "zh"), ("これはペンです。それは本です。", "ja"), ("한국어 문장입니다", "ko"), ("", "en"),
    ],
)
def test_language(spark, text, lang):
    assert one(spark, tx.text_language, text) == lang


def test_reference_entries_are_skipped(spark):
    entry = "Ehsan Hosseini-Asl, Bryan McCann, and Richard Socher. A simple language model. arXiv preprint, 2020."
    assert one(spark, tx.reference_entry, entry) and one(spark, lambda c: tx.skip_translation(c, "zh"), entry)
    assert not one(spark, tx.reference_entry, "We study how the models learn in 2020.")


def fnv(text):
    h = fingerprint.FNV_OFFSET
    for c in text:
        h = (h ^ ord(c)) * fingerprint.FNV_PRIME % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def test_fnv_and_simhash(spark):
    rows = [("",), ("a",), ("augmented reality",), ("模型",)]
    got = {r["w"]: r["h"] for r in spark.createDataFrame(rows, "w string").select("w", fingerprint.fnv1a64("w").alias("h")).collect()}
    assert got == {w: fnv(w) for (w,) in rows}
    docs = spark.createDataFrame([(1, "aug- mented reality"), (2, "augmented reality"), (3, "--"), (4, None)], "doc_id long, text string")
    prints = {r["doc_id"]: (r["simhash"], r["has_features"]) for r in fingerprint.simhash(docs).collect()}
    assert prints[1] == prints[2] and prints[3] == (0, False) == prints[4]


def test_near_hashes_equal_brute_force(spark):
    import random

    random.seed(5)
    base = [random.getrandbits(63) for _ in range(30)]
    values = {b ^ sum(1 << i for i in random.sample(range(63), k)) for b in base for k in (0, 2, 5, 6, 7)}
    got = {tuple(r) for r in fingerprint.hashes_within(spark.createDataFrame([(v,) for v in values], "simhash long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 6}


def test_inline_content_and_repair(spark):
    rows = [("a ⟦f1⟧ b^2^.", "x ⟦f1⟧ y^2^."), ("a ⟦f1⟧.", "x."), ("a.", "x ⟦f7⟧.")]
    df = spark.createDataFrame(rows, "s string, t string")
    out = [tuple(r) for r in df.select(tx.preserves_inline(F.col("s"), F.col("t")), memory.repaired(F.col("s"), F.col("t"))).collect()]
    assert out == [(True, "x ⟦f1⟧ y^2^."), (False, "x⟦f1⟧."), (False, "x .")]


def test_batches_respect_both_limits(spark):
    sizes = [1000, 1000, 1000, 10, 10, 10, 10, 10, 10, 10, 5000, 1]
    rows = [(1, i, "x" * n) for i, n in enumerate(sizes)]
    got = [r["batch"] for r in structure.batches(spark.createDataFrame(rows, "doc_id long, block_order long, text string")).orderBy("block_order").collect()]
    assert got == [0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 3, 4]


def test_chain_goes_over_a_figure_and_a_page(spark):
    open_ = "this paragraph has several ordinary lower case words but it does not end"
    rows = [(1, 0, 1, "heading", "Intro"), (1, 1, 1, "para", open_), (1, 2, 1, "figure", "fig"), (1, 3, 1, "para", "and goes on."), (1, 4, 2, "para", "Other text."), (1, 5, 2, "para", "more")]
    got = {r["block_order"]: r["chain"] for r in structure.chains(spark.createDataFrame(rows, "doc_id long, block_order long, page long, kind string, text string")).collect()}
    assert got == {1: 1, 3: 1, 4: 4, 5: 5}


def test_abstract_and_merge(spark):
    df = spark.createDataFrame([({"deep": [0, 5000], "models": [1], "nets": [1]},)], "m map<string,array<int>>")
    assert df.select(biblio.abstract(F.col("m"))).first()[0] == "deep nets"
    records = spark.createDataFrame([(1, "S2", "T", "10.1/A", None, None, None), (2, "arXiv", "T", "10.1/a", "2401.1", 2020, 7)], "rec_id long, source string, title string, doi string, arxiv_id string, year int, citations long")
    found = biblio.merged(records, biblio.linked(records)).collect()
    assert [(r["rec_id"], r["year"], r["citations"], r["sources"]) for r in found] == [(2, 2020, 7, "arXiv+S2")]


def test_cjk_terms_and_citations(spark):
    df = spark.createDataFrame([("核心贡献是什么",)], "q string")
    terms = df.select(retrieval.cjk_terms(F.col("q"), "的了是在和与有这那什么")).first()[0]
    assert terms[:2] == ["核心", "心贡"] and "什么" not in terms
    answers = spark.createDataFrame([(1, "see [B2], [B1] and [B2], [B9]")], "id long, text string")
    targets = spark.createDataFrame([(1, "B1"), (1, "B2")], "id long, marker string")
    assert [r["marker"] for r in retrieval.citations(answers, targets, ["id"]).orderBy("position").collect()] == ["B2", "B1"]


def test_upserts_keep_hand_edits_and_first_times(spark):
    kind = "id string, title string, year int, status string, added_at long, meta_edited boolean"
    old = spark.createDataFrame([("a", "mine", 2000, "done", 1, True), ("b", "old", None, "new", 2, False)], kind)
    new = spark.createDataFrame([("a", "theirs", 2001, 9), ("b", "fresh", None, 9), ("c", "c", 2002, 9)], "id string, title string, year int, added_at long")
    got = {r["id"]: (r["title"], r["year"], r["added_at"]) for r in library.upsert_papers(old, new).collect()}
    assert got == {"a": ("mine", 2001, 1), "b": ("fresh", None, 2), "c": ("c", 2002, 9)}


@pytest.mark.parametrize("name", ["flt1_search", "agg5_tag_counts", "tm4_coverage", "bib9_in_library", "str5_idle_sessions", "use6_estimates"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    wanted = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(str(v)[:19] for v in r)) for r in rows)
    assert plain(got.select(columns).collect()) == plain(wanted)
