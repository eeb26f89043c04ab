"""Notes, answers and the dictionary, by example and against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions.sql import register
from quillspark.operators import dictionary as dic
from quillspark.operators import memory as tm
from quillspark.operators import notes as nt
from quillspark.operators.fingerprint import simhash
from quillspark.sources.files import ingested

NOTE = "paper_id string, title string, n long, block_id string, char_start long, char_end long, excerpt string, stamp string, text string"


def test_note_files(spark):
    rows = [("p", 'A "b" \\c', 10, "p:1:2", 0, 9, "x: {y} ## z", "2026-08-01 10:00", "first\n\n### deeper\nlast \n"), ("p", None, 2, "p:1:1", 0, 4, "line\nbreak", "2026-08-02 10:00", "")]
    files = nt.note_files(spark.createDataFrame(rows, NOTE))
    content = files.first()["content"]
    assert content.startswith('---\npaper: p\ntitle: "A \\"b\\" \\\\c"\nanchors:\n  a2: {') and "\n## a10 · 2026-08-01 10:00\n\nfirst\n" in content
    other = files.withColumn("content", F.concat("content", F.lit("\n## mine\nno entry\n\n## a3 · later\nkept")))
    broken = spark.createDataFrame([("q", "no front matter"), ("r", "---\nopen"), ("s", None), ("t", "")], "paper_id string, content string")
    got = {r["anchor_id"]: (r["stamp"], r["text"], r["anchor"] and (r["anchor"]["block_id"], r["anchor"]["excerpt"])) for r in nt.note_entries(other.unionByName(broken)).collect()}
    assert got == {"a2": ("2026-08-02 10:00", "", ("p:1:1", "line\nbreak")), "a10": ("2026-08-01 10:00", "first\n\n### deeper\nlast", ("p:1:2", "x: {y} ## z")), "a3": ("later", "kept", None)}


def test_relocated(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
    texts = {"b1": " ".join(words), "b2": " ".join(words[:-1]), "b3": "Quite  another TEXT", "b4": "quite another text", "b5": "of no relation whatever to any of these"}
    blocks = spark.createDataFrame([(p, i, k, x) for p in "pq" for k, (i, x) in enumerate(texts.items())] + [("q", "b9", 9, "only here")], "paper_id string, block_id string, block_order int, text string")
    anchors = spark.createDataFrame([("p", "same", "quite another text"), ("p", "near", " ".join([*words, "more"])), ("p", "none", "only here"), ("q", "own", "Only here"), ("z", "no paper", "quite another text"), ("p", "null", None)], "paper_id string, anchor_id string, excerpt string")
    prints = {r["doc_id"]: r["simhash"] & (1 << 64) - 1 for r in simhash(spark.createDataFrame([*texts.items(), ("asked", " ".join([*words, "more"]))], "doc_id string, text string")).collect()}
    apart = {i: (prints[i] ^ prints["asked"]).bit_count() for i in texts}
    near = min(apart, key=apart.get)
    assert apart[near] <= nt.NEAR
    got = {r["anchor_id"]: r["block_id"] for r in nt.relocated(anchors, blocks).collect()}
    assert got == {"same": "b3", "near": near, "none": None, "own": "b9", "no paper": None, "null": None}


def test_numbers_and_lists(spark):
    notes = spark.createDataFrame([("p", n, f"2026-08-0{n % 3 + 1}", f"t{n}", "e") for n in (1, 2, 4, 7)] + [("q", 2, "2026-08-01", "t", "e")], "paper_id string, n long, stamp string, text string, excerpt string")
    new = spark.createDataFrame([("p", at, f"new{at}") for at in range(5)] + [("q", 3, "a"), ("q", 4, "b"), ("r", 1, "c"), ("r", 1, "d")], "paper_id string, at int, what string")
    got = sorted((r["paper_id"], r["n"]) for r in nt.numbered(notes, new).collect())
    assert got == [("p", 3), ("p", 5), ("p", 6), ("p", 8), ("p", 9), ("q", 1), ("q", 3), ("r", 1), ("r", 2)]
    assert [r["n"] for r in nt.removed(notes, notes.where("n = 2")).where("paper_id = 'p'").orderBy("n").collect()] == [1, 4, 7]
    assert [r["n"] for r in nt.newest(notes.where("paper_id = 'p'")).orderBy("place").collect()] == [2, 7, 4, 1]
    papers = spark.createDataFrame([("p", "P", 5, None), ("q", "Q", 1, 9)], "id string, title string, added_at long, last_opened_at long")
    assert [(r["title"], r["text"]) for r in nt.listing(notes, papers, 3).orderBy("place").collect()] == [("Q", "t"), ("P", "t2"), ("P", "t7")]
    assert nt.listing(notes.where("paper_id = 'q'"), papers).count() == 0
    assert nt.numbered(notes, new.limit(0)).count() == 0


def test_answers(spark):
    said = spark.createDataFrame([(1, "talk\n【1】 one\ngoes on\n\n【2】\n【3】three 【4】 no\n【1】 again"), (2, ""), (3, None)], "k int, text string")
    assert {(r["n"], r["text"]) for r in tm.batch_answers(said, ["k"]).collect()} == {(1, "again"), (3, "three 【4】 no")}
    lines = spark.createDataFrame([(1, "Titles:\n1) One \n 2、 Two\n3 Three\n4） \n5. Five")], "k int, text string")
    assert {(r["n"], r["text"]) for r in tm.outline_answers(lines, ["k"]).collect()} == {(1, "One"), (2, "Two"), (5, "Five")}


def test_units(spark):
    parts = spark.createDataFrame([(1, 2, "b ⟦f2⟧ ⟦f1⟧"), (1, 1, "a ⟦f3⟧"), (1, 3, ""), (1, 4, "c ⟦f1⟧"), (2, 1, "alone")], "k int, block_order int, text string")
    assert {r["k"]: r["text"] for r in tm.joined_units(parts, ["k"]).collect()} == {1: "a ⟦f3⟧ ⟦pb⟧ b ⟦f5⟧ ⟦f4⟧ ⟦pb⟧  ⟦pb⟧ c ⟦f6⟧", 2: "alone"}


@pytest.mark.parametrize(("text", "told"), [("a ⟦f1⟧ b ⟦f02⟧⟦f3⟧", "a x b ⟦f1⟧"), ("⟦f1⟧", "x"), ("none", "none"), ("", "")])
def test_restored(spark, text, told):
    df = spark.createDataFrame([(text, {1: "x", 2: "⟦f1⟧"})], "t string, f map<int,string>")
    assert df.select(tm.restored(F.col("t"), F.col("f"))).first()[0] == told


def test_dictionary(spark):
    entry = "word string, phonetic string, translation string, frq long, bnc long, collins long, oxford long, tag string, seq long"
    rows = [
        ("running", "r", "n. old", 5, None, 0, 0, "", 1), ("running", None, "n. new", 5, None, 0, 0, "", 2), ("run", "", "v. run", None, None, None, None, None, 3), ("occur", "", "v.", 0, 9, 0, 0, "", 4),
        ("model", "", "n.", 0, 0, 0, 1, None, 5), ("rarest", "", "adj.", 250_001, 0, 0, 0, "", 6), ("began", "", "begin的过去式", 0, 0, 0, 0, "", 7), ("two words", "", "x", 1, 1, 1, 1, "t", 8),
        ("Paris", "", "x", 1, 1, 1, 1, "t", 9), ("silent", "", "", 1, 1, 1, 1, "t", 10), ("city", "", "n.", 1, 0, 0, 0, "", 11), ("a" * 25, "", "x", 1, 1, 1, 1, "t", 12),
    ]
    kept = dic.trimmed(spark.createDataFrame(rows, entry))
    assert {r["word"]: r["translation"] for r in kept.collect()} == {"running": "n. new", "run": "v. run", "occur": "v.", "model": "n.", "began": "begin的过去式", "city": "n."}
    asked = spark.createDataFrame([(w,) for w in ("Running ", "runs", "occurred", "unmodel", "models", "cities", "cities", "rarest", "x1", "", None, "un")], "term string")
    got = {r["term"]: r["word"] for r in dic.looked_up(asked, kept).collect()}
    assert got == {"Running ": "running", "runs": "run", "occurred": "occur", "unmodel": "model", "models": "model", "cities": "city"}


def test_ingested(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF one", "b.PDF": b"%PDF one", "c.pdf": b"%PDF two", "d.txt": b"%PDF six", "f.pdf": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    known = spark.createDataFrame([(hashlib.sha1(b"%PDF two").hexdigest(),)], "id string")
    read = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    new, failed = ingested(read.unionByName(spark.createDataFrame([("/e.pdf", bytearray()), ("/g.pdf", None)], "path string, content binary")), known)
    assert [(r["id"], r["path"][-5:], r["length"]) for r in new.collect()] == [(hashlib.sha1(b"%PDF one").hexdigest(), "a.pdf", 8)]
    assert {(r["path"][-5:], r["reason"]) for r in failed.collect()} == {("e.pdf", "empty"), ("g.pdf", "empty"), ("f.pdf", "not a PDF")}


def test_words_in_sql(spark):
    register(spark)
    rows = spark.sql("SELECT k, place, word FROM VALUES (1, 'Aug- mented 中文'), (2, ''), (3, NULL) t(k, x), LATERAL text_words(x)").collect()
    assert sorted(rows) == [(1, 0, "augmented"), (1, 1, "中"), (1, 2, "文")]


def test_anchors_in_block_form(spark):
    """Files as YAML writers lay them out: parts on lines of their own, long values folded, quotes where they are needed."""
    content = """---
paper: p
title: Some title
anchors:
  a1:
    block_id: p:1:2
    char_start: 4
    char_end: 90
    simhash: 00ff
    excerpt: a plain text that goes
      on over a line
  a2:
    block_id: "p:1:3"
    char_start: 0
    char_end: 7
    excerpt: "quoted: \\"with\\" \\
      signs and é"
  a3:
    block_id: p:1:4
    char_start: 0
    char_end: 7
    excerpt: 'it''s single'
  a4:
    block_id: p:1:5
    char_start: 1
    char_end: 2
    excerpt: |-
      two
      lines
  a5:
    block_id: p:1:6
    char_start: 1
    char_end: 2
    excerpt: >-
      one folded
      line
highlights: {}
---

## a1 · 2026-08-01 10:00

one

## a2 · s
two
## a3 · s
## a4 · s
## a5 · s
## a6 · s
"""
    rows = nt.note_entries(spark.createDataFrame([("p", content)], "paper_id string, content string")).collect()
    got = {r["anchor_id"]: r["anchor"] and (r["anchor"]["block_id"], r["anchor"]["char_start"], r["anchor"]["char_end"], r["anchor"]["excerpt"]) for r in rows}
    assert got == {
        "a1": ("p:1:2", 4, 90, "a plain text that goes on over a line"), "a2": ("p:1:3", 0, 7, 'quoted: "with" signs and é'), "a3": ("p:1:4", 0, 7, "it's single"),
        "a4": ("p:1:5", 1, 2, "two\nlines"), "a5": ("p:1:6", 1, 2, "one folded line"), "a6": None,
    }
