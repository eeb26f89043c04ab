"""Units cut back, results applied, contexts chosen: by example and against plain versions."""

import math
import random
import re

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import fixed
from quillspark.operators import context as cx
from quillspark.operators import memory as tm
from quillspark.operators import units as un

PARTS = "unit string, block_order long, text string"


def proportional(parts, out):
    total, pieces, start, acc = sum(map(len, parts)) or 1, [], 0, 0
    for p in parts[:-1]:
        acc += len(p)
        target, near = math.floor(acc / total * len(out) + 0.5), max(8, math.floor(len(out) * 0.15 + 0.5))
        stops = [i for i in range(max(start + 1, target - near), min(len(out) - 1, target + near) + 1) if out[i - 1] in fixed.CUT_SIGNS]
        cut = min(max(min(stops, key=lambda i: abs(i - target), default=target), start + 1), len(out))
        pieces.append(out[start:cut])
        start = cut
    return [*pieces, out[start:]]


def test_proportional_cuts(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice(["ab ", "译文", "word, ", "end. ", "x;", "？", "long"]) for _ in range(n))
    units = {str(i): ([prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))], prose(rng.randint(1, 60))) for i in range(300)}
    units |= {"marks": (["one", "two", "three"], "eins【pb】zwei [[ PB ]] drei"), "few": (["a" * 20, "b" * 20], "only one"), "many": (["aaaa", "bbbb"], "x ⟦pb⟧ y ⟦pb⟧ z, and more")}
    parts = spark.createDataFrame([(u, k * 3, p) for u, (ps, _) in units.items() for k, p in enumerate(ps)], PARTS)
    answers = spark.createDataFrame([(u, out) for u, (_, out) in units.items()] + [("none", "x"), ("0", None)], "unit string, text string")
    got: dict = {}
    for r in un.split_units(parts, answers, ["unit"]).orderBy("block_order").collect():
        got.setdefault(r["unit"], []).append((r["text"], r["reason"]))
    want = {}
    for u, (ps, out) in units.items():
        pieces = re.split(fixed.PART_BREAK, out)
        pieces = [p.strip() for p in (pieces if len(pieces) == len(ps) else proportional(ps, re.sub(fixed.PART_BREAK, " ", out)))]
        want[u] = [(p, None) for p in pieces] if all(pieces) else [(None, "blank")] * len(ps)
    assert got == want
    assert [t for t, _ in got["marks"]] == ["eins", "zwei", "drei"] and sum(x[0][1] is None for x in got.values()) > 150


def test_placeholders_come_back(spark):
    rows = [("u", 1, "a ⟦f1⟧ b ⟦f2⟧"), ("u", 2, "c ⟦f1⟧ x^2^."), ("v", 1, "a ⟦f1⟧."), ("v", 2, "b")]
    parts = spark.createDataFrame(rows, PARTS)
    joined = {r["unit"]: r["text"] for r in tm.joined_units(parts, ["unit"]).collect()}
    assert joined["u"] == "a ⟦f1⟧ b ⟦f2⟧ ⟦pb⟧ c ⟦f3⟧ x^2^."
    cut = lambda u, text: [(r["text"], r["reason"]) for r in un.split_units(parts, spark.createDataFrame([(u, text)], "unit string, text string"), ["unit"]).orderBy("block_order").collect()]
    assert cut("u", joined["u"]) == [("a ⟦f1⟧ b ⟦f2⟧", None), ("c ⟦f1⟧ x^2^.", None)]
    assert cut("u", "A ⟦f2⟧ ⟦f3⟧ B ⟦f1⟧ ⟦pb⟧ C.") == [("A ⟦f2⟧  B ⟦f1⟧", None), ("C⟦f1⟧^2^.", None)]
    assert cut("v", "x ⟦pb⟧  ") == [(None, "blank"), (None, "blank")]


def test_applied(spark):
    long = "This is a long paragraph of plain English prose that a translation into Chinese must not leave as it is, because nobody would then have read anything new at all in it."
    chinese = "这是一个很长的段落，翻译成中文以后不应该保持原样，否则没有人会从中读到任何新的内容。" * 2
    parts = spark.createDataFrame([
        ("one", "b1", 1, long, True), ("same", "b2", 2, long, True), ("mark", "b3", 3, long + " ⟦f1⟧.", True), ("blank", "b4", 4, "X. Y. ABC", True), ("empty", "b5", 5, long, True), ("gone", "b6", 6, long, False),
        ("two", "b7", 7, long, True), ("two", "b8", 8, long, True), ("half", "b9", 9, long, True), ("half", "b10", 10, long, True), ("never", "b11", 11, long, True),
    ], "unit string, block_id string, block_order long, text string, known boolean")
    results = spark.createDataFrame([
        ("one", f"<think>hm</think>译文：{chinese}", "m"), ("same", long, "m"), ("mark", chinese, "m"), ("blank", " ", "m"), ("empty", "", "m"), ("gone", chinese, "m"), ("two", f"{chinese} ⟦pb⟧ {chinese}", "m"), ("half", f"{chinese} ⟦pb⟧ {long}", "m"),
    ], "unit string, text string, model string").withColumns({"provider": F.lit("p"), "input_tokens": F.lit(3), "output_tokens": F.lit(4)})
    terms = spark.createDataFrame([("b", "乙"), ("a", "甲")], "term string, target string")
    asked = un.prompts(parts.select("block_id", "block_order", "text", F.lit(1).alias("doc_id"), F.lit("para").alias("kind")), terms, "Translate.", "Terms:", "zh")
    first = asked.orderBy("block_id").first()
    assert first["system"] == "Translate.\n\nTerms:\na => 甲\nb => 乙" and first["user"] == f"【本段】{long}\n\n【下文】{long}"
    assert un.prompts(parts.select("block_id", "block_order", "text", F.lit(1).alias("doc_id"), F.lit("para").alias("kind")), terms.limit(0), "T", "x", "zh").first()["system"] == "T"
    out, paid = un.translated(parts, asked, lambda asked: results, "zh")
    got = {r["block_id"]: (r["text"], r["model"], r["reason"]) for r in out.collect()}
    assert got == {
        "b1": (chinese, "m", None), "b2": (None, "m", "untranslated"), "b3": (chinese[:-1] + "⟦f1⟧。", "m", None), "b4": ("X. Y. ABC", "identity", None), "b5": (None, "m", "untranslated"),
        "b7": (chinese, "m", None), "b8": (chinese, "m", None), "b9": (None, "m", "untranslated"), "b10": (None, "m", "untranslated"),
    }
    assert paid.count() == 8 and paid.agg(F.sum("input_tokens")).first()[0] == 24


def choose(question, blocks, hits, said, broad):
    """The same choice, one question after another; ``blocks`` in reading order as (id, page, order, kind, section, text)."""
    def leads():
        out, used, seen = [], 0, set()
        for b in blocks:
            if b[3] == "para" and b[4] and b[4] not in seen and len(b[5]) >= 40:
                if used + len(b[5]) > 6000:
                    break
                seen.add(b[4])
                out.append(b)
                used += len(b[5])
        return out

    by_id = {b[0]: b for b in blocks}
    if question["whole"]:
        found, strong = leads(), True
    else:
        translated = [b for b in blocks if b[0] in said]
        found = (translated + [by_id[h] for h in hits if h not in said])[:8]
        strong = bool(hits) or any(s >= 3 for s in said.values())
        if broad or not strong or not any(b[3] == "para" and len(b[5]) >= 40 for b in found):
            found = (found + [b for b in leads() if b not in found])[:14]
    if not found or (not strong and len(found) < 3):
        paras = [b for b in blocks if b[3] == "para"]
        rich = [b for b in paras if len(b[5]) > 120]
        pool = rich if len(rich) >= 5 else paras
        step = max(1, len(pool) // 5)
        found = found + [b for i, b in enumerate(pool) if i % step == 0 and b not in found][:5]
    return [b[0] for b in sorted(found, key=lambda b: (b[1], b[2]))]


def test_chosen(spark):
    rng = random.Random(7)
    papers, questions, hits, said = {}, [], [], []
    for p in range(25):
        sections = rng.choice([[None], ["A", "B", "C", "D", "E"], [f"s{i}" for i in range(20)]])
        papers[f"p{p}"] = [(f"p{p}:{i}", i // 8, i, rng.choice(["para", "para", "para", "heading", "figure"]), rng.choice(sections), "t" * rng.choice([10, 39, 40, 100, 121, 900])) for i in range(rng.randint(0, 60))]
        for q in range(6):
            qid, blocks = f"p{p}q{q}", papers[f"p{p}"]
            questions.append({"question_id": qid, "paper_id": f"p{p}", "question": rng.choice(["What is the main idea?", "How many layers", "第三层"]), "whole": q == 5})
            some = rng.sample(blocks, min(len(blocks), rng.choice([0, 0, 1, 3, 12])))
            hits += [(qid, b[0], i + 1) for i, b in enumerate(some[:8])]
            more = rng.sample(blocks, min(len(blocks), rng.choice([0, 0, 1, 2, 8])))
            said += [(qid, b[0], rng.choice([1, 2, 3])) for b in more]
    table = spark.createDataFrame([(p, *b) for p, bs in papers.items() for b in bs], "paper_id string, block_id string, page int, block_order long, kind string, section string, text string")
    asked = spark.createDataFrame(questions, "question_id string, paper_id string, question string, whole boolean")
    ranked, scored = spark.createDataFrame(hits, "question_id string, block_id string, rank int"), spark.createDataFrame(said, "question_id string, block_id string, score int")
    out = cx.chosen(asked, table, ranked, scored)
    got: dict = {}
    for r in out.orderBy("place").collect():
        got.setdefault(r["question_id"], []).append(r["block_id"])
    want = {}
    for q in questions:
        ids = choose(q, papers[q["paper_id"]], [] if q["whole"] else [b for i, b, _ in hits if i == q["question_id"]], {} if q["whole"] else {b: s for i, b, s in said if i == q["question_id"]}, "main idea" in q["question"])
        if ids:
            want[q["question_id"]] = ids
    assert got == want
    titles = spark.createDataFrame([("p0", "Title")], "id string, title string")
    shown = {r["question_id"]: r["context"] for r in cx.contexts(out, asked, table, titles).collect()}
    assert len(shown) == len(questions)
    q = next(x["question_id"] for x in questions if x["question_id"] in want and x["whole"])
    lines = shown[q].split("\n")
    assert lines[0] == ("《Title》" if q.startswith("p0q") else "《》") and "论文各节开头（按目录顺序）：" in lines and sum(x.startswith("[B") for x in lines) == len(want[q])


def test_marks_are_taken_out_only_where_they_dont_fit(spark):
    """Each answer used to be read for marks once more, to be cut without them."""
    parts = spark.createDataFrame([("u", i, f"one two {i}") for i in range(2)] + [("v", i, "one two, three four") for i in range(2)], "unit string, block_order long, text string")
    answers = spark.createDataFrame([("u", " eins \u2028\x0b ⟦pb⟧ zwei\n"), ("v", "eins zwei, [PB] drei [pb] vier")], "unit string, text string")
    made = un.split_units(parts, answers, ["unit"])
    told = sorted((r["unit"], r["block_order"], r["text"], r["reason"]) for r in made.collect())
    assert told[:2] == [("u", 0, "eins \u2028", None), ("u", 1, "zwei", None)] and [r[2] for r in told[2:]] == ["eins zwei,", "drei vier"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.split("\n") if " AS plain" in line] and all("CASE WHEN" in x.split("regexp_replace(out")[0][-200:] for x in plan.split("\n") if " AS plain" in x)


def test_inline_signs_and_none(spark):
    rows = [(None, "a"), ("a", None), ("a", "b"), ("a ^2^", "b"), ("^2^ ⟦f1⟧", "⟦f01⟧ ^2^"), ("~", "x"), (None, "^"), ("⟦f", "y")]
    made = spark.createDataFrame(rows, "a string, b string").select(tx.preserves_inline(F.col("a"), F.col("b")).alias("p"), tm.placeholder_numbers(F.col("a")).alias("n"))
    assert [(r["p"], r["n"]) for r in made.collect()] == [(None, None), (None, []), (True, []), (False, []), (True, [1]), (True, []), (None, None), (True, [])]
