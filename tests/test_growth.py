"""Steps whose work is to grow no faster than their input: what a plan joins by, sorts and shuffles."""

import re

from pyspark.sql import functions as F

from quillspark.operators import biblio as bib
from quillspark.operators import memory as tm
from quillspark.operators import retrieval as ret
from quillspark.operators import selections as sl
from quillspark.plans import QUERIES

BLOCKS = "block_id string, paper_id string, text string NOT NULL"
SAID = "block_id string, glossary_version int, prompt_version int, text string, created_at long"


def nodes(df, kind):
    """The lines of the plan of ``df`` that are of a kind."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if re.match(rf"[ :+\-|]*(\*\(\d+\) )?{kind}", line)]


def joined(df):
    """The most rows that a join of ``df`` gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if "Join" in name:
                most = max(most, p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def shuffled(df):
    """The names of all columns that are shuffled for ``df``."""
    df.collect()
    todo, names = [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if name == "Exchange":
                names |= {p.output().apply(i).name() for i in range(p.output().size())}
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return names


def test_titles_of_many_copies(spark):
    """Copies of a paper and of a record are not multiplied with one another."""
    papers = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("One Title").alias("title"))
    first = papers.select("id", F.concat("title", F.lit(" by A. Somebody")).alias("text"))
    records = spark.range(300).select(F.col("id").alias("rec_id"), F.lit("one title").alias("title"), F.array(F.when(F.col("id") % 2 == 1, "Somebody").otherwise("Nobody Else")).alias("authors"))
    made = bib.title_hits(papers, first, records)
    assert {(r["id"], r["rec_id"]) for r in made.collect()} == {(str(i), 1) for i in range(300)}
    assert joined(made) <= 600


def test_ranges_are_no_join_condition(spark):
    """A highlight's range is made once for it, not in the condition of the join."""
    blocks = spark.createDataFrame([("a", "p", "Take 12 apples and 30 pears. Then rest.")], BLOCKS)
    marked = spark.createDataFrame([("a", 1, 5, 14, ""), ("a", 2, 0, 4, "nimm")], "block_id string, id int, char_start int, char_end int, excerpt string")
    made = sl.projected(marked, blocks, spark.createDataFrame([("a", "nimm 12 Birnen und 30 Apfel, 12 mal")], "block_id string, text string"))
    assert {(r["id"], r["stage"]) for r in made.collect()} == {(1, "tokens"), (2, "excerpt")}
    joins = nodes(made, "SortMergeJoin")
    assert joins and not any("position" in line for line in joins)


def keyed_by_patterns(df):
    return [line for kind in ("Sort ", "Exchange") for line in nodes(df, kind) if "regexp" in line]


def test_inline_content_is_no_key(spark):
    """Sorts compare keys again and again, so what is made of a text by patterns is none."""
    blocks = spark.createDataFrame([("a", "p", "x ⟦f1⟧ ^2^"), ("b", "p", "y ⟦f1⟧"), ("c", "p", "z")], BLOCKS)
    said = spark.createDataFrame([("a", 1, 1, "⟦f1⟧ q ^2^", 1), ("a", 2, 1, "⟦f1⟧", 2), ("b", 1, 1, "⟦f2⟧", 1), ("c", 1, 1, "z", 3)], SAID)
    made = tm.latest(said, blocks)
    assert {(r["block_id"], r["created_at"]) for r in made.collect()} == {("a", 1), ("c", 3)}
    assert nodes(made, "SortMergeJoin") and not keyed_by_patterns(made)


def test_migration_keys(spark):
    blocks = spark.createDataFrame([("a", "p", "x ⟦f1⟧ ^2^"), ("b", "p", "y ⟦f1⟧"), ("c", "p", "z")], BLOCKS)
    said = spark.createDataFrame([("a", 1, 1, "⟦f1⟧ q ^2^", 1), ("b", 1, 1, "⟦f2⟧", 1), ("c", 1, 1, "z", 3)], SAID)
    made = tm.migrate(said, blocks, blocks.withColumn("block_id", F.concat("block_id", F.lit("2"))))
    assert {(r["old_id"], r["block_id"], r["rule"]) for r in made.collect()} == {("a", "a2", 1), ("c", "c2", 1)}
    assert nodes(made, "SortMergeJoin") and not keyed_by_patterns(made)


def test_migration_shuffles_no_texts(spark):
    """Digests and inline content are shuffled, not texts; numbers of placeholders have any size."""
    old = [("a", "one"), ("b", "two"), ("c", "two"), ("d", "three"), ("e", None), ("g", "gone"), ("i", "moved ^2^"), ("j", "moved ^2^"), ("k", "⟦f099999999999⟧"), ("l", "lost ⟦f1⟧")]
    new = [("d", "one"), ("b", "two"), ("c", "two"), ("x", None), ("h", "moved ^2^")]
    said = [("a", "eins"), ("b", "zwei"), ("c", "zwei ~q~"), ("d", "drei"), ("e", ""), ("g", "weg"), ("j", "bewegt ^2^"), ("i", "^2^"), ("k", "⟦f99999999999⟧"), ("l", "weg"), ("m", "herrenlos")]
    old, new = (spark.createDataFrame([(i, "p", text) for i, text in rows], "block_id string, paper_id string, text string") for rows in (old, new))
    said = spark.createDataFrame([(i, v, 1, text, 1) for i, text in said for v in (1, 2)], SAID)
    told = {("a", "d", 1), ("b", "b", 2), ("g", "g", 3), ("i", "h", 1), ("k", "k", 3)}
    for made in (tm.migrate(said, old, new), tm.migrate(said, tm.with_content(old), tm.with_content(new))):
        rows = made.collect()
        assert {(r["old_id"], r["block_id"], r["rule"]) for r in rows} == told and len(rows) == 2 * len(told)
        names = shuffled(made)
        assert {"content", "want", "got"} <= names and not {"text", "source"} & names


def test_validity_shuffles_no_texts(spark):
    rows = [("a", "x ⟦f1⟧ ^2^"), ("b", "y ⟦f1⟧"), ("c", None), ("d", "z"), ("e", "z"), ("f", "z")]
    blocks = spark.createDataFrame([(i, "p", text) for i, text in rows], "block_id string, paper_id string, text string")
    said = [("a", "⟦f01⟧ ^2^"), ("b", "y"), ("c", "~q~"), ("d", " "), ("e", "x</think>z"), ("f", None), ("g", "⟦f2⟧")]
    said = spark.createDataFrame([(i, 1, 1, text, 1) for i, text in said], SAID)
    right, wrong = tm.valid(said, blocks), tm.failures(said, blocks)
    assert {r["block_id"] for r in right.collect()} == {"a", "c", "g"} and right.columns == said.columns
    assert {tuple(r) for r in wrong.collect()} == {("empty", 1), ("thinking", 1), ("inline", 1)}
    assert {r["block_id"] for r in tm.latest(said, blocks).collect()} == {"a", "c"}
    assert not {"text", "source_text"} & (shuffled(right.select("block_id")) | shuffled(wrong))


def test_migration_reads_blocks_that_are_made_once(spark):
    """Old and new blocks and translations used to cut all texts anew, four times in all."""
    made = QUERIES["tm6_migrated"](spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and not [line for line in nodes(made, "Generate") if "posexplode" in line]


def test_inverted_abstracts_shuffle_nothing(spark, tmp_path):
    rows = [(1, "a b\ta\n\n c"), (2, ""), (3, " d "), (4, None), (5, "x\u00a0y é x\u00a0y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = QUERIES["src7_inverted_abstracts"](spark, str(tmp_path))
    assert {r["doc_id"]: r["abstract"] for r in made.collect()} == {1: "a b a c", 2: "", 3: "d", 4: None, 5: "x\u00a0y é x\u00a0y"}
    assert not nodes(made, "Exchange")


def test_citing_words_are_made_once(spark):
    """The words that citations are made of come from each text once, not from a paper's first text for each of its blocks."""
    made = QUERIES["bib15_bib16_citations"](spark, "/root/testdata/sf0.001")
    windows = [line for line in nodes(made, "Window") if "first" in line]
    assert windows and not any(re.search(r"first(_value)?\(text", line) for line in windows)


def test_contexts_read_blocks_that_are_made_once(spark):
    made = QUERIES["ret9_contexts"](spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and not [line for line in nodes(made, "Generate") if "posexplode" in line]


def test_figures_read_boxes_that_are_made_once(spark):
    """Boxes are read for the corners and the cells of both sides; each reading used to cut the texts anew."""
    made = QUERIES["lay9_figure_clusters"](spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and not [line for line in nodes(made, "Generate") if "posexplode" in line]


def test_reading_items_read_blocks_that_are_made_once(spark):
    made = QUERIES["seg10_reading_items"](spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and not [line for line in nodes(made, "Generate") if "posexplode" in line]


def test_terms_meet_translations_once(spark):
    said = spark.createDataFrame([("p", f"b{i}", "common " + ("rare" if i == 2 else "other") + (" some" if i < 2 else "")) for i in range(5)] + [("q", "c", "common")], "paper_id string, block_id string, text string")
    terms = spark.createDataFrame([(p, t) for p in "pq" for t in ("common", "rare", "some", "none")], "paper_id string, term string")
    made = ret.search_translations(said, terms)
    # of five blocks two at most may have a term, of one block one
    assert {(r["block_id"], r["score"]) for r in made.collect()} == {("b0", 4), ("b1", 4), ("b2", 4), ("c", 6)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_search_multiplies_no_documents(spark, monkeypatch):
    """Documents used to be shuffled once for each block of questions and questions for each shard, and hits for each shard as rows of their own; a task carries the best from shard to shard."""
    monkeypatch.setattr(ret, "SHARD", 10)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.concat(F.lit("word"), (F.col("id") % 9).cast("string"))).alias("text"))
    asked = spark.range(200).select(F.col("id").alias("question_id"), F.concat(F.lit("common word"), (F.col("id") % 9).cast("string")).alias("text"))
    found = ret.bm25(asked, ret.postings(docs, "doc_id"), 4, "doc_id")
    rows = {tuple(r)[:2] for r in found.collect()}
    assert len(rows) == 800 and {(0, 0), (0, 9), (0, 18), (0, 27), (5, 5), (199, 1)} <= rows
    todo, sent = [found._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == "Exchange":
            sent += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.executedPlan()] if p.nodeName().startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
    assert sent <= 200 * 6  # a row for each question and task


def test_search_bounds_keep_what_may_come_up(spark, monkeypatch):
    """Lists that alone stay under the best so far are only looked up: scores and ties are those of a full search, in turns of a few terms and over shards."""
    import random
    from collections import Counter
    from math import log

    for name, value in (("SHARD", 40), ("AT_ONCE", 7), ("MOST_TERMS", 60), ("COMMON", 3)):
        monkeypatch.setattr(ret, name, value)
    rand = random.Random(4)
    words = [f"w{i:03}" for i in range(90)]
    texts = {i: [words[min(89, int(rand.expovariate(0.12)))] for _ in range(rand.choice((3, 12, 40)))] for i in range(240)}
    texts |= {i: texts[i - 200] for i in range(240, 260)}  # equal scores
    asked = {i: rand.sample(words[:60], rand.choice((1, 4, 20))) for i in range(40)}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    want = set()
    for q, ws in asked.items():
        scores = []
        for i, t in texts.items():
            tf = Counter(t)
            if any(w in tf for w in ws):
                scores.append((-round(sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in ws), 6), i))
        want |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:5])}
    # string ids keep their order; a question's rows are one question, a document without an id is counted but not found
    frame = spark.createDataFrame([(f"d{i:03}", " ".join(t)) for i, t in texts.items() if i] + [(None, " ".join(texts[0]))], "block_id string, text string")
    said = spark.createDataFrame([(q, " ".join(part)) for q, ws in asked.items() for part in (ws, ws[:1])], "question_id int, text string")
    got = {tuple(r) for r in ret.bm25(said, ret.postings(frame), 5).collect()}
    left = {q for q, i, *_ in want if i == 0}
    assert {(q, int(i[1:]), s, r) for q, i, s, r in got if q not in left} == {r for r in want if r[0] not in left} and len(left) < 20
    assert "d000" not in {r[1] for r in got}
