"""Names, records from JSON, edits, dialogue tables and positions on literal rows; nulls and empty tables."""

import json

from pyspark.sql import functions as F

from quillspark.functions import names as nm
from quillspark.operators import reading as rd


def values(spark, column, texts):
    return [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(column(F.col("text")).alias("x")).collect()]


def test_names(spark):
    assert values(spark, nm.normal_query, ["  Deep \t Nets ", "", None]) == ["deep nets", "", None]
    assert values(spark, nm.plain_title, ["A **b** ⟦f1⟧ x^2^ y~i~", None]) == ["A b x2 y i", None]
    file_name = lambda t: nm.note_file_name(t, F.lit(2020), F.lit("0123456789"))
    assert values(spark, file_name, ["Attention: Is All!", "!!", None]) == ["attention-is-all-2020.md", "01234567-2020.md", "01234567-2020.md"]
    assert values(spark, nm.links, ["see (https://a.b/c), http://d.e/f.", "none", None]) == [["https://a.b/c", "http://d.e/f"], [], None]
    assert values(spark, nm.heading_level, ["3.1.2 Data", "Data", "4. End"]) == [3, 1, 1]
    heading = lambda t: nm.is_heading(t, F.lit(10.0), F.lit(10.0))
    assert values(spark, heading, ["2 Method", "IV. Results", "abstract", "plain words", "x" * 121, "arXiv:1234"]) == [True, True, True, False, False, False]
    assert values(spark, nm.split_authors, ["A. One, B. Two and  C. Three；D", ""]) == [["A. One", "B. Two", "C. Three", "D"], []]
    tags = lambda t: nm.normal_tags(F.split(t, ","))
    assert values(spark, tags, ["#ml,ML, ##nlp ,,#", ",".join(f"t{i}" for i in range(30))]) == [["ml", "nlp"], [f"t{i}" for i in range(20)]]


def test_text_tables(spark):
    assert values(spark, nm.is_text_table, ["word " * 40, "word " * 39, "word 1234567890123 " * 40, "word 12 " * 10]) == [True, False, False, False]


def test_map_version(spark):
    h = 0x811C9DC5
    for c in "a=1\nb=模":
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    df = spark.createDataFrame([({"b": "模", "a": "1"},), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(nm.map_version(F.col("m"))).collect()] == [h, 0]


def test_records_from_json(spark):
    repo = {"pdf_url": "https://r.org/x.pdf", "source": {"type": "repository"}}
    works = [
        {"id": "https://openalex.org/W1", "title": "T", "doi": "https://doi.org/10.48550/arXiv.1", "locations": [repo, {"landing_page_url": "http://arxiv.org/abs/2401.01234v2"}]},
        {"id": "W2", "title": "T", "locations": [{**repo, "pdf_url": "https://a.ssrn.com/x"}, {**repo, "pdf_url": "http://r.org/x"}, repo], "doi": "10.1/x"},
        {"id": "W3", "title": "T", "locations": [{"pdf_url": "https://p.com/x", "source": None}]}, {"id": "W4", "title": None, "locations": [repo]}, {"title": "T", "locations": None},
    ]
    got = rd.open_graph_records(spark.createDataFrame([(json.dumps(w),) for w in works] + [(None,), ("{",)], "json string"), [])
    assert sorted((r["id"], r["pdf_url"], r["arxiv_id"], r["doi"]) for r in got.collect()) == [("oa:W1", "https://arxiv.org/pdf/2401.01234", "2401.01234", None), ("oa:W2", "https://r.org/x.pdf", None, "10.1/x")]
    papers = [{"title": "T", "authors": [{"name": "A"}, {"name": ""}]}, {"paperId": "p", "title": "U"}, {"title": ""}]
    got = rd.graph_records(spark.createDataFrame([(json.dumps(p),) for p in papers] + [(None,)], "json string"), [])
    assert sorted((r["id"], r["authors"]) for r in got.collect()) == [("s2:T", ["A"]), ("s2:p", [])]


def test_edits(spark):
    papers = spark.createDataFrame([("a", "Old", 1999, False), ("b", "Old", 1999, False), ("c", "Old", 1999, True)], "id string, title string, year int, meta_edited boolean")
    edits = spark.createDataFrame([("a", " New  title ", 99), ("b", "  ", 2000)], "id string, title string, year int")
    got = {r["id"]: tuple(r)[1:] for r in rd.hand_edited(papers, edits).collect()}
    assert got == {"a": ("New title", None, True), "b": ("Old", 1999, False), "c": ("Old", 1999, True)}
    old = spark.createDataFrame([("a", "de", "x", 1), ("b", "de", "x", 1)], "paper_id string, lang string, text string, created_at long")
    assert sorted(map(tuple, rd.upsert_titles(old, old.where("paper_id = 'a'").withColumn("created_at", F.lit(9).cast("long"))).collect())) == [("a", "de", "x", 9), ("b", "de", "x", 1)]


def test_turns_and_messages(spark):
    sessions = spark.createDataFrame([(1, None, 10), (2, "Kept", 100), (3, None, 5)], "session_id long, title string, updated_at long")
    turns = spark.createDataFrame([(1, "First?", 20), (1, "Second?", 20), (2, "Late?", 50)], "session_id long, question string, now long")
    got = {r["session_id"]: tuple(r)[1:] for r in rd.appended_turns(sessions, turns).collect()}
    assert got == {1: ("First?", 21), 2: ("Kept", 101), 3: (None, 5)}
    said = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(9)], "session_id long, id long, role string, text string")
    asked = spark.createDataFrame([(1, "ctx", "q"), (2, "ctx", "q")], "session_id long, context string, question string")
    rows = rd.message_table(said, asked, "sys").orderBy("session_id", "position").collect()
    assert [r["content"] for r in rows] == ["sys", "ctx", *[f"m{i}" for i in range(3, 9)], "q", "sys", "ctx", "q"]
    assert [r["position"] for r in rows] == [*range(9), *range(3)]


def test_units_and_sections(spark):
    units = spark.createDataFrame([("p", f"p:x:{i}", i, "para", t) for i, t in enumerate(["a", " ", None, "x" * 20_001, "b"])] + [("p", "q:x:1", 9, "para", "a"), ("p", "p:x:8", 8, "figure", "a")], "paper_id string, id string, unit_order long, kind string, text string")
    assert [r["id"] for r in rd.external_units(units).orderBy("unit_order").collect()] == ["p:x:0", "p:x:4"]
    heads = spark.createDataFrame([(1, 1, 0, "Intro"), (1, 2, 5, "End")], "paper long, page long, depth long, text string")
    at = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 2, 5), (1, 0, 0), (2, 1, 1)], "paper long, page long, depth long")
    assert {(r["paper"], r["page"], r["depth"]): r["section"] for r in rd.current_section(at, heads).collect()} == {(1, 1, 3): "Intro", (1, 2, 4): "Intro", (1, 2, 5): "End", (1, 0, 0): None, (2, 1, 1): None}
    assert rd.current_section(at.limit(0), heads).count() == 0 and rd.external_units(units.limit(0)).count() == 0


def test_paper_language(spark):
    rows = [(1, 1, i, "para", "der Hund und die Katze ist nicht mit dem Ball auf der Wiese") for i in range(80)] + [(1, 2, i, "para", "le chat est dans la maison avec les enfants et une table " * 99) for i in range(9)]
    rows += [(2, 1, 0, "heading", "nothing"), (3, 1, 0, "para", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, page long, block_order long, kind string, text string")
    got = {r["doc_id"]: r["lang"] for r in rd.paper_language(blocks).collect()}
    assert got[1] == "de" and set(got) == {1, 3}


def test_plain_titles_of_odd_first_lines(spark, tmp_path):
    """Blank titles, and signs of a title that pair with those behind it, used to differ from the SQL."""
    import duckdb

    from quillspark.plans import ORACLE_SQL, QUERIES

    first = ["", "  \t ", "about ~5 pages", "2^10 of x^2^", "~a~ b", "see ⟦f3⟧", "** so **** it * goes***", "\x0b a \r b", None]
    rows = [(i, t if t is None else t + "\nmore", "en", "web", 0) for i, t in enumerate(first)] + [(len(first), "", "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["txt5_plain_titles"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["txt5_plain_titles"](spark, str(tmp_path)).collect()) == want and len(want) == len(rows)
