"""Reading items by example."""

from quillspark.operators import flow as fl

BLOCK = "doc_id long, page long, block_order long, kind string, text string, section string, x double, y double, width double, height double, size double"


def test_reading_items(spark):
    long = "this paragraph goes on without a stop and therefore its sentence does not end before the page does"
    rows = [
        (1, 1, 0, "heading", "Intro", "Intro", 0, 0, 100, 14, 14), (1, 1, 1, "para", long, "Intro", 0, 0, 300, 80, 10), (1, 1, 2, "margin", "7", None, 0, 0, 5, 5, 8), (1, 2, 3, "para", "but goes on here.", "Intro", 0, 0, 300, 40, 10),
        (1, 2, 4, "figure", "", "Intro", 0, 100, 100, 100, None), (1, 2, 5, "figure", "", "Intro", 110, 100, 100, 100, None), (1, 2, 6, "figure", "", "Intro", 400, 600, 50, 50, None), (1, 2, 7, "figure", "", "Intro", 410, 610, 10, 10, None), (1, 3, 8, "figure", "", "Intro", 0, 0, 50, 50, None),
        (1, 3, 9, "para", "Figure 2: what is shown", "Intro", 0, 0, 300, 40, 10), (1, 3, 10, "table", "", "Intro", 0, 0, 50, 50, None), (1, 3, 11, "para", "Jane Doe, Some University", "Intro", 0, 0, 90, 12, 10), (1, 3, 12, "para", "tiny print", "Intro", 0, 0, 90, 40, 7),
        (1, 3, 13, "heading", "References", "References", 0, 0, 90, 14, 14), (1, 4, 14, "para", "[1] Someone. Something. 2020.", "References", 0, 0, 90, 40, 10), (2, 1, 0, "para", "Alone.", None, 0, 0, 300, 80, None),
    ]
    made = spark.createDataFrame([tuple(float(v) if i > 5 and v is not None else v for i, v in enumerate(r)) for r in rows], BLOCK)
    got = [(r["doc_id"], r["place"], r["type"], r["role"], r["blocks"]) for r in fl.reading_items(made).orderBy("doc_id", "place").collect()]
    assert got == [
        (1, 1, "heading", None, [0]), (1, 2, "para", "body", [1, 3]), (1, 3, "figures", None, [4, 5, 6]), (1, 4, "figures", None, [8]), (1, 5, "para", "caption", [9]), (1, 6, "figures", None, [10]),
        (1, 7, "para", "line", [11]), (1, 8, "para", "small", [12]), (1, 9, "heading", None, [13]), (1, 10, "para", "ref", [14]), (2, 1, "para", "body", [0]),
    ]
    assert fl.reading_items(made.limit(0)).count() == 0
