"""Queries on places on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import flow as fl
from ..operators import spatial as sp
from .registry import query

_ITEMS = "SELECT doc_id, page, block_order AS item, x, y, width, size, height, text FROM f_placed"


def _items(t):
    return t("f_placed").select("doc_id", "page", F.col("block_order").alias("item"), "x", "y", "width", "size", "height", "text")


@query("lay5_jn11_assigned", f"""
WITH i AS (SELECT doc_id, page, item, x + width / 2 AS px, y + size / 2 AS py FROM ({_ITEMS})),
j AS (SELECT i.*, region, dropped, (x2 - x1) * (y2 - y1) AS area, px BETWEEN x1 - 2 AND x2 + 2 AND py BETWEEN y1 - 2 AND y2 + 2 AS inside, px BETWEEN x1 - 4 AND x2 + 4 AND py BETWEEN y1 - 4 AND y2 + 4 AS slack,
  greatest(x1 - px, 0, px - x2) ** 2 + greatest(y1 - py, 0, py - y2) ** 2 AS away FROM i LEFT JOIN f_regions USING (doc_id, page)),
g AS (SELECT doc_id, page, item, min(CASE WHEN NOT dropped AND inside THEN {{'by': area, 'region': region}} END).region AS a, bool_or(dropped AND slack) AS d, min(CASE WHEN NOT dropped AND away < 1600 THEN {{'by': away, 'region': region}} END).region AS n FROM j GROUP BY ALL)
SELECT doc_id, page, item, coalesce(a, CASE WHEN NOT coalesce(d, false) THEN n END) AS region, CASE WHEN a IS NOT NULL THEN 'inside' WHEN d THEN 'dropped' WHEN n IS NOT NULL THEN 'near' ELSE 'far' END AS how FROM g""")
def _(t):
    return sp.assigned(_items(t), t("f_regions"))


@query("lay6_jn10_uncovered", f"""
SELECT doc_id, page, item, y >= 842 * (1 - {sp.EDGE}) OR y <= 842 * {sp.EDGE} AS edge FROM ({_ITEMS}) i WHERE NOT EXISTS (SELECT 1 FROM f_regions r WHERE r.region < 2 AND r.doc_id = i.doc_id AND r.page = i.page
  AND i.x + i.width / 2 BETWEEN x1 - 2 AND x2 + 2 AND i.y + i.size * 0.35 BETWEEN y1 - 2 AND y2 + 2)""")
def _(t):
    boxes = t("f_regions").where("region < 2").select("doc_id", "page", F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("x2 - x1").alias("width"), F.expr("y2 - y1").alias("height"))
    return sp.uncovered(_items(t).withColumn("page_height", F.lit(842)), boxes).select("doc_id", "page", "item", "edge")


@query("lay7_contained", """
SELECT DISTINCT a.doc_id, a.page, a.region AS item FROM f_regions a JOIN f_regions b USING (doc_id, page) WHERE a.region <> b.region AND (b.x2 - b.x1) * (b.y2 - b.y1) > (a.x2 - a.x1) * (a.y2 - a.y1)
  AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.9""")
def _(t):
    return sp.contained(t("f_regions").select("doc_id", "page", F.col("region").alias("item"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("x2 - x1").alias("width"), F.expr("y2 - y1").alias("height")))


@query("lay8_jn12_next_texts", """
WITH j AS (SELECT r.doc_id, r.page, region, x1, y1, x2, y2, block_order, x, y, width, height, size, x IS NOT NULL AND least(x2, x + width) - greatest(x1, x) >= least(x2 - x1, width) * 0.3 AS shared,
  y >= (y1 + y2) / 2 AND y + height / 2 > y2 AND y < y2 + size * 2 AS above, y + height <= (y1 + y2) / 2 AND y + height / 2 < y1 AND y + height > y1 - size * 2 AS below FROM f_regions r LEFT JOIN f_placed p USING (doc_id, page)),
g AS (SELECT doc_id, page, region AS box, min(CASE WHEN shared AND above THEN {'y': y, 'o': block_order, 's': size} END) AS a, min(CASE WHEN shared AND below AND NOT above THEN {'y': -(y + height), 'o': block_order, 's': size} END) AS b FROM j GROUP BY ALL)
SELECT doc_id, page, box, a.y AS above_y, a.s AS above_size, -b.y AS below_y, b.s AS below_size FROM g""")
def _(t):
    boxes = t("f_regions").select("doc_id", "page", F.col("region").alias("box"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("x2 - x1").alias("width"), F.expr("y2 - y1").alias("height"))
    texts = t("f_placed").select("doc_id", "page", F.col("block_order").alias("text"), "x", "y", "width", "height", "size")
    return sp.next_texts(boxes, texts).select("doc_id", "page", "box", F.col("above.y").alias("above_y"), F.col("above.size").alias("above_size"), F.col("below.y").alias("below_y"), F.col("below.size").alias("below_size"))


_AREA = "(x2 - x1) * (y2 - y1)"
_FIGURES = "SELECT doc_id, page, block_order, CASE WHEN block_order % 5 < 3 THEN 'figure' ELSE 'para' END AS kind, CAST(50 + 130 * (block_order % 5) AS BIGINT) AS x, CAST(700 - 100 * floor((block_order % 10) / 5) AS BIGINT) AS y, CAST(100 + 25 * (doc_id % 3) AS BIGINT) AS width, CAST(80 - 45 * (block_order % 2) * (doc_id % 2) AS BIGINT) AS height FROM f_blocks"


@query("lay9_figure_clusters", f"""
WITH RECURSIVE f AS ({_FIGURES}),
r AS (SELECT *, x AS x1, y AS y1, x + width AS x2, y + height AS y2, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_order) AS run
  FROM (SELECT *, coalesce(kind = 'figure' AND lag(kind) OVER w = 'figure' AND lag(page) OVER w = page, false) AS go FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY block_order))),
g AS (SELECT * FROM r WHERE kind = 'figure'),
e AS (SELECT a.doc_id, a.block_order AS a, b.block_order AS b FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.run = b.run AND a.block_order <> b.block_order
  AND ((greatest(a.x1, b.x1) - least(a.x2, b.x2) <= 30 AND greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(1, least(a.height, b.height)) >= 0.5)
    OR (greatest(a.y1, b.y1) - least(a.y2, b.y2) <= 14 AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(1, least(a.width, b.width)) >= 0.5))),
reach AS (SELECT doc_id, block_order AS a, block_order AS b FROM g UNION SELECT reach.doc_id, reach.a, e.b FROM reach JOIN e ON e.doc_id = reach.doc_id AND e.a = reach.b),
c AS (SELECT doc_id, a AS block_order, min(b) AS cluster FROM reach GROUP BY ALL),
w AS (SELECT g.*, cluster, min(x1) OVER v AS u1, min(y1) OVER v AS v1, max(x2) OVER v AS u2, max(y2) OVER v AS v2, sum(width * height) OVER v AS filled FROM g JOIN c USING (doc_id, block_order) WINDOW v AS (PARTITION BY doc_id, cluster))
SELECT doc_id, page, block_order, CASE WHEN loose THEN block_order ELSE cluster END AS cluster, CASE WHEN loose THEN x1 ELSE u1 END AS x1, CASE WHEN loose THEN y1 ELSE v1 END AS y1, CASE WHEN loose THEN x2 ELSE u2 END AS x2, CASE WHEN loose THEN y2 ELSE v2 END AS y2
FROM (SELECT *, filled < (u2 - u1) * (v2 - v1) * 0.7 AS loose FROM w)""")
def _(t):
    blocks = t("f_blocks")
    return sp.figure_clusters(blocks.sparkSession.sql(_FIGURES.replace("f_blocks", "{f_blocks}"), f_blocks=blocks))


_FOUND = "SELECT doc_id, page, label, CAST((doc_id * 7 + item * 13) % 100 AS DOUBLE) / 100 AS score, item, x1, y1, x2, y2 FROM (SELECT doc_id, page, 'text' AS label, region AS item, x1, y1, x2, y2 FROM f_regions UNION ALL SELECT doc_id, page, CASE WHEN doc_id % 4 = 0 THEN 'figure' ELSE 'text' END, region + 20, x1 + 15 * (doc_id % 6), y1, x2 + 15 * (doc_id % 6), y2 FROM f_regions)"


@query("lay10_suppressed", f"""
WITH l AS (SELECT doc_id, page, label, list([{{'by': -score, 'item': item, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, item) AS every FROM ({_FOUND}) GROUP BY ALL),
k AS (SELECT doc_id, page, label, unnest(list_reduce(every, lambda kept, r: CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.x2, r[1].x2) - greatest(k.x1, r[1].x1)) * greatest(0, least(k.y2, r[1].y2) - greatest(k.y1, r[1].y1))
  / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r[1].x2 - r[1].x1) * (r[1].y2 - r[1].y1) - greatest(0, least(k.x2, r[1].x2) - greatest(k.x1, r[1].x1)) * greatest(0, least(k.y2, r[1].y2) - greatest(k.y1, r[1].y1)) + 1e-6) > 0.5)) > 0 THEN kept ELSE list_concat(kept, r) END)) AS r FROM l)
SELECT doc_id, page, label, r.item AS item FROM k""")
def _(t):
    regions = t("f_regions")
    return sp.suppressed(regions.sparkSession.sql(_FOUND.replace("f_regions", "{f_regions}"), f_regions=regions)).select("doc_id", "page", "label", "item")


@query("lay13_split_at_gaps", f"""
WITH i AS (SELECT *, CAST(floor((item % 10) / 5) AS BIGINT) AS region FROM ({_ITEMS})),
m AS (SELECT doc_id, page, region, list(size ORDER BY size) FILTER (WHERE size > 1) AS s FROM i GROUP BY ALL)
SELECT doc_id, page, region, item, CAST(sum(CASE WHEN gap > 3 * s[CAST(floor(len(s) / 2) AS BIGINT) + 1] THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, region ORDER BY y DESC, item) AS BIGINT) AS part
FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, region ORDER BY y DESC, item) - y AS gap FROM i) JOIN m USING (doc_id, page, region)""")
def _(t):
    return sp.split_at_gaps(_items(t).withColumn("region", F.floor(F.col("item") % 10 / 5))).select("doc_id", "page", "region", "item", "part")


@query("lay14_colliding", f"""
WITH i AS (SELECT *, trim(text) AS s FROM ({_ITEMS}) WHERE length(trim(text)) >= 3 AND width > 0),
p AS (SELECT a.doc_id, a.page, a.item AS a, b.item AS b FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.page = b.page AND a.item < b.item AND a.s <> b.s
  WHERE greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.size, b.y + b.size) - greatest(a.y, b.y)) > least(a.width * a.size, b.width * b.size) * {sp.COLLIDING})
SELECT DISTINCT doc_id, page, unnest([a, b]) AS item FROM p""")
def _(t):
    return sp.colliding(_items(t).withColumnRenamed("text", "str"))


_NOTES = "SELECT doc_id, page, block_order AS block, x, y, width, height, CASE WHEN block_order % 3 = 0 THEN concat('* ', text) ELSE text END AS text FROM f_placed"
_RULES = "SELECT doc_id, page, block_order AS rule, x + 10 * (doc_id % 5) AS x, y + 10 + block_order % 7 AS y, CAST(100 AS BIGINT) AS width, CAST(2500 AS BIGINT) AS page_height FROM f_placed WHERE block_order % 2 = 0"


@query("lay15_footnote_rules", f"""
WITH n AS ({_NOTES}), r AS ({_RULES}),
m AS (SELECT r.doc_id, r.page, rule, min({{'gap': r.y - (n.y + n.height), 'block': block}}).block AS block FROM r JOIN n ON r.doc_id = n.doc_id AND r.page = n.page AND starts_with(n.text, '* ')
  WHERE r.y <= page_height * 0.4 AND r.y - (n.y + n.height) BETWEEN 0 AND 14 AND abs(n.x - r.x) <= 30 AND r.x + r.width <= n.x + n.width + 30 GROUP BY ALL)
SELECT doc_id, page, block, min(rule) AS rule FROM m GROUP BY ALL""")
def _(t):
    placed = t("f_placed")
    made = lambda sql: placed.sparkSession.sql(sql.replace("f_placed", "{f_placed}"), f_placed=placed)
    return sp.footnote_rules(made(_NOTES), made(_RULES))


_LINES = "SELECT doc_id, page, block_order AS item, CAST(CASE WHEN block_order % 3 = 1 THEN 320 ELSE 50 END AS BIGINT) AS x, CASE WHEN block_order % 8 = 3 THEN CAST(20 AS BIGINT) ELSE y END AS y, CAST(CASE WHEN block_order % 7 = 0 THEN 500 ELSE 240 END AS BIGINT) AS width, CASE WHEN block_order % 8 = 3 THEN concat(' ', CAST(page AS {S})) ELSE text END AS text FROM f_placed"


def _lines(t):
    placed = t("f_placed")
    return placed.sparkSession.sql(_LINES.replace("{S}", "STRING").replace("f_placed", "{f_placed}"), f_placed=placed)


@query("lay2_page_numbers", f"SELECT doc_id, page, item FROM ({_LINES.replace('{S}', 'VARCHAR')}) WHERE regexp_matches(text, '^\\s*\\d{{1,4}}\\s*$') AND (y < 842 * 0.06 OR y > 842 * (1 - 0.06))")
def _(t):
    return _lines(t).where(sp.page_number(F.col("text"), F.col("y"), F.lit(842))).select("doc_id", "page", "item")


@query("lay3_reading_order", f"""
WITH l AS (SELECT *, x < 306 - 612 * 0.08 AND x + width > 306 + 612 * 0.08 AS f FROM ({_LINES.replace('{S}', 'VARCHAR')})),
c AS (SELECT *, CASE WHEN f THEN 'full' WHEN x + width / 2 < 306 THEN 'left' ELSE 'right' END AS col, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y DESC, item) AS above FROM l)
SELECT doc_id, page, item, col AS "column", CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY 2 * above + CASE WHEN f THEN 0 ELSE 1 END) AS INT) AS band,
  CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY above, NOT f, col = 'right', y DESC, item) AS INT) AS place FROM c""")
def _(t):
    return sp.reading_order(_lines(t).withColumn("page_width", F.lit(612))).select("doc_id", "page", "item", "column", "band", "place")


_PAGES = "SELECT doc_id, page, block_order AS item, CAST(CASE WHEN block_order % 3 = 1 THEN 320 ELSE 50 END AS BIGINT) AS x, y, CAST(CASE WHEN block_order % 7 = 0 THEN 500 ELSE 240 END AS BIGINT) AS width, height, size, heading, text FROM f_placed"


@query("lay4_parsed_pages", f"""
WITH l AS (SELECT *, x < 306 - 612 * 0.08 AND x + width > 306 + 612 * 0.08 AS f FROM ({_PAGES})),
c AS (SELECT *, x + width / 2 >= 306 AND NOT f AS r, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y DESC, item) AS above FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY above, NOT f, r, y DESC, item) AS place FROM c),
b AS (SELECT doc_id, page, max_by(bucket, n * 1000000 - first) AS body FROM (SELECT doc_id, page, floor(size * 2 + 0.5) / 2 AS bucket, sum(length(text)) AS n, min(place) AS first FROM o GROUP BY ALL) GROUP BY ALL),
g AS (SELECT o.*, body, lag(y) OVER w - y AS gap, lag(heading) OVER w AS after FROM o JOIN b USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY place)),
m AS (SELECT doc_id, page, coalesce(median(CASE WHEN gap > 0 AND gap < {fixed.GAP_LIMIT} * body THEN gap END), {fixed.PITCH} * max(body)) AS pitch FROM g GROUP BY doc_id, page),
p AS (SELECT g.*, sum(CASE WHEN gap IS NULL OR gap <= 0 OR gap > {fixed.PARAGRAPH_GAP} * pitch OR heading OR after THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY place) AS paragraph FROM g JOIN m USING (doc_id, page)),
q AS (SELECT doc_id, page, CAST(paragraph AS BIGINT) AS paragraph, bool_or(heading) AS heading, string_agg(text, ' ' ORDER BY place) AS text, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1, count(*) AS n FROM p GROUP BY ALL)
SELECT doc_id, page, paragraph, CASE WHEN heading THEN 'heading' ELSE 'para' END AS kind, text, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, x0, y0, x1, y1, n FROM q""")
def _(t):
    placed = t("f_placed")
    return sp.parsed_pages(placed.sparkSession.sql(_PAGES.replace("f_placed", "{f_placed}"), f_placed=placed).withColumn("page_width", F.lit(612)))


@query("seg10_reading_items")
def _(t):
    blocks = t("f_blocks")
    shaped = blocks.sparkSession.sql(_FIGURES.replace("f_blocks", "{f_blocks}"), f_blocks=blocks).drop("kind")
    size = F.when(F.col("block_order") % 9 == 4, 7.0).otherwise(10.0)
    return fl.reading_items(blocks.select("doc_id", "block_order", "kind", "text", "section").join(shaped.hint("merge"), ["doc_id", "block_order"]).withColumn("size", size))
