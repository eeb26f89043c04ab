"""Queries on model outputs, first pages and positioned lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import register
from ..operators import gates
from ..operators import retrieval as ret
from .registry import query

WS = r"[ \t\n\r\f\v]+"
_PAIRS = "SELECT t.block_id, b.text AS s, t.text AS o FROM f_translations t JOIN f_blocks b USING (block_id)"


def _pairs(t):
    return t("f_translations").select("block_id", F.col("text").alias("o")).join(t("f_blocks").select("block_id", F.col("text").alias("s")).hint("merge"), "block_id")


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_ENTRY = rf"""(length(trim(s)) <= {fixed.ENTRY_LONGEST} AND regexp_matches(trim(s), '{fixed.ENTRY_YEAR}') AND ((regexp_matches(trim(s), '{fixed.ENTRY_NUMBER}') AND regexp_matches(trim(s), '{fixed.ENTRY_NAMES}'))
  OR (len(w) >= 2 AND len(list_filter(w, lambda y: regexp_matches(y, '^[A-Z]'))) >= {fixed.ENTRY_CAPITALS} * len(w) AND regexp_matches(trim(s), '{fixed.ENTRY_VENUE}'))))"""
_PROSE = r"length(array_to_string(regexp_extract_all(s, '\b[a-z]{2,}\b'), ''))"
_ZH = rf"""
SELECT block_id, trim(o) = '' OR regexp_matches(o, '{fixed.THINK_TAG}') OR ({_n('s', '[A-Za-z]')} >= {fixed.LONG_SOURCE} AND NOT regexp_matches(s, '{fixed.LISTED_ENTRY}') AND NOT {_ENTRY}
  AND {_n('s', fixed.INITIALS)} < {fixed.NAMES_IN_LIST}
  AND NOT ({_n('s', ',')} >= {fixed.NAMES_IN_LIST} AND len(list_filter(string_split_regex(s, '\s+'), lambda y: regexp_matches(y, '^[A-Z]'))) >= {fixed.NAMES_SHARE} * greatest(len(list_filter(string_split_regex(s, '\s+'), lambda y: y <> '')), 1))
  AND ({_n('o', '[一-鿿]')} = 0 OR (contains(o, substr(trim(s), 1, {fixed.COPIED_HEAD})) AND length(substr(trim(s), 1, {fixed.COPIED_HEAD})) >= {fixed.COPIED_LEAST})
    OR ({_PROSE} >= {fixed.LONG_SOURCE} AND {_n('o', '[一-鿿]')} < {_PROSE} * {fixed.PROSE_SHARE}))) AS rejected
FROM (SELECT *, list_filter(string_split_regex(string_split_regex(trim(s), '\.\s+')[1], '\s+'), lambda y: y <> '') AS w FROM ({_PAIRS}))"""


@query("tm9_not_translation", _ZH)
def _(t):
    return _pairs(t).select("block_id", gates.not_translation(F.col("s"), F.col("o"), "zh").alias("rejected"))


@query("tm10_titles", f"SELECT block_id, o <> '' AND lower(regexp_replace(o, '[\\s\\p{{P}}]+', '', 'g')) <> lower(regexp_replace(s, '[\\s\\p{{P}}]+', '', 'g')) AND {_n('o', '[一-鿿㐀-䶿]')} > 0 AS accepted FROM (SELECT block_id, s, CASE WHEN length(o) % 3 = 0 THEN concat(o, '译') ELSE o END AS o FROM ({_PAIRS}))")
def _(t):
    marked = _pairs(t).withColumn("o", F.when(F.char_length("o") % 3 == 0, F.concat("o", F.lit("译"))).otherwise(F.col("o")))
    return marked.select("block_id", gates.title_translation(F.col("s"), F.col("o"), "zh").alias("accepted"))


@query("tm11_without_meta", f"SELECT block_id, trim(o) AS text FROM ({_PAIRS})")
def _(t):
    talk = F.concat(F.lit("<think>first\nthe words</think>\nOK. Translation: draft\n- 译文： "), "o")
    return _pairs(t).select("block_id", gates.without_meta(talk).alias("text"))


_FOLD = f"trim(regexp_replace({{}}, '{WS}', ' ', 'g'))"


@query("tm15_digests", f"""SELECT doc_id, latin >= {fixed.LATIN_LEAST} AND latin >= han * {fixed.LATIN_SHARE} AS latin, latin >= {fixed.LATIN_LEAST} AND latin >= han * {fixed.LATIN_SHARE} AND NOT echo AS digest FROM (
SELECT doc_id, {_n('x', '[A-Za-z]')} AS latin, {_n('x', '[一-鿿]')} AS han, x <> '' AND (contains(c, substr(x, 1, 40)) OR contains(c, substr(x, CAST(floor(greatest(length(x) - 40, 0) / 2) AS INT) + 1, 40)) OR contains(c, substr(x, greatest(length(x) - 40, 0) + 1, 40))) AS echo
FROM (SELECT doc_id, {_FOLD.format("CASE WHEN doc_id % 2 = 0 THEN reverse(text) ELSE text END")} AS x, {_FOLD.format("text")} AS c FROM documents))""")
def _(t):
    both = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.reverse("text")).otherwise(F.col("text")).alias("x"))
    return both.select("doc_id", gates.in_target_script(F.col("x"), "fr").alias("latin"), gates.digest(F.col("x"), F.col("text"), "fr").alias("digest"))


@query("ret5_ret6_strong_hits", """
WITH said AS (SELECT doc_id AS paper_id, block_id, text FROM f_translations JOIN (SELECT block_id, doc_id FROM f_blocks) USING (block_id)),
asked AS (SELECT DISTINCT doc_id AS paper_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents),
found AS (SELECT s.*, term FROM said s JOIN asked USING (paper_id) WHERE contains(text, term)),
useful AS (SELECT paper_id, term FROM (SELECT paper_id, term, count(*) AS df FROM found GROUP BY ALL) JOIN (SELECT paper_id, count(*) AS n FROM said GROUP BY paper_id) USING (paper_id) WHERE df <= greatest(1, floor(n * 0.4))),
scored AS (SELECT paper_id, block_id, sum(length(term)) AS score FROM found JOIN useful USING (paper_id, term) GROUP BY ALL)
SELECT paper_id, block_id, CAST(score AS BIGINT) AS score, max(score) OVER (PARTITION BY paper_id) >= 4 AS strong FROM scored QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, block_id) <= 8""")
def _(t):
    from pyspark.sql import Window

    said = t("f_translations").select("block_id", "text").join(t("f_blocks").select("block_id", F.col("doc_id").alias("paper_id")).hint("merge"), "block_id")
    asked = t("documents").select(F.col("doc_id").alias("paper_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("term")).distinct()
    top = ret.search_translations(said, asked)
    return top.select("paper_id", "block_id", "score", (F.max("score").over(Window.partitionBy("paper_id")) >= 4).alias("strong"))


_STAMP = "concat('24', lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'), '.', lpad(CAST(doc_id % 211 AS VARCHAR), 5, '0'))"


@query("bib12_printed_ids", f"""
WITH p AS (SELECT id, doc_id, CASE doc_id % 4 WHEN 0 THEN {_STAMP} WHEN 1 THEN '2401.00001' END AS stored FROM f_papers),
b AS (SELECT paper_id, min(CASE WHEN doc_id % 3 = 0 AND block_order >= 2 THEN {_STAMP} END) AS arxiv, bool_or(doc_id % 3 = 0 AND block_order >= 2) AS stamped, min(CASE WHEN doc_id % 5 = 1 THEN concat('10.1000/', CAST(doc_id AS VARCHAR)) END) AS doi FROM f_blocks WHERE page = 1 GROUP BY paper_id)
SELECT id, CASE WHEN arxiv IS NOT NULL AND (stored IS NULL OR stored = arxiv) THEN concat(arxiv, 'v2') ELSE stored END AS arxiv_id, coalesce(stamped, false) AS stamped, doi FROM p LEFT JOIN b ON p.id = b.paper_id""")
def _(t):
    stamp = F.expr(_STAMP.replace("VARCHAR", "STRING"))
    papers = t("f_papers").select("id", F.when(F.col("doc_id") % 4 == 0, stamp).when(F.col("doc_id") % 4 == 1, "2401.00001").alias("arxiv_id"))
    # first pages with stamps and DOIs printed on them
    stamped = F.when((F.col("doc_id") % 3 == 0) & (F.col("block_order") >= 2), F.concat(F.lit(" arXiv:"), stamp, F.lit("v2 [cs.CL] "))).otherwise("")
    doi = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" (doi 10.1000/"), F.col("doc_id").cast("string"), F.lit("). "))).otherwise("")
    return gates.printed_ids(papers, t("f_blocks").select("paper_id", "page", "block_order", F.concat(F.lit("x"), stamped, doi).alias("text")))


@query("agg6_body_size", "SELECT doc_id, max_by(bucket, n * 1000000 - first) AS body FROM (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS bucket, sum(length(text)) AS n, min(block_order) AS first FROM f_placed GROUP BY ALL) GROUP BY doc_id")
def _(t):
    return gates.body_size(t("f_placed"), ["doc_id"])


_BREAKS = f"""
WITH g AS (SELECT *, lag(y) OVER w - y AS gap, lag(heading) OVER w AS after FROM f_placed JOIN (SELECT doc_id, page, max_by(bucket, n * 1000000 - first) AS body FROM (SELECT doc_id, page, floor(size * 2 + 0.5) / 2 AS bucket, sum(length(text)) AS n, min(block_order) AS first FROM f_placed GROUP BY ALL) GROUP BY doc_id, page) USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_order)),
m AS (SELECT doc_id, page, coalesce(median(CASE WHEN gap > 0 AND gap < {fixed.GAP_LIMIT} * body THEN gap END), {fixed.PITCH} * max(body)) AS pitch FROM g GROUP BY doc_id, page)
SELECT doc_id, page, block_order, x, y, width, height, sum(CASE WHEN gap IS NULL OR gap <= 0 OR gap > {fixed.PARAGRAPH_GAP} * pitch OR heading OR after THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY block_order) AS paragraph FROM g JOIN m USING (doc_id, page)"""


@query("win4_paragraphs", f"SELECT doc_id, page, block_order, CAST(paragraph AS BIGINT) AS paragraph FROM ({_BREAKS})")
def _(t):
    return gates.paragraphs(t("f_placed"), ["doc_id", "page"]).select("doc_id", "page", "block_order", "paragraph")


@query("agg9_boxes", f"SELECT doc_id, page, CAST(paragraph AS BIGINT) AS paragraph, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1, count(*) AS n FROM ({_BREAKS}) GROUP BY ALL")
def _(t):
    return gates.boxes(gates.paragraphs(t("f_placed"), ["doc_id", "page"]), ["doc_id", "page", "paragraph"])


@query("udf1_inline_content_matches", f"SELECT block_id, contains(s, '⟦f1⟧') = contains(o, '⟦f1⟧') AND list_sort(regexp_extract_all(s, '\\^[^\\s^~]{{1,16}}\\^|~[^\\s~^]{{1,16}}~')) = list_sort(regexp_extract_all(o, '\\^[^\\s^~]{{1,16}}\\^|~[^\\s~^]{{1,16}}~')) AS same FROM ({_PAIRS})")
def _(t):
    pairs = _pairs(t)
    register(pairs.sparkSession)
    return pairs.selectExpr("block_id", "inline_content_matches(s, o) AS same")
