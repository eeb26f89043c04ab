"""Queries on blocks, translations, retrieval and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..llm.scratch import written
from ..operators import library as lib
from ..operators import memory as tm
from ..operators import retrieval as ret
from ..operators import structure as st
from .registry import query

_SCRIPT = r"\^[^\s^~]{1,16}\^|~[^\s~^]{1,16}~"


def _inline(x: str) -> str:
    return r"list_sort(list_concat(list_transform(regexp_extract_all(" + x + r", '⟦f(\d+)⟧', 1), lambda n: 'formula:' || CAST(CAST(n AS INT) AS VARCHAR)), regexp_extract_all(" + x + f", '{_SCRIPT}')))"


_VALID = f"trim(t.text) <> '' AND NOT contains(t.text, 'think>') AND (b.text IS NULL OR {_inline('b.text')} = {_inline('t.text')})"


@query("src1_blocks_in_order", "SELECT block_id, page, block_order, kind FROM f_blocks")
def _(t):
    return t("f_blocks").orderBy("doc_id", "page", "block_order").select("block_id", "page", "block_order", "kind")


@query("src17_upsert_translations", "SELECT block_id, glossary_version, CASE WHEN created_at % 2 = 0 THEN concat(text, '!') ELSE text END AS text, created_at FROM f_translations")
def _(t):
    old = t("f_translations")
    new = old.where("created_at % 2 = 0").withColumns({"text": F.concat("text", F.lit("!")), "created_at": F.col("created_at") + 5})
    return lib.upsert_translations(old, new).select("block_id", "glossary_version", "text", "created_at")


@query("src19_replaced_blocks", "SELECT block_id FROM f_blocks WHERE doc_id % 7 <> 0 OR kind = 'para' OR doc_id NOT IN (SELECT doc_id FROM f_blocks WHERE kind = 'para')")
def _(t):
    b = t("f_blocks")
    return lib.replace_blocks(b, b.where("doc_id % 7 = 0 AND kind = 'para'")).select("block_id")


@query("flt4_find", "SELECT b.block_id FROM f_blocks b LEFT JOIN f_translations t USING (block_id) WHERE contains(lower(b.text), 'ther') OR contains(lower(coalesce(t.text, '')), 'ther')")
def _(t):
    return lib.find(t("f_blocks"), t("f_translations"), "Ther").select("block_id")


@query("flt5_tm1_valid", f"SELECT t.block_id FROM f_translations t LEFT JOIN f_blocks b USING (block_id) WHERE {_VALID}")
def _(t):
    return tm.valid(t("f_translations"), t("f_blocks")).select("block_id")


@query("tm2_lookup", f"SELECT t.block_id, t.text FROM f_translations t LEFT JOIN f_blocks b USING (block_id) WHERE glossary_version = 2 AND {_VALID}")
def _(t):
    return tm.current(tm.valid(t("f_translations"), t("f_blocks")), 2, 1).select("block_id", "text")


@query("tm3_agg3_latest", f"SELECT t.block_id, max(t.created_at) AS created_at FROM f_translations t JOIN f_blocks b USING (block_id) WHERE {_VALID} GROUP BY t.block_id")
def _(t):
    return tm.latest(t("f_translations"), t("f_blocks")).select("block_id", "created_at")


@query("tm4_coverage", f"WITH ok AS (SELECT DISTINCT t.block_id FROM f_translations t LEFT JOIN f_blocks b USING (block_id) WHERE glossary_version = 1 AND {_VALID}) SELECT paper_id, count(*) AS total, count(ok.block_id) AS done FROM f_blocks LEFT JOIN ok USING (block_id) WHERE kind IN ('para', 'heading') GROUP BY paper_id")
def _(t):
    return tm.coverage(t("f_blocks"), t("f_translations"), 1, 1)


@query("tm5_work_list", f"WITH ok AS (SELECT DISTINCT t.block_id FROM f_translations t LEFT JOIN f_blocks b USING (block_id) WHERE glossary_version = 1 AND {_VALID}) SELECT block_id, CASE WHEN NOT regexp_matches(text, '[A-Za-z]{{2,}}') THEN 'identity' ELSE 'translate' END AS action FROM f_blocks WHERE kind IN ('para', 'heading') AND block_id NOT IN (SELECT block_id FROM ok)")
def _(t):
    return tm.work_list(t("f_blocks"), t("f_translations"), 1, 1, ~F.col("text").rlike("[A-Za-z]{2,}")).select("block_id", "action")


@query("tm6_migrated", f"""
WITH new AS (SELECT paper_id, concat(paper_id, ':', CAST(page AS VARCHAR), ':', CAST(block_order + 1 AS VARCHAR)) AS block_id, sha1(text) AS content FROM f_blocks),
alone AS (SELECT paper_id, content, min(block_id) AS "to" FROM new GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT t.block_id AS old_id, glossary_version, prompt_version, "to", CASE WHEN "to" IS NOT NULL THEN 1 WHEN n.content = sha1(b.text) THEN 2 WHEN n.content IS NULL THEN 3 END AS rule
  FROM f_translations t JOIN f_blocks b USING (block_id) LEFT JOIN alone a ON a.paper_id = b.paper_id AND a.content = sha1(b.text) LEFT JOIN new n ON n.block_id = t.block_id WHERE {_inline('b.text')} = {_inline('t.text')}),
p AS (SELECT old_id, CASE WHEN rule = 1 THEN "to" ELSE old_id END AS block_id, glossary_version, prompt_version, rule FROM r WHERE rule IS NOT NULL)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY block_id, glossary_version, prompt_version ORDER BY rule, old_id) = 1""")
def _(t):
    # written with their digests, as old and new blocks and translations would each cut all texts anew
    blocks = written(tm.with_content(t("f_blocks").drop("section")), "blocks")
    new = blocks.withColumn("block_id", F.concat_ws(":", "paper_id", F.col("page").cast("string"), (F.col("block_order") + 1).cast("string")))
    return tm.migrate(t("f_translations", f_blocks=blocks), blocks, new)


@query("tm8_untitled", "SELECT id, title FROM f_papers WHERE title <> '' AND doc_id % 3 <> 0")
def _(t):
    titles = t("f_papers").where("doc_id % 3 = 0").select(F.col("id").alias("paper_id"), F.lit("zh").alias("lang"), F.col("title").alias("source"))
    return tm.untitled(t("f_papers"), titles, "zh").select("id", "title")


@query("tm12_repaired", "SELECT t.block_id, CASE WHEN contains(b.text, '⟦f1⟧') AND NOT contains(t.text, '⟦f1⟧') THEN concat(regexp_replace(t.text, '[.!?][ \\t\\n]*$', ''), '⟦f1⟧', regexp_extract(t.text, '([.!?][ \\t\\n]*)$', 1)) ELSE t.text END AS text FROM f_translations t JOIN f_blocks b USING (block_id)")
def _(t):
    both = t("f_translations").join(t("f_blocks").select("block_id", F.col("text").alias("source")).hint("merge"), "block_id")
    return both.select("block_id", tm.repaired(F.col("source"), F.col("text")).alias("text"))


@query("agg8_failures", f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(t.text) = '' THEN 'empty' WHEN contains(t.text, 'think>') THEN 'thinking' WHEN b.text IS NOT NULL AND NOT ({_VALID}) THEN 'inline' END AS reason FROM f_translations t LEFT JOIN f_blocks b USING (block_id)) WHERE reason IS NOT NULL GROUP BY reason")
def _(t):
    return tm.failures(t("f_translations"), t("f_blocks"))


@query("set3_set4_placeholders", "SELECT t.block_id, contains(b.text, '⟦f1⟧') AND NOT contains(t.text, '⟦f1⟧') AS missing FROM f_translations t JOIN f_blocks b USING (block_id)")
def _(t):
    both = t("f_translations").join(t("f_blocks").select("block_id", F.col("text").alias("source")).hint("merge"), "block_id")
    return both.select("block_id", (F.size(F.array_except(tm.placeholder_numbers(F.col("source")), tm.placeholder_numbers(F.col("text")))) > 0).alias("missing"))


@query("agg1_block_counts", "SELECT paper_id, count(*) AS n, count(DISTINCT page) AS pages, count(DISTINCT section) AS sections FROM f_blocks GROUP BY paper_id")
def _(t):
    return t("f_blocks").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages"), F.countDistinct("section").alias("sections"))


@query("agg7_upper_median", "SELECT doc_id, list_sort(list(length(text)))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM f_blocks GROUP BY doc_id")
def _(t):
    sizes = t("f_blocks").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.char_length("text").cast("long"))).alias("x"))
    return sizes.select("doc_id", F.element_at("x", F.floor(F.size("x") / 2).cast("int") + 1).alias("median"))


@query("win1_sections", "SELECT block_id, section FROM f_blocks")
def _(t):
    return st.with_section(t("f_blocks").drop("section")).select("block_id", "section")


@query("win2_win3_ret7_section_leads", "SELECT block_id, CAST(used AS BIGINT) AS used FROM (SELECT block_id, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY block_order) AS used FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY block_order) AS r FROM f_blocks WHERE kind = 'para' AND section IS NOT NULL AND length(text) >= 40) WHERE r = 1) WHERE used <= 6000")
def _(t):
    return st.section_leads(t("f_blocks")).select("block_id", "used")


@query("win6_even_sample", "SELECT block_id FROM (SELECT block_id, row_number() OVER w - 1 AS pos, greatest(1, floor(count(*) OVER (PARTITION BY doc_id) / 5)) AS step FROM f_blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_order)) WHERE pos % step = 0 AND pos / step < 5")
def _(t):
    return st.even_sample(t("f_blocks")).select("block_id")


@query("win7_last_messages", "SELECT session_id, id, CAST(back AS INT) AS back FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM f_chat) WHERE back <= 6")
def _(t):
    return ret.last_messages(t("f_chat")).select("session_id", "id", "back")


@query("win8_fragment_runs", "SELECT doc_id, block_order, parts, text FROM (SELECT doc_id, page, g, min(block_order) AS block_order, count(*) AS parts, string_agg(text, ' ' ORDER BY block_order) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_order) - row_number() OVER (PARTITION BY doc_id, page, length(text) < 60 ORDER BY block_order) AS g FROM f_blocks) WHERE length(text) < 60 GROUP BY doc_id, page, g)")
def _(t):
    return st.fragment_runs(t("f_blocks"), F.char_length("text") < 60).select("doc_id", "block_order", "parts", "text")


@query("win9_remaining", "SELECT event_id, CAST(count(*) OVER (PARTITION BY provider, CAST(ts AS DATE)) - row_number() OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS remaining, CAST(sum(input_tokens) OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM f_usage")
def _(t):
    run = Window.partitionBy("provider", F.to_date("ts"))
    order = run.orderBy("ts", "event_id")
    return t("f_usage").select("event_id", (F.count(F.lit(1)).over(run) - F.row_number().over(order)).cast("long").alias("remaining"), F.sum("input_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))


@query("top8_anchor_blocks", "SELECT doc_id, min_by(block_id, (CASE WHEN kind = 'heading' THEN 0 ELSE 1000000 END) + block_order) AS anchor FROM f_blocks GROUP BY doc_id")
def _(t):
    return t("f_blocks").groupBy("doc_id").agg(F.min_by("block_id", F.struct(F.col("kind") != "heading", F.col("block_order"))).alias("anchor"))


@query("seg1_outline", "SELECT doc_id, block_order, page, text AS title FROM f_blocks WHERE kind = 'heading'")
def _(t):
    return st.outline(t("f_blocks"))


@query("seg2_references", f"SELECT block_id, coalesce(regexp_matches(section, '{st.REFERENCES}'), false) AS in_references FROM f_blocks")
def _(t):
    return t("f_blocks").select("block_id", st.in_references(F.col("section")).alias("in_references"))


@query("seg3_chains")
def _(t):
    return st.chains(t("f_blocks"))


@query("seg7_batches")
def _(t):
    return st.batches(t("f_blocks").where("kind = 'para'"))


@query("ret1_query_terms", "SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_sort(list_distinct(list_transform(range(1, len(k) + 1), lambda i: {'p': list_position(k, k[i]), 'w': k[i]}))), lambda x: x.w), 1, 12), ' ') AS terms FROM (SELECT conv_id, turn, regexp_extract_all(text, '[a-zA-Z0-9]{3,}') AS k FROM conversations)")
def _(t):
    return t("conversations").select("conv_id", "turn", F.array_join(F.slice(tx.query_terms(F.col("text")), 1, 12), " ").alias("terms"))


@query("ret2_postings", "SELECT term, doc_id, CAST(len(k) AS INT) AS length, count(*) AS tf FROM (SELECT doc_id, k, unnest(k) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}|[一-鿿]') AS k FROM documents)) GROUP BY term, doc_id, k")
def _(t):
    return ret.postings(t("documents"), "doc_id").select("term", "doc_id", "length", "tf")


@query("ret3_top5_bm25", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}|[一-鿿]')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc_id, count(*) AS length FROM w GROUP BY ALL), c AS (SELECT count(*) AS n, avg(length) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
k AS (SELECT conv_id * 1000 + turn AS question_id, list_concat(regexp_extract_all(text, '[a-zA-Z0-9]{3,}'), regexp_extract_all(text, '[一-鿿]')) AS every FROM conversations WHERE role = 'user'),
q AS (SELECT DISTINCT question_id, lower(unnest(every)) AS term FROM k),
s AS (SELECT question_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM q JOIN d USING (term) JOIN p USING (term) JOIN l USING (doc_id), c GROUP BY ALL)
SELECT question_id, doc_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 8""")
def _(t):
    asked = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    return ret.bm25(asked, ret.postings(t("documents"), "doc_id"), 8, "doc_id")


@query("set2_ordered_union", "SELECT doc_id, block_id FROM (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, block_order) AS r FROM (SELECT doc_id, block_id, block_order, min(p) AS p FROM (SELECT doc_id, block_id, block_order, 0 AS p FROM f_blocks WHERE kind = 'heading' UNION ALL SELECT doc_id, block_id, block_order, 1 FROM f_blocks WHERE block_order % 3 = 0) GROUP BY ALL)) WHERE r <= 8")
def _(t):
    b = t("f_blocks").select("doc_id", "block_id", "block_order", "kind")
    return ret.ordered_union([b.where("kind = 'heading'"), b.where("block_order % 3 = 0")], ["doc_id"], ["block_order"], 8).select("doc_id", "block_id")


@query("ret10_jn4_citations", "SELECT session_id, id, concat('B', CAST(id AS VARCHAR)) AS marker FROM f_chat WHERE role = 'assistant' AND id % 2 = 0")
def _(t):
    chat = t("f_chat").where("role = 'assistant'")
    targets = chat.where("id % 2 = 0").select("session_id", "id", F.concat(F.lit("B"), F.col("id").cast("string")).alias("marker"))
    return ret.citations(chat, targets, ["session_id", "id"]).select("session_id", "id", "marker")


@query("ret11_summary_context", "SELECT block_id, CAST(used AS BIGINT) AS used FROM (SELECT block_id, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_order) AS used FROM (SELECT *, max(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS has, row_number() OVER (PARTITION BY doc_id, section, kind ORDER BY block_order) AS r FROM f_blocks WHERE kind <> 'figure') WHERE has = 0 OR kind = 'heading' OR (r = 1 AND section IS NOT NULL)) WHERE used <= 6000")
def _(t):
    return st.summary_context(t("f_blocks")).select("block_id", "used")


@query("cht1_top6_sessions", "SELECT session_id, count(*) AS messages, max(id) AS last FROM f_chat GROUP BY session_id")
def _(t):
    return t("f_chat").groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max("id").alias("last"))


@query("cht2_ownership", "SELECT DISTINCT session_id FROM f_chat WHERE paper_id IN (SELECT doc_id FROM f_papers)")
def _(t):
    return t("f_chat").join(t("f_papers").select(F.col("doc_id").alias("paper_id")).hint("merge"), "paper_id", "left_semi").select("session_id").distinct()


@query("cht4_titles", r"SELECT session_id, substr(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 48) AS title FROM f_chat WHERE role = 'user' AND NOT starts_with(text, '>') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id) = 1")
def _(t):
    first = lib.top_by(t("f_chat").where("role = 'user' AND NOT startswith(text, '>')"), ["session_id"], [F.col("id")], 1)
    return first.select("session_id", tx.session_title(F.col("text")).alias("title"))


@query("cht5_deleted_sessions", "SELECT session_id, id FROM f_chat WHERE session_id % 4 <> 0")
def _(t):
    gone = t("f_chat").where("session_id % 4 = 0").select("session_id").distinct()
    return t("f_chat").join(gone.hint("merge"), "session_id", "left_anti").select("session_id", "id")
