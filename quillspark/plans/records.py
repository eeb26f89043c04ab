"""Queries on papers, bibliographic records and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import biblio as bib
from ..operators import library as lib
from ..operators import reading as rd
from ..operators import usage as use
from ..sources import adapters
from .registry import query


@query("src2_recent_papers", "SELECT id, coalesce(last_opened_at, added_at) AS used_at FROM f_papers")
def _(t):
    return t("f_papers").orderBy(F.coalesce("last_opened_at", "added_at").desc(), "id").select("id", F.coalesce("last_opened_at", "added_at").alias("used_at"))


@query("src3_atom_records", "SELECT doc_id, concat('24', lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'), '.', lpad(CAST(doc_id % 211 AS VARCHAR), 5, '0')) AS arxiv_id, trim(regexp_replace(first_line, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title FROM f_first")
def _(t):
    title = F.replace(F.replace("first_line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/24"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("doc_id") % 211).cast("string"), 5, "0"), F.lit("v1</id><title>"), title, F.lit("</title></entry>"))
    return bib.atom_records(t("f_first").select("doc_id", entry.alias("xml")))


@query("src4_page_metadata", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def _(t):
    return t("pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("src7_inverted_abstracts", "SELECT doc_id, array_to_string(list_slice(w, 1, 5000), ' ') AS abstract FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM documents)")
def _(t):
    index = t("documents").select("doc_id", "text").mapInArrow(bib.word_index, "doc_id long, index map<string, array<int>>")
    return index.select("doc_id", bib.abstract(F.col("index")).alias("abstract"))


@query("src16_upsert_papers", "SELECT o.id, CASE WHEN o.meta_edited THEN o.title WHEN o.doc_id % 3 = 0 THEN concat(o.title, ' II') ELSE o.title END AS title, o.year FROM f_papers o")
def _(t):
    old = t("f_papers").select("id", "title", "year", "status", "added_at", "meta_edited")
    new = t("f_papers").where("doc_id % 3 = 0").select("id", F.concat("title", F.lit(" II")).alias("title"), F.lit(None).cast("int").alias("year"), "added_at")
    return lib.upsert_papers(old, new).select("id", "title", "year")


@query("src20_cascading_delete", "SELECT block_id FROM f_translations WHERE split_part(block_id, ':', 1) NOT IN (SELECT id FROM f_papers WHERE doc_id % 5 = 0)")
def _(t):
    gone = t("f_papers").where("doc_id % 5 = 0").select(F.col("id").alias("paper_id"))
    return lib.delete_papers(t("f_translations"), gone, F.get(F.split("block_id", ":"), F.lit(0))).select("block_id")


@query("src22_inventory", "SELECT 'papers' AS name, count(*) AS n_rows FROM f_papers UNION ALL SELECT 'blocks', count(*) FROM f_blocks UNION ALL SELECT 'translations', count(*) FROM f_translations UNION ALL SELECT 'usage', count(*) FROM f_usage")
def _(t):
    return lib.inventory({n: t(f"f_{n}") for n in ("papers", "blocks", "translations", "usage")})


@query("flt1_search", "SELECT id FROM f_papers WHERE contains(lower(title), 'the') OR contains(lower(tag1), 'the') OR contains(CAST(year AS VARCHAR), 'the')")
def _(t):
    return lib.search(t("f_papers"), " The ", ["title", "tag1", "year"]).select("id")


@query("flt2_collection", "SELECT id FROM f_papers WHERE status = 'reading'")
def _(t):
    return lib.collection(t("f_papers"), "reading").select("id")


@query("flt3_tagged", "SELECT id FROM f_papers WHERE tag1 = 't3' OR tag2 = 't3'")
def _(t):
    return lib.tagged(t("f_papers"), "t3").select("id")


@query("flt6_incomplete", "SELECT id, year IS NULL AS incomplete, NOT regexp_matches(trim(title), '[ \\t]') AS one_word FROM f_papers")
def _(t):
    return t("f_papers").select("id", F.col("year").isNull().alias("incomplete"), (~F.trim("title").rlike(r"[ \t]")).alias("one_word"))


@query("flt7_lookup_due", "SELECT id FROM f_papers WHERE last_opened_at IS NULL OR last_opened_at < 1712592000500 - 30 * 86400000::BIGINT")
def _(t):
    return lib.lookup_due(t("f_papers"), F.col("last_opened_at"), F.lit(1712592000500)).select("id")


@query("flt8_stale_layouts", "SELECT id, CASE WHEN status = 'done' AND doc_id % 4 < 2 THEN 'pending' ELSE status END AS layout_state FROM f_papers")
def _(t):
    return lib.stale_layouts(t("f_papers"), F.col("doc_id") % 4, F.col("status"), 2).select("id", "layout_state")


@query("agg2_use2_month_usage", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, provider, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS calls FROM f_usage GROUP BY ALL")
def _(t):
    return use.by_month(t("f_usage"), ["provider", "model"])


@query("agg4_sorted_tags", "SELECT id, CASE WHEN tag1 = tag2 THEN concat('[\"', tag1, '\"]') ELSE concat('[\"', least(tag1, tag2), '\",\"', greatest(tag1, tag2), '\"]') END AS tags FROM f_papers")
def _(t):
    return t("f_papers").select("id", F.to_json(F.array_sort(F.array_distinct(F.array("tag1", "tag2")))).alias("tags"))


@query("agg5_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT id, tag1 AS tag FROM f_papers UNION SELECT id, tag2 FROM f_papers) GROUP BY tag")
def _(t):
    return lib.tag_counts(t("f_papers"))


@query("top1_shelf", "SELECT id, row_number() OVER (ORDER BY pinned_at DESC NULLS LAST, year DESC NULLS LAST, coalesce(last_opened_at, added_at) DESC, id) AS place FROM f_papers")
def _(t):
    return lib.placed(lib.shelf(t("f_papers"), "year").select("id"))


@query("top2_continue_reading", "SELECT id, progress FROM f_papers WHERE progress > 0 AND progress < 100 ORDER BY coalesce(last_opened_at, added_at) DESC, id LIMIT 3")
def _(t):
    return t("f_papers").where("progress > 0 AND progress < 100").orderBy(F.coalesce("last_opened_at", "added_at").desc(), "id").limit(3).select("id", "progress")


@query("top3_palette", "SELECT id FROM f_papers WHERE contains(lower(title), 'and') ORDER BY id LIMIT 6")
def _(t):
    return lib.search(t("f_papers"), "and", ["title"]).orderBy("id").limit(6).select("id")


@query("top4_ranked_records", "SELECT source, rec_id, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(citations, -1) DESC, year DESC NULLS LAST, rec_id) AS INT) AS rank FROM f_bib")
def _(t):
    return bib.ranked(t("f_bib")).select("source", "rec_id", "rank")


@query("top7_recent_queries", "SELECT source, query_norm, last, CAST(rank AS INT) AS rank FROM (SELECT source, query_norm, max(ts) AS last, row_number() OVER (PARTITION BY source ORDER BY max(ts) DESC, query_norm) AS rank FROM f_search_log GROUP BY source, query_norm) WHERE rank <= 8")
def _(t):
    last = t("f_search_log").groupBy("source", "query_norm").agg(F.max("ts").alias("last"))
    return lib.top_by(last, ["source"], [F.desc("last"), F.col("query_norm")], 8)


@query("bibf1_bibf2_ids", "SELECT rec_id, doi, arxiv_id FROM f_bib")
def _(t):
    said = F.concat(F.lit("see https://doi.org/"), F.coalesce("doi", F.lit("-")), F.lit("). arXiv:"), F.coalesce("arxiv_id", F.lit("none")), F.lit("v2 "))
    return t("f_bib").select("rec_id", tx.doi(said).alias("doi"), tx.arxiv_id(F.concat(F.lit("arXiv:"), F.coalesce("arxiv_id", F.lit("none")), F.lit("v2"))).alias("arxiv_id"))


@query("bibf5_title_keys", r"SELECT rec_id, lower(regexp_replace(title, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM f_bib")
def _(t):
    return t("f_bib").select("rec_id", tx.title_key(F.col("title")).alias("key"))


_FULL = "SELECT r.rec_id, r.title, r.year, r.doi, r.arxiv_id, r.citations, d.text AS abstract FROM f_bib r JOIN documents d ON d.doc_id = r.rec_id"


def _full(t):
    """Records whose abstract is the document."""
    return t("f_bib").join(t("documents").select(F.col("doc_id").alias("rec_id"), F.col("text").alias("abstract")).hint("merge"), "rec_id")


@query("bib1_sanitized", rf"""SELECT rec_id, substr(trim(regexp_replace(coalesce(title, ''), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 300) AS title, CASE WHEN year * (rec_id % 2 + 1) < 2200 THEN year * (rec_id % 2 + 1) END AS year,
  nullif(substr(trim(regexp_replace(abstract, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 4000), '') AS abstract, CASE WHEN rec_id % 3 = 0 THEN '' ELSE concat(array_to_string(list_transform(range(1, CAST(least(rec_id % 90 + 1, 60) AS INT) + 1), lambda i: concat('A. ', CAST(i AS VARCHAR))), ',')) END AS authors FROM ({_FULL})""")
def _(t):
    named = F.when(F.col("rec_id") % 3 != 0, F.transform(F.sequence(F.lit(1), (F.col("rec_id") % 90 + 1).cast("int")), lambda i: F.concat(F.lit(" A.\n "), i.cast("string"))))
    made = _full(t).withColumns({"authors": named, "year": (F.col("year") * (F.col("rec_id") % 2 + 1)).cast("long")})
    return bib.sanitized(made).select("rec_id", "title", "year", "abstract", F.array_join("authors", ",").alias("authors"))


@query("bib2_bib3_edges", "SELECT a, b FROM (SELECT min(rec_id) OVER (PARTITION BY doi) AS a, rec_id AS b FROM f_bib WHERE doi IS NOT NULL UNION SELECT min(rec_id) OVER (PARTITION BY arxiv_id), rec_id FROM f_bib WHERE arxiv_id IS NOT NULL) WHERE a <> b")
def _(t):
    r = t("f_bib")
    return bib.key_edges(r, F.lower("doi")).unionByName(bib.key_edges(r, F.col("arxiv_id"))).distinct()


@query("bib5_clusters")
def _(t):
    return bib.linked(t("f_bib"))


@query("bib6_agg11_merged", "SELECT coalesce(doi, CAST(rec_id AS VARCHAR)) AS of, min_by(title, rk * 1000000000 + rec_id) AS title, max(citations) AS citations, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM (SELECT *, CASE source WHEN 'arXiv' THEN 0 WHEN 'S2' THEN 1 ELSE 2 END AS rk FROM f_bib) GROUP BY 1")
def _(t):
    r = t("f_bib").withColumn("of", F.coalesce("doi", F.col("rec_id").cast("string")))
    heads = r.groupBy("of").agg(F.min("rec_id").alias("cluster"))
    m = bib.merged(r, r.join(heads.hint("merge"), "of").select("rec_id", "cluster"))
    return m.join(heads.hint("merge"), "cluster").select("of", "title", "citations", F.array_join(F.array_sort(F.split("sources", r"\+")), "+").alias("sources"))


@query("bib7_explained", f"""SELECT rec_id, CASE WHEN exact THEN '' ELSE array_to_string(hits, ',') END AS hits, CASE WHEN exact THEN 'id' WHEN len(hits) > 0 THEN 'hits' WHEN citations > 100 THEN 'cited' ELSE 'related' END AS why
  FROM (SELECT rec_id, citations, coalesce(arxiv_id = '2402.00001', false) AS exact, list_filter(['eron', 'ther', 'tur'], lambda w: contains(lower(concat(title, ' ', coalesce(abstract, ''))), w)) AS hits FROM ({_FULL}))""")
def _(t):
    return bib.explained(_full(t), "with Eron ther tur 2402.00001").select("rec_id", F.array_join("hits", ",").alias("hits"), "why")


@query("bib8_source_status", "SELECT q.query_norm, s.source, coalesce(n, 0) AS n, CAST(coalesce(failed, 0) AS BIGINT) AS failed, n IS NULL AS pending FROM (SELECT DISTINCT query_norm FROM f_search_log) q CROSS JOIN (VALUES ('view'), ('click'), ('nowhere')) s(source) LEFT JOIN (SELECT query_norm, source, count(*) AS n, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) AS failed FROM f_search_log GROUP BY ALL) c ON c.query_norm = q.query_norm AND c.source = s.source")
def _(t):
    return bib.source_status(t("f_search_log"), ["view", "click", "nowhere"])


@query("bib9_in_library", "WITH p AS (SELECT rec_id AS id, arxiv_id, doi FROM f_bib WHERE rec_id % 2 = 0) SELECT rec_id, paper FROM (SELECT rec_id, coalesce((SELECT min(id) FROM p WHERE p.arxiv_id = b.arxiv_id), (SELECT min(id) FROM p WHERE p.doi = b.doi)) AS paper FROM f_bib b) WHERE paper IS NOT NULL")
def _(t):
    return bib.in_library(t("f_bib"), t("f_bib").where("rec_id % 2 = 0").select(F.col("rec_id").alias("id"), "arxiv_id", "doi"))


@query("bib10_enriched", "SELECT id, CASE WHEN meta_edited THEN p.title ELSE coalesce(b.title, p.title) END AS title, CASE WHEN meta_edited THEN p.year ELSE coalesce(b.year, p.year) END AS year FROM f_papers p LEFT JOIN f_bib b ON p.doc_id = b.rec_id")
def _(t):
    return bib.enriched(t("f_papers"), t("f_bib")).select("id", "title", "year")


@query("set1_all_sources", """
SELECT 'arXiv' AS source, concat('24', lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0'), '.', lpad(CAST(doc_id % 211 AS VARCHAR), 5, '0')) AS id, CAST(NULL AS INT) AS year, trim(regexp_replace(substr(first_line, 1, 80), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title FROM f_first WHERE doc_id % 3 = 0
UNION ALL SELECT source, concat('s2:', CAST(rec_id AS VARCHAR)), year, title FROM f_bib WHERE source = 'S2' AND title <> ''
UNION ALL SELECT source, concat('oa:W', CAST(rec_id AS VARCHAR)), year, title FROM f_bib WHERE source = 'OpenAlex' AND title <> '' AND rec_id % 2 = 0""")
def _(t):
    # each source's own form becomes records, and all of them one table; columns that a source has not are null
    number = F.concat(F.lit("24"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("doc_id") % 211).cast("string"), 5, "0"))
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), number, F.lit("v1</id><title>"), F.substring("first_line", 1, 80), F.lit("</title></entry>"))
    atom = t("f_first").where("doc_id % 3 = 0").select("doc_id", entry.alias("xml"))
    own = t("f_bib").withColumn("rec", F.col("rec_id").cast("string"))
    graph = own.where("source = 'S2'").select(F.to_json(F.struct(F.col("rec").alias("paperId"), "title", "year")).alias("json"))
    place = F.struct(F.lit("https://zenodo.org/b.pdf").alias("pdf_url"), F.struct(F.when(F.col("rec_id") % 2 == 0, "repository").otherwise("journal").alias("type")).alias("source"))
    work = F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), "rec").alias("id"), "title", F.col("year").alias("publication_year"), F.array(place).alias("locations")))
    raw = {"arxiv": atom, "s2": graph, "openalex": own.where("source = 'OpenAlex'").select(work.alias("json"))}
    return adapters.all_records(raw).select("source", "id", "title", "year")


@query("use3_use4_costs", "SELECT event_id, CASE WHEN contains(model, 'claude-sonnet') THEN (input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000 WHEN contains(model, 'gpt-4o-mini') THEN (input_tokens * 0.15::DOUBLE + output_tokens * 0.6::DOUBLE) / 1000000 WHEN contains(model, 'deepseek') THEN (input_tokens * 0.27::DOUBLE + output_tokens * 1.1::DOUBLE) / 1000000 WHEN contains(model, 'qwen') THEN (input_tokens * 0.1::DOUBLE + output_tokens * 0.4::DOUBLE) / 1000000 END AS usd FROM f_usage")
def _(t):
    return use.cost(t("f_usage")).select("event_id", "usd")


_MONEY = "CASE WHEN contains(model, 'claude-sonnet') THEN (input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000 WHEN contains(model, 'gpt-4o-mini') THEN (input_tokens * 0.15::DOUBLE + output_tokens * 0.6::DOUBLE) / 1000000 WHEN contains(model, 'deepseek') THEN (input_tokens * 0.27::DOUBLE + output_tokens * 1.1::DOUBLE) / 1000000 WHEN contains(model, 'qwen') THEN (input_tokens * 0.1::DOUBLE + output_tokens * 0.4::DOUBLE) / 1000000 END"


@query("use5_overview", f"SELECT CAST(date_trunc('month', ts) AS DATE) AS month, round(sum(usd), 6) AS usd, coalesce(string_agg(DISTINCT CASE WHEN usd IS NULL THEN model END, ',' ORDER BY CASE WHEN usd IS NULL THEN model END), '') AS unpriced FROM (SELECT ts, model, {_MONEY} AS usd FROM f_usage) GROUP BY 1")
def _(t):
    return use.overview(t("f_usage"))


@query("use6_estimates", "SELECT doc_id, paras, input_tokens, output_tokens FROM (SELECT doc_id, count(*) AS paras, CAST(ceil(sum(length(text)) * 10 / 38) AS BIGINT) + CAST(ceil(count(*) / 6) AS BIGINT) * 160 AS input_tokens, CAST(ceil(CAST(ceil(sum(length(text)) * 10 / 38) AS BIGINT) * 13 / 10) AS BIGINT) AS output_tokens FROM f_blocks WHERE kind = 'para' GROUP BY doc_id)")
def _(t):
    return use.estimate(t("f_blocks").where("kind = 'para'"), ["doc_id"], "gpt-4o-mini").select("doc_id", "paras", "input_tokens", "output_tokens")
