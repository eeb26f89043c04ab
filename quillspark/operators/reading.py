"""Records from JSON, metadata edits, dialogue tables, units from pages and the section of a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import names as nm
from ..functions import text as tx

WORK = (
    "id string, title string, doi string, publication_year int, cited_by_count long, "
    "locations array<struct<pdf_url: string, landing_page_url: string, source: struct<type: string>>>"
)
GRAPH_PAPER = (
    "paperId string, title string, year int, abstract string, citationCount long, authors array<struct<name: string>>, "
    "externalIds struct<DOI: string, ArXiv: string>, openAccessPdf struct<url: string>"
)


def downloadable(locations: Column) -> tuple[Column, Column]:
    """(pdf_url, arxiv_id) of the copy to fetch: the best of all locations, arXiv copies before open repositories, then in their order."""

    def ranked(x: Column, i: Column) -> Column:
        arxiv = F.nullif(F.regexp_extract(F.concat_ws(" ", x["landing_page_url"], x["pdf_url"]), fixed.ARXIV_COPY, 1), F.lit(""))
        open_ = (x["source"]["type"] == "repository") & F.startswith(F.lower(x["pdf_url"]), F.lit("https://")) & ~x["pdf_url"].rlike(fixed.BLOCKED_HOSTS)
        rank = F.when(arxiv.isNotNull(), 0).when(open_, 1)
        url = F.coalesce(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv), x["pdf_url"])
        return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), i.alias("i"), url.alias("url"), arxiv.alias("arxiv")))

    best = F.array_min(F.transform(locations, ranked))
    return best["url"], best["arxiv"]


def open_graph_records(works: DataFrame, keep: list[str]) -> DataFrame:
    """Records of works in ``json`` that have a title and a copy to fetch; arXiv DOIs are not kept as DOIs."""
    w = works.select(*keep, F.from_json("json", WORK).alias("w"))
    url, arxiv = downloadable(F.col("w.locations"))
    doi = F.regexp_replace(F.col("w.doi"), r"(?i)^https?://(dx\.)?doi\.org/", "")
    rec = w.select(
        *keep, F.concat(F.lit("oa:"), F.regexp_replace(F.coalesce("w.id", "w.title"), r"^https?://openalex\.org/", "")).alias("id"), F.col("w.title").alias("title"),
        F.col("w.publication_year").alias("year"), url.alias("pdf_url"), arxiv.alias("arxiv_id"), F.when(~doi.rlike(r"(?i)^10\.48550/arxiv\."), doi).alias("doi"), F.col("w.cited_by_count").alias("citations"),
    )
    return rec.where("title <> '' AND pdf_url IS NOT NULL")


def graph_records(papers: DataFrame, keep: list[str]) -> DataFrame:
    """Records of graph-API papers in ``json`` that have a title."""
    p = papers.select(*keep, F.from_json("json", GRAPH_PAPER).alias("p")).where("p.title <> ''")
    names = F.filter(F.transform(F.coalesce("p.authors", F.array().cast("array<struct<name: string>>")), lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    return p.select(
        *keep, F.concat(F.lit("s2:"), F.coalesce("p.paperId", "p.title")).alias("id"), F.col("p.title").alias("title"), names.alias("authors"), F.col("p.year").alias("year"),
        F.col("p.openAccessPdf.url").alias("pdf_url"), F.col("p.externalIds.DOI").alias("doi"), F.col("p.externalIds.ArXiv").alias("arxiv_id"), F.col("p.citationCount").alias("citations"),
    )


def routed(queries: DataFrame, query: Column, sources: dict[str, bool]) -> DataFrame:
    """A row for each query and source to ask; a query with an arXiv id or DOI asks only sources that know ids."""
    has_id = query.rlike(r"[0-9]{4}\.[0-9]{4,5}|10\.[0-9]{4,9}/[^ ]")
    every, able = (F.array(*[F.lit(s) for s, ids in sources.items() if ids or not only]) for only in (False, True))
    return queries.withColumn("source", F.explode(F.when(has_id, able).otherwise(every)))


def upsert_titles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Titles (paper_id, lang, ...): a new row replaces the old one whole, its source and time too."""
    return old.join(new.select("paper_id", "lang").distinct().hint("merge"), ["paper_id", "lang"], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def hand_edited(papers: DataFrame, edits: DataFrame) -> DataFrame:
    """Papers with title and year as edited, legal or null, and marked so; an edit without a title is none."""
    patch = edits.select("id", nm.short_text(F.col("title")).alias("new_title"), nm.legal_year(F.col("year")).alias("new_year")).where("new_title IS NOT NULL")
    both = papers.join(patch.hint("merge"), "id", "left")
    done = F.col("new_title").isNotNull()
    cols = {"title": F.coalesce("new_title", "title"), "year": F.when(done, F.col("new_year")).otherwise(F.col("year")), "meta_edited": F.col("meta_edited") | done}
    return both.select(*[cols[c].alias(c) if c in cols else c for c in papers.columns])


def replaced_tags(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Tags (paper_id, tag) with those of the edited papers (paper_id, tags) taken anew."""
    fresh = edits.select("paper_id", F.explode(nm.normal_tags(F.col("tags"))).alias("tag"))
    return tags.join(edits.select("paper_id").distinct().hint("merge"), "paper_id", "left_anti").unionByName(fresh)


def message_table(messages: DataFrame, questions: DataFrame, system: str, k: int = 6) -> DataFrame:
    """(session_id, position, role, content): system, context, the last ``k`` messages, the question.

    ``questions`` is (session_id, context, question).
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)
    last = last.select("session_id", (F.lit(k + 2) - F.col("back")).alias("at"), "role", F.col("text").alias("content"))
    fixed = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(r).alias("role"), c.alias("content")) for a, r, c in ((0, "system", F.lit(system)), (1, "user", F.col("context")), (k + 2, "user", F.col("question")))])
    every = questions.select("session_id", F.inline(fixed)).unionByName(last.join(questions.select("session_id").hint("merge"), "session_id", "left_semi"))
    return every.select("session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1).cast("long").alias("position"), "role", "content")


def search_digest(results: DataFrame, keys: list[str], k: int = 12, size: int = 300) -> DataFrame:
    """(keys, listing): the first ``k`` results by ``position``, numbered, with source, year, citations and short abstracts."""
    top = results.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).where(F.col("r") <= k)
    facts = F.concat_ws(" · ", "source", F.col("year").cast("string"), F.concat(F.lit("被引"), F.col("citations").cast("string")))
    line = F.concat(F.col("r").cast("string"), F.lit(". "), "title", F.lit("（"), facts, F.lit("）"), F.when(F.col("abstract") != "", F.concat(F.lit("\n   摘要："), F.substring("abstract", 1, size))).otherwise(""))
    rows = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("rows"))  # k rows at most
    return rows.select(*keys, F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("listing"))


def appended_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions (session_id, title, updated_at) after turns (session_id, question, now): first title stays, time goes up."""
    w = Window.partitionBy("session_id").orderBy("now", "question")
    first = turns.withColumn("i", F.row_number().over(w))
    told = first.groupBy("session_id").agg(F.min_by("question", "i").alias("question"), F.count(F.lit(1)).alias("n"), F.max(F.col("now") - F.col("i")).alias("lead"))
    both = sessions.join(told.hint("merge"), "session_id", "left")
    # one turn after another takes greatest(updated + 1, now): n steps end at the larger of old + n and now_i + n - i
    after = F.greatest(F.col("updated_at"), F.col("lead")) + F.col("n")
    return both.select("session_id", F.coalesce("title", tx.session_title(F.col("question"))).alias("title"), F.coalesce(after, "updated_at").alias("updated_at"))


def external_units(units: DataFrame, most: int = 8000, size: int = 20_000) -> DataFrame:
    """Units (paper_id, id, unit_order, kind, text) fit to translate, of the first ``most`` of a paper."""
    first = units.withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy("unit_order"))).where(F.col("r") <= most).drop("r")
    named = F.startswith("id", F.concat("paper_id", F.lit(":x:"))) & (F.char_length("id") <= 160)
    return first.where(named & F.col("kind").isin("para", "heading") & (F.trim(tx.collapse(F.col("text"))) != "") & (F.char_length("text") <= size))


def current_section(positions: DataFrame, headings: DataFrame) -> DataFrame:
    """Positions (paper, page, depth, ...) with the last heading (paper, page, depth, text) at or before each."""
    listed = headings.groupBy("paper").agg(F.collect_list(F.struct("page", "depth", "text")).alias("heads"))  # one document's headings
    both = positions.join(listed.hint("merge"), "paper", "left")
    before = F.filter("heads", lambda h: (h["page"] < F.col("page")) | ((h["page"] == F.col("page")) & (h["depth"] <= F.col("depth"))))
    return both.withColumn("section", F.array_max(before)["text"]).drop("heads")


def paper_language(blocks: DataFrame, k: int = 80) -> DataFrame:
    """(doc_id, lang): the language of a document's first ``k`` paragraphs."""
    w = Window.partitionBy("doc_id").orderBy("page", "block_order")
    some = blocks.where("kind = 'para'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n")
    return some.groupBy("doc_id").agg(text.alias("text")).select("doc_id", tx.text_language(F.col("text")).alias("lang"))
