"""Bibliographic records: normal forms, matching, clusters, merged fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..llm.words import slices
from .fingerprint import hashes_within, min_label, simhash

SOURCE_RANK = {"arXiv": 0, "S2": 1, "OpenAlex": 2}

# Query words that explain nothing.
STOP_WORDS = (
    "the and for with all you your need are was were from that this these those what how why when which who using use used "
    "based via into its our can not but has have had does did about paper papers study method approach new towards toward over "
    "under between through more than some any one two per"
)


# The longest title, abstract and name, the most names, and the years (both excluded) between which one is kept.
LONGEST_TITLE, LONGEST_ABSTRACT, LONGEST_NAME, MOST_AUTHORS, YEARS = 300, 4000, 120, 60, (1500, 2200)


def sanitized(records: DataFrame) -> DataFrame:
    """Fields cut to size; records without title and ids are dropped; implausible years become null, as do blank abstracts.

    ``abstract``, ``authors`` (an array, whose blank names go) and ``pdf_url`` are looked at where there are any.
    """
    made = {"title": tx.clamp(F.coalesce("title", F.lit("")), LONGEST_TITLE), "year": F.when((F.col("year") > YEARS[0]) & (F.col("year") < YEARS[1]), F.col("year"))}
    if "abstract" in records.columns:
        made["abstract"] = F.nullif(tx.clamp(F.col("abstract"), LONGEST_ABSTRACT), F.lit(""))
    if "authors" in records.columns:
        names = F.transform(F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, MOST_AUTHORS), lambda n: tx.clamp(n, LONGEST_NAME))
        made["authors"] = F.filter(names, lambda n: n != "")
    ids = [c for c in ("doi", "arxiv_id", "pdf_url") if c in records.columns]
    return records.withColumns(made).where(F.concat_ws("", "title", *ids) != "")


def key_edges(records: DataFrame, key: Column) -> DataFrame:
    """(a, b): every record with a key and the smallest record that has it, so a key costs its records and not their pairs."""
    keyed = records.select("rec_id", key.alias("k")).where("k IS NOT NULL AND k <> ''")
    least = keyed.groupBy("k").agg(F.min("rec_id").alias("a"))
    return keyed.join(least.hint("merge"), "k").where("rec_id <> a").select("a", F.col("rec_id").alias("b"))


def title_edges(records: DataFrame, distance: int = 6) -> DataFrame:
    """(a, b) of records without ids whose title fingerprints are near; titles without features give none."""
    loose = records.where("doi IS NULL AND arxiv_id IS NULL").select(F.col("rec_id").alias("doc_id"), F.col("title").alias("text"))
    prints = simhash(loose).where("has_features")
    heads = prints.groupBy("simhash").agg(F.min("doc_id").alias("head"))
    same = prints.join(heads.hint("merge"), "simhash").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    near = hashes_within(heads.select("simhash"), distance)
    ends = near.join(heads.select(F.col("simhash").alias("a"), F.col("head").alias("x")).hint("merge"), "a").join(heads.select(F.col("simhash").alias("b"), F.col("head").alias("y")).hint("merge"), "b")
    return same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def linked(records: DataFrame) -> DataFrame:
    """(rec_id, cluster) by equal DOI or arXiv id without version, and for records without either by title."""
    arxiv = F.regexp_replace("arxiv_id", r"v\d+$", "")
    edges = key_edges(records, F.lower("doi")).unionByName(key_edges(records, arxiv)).unionByName(title_edges(records))
    return min_label(edges, records, "rec_id")


def merged(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record for each cluster: first by source rank and id; then first non-null, greatest citations, distinct sources in order."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(r)) for s, r in SOURCE_RANK.items()], F.lit(9))
    rows = records.join(clusters.hint("merge"), "rec_id").withColumn("order", F.struct(rank.alias("r"), "rec_id"))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
    out = rows.groupBy("cluster").agg(F.min_by("rec_id", "order").alias("rec_id"), F.min_by("title", "order").alias("title"), first("doi"), first("arxiv_id"), first("year"), F.max("citations").alias("citations"), F.array_sort(F.collect_set(F.struct(rank.alias("r"), "source"))).alias("s"))
    return out.withColumn("sources", F.array_join(F.transform("s", lambda x: x["source"]), "+")).drop("s")


def explained(records: DataFrame, query: str) -> DataFrame:
    """why: the id that the query names; else up to four query words (or runs of Han) in title or abstract; else cited, if over a hundred times; else related."""
    asked = F.lit(query)
    words = F.filter(F.regexp_extract_all(F.lower(asked), F.lit("[a-z0-9]{3,}"), 0), lambda w: ~w.isin(*STOP_WORDS.split()) & ~w.rlike(r"^\d+$"))
    terms = F.array_distinct(F.concat(words, F.regexp_extract_all(asked, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), 0)))
    among = F.lower(F.concat_ws(" ", *[c for c in ("title", "abstract") if c in records.columns]))
    exact = F.coalesce(F.col("arxiv_id") == tx.arxiv_id(asked), F.lit(False))
    hits = F.when(exact, F.array().cast("array<string>")).otherwise(tx.let(among, lambda a: F.slice(F.filter(terms, lambda w: F.contains(a, w)), 1, 4)))
    told = records.withColumns({"exact": exact, "hits": hits})
    return told.withColumn("why", F.when(F.col("exact"), "id").when(F.size("hits") > 0, "hits").when(F.col("citations") > 100, "cited").otherwise("related")).drop("exact")


def in_library(records: DataFrame, papers: DataFrame) -> DataFrame:
    """(rec_id, paper) by arXiv id first, else DOI; ``papers`` is (id, arxiv_id, doi)."""
    by = lambda c, name: papers.where(F.col(c).isNotNull()).groupBy(F.lower(c).alias(f"k_{c}")).agg(F.min("id").alias(name))
    a, d = by("arxiv_id", "p1"), by("doi", "p2")
    both = records.join(a.hint("merge"), F.lower(records["arxiv_id"]) == a["k_arxiv_id"], "left").join(d.hint("merge"), F.lower(records["doi"]) == d["k_doi"], "left")
    return both.select("rec_id", F.coalesce("p1", "p2").alias("paper")).where("paper IS NOT NULL")


def enriched(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Papers take a record's fields where it has them; rows edited by hand stay."""
    both = papers.alias("p").join(records.alias("r").hint("merge"), F.col("p.doc_id") == F.col("r.rec_id"), "left")
    new = lambda c: F.when(F.col("p.meta_edited"), F.col(f"p.{c}")).otherwise(F.coalesce(f"r.{c}", f"p.{c}")).alias(c)
    return both.select("p.id", new("title"), new("year"), "p.meta_edited")


def source_status(log: DataFrame, sources: list[str]) -> DataFrame:
    """(query_norm, source, n, failed, pending) for every source of every query."""
    seen = log.groupBy("query_norm", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == 429, 1).otherwise(0)).alias("failed"))
    every = log.select("query_norm").distinct().select("query_norm", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    out = every.join(seen.hint("merge"), ["query_norm", "source"], "left")
    return out.select("query_norm", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("failed", F.lit(0)).alias("failed"), F.col("n").isNull().alias("pending"))


def word_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, index) of texts (doc_id, text): a map of each word, as blanks, tabs and line feeds part them, to its positions in order; null for a null text.

    A text's index is made where the text is, so words are no rows and nothing is shuffled.
    """
    for batch in (part for whole in batches for part in slices(whole, "text", 1_000_000)):
        made: list[dict[str, list[int]] | None] = []
        for text in batch.column("text").to_pylist():
            index: dict[str, list[int]] | None = None if text is None else {}
            for at, word in enumerate(w for w in re.split("[ \\t\\n]+", text or "") if w):
                index.setdefault(word, []).append(at)
            made.append(index)
        column = pa.array([None if m is None else list(m.items()) for m in made], pa.map_(pa.string(), pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "index"])


def abstract(index: Column) -> Column:
    """Text from a map of words to positions 0 to 4999; of words that claim a position the last one has it."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(F.filter(e["value"], lambda p: (p >= 0) & (p < 5000)), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    last = lambda ordered: F.filter(ordered, lambda x, k: (k == F.size(ordered) - 1) | (F.get(ordered, k + 1)["p"] != x["p"]))
    return F.array_join(F.transform(tx.let(F.array_sort(placed), last), lambda x: x["w"]), " ")


def atom_records(feeds: DataFrame) -> DataFrame:
    """(doc_id, arxiv_id, title) of Atom entries (doc_id, xml): white space folded, entities decoded, version dropped."""
    title = tx.collapse(F.regexp_extract("xml", r"(?s)<title>(.*?)</title>", 1))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(sign))
    return feeds.select("doc_id", F.regexp_extract("xml", r"<id>[^<]*/abs/([^<]+?)(?:v\d+)?</id>", 1).alias("arxiv_id"), title.alias("title"))


def ranked(records: DataFrame) -> DataFrame:
    return records.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.coalesce("citations", F.lit(-1)).desc(), F.col("year").desc_nulls_last(), "rec_id")))


def title_hits(papers: DataFrame, first: DataFrame, records: DataFrame) -> DataFrame:
    """(id, rec_id): records of a paper's very title of which an author's last name, of three letters or more, is on its first page.

    ``papers``: id, title; ``first``: id, text; ``records``: rec_id, title, authors (array). Of several the smallest rec_id.
    Of the records of a title only the smallest with a name counts, and papers of one title with one first page are asked for once, so
    neither many copies of a record nor many of a paper are multiplied with the other side.
    """
    page = first.select("id", F.lower("text").alias("page"))
    keyed = papers.select("id", tx.title_key(F.col("title")).alias("key")).where("key <> ''").join(page.hint("merge"), "id")
    names = F.transform(F.slice("authors", 1, 20), lambda a: F.lower(F.try_element_at(F.split(F.trim(a), r"\s+"), F.lit(-1))))
    named = records.select("rec_id", tx.title_key(F.col("title")).alias("key"), F.explode(names).alias("name")).where("key <> '' AND length(name) >= 3")
    offered = named.groupBy("key", "name").agg(F.min("rec_id").alias("rec_id"))
    met = keyed.select("key", "page").distinct().hint("merge").join(offered.hint("merge"), "key").where(F.contains("page", F.col("name")))
    found = met.groupBy("key", "page").agg(F.min("rec_id").alias("rec_id"))
    return keyed.join(found.hint("merge"), ["key", "page"]).select("id", "rec_id")


def trusted_hits(papers: DataFrame, first: DataFrame, records: DataFrame) -> DataFrame:
    """(id, rec_id, rule): the record that completes a paper of which authors, year or source are missing or whose title is one word; edited papers are left alone.

    By arXiv id, then DOI, then title (``title_hits``). An id that the paper has, or an arXiv stamp, is sure; an id that was only read on
    the first page may be a citation's, so its record has to have the paper's title. ``papers``: id, title, authors, year, source,
    arxiv_id, doi, meta_edited; ``first``: id, text, arxiv_id, stamped, doi.
    """
    lacking = F.col("authors").isNull() | F.col("year").isNull() | F.col("source").isNull() | ~F.coalesce(F.col("title").rlike(r"\S\s+\S"), F.lit(False))
    open_ones = papers.where(~F.coalesce("meta_edited", F.lit(False)) & lacking)
    read = first.select("id", F.col("arxiv_id").alias("read_arxiv"), F.col("doi").alias("read_doi"), "stamped")
    keyed = open_ones.select("id", "title", "arxiv_id", "doi").join(read.hint("merge"), "id", "left")
    own = lambda c, r: F.struct(F.coalesce(c, r).alias("key"), F.col(c).isNotNull().alias("sure"))
    keyed = keyed.select("id", tx.title_key(F.coalesce("title", F.lit(""))).alias("key"), own("arxiv_id", "read_arxiv").alias("a"), own("doi", "read_doi").alias("d"), F.coalesce("stamped", F.lit(False)).alias("stamped"))
    offered = records.select("rec_id", tx.title_key(F.coalesce("title", F.lit(""))).alias("rec_key"), "arxiv_id", "doi")
    same = (F.col("key") != "") & (F.col("key") == F.col("rec_key"))
    by_arxiv = keyed.where("a.key IS NOT NULL").withColumn("arxiv_id", F.col("a.key")).hint("merge").join(offered.drop("doi").hint("merge"), "arxiv_id").where(F.col("a.sure") | F.col("stamped") | same)
    by_doi = keyed.where("d.key IS NOT NULL").withColumn("doi", F.col("d.key")).hint("merge").join(offered.drop("arxiv_id").hint("merge"), "doi").where(F.col("d.sure") | same)
    told = lambda hits, rank: hits.select("id", F.struct(F.lit(rank).alias("rank"), "rec_id").alias("hit"))
    every = told(by_arxiv, 1).unionByName(told(by_doi, 2)).unionByName(told(title_hits(open_ones, first, records), 3))
    best = every.groupBy("id").agg(F.min("hit").alias("hit"))
    rule = F.element_at(F.array(*[F.lit(r) for r in ("arxiv", "doi", "title")]), F.col("hit.rank"))
    return best.select("id", "hit.rec_id", rule.alias("rule"))
