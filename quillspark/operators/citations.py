"""Citations by author and year, and the entries of the bibliography that they name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as tx


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def citations(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, cite): what looks like a citation in each ``text``, in order. A null text has none."""
    return texts.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(fixed.CITATION), F.lit(0))).alias("place", "cite"))


def _names(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.NAME_WORD), F.lit(0))


def _first(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, pattern, -1), F.lit(0))


def entries(blocks: DataFrame) -> DataFrame:
    """(paper_id, block_order, author, authors, years): the entries of each paper's bibliography.

    Entries are the paragraphs of a section named like one; where a paper has none, those behind the first heading named so.
    ``author``: the first author's last word, null if that name is none or too long; ``authors``: the last words of all
    authors; ``years``: four digits with a letter behind them or not.
    """
    own = (F.col("kind") == "para") & F.coalesce(F.col("section").rlike(fixed.REFERENCE_SECTION), F.lit(False))
    per_paper = blocks.groupBy("paper_id").agg(
        F.max(own).alias("has"), F.min(F.when((F.col("kind") == "heading") & F.col("text").rlike(fixed.REFERENCE_SECTION), F.col("block_order"))).alias("from")
    )
    pool = blocks.join(per_paper.hint("merge"), "paper_id").where(F.when(F.col("has"), own).otherwise((F.col("kind") == "para") & (F.col("block_order") > F.col("from"))))
    plain = pool.select("paper_id", "block_order", _nfkc("text").alias("text"), F.col("text").alias("written"))
    bare = F.regexp_replace("written", fixed.ENTRY_LABEL, "")
    first = _nfkc(_first(_first(bare, fixed.AUTHORS_END), fixed.BETWEEN_AUTHORS))
    every = _nfkc(_first(F.col("written"), fixed.AUTHORS_END))
    years = F.array_distinct(F.regexp_extract_all(bare, F.lit(tx.ascii_edges(r"\b(\d{4}[a-z]?)\b")), F.lit(1)))
    told = plain.select("paper_id", "block_order", first.alias("first"), every.alias("every"), years.alias("years"))
    last = lambda t: F.try_element_at(_names(t), F.lit(-1))
    authors = F.array_compact(F.transform(F.split("every", fixed.BETWEEN_AUTHORS, -1), lambda n: last(F.regexp_replace(n, r"^\s*and\s+", ""))))
    named = F.size(_names(F.col("first")))
    return told.select("paper_id", "block_order", F.when(named <= fixed.NAME_WORDS, last(F.col("first"))).alias("author"), authors.alias("authors"), "years")


def cited(cites: DataFrame, entries: DataFrame) -> DataFrame:
    """``cites`` (paper_id, cite, ...) with ``entry``: the order of the one entry of the paper that the citation names, else null.

    First author and year have to agree. Of several entries the one stays that also has the second author named, or three
    authors or more behind "et al."; if that leaves none or several, nothing is named. Each citation of a paper
    is looked up once, however often it is written.
    """
    parts = lambda c, g: F.regexp_extract(c, tx.ascii_edges(fixed.CITED), g)
    asked = cites.select("paper_id", "cite").distinct().withColumn("plain", _nfkc("cite"))
    second = F.nullif(F.regexp_extract("cite", fixed.CITED_SECOND, 1), F.lit(""))
    keyed = asked.select(
        "paper_id", "cite", F.array_join(_names(parts(F.col("plain"), 1)), " ").alias("author"), F.concat(parts(F.col("cite"), 2), parts(F.col("cite"), 3)).alias("year"),
        F.array_join(_names(_nfkc(second)), " ").alias("second"), F.col("cite").rlike(tx.ascii_edges(r"\bet al\.")).alias("many"),
    )
    dated = entries.where("author IS NOT NULL").select("paper_id", "author", "block_order", "authors", F.explode("years").alias("year"))
    fits = F.when(F.col("second") != "", (F.size("authors") == 2) & (F.get("authors", F.lit(1)) == F.col("second"))).otherwise(F.col("many") & (F.size("authors") >= 3))
    met = keyed.where("year <> ''").hint("merge").join(dated.hint("merge"), ["paper_id", "author", "year"])
    found = met.groupBy("paper_id", "cite").agg(
        F.count(F.lit(1)).alias("n"), F.min("block_order").alias("only"), F.count(F.when(fits, 1)).alias("n_fit"), F.min(F.when(fits, F.col("block_order"))).alias("fit")
    )
    one = found.select("paper_id", "cite", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_fit") == 1, F.col("fit")).alias("entry"))
    return cites.join(one.hint("merge"), ["paper_id", "cite"], "left")
