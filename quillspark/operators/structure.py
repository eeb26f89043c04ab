"""Sections, budgets, chains and batches of a document's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx

REFERENCES = fixed.REFERENCES_HEADING


def order_of(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("block_order")


def with_section(blocks: DataFrame) -> DataFrame:
    """Section of each block: the latest heading at or above it."""
    heading = F.when(F.col("kind") == "heading", F.col("text"))
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(order_of()))


def section_leads(blocks: DataFrame, least: int = 40, budget: int = 6000) -> DataFrame:
    """The first paragraph of each section with at least ``least`` characters, in order, until the budget is over."""
    fit = blocks.where((F.col("kind") == "para") & F.col("section").isNotNull() & (F.char_length("text") >= least))
    first = fit.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("block_order"))).where("r = 1").drop("r")
    return within_budget(first, F.char_length("text"), budget)


def within_budget(rows: DataFrame, size: Column, budget: int) -> DataFrame:
    used = F.sum(size).over(order_of().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used.cast("long")).where(F.col("used") <= budget)


def even_sample(blocks: DataFrame, k: int = 5) -> DataFrame:
    """Every step-th block, at most ``k``."""
    w = Window.partitionBy("doc_id")
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / k))
    at = F.row_number().over(order_of()) - 1
    return blocks.withColumn("at", at).withColumn("step", step).where((F.col("at") % F.col("step") == 0) & (F.col("at") / F.col("step") < k)).drop("at", "step")


def duplicate_counter(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("dup", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def fragment_runs(blocks: DataFrame, is_fragment: Column) -> DataFrame:
    """Runs of consecutive fragments on one page become one row."""
    w, own = Window.partitionBy("doc_id", "page").orderBy("block_order"), Window.partitionBy("doc_id", "page", "fragment").orderBy("block_order")
    flagged = blocks.withColumn("fragment", is_fragment).withColumn("island", F.row_number().over(w) - F.row_number().over(own))
    runs = flagged.where("fragment").groupBy("doc_id", "page", "island")
    return runs.agg(F.min("block_order").alias("block_order"), F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"]), " ").alias("text")).drop("island")


def outline(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'heading'").select("doc_id", "block_order", "page", F.col("text").alias("title"))


def chains(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_order, chain): paragraphs that go on across a page or a float share the first one's order.

    Figures are floats: they are skipped, but noted as crossed. A link needs an open end before, an open start after,
    and a page break or a float between. Headings end a chain.
    """
    w = order_of()
    crossed = blocks.withColumn("floats", F.sum(F.when(F.col("kind") == "figure", 1).otherwise(0)).over(w))
    flow = crossed.where("kind <> 'figure'")
    prior = lambda c: F.lag(c).over(w)
    parted = (prior("page") != F.col("page")) | (prior("floats") != F.col("floats"))
    # texts are read where the rest holds
    linked = (F.col("kind") == "para") & (prior("kind") == "para") & parted & tx.starts_mid_sentence(F.col("text")) & tx.ends_mid_sentence(prior("text"))
    marked = flow.withColumn("head", F.when(~F.coalesce(linked, F.lit(False)), F.col("block_order")))
    chained = marked.select("doc_id", "block_order", "kind", F.last("head", ignorenulls=True).over(w).alias("chain"))
    return chained.where("kind = 'para'").drop("kind")


def batches(paras: DataFrame, chars: int = 2600, most: int = 6) -> DataFrame:
    """(doc_id, block_order, batch): paragraphs in order, greedily put together within both limits; documents in parallel."""
    start = F.struct(F.array().cast("array<struct<o:bigint,b:bigint>>").alias("out"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["c"] + x["size"] > chars) | (acc["n"] >= most))
        b = F.when(full, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(x["block_order"].alias("o"), b.alias("b")))).alias("out"), b.alias("b"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).cast("long").alias("n"), F.when(full, x["size"]).otherwise(acc["c"] + x["size"]).cast("long").alias("c"),
        )

    listed = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_order", F.char_length("text").cast("long").alias("size")))).alias("xs"))
    folded = listed.select("doc_id", F.explode(F.aggregate("xs", start, step)["out"]).alias("e"))
    return folded.select("doc_id", F.col("e.o").alias("block_order"), F.col("e.b").alias("batch"))


def in_references(section: Column) -> Column:
    return F.coalesce(section.rlike(REFERENCES), F.lit(False))


def summary_context(blocks: DataFrame, budget: int = 6000) -> DataFrame:
    """Headings and the first paragraph under each; documents without headings give all paragraphs; each part costs one more."""
    has = F.max(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "section", "kind").orderBy("block_order"))
    marked = blocks.where("kind <> 'figure'").withColumn("has", has).withColumn("first", first)
    kept = marked.where("has = 0 OR kind = 'heading' OR (first = 1 AND section IS NOT NULL)").drop("has", "first")
    return within_budget(kept, F.char_length("text") + 1, budget)


# How many letters make a key of a text's beginning, and how many it has to have.
KEY_LETTERS, KEY_LEAST = 48, 12


def beginning_key(text: Column) -> Column:
    """The first letters of a text, without placeholders, marks and a section's number."""
    bare = F.regexp_replace(F.regexp_replace(text, r"⟦f\d+⟧|\*\*|[*^~]", ""), r"^\s*(?:[A-Z]|\d+)(?:\.\d+)*\.?\s+", "")
    return F.left(F.regexp_replace(F.lower(bare), "[^a-z]+", ""), F.lit(KEY_LETTERS))


def placed_units(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, unit_order, block_order, page): where units (paper_id, unit_order, text) of another edition stand among a paper's blocks.

    A unit stands where the first paragraph or heading with its beginning does; one without such a block stands where
    the unit before it does, the first ones at the paper's first block. Papers without blocks place nothing.
    """
    key = beginning_key(F.col("text"))
    first = blocks.where(F.col("kind").isin("para", "heading")).select("paper_id", key.alias("key"), "page", "block_order").where(F.length("key") >= KEY_LEAST)
    first = first.groupBy("paper_id", "key").agg(F.min(F.struct("page", "block_order")).alias("at"))
    start = blocks.groupBy("paper_id").agg(F.min(F.struct("page", "block_order"))["block_order"].alias("start"))
    keyed = units.select("paper_id", "unit_order", F.when(F.length(key) >= KEY_LEAST, key).alias("key")).join(start.hint("merge"), "paper_id")
    met = keyed.join(first.hint("merge"), ["paper_id", "key"], "left")
    carried = F.last("at", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("unit_order"))
    placed = met.withColumn("at", carried)
    return placed.select("paper_id", "unit_order", F.coalesce("at.block_order", "start").alias("block_order"), F.coalesce("at.page", F.lit(1)).alias("page"))
