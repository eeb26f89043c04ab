"""A document's blocks as the items that a reader sees one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..llm.scratch import written
from . import spatial as sp
from . import structure as st

SMALL, LINE_SIGNS, LINE_HEIGHT, LEAST_SIZE, BODY = 0.85, 90, 1.8, 4, 10.0


def body_sizes(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): the upper median of the font sizes of a document's paragraphs, of those over 4; documents without any are left out."""
    sized = blocks.where(f"kind = 'para' AND size > {LEAST_SIZE}")
    doc = Window.partitionBy("doc_id")
    ranked = sized.withColumns({"turn": F.row_number().over(doc.orderBy("size", "block_order")), "n": F.count(F.lit(1)).over(doc)})
    return ranked.where("turn = floor(n / 2) + 1").select("doc_id", F.col("size").cast("double").alias("body"))


def reading_items(blocks: DataFrame) -> DataFrame:
    """(doc_id, place, type, role, blocks): headings, paragraphs with all parts of their chain, and rows of figures, in reading order.

    ``blocks``: doc_id, page, block_order, kind, text, section, x, y, width, height, size. A paragraph's role is ref in a bibliography, caption,
    small (well under the body's size), line (short, of one line and without further parts) or body. Figures that belong
    together are one, neighbouring ones of a page are one item; figures within others and margins are no items.
    """
    # written, as every kind of item reads them, and each reading would make the blocks anew
    blocks = written(blocks.select("doc_id", "page", "block_order", "kind", "text", "section", "x", "y", "width", "height", "size"), "blocks")
    chains = st.chains(blocks.where("kind <> 'margin'"))
    parts = chains.groupBy("doc_id", F.col("chain").alias("block_order")).agg(F.array_sort(F.collect_list("block_order")).alias("blocks"))
    paras = blocks.where("kind = 'para'").join(parts.hint("merge"), ["doc_id", "block_order"]).join(body_sizes(blocks).hint("merge"), "doc_id", "left")
    body = F.coalesce("body", F.lit(BODY))
    line = (F.size("blocks") == 1) & (F.length("text") <= LINE_SIGNS) & (F.col("height") <= F.coalesce("size", body) * LINE_HEIGHT)
    role = F.when(st.in_references(F.col("section")), "ref").when(F.col("text").rlike(fixed.CAPTION), "caption").when(F.col("size") < body * SMALL, "small").when(line, "line").otherwise("body")
    columns = ["doc_id", "page", "block_order", "type", "role", "blocks"]
    none = F.lit(None).cast("string").alias("role")
    told = paras.select("doc_id", "page", "block_order", F.lit("para").alias("type"), role.alias("role"), "blocks")
    heads = blocks.where("kind = 'heading'").select("doc_id", "page", "block_order", F.lit("heading").alias("type"), none, F.array("block_order").alias("blocks"))
    other = blocks.where("kind NOT IN ('para', 'heading', 'figure', 'margin')").select("doc_id", "page", "block_order", F.lit("other").alias("type"), none, F.array("block_order").alias("blocks"))
    clusters = sp.figure_clusters(blocks).groupBy("doc_id", "page", F.col("cluster").alias("block_order")).agg(F.array_sort(F.collect_list("block_order")).alias("blocks"))
    figures = clusters.select("doc_id", "page", "block_order", F.lit("figures").alias("type"), none, "blocks")
    every = told.unionByName(heads).unionByName(other).unionByName(figures).select(columns)
    order = Window.partitionBy("doc_id").orderBy("block_order")
    goes_on = (F.col("type") == "figures") & (F.lag("type").over(order) == "figures") & (F.lag("page").over(order) == F.col("page"))
    item = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order)
    made = every.withColumn("place", item).groupBy("doc_id", "place").agg(F.min_by("type", "block_order").alias("type"), F.min_by("role", "block_order").alias("role"), F.flatten(F.array_sort(F.collect_list(F.struct("block_order", "blocks")))["blocks"]).alias("blocks"))
    return made.select("doc_id", "place", F.when(F.col("type") == "other", "figures").otherwise(F.col("type")).alias("type"), "role", "blocks")
