"""Papers, blocks and ledgers as tables: filters, orders, merges and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

# --- filters


def search(papers: DataFrame, text: str, columns: list[str]) -> DataFrame:
    q = text.strip().lower()
    if not q:
        return papers
    return papers.where(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: F.coalesce(F.contains(F.lower(x), F.lit(q)), F.lit(False))))


def collection(papers: DataFrame, name: str) -> DataFrame:
    wanted = {"unread": "new", "reading": "reading", "done": "done"}.get(name)
    return papers if wanted is None else papers.where(F.col("status") == wanted)


def tagged(papers: DataFrame, tag: str) -> DataFrame:
    return papers.where(F.array_contains(F.array("tag1", "tag2"), tag))


def find(blocks: DataFrame, translations: DataFrame, text: str) -> DataFrame:
    """Blocks whose source or newest translation contains ``text``, in any case."""
    q = text.lower()
    both = blocks.join(newest(translations, ["block_id"]).select("block_id", F.col("text").alias("translated")).hint("merge"), "block_id", "left")
    return both.where(F.contains(F.lower("text"), F.lit(q)) | F.coalesce(F.contains(F.lower("translated"), F.lit(q)), F.lit(False)))


def lookup_due(papers: DataFrame, looked_up: Column, now: Column, days: int = 30) -> DataFrame:
    return papers.where(looked_up.isNull() | (looked_up < now - F.lit(days * 86_400_000)))


def stale_layouts(papers: DataFrame, version: Column, state: Column, current: int) -> DataFrame:
    return papers.withColumn("layout_state", F.when((state == "done") & (version < current), "pending").otherwise(state))


# --- orders


def shelf(papers: DataFrame, by: str = "opened") -> DataFrame:
    last = F.coalesce("last_opened_at", "added_at")
    key = {"opened": [last.desc()], "added": [F.col("added_at").desc()], "title": [F.lower("title").asc()], "year": [F.col("year").desc_nulls_last()]}[by]
    return papers.orderBy(F.col("pinned_at").desc_nulls_last(), *key, last.desc(), "id")


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a sorted table with their place from 1 on: places inside partitions and the sizes of the partitions before, so no task sees all rows."""
    kept = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))  # partition and row, as they were sorted
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + inside + 1).alias(name))


def top_by(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


# --- merges


def newest(rows: DataFrame, keys: list[str], at: str = "created_at", ties: tuple[str, ...] = ("glossary_version", "prompt_version")) -> DataFrame:
    """The latest row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(at, *[c for c in ties if c in rows.columns])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows by id; a known row keeps a hand-edited title, else takes the new value where there is one."""
    both = old.alias("o").join(new.alias("n").hint("merge"), "id", "full_outer")
    fresh = F.coalesce("n.title", "o.title")
    return both.select("id", F.when(F.col("o.meta_edited"), F.col("o.title")).otherwise(fresh).alias("title"), F.coalesce("n.year", "o.year").alias("year"), F.coalesce("o.status", F.lit("new")).alias("status"), F.coalesce("o.added_at", "n.added_at").alias("added_at"), F.coalesce("o.meta_edited", F.lit(False)).alias("meta_edited"))


def upsert_translations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Text and model of the new rows; the first creation time stays."""
    keys = ["block_id", "glossary_version", "prompt_version"]
    both = old.alias("o").join(new.alias("n").hint("merge"), keys, "full_outer")
    return both.select(*keys, F.coalesce("n.model", "o.model").alias("model"), F.coalesce("n.text", "o.text").alias("text"), F.coalesce("o.created_at", "n.created_at").alias("created_at"))


def replace_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All blocks of the papers in ``new`` are replaced."""
    return old.join(new.select("paper_id").distinct().hint("merge"), "paper_id", "left_anti").select(*old.columns).unionByName(new)


def append_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks with known ids are ignored."""
    return old.unionByName(new.join(old.select("block_id").hint("merge"), "block_id", "left_anti").select(*old.columns))


def delete_papers(table: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """Rows of a table that do not belong to the papers (paper_id) in ``gone``."""
    return table.withColumn("owner", key).join(gone.select(F.col("paper_id").alias("owner")).distinct().hint("merge"), "owner", "left_anti").select(*table.columns)


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored paths that no table refers to; deleting them is the caller's."""
    return stored.join(referenced.select("path").distinct().hint("merge"), "path", "left_anti")


# --- counts


def tag_counts(papers: DataFrame) -> DataFrame:
    tags = papers.select("id", F.explode(F.array_distinct(F.array("tag1", "tag2"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def repeated_lines(lines: DataFrame, page: str, doc: str, key: Column) -> DataFrame:
    """(doc, key, pages) of normalised lines on at least max(3, half) of a document's pages; none with under three pages."""
    keyed = lines.withColumn("key", key).where(F.col("key") != "")
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("of"))
    seen = keyed.groupBy(doc, "key").agg(F.countDistinct(page).alias("pages"))
    both = seen.join(pages.hint("merge"), doc)
    return both.where((F.col("of") >= 3) & (F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("of") / 2)))).select(doc, "key", "pages")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out
