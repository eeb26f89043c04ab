"""Gates: whether a model's output is a translation, a title, a digest; ids printed on a first page; lines to paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def without_meta(out: Column) -> Column:
    """The output behind think blocks and behind the last announcement of a translation."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(out, fixed.THINK_BLOCK, ""), fixed.THINK_REST, ""))
    told = F.trim(F.element_at(F.split(bare, fixed.META_MARK, -1), -1))
    return F.trim(F.regexp_replace(told, fixed.META_LABEL, ""))


def _names(source: Column) -> Column:
    """Sources that stay as they are: entries of a bibliography and lists of names."""
    words = tx.count(source, r"\S+")
    capitals = tx.count(source, r"(?<!\S)[A-Z]")
    many = (tx.count(source, ",") >= fixed.NAMES_IN_LIST) & (capitals >= fixed.NAMES_SHARE * F.greatest(words, F.lit(1)))
    initials = tx.count(source, tx.ascii_edges(fixed.INITIALS)) >= fixed.NAMES_IN_LIST
    return source.rlike(fixed.LISTED_ENTRY) | tx.reference_entry(source) | initials | many


def _no_chinese(source: Column, out: Column) -> Column:
    """Evidence in a long source's output: no Han sign, the source's opening copied, too few Han signs for its prose."""
    han = tx.count(out, fixed.HAN)
    prose = F.char_length(F.array_join(F.regexp_extract_all(source, F.lit(tx.ascii_edges(r"\b[a-z]{2,}\b")), 0), ""))
    head = F.substring(F.trim(source), 1, fixed.COPIED_HEAD)
    copied = F.contains(out, head) & (F.char_length(head) >= fixed.COPIED_LEAST) & (tx.count(head, tx.ascii_edges(r"\b[a-z]{3,}\b")) >= fixed.COPIED_WORDS)
    found = [han == 0, copied, (prose >= fixed.LONG_SOURCE) & (han < prose * fixed.PROSE_SHARE)]
    return (tx.count(source, "[A-Za-z]") >= fixed.LONG_SOURCE) & ~_names(source) & reduce(Column.__or__, found)


def not_translation(source: Column, out: Column, lang: str) -> Column:
    """Blank, thinking aloud, or not in the script that ``lang`` is written in, as far as the source is long enough to tell."""
    s, o = tx.script_counts(source), tx.script_counts(out)
    foreign = s["han"] + s["kana"] + s["hangul"]
    wrong = {
        "zh": lambda: _no_chinese(source, out),
        "ja": lambda: (foreign + s["latin"] >= fixed.LONG_SOURCE) & (o["kana"] < fixed.NATIVE_SIGNS),
        "ko": lambda: (foreign + s["latin"] >= fixed.LONG_SOURCE) & (o["hangul"] < fixed.NATIVE_SIGNS),
    }.get(lang, lambda: (foreign >= fixed.FOREIGN_SOURCE) & (o["latin"] < foreign * fixed.FOREIGN_SHARE))
    return (tx.collapse(out) == "") | out.rlike(fixed.THINK_TAG) | wrong()


def title_translation(source: Column, out: Column, lang: str) -> Column:
    """A title's output that says something else than the title and is in the script of ``lang``."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s\p{P}]+", ""))
    o = tx.script_counts(out)
    native = {"zh": o["han"], "ja": o["kana"] + o["han"], "ko": o["hangul"]}.get(lang)
    right = native > 0 if native is not None else tx.preserves_inline(source, out) & ~not_translation(source, out, lang)
    return (F.coalesce(out, F.lit("")) != "") & (key(out) != key(source)) & right


def in_target_script(text: Column, lang: str) -> Column:
    c = tx.script_counts(text)
    han, latin = tx.count(text, fixed.HAN), tx.count(text, "[A-Za-z]")
    told = {"zh": (han >= fixed.CHINESE_LEAST) & (han >= latin * fixed.CHINESE_SHARE), "ja": c["kana"] >= fixed.NATIVE_SIGNS, "ko": c["hangul"] >= fixed.NATIVE_SIGNS}
    return told.get(lang, (latin >= fixed.LATIN_LEAST) & (latin >= han * fixed.LATIN_SHARE))


def echoes(text: Column, context: Column, window: int = 40) -> Column:
    """One of the text's windows (start, middle, end; a short text as a whole) is in the context, white space folded."""
    t, among = tx.collapse(text), tx.collapse(context)
    spare = F.greatest(F.char_length(t) - window, F.lit(0))
    starts = F.array(F.lit(1), F.floor(spare / 2).cast("int") + 1, spare + 1)
    return (t != "") & F.exists(F.transform(starts, lambda i: F.substring(t, i, F.lit(window))), lambda w: F.contains(among, w))


def digest(text: Column, context: Column, lang: str) -> Column:
    return in_target_script(text, lang) & ~echoes(text, context)


def printed_ids(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, arxiv_id, stamped, doi) of papers (id, arxiv_id) from the blocks (paper_id, page, block_order, text) of their first pages.

    The first printed arXiv id counts unless another is stored; a stamp has a subject behind the id.
    """
    first = blocks.where("page <= 1").select("paper_id", "block_order", F.nullif(F.regexp_extract("text", fixed.ARXIV_STAMP_ID, 1), F.lit("")).alias("arxiv"), (F.col("text").rlike(fixed.ARXIV_STAMP) & (F.col("page") == 1)).alias("stamp"), F.nullif(F.regexp_extract("text", tx.ascii_edges(fixed.PRINTED_DOI), 0), F.lit("")).alias("doi"))
    least = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("block_order", c)))[c].alias(c)
    found = first.groupBy("paper_id").agg(least("arxiv"), F.max("stamp").alias("stamped"), least("doi"))
    base = lambda c: F.regexp_replace(c, r"v\d+$", "")
    both = papers.select("id", F.col("arxiv_id").alias("stored")).join(found.withColumnRenamed("paper_id", "id").hint("merge"), "id", "left")
    own = F.when(F.col("arxiv").isNotNull() & F.coalesce(base("arxiv") == base("stored"), F.lit(True)), F.col("arxiv")).otherwise(F.col("stored"))
    return both.select("id", own.alias("arxiv_id"), F.coalesce("stamped", F.lit(False)).alias("stamped"), F.regexp_replace("doi", fixed.AFTER_DOI, "").alias("doi"))


def body_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): the font size, to half points, that most characters have; of equals the one met first."""
    bucket = F.floor(F.col("size") * 2 + 0.5) / 2
    weight = lines.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(F.char_length("text")).alias("n"), F.min("block_order").alias("first"))
    return weight.groupBy(*keys).agg(F.max_by("bucket", F.struct("n", -F.col("first"))).alias("body"))


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, block_order, text, size, y, heading) with ``paragraph``: a new one after a gap that is none or wide, and at headings."""
    w = Window.partitionBy(*keys).orderBy("block_order")
    spaced = lines.join(body_size(lines, keys).hint("merge"), keys).withColumn("gap", F.lag("y").over(w) - F.col("y"))
    usual = F.when((F.col("gap") > 0) & (F.col("gap") < fixed.GAP_LIMIT * F.col("body")), F.col("gap"))
    pitch = spaced.groupBy(*keys).agg(F.coalesce(F.median(usual), fixed.PITCH * F.max("body")).alias("pitch"))
    begins = F.col("gap").isNull() | (F.col("gap") <= 0) | (F.col("gap") > fixed.PARAGRAPH_GAP * F.col("pitch")) | F.col("heading") | F.lag("heading").over(w)
    told = spaced.join(pitch.hint("merge"), keys).withColumn("new", begins.cast("int"))
    return told.withColumn("paragraph", F.sum("new").over(w)).select(*lines.columns, "paragraph")


def boxes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the boxes (x, y, width, height) of each group, and how many there are."""
    edge = {"x0": F.min("x"), "y0": F.min("y"), "x1": F.max(F.col("x") + F.col("width")), "y1": F.max(F.col("y") + F.col("height"))}
    return lines.groupBy(*keys).agg(*[c.alias(k) for k, c in edge.items()], F.count(F.lit(1)).alias("n"))
