"""Notes on papers: files, anchors found again after a new reading of the paper, free ids, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .fingerprint import hamming, simhash

NEAR = 12  # bits of 64 in which fingerprints of one paragraph may differ
ANCHOR = "block_id string, char_start bigint, char_end bigint, excerpt string"


#: An anchor whose parts are lines of their own.
BLOCK_ANCHOR = r"(?m)^  (a\d+):[ \t]*\n((?:(?:    .*|[ \t]*)(?:\n|\z))+)"


def scalar(value: Column) -> Column:
    """The string that a YAML scalar stands for: plain, in single or double quotes, or a block (| or >); lines that go on are folded."""
    text = F.regexp_replace(value, r"\A[ \t]+|\s+\z", "")
    folded = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?<!\n)\n[ \t]*(?![ \t]*\n)", " "), r"\n[ \t]*(?:\n[ \t]*)", "\n")
    block = F.regexp_replace(F.regexp_replace(text, r"\A[|>][-+]?[ \t]*\n", ""), r"(?m)^      ", "")
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), folded(F.regexp_replace(text, r"\\\n[ \t]*", "")), F.lit("}")), "$.v")
    single = F.regexp_replace(F.regexp_replace(folded(text), r"\A'|'\z", ""), "''", "'")
    return F.when(text.rlike(r"\A\|"), block).when(text.rlike(r"\A>"), folded(block)).when(F.startswith(text, F.lit('"')), quoted).when(F.startswith(text, F.lit("'")), single).otherwise(folded(text))


def block_anchor(lines: Column) -> Column:
    """An anchor (``ANCHOR``) out of lines "    name: value"; values may go on over deeper lines."""
    value = lambda name: F.regexp_extract(lines, rf"(?ms)^    {name}:(.*?)(?=^    \S|\z)", 1)
    made = [F.when(value(name) != "", scalar(value(name))).cast(kind).alias(name) for name, kind in (part.split() for part in ANCHOR.split(", "))]
    return F.when(lines.isNotNull(), F.struct(*made))


def note_files(notes: DataFrame) -> DataFrame:
    """(paper_id, content): a Markdown document for each paper of notes (paper_id, title, n, block_id, char_start, char_end, excerpt, stamp, text).

    The front matter gives each note's anchor as a flow mapping; the notes follow in order of their numbers.
    """
    anchor = F.to_json(F.struct(*[F.col(part.split()[0]) for part in ANCHOR.split(", ")]))
    line = F.concat(F.lit("  a"), F.col("n").cast("string"), F.lit(": "), anchor)
    section = F.concat(F.lit("\n## a"), F.col("n").cast("string"), F.lit(" · "), "stamp", F.lit("\n\n"), F.rtrim("text"), F.lit("\n"))
    listed = notes.groupBy("paper_id").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("n", line.alias("line"), section.alias("section")))).alias("notes"))
    quoted = F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), r"\\", r"\\\\"), '"', r'\\"')
    head = F.concat(F.lit("---\npaper: "), F.col("paper_id").cast("string"), F.lit('\ntitle: "'), quoted, F.lit('"\nanchors:\n'), F.array_join("notes.line", "\n"), F.lit("\n---\n"))
    return listed.select("paper_id", F.concat(head, F.array_join("notes.section", "")).alias("content"))


def note_entries(files: DataFrame) -> DataFrame:
    """(paper_id, anchor_id, stamp, text, anchor): the entries of note files; a heading of another kind ends one and begins none.

    ``anchor`` is null where the front matter has none of that id, be it in flow form or as a block of lines. Files without a closed front matter give nothing.
    """
    parts = files.select("paper_id", F.regexp_extract("content", r"(?s)\A---[ \t]*\n(.*?\n)---\n", 1).alias("front"), F.regexp_extract("content", r"(?s)\A---[ \t]*\n.*?\n---\n(.*)\z", 1).alias("body")).where("front <> ''")
    section = r"(?ms)^## (a\d+) · ([^\n]+)$(.*?)(?=^## |\z)"
    group = lambda text, pattern, g: F.regexp_extract_all(text, F.lit(pattern), g)
    anchors = F.map_from_entries(F.arrays_zip(group("front", r"(?m)^  (a\d+): (\{.*\})$", 1), group("front", r"(?m)^  (a\d+): (\{.*\})$", 2)))
    told = F.map_from_entries(F.arrays_zip(group("front", BLOCK_ANCHOR, 1), group("front", BLOCK_ANCHOR, 2)))
    every = F.arrays_zip(group("body", section, 1).alias("anchor_id"), group("body", section, 2).alias("stamp"), group("body", section, 3).alias("text"))
    rows = parts.select("paper_id", anchors.alias("anchors"), told.alias("told"), F.explode(every).alias("e"))
    text = F.regexp_replace("e.text", r"\A\s+|\s+\z", "")
    return rows.select("paper_id", "e.anchor_id", F.trim("e.stamp").alias("stamp"), text.alias("text"), F.coalesce(F.from_json(F.try_element_at("anchors", "e.anchor_id"), ANCHOR), block_anchor(F.try_element_at("told", "e.anchor_id"))).alias("anchor"))


def relocated(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, anchor_id, block_id): anchors (paper_id, anchor_id, excerpt) in the blocks (paper_id, block_id, block_order, text) of a new reading.

    The paper's first block with the same text (case and white space aside); else the one whose fingerprint is nearest, the
    first of equals, if at most 12 bits differ; else null. Only what has no equal text meets the other blocks of its paper.
    """
    same = lambda c: F.lower(tx.collapse(F.col(c))).alias("same")
    first = blocks.groupBy("paper_id", same("text")).agg(F.min_by("block_id", "block_order").alias("exact"))
    asked = anchors.select("paper_id", "anchor_id", "excerpt", same("excerpt")).join(first.hint("merge"), ["paper_id", "same"], "left")
    keyed = lambda df, key, text: df.select(*key, F.struct(*key).alias("key"), F.col(text).alias("text"))
    prints = lambda df, key, text: simhash(keyed(df, key, text).select("key", "text"), "key").select("key.*", F.col("simhash"))
    loose = prints(asked.where("exact IS NULL"), ["paper_id", "anchor_id"], "excerpt").withColumnRenamed("simhash", "wanted")
    offered = prints(blocks, ["paper_id", "block_id", "block_order"], "text")
    apart = loose.join(offered.hint("merge"), "paper_id").withColumn("apart", hamming(F.col("wanted"), F.col("simhash"))).where(F.col("apart") <= NEAR)
    nearest = apart.groupBy("paper_id", "anchor_id").agg(F.min_by("block_id", F.struct("apart", "block_order")).alias("near"))
    return asked.join(nearest.hint("merge"), ["paper_id", "anchor_id"], "left").select("paper_id", "anchor_id", F.coalesce("exact", "near").alias("block_id"))


def numbered(notes: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (paper_id, at, ...) with ``n``: in order of ``at`` the numbers from 1 on that ``notes`` (paper_id, n) leave free in the paper.

    A free number is one more than a number in use, or 1, plus what the gap has room for: gaps are rows, numbers are not.
    """
    w = Window.partitionBy("paper_id").orderBy("n")
    ends = notes.select("paper_id", "n").unionByName(new.select("paper_id", F.lit(0).cast("long").alias("n")).distinct()).distinct()
    gaps = ends.withColumn("room", F.coalesce(F.lead("n").over(w) - F.col("n") - 1, F.lit(1 << 40)))
    before = F.sum("room").over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = gaps.where("room > 0").select("paper_id", "n", "room", F.coalesce(before, F.lit(0)).alias("before"))
    turn = new.withColumn("turn", F.row_number().over(Window.partitionBy("paper_id").orderBy("at")))
    # numbers and gaps of a paper on one line: each number takes the last gap that begins before it
    line = placed.select("paper_id", F.col("before").alias("place"), F.lit(0).alias("is_new"), (F.col("n") - F.col("before")).alias("shift"), F.lit(None).cast(turn.select(F.struct(*turn.columns)).schema[0].dataType).alias("row"))
    line = line.unionByName(turn.select("paper_id", (F.col("turn") - 1).cast("long").alias("place"), F.lit(1).alias("is_new"), F.lit(None).cast("long").alias("shift"), F.struct(*turn.columns).alias("row")))
    carried = F.last("shift", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("place", "is_new"))
    return line.withColumn("shift", carried).where("is_new = 1").select("row.*", (F.col("row.turn") + F.col("shift")).alias("n")).drop("turn")


def removed(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """Notes without those that ``gone`` (paper_id, n) names."""
    return notes.join(gone.select("paper_id", "n").distinct().hint("merge"), ["paper_id", "n"], "left_anti").select(*notes.columns)


def newest(notes: DataFrame) -> DataFrame:
    """Notes with ``place``: a paper's newest comes first, of one moment the higher number."""
    return notes.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("stamp"), F.desc("n"))))


def listing(notes: DataFrame, papers: DataFrame, most: int = 60) -> DataFrame:
    """(place, title, excerpt, text): the first ``most`` notes of all papers, papers last used and newest notes first, to be read against each other; nothing if there is one note only."""
    recent = F.coalesce("last_opened_at", "added_at").alias("recent")
    titled = notes.join(papers.select(F.col("id").alias("paper_id"), "title", recent).hint("merge"), "paper_id")
    order = [F.desc("recent"), "paper_id", F.desc("stamp"), F.desc("n")]
    first = titled.orderBy(*order).limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))  # of ``most`` rows
    return placed.where("all >= 2").select("place", "title", "excerpt", "text")
