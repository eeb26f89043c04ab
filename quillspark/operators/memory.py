"""Translation memory: validity, coverage, work lists, migration, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .library import newest

CURRENT = ("glossary_version", "prompt_version")


def _kept() -> Column:
    """Whether ``want`` and ``got`` are the same. Within ``let``, as they would be keys of the join else, and ids are what the next join is by, too."""
    return tx.let(F.struct("want", "got"), lambda t: t["want"] == t["got"])


def _with_inline(translations: DataFrame, blocks: DataFrame, how: str) -> DataFrame:
    """Translations with ``got`` and ``want``, the inline content of both sides; texts of blocks are not shuffled for it."""
    have = blocks.select("block_id", tx.inline_tokens(F.col("text")).alias("want"))
    return translations.withColumn("got", tx.inline_tokens(F.col("text"))).join(have.hint("merge"), "block_id", how)


def valid(translations: DataFrame, blocks: DataFrame, orphans: bool = True) -> DataFrame:
    """Translations not blank, without think tags, that preserve inline content; a missing source is not held against them."""
    shown = (F.trim("text") != "") & ~F.contains("text", F.lit("think>"))
    both = _with_inline(translations.where(shown), blocks, "left" if orphans else "inner")
    return both.where(F.col("want").isNull() | _kept()).drop("want", "got")


def current(translations: DataFrame, glossary: int, prompt: int) -> DataFrame:
    return translations.where((F.col("glossary_version") == glossary) & (F.col("prompt_version") == prompt))


def latest(translations: DataFrame, blocks: DataFrame) -> DataFrame:
    return newest(valid(translations, blocks, orphans=False), ["block_id"])


def coverage(blocks: DataFrame, translations: DataFrame, glossary: int, prompt: int) -> DataFrame:
    """(paper_id, total, done) over paragraphs and headings."""
    units = blocks.where(F.col("kind").isin("para", "heading"))
    done = valid(current(translations, glossary, prompt), blocks).select("block_id").distinct().withColumn("ok", F.lit(1))
    return units.join(done.hint("merge"), "block_id", "left").groupBy("paper_id").agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("done"))


def work_list(blocks: DataFrame, translations: DataFrame, glossary: int, prompt: int, skip: Column) -> DataFrame:
    """Units without a valid translation; action is identity for those that need none, else translate."""
    have = valid(current(translations, glossary, prompt), blocks).select("block_id").distinct()
    todo = blocks.where(F.col("kind").isin("para", "heading")).join(have.hint("merge"), "block_id", "left_anti")
    return todo.select("block_id", "doc_id", "block_order", F.when(skip, "identity").otherwise("translate").alias("action"))


def with_content(blocks: DataFrame) -> DataFrame:
    """Blocks with ``content``, the digest of their text."""
    return blocks.withColumn("content", F.unhex(F.sha1("text")))


def migrate(translations: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, block_id, glossary_version, prompt_version, rule) after blocks were cut anew.

    A translation goes to the block of its paper with the same, unique content; else it stays if its id still has
    that content; else it stays only if its id is free. On a conflict the better rule, then the smaller old id wins.
    Blocks that have ``content`` (``with_content``) are compared by it, others by the digest that is made of their text here.
    """
    # texts stay where they are read: their digests and their inline content, which most have none of, are all that is shuffled of them
    old, new = [b if "content" in b.columns else with_content(b) for b in (old, new)]
    inline = tx.inline_tokens(F.col("text"))
    said = translations.select(F.col("block_id").alias("old_id"), *CURRENT, inline.alias("got"))
    was = old.select(F.col("block_id").alias("old_id"), "paper_id", "content", inline.alias("want"))
    now = new.select(F.col("block_id").alias("old_id"), F.col("content").alias("now"))
    same = Window.partitionBy("paper_id", "content")
    alone = new.select("paper_id", "content", F.col("block_id").alias("to")).withColumn("n", F.count(F.lit(1)).over(same)).where("n = 1").drop("n")
    rows = said.join(was.hint("merge"), "old_id").where(_kept()).drop("want", "got").join(now.hint("merge"), "old_id", "left")
    rows = rows.join(alone.hint("merge"), ["paper_id", "content"], "left")
    rule = F.when(F.col("to").isNotNull(), 1).when(F.col("now") == F.col("content"), 2).when(F.col("now").isNull(), 3)
    placed = rows.withColumn("rule", rule).where("rule IS NOT NULL")
    placed = placed.withColumn("block_id", F.when(F.col("rule") == 1, F.col("to")).otherwise(F.col("old_id")))
    w = Window.partitionBy("block_id", *CURRENT).orderBy("rule", "old_id")
    return placed.withColumn("r", F.row_number().over(w)).where("r = 1").select("old_id", "block_id", *CURRENT, "rule")


def untitled(papers: DataFrame, titles: DataFrame, lang: str, batch: int = 30) -> DataFrame:
    """(id, title, batch) of papers whose current title has no translation into ``lang``."""
    have = titles.where(F.col("lang") == lang).select(F.col("paper_id").alias("id"), F.col("source").alias("title"))
    todo = papers.where("title <> ''").join(have.hint("merge"), ["id", "title"], "left_anti").select("id", "title")
    bucket = F.pmod(F.xxhash64("id"), F.lit(64))
    return todo.withColumn("bucket", bucket).withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1) / batch)).select("id", "title", "bucket", "batch")


def placeholder_numbers(text: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit(tx.PLACEHOLDER), 1), lambda n: n.cast("int"))
    return F.when(F.contains(text, F.lit("⟦f")), numbers).when(text.isNotNull(), F.array().cast("array<int>"))


def repaired(source: Column, translated: Column) -> Column:
    """Invented placeholders dropped, missing ones put before the final stop."""
    want, got = placeholder_numbers(source), placeholder_numbers(translated)
    bare = F.aggregate(F.array_except(got, want), translated, lambda t, n: F.replace(t, F.concat(F.lit("⟦f"), n.cast("string"), F.lit("⟧")), F.lit("")))
    missing = F.array_join(F.transform(F.array_except(want, got), lambda n: F.concat(F.lit("⟦f"), n.cast("string"), F.lit("⟧"))), "")
    stop = F.regexp_extract(bare, r"([。．.！!？?]\s*)$", 1)
    return F.when(missing == "", bare).otherwise(F.concat(F.substring(bare, F.lit(1), F.char_length(bare) - F.char_length(stop)), missing, stop))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)^.*</think>", ""))


def failures(translations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(reason, n): why translations are not valid."""
    early = F.when(F.trim("text") == "", "empty").when(F.contains("text", F.lit("think>")), "thinking")
    both = _with_inline(translations.select("block_id", "text", early.alias("early")), blocks, "left")
    reason = F.coalesce("early", F.when(~_kept(), "inline"))
    return both.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# The mark between the parts of a unit, and languages in the order in which versions of the instructions are numbered.
PAGE_BREAK = "⟦pb⟧"
TARGETS = ("zh", "en", "ja", "ko", "de", "fr", "es")


def version_key(base: Column, lang: Column) -> Column:
    """The version of the instructions for a language: a thousand of numbers for each; an unknown language counts as the first."""
    return base + 1000 * (F.greatest(F.array_position(F.array(*[F.lit(x) for x in TARGETS]), lang), F.lit(1)) - 1)


def restored(text: Column, formulas: Column) -> Column:
    """The text with its placeholders replaced by ``formulas`` (map of number and text); those that it does not know go."""
    pieces = F.split(text, tx.PLACEHOLDER, -1)
    values = F.transform(placeholder_numbers(text), lambda n: F.coalesce(F.try_element_at(formulas, n), F.lit("")))
    return F.array_join(F.zip_with(pieces, values, lambda piece, v: F.concat(piece, F.coalesce(v, F.lit("")))), "")


def joined_units(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the parts (keys, block_order, text) of a unit in order with page breaks between; placeholders count on from part to part."""
    before = Window.partitionBy(*keys).orderBy("block_order").rowsBetween(Window.unboundedPreceding, -1)
    most = F.greatest(F.coalesce(F.array_max(placeholder_numbers(F.col("text"))), F.lit(0)), F.lit(0))
    placed = parts.withColumn("most", most).withColumn("offset", F.coalesce(F.sum("most").over(before), F.lit(0)))
    marks = F.transform(placeholder_numbers(F.col("text")), lambda n: F.concat(F.lit("⟦f"), (n + F.col("offset")).cast("string"), F.lit("⟧")))
    shifted = F.array_join(F.zip_with(F.split("text", tx.PLACEHOLDER, -1), marks, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
    listed = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_order", shifted.alias("text")))).alias("parts"))
    return listed.select(*keys, F.array_join("parts.text", f" {PAGE_BREAK} ").alias("text"))


def batch_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, text) of answers (keys, text) whose parts begin with 【n】 at a line's start; blank parts give none, of equal numbers the last counts."""
    return _parts(answers, keys, r"(?ms)^【(\d{1,9})】[ \t]*(.*?)(?=^【\d+】|\z)")


def outline_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The same of lines "n) title" (or with another sign behind the number); lines of another form are left out."""
    return _parts(answers, keys, r"(?m)^[^\S\n]*(\d{1,9})[^\S\n]*[)）.、．]([^\n]+)$")


def _parts(answers: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    group = lambda g: F.regexp_extract_all("text", F.lit(pattern), g)
    rows = answers.select(*keys, F.posexplode(F.arrays_zip(group(1).alias("n"), group(2).alias("text"))).alias("at", "part"))
    said = rows.select(*keys, "at", F.col("part.n").cast("long").alias("n"), F.regexp_replace("part.text", r"\A\s+|\s+\z", "").alias("text")).where("text <> ''")
    return said.groupBy(*keys, "n").agg(F.max_by("text", "at").alias("text"))


def repaired_marks(source: Column, translated: Column) -> Column:
    """The translation with the source's script marks: of each as many as the source has, from the left; others lose their signs, missing ones come before the final stop."""
    marks = lambda c: F.regexp_extract_all(c, F.lit(tx.SCRIPT_MARK), 0)
    times = lambda among, m: F.size(F.filter(among, lambda x: x == m))

    def made(pair: Column) -> Column:
        want, got = pair["want"], pair["got"]
        kept = F.transform(got, lambda m, i: F.when(times(F.slice(got, F.lit(1), i + 1), m) <= times(want, m), m).otherwise(F.substring(m, F.lit(2), F.char_length(m) - 2)))
        text = F.array_join(F.zip_with(F.split(translated, tx.SCRIPT_MARK, -1), kept, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
        missing = F.array_join(F.transform(F.array_distinct(want), lambda m: F.repeat(m, F.greatest(times(want, m) - times(got, m), F.lit(0)))), "")
        return tx.let(F.struct(text.alias("text"), F.regexp_extract(text, r"[。．.！!？?]\s*\z", 0).alias("stop"), missing.alias("missing")), _before_stop)

    return tx.let(F.struct(marks(source).alias("want"), marks(translated).alias("got")), made)


def _before_stop(t: Column) -> Column:
    return F.concat(F.substring(t["text"], F.lit(1), F.char_length(t["text"]) - F.char_length(t["stop"])), t["missing"], t["stop"])
