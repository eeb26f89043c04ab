"""Units of translation: prompts for them, answers cut back to their parts, and what an answer becomes in the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from . import gates
from . import memory as tm

IDENTITY = "identity"
PART = "array<struct<block_order: bigint, text: string>>"


def _cut(parts: Column, out: Column) -> Column:
    """``out`` in as many pieces as there are parts, in proportion to their lengths, cut behind the nearest sign of punctuation."""
    size = F.length(out)
    near = F.greatest(F.lit(fixed.CUT_LEAST), F.floor(size * fixed.CUT_SHARE + 0.5).cast("int"))
    lengths = F.transform(parts, lambda p: F.length(p["text"]))
    total = F.greatest(F.aggregate(lengths, F.lit(0), lambda a, n: a + n), F.lit(1))
    upto = F.transform(F.slice(lengths, F.lit(1), F.size(lengths) - 1), lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, m: a + m))
    stops = F.array_compact(F.transform(F.split(out, ""), lambda c, i: F.when((c != "") & F.contains(F.lit(fixed.CUT_SIGNS), c), i + 1)))

    def pieces(c: Column) -> Column:
        def step(a: Column, target: Column) -> Column:
            low, high = F.greatest(a["at"] + 1, target - c["near"]), F.least(c["size"] - 1, target + c["near"])
            found = F.transform(F.filter(c["stops"], lambda i: (i >= low) & (i <= high)), lambda i: F.struct(F.abs(i - target).alias("by"), i.alias("i")))
            cut = F.least(F.greatest(F.coalesce(F.array_min(found)["i"], target), a["at"] + 1), c["size"])
            return F.struct(cut.cast("int").alias("at"), F.concat(a["out"], F.array(F.substring(out, a["at"] + 1, cut - a["at"]))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        done = F.aggregate(c["targets"], start, step)
        return tx.let(done, lambda d: F.concat(d["out"], F.array(F.substring(out, d["at"] + 1, c["size"]))))

    targets = F.transform(upto, lambda n: F.floor(n / total * size + 0.5).cast("int"))
    return tx.let(F.struct(targets.alias("targets"), stops.alias("stops"), size.alias("size"), near.alias("near")), pieces)


def split_units(parts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_order, source, text, reason): answers (keys, text) to units cut back to their parts (keys, block_order, text).

    Cut at the marks between parts; where these are not one fewer than the parts, in proportion. Placeholders get their part's numbers
    again; placeholders and script marks that a part lacks or has too many are repaired. If a piece is blank (``reason``:
    blank) or can't be repaired (inline), the whole unit fails and its texts are null. A unit without an answer gives nothing.
    """
    units = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("block_order").cast("bigint").alias("block_order"), "text"))).alias("parts"))  # a unit is a chain of a few blocks
    both = units.join(answers.where("text IS NOT NULL").select(*keys, F.col("text").alias("out")).hint("merge"), keys)
    marked = F.split("out", fixed.PART_BREAK, -1)
    # without marks only what is cut without them
    both = both.withColumn("marked", marked).withColumn("plain", F.when(F.size("marked") != F.size("parts"), F.regexp_replace("out", fixed.PART_BREAK, " ")))
    pieces = F.when(F.size("marked") == F.size("parts"), F.col("marked")).otherwise(_cut(F.col("parts"), F.col("plain")))
    rows = both.select(*keys, "parts", pieces.alias("pieces")).select(*keys, F.posexplode(F.arrays_zip("parts", "pieces")).alias("place", "z"))
    unit = Window.partitionBy(*keys)
    own = F.greatest(F.coalesce(F.array_max(tm.placeholder_numbers(F.col("source"))), F.lit(0)), F.lit(0))
    rows = rows.select(*keys, "place", F.col("z.parts.block_order").alias("block_order"), F.col("z.parts.text").alias("source"), F.col("z.pieces").alias("piece")).withColumn("own", own)
    rows = rows.withColumn("before", F.coalesce(F.sum("own").over(unit.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    back = F.transform(tm.placeholder_numbers(F.col("piece")), lambda n: F.when((n - F.col("before") >= 1) & (n - F.col("before") <= F.col("own")), n - F.col("before")).otherwise(0))
    named = F.transform(back, lambda n: F.concat(F.lit("⟦f"), n.cast("string"), F.lit("⟧")))
    renumbered = F.array_join(F.zip_with(F.split("piece", tx.PLACEHOLDER, -1), named, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    # trimmed of what \s is
    rows = rows.withColumn("said", F.trim(F.when(F.contains("piece", F.lit("⟦f")), renumbered).otherwise(F.col("piece")), F.lit(" \t\n\x0b\f\r"))).withColumn("first_said", F.col("said"))
    source, said = F.col("source"), F.col("said")
    rows = rows.withColumn("said", F.when(tx.preserves_inline(source, said), said).otherwise(tm.repaired(source, said)))
    rows = rows.withColumn("said", F.when(tx.preserves_inline(source, said), said).otherwise(tm.repaired_marks(source, said)))
    fault = F.when(F.col("first_said") == "", "blank").when(~tx.preserves_inline(source, said), "inline")
    judged = rows.withColumn("fault", F.when(F.col("piece").rlike(r"\S"), fault).otherwise("blank"))
    judged = judged.withColumn("reason", F.min("fault").over(unit))
    return judged.select(*keys, "block_order", "source", F.when(F.col("reason").isNull(), said).alias("text"), "reason")


def prompts(blocks: DataFrame, terms: DataFrame, instructions: str, glossary_head: str, lang: str) -> DataFrame:
    """(block_id, system, user): what a model is asked for each paragraph and heading (doc_id, block_order, block_id, kind, text).

    The user part has the text between those before and after it. The system part is the instructions, for Chinese with the
    glossary (term, target) in order of its terms; it is one row that every block gets.
    """
    order = Window.partitionBy("doc_id").orderBy("block_order")
    said = blocks.where(F.col("kind").isin("para", "heading")).withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})
    labelled = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), c))
    user = F.concat_ws("\n\n", labelled("【上文】", "before"), F.concat(F.lit("【本段】"), "text"), labelled("【下文】", "after"))
    listed = terms.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "target"))), lambda t: F.concat(t["term"], F.lit(" => "), t["target"])), "\n").alias("lines"))  # a glossary is a small file
    system = F.when((F.lit(lang) == "zh") & (F.col("lines") != ""), F.concat(F.lit(f"{instructions}\n\n{glossary_head}\n"), "lines")).otherwise(instructions)
    return said.crossJoin(F.broadcast(listed.select(system.alias("system")))).select("block_id", "system", user.alias("user"))


def applied(parts: DataFrame, results: DataFrame, lang: str) -> DataFrame:
    """(unit, block_id, text, model, reason): what a table of results becomes, block by block; what fails has no text but a reason.

    ``parts``: unit, block_id, block_order, text, known (is its paper still there); ``results``: unit, text, model. Announcements and
    thinking are cut off. A unit of one block is repaired; an answer that is no translation fails (untranslated), but a
    blank one to a source without prose stands for itself (model: identity). A unit of several is cut back to its blocks, and fails as a
    whole if it can't be (blank, inline) or one of its pieces is no translation. Blocks whose paper is gone are left out.
    """
    # an answer of several of one unit counts: the last in order
    answers = results.groupBy("unit").agg(F.max(F.struct("text", "model")).alias("r")).select("unit", gates.without_meta(F.coalesce("r.text", F.lit(""))).alias("text"), "r.model")
    sized = parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    one = sized.where("n = 1").select("unit", "block_id", F.col("text").alias("source"), "known").join(answers.hint("merge"), "unit")
    source, said = F.col("source"), F.col("text")
    wrong = gates.not_translation(source, said, lang)
    one = one.withColumn("wrong", wrong)
    for repair in (tm.repaired, tm.repaired_marks):
        one = one.withColumn("text", F.when(F.col("wrong") | tx.preserves_inline(source, said), said).otherwise(repair(source, said)))
    itself = (tx.collapse(said) == "") & ~source.rlike(tx.ascii_edges(r"\b[a-z]{2,}\b"))
    reason = F.when(itself, None).when(F.col("wrong"), "untranslated").when(~tx.preserves_inline(source, said), "inline")
    one = one.select("unit", "block_id", "known", F.when(itself, source).otherwise(said).alias("text"), F.when(itself, IDENTITY).otherwise(F.col("model")).alias("model"), reason.alias("reason"))
    several = sized.where("n > 1")
    cut = split_units(several.select("unit", "block_order", "text"), answers, ["unit"])
    untold = F.max(F.when(F.col("reason").isNull() & gates.not_translation(F.col("source"), F.col("text"), lang), "untranslated")).over(Window.partitionBy("unit"))
    cut = cut.withColumn("reason", F.coalesce("reason", untold)).drop("source")
    more = several.select("unit", "block_id", "block_order", "known").join(cut.hint("merge"), ["unit", "block_order"]).join(answers.select("unit", "model").hint("merge"), "unit")
    both = one.unionByName(more.select(*one.columns))
    return both.where("known").select("unit", "block_id", F.when(F.col("reason").isNull(), F.col("text")).alias("text"), "model", "reason")


def ledger(results: DataFrame) -> DataFrame:
    """(task, provider, model, input_tokens, output_tokens): a row for each answer, refused ones too, as they cost as much; to be appended to the ledger."""
    return results.select(F.lit("translate").alias("task"), "provider", "model", "input_tokens", "output_tokens")


def translated(parts: DataFrame, asked: DataFrame, runner: Callable[[DataFrame], DataFrame], lang: str) -> tuple[DataFrame, DataFrame]:
    """(translations and failures, ledger rows) of ``asked`` (unit, system, user), which ``runner`` makes results of (unit, text, provider, model, input_tokens, output_tokens)."""
    results = runner(asked)
    return applied(parts, results, lang), ledger(results)
