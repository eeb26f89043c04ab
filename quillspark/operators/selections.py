"""Selections found in the blocks that they were made in, highlights carried over to translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .fingerprint import hamming, simhash

# White space as JavaScript and Unicode have it; Java's \s is ASCII.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LEFT_OUT = rf"{SPACE[1:-1]}\-\x{{0}}"
FOUND = "struct<start: int, stop: int, stage: string>"


def escaped(text: Column) -> Column:
    """The text as a pattern that matches nothing but it."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\#&\-~\s])", r"\\$1")


def _range(start: Column, stop: Column, stage: str) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(stage).alias("stage"))


def normal(text: Column) -> Column:
    """(text, map): without white space and hyphens, ligatures written out, and the place in ``text`` of each sign that is left."""
    without = F.regexp_replace(text, rf"[{SPACE[1:-1]}\-]", "\u0000")
    wide = lambda c: F.length(_written_out(c))
    kept = F.filter(F.transform(F.split(without, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["c"] != "\u0000") & (x["c"] != ""))
    places = F.flatten(F.transform(kept, lambda x: F.array_repeat(x["i"], wide(x["c"]))))
    return F.struct(_written_out(F.array_join(kept["c"], "")).alias("text"), places.alias("map"))


def bare(text: Column) -> Column:
    """The text that ``normal`` gives, without the places."""
    return _written_out(F.regexp_replace(text, rf"[{LEFT_OUT}]", ""))


def _place(text: Column, n: Column) -> Column:
    """The place in ``text``, from 0, of the sign that the ``n``-th one of ``bare`` is or comes from; null if there is none."""
    wide = text
    for sign, letters in fixed.LIGATURES.items():
        wide = F.replace(wide, F.lit(sign), F.lit(sign * len(letters)))
    # possessive, as Java's other repetitions of a group may go a step deeper each time
    upto = F.regexp_substr(wide, F.concat(F.lit(rf"\A(?:[{LEFT_OUT}]*+[^{LEFT_OUT}]){{"), n.cast("string"), F.lit("}+")))

    def told(part: Column) -> Column:
        place = F.length(part) - 1
        for sign, letters in fixed.LIGATURES.items():
            times = F.length(part) - F.length(F.replace(part, F.lit(sign), F.lit("")))
            place = place - (times - F.ceil(times / len(letters)))
        return place

    return F.when(n >= 1, tx.let(upto, told))


def _written_out(text: Column) -> Column:
    for sign, letters in fixed.LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def located(text: Column, selection: Column) -> Column:
    """(start, stop, stage) of a selection in a block's text, null if it isn't there; from 0, behind the last sign.

    In stages: as it is (exact); with any white space where it has some (spaced); without white space and hyphens and with
    ligatures written out, from four signs on (normal); from 49 signs on by both ends alone (ends): the first of its first
    24, 16 or 10 signs that is there, then of its last ones the first that stands behind and not three times as far as it is long.
    """
    at = lambda part, whole, start=None: F.position(part, whole, start) if start is not None else F.position(part, whole)
    words = F.filter(F.split(selection, SPACE + "+"), lambda w: w != "")
    spaced = F.array_join(F.transform(words, escaped), SPACE + "+")
    hit = F.when(F.size(words) > 0, F.regexp_instr(text, spaced))

    def by_ends(p: Column) -> Column:
        b, s = p["b"], p["s"]
        n = F.length(s)
        heads = F.coalesce(*[F.nullif(at(F.left(s, F.lit(k)), b), F.lit(0)) for k in fixed.END_LENGTHS])

        def tail(hi: Column) -> Column:
            ends = [F.struct(at(F.right(s, F.lit(k)), b, hi + fixed.END_GAP).alias("at"), F.lit(k).alias("k")) for k in fixed.END_LENGTHS]
            good = F.filter(F.array(*ends), lambda e: (e["at"] > 0) & (e["at"] + e["k"] - hi <= n * fixed.END_SPREAD))
            return tx.let(F.get(good, F.lit(0)), lambda e: F.when(e.isNotNull(), _range(_place(text, hi), _place(text, e["at"] + e["k"] - 1) + 1, "ends")))

        return F.when(n > fixed.ENDS_FROM, tx.let(heads, lambda hi: F.when(hi.isNotNull(), tail(hi))))

    loose = tx.let(hit, lambda i: F.when(i > 0, _range(i - 1, i - 1 + F.length(F.regexp_substr(text, spaced)), "spaced")))

    def folded(p: Column) -> Column:
        # what is there with any white space is there without any
        i, n = p["i"], F.length(p["s"])
        whole = F.when(n >= fixed.NORMAL_LEAST, _range(_place(text, i), _place(text, i + n - 1) + 1, "normal"))
        return F.when(i > 0, F.coalesce(loose, whole)).when((F.size(words) > 0) & (n >= fixed.NORMAL_LEAST), by_ends(p))

    exact = tx.let(at(selection, text), lambda i: F.when(i > 0, _range(i - 1, i - 1 + F.length(selection), "exact")))
    both = F.struct(bare(text).alias("b"), bare(selection).alias("s"))
    return F.coalesce(exact, tx.let(tx.let(both, lambda p: F.struct(p["b"].alias("b"), p["s"].alias("s"), at(p["s"], p["b"]).alias("i"))), folded))


def selections_in_blocks(selections: DataFrame, blocks: DataFrame) -> DataFrame:
    """``selections`` (block_id, selection, ...) with ``start``, ``stop`` and ``stage`` in the block's text; null where the block or the selection isn't there."""
    both = selections.join(blocks.select("block_id", F.col("text").alias("_text")).hint("merge"), "block_id", "left")
    return both.withColumn("_found", located(F.col("_text"), F.col("selection"))).select(*selections.columns, "_found.start", "_found.stop", "_found.stage")


def anchored(selections: DataFrame, blocks: DataFrame) -> DataFrame:
    """New anchors for ``selections`` (block_id, selection, ...): the range of the selection, or else of the whole block, with the first 160 signs of it as excerpt, and of a longer selection 4,000 as quote. Selections of unknown blocks give none."""
    found = selections_in_blocks(selections, blocks).join(blocks.select("block_id", F.col("text").alias("_text")).hint("merge"), "block_id")
    here = F.col("stage").isNotNull()
    excerpt = F.substring(F.when(here, F.col("selection")).otherwise(F.col("_text")), 1, fixed.EXCERPT)
    quote = F.when(here & (F.length("selection") > fixed.EXCERPT), F.substring("selection", 1, 4000))
    kept = [F.col(c) for c in selections.columns]
    return found.select(*kept, F.coalesce("start", F.lit(0)).alias("char_start"), F.coalesce("stop", F.length("_text")).alias("char_end"), excerpt.alias("excerpt"), quote.alias("quote"), F.coalesce("stage", F.lit("block")).alias("stage"))


def _nearest(text: Column, row: Column, token: Column) -> Column:
    """Start of the occurrence of ``token`` in ``text`` that is nearest to ``row.center``, the first of equals; null if there is none.

    ``row``: center, back (the text backwards) and n (its length). The last occurrence up to the center is the first one of the text backwards.
    """
    size, upto = F.length(token), F.floor(row["center"]).cast("int")
    behind = F.position(F.reverse(token), row["back"], F.greatest(row["n"] - upto - size, F.lit(0)) + 1) - 1
    ends = F.struct(F.when(behind >= 0, row["n"] - behind - size).alias("before"), F.nullif(F.position(token, text, upto + 2), F.lit(0)).alias("after"))
    return tx.let(ends, lambda e: F.when(e["before"].isNull() | (e["after"] - 1 - row["center"] < row["center"] - e["before"]), e["after"] - 1).otherwise(e["before"]))


def sentence_start(text: Column, at: Column) -> Column:
    """``at``, or the nearest place up to 40 signs before it that stands behind a sentence's end, or the text's beginning."""
    low = F.greatest(at - fixed.SNAP, F.lit(0))
    before = F.substring(text, F.greatest(low, F.lit(1)), at - F.greatest(low, F.lit(1)) + 1)  # the signs before the places from low on
    last = F.length(F.regexp_extract(before, rf"(?s)^.*[{fixed.SENTENCE_ENDS}]", 0))
    return F.when(last > 0, F.greatest(low, F.lit(1)) - 1 + last).when(low == 0, F.lit(0)).otherwise(at)


def sentence_end(text: Column, at: Column) -> Column:
    """``at``, or the nearest place up to 40 signs behind it that stands behind a sentence's end."""
    after = F.substring(text, F.greatest(at, F.lit(1)), F.least(F.length(text), at + fixed.SNAP) - at + 1)
    first = F.regexp_instr(after, F.lit(f"[{fixed.SENTENCE_ENDS}]"))
    return F.when(at == 0, F.lit(0)).when(first > 0, at + first - 1).otherwise(at)


def projected(highlights: DataFrame, blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """(block_id, id, start, stop, stage): highlights (block_id, id, char_start, char_end, excerpt) on the translations (block_id, text) of their blocks.

    An excerpt that stands in the translation is taken as it is (excerpt); one of full length goes on to its sentence's
    end. Else numbers and Latin words of the highlighted text that stand in the translation, each where it is nearest to
    the highlight's middle in proportion, span a range (tokens), or else the proportion itself does (share); both grow to
    sentence ends. Empty ranges are left out.
    """
    source, said = F.col("_source"), F.col("_said")
    both = highlights.join(blocks.select("block_id", F.col("text").alias("_source")).hint("merge"), "block_id").join(translations.select("block_id", F.col("text").alias("_said")).hint("merge"), "block_id")
    size, n = F.greatest(F.length(source), F.lit(1)), F.length(said)
    center = (F.col("char_start") + F.col("char_end")) / 2 / size * n
    marked = F.substring(source, F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    tokens = F.array_distinct(F.regexp_extract_all(marked, F.lit(fixed.SHARED_TOKEN), F.lit(0)))
    # what a token's place asks of the row is made once for the row, not for each token
    row = F.struct(center.alias("center"), F.reverse(said).alias("back"), n.alias("n"))
    nearest = lambda r: F.filter(F.transform(tokens, lambda t: F.struct(_nearest(said, r, t).alias("at"), F.length(t).alias("n"))), lambda x: x["at"].isNotNull())
    rows = both.withColumn("_found", tx.let(row, nearest))
    inside = F.when(F.coalesce(F.col("excerpt"), F.lit("")) != "", F.position("excerpt", "_said") - 1)
    some = F.size("_found") > 0
    low = F.when(some, F.array_min(F.transform("_found", lambda x: x["at"]))).otherwise(F.floor(F.col("char_start") / size * n).cast("int"))
    high = F.when(some, F.array_max(F.transform("_found", lambda x: x["at"] + x["n"]))).otherwise(F.ceil(F.col("char_end") / size * n).cast("int"))
    rows = rows.withColumns({"_in": inside, "_low": low, "_high": high})
    whole = F.col("_in") >= 0
    excerpt_end = F.col("_in") + F.length("excerpt")
    start = F.when(whole, F.col("_in")).otherwise(sentence_start(said, F.col("_low")))
    stop = F.when(whole, F.when(F.length("excerpt") >= fixed.EXCERPT, sentence_end(said, excerpt_end)).otherwise(excerpt_end)).otherwise(sentence_end(said, F.col("_high")))
    stage = F.when(whole, "excerpt").when(some, "tokens").otherwise("share")
    held = lambda c: F.greatest(F.lit(0), F.least(c, n))
    hit = F.struct(held(start).cast("int").alias("start"), held(stop).cast("int").alias("stop"), stage.alias("stage"))
    # exploded, as a condition on the range would move into the join with all that the range is made of, once for each time it is named
    out = rows.select("block_id", "id", F.explode_outer(F.array(hit)).alias("hit")).where("hit.stop > hit.start")
    return out.select("block_id", "id", "hit.start", "hit.stop", "hit.stage")


def resolved(anchors: DataFrame, blocks: DataFrame, near: int = 12) -> DataFrame:
    """``anchors`` (paper_id, anchor_id, block_id, char_start, char_end, excerpt, print) with the block and range where each stands now, and ``rule``.

    In stages: the block of that id, if its fingerprint is near or the excerpt is in it (kept); else the first block of the paper in
    which an excerpt of twelve signs or more stands (excerpt; an anchor longer than its excerpt takes the whole block); else the
    block with the same text, or with the nearest fingerprint (print); else what it was, unless its id is another text's now, which gives no
    block (lost).
    """
    prints = simhash(blocks.select(F.col("block_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("block_id"), F.col("simhash").alias("now"))
    known = blocks.select("paper_id", "block_id", "block_order", "text").join(prints.hint("merge"), "block_id")
    live = known.select("paper_id", "block_id", F.col("text").alias("_text"), "now")
    rows = anchors.join(live.hint("merge"), ["paper_id", "block_id"], "left")
    same = F.col("_text").isNotNull() & ((hamming(F.col("now"), F.col("print")) <= near) | located(F.col("_text"), F.col("excerpt")).isNotNull())
    rows = rows.withColumns({"_live": F.col("_text").isNotNull(), "_same": F.coalesce(same, F.lit(False))}).drop("_text", "now")
    plain = lambda c: F.lower(tx.collapse(F.col(c)))
    # what each pair asks of either side is made once for the side; in any stage the bare block holds what the bare excerpt begins with
    head = F.when(F.length(F.trim("excerpt")) >= 12, F.left(bare(F.col("excerpt")), F.lit(min(fixed.END_LENGTHS))))
    open_ones = rows.where("NOT _same").select("paper_id", "anchor_id", "excerpt", "print", "char_start", "char_end", head.alias("_head"), plain("excerpt").alias("_asked"))
    offered = known.select("*", bare(F.col("text")).alias("_bare"), plain("text").alias("_plain"))
    # blocks of the same paper only: a paper's open anchors meet its blocks
    met = open_ones.hint("merge").join(offered.hint("merge"), "paper_id")
    seen = F.when(F.contains("_bare", F.col("_head")), located(F.col("text"), F.col("excerpt")))
    apart = F.when(F.col("_plain") == F.col("_asked"), -1).otherwise(hamming(F.col("now"), F.col("print")))
    tried = met.withColumns({"_seen": seen, "_apart": apart})
    best = tried.groupBy("paper_id", "anchor_id").agg(
        F.min(F.when(F.col("_seen").isNotNull(), F.struct("block_order", "block_id", F.col("_seen.start").alias("a"), F.col("_seen.stop").alias("z"), F.length("text").alias("n")))).alias("e"),
        F.min(F.when(F.col("_apart") <= near, F.struct(F.col("_apart").alias("by"), "block_order", "block_id"))).alias("p"),
    )
    both = rows.join(best.hint("merge"), ["paper_id", "anchor_id"], "left")
    rule = F.when(F.col("_same"), "kept").when(F.col("e").isNotNull(), "excerpt").when(F.col("p").isNotNull(), "print").when(F.col("_live"), "lost").otherwise("gone")
    whole = F.col("char_end") - F.col("char_start") > F.length("excerpt")
    by = both.withColumn("rule", rule)
    told = F.col("rule") == "excerpt"
    return by.select(
        "paper_id", "anchor_id", F.when(told, F.col("e.block_id")).when(F.col("rule") == "print", F.col("p.block_id")).when(F.col("rule") != "lost", F.col("block_id")).alias("block_id"),
        F.when(told, F.when(whole, 0).otherwise(F.col("e.a"))).otherwise(F.col("char_start")).cast("int").alias("char_start"), F.when(told, F.when(whole, F.col("e.n")).otherwise(F.col("e.z"))).otherwise(F.col("char_end")).cast("int").alias("char_end"), "rule",
    )
