"""What of a paper a model is shown for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieval import ordered_union

HITS, WITH_LEADS, LEAST, PROSE, SAMPLES, BUDGET = 8, 14, 3, 40, 5, 6000
MEATY, MEATY_LEAST = 120, 5
WANTED = ["question_id", "paper_id", "block_id", "page", "block_order", "kind", "section", "text"]


def section_leads(blocks: DataFrame) -> DataFrame:
    """The first paragraph of 40 signs or more of each section, in order, as long as all of a paper's together keep to the budget."""
    own = Window.partitionBy("paper_id", "section").orderBy("page", "block_order")
    first = blocks.where(f"kind = 'para' AND coalesce(section, '') <> '' AND length(text) >= {PROSE}").withColumn("turn", F.row_number().over(own)).where("turn = 1").drop("turn")
    order = Window.partitionBy("paper_id").orderBy("page", "block_order").rowsBetween(Window.unboundedPreceding, 0)
    # the first that goes over the budget ends the list, so a running sum decides
    return first.withColumn("used", F.sum(F.length("text")).over(order)).where(F.col("used") <= BUDGET).drop("used")


def even_samples(blocks: DataFrame) -> DataFrame:
    """(paper_id, block_id, ..., turn): paragraphs at even distances over each paper, of those over 120 signs if there are five; five of them, of papers that don't divide evenly one or more beyond."""
    paper = Window.partitionBy("paper_id")
    meaty = F.length("text") > MEATY
    paras = blocks.where("kind = 'para'").withColumn("rich", F.sum(F.when(meaty, 1).otherwise(0)).over(paper) >= MEATY_LEAST)
    pool = paras.where(~F.col("rich") | meaty).withColumns({"at": F.row_number().over(paper.orderBy("page", "block_order")) - 1, "n": F.count(F.lit(1)).over(paper)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLES))
    return pool.where(F.col("at") % step == 0).withColumn("turn", (F.col("at") / step).cast("int")).drop("rich", "at", "n")


def chosen(questions: DataFrame, blocks: DataFrame, hits: DataFrame, translated_hits: DataFrame, strong_score: int = 3) -> DataFrame:
    """(WANTED, place): the blocks shown for each question (question_id, paper_id, question, whole), in reading order.

    A question on the whole paper gets its section leads. Others get hits of their words: those in translations (question_id,
    block_id, score) first, then those in the text (question_id, block_id, rank), eight in all. Section leads follow, up to 14,
    if the question is broad, no hit is strong (a hit in the text is, one in a translation from ``strong_score`` on) or no
    hit is a paragraph of 40 signs. With no block at all, or fewer than three and none strong, even samples follow.
    """
    of_paper = blocks.select("paper_id", *[c for c in WANTED if c not in ("question_id", "paper_id")])
    asked = questions.select("question_id", "paper_id", "question", "whole")
    narrow = asked.where("NOT whole").select("question_id", "paper_id")
    with_block = lambda found, by: found.join(narrow.hint("merge"), "question_id").join(of_paper.hint("merge"), ["paper_id", "block_id"]).select(*WANTED, by.alias("by"))
    in_text = with_block(hits, F.col("rank").cast("long"))
    in_translation = with_block(translated_hits, F.row_number().over(Window.partitionBy("question_id").orderBy("page", "block_order")).cast("long"))
    found = ordered_union([in_translation, in_text], ["question_id"], ["by"], HITS).select(*WANTED)
    strong = in_text.select("question_id").unionByName(translated_hits.where(F.col("score") >= strong_score).select("question_id")).distinct().withColumn("strong", F.lit(True))
    prose = found.where(f"kind = 'para' AND length(text) >= {PROSE}").select("question_id").distinct().withColumn("prose", F.lit(True))
    flags = asked.join(strong.hint("merge"), "question_id", "left").join(prose.hint("merge"), "question_id", "left")
    flags = flags.select("question_id", "paper_id", "whole", F.coalesce("strong", F.col("whole")).alias("strong"), (~F.col("whole") & (tx.broad_question(F.col("question")) | F.col("strong").isNull() | F.col("prose").isNull())).alias("leads"))
    leads = section_leads(of_paper)
    wanted = flags.where("whole OR leads").select("question_id", "paper_id").join(leads.hint("merge"), "paper_id").select(*WANTED, F.col("block_order").cast("long").alias("by"))
    both = ordered_union([found.withColumn("by", F.lit(0).cast("long")), wanted], ["question_id"], ["by", "block_order"], 1 << 30)
    placed = both.join(flags.select("question_id", "whole", "strong").hint("merge"), "question_id")
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy("priority", "by", "block_order"))
    # a question that gets leads keeps 14 in all; one on the whole paper keeps all its leads
    kept = placed.withColumn("turn", turn).where(f"whole OR turn <= {WITH_LEADS}").select(*WANTED)
    n = kept.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    thin = flags.join(n.hint("merge"), "question_id", "left").where(f"n IS NULL OR (NOT strong AND n < {LEAST})").select("question_id", "paper_id")
    samples = thin.join(even_samples(of_paper).hint("merge"), "paper_id").select(*WANTED, "turn").join(kept.select("question_id", "block_id").hint("merge"), ["question_id", "block_id"], "left_anti")
    filled = samples.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("turn"))).where(F.col("r") <= SAMPLES).select(*WANTED)
    reading = Window.partitionBy("question_id").orderBy("page", "block_order")
    return kept.unionByName(filled).withColumn("place", F.row_number().over(reading))


def contexts(chosen: DataFrame, questions: DataFrame, blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """(question_id, context): title, outline and the chosen blocks with their labels, in reading order. Labels are what answers cite."""
    label = F.concat(F.lit("[B"), F.col("block_order").cast("string"), F.lit("]（"), F.coalesce("section", F.lit("正文")), F.lit(" · p."), F.col("page").cast("string"), F.lit("）"), "text")
    listed = chosen.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", label.alias("line"))))["line"], "\n").alias("lines"))  # some twenty blocks
    heads = blocks.where("kind = 'heading'").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "block_order", "text")))["text"], " / ").alias("outline"))
    both = questions.join(papers.select(F.col("id").alias("paper_id"), "title").hint("merge"), "paper_id", "left").join(heads.hint("merge"), "paper_id", "left").join(listed.hint("merge"), "question_id", "left")
    outline = F.when(F.coalesce("outline", F.lit("")) != "", F.concat(F.lit("目录："), "outline"))
    intro = F.when(F.col("whole"), "论文各节开头（按目录顺序）：").otherwise("论文片段：")
    return both.select("question_id", F.concat_ws("\n", F.concat(F.lit("《"), F.coalesce("title", F.lit("")), F.lit("》")), outline, intro, F.nullif("lines", F.lit(""))).alias("context"))
