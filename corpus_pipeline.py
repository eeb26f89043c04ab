"""A corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage works on all that the one before it kept and returns the columns of documents, the last one the packed
pieces. ``run`` cuts lineage between stages with a table in the shared folder. Columns besides doc_id, text, lang and
source pass through whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import without_overlaps
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.language_id import floors, held_out, in_learned_language, learned
from quillspark.llm.line_dedup import remove_spread_lines
from quillspark.llm.packing import best_fit, measured
from quillspark.llm.queries import TOKENIZER
from quillspark.llm.scratch import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; the rest go. The model is fitted on all labelled rows but those held out; what is too low a score is read off all of these.

    A null text or one without a letter is in no language and goes; rows without an id or with a repeated one are judged like others.
    """
    model = learned(docs.where(~held_out()))
    return in_learned_language(docs, model, floors(model, docs.where(held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars is counted anew. A text that was all boilerplate stays, as an empty one; a row without an id keeps all its lines."""
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    same = [c for c in ("n_lines", "n_removed") if c in docs.columns]  # the operator would replace them
    free = _free(docs)
    held = docs.withColumn(free, F.struct(*same)).drop(*same) if same else docs
    out = remove_spread_lines(held).withColumns({c: F.col(f"`{free}`.`{c}`") for c in same})
    return out.select(*[counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the smallest id, all rows of it; texts without words and rows without an id stay."""
    found = jaccard_components(docs, width=5, num=4, den=5)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids: a row for each piece of a document, with its bin and place in it; an empty text is its end id."""
    return best_fit(measured(docs, TOKENIZER), capacity=2048, rows=docs.count())


def _free(docs: DataFrame) -> str:
    name = "kept"
    while name in docs.columns:
        name += "_"
    return name


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: Language ID and packing are not SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
