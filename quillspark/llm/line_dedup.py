"""Line dedup by distinct-site spread.

The sites of each line hash are gathered in HyperLogLog sketches, which merge by aggregation. Lines whose
estimate lies within the sketch's error of the threshold get an exact distinct count. Lines spread over at
least ``min_sites`` sites are boilerplate; only the first document that has such a line keeps it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

LOG2_REGISTERS = 10
#: Lines of a counted list that are broadcast (some 12 MB); the lines of a longer one are salted, as one may be a third of all rows.
FEW, SALTS = 300_000, 16


def _with_list(lines: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """``lines`` joined with a list of ``n`` distinct lines, so that a very common line is no task of its own."""
    if n <= FEW:
        return lines.join(F.broadcast(listed), "line_hash")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "site"), F.lit(SALTS)).cast("int"))
    spread = listed.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(spread.hint("merge"), ["line_hash", "salt"]).drop("salt")


def spread_lines(lines: DataFrame, min_sites: int) -> tuple[DataFrame, int]:
    """(line_hash, first_doc) of the lines (line_hash, doc_id, site) on ``min_sites`` sites or more, and a bound of their number."""
    band = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << LOG2_REGISTERS) * min_sites))
    sketched = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(LOG2_REGISTERS)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    judged = sketched.select("line_hash", "first_doc", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") > min_sites - band)
    judged = written(judged, "spread")
    n = judged.count()
    sure = judged.where(F.col("about") >= min_sites + band).select("line_hash", "first_doc")
    near = judged.where(F.col("about") < min_sites + band).select("line_hash", "first_doc")
    pairs = _with_list(lines, near, n).select("line_hash", "first_doc", "site").distinct()
    exact = pairs.groupBy("line_hash", "first_doc").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return written(sure.unionByName(exact.select("line_hash", "first_doc")), "wide"), n


def remove_spread_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with the text freed of boilerplate, and n_lines, n_removed.

    A text is cut at line feeds; lines are compared without spaces at their ends, and blank ones always stay. A
    line that is on ``min_sites`` sources or more goes, except from the document with the smallest doc_id that
    has it (all its copies there stay). A null source is no site. A null text stays null with 0 lines; rows
    without a doc_id are left as they are but count for the spread; rows that repeat a doc_id are one document, each
    losing its own lines. Columns of ``docs`` that are called n_lines or n_removed are replaced, all others stay.
    """
    lines = docs.select("doc_id", F.col("source").alias("site"), F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.where(F.trim("line") != "").select("doc_id", "site", F.unhex(F.md5(F.trim("line"))).alias("line_hash"))
    wide, n = spread_lines(lines, min_sites)
    gone = _with_list(lines, wide, n).where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("line_hash").alias("gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    free = "gone"
    while free in docs.columns:
        free += "_"
    joined = docs.select(*names).join(gone.withColumnRenamed("gone", free).hint("merge"), "doc_id", "left").select(*names, free)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(free).to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                kept = parts
                if gone and text is not None:
                    out = set(gone)
                    kept = [x for x in parts if not (y := x.strip(" ")) or hashlib.md5(y.encode()).digest() not in out]
                    text = "\n".join(kept)
                texts.append(text)
                n.append(len(parts))
                removed.append(len(parts) - len(kept))
            out = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = joined.drop(free).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(cut, schema)
