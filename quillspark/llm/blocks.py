"""Documents in blocks: ranges of doc_id of similar size in bytes, each read whole by one task.

Block numbers grow with doc_id, so of two blocks the one with the smaller number has only smaller ids.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of equal row counts that are measured, at most; only these numbers come to the driver, at any size.
RANGES = 4096
#: Blocks for rows without an id.
UNNAMED = 64


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame) -> int:
    """Four blocks for each split of the input, one for each shuffle partition at least: bounded work in a task at any size."""
    return max(4 * docs.rdd.getNumPartitions(), shuffle_partitions(docs))


def in_blocks(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and ``blk``, about ``block_count`` of them; rows without an id are dealt to blocks below 0 by a hash of the text.

    Ranges between quantiles of the ids are measured in bytes of text, and each is cut into as many blocks, evenly in
    its ids, as its bytes call for. So a run of long documents makes more blocks, not larger ones.
    """
    n = block_count(docs)
    ranges = max(1, min(RANGES, n // 2))
    cuts = docs.select(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges)).alias("q")).first()["q"] or []
    splits = [float("-inf"), *(sorted({float(x) for x in cuts}) or [0.0]), float("inf")]
    known = docs.withColumn("blk_id", F.coalesce(F.col(id_col).cast("double"), F.lit(0.0)))
    known = Bucketizer(splits=splits, inputCol="blk_id", outputCol="blk_at").transform(known.select(*dict.fromkeys([*columns, id_col, text]), "blk_id"))
    sizes = known.where(F.col(id_col).isNotNull()).groupBy("blk_at").agg(F.sum(F.octet_length(text)).alias("size"), F.min("blk_id").alias("low"), F.max("blk_id").alias("high"))
    found = sorted(sizes.collect(), key=lambda r: r["blk_at"])  # RANGES rows at most
    each = max(1.0, sum(r["size"] or 0 for r in found) / n)
    rows, first = [], 0
    for r in found:
        pieces = max(1, round((r["size"] or 0) / each))
        rows.append((r["blk_at"], first, r["low"], pieces / (r["high"] - r["low"] + 1), pieces - 1))
        first += pieces
    bounds = docs.sparkSession.createDataFrame(rows, "blk_at double, blk_first int, blk_low double, blk_rate double, blk_last int")
    placed = known.join(F.broadcast(bounds), "blk_at", "left")
    inside = F.least(F.floor((F.col("blk_id") - F.col("blk_low")) * F.col("blk_rate")).cast("int"), F.col("blk_last"))
    unnamed = -1 - F.pmod(F.xxhash64(text), F.lit(UNNAMED)).cast("int")
    return placed.select(*columns, F.when(F.col(id_col).isNull(), unnamed).otherwise(F.col("blk_first") + inside).alias("blk"))
