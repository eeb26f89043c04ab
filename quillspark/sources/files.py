"""Files named by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.notes import scalar

# The ending of names that are taken in, and what a file of that kind begins with.
ENDING, HEAD = ".pdf", b"%PDF"


def ingested(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New files (id, path, length) and failures (path, reason) of files (path, content) as ``spark.read.format("binaryFile")`` gives them.

    A file's id is the SHA-1 of its content; ``known`` (id) and repeats within the table are left out, of repeats the first path
    stays. Names with another ending are skipped, files without content or that do not begin like a PDF fail (Spark's reader itself lists no empty files).
    """
    named = files.where(F.lower("path").endswith(ENDING))
    right = F.coalesce(F.substring(F.col("content"), 1, len(HEAD)) == F.lit(HEAD), F.lit(False))
    reason = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty").when(~right, "not a PDF")
    told = named.select("path", F.octet_length("content").cast("long").alias("length"), F.sha1("content").alias("id"), reason.alias("reason"))
    first = told.where("reason IS NULL").groupBy("id").agg(F.min("path").alias("path"), F.max("length").alias("length"))
    return first.join(known.select("id").hint("merge"), "id", "left_anti"), told.where("reason IS NOT NULL").select("path", "reason")


def glossary_terms(files: DataFrame) -> DataFrame:
    """(path, term, target) of glossary files (path, content): the lines under "terms:". A file without them, or with none that is a string, gives nothing; of equal terms the last counts."""
    body = F.regexp_extract("content", r"(?m)^terms:[ \t]*\n((?:(?:[ \t]+.*|[ \t]*)(?:\n|\z))+)", 1)
    line = r"""(?m)^[ \t]+("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s:#'"][^:\n]*):[ \t]+(\S.*)$"""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(line), F.lit(1)).alias("k"), F.regexp_extract_all("body", F.lit(line), F.lit(2)).alias("v"))
    rows = files.select("path", body.alias("body")).select("path", F.posexplode(pairs).alias("at", "p"))
    plain = rows.where(~F.col("p.v").rlike(r"^(?:[-+]?[0-9][0-9.eE+-]*|true|false|null|~|[\[{].*)$"))
    said = plain.select("path", "at", F.trim(scalar(F.col("p.k"))).alias("term"), scalar(F.col("p.v")).alias("target")).where("term <> ''")
    return said.groupBy("path", "term").agg(F.max_by("target", "at").alias("target"))
