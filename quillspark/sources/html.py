"""A table of web pages as ordered text units, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = r"(?s)<(?:script|style|nav|header|footer)\b.*?</(?:script|style|nav|header|footer)>"
INLINE = r"b|i|em|strong|a|br|sup|sub|span|/b|/i|/em|/strong|/a|/sup|/sub|/span"
UNIT = rf"(?s)<(?:h[1-6]|p|li)\b[^>]*>(?:[^<]++|<(?:{INLINE})\b[^>]*>)*"


def decoded(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" "))


def units(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, level, text, unit_id): headings and paragraphs of each page, in order.

    Script, style, nav, header and footer content is dropped. Ids are content hashes with a counter for repeats.
    """
    body = F.regexp_replace(F.regexp_replace("html", SKIPPED, ""), r"(?s)<!--.*?-->", "")
    pieces = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit(UNIT), 0)).alias("i", "piece"))
    text = F.trim(F.regexp_replace(F.regexp_replace(decoded(F.col("piece")), r"<[^>]*>", " "), r"[ \t\n\r]+", " "))
    level = F.regexp_extract("piece", r"^<h([1-6])", 1)
    made = pieces.select("page_id", "i", F.when(level != "", "heading").otherwise("para").alias("kind"), F.when(level != "", level.cast("int")).alias("level"), text.alias("text")).where("text <> ''")
    order = Window.partitionBy("page_id").orderBy("i")
    content = F.sha1("text")
    again = F.row_number().over(Window.partitionBy("page_id", "text").orderBy("i")) - 1
    return made.select("page_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "kind", "level", "text", F.concat_ws("-", F.substring(content, 1, 12), again.cast("string")).alias("unit_id"))
