"""SQL functions for users of ``spark.sql``: each is Spark SQL itself, so Catalyst sees through it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import PLACEHOLDER, SCRIPT_MARK, WS


def register(spark: SparkSession) -> None:
    """Registers ``inline_content_matches(source, translated)`` in the session: both hold the same placeholders and script marks.

    Also the table function ``text_words(document)``, to be called with LATERAL: (place, word) of the words that fingerprints are made of.
    """
    tokens = lambda c: f"array_sort(concat(transform(regexp_extract_all({c}, r'{PLACEHOLDER}', 1), n -> concat('formula:', CAST(CAST(n AS INT) AS STRING))), regexp_extract_all({c}, r'{SCRIPT_MARK}', 0)))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION inline_content_matches(source STRING, translated STRING) RETURNS BOOLEAN RETURN {tokens('source')} = {tokens('translated')}")
    words = f"regexp_extract_all(lower(regexp_replace(document, r'([a-zA-Z])-{WS}([a-zA-Z])', '$1$2')), r'[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', 0)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_words(document STRING) RETURNS TABLE (place INT, word STRING) RETURN SELECT posexplode({words})")
