"""Queries by name, with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("documents", "pages", "events", "conversations", "benchmark", "labels")

# Corpus tables derived from the given ones, in either dialect. {documents} stands for a given table.
_SPARK = {
    "f_lines": "SELECT doc_id, CAST(pos AS BIGINT) AS block_order, line FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line",
    "f_first": "SELECT doc_id, n_chars, split(text, '\n')[0] AS first_line FROM {documents}",
    "f_words": "SELECT doc_id, w FROM (SELECT doc_id, explode(regexp_extract_all(text, '[a-z][a-z]+', 0)) AS w FROM {documents})",
}
_DUCK = {
    "f_lines": "SELECT doc_id, CAST(i-1 AS BIGINT) AS block_order, string_split(text, chr(10))[i] AS line FROM documents, UNNEST(range(1, len(string_split(text, chr(10)))+1)) u(i)",
    "f_first": "SELECT doc_id, n_chars, string_split(text, chr(10))[1] AS first_line FROM documents",
    "f_words": "SELECT doc_id, unnest(regexp_extract_all(text, '[a-z][a-z]+')) AS w FROM documents",
}
_BOTH = {
    "f_blocks": """
WITH k AS (SELECT doc_id, block_order, CAST(floor(block_order/10) AS BIGINT)+1 AS page, trim(line) AS raw,
    CASE WHEN block_order % 7 = 0 AND length(trim(line)) < 120 THEN 'heading' WHEN block_order % 11 = 5 THEN 'figure' ELSE 'para' END AS kind
  FROM {f_lines} WHERE length(trim(line)) > 0),
f AS (SELECT doc_id, page, block_order, kind, CASE WHEN kind = 'para' AND block_order % 5 = 1 THEN concat(raw, ' ⟦f1⟧') ELSE raw END AS text FROM k)
SELECT sha1(CAST(doc_id AS {S})) AS paper_id, concat(sha1(CAST(doc_id AS {S})), ':', CAST(page AS {S}), ':', CAST(block_order AS {S})) AS block_id,
  doc_id, page, block_order, kind, text,
  substr(max(CASE WHEN kind = 'heading' THEN concat(lpad(CAST(block_order AS {S}), 8, '0'), text) END)
    OVER (PARTITION BY doc_id ORDER BY block_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS section FROM f""",
    "f_translations": """
SELECT block_id, 1 + block_order % 2 AS glossary_version, 1 AS prompt_version,
  CASE doc_id % 3 WHEN 0 THEN 'qwen3:8b' WHEN 1 THEN 'gpt-4o-mini' ELSE 'identity' END AS model,
  CASE WHEN block_order % 13 = 0 THEN '' WHEN block_order % 10 = 1 THEN lower(replace(text, ' ⟦f1⟧', '')) ELSE lower(text) END AS text,
  doc_id * 1000 + block_order AS created_at
FROM {f_blocks} WHERE kind IN ('para', 'heading') AND (doc_id + block_order) % 3 <> 0""",
    "f_usage": """
SELECT event_id, ts, event_type AS task, concat('p', CAST(user_id % 4 AS {S})) AS provider,
  CASE user_id % 5 WHEN 0 THEN 'gpt-4o-mini-x' WHEN 1 THEN 'claude-sonnet-x' WHEN 2 THEN 'qwen3:8b' WHEN 3 THEN 'mystery' ELSE 'deepseek-chat' END AS model,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 7) AS BIGINT) AS output_tokens FROM {events}""",
    "f_bib": """
SELECT doc_id AS rec_id, CASE doc_id % 3 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'S2' ELSE 'OpenAlex' END AS source, substr(first_line, 1, 80) AS title,
  CASE WHEN doc_id % 4 = 0 THEN concat('10.1000/', CAST(doc_id % 97 AS {S})) END AS doi,
  CASE WHEN doc_id % 3 <> 2 THEN concat('24', lpad(CAST(doc_id % 12 + 1 AS {S}), 2, '0'), '.', lpad(CAST(doc_id % 211 AS {S}), 5, '0')) END AS arxiv_id,
  CAST(2000 + doc_id % 25 AS INT) AS year, CASE WHEN doc_id % 5 <> 0 THEN n_chars % 1000 END AS citations FROM {f_first}""",
    "f_progress": "SELECT event_id, user_id AS paper_id, least(CAST(100.0 AS DOUBLE), value/4) AS progress, value/500 AS scroll_position, event_type AS last_section, ts FROM {events}",
    "f_chat": """
SELECT conv_id AS session_id, conv_id % 100 AS paper_id, turn AS id, role,
  CASE WHEN role = 'assistant' THEN concat(text, ' [B', CAST(turn AS {S}), ']') ELSE text END AS text FROM {conversations} WHERE role IN ('user', 'assistant')""",
    "f_papers": """
SELECT sha1(CAST(doc_id AS {S})) AS id, doc_id, substr(first_line, 1, 200) AS title,
  CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'reading' ELSE 'done' END AS status, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN doc_id % 100 ELSE 100 END AS progress,
  1700000000000 + doc_id AS added_at, CASE WHEN doc_id % 4 <> 0 THEN 1710000000000 + doc_id * 7 % 1000 END AS last_opened_at,
  CASE WHEN doc_id % 50 = 0 THEN 1720000000000 + doc_id END AS pinned_at, doc_id % 10 = 0 AS meta_edited,
  CASE WHEN doc_id % 6 <> 0 THEN CAST(2000 + doc_id % 25 AS INT) END AS year, concat('t', CAST(doc_id % 7 AS {S})) AS tag1, concat('t', CAST(doc_id % 5 AS {S})) AS tag2 FROM {f_first}""",
    # lines at places on pages: headings are larger, every sixth line is set off, every ninth is out of order
    "f_placed": """
SELECT doc_id, page, block_order, text, kind = 'heading' AS heading, CAST(CASE WHEN kind = 'heading' THEN 14.2 ELSE 9.9 END AS DOUBLE) AS size,
  CAST(50 + doc_id % 7 AS BIGINT) AS x, CAST(800 - 12 * (block_order % 10) - CASE WHEN block_order % 10 >= 6 THEN 20 ELSE 0 END + CASE WHEN block_order % 9 = 8 THEN 40 ELSE 0 END AS BIGINT) AS y,
  CAST(5 * length(text) AS BIGINT) AS width, CAST(10 AS BIGINT) AS height FROM {f_blocks}""",
    # regions around three lines each, the last one left out of the text; on odd pages smaller ones within, not always wholly
    "f_regions": """
SELECT doc_id, page, CAST(k + 10 * inner_one AS BIGINT) AS region, CAST(CASE WHEN inner_one = 0 THEN 40 ELSE 100 + 60 * (doc_id % 8) END AS BIGINT) AS x1, low - CASE WHEN inner_one = 0 THEN 2 ELSE -1 END AS y1,
  CAST(CASE WHEN inner_one = 0 THEN 340 + 50 * (doc_id % 5) ELSE 250 + 60 * (doc_id % 8) END AS BIGINT) AS x2, high + CASE WHEN inner_one = 0 THEN 8 ELSE 6 END AS y2, k = 3 AND inner_one = 0 AS dropped
FROM (SELECT doc_id, page, CAST(floor(block_order % 10 / 3) AS BIGINT) AS k, min(y) AS low, max(y) AS high FROM {f_placed} GROUP BY doc_id, page, CAST(floor(block_order % 10 / 3) AS BIGINT)) g
CROSS JOIN (SELECT 0 AS inner_one UNION ALL SELECT 1) u WHERE inner_one = 0 OR page % 2 = 1""",
    # notes on paragraphs; their numbers have gaps
    "f_notes": """
SELECT paper_id, CAST(floor(block_order/4) AS BIGINT) + 1 AS n, block_id, block_order, CAST(0 AS BIGINT) AS char_start, CAST(length(text) AS BIGINT) AS char_end, substr(text, 1, 160) AS excerpt,
  concat('2026-08-', lpad(CAST(block_order * 5 % 28 + 1 AS {S}), 2, '0'), ' 10:00') AS stamp, concat('On "', substr(text, 1, 20), '".') AS text, section AS title
FROM {f_blocks} WHERE kind = 'para' AND block_order % 4 = 2""",
    # a large dictionary: words of the documents, every seventh with a capital as well
    "f_dictionary": """
SELECT CASE WHEN rec % 7 = 0 THEN concat(upper(substr(w, 1, 1)), substr(w, 2)) ELSE w END AS word, CASE WHEN rec % 3 = 0 THEN w END AS phonetic, CASE WHEN rec % 11 = 0 THEN '' WHEN rec % 5 = 0 THEN concat(w, '的复数') ELSE concat('n. ', w) END AS translation,
  CASE WHEN rec % 2 = 0 THEN 0 ELSE rec * 1000 END AS frq, CASE WHEN rec % 4 = 0 THEN rec END AS bnc, CAST(0 AS BIGINT) AS collins, rec % 9 AS oxford, '' AS tag, rec AS seq
FROM (SELECT min(doc_id) AS rec, lower(w) AS w FROM {f_words} GROUP BY lower(w))""",
    "f_search_log": "SELECT event_id, ts, user_id % 20 AS query_norm, event_type AS source, CASE WHEN event_id % 9 = 0 THEN 429 ELSE 200 END AS status FROM {events}",
}


def table(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A given table, or one derived from it; derived ones that are ``made`` already are taken as they are."""
    if name in made:
        return made[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = (_SPARK | _BOTH)[name].replace("{S}", "STRING")
    parts = {n: table(spark, sf_dir, n, **made) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **parts)


def _duck(text: str) -> str:
    """``text`` for DuckDB, with the derived tables that it names as common table expressions."""
    needed: list[str] = []

    def need(part: str) -> None:
        for name in [*_DUCK, *_BOTH]:
            if re.search(rf"\b{name}\b", part) and name not in needed:
                need((_DUCK | _BOTH)[name])
                if name not in needed:
                    needed.append(name)

    need(text)
    made = ", ".join(f"{n} AS ({(_DUCK | _BOTH)[n]})" for n in needed)
    made = re.sub(r"\{(\w+)\}", lambda m: "VARCHAR" if m[1] == "S" else m[1], made)
    return f"WITH {made} SELECT * FROM ({text})" if made else text


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (t, spark), where t gives tables by name, under ``name``."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda n, **made: table(spark, sf_dir, n, **made))
        if sql:
            ORACLE_SQL[name] = _duck(sql)
        return f

    return add
