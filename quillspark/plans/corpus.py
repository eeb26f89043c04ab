"""Queries on documents and pages: text functions, fingerprints, page units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import fingerprint as fp
from ..operators import library as lib
from ..sources import html
from .registry import query

WS = r"[ \t\n\r\f\v]+"


@query("txt1_clamped", rf"SELECT doc_id, substr(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 300) AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.clamp(F.col("text"), 300).alias("text"))


@query("txt2_dehyphenated", rf"SELECT doc_id, md5(regexp_replace(text, '([a-zA-Z])-{WS}([a-zA-Z])', '\1\2', 'g')) AS joined FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(tx.dehyphenated(F.col("text"))).alias("joined"))


@query("txt3_repeat_key", rf"SELECT doc_id, block_order, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '{WS}', ' ', 'g'))) AS key FROM f_lines")
def _(t):
    return t("f_lines").select("doc_id", "block_order", tx.repeat_key(F.col("line")).alias("key"))


@query("txt8_script_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '[一-鿿㐀-䶿]')) AS BIGINT) AS han FROM documents")
def _(t):
    c = tx.script_counts(F.col("text"))
    return t("documents").select("doc_id", c["latin"].alias("latin"), c["han"].alias("han"))


def _latin_sql(table: str = "documents", key: str = "doc_id") -> str:
    parts = []
    for lang, words in fixed.FUNCTION_WORDS.items():
        said = ", ".join(f"'{w}'" for w in words.split())
        parts.append(f"len(list_filter(w, lambda x: x IN ({said}))) AS {lang}")
    return rf"""
SELECT {key}, CASE WHEN n < 6 OR greatest(d, f, e) = 0 THEN 'en' WHEN d = greatest(d, f, e) THEN 'de' WHEN f = greatest(d, f, e) THEN 'fr' ELSE 'es' END AS told FROM (
SELECT {key}, n, CASE WHEN de >= 2 AND de / n >= 0.04 THEN de ELSE 0 END AS d, CASE WHEN fr >= 2 AND fr / n >= 0.04 THEN fr ELSE 0 END AS f, CASE WHEN es >= 2 AND es / n >= 0.04 THEN es ELSE 0 END AS e
FROM (SELECT {key}, len(w) AS n, {", ".join(parts)} FROM (SELECT {key}, list_filter(string_split_regex(lower(regexp_replace(text, '(?i)\bet[ \t\n\r]+al\b\.?', ' ', 'g')), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM {table})))"""


@query("txt9_language", _latin_sql())
def _(t):
    return t("documents").select("doc_id", tx.text_language(F.col("text")).alias("told"))


@query("txt11_cjk_dominant", "SELECT doc_id, len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ가-힯]')) > 0 AND len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ가-힯]')) >= len(regexp_extract_all(text, '[A-Za-z]')) / 4 AS cjk FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.cjk_dominant(F.col("text")).alias("cjk"))


_ENTRY = rf"""
SELECT block_id, length(x) <= {fixed.ENTRY_LONGEST} AND regexp_matches(x, '{fixed.ENTRY_YEAR}') AND (
  (regexp_matches(x, '{fixed.ENTRY_NUMBER}') AND regexp_matches(x, '{fixed.ENTRY_NAMES}'))
  OR (len(w) >= 2 AND len(list_filter(w, lambda y: regexp_matches(y, '^[A-Z]'))) >= {fixed.ENTRY_CAPITALS} * len(w) AND regexp_matches(x, '{fixed.ENTRY_VENUE}'))) AS entry
FROM (SELECT block_id, trim(text) AS x, list_filter(string_split_regex(string_split_regex(trim(text), '\.\s+')[1], '\s+'), lambda y: y <> '') AS w FROM f_blocks)"""


@query("txt12_reference_entry", _ENTRY)
def _(t):
    return t("f_blocks").select("block_id", tx.reference_entry(F.col("text")).alias("entry"))


@query("txt13_skip_translation", f"SELECT block_id, NOT regexp_matches(text, '[A-Za-z]{{2,}}') OR told = 'de' OR entry AS skip FROM f_blocks JOIN ({_latin_sql('f_blocks', 'block_id')}) USING (block_id) JOIN ({_ENTRY}) USING (block_id)")
def _(t):
    return t("f_blocks").select("block_id", tx.skip_translation(F.col("text"), "de").alias("skip"))


@query("txt15_token_estimate", r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) * 1.3::DOUBLE + 0.5) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("txt16_human_tokens", "SELECT event_id, CASE WHEN input_tokens >= 1000000 THEN concat((input_tokens + 50000) // 1000000, '.', (input_tokens + 50000) // 100000 % 10, 'M') WHEN input_tokens >= 1000 THEN concat((input_tokens + 50) // 1000, '.', (input_tokens + 50) // 100 % 10, 'k') ELSE CAST(input_tokens AS VARCHAR) END AS shown FROM f_usage")
def _(t):
    return t("f_usage").select("event_id", tx.human_tokens(F.col("input_tokens")).alias("shown"))


_FRAGMENT = rf"""
SELECT block_id, n > 0 AND (n <= {fixed.FORMULA_TINY}
  OR (n <= {fixed.FORMULA_SHORT} AND len(regexp_extract_all(x, '[a-zA-Z]{{4,}}')) <= {fixed.FORMULA_WORDS} AND regexp_matches(x, '{fixed.FORMULA_SIGNS}'))
  OR (n <= {fixed.FORMULA_LONG} AND len(regexp_extract_all(x, '\b[A-Z]\b')) >= {fixed.FORMULA_CAPITALS} AND regexp_matches(x, '{fixed.FORMULA_RELATION}'))) AS fragment
FROM (SELECT block_id, trim(text) AS x, length(trim(text)) AS n FROM f_blocks)"""


@query("txt17_formula_fragment", _FRAGMENT)
def _(t):
    return t("f_blocks").select("block_id", tx.formula_fragment(F.col("text")).alias("fragment"))


@query("txt18_numeric_noise", rf"SELECT doc_id, block_order, n >= 8 AND m >= 0.6 * n AS noise FROM (SELECT doc_id, block_order, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '^[-+(]?[0-9][0-9.,%)]*$'))) AS m FROM (SELECT doc_id, block_order, list_filter(string_split_regex(line, '{WS}'), lambda x: x <> '') AS w FROM f_lines))")
def _(t):
    return t("f_lines").select("doc_id", "block_order", tx.numeric_noise(F.col("line")).alias("noise"))


@query("txt20_broad_question", f"SELECT conv_id, turn, regexp_matches(text, '(?i){fixed.BROAD_HAN}|{fixed.BROAD_LATIN}') AS broad FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", tx.broad_question(F.col("text")).alias("broad"))


_OPEN = rf"""
SELECT block_id, length(e) >= {fixed.OPEN_LENGTH} AND len(regexp_extract_all(e, '\b[a-z]{{3,}}\b')) >= {fixed.OPEN_WORDS} AND NOT regexp_matches(e, '{fixed.LINK_AT_END}') AND NOT contains('{fixed.CLOSING_SIGNS}', right(e, 1)) AS ends,
  regexp_matches(b, '^(?:{fixed.GOES_ON})') AND NOT regexp_matches(b, '^(?:{fixed.LINK_AT_START}|{fixed.LIST_LABEL})') AS starts
FROM (SELECT block_id, regexp_replace(text, '[\s*^~]+$', '') AS e, regexp_replace(text, '^[\s*]+', '') AS b FROM f_blocks)"""


@query("txt22_open_ends", _OPEN)
def _(t):
    return t("f_blocks").select("block_id", tx.ends_mid_sentence(F.col("text")).alias("ends"), tx.starts_mid_sentence(F.col("text")).alias("starts"))


@query("flt9_wordless_lines", r"SELECT doc_id, block_order FROM f_lines WHERE NOT regexp_matches(line, '[\p{L}\p{N}]')")
def _(t):
    return t("f_lines").where(~F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc_id", "block_order")


@query("flt10_safe_links", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto') AS safe FROM pages")
def _(t):
    return t("pages").select("page_id", tx.safe_link(F.col("url")).alias("safe"))


@query("dt3_minute_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM events")
def _(t):
    return t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("stamp"))


@query("js1_tolerant_json", "SELECT event_id, CASE WHEN json_valid(props) THEN CAST(len(json_keys(props)) AS BIGINT) ELSE 0 END AS n_keys FROM events")
def _(t):
    return t("events").select("event_id", F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("m")).select("event_id", F.size("m").cast("long").alias("n_keys"))


@query("fp1_features", rf"SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, CAST(greatest(2 * len(k) - 1, 0) AS BIGINT) AS n_features, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '([a-zA-Z])-{WS}([a-zA-Z])', '\1\2', 'g')), '[a-z0-9]+|[一-鿿㐀-䶿]') AS k FROM documents)")
def _(t):
    d = t("documents").select("doc_id", tx.tokens(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(tx.features(F.col("k"))).cast("long").alias("n_features"), F.md5(F.array_join("k", " ")).alias("tokens"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({w}, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_TOKENS = rf"SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '([a-zA-Z])-{WS}([a-zA-Z])', '\1\2', 'g')), '[a-z0-9]+|[一-鿿㐀-䶿]') AS k FROM documents"
_SIMHASH = f"""
WITH tok AS ({_TOKENS}),
feat AS (SELECT doc_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS f FROM tok),
word AS (SELECT DISTINCT f FROM feat),
h AS (SELECT f, {_FNV.format(w='f')} AS h FROM word),
n AS (SELECT doc_id, f, count(*) AS c FROM feat GROUP BY doc_id, f),
bit AS (SELECT doc_id, b, sum(CASE WHEN (h // (1::HUGEINT << b)) % 2 = 1 THEN c ELSE -c END) AS v FROM n JOIN h USING (f), UNNEST(range(0, 64)) u(b) GROUP BY doc_id, b),
s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << b ELSE 0 END)::HUGEINT AS s FROM bit GROUP BY doc_id)
SELECT documents.doc_id, CAST(CASE WHEN coalesce(s, 0) >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE coalesce(s, 0) END AS BIGINT) AS simhash FROM documents LEFT JOIN s USING (doc_id)"""


@query("fp2_fp3_simhash", _SIMHASH)
def _(t):
    return fp.simhash(t("documents")).select("doc_id", "simhash")


@query("fp4_fp5_near_fingerprints", f"WITH q AS (SELECT DISTINCT simhash FROM ({_SIMHASH})) SELECT x.simhash AS a, y.simhash AS b FROM q x JOIN q y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 6")
def _(t):
    return fp.hashes_within(fp.simhash(t("documents")))


@query("fp7_content_ids", "SELECT doc_id, sha1(text) AS content_id, concat_ws(':', sha1(CAST(doc_id AS VARCHAR)), '1', '0') AS first_block FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha1("text").alias("content_id"), F.concat_ws(":", F.sha1(F.col("doc_id").cast("string")), F.lit("1"), F.lit("0")).alias("first_block"))


@query("fp8_exact_duplicates", "SELECT sha1(text) AS content_id, min(doc_id) AS kept_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return fp.exact_duplicates(t("documents"))


@query("fp10_echoes", "SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b WHERE length(b.text) >= 40 AND (contains(d.text, substr(b.text, 1, 40)) OR contains(d.text, substr(b.text, CAST(floor((length(b.text) - 40) / 2) AS INT) + 1, 40)) OR contains(d.text, substr(b.text, length(b.text) - 39, 40)))")
def _(t):
    return fp.echoes(t("documents"), t("benchmark"))


@query("flagship_near_duplicates")
def _(t):
    return fp.clusters(t("documents").select("doc_id", "text"))


@query("src9_src10_page_units", r"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos, kind, text FROM (
  SELECT page_id, i, CASE WHEN regexp_matches(piece, '^<h[1-6]') THEN 'heading' ELSE 'para' END AS kind,
         trim(regexp_replace(regexp_replace(replace(replace(piece, '&amp;', '&'), '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text
  FROM (SELECT page_id, i, pieces[i] AS piece FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<(?:script|style|nav|header|footer)\b.*?</(?:script|style|nav|header|footer)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:h[1-6]|p|li)\b[^>]*>(?:[^<]|<(?:b|i|em|strong|a|br|sup|sub|span|/b|/i|/em|/strong|/a|/sup|/sub|/span)\b[^>]*>)*') AS pieces FROM pages), UNNEST(range(1, len(pieces) + 1)) u(i)))
WHERE text <> ''""")
def _(t):
    return html.units(t("pages")).select("page_id", "pos", "kind", "text")


@query("win5_duplicate_counter", "SELECT doc_id, block_order, md5(line) AS content, CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY block_order) - 1 AS BIGINT) AS dup FROM f_lines")
def _(t):
    from ..operators import structure as st

    return st.duplicate_counter(t("f_lines").withColumn("content", F.md5("line")), ["doc_id", "content"], [F.col("block_order")]).select("doc_id", "block_order", "content", F.col("dup").cast("long").alias("dup"))


@query("lay1_agg10_repeated_lines", rf"""
WITH l AS (SELECT d.source, l.doc_id, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '{WS}', ' ', 'g'))) AS key FROM f_lines l JOIN documents d USING (doc_id)),
p AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY source)
SELECT source, key, count(DISTINCT doc_id) AS pages FROM l JOIN p USING (source) WHERE key <> '' AND n >= 3 GROUP BY source, key, n HAVING count(DISTINCT doc_id) >= greatest(3, ceil(n / 2.0))""")
def _(t):
    lines = t("f_lines").join(t("documents").select("doc_id", "source").hint("merge"), "doc_id")
    return lib.repeated_lines(lines, "doc_id", "source", tx.repeat_key(F.col("line")))
