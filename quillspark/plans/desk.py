"""Queries on notes, answers of models and the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql import register
from ..operators import dictionary as dic
from ..operators import memory as tm
from ..operators import notes as nt
from ..operators import usage as use
from ..sources import files as fs
from ..streaming import answers as ans
from .registry import query

_ANCHOR = "to_json({'block_id': block_id, 'char_start': char_start, 'char_end': char_end, 'excerpt': excerpt})"


@query("src12_note_files", f"""SELECT paper_id, concat('---', chr(10), 'paper: ', paper_id, chr(10), 'title: "', replace(replace(coalesce(max(title), ''), '\\', '\\\\'), '"', '\\"'), '"', chr(10), 'anchors:', chr(10),
  string_agg(concat('  a', CAST(n AS VARCHAR), ': ', CAST({_ANCHOR} AS VARCHAR)), chr(10) ORDER BY n), chr(10), '---', chr(10),
  string_agg(concat(chr(10), '## a', CAST(n AS VARCHAR), ' · ', stamp, chr(10), chr(10), rtrim(text), chr(10)), '' ORDER BY n)) AS content FROM f_notes GROUP BY paper_id""")
def _(t):
    return nt.note_files(t("f_notes"))


@query("src11_note_entries", "SELECT paper_id, concat('a', CAST(n AS VARCHAR)) AS anchor_id, stamp, text, block_id, char_end, excerpt FROM f_notes")
def _(t):
    # each file ends in a section that is none of ours
    files = nt.note_files(t("f_notes")).withColumn("content", F.concat("content", F.lit("\n## Of my own\n\nnot an entry\n")))
    return nt.note_entries(files).select("paper_id", "anchor_id", "stamp", "text", "anchor.block_id", "anchor.char_end", "anchor.excerpt")


@query("fp6_jn8_relocated")
def _(t):
    # the new reading has other ids, and of two blocks in three other words at the end
    words = F.split("text", " ")
    cut = F.when(F.col("block_order") % 3 == 0, F.upper("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), "  "))
    new = t("f_blocks").select("paper_id", F.concat(F.lit("new:"), "block_id").alias("block_id"), "block_order", cut.alias("text"))
    return nt.relocated(t("f_notes").select("paper_id", F.col("n").alias("anchor_id"), "excerpt"), new)


@query("not4_numbered", """
WITH new AS (SELECT paper_id, block_order AS "at", row_number() OVER (PARTITION BY paper_id ORDER BY block_order) AS turn FROM f_blocks WHERE kind = 'para' AND block_order % 4 <> 2),
most AS (SELECT paper_id, max(turn) AS turns FROM new GROUP BY paper_id),
used AS (SELECT paper_id, max(n) AS n FROM f_notes GROUP BY paper_id),
every AS (SELECT paper_id, unnest(range(1, CAST(turns + coalesce(n, 0) + 1 AS BIGINT))) AS n FROM most LEFT JOIN used USING (paper_id)),
free AS (SELECT paper_id, n, row_number() OVER (PARTITION BY paper_id ORDER BY n) AS turn FROM every WHERE (paper_id, n) NOT IN (SELECT (paper_id, n) FROM f_notes))
SELECT paper_id, "at", n FROM new JOIN free USING (paper_id, turn)""")
def _(t):
    new = t("f_blocks").where("kind = 'para' AND block_order % 4 <> 2").select("paper_id", F.col("block_order").alias("at"))
    return nt.numbered(t("f_notes"), new)


@query("not5_removed", "SELECT paper_id, n, text FROM f_notes WHERE n % 3 <> 0")
def _(t):
    return nt.removed(t("f_notes"), t("f_notes").where("n % 3 = 0")).select("paper_id", "n", "text")


@query("not6_newest", "SELECT paper_id, n, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY stamp DESC, n DESC) AS INT) AS place FROM f_notes")
def _(t):
    return nt.newest(t("f_notes")).select("paper_id", "n", "place")


@query("ret14_listing", """SELECT CAST(row_number() OVER (ORDER BY recent DESC, paper_id, stamp DESC, n DESC) AS INT) AS place, title, excerpt, text
  FROM (SELECT x.*, p.title AS title, coalesce(last_opened_at, added_at) AS recent FROM (SELECT * EXCLUDE (title) FROM f_notes) x JOIN f_papers p ON p.id = x.paper_id) ORDER BY place LIMIT 60""")
def _(t):
    return nt.listing(t("f_notes").drop("title"), t("f_papers"))


@query("tm7_version_keys", "SELECT block_id, CAST(prompt_version + 1000 * CASE created_at % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 0 END AS BIGINT) AS version FROM f_translations")
def _(t):
    lang = F.element_at(F.array(*[F.lit(x) for x in ("zh", "ja", "es", "none")]), (F.col("created_at") % 4).cast("int") + 1)
    return t("f_translations").select("block_id", tm.version_key(F.col("prompt_version"), lang).cast("long").alias("version"))


@query("tm14_restored", "SELECT block_id, replace(text, '⟦f1⟧', CASE WHEN block_order % 2 = 0 THEN '' ELSE 'x ⟦f1⟧' END) AS text FROM f_blocks")
def _(t):
    formulas = F.create_map(F.when(F.col("block_order") % 2 == 0, 2).otherwise(1), F.lit("x ⟦f1⟧"))
    return t("f_blocks").select("block_id", tm.restored(F.col("text"), formulas).alias("text"))


@query("seg4_units", """SELECT doc_id, chain, string_agg(replace(text, '⟦f1⟧', concat('⟦f', CAST(1 + coalesce("before", 0) AS VARCHAR), '⟧')), ' ⟦pb⟧ ' ORDER BY block_order) AS text
  FROM (SELECT *, CAST(sum(CASE WHEN contains(text, '⟦f1⟧') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chain ORDER BY block_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS "before"
    FROM (SELECT doc_id, block_order, text, CAST(floor(block_order / 12) AS BIGINT) AS chain FROM f_blocks)) GROUP BY doc_id, chain""")
def _(t):
    parts = t("f_blocks").select("doc_id", F.floor(F.col("block_order") / 12).alias("chain"), "block_order", "text")
    return tm.joined_units(parts, ["doc_id", "chain"])


@query("seg8_batch_answers", "SELECT doc_id, page, block_order AS n, trim(text) AS text FROM f_blocks")
def _(t):
    part = F.concat(F.lit("【"), F.col("block_order").cast("string"), F.lit("】 "), "text")
    said = t("f_blocks").groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("text"))
    return tm.batch_answers(said, ["doc_id", "page"])


@query("seg8_outline_answers", "SELECT doc_id, block_order AS n, trim(text) AS text FROM f_blocks WHERE kind = 'heading'")
def _(t):
    line = F.concat(F.lit(" "), F.col("block_order").cast("string"), F.when(F.col("block_order") % 2 == 0, ") ").otherwise("、"), "text")
    said = t("f_blocks").where("kind = 'heading'").groupBy("doc_id").agg(F.concat(F.lit("The titles:\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return tm.outline_answers(said, ["doc_id"])


_USD = "(CAST(input_tokens AS DOUBLE) * {} + CAST(output_tokens AS DOUBLE) * {}) / 1000000"


@query("cht6_udf4_turn_costs", f"SELECT event_id, CASE user_id % 5 WHEN 0 THEN {_USD.format('0.15', '0.6')} WHEN 1 THEN {_USD.format(3, 15)} WHEN 2 THEN 0 WHEN 3 THEN {_USD.format(2, 4)} ELSE {_USD.format('0.27', '1.1')} END AS usd FROM f_usage JOIN (SELECT event_id, user_id FROM events) USING (event_id)")
def _(t):
    return use.cost(t("f_usage"), F.contains("model", F.lit(":")), [("mystery", 2, 4), *use.PRICES]).select("event_id", "usd")


_NOTED = " OR ".join(f"contains(translation, '的{n}')" for n in dic.INFLECTED)
_KEPT = f"SELECT lower(word) AS word, coalesce(max_by({{'p': phonetic}}, seq).p, '') AS phonetic, max_by(translation, seq) AS translation FROM f_dictionary WHERE translation <> '' AND regexp_matches(word, '^[a-z][^ ]*$') AND length(word) <= {dic.LONGEST} AND (frq BETWEEN 1 AND {dic.RAREST} OR coalesce(bnc, 0) BETWEEN 1 AND {dic.RAREST} OR oxford > 0 OR length(word) <= {dic.SHORT} OR {_NOTED}) GROUP BY lower(word)"


@query("src14_trimmed_dictionary", _KEPT)
def _(t):
    return dic.trimmed(t("f_dictionary"))


_CUT = ", ".join(f"CASE WHEN ends_with(w, '{end}') THEN concat(left(w, length(w) - {len(end)}), '{instead}') END" for end, instead in dic.ENDINGS)
_BARE = ", ".join(f"CASE WHEN starts_with(w, '{p}') AND length(w) >= {len(p) + dic.LEFT_BY_PREFIX} THEN substr(w, {len(p) + 1}) END" for p in dic.PREFIXES)


@query("txt14_jn13_looked_up", f"""
WITH kept AS ({_KEPT}),
asked AS (SELECT DISTINCT concat(w, CASE length(w) % 3 WHEN 0 THEN 's' WHEN 1 THEN 'ing' ELSE '' END) AS w FROM f_words WHERE length(w) + CASE length(w) % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END <= 24),
plain AS (SELECT w, list_concat([w], list_filter([{_CUT}], lambda c: length(c) >= 2)) AS p FROM asked),
forms AS (SELECT w, list_concat(list_concat(p, list_transform(list_filter(p, lambda c: length(c) > 2 AND right(c, 1) = right(left(c, length(c) - 1), 1) AND regexp_matches(c, '[b-df-hj-np-tv-z]$')), lambda c: left(c, length(c) - 1))), list_filter([{_BARE}], lambda c: c IS NOT NULL)) AS c FROM plain),
placed AS (SELECT w, unnest(c) AS word, unnest(range(1, len(c) + 1)) AS place FROM forms)
SELECT w AS term, word, phonetic, translation FROM placed JOIN kept USING (word) QUALIFY row_number() OVER (PARTITION BY w ORDER BY place) = 1""")
def _(t):
    ending = F.when(F.char_length("w") % 3 == 0, "s").when(F.char_length("w") % 3 == 1, "ing").otherwise("")
    return dic.looked_up(t("f_words").select(F.concat("w", ending).alias("term")), dic.trimmed(t("f_dictionary")))


@query("tm13_repaired_marks", "SELECT block_id, concat(text, ' ^2^ 9', '^2^~i~', '. ') AS text FROM f_translations")
def _(t):
    source = F.concat("source", F.lit(" ^2^ ~i~ ^2^"))
    both = t("f_translations").select("block_id", F.concat("text", F.lit(" ^2^ ^9^. ")).alias("text")).join(t("f_blocks").select("block_id", F.col("text").alias("source")).hint("merge"), "block_id")
    return both.select("block_id", tm.repaired_marks(source, F.col("text")).alias("text"))


def _chunks(t, text):
    """Chunks of seven characters of ``text`` for each turn of the conversations."""
    rows = t("conversations").where("text IS NOT NULL").select(F.struct("conv_id", "turn").alias("key"), text.alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("t") - 1) / 7).cast("int")), lambda i: F.substring("t", i * 7 + 1, F.lit(7)))
    return rows.select("key", F.posexplode(cut).alias("seq", "chunk"))


@query("str9_without_thinking", "SELECT conv_id, turn, concat('Aha. ', text) AS text FROM conversations WHERE text IS NOT NULL")
def _(t):
    said = F.concat(F.lit("Aha. <think>so\n"), "text", F.lit("</think>"), "text", F.lit("<think>more"))
    return ans.whole_answers(_chunks(t, said)).select("key.conv_id", "key.turn", "text")


@query("str10_parts", "SELECT conv_id, turn, CAST(n AS BIGINT) AS n, trim(text) AS text FROM conversations, (VALUES (1), (3)) v(n) WHERE trim(text) <> ''")
def _(t):
    said = F.concat(F.lit("Well:\n【1】"), F.trim("text"), F.lit("\n【2】 <think>hm</think>\n【3】 "), F.trim("text"))
    return ans.whole_parts(_chunks(t, said)).select("key.conv_id", "key.turn", "n", "text")


_FILE = "concat('%PDF ', CAST(page_id % 300 AS VARCHAR), ' ', CASE WHEN page_id % 7 = 0 THEN html ELSE '' END)"


@query("src13_ingested", f"""SELECT id, min(path) AS path FROM (SELECT sha1({_FILE}) AS id, concat('/in/', lpad(CAST(page_id AS VARCHAR), 12, '0'), '.PDF') AS path, page_id FROM pages WHERE page_id % 5 <> 0 AND html IS NOT NULL AND page_id % 11 <> 0)
  WHERE id NOT IN (SELECT sha1({_FILE}) FROM pages WHERE html IS NOT NULL AND page_id % 13 = 0) GROUP BY id""")
def _(t):
    # files as pages make them: some of another kind, some that are none, repeats, and some known before
    ending = F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".PDF")
    content = F.when(F.col("page_id") % 11 != 0, F.expr(_FILE.replace("VARCHAR", "STRING")).cast("binary"))
    files = t("pages").where("html IS NOT NULL").select("page_id", F.concat(F.lit("/in/"), F.lpad(F.col("page_id").cast("string"), 12, "0"), ending).alias("path"), content.alias("content"))
    known = t("pages").where("html IS NOT NULL AND page_id % 13 = 0").select(F.sha1(F.expr(_FILE.replace("VARCHAR", "STRING"))).alias("id"))
    return fs.ingested(files, known)[0].select("id", "path")


@query("udf6_text_words", "SELECT doc_id, CAST(i - 1 AS INT) AS place, k[i] AS word FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '([a-zA-Z])-[ \\t\\n\\r\\f\\v]+([a-zA-Z])', '\\1\\2', 'g')), '[a-z0-9]+|[一-鿿㐀-䶿]') AS k FROM documents), UNNEST(range(1, len(k) + 1)) u(i)")
def _(t):
    docs = t("documents")
    register(docs.sparkSession)
    return docs.sparkSession.sql("SELECT doc_id, place, word FROM {docs}, LATERAL text_words(text)", docs=docs)


# a small glossary of each document's first words
_GLOSSARY = "SELECT doc_id, concat('terms:', {LF}, array_join(transform(w, x -> concat('  ', x, ': \"', x, ' s\"')), {LF}), {LF}, '  n: 5', {LF}, 'other: x', {LF}) AS content FROM (SELECT doc_id, slice(array_distinct(regexp_extract_all(text, '[a-z]{{4,}}', 0)), 1, 5) AS w FROM {documents})"


@query("src15_glossaries", "SELECT DISTINCT doc_id AS path, x AS term, concat(x, ' s') AS target FROM (SELECT doc_id, unnest(list_filter(k, lambda x, i: list_position(k, x) = i)[1:5]) AS x FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}') AS k FROM documents))")
def _(t):
    docs = t("documents")
    files = docs.sparkSession.sql(_GLOSSARY.replace("{LF}", "'\\n'"), documents=docs).withColumnRenamed("doc_id", "path")
    return fs.glossary_terms(files)
