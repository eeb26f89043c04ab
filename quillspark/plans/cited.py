"""Queries on citations, selections and translated units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..llm.scratch import written
from ..operators import biblio as bib
from ..operators import citations as ct
from ..operators import context as cx
from ..operators import memory as tm
from ..operators import selections as sl
from ..operators import structure as st
from ..operators import units as un
from ..operators.fingerprint import simhash
from .registry import query

# each line of a document cites names made of its own words; every sixth one is an entry of the bibliography
_CITING = """SELECT paper_id, block_order, CASE WHEN block_order % 6 = 5 THEN 'References' ELSE section END AS section, CASE WHEN block_order % 6 = 5 THEN 'para' ELSE kind END AS kind,
  CASE WHEN block_order % 6 = 5 THEN concat('[', block_order, '] ', a, ', K.', CASE block_order % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' and ', b, ', L.') ELSE concat(', ', b, ', L., ', c, ', M.') END, ' Of something. ', 2000 + doc_id % 3, '.')
       ELSE concat(text, ' (', a, ' et al., ', 2000 + doc_id % 3, '; ', b, ' ', 2000 + block_order % 3, ') and ', a, ' and ', c, ', ', 2000 + doc_id % 3) END AS text
FROM (SELECT *, initcap(coalesce(get(w, block_order % 5), 'Aa')) AS a, initcap(coalesce(get(w, 1), 'Bb')) AS b, initcap(coalesce(get(w, 2), 'Cc')) AS c
  FROM (SELECT *, first_value(words) OVER (PARTITION BY paper_id ORDER BY block_order) AS w FROM (SELECT *, slice(regexp_extract_all(text, '[a-z]{{3,}}', 0), 1, 5) AS words FROM {f_blocks})))"""


@query("bib15_bib16_citations")
def _(t):
    blocks = t("f_blocks")
    made = blocks.sparkSession.sql(_CITING, f_blocks=blocks)
    return ct.cited(ct.citations(made.where("coalesce(section, '') <> 'References'"), ["paper_id", "block_order"]), ct.entries(made))


# parts of paragraphs as they are copied from a page: as they are, spaces doubled, hyphens at line ends, ligatures on the page, something else in the middle, and from elsewhere
_SELECTED = """SELECT block_id, block_order, CASE WHEN block_order % 6 = 3 THEN replace(text, 'fi', 'ﬁ') ELSE text END AS text,
  CASE block_order % 6 WHEN 1 THEN replace(part, ' ', '  ') WHEN 2 THEN replace(part, 'e', concat('-', {LF}, 'e')) WHEN 4 THEN concat(substr(part, 1, 60), ' ∑ x=1 ', substr(part, 61)) WHEN 5 THEN concat('zz', part) ELSE part END AS selection
FROM (SELECT block_id, block_order, text, substr(text, CAST(1 + block_order % 30 AS INT), CAST(20 + (block_order * 7 + doc_id) % 130 AS INT)) AS part FROM {f_blocks} WHERE kind = 'para') b"""


def _selected(t):
    blocks = t("f_blocks")
    return blocks.sparkSession.sql(_SELECTED.replace("{LF}", "'\\n'"), f_blocks=blocks)


_PLAIN = "regexp_replace(regexp_replace({}, '[\\s\\xA0-]', '', 'g'), 'ﬁ', 'fi', 'g')"
_SIGNS = "list_filter(list_transform(string_split(text, ''), lambda c, i: {'c': CASE c WHEN 'ﬁ' THEN 'fi' ELSE c END, 'i': i - 1}), lambda x: NOT regexp_matches(x.c, '^[\\s\\xA0-]$'))"


@query("not1_located", f"""
WITH s AS ({_SELECTED.replace('{LF}', 'chr(10)').replace('{f_blocks}', 'f_blocks')}),
p AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(selection, '[\\s\\xA0]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\-])', '\\\\\\1', 'g')), '[\\s\\xA0]+') AS pattern,
  {_PLAIN.format('text')} AS b, {_PLAIN.format('selection')} AS n, flatten(list_transform({_SIGNS}, lambda x: CASE WHEN x.c = 'fi' THEN [x.i, x.i] ELSE [x.i] END)) AS m FROM s),
q AS (SELECT *, instr(text, selection) AS e, CASE WHEN pattern <> '' THEN regexp_extract(text, pattern) ELSE '' END AS hit, instr(b, n) AS w,
  coalesce(nullif(instr(b, left(n, 24)), 0), nullif(instr(b, left(n, 16)), 0), nullif(instr(b, left(n, 10)), 0)) AS hi FROM p),
r AS (SELECT *, list_filter(list_transform([24, 16, 10], lambda k: {{'k': k, 'at': CASE WHEN instr(substr(b, hi + 10), right(n, k)) > 0 THEN instr(substr(b, hi + 10), right(n, k)) + hi + 9 ELSE 0 END}}), lambda t: t.at > 0 AND t.at + t.k - hi <= 3 * length(n)) AS tails FROM q),
d AS (SELECT *, CASE WHEN e > 0 THEN 'exact' WHEN hit <> '' THEN 'spaced' WHEN length(n) >= 4 AND pattern <> '' AND w > 0 THEN 'normal' WHEN length(n) > 48 AND pattern <> '' AND hi IS NOT NULL AND len(tails) > 0 THEN 'ends' END AS stage FROM r)
SELECT block_id, CAST(CASE stage WHEN 'exact' THEN e - 1 WHEN 'spaced' THEN instr(text, hit) - 1 WHEN 'normal' THEN m[w] WHEN 'ends' THEN m[hi] END AS INT) AS start,
  CAST(CASE stage WHEN 'exact' THEN e - 1 + length(selection) WHEN 'spaced' THEN instr(text, hit) - 1 + length(hit) WHEN 'normal' THEN m[w + length(n) - 1] + 1 WHEN 'ends' THEN m[tails[1].at + tails[1].k - 1] + 1 END AS INT) AS stop, stage FROM d""")
def _(t):
    made = _selected(t)
    return sl.selections_in_blocks(made.select("block_id", "selection"), made.select("block_id", "text")).select("block_id", "start", "stop", "stage")


@query("not2_resolved")
def _(t):
    # the new reading has other ids for two blocks in three, and texts at the places of others
    was, notes = t("f_blocks"), t("f_notes")
    prints = simhash(was.select(F.col("block_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("block_id"), F.col("simhash").alias("print"))
    anchors = notes.select("paper_id", F.col("n").alias("anchor_id"), "block_id", "char_start", "char_end", "excerpt").join(prints.hint("merge"), "block_id")
    moved = F.concat_ws(":", "paper_id", "page", (F.col("block_order") + F.when(F.col("block_order") % 3 == 0, 0).otherwise(1)).cast("string"))
    return sl.resolved(anchors, was.where("block_order % 5 <> 1").select("paper_id", moved.alias("block_id"), "block_order", "text").dropDuplicates(["block_id"]))


_MARKED = """SELECT block_id, CAST(block_order AS INT) AS id, CAST(block_order * 3 % 40 AS INT) AS char_start, CAST(block_order * 3 % 40 + 15 + doc_id % 60 AS INT) AS char_end,
  CASE block_order % 3 WHEN 0 THEN lower(substr(text, 3, 25)) WHEN 1 THEN substr(text, 1, 20) END AS excerpt FROM {f_blocks} WHERE kind = 'para'"""


@query("not3_projected")
def _(t):
    blocks, said = t("f_blocks"), t("f_translations")
    marked = blocks.sparkSession.sql(_MARKED, f_blocks=blocks)
    return sl.projected(marked, blocks, said.select("block_id", "text"))


_CHAINS = "SELECT doc_id, CAST(floor(block_order / 12) AS BIGINT) AS chain, block_order, text FROM {f_blocks}"


@query("seg5_round_trip", f"SELECT doc_id, chain, block_order, text, CAST(NULL AS VARCHAR) AS reason FROM ({_CHAINS.replace('{f_blocks}', 'f_blocks')})")
def _(t):
    blocks = t("f_blocks")
    parts = blocks.sparkSession.sql(_CHAINS, f_blocks=blocks)
    return un.split_units(parts, tm.joined_units(parts, ["doc_id", "chain"]), ["doc_id", "chain"]).drop("source")


@query("tm16_prompts", """
WITH g AS (SELECT string_agg(concat(term, ' => ', target), chr(10) ORDER BY term) AS lines FROM (SELECT DISTINCT source AS term, concat('<', source, '>') AS target FROM documents WHERE source IS NOT NULL)),
n AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM f_blocks WHERE kind IN ('para', 'heading') WINDOW w AS (PARTITION BY doc_id ORDER BY block_order))
SELECT block_id, concat('Translate.', chr(10), chr(10), 'Terms:', chr(10), lines) AS system, concat_ws(concat(chr(10), chr(10)), CASE WHEN b <> '' THEN concat('【上文】', b) END, concat('【本段】', text), CASE WHEN a <> '' THEN concat('【下文】', a) END) AS user FROM n, g""")
def _(t):
    terms = t("documents").where("source IS NOT NULL").select(F.col("source").alias("term"), F.concat(F.lit("<"), "source", F.lit(">")).alias("target")).distinct()
    return un.prompts(t("f_blocks"), terms, "Translate.", "Terms:", "zh")


# headings are units of their own, six lines of text another one; every fifth document got no answer
_UNITS = "SELECT doc_id, block_id, block_order, text, CASE WHEN kind = 'heading' THEN block_id ELSE concat(paper_id, ' ', CAST(floor(block_order / 6) AS {S})) END AS unit FROM {f_blocks} WHERE kind <> 'figure'"


@query("tm17_applied", f"""
WITH u AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n, regexp_matches(text, '\\b[a-z]{{2,}}\\b') AS prose FROM ({_UNITS.replace('{f_blocks}', 'f_blocks').replace('{S}', 'VARCHAR')}))
SELECT block_id, CASE WHEN doc_id % 5 <> 0 THEN lower(text) WHEN n = 1 AND NOT prose THEN text END AS text, CASE WHEN doc_id % 5 = 0 AND n = 1 AND NOT prose THEN 'identity' ELSE 'stub' END AS model,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN n > 1 THEN 'blank' WHEN prose THEN 'untranslated' END END AS reason FROM u""")
def _(t):
    blocks = t("f_blocks")
    parts = blocks.sparkSession.sql(_UNITS.replace("{S}", "STRING"), f_blocks=blocks).withColumn("known", F.lit(True))

    def stub(asked):
        said = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<think>so</think>Translation: "), F.lower("text"))).otherwise(F.lower("text"))
        return asked.select("unit", said.alias("text"), F.lit("p").alias("provider"), F.lit("stub").alias("model"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))

    asked = tm.joined_units(parts, ["doc_id", "unit"])
    return un.translated(parts, asked, stub, "en")[0].drop("unit")


# every user's turn is a question on a paper; what it hits in the text and in translations is told by its words' numbers
_ASKED = "SELECT concat(session_id, ':', id) AS question_id, sha1(CAST(session_id % 150 AS STRING)) AS paper_id, text AS question, id % 7 = 0 AS whole FROM {f_chat} WHERE role = 'user'"
_HITS = "SELECT question_id, block_id, {number} FROM {asked} q JOIN {f_blocks} b USING (paper_id) WHERE NOT whole AND (length(question) + block_order * {step}) % {every} = 0 {rest}"


def _contexts(t):
    # written, as it is read for hits, leads, samples, outlines and texts, and each reading would shuffle all texts to make it
    chat, blocks = t("f_chat"), written(t("f_blocks"), "blocks")
    sql = lambda text, **frames: blocks.sparkSession.sql(text, **frames)
    asked = sql(_ASKED, f_chat=chat)
    made = lambda number, step, every, rest: sql(_HITS.replace("{number}", number).replace("{step}", str(step)).replace("{every}", str(every)).replace("{rest}", rest), asked=asked, f_blocks=blocks)
    hits = made("CAST(row_number() OVER (PARTITION BY question_id ORDER BY block_order) AS INT) AS rank", 3, 17, "AND length(question) % 3 <> 0").where("rank <= 8")
    said = made("CAST(1 + block_order % 4 AS INT) AS score, row_number() OVER (PARTITION BY question_id ORDER BY block_order) AS r", 5, 23, "AND length(question) % 2 = 0").where("r <= 8").drop("r")
    return asked, cx.chosen(asked, blocks, hits, said), blocks


@query("ret8_chosen")
def _(t):
    return _contexts(t)[1].select("question_id", "block_id", "place")


@query("ret9_contexts")
def _(t):
    asked, chosen, blocks = _contexts(t)
    return cx.contexts(chosen, asked, blocks, t("f_papers").select("id", "title"))


# another edition's units: some begin as a block does, numbered or in capitals, some don't
_EDITION = "SELECT paper_id, block_order AS unit_order, CASE block_order % 4 WHEN 0 THEN concat('3.1 ', upper_ascii) WHEN 1 THEN concat('**', text, '** more') WHEN 2 THEN 'Not in there at all' ELSE text END AS text FROM (SELECT *, {UP} AS upper_ascii FROM {f_blocks})"
_UP = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_KEY = "left(regexp_replace(lower(regexp_replace(regexp_replace({}, '⟦f\\d+⟧|\\*\\*|[*^~]', '', 'g'), '^\\s*(?:[A-Z]|\\d+)(?:\\.\\d+)*\\.?\\s+', '')), '[^a-z]+', '', 'g'), 48)"


@query("seg9_jn14_placed", f"""
WITH u AS (SELECT paper_id, unit_order, {_KEY.format('text')} AS k FROM ({_EDITION.replace('{UP}', _UP).replace('{f_blocks}', 'f_blocks')})),
b AS (SELECT paper_id, k, min({{'p': page, 'o': block_order}}) AS f FROM (SELECT paper_id, page, block_order, {_KEY.format('text')} AS k FROM f_blocks WHERE kind IN ('para', 'heading')) WHERE length(k) >= 12 GROUP BY ALL),
s AS (SELECT paper_id, min({{'p': page, 'o': block_order}}).o AS start FROM f_blocks GROUP BY paper_id),
m AS (SELECT u.paper_id, unit_order, start, last_value(f IGNORE NULLS) OVER (PARTITION BY u.paper_id ORDER BY unit_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM u JOIN s USING (paper_id) LEFT JOIN b ON b.paper_id = u.paper_id AND b.k = u.k AND length(u.k) >= 12)
SELECT paper_id, unit_order, coalesce(f.o, start) AS block_order, coalesce(f.p, 1) AS page FROM m""")
def _(t):
    blocks = t("f_blocks")
    return st.placed_units(blocks.sparkSession.sql(_EDITION.replace("{UP}", _UP), f_blocks=blocks), blocks)


# papers that lack something, what their first pages say, and records, a third of them with another title
_LACKING = "SELECT id, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Cut' ELSE substr(title, 1, 80) END AS title, CASE WHEN doc_id % 2 = 0 THEN 'Someone' END AS authors, year, 'arXiv' AS source, CASE WHEN doc_id % 8 = 0 THEN concat('A', CAST(doc_id % 300 AS {S})) END AS arxiv_id, CASE WHEN doc_id % 9 = 0 THEN concat('10.1/', CAST(doc_id % 200 AS {S})) END AS doi, meta_edited FROM {f_papers}"
_FIRST = "SELECT id, concat(title, ' by Somebody') AS text, CASE WHEN doc_id % 3 = 0 THEN concat('A', CAST(doc_id % 300 AS {S})) END AS arxiv_id, doc_id % 6 = 0 AS stamped, CASE WHEN doc_id % 5 = 0 THEN concat('10.1/', CAST(doc_id % 200 AS {S})) END AS doi FROM {f_papers}"
_OFFERED = "SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN concat(title, ' two') ELSE title END AS title, CASE WHEN rec_id % 4 = 1 THEN 'Nobody Else' ELSE 'A. Somebody' END AS author, CASE WHEN rec_id % 2 = 0 THEN concat('A', CAST(rec_id AS {S})) END AS arxiv_id, CASE WHEN rec_id % 2 = 1 THEN concat('10.1/', CAST(rec_id AS {S})) END AS doi FROM {f_bib}"
_LETTERS = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _made(t, sql, table):
    frame = t(table)
    return frame.sparkSession.sql(sql.replace("{S}", "STRING"), **{table: frame})


_DUCK = lambda sql, table: sql.replace("{S}", "VARCHAR").replace(f"{{{table}}}", table)


@query("bib13_bib14_trusted", f"""
WITH o AS (SELECT *, {_LETTERS.format('title')} AS k FROM ({_DUCK(_LACKING, 'f_papers')}) WHERE NOT meta_edited AND (authors IS NULL OR year IS NULL OR source IS NULL OR NOT coalesce(regexp_matches(title, '\\S\\s+\\S'), false))),
p AS (SELECT o.*, f.text, f.stamped, o.arxiv_id IS NOT NULL OR f.stamped AS sure_a, o.doi IS NOT NULL AS sure_d, coalesce(o.arxiv_id, f.arxiv_id) AS a, coalesce(o.doi, f.doi) AS d FROM o LEFT JOIN ({_DUCK(_FIRST, 'f_papers')}) f USING (id)),
r AS (SELECT *, {_LETTERS.format('title')} AS rk FROM ({_DUCK(_OFFERED, 'f_bib')})),
h AS (SELECT id, 1 AS rank, rec_id FROM p JOIN r ON p.a = r.arxiv_id WHERE sure_a OR (k <> '' AND k = rk) UNION ALL SELECT id, 2, rec_id FROM p JOIN r ON p.d = r.doi WHERE sure_d OR (k <> '' AND k = rk)
  UNION ALL SELECT id, 3, rec_id FROM p JOIN r ON k <> '' AND k = rk AND author = 'A. Somebody' AND contains(lower(text), 'somebody') OR k <> '' AND k = rk AND author = 'Nobody Else' AND contains(lower(text), 'else')),
b AS (SELECT id, min({{'rank': rank, 'rec_id': rec_id}}) AS hit FROM h GROUP BY id)
SELECT id, hit.rec_id AS rec_id, ['arxiv', 'doi', 'title'][hit.rank] AS rule FROM b""")
def _(t):
    records = _made(t, _OFFERED, "f_bib").withColumn("authors", F.array("author")).drop("author")
    return bib.trusted_hits(_made(t, _LACKING, "f_papers").drop("doc_id"), _made(t, _FIRST, "f_papers"), records)
