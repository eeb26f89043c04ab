"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode, with_sha256
from .decontaminate import overlaps
from .html_extract import extract
from .jaccard_join import jaccard_components
from .language_id import held_out, learned, with_language
from .lattice_dedup import near_duplicates
from .lexical_search import NO_TERM, index, search
from .line_dedup import remove_spread_lines
from .packing import best_fit, measured
from .periodic import collapse
from .scratch import shared_dir
from .substring_dedup import remove_repeats
from .token_store import read_documents, write_shards
from .url_filter import judged

# The rules of op8 (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MIN_SITES = 10
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quillspark-shards-{uuid.uuid4().hex}"
    write_shards(_table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=1)
    return read_documents(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return best_fit(measured(docs, TOKENIZER), capacity=2048, rows=docs.count())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged(_table(spark, sf_dir, "pages"), rules)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = learned(docs.where(~held_out()))
    out = with_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_spread_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op11_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, decoded=True)
    out = out.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))
    return with_sha256(out).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=50)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one text in ten, by a hash of its id, the words from some place on repeat those there; a row without an id stays as it is."""

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                h = zlib.crc32(str(doc).encode())
                words = text.encode().split() if text and doc is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[i] = b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(planted, docs.select("doc_id", "text").schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse(with_periods(_table(spark, sf_dir, "documents")))
    # the run with the greatest length / period, compared as whole numbers; runs come by start and period
    out = out.withColumn("b", F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_token_store, op3_best_fit_packing, op4_substring_dedup, op5_decontamination, op6_jaccard_join, op7_lattice_dedup, op8_url_filter, op9_language_id, op10_line_dedup, op11_bpe_words, op12_ranked_search, op13_periodic_runs)}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL = {
    "op4_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM t, UNNEST(range(1, len(w) - 11)) u(i)),
first AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN first USING (h), UNNEST(range(0, 13)) v(k) WHERE doc_id > d),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)""",
    "op8_url_filter": rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
rules(rh, rp, rv) AS (VALUES {_RULES}),
hit AS (SELECT host, path, max({{'n': length(rh) + length(rp), 'h': length(rh), 'rule': rh || rp, 'verdict': rv}}) AS best
        FROM (SELECT DISTINCT host, path FROM v) d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, v.host, v.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM v LEFT JOIN hit USING (host, path)""",
    "op10_line_dedup": rf"""
WITH p AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, i, trim(lines[i]) AS line FROM p, UNNEST(range(1, len(lines) + 1)) u(i) WHERE trim(lines[i]) <> ''),
wide AS (SELECT line, min(doc_id) AS d FROM l GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
g AS (SELECT doc_id, list(i) AS gone FROM l JOIN wide USING (line) WHERE doc_id > d GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)], chr(10)) END) AS text_md5
FROM p LEFT JOIN g USING (doc_id)""",
    "op12_ranked_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{NO_TERM}]+')) AS w FROM documents),
p AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w),
len AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS all_docs, sum(n) AS all_terms FROM len),
d AS (SELECT w, count(*) AS df FROM p GROUP BY w),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{NO_TERM}]+')) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * all_docs + 2) / (2.0 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + CAST((50 * n * all_docs) // all_terms AS BIGINT))))) AS BIGINT) AS score
      FROM q JOIN p USING (w) JOIN d USING (w) JOIN len USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op6_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM t, UNNEST(range(1, greatest(len(w) - 3, 1) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * x >= 85 * (m.n + k.n - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op7_lattice_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
}
