"""run() of the pipeline against a brute-force version, with foreign and gibberish documents beside clean ones."""

import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import STAGES, run
from quillspark.llm.queries import TOKENIZER

KNOWN = {
    "de": "der die das und ein eine hund katze straße haus läuft schnell über durch nicht auch wird werden zeit jahr schule kinder wasser stadt grün später zwischen immer wieder gegen möchte können",
    "en": "the a and of to in dog cat street house runs quickly over through not also will would time year school children water town green later between always again against should could",
    "es": "el la los y de un una perro gato calle casa corre rápido sobre por no también será tiempo año escuela niños agua ciudad verde después entre siempre otra contra quiere pueden",
    "fr": "le la les et de un une chien chat rue maison court vite sur par ne pas aussi sera temps année école enfants eau ville vert après entre toujours encore contre voudrait peuvent",
}
FOREIGN = [
    "Pies i kot biegną szybko wzdłuż głównej ulicy miasta, podczas gdy mieszkańcy patrzą z okien swoich starych domów i piją gorącą herbatę.",
    "Koira ja kissa juoksevat nopeasti kaupungin pääkatua pitkin, kun asukkaat katsovat vanhojen talojensa ikkunoista ja juovat kahvia.",
    "Собака и кошка быстро бегут по главной улице города, а жители смотрят из окон своих старых домов и пьют горячий чай.",
    "犬と猫は町の大通りを速く走り、住民は古い家の窓から見ています。子供たちは学校で水を飲みます。",
    "asdf qwer zxcv lkjh poiu mnbv gfds trew yuio hjkl vbnm qaz wsx edc rfv tgb yhn ujm ikl plo wqa sxz",
    "1234 5678 !!",
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_run(spark, tmp_path):
    rng = np.random.default_rng(5)
    item = " ".join(rng.choice(KNOWN["en"].split(), 20))
    rows = []
    for lang, vocab in KNOWN.items():
        for i in range(60):
            text = " ".join(rng.choice(vocab.split(), int(rng.integers(40, 90))))
            if i % 10 == 3:
                text = text + " " + item
            if i % 4 == 1:
                text += "\n" + " ".join(vocab.split()[:6])
            rows.append((len(rows), text, lang, f"s{i % 40}", len(text)))
    for d in range(0, 240, 30):
        text = rows[d][1].rsplit(" ", 1)[0] + " anders"
        rows.append((len(rows), text, rows[d][2], "copy", len(text)))
    foreign = len(rows)
    rows += [(foreign + i, t, None, f"f{i}", len(t)) for i, t in enumerate(FOREIGN)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]

    docs = {r[0]: r[1].split("\n") for r in rows[:foreign]}
    sites, first = {}, {}
    for d, lines in docs.items():
        for x in lines:
            sites.setdefault(x, set()).add(rows[d][3])
            first.setdefault(x, d)
    docs = {d: "\n".join(x for x in lines if len(sites[x]) < 10 or first[x] == d) for d, lines in docs.items()}
    sets = {d: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for d, t in docs.items()}
    least = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                least[b] = min(least[b], least[a])
    kept = {d: t for d, t in docs.items() if least[d] == d and item not in t}
    assert 200 < len(kept) < len(docs) < len(rows)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert got == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept.items()}


def test_stages_on_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(KNOWN[lang].split(), 40)), lang, f"s{i % 12}", 0, "x", 1, None) for i, lang in enumerate(list(KNOWN) * 20)]
    clean = len(rows)
    other = " ".join(rng.choice(KNOWN["fr"].split(), 40))
    rows += [(None, rows[0][1], "de", "s1", 0, "y", 2, 3), (500, None, "en", None, None, None, None, None), (501, "", None, "s1", 0, None, None, None), (7, other, "fr", "s", 0, "z", 4, 5), (502, rows[1][1] * 300, "en", "s3", 1, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, gone string, n_lines int, score double"
    rows = [(*r[:7], None if r[7] is None else float(r[7])) for r in rows]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "no such passage in any of these documents at all it seems to be")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        kept = {r["doc_id"]: r for r in out.collect()}
        assert set(range(clean)) <= set(kept), name
        assert kept[7]["text"] in (rows[7][1], other) and kept[0]["gone"] == "x" and kept[0]["n_lines"] == 1
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    packed = STAGES[-1][1](spark, docs, str(tmp_path))
    sizes = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert sizes[500] == sizes[501] == 1 and sizes[502] == len(tokenizer.encode(rows[-1][1], add_special_tokens=False).ids) + 1
    assert STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
