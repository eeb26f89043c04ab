"""Documents near by fingerprint whose sets are apart, and chunks of hashes."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import fingerprint as fp


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 40)


def test_hashes_meet_over_chunks(spark, small_chunks):
    random = np.random.default_rng(3)
    base = random.integers(-(2**63), 2**63, 30)
    flips = [int(h) ^ sum(1 << int(b) for b in random.choice(63, k, replace=False)) for h in base for k in range(0, 9)]
    values = sorted({int(h) for h in [*base, *flips, 0, -1]})
    near = {(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 6}
    rows = fp.hashes_within(spark.createDataFrame([(v,) for v in [*values, *values[:5]]], "simhash long")).collect()
    assert len(rows) == len(near) and {tuple(r) for r in rows} == near


def _made(n: int) -> list[tuple[int, str]]:
    """Long texts of the same few words in other orders: near by fingerprint, apart as sets; every ninth is a near copy of the one before."""
    random = np.random.default_rng(5)
    words, out = [f"w{i}" for i in range(40)], []
    for i in range(n):
        said = [words[k] for k in np.minimum(random.geometric(0.25, 30 + 25 * (i % 8)), 40) - 1]
        out.append((i, f"{out[-1][1]} more {i}" if i % 9 == 8 else " ".join(said)))
    return [*out, (n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE")]


def test_verified_pairs_as_by_brute_force(spark, small_chunks):
    made = _made(150)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    prints = {r[0]: r[1] & (2**64 - 1) for r in fp.simhash(docs).select("doc_id", "simhash").collect()}
    sets = {i: {(a, b) for a, b in itertools.pairwise((t or "").split())} for i, t in made[:-2]}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if (prints[a] ^ prints[b]).bit_count() <= 6 and sets[a] and sets[b]]
    want = {(a, b) for a, b in near if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])} | {(152, 153)}
    assert {tuple(r) for r in fp.verified_pairs(docs).collect()} == want and len(near) > 5 * len(want) > 50
    found = {r["doc_id"]: (r["cluster"], r["size"]) for r in fp.clusters(docs).collect()}
    assert len(found) == len(made) and found[153] == (152, 2) and found[151] == (151, 1) and found[8][0] <= 7


def test_sketches_leave_few_pairs_of_sets(spark):
    """Sets used to meet for each pair of near fingerprints."""
    made = [(i, t) for i, t in _made(150) if t]
    sets = [(i, list({hash(p) for p in itertools.pairwise(t.split())})) for i, t in made if len(t.split()) > 1]
    frame = spark.createDataFrame(sets, "doc_id long, s array<long>").select("doc_id", F.lit(0).cast("long").alias("simhash"), F.size("s").alias("n"), fp._sketch("s").alias("sketch"))
    close = {tuple(r) for r in fp._close(frame, 6, 0.5).collect()}
    of = {i: set(s) for i, s in sets}
    linked = {(a, b) for a, b in itertools.combinations(of, 2) if 2 * len(of[a] & of[b]) >= len(of[a] | of[b])}
    assert linked <= close and len(close) < len(of) * (len(of) - 1) / 4


def test_what_is_located_begins_in_the_bare_text(spark):
    """Anchors are looked for in the blocks that pass this alone; before, in every block of the paper."""
    from quillspark.operators import selections as sl

    random = np.random.default_rng(9)
    signs = ["a", "b", "e", " ", "\t", "-", "\n", "ﬁ", "fi", " ", ".", "\u0000", "😀"]
    rows = []
    for _ in range(600):
        text = "".join(random.choice(signs, 90))
        part = text[(at := int(random.integers(0, 40))) : at + int(random.integers(0, 60))]
        rows.append((text, str(random.choice([part, part.replace(" ", "  "), part.replace("-", ""), part[:25] + "zz" + part[27:], part.replace("ﬁ", "fi")]))))
    found = spark.createDataFrame(rows, "text string, part string").select(
        sl.located(F.col("text"), F.col("part"))["stage"].alias("stage"), (sl.bare(F.col("text")) == sl.normal(F.col("text"))["text"]).alias("same"),
        F.contains(sl.bare(F.col("text")), F.left(sl.bare(F.col("part")), F.lit(10))).alias("may"),
    ).collect()
    assert all(r["same"] for r in found) and all(r["may"] for r in found if r["stage"]) and {"exact", "spaced", "normal", "ends"} <= {r["stage"] for r in found}


def test_cooldown_by_the_whole_time(spark):
    """Its SQL is; times were cut to milliseconds, in which an earlier event with a larger id came later."""
    import datetime as dt

    from quillspark.streaming import ledgers as led

    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(9, 100, 429), (1, 900, 200), (2, 60_000_099, 200), (3, 60_000_100, 200), (4, 60_000_900, 200)]
    log = spark.createDataFrame([(i, "s", start + dt.timedelta(microseconds=at), status) for i, at, status in rows], "event_id long, source string, ts timestamp, status int")
    assert {r["event_id"]: r["skipped"] for r in led.cooling(log).collect()} == {9: False, 1: True, 2: True, 3: False, 4: False}


def test_words_of_more_than_24_letters_are_not_looked_up(spark, tmp_path):
    """The SQL looked them up."""
    import duckdb

    from quillspark.plans import ORACLE_SQL, QUERIES

    made = spark.createDataFrame([(7 * i + 1, w, "en", "s", len(w)) for i, w in enumerate(["a" * 22 + " ab", "b" * 24, "c" * 21, "d" * 23, "e" * 22 + "s"])], "doc_id long, text string, lang string, source string, n_chars long")
    made.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["txt14_jn13_looked_up"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(con.execute(ORACLE_SQL["txt14_jn13_looked_up"]).fetchall()) == got and max(len(r[0]) for r in got) == 23


def test_one_plan_of_lattice_tables():
    """Tables were others from a million vectors on, so a link could come and go with the size of the input."""
    from quillspark.llm.lattice_dedup import PLANS

    assert len(PLANS) == 1 and PLANS[0][0] == float("inf")


def test_bm25_over_shards_and_blocks(spark, monkeypatch):
    """Each hit of a term used to be a row; now shards of documents meet blocks of questions, with ties by id across them."""
    from math import log

    from quillspark.operators import retrieval as ret

    monkeypatch.setattr(ret, "SHARD", 12)
    monkeypatch.setattr(ret, "AT_ONCE", 5)
    random = np.random.default_rng(2)
    words = [f"word{i}" for i in range(15)]
    texts = {i: [words[j] for j in np.minimum(random.geometric(0.2, 1 + i % 6) - 1, 14)] for i in range(60)}
    asked = {i: [words[j] for j in random.choice(15, 1 + i % 4, replace=False)] for i in range(30)} | {30: ["nowhere"]}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in words}
    part = lambda w, t: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    want = set()
    for q, ws in asked.items():
        scores = sorted((-round(sum(part(w, t) for w in ws if w in t), 6), i) for i, t in texts.items() if set(ws) & set(t))
        want |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(scores[:4])}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], f"{key} long, text string")
    got = ret.bm25(frame(asked, "question_id"), ret.postings(frame(texts, "doc_id"), "doc_id"), 4, "doc_id")
    assert {tuple(r) for r in got.collect()} == want
    assert ret.bm25(frame(asked, "question_id"), ret.postings(frame(texts, "doc_id").limit(0), "doc_id"), 4, "doc_id").count() == 0


def test_hashes_meet_once_within_a_chunk(monkeypatch):
    """Each hash used to meet all others of its chunk, those before it as well."""
    met, count = [], np.bitwise_count
    monkeypatch.setattr(fp.np, "bitwise_count", lambda x: met.append(x.size) or count(x))
    monkeypatch.setattr(fp, "AT_ONCE", 50)
    hashes = np.array([(1 << 40) + (i << 7 * 3) for i in range(90)], np.uint64)
    found = {(int(x), int(y)) for i, j in fp._met(hashes, hashes, 6, True) for x, y in zip(i, j, strict=True)}
    want = {(x, y) for x, y in itertools.combinations(range(90), 2) if int(hashes[x] ^ hashes[y]).bit_count() <= 6}
    assert found == want and sum(met) <= 0.6 * 7 * 90 * 90


def test_fingerprints_of_long_and_odd_lists():
    """Counters of 16 bits are emptied before they are full, and a token's units are those of UTF-16."""
    import pyarrow as pa

    def fnv(said):
        h = fp.FNV_OFFSET
        for unit in np.frombuffer(said.encode("utf-16-le"), "<u2").tolist():
            h = (h ^ unit) * fp.FNV_PRIME % (1 << 64)
        return h

    lists = [[], None, ["a"], ["x", "\U0001d4b3y", "", "\u6a21"], ["same"] * 70_000, [str(i % 7) for i in range(140_001)]]
    value, has = fp._votes(pa.array(lists, pa.list_(pa.string())))
    for said, got, some in zip(lists, value.view(np.uint64).tolist(), has.tolist(), strict=True):
        features = collections.Counter([*(said or []), *(f"{a} {b}" for a, b in itertools.pairwise(said or []))])
        of = {f: fnv(f) for f in features}
        n = sum(features.values())
        assert got == sum(1 << bit for bit in range(64) if 2 * sum(c for f, c in features.items() if of[f] >> bit & 1) > n) and some == (n > 0)


def test_search_asks_for_all_terms(spark):
    """Only the first twelve terms of a question were looked for; ret1_query_terms still lists the first twelve, as its SQL says."""
    from quillspark.operators import retrieval as ret
    from quillspark.plans import ORACLE_SQL

    docs = spark.createDataFrame([(1, "term0"), (2, "thirteenth")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, " ".join([*(f"none{i}" for i in range(12)), "thirteenth"])), (8, "nothing")], "question_id long, text string")
    assert [tuple(r)[:2] for r in ret.bm25(asked, ret.postings(docs, "doc_id"), 8, "doc_id").collect()] == [(7, 2)]
    assert "1:12" not in ORACLE_SQL["ret3_top5_bm25"]


def _sent(df):
    """Rows that the exchanges of ``df`` gave."""
    df.collect()
    todo, sent = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == "Exchange":
            sent += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.executedPlan()] if p.nodeName().startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
    return sent


def test_chunks_multiply_no_rows(spark, small_chunks):
    """A row used to be shuffled once for each chunk, so the disk that fingerprints and sketches took grew with the square of the documents."""
    rows = spark.range(400).select((F.col("id") * 7919).alias("simhash"))
    assert _sent(fp.hashes_within(rows)) <= 400


def test_sets_of_one_group_do_not_meet_pair_by_pair(spark, small_chunks, monkeypatch):
    """Near copies are a square of pairs; sets used to be shuffled for each of them, and to be written for all documents."""
    monkeypatch.setattr(fp, "MOST_PAIRS", 30)
    monkeypatch.setattr(fp, "MOST_IDS", 3)
    base = [f"w{i}" for i in range(80)]
    made = _made(150) + [(1000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    pairs = {tuple(r) for r in fp.verified_pairs(docs).collect()}
    of = {i: i for i, _ in made}
    for _ in range(9):
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    want = {(i, c, sum(x == c for x in of.values())) for i, c in of.items()}
    assert {tuple(r) for r in fp.clusters(docs).collect()} == want
    links = {tuple(r) for r in fp._component_links(docs, 6, 0.5).collect()}
    assert len(pairs) > 400 and links <= pairs and len(links) < len(pairs) / 2
