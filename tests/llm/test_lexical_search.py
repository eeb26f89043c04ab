"""Ranked search against scores taken one by one."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, queries, k):
    """One (item, rank, id, score) after another."""
    found = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        scored = []
        for i, w in found:
            score = 0
            for t in set(terms(text)):
                tf = w.count(t)
                if tf:
                    m = 100 - 50 + (50 * len(w) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"W{i}" if i % 3 else f"ß{i}é" for i in range(400)])
    weight = 1 / np.arange(1, 401)
    prose = lambda n: " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    docs = [(i * 2, prose(int(n))) for i, n in enumerate(rng.integers(1, 80, 2500))]
    docs += [(9001 + i, docs[5][1]) for i in range(80)]  # ties
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (None, "w9 w10"), (8001, None), (8003, ""), (8005, " .,! "), (8007, "w5," * 30000), (8009, "ONLY here")]
    queries = [(i, prose(int(n))) for i, n in enumerate(rng.integers(1, 30, 30))]
    queries += [(100, None), (101, ""), (102, "unheardof"), (103, "only HERE w0"), (0, "w1 W1 w1"), (None, "w9"), (104, docs[5][1]), (105, docs[3][1])]
    return docs, queries


@pytest.mark.parametrize("size", [3_000, 60_000, ls.SHARD])
def test_ranks_and_scores(spark, tables, size):
    docs, queries = tables
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, rank int")
    got = [tuple(r) for r in ls.search(ls.index(frame, size=size), asked, k=50).select("item_id", "rank", "doc_id", "score").collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(by_hand(docs, queries, 50), key=order)


def test_turns_and_empty_tables(spark, tables, monkeypatch):
    docs, queries = tables
    frame, asked = spark.createDataFrame(docs[:300], "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(ls, "MOST_TERMS", 100)
    order = lambda x: tuple((v is None, v or 0) for v in x)
    got = [tuple(r) for r in ls.search(ls.index(frame), asked, k=3).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=order) == sorted(by_hand(docs[:300], queries, 3), key=order)
    assert ls.search(ls.index(frame.limit(0)), asked).collect() == []
    assert ls.search(ls.index(frame), asked.limit(0)).collect() == []
    assert ls.search(ls.index(frame.withColumn("text", F.lit(None).cast("string"))), asked).collect() == []


def test_blocks_stay_packed(spark, tables):
    """Once the bar is known, candidates are rejected by block maxima: most blocks of frequent terms are never unpacked."""
    docs, _ = tables
    rows = ls.index(spark.createDataFrame([(i, t) for i, t in docs if i is not None], "doc_id long, text string").coalesce(1)).collect()
    rows = [r.asDict() for r in rows]
    shape = (sum(r["docs"] for r in rows), sum(r["terms"] for r in rows))
    asked = {0: ["w1", "ß0é", "ß300é", "w2"]}
    weights = {t: (math.floor(1000 * math.log((2 * shape[0] + 2) / (2 * sum(r["df"] for r in rows if r["term"] == t) + 1))), 10**6) for t in asked[0]}
    weights = {t: (w, max(int(ls.impact(np.int64(tf), ls.lengths_to_m(np.int64(n), *shape))) for r in rows if r["term"] == t for _, tf, n in np.frombuffer(r["pairs"], ls._PAIR).tolist())) for t, (w, _) in weights.items()}
    heaps = {}
    first = ls.search_shard(rows, asked, weights, heaps, 1, shape)
    again = ls.search_shard(rows, asked, weights, heaps, 1, shape)
    assert sum(x.open.sum() for x in again.values()) < 0.5 * sum(len(again[t].last) for t in asked[0] if t in again)
    assert sum(x.open.sum() for x in again.values()) <= sum(x.open.sum() for x in first.values())
