"""Runs and collapsed texts against a search over all periods."""

import hashlib
import random
import re
import zlib

import pytest

from quillspark.llm import periodic
from quillspark.llm.queries import op13_periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_hand(w):
    """(start, length, period) of all runs, by start and period."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rng):
    k, out = rng.choice([1, 2, 3, 5, 30]), []
    for _ in range(rng.randint(1, 8)):
        p = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 31, 40, 64, 100])
        root = [f"w{rng.randrange(k)}" for _ in range(p)]
        out += [root[i % p] for i in range(int(p * rng.uniform(1, 8)))] if rng.random() < 0.5 else [f"w{rng.randrange(3 * k)}" for _ in range(rng.randint(1, 60))]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["\t".join(made(rng)) + rng.choice(["", "  \n"]) for _ in range(400)]
    root = [f"r{i}" for i in range(3000)]
    texts += [None, "", " \n ", "a", "the " * 9000, " ".join(root * 4 + root[:77]), " ".join((root[:50] * 40 + ["x"]) * 4), "é\xa0ß " * 40, " ".join(["a"] * 23), " ".join(["a"] * 24)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 20), (3, "a b " * 20), (3, "a b " * 20)]


def test_collapse(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, runs int").repartition(3)
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic.collapse(docs).collect()]
    want = []
    for i, t in rows:
        found = by_hand(words(t)) if (t or "") != "the " * 9000 else [(0, 9000, 1)]
        want.append((i, found, collapsed(words(t), found)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(len(x[1]) for x in want) > 300
    assert periodic.collapse(docs.limit(0)).collect() == []


def test_query(spark, rows, tmp_path):
    rng = random.Random(6)
    prose = [(1000 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 400)))) for i in range(150)]
    table = [r for r in rows[:60] if r[1] is not None] + [(500, None), (501, "")] + prose
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want, planted = [], 0
    for i, t in table:
        w, h = words(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            planted += 1
        found = by_hand(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found))))
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert planted > 10
    assert sorted(got) == sorted(want)
