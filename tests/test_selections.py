"""Selections, anchors and highlights against plain versions that go sign by sign."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.operators import selections as sl
from quillspark.operators.fingerprint import simhash

SPACE = re.compile(r"[\s\xa0  -     　﻿]")


def folded(s):
    out = [(c, i) for i, ch in enumerate(s) if ch != "-" and not SPACE.match(ch) for c in fixed.LIGATURES.get(ch, ch)]
    return "".join(c for c, _ in out), [i for _, i in out]


def located(text, sel):
    if sel in text:
        return text.index(sel), text.index(sel) + len(sel), "exact"
    words = [w for w in SPACE.split(sel) if w]
    if not words:
        return None
    m = re.search((SPACE.pattern + "+").join(map(re.escape, words)), text)
    if m:
        return m.start(), m.end(), "spaced"
    (b, where), (s, _) = folded(text), folded(sel)
    if len(s) < 4:
        return None
    if s in b:
        i = b.index(s)
        return where[i], where[i + len(s) - 1] + 1, "normal"
    if len(s) > 48:
        hi = next((b.find(s[:k]) for k in (24, 16, 10) if s[:k] in b), -1)
        for k in (24, 16, 10) if hi >= 0 else ():
            ti = b.find(s[-k:], hi + 10)
            if ti >= 0 and ti + k - hi <= 3 * len(s):
                return where[hi], where[ti + k - 1] + 1, "ends"
    return None


def made(rng):
    words = ["significant", "ﬁnd", "find", "the", "a", "co-operate", "x+y", "(see)", "[3]", "ﬂow", "state-of", "C#", "50%", "naïve", "中文"]
    text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\xa0", "-", " "]) for _ in range(rng.randint(1, 60)))
    a = rng.randrange(len(text))
    part = text[a : a + rng.choice([1, 3, 10, 40, 90, 200])]
    part = {
        0: lambda p: p, 1: lambda p: re.sub(r"\s+", "   ", p), 2: lambda p: p.replace("fi", "ﬁ").replace("ﬂ", "fl"), 3: lambda p: p.replace("nif", "ni-\nf").replace(" ", ""),
        4: lambda p: p[: len(p) // 2] + "NOISE ∑ noise" + p[len(p) // 2 :], 5: lambda p: "nowhere " + p, 6: lambda p: p + " " * 3, 7: lambda p: "",
    }[rng.randrange(8)](part)
    return text, part


def test_located(spark):
    rng = random.Random(8)
    rows = [made(rng) for _ in range(1500)] + [("abc", ""), ("", "a"), ("a b", " "), ("a.b*c", "a.b*c"), ("x a\\Eb", "a\\Eb"), ("a  \\Q b", "a \\Q b")]
    blocks = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(rows)] + [("null", None)], "block_id string, text string").repartition(4)
    asked = spark.createDataFrame([(str(i), s, 5) for i, (_, s) in enumerate(rows)] + [("null", "x", 1), ("none", "x", 2), ("0", None, 3)], "block_id string, selection string, start0 int")
    got = {(r["block_id"], r["start0"]): r["stage"] and (r["start"], r["stop"], r["stage"]) for r in sl.selections_in_blocks(asked, blocks).collect()}
    assert [got[str(i), 5] for i in range(len(rows))] == [located(t, s) for t, s in rows]
    assert got["null", 1] is None and got["none", 2] is None and got["0", 3] is None
    stages = [x and x[2] for x in got.values()]
    assert all(stages.count(s) > 20 for s in ("exact", "spaced", "normal", "ends", None))
    new = {r["block_id"]: r for r in sl.anchored(asked.where("start0 = 5"), blocks).collect()}
    for i, (t, s) in enumerate(rows):
        want = located(t, s)
        assert (new[str(i)]["char_start"], new[str(i)]["char_end"]) == (want[:2] if want else (0, len(t)))
        assert new[str(i)]["excerpt"] == (s if want else t)[:160] and new[str(i)]["quote"] == (s[:4000] if want and len(s) > 160 else None)


def snapped(text, at, step):
    for i in range(at, max(0, at - 40) - 1, -1) if step < 0 else range(at, min(len(text), at + 40) + 1):
        if i == 0 or text[i - 1] in fixed.SENTENCE_ENDS:
            return i
    return at


def projected(source, said, a, z, excerpt):
    n, size = len(said), len(source) or 1
    if excerpt and excerpt in said:
        start, stop, stage = said.index(excerpt), said.index(excerpt) + len(excerpt), "excerpt"
        stop = snapped(said, stop, 1) if len(excerpt) >= 160 else stop
    else:
        center, spans = (a + z) / 2 / size * n, []
        for t in dict.fromkeys(re.findall(fixed.SHARED_TOKEN, source[a:z], re.ASCII)):
            places = [i for i in range(len(said)) if said.startswith(t, i)]
            if places:
                best = min(places, key=lambda i: abs(i - center))
                spans.append((best, best + len(t)))
        low, high = (min(s for s, _ in spans), max(e for _, e in spans)) if spans else (math.floor(a / size * n), math.ceil(z / size * n))
        start, stop, stage = snapped(said, low, -1), snapped(said, high, 1), "tokens" if spans else "share"
    start, stop = max(0, min(start, n)), max(0, min(stop, n))
    return (start, stop, stage) if stop > start else None


def test_projected(spark):
    rng = random.Random(9)
    words = ["banana", "anana", "BLEU", "41.8", "7%", "ana", "x", "译文", "句子。", "end.", "so;", "Transformer-XL", "\n", "more"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    rows = []
    for i in range(600):
        source, said = text(40), text(60)
        a = rng.randint(0, len(source))
        z = rng.randint(a, len(source))
        b = rng.randint(0, max(0, len(said) - 1))
        rows.append((str(i), source, said, a, z, rng.choice([None, "", said[b : b + rng.choice([5, 200])], source[a:z][:160]])))
    blocks = spark.createDataFrame([(r[0], r[1]) for r in rows], "block_id string, text string")
    translations = spark.createDataFrame([(r[0], r[2]) for r in rows], "block_id string, text string")
    highlights = spark.createDataFrame([(r[0], 1, r[3], r[4], r[5]) for r in rows], "block_id string, id int, char_start int, char_end int, excerpt string")
    got = {r["block_id"]: (r["start"], r["stop"], r["stage"]) for r in sl.projected(highlights, blocks, translations).collect()}
    want = {r[0]: projected(*r[1:]) for r in rows}
    assert got == {k: v for k, v in want.items() if v}
    assert all(sum(v[2] == s for v in got.values()) > 20 for s in ("excerpt", "tokens", "share"))


def test_resolved(spark):
    words = [f"word{i}" for i in range(60)]
    blocks = [("p", "live", 1, " ".join(words)), ("p", "moved", 2, "Here the chosen passage stands, after all."), ("p", "again", 3, "and the chosen passage comes again"), ("p", "reused", 4, "of something else altogether, a new text"), ("p", "short", 5, "Tiny  ONE"), ("q", "other", 1, "the chosen passage of another paper")]
    table = spark.createDataFrame(blocks, "paper_id string, block_id string, block_order int, text string")
    near = " ".join([*words[:-1], "changed"])
    prints = {r["doc_id"]: r["simhash"] for r in simhash(spark.createDataFrame([("near", near), ("far", "quite unlike anything in here, whatever one may look for")], "doc_id string, text string")).collect()}
    anchors = spark.createDataFrame([
        ("p", "kept", "live", 3, 9, "gone text", prints["near"]), ("p", "held", "live", 3, 9, "word5 word6", prints["far"]), ("p", "excerpt", "old", 7, 25, "the chosen passage", prints["far"]),
        ("p", "whole", "old", 0, 300, "the chosen passage", prints["far"]), ("p", "print", "reused", 1, 5, "lost words are these", prints["near"]), ("p", "same", "old", 0, 8, "tiny one", prints["far"]), ("p", "lost", "reused", 1, 5, "nowhere at all", prints["far"]),
        ("p", "gone", "old", 1, 5, "nowhere at all", prints["far"]), ("z", "no paper", "old", 1, 5, "the chosen passage", prints["far"]),
    ], "paper_id string, anchor_id string, block_id string, char_start int, char_end int, excerpt string, print long")
    got = {r["anchor_id"]: (r["block_id"], r["char_start"], r["char_end"], r["rule"]) for r in sl.resolved(anchors, table).collect()}
    assert got == {
        "kept": ("live", 3, 9, "kept"), "held": ("live", 3, 9, "kept"), "excerpt": ("moved", 5, 23, "excerpt"), "whole": ("moved", 0, 42, "excerpt"), "print": ("live", 1, 5, "print"),
        "same": ("short", 0, 8, "print"), "lost": (None, 1, 5, "lost"), "gone": ("old", 1, 5, "gone"), "no paper": ("old", 1, 5, "gone"),
    }


@pytest.mark.parametrize("rows", [[], [("b", None)]])
def test_empty(spark, rows):
    blocks = spark.createDataFrame(rows, "block_id string, text string")
    assert sl.selections_in_blocks(blocks.select("block_id", F.lit("x").alias("selection")), blocks).where("stage IS NOT NULL").count() == 0


def test_places_are_taken_from_long_texts_without_a_row_of_signs(spark):
    """A block's signs used to become a list, whatever was asked of it."""
    text = "ab-c ﬁﬁ\u00a0dﬃ-x\x00y " * 3 + "wo rd " * 60_000 + "last-ﬄ one"
    frame = spark.createDataFrame([(text, "cfifid"), (text, "ffixy"), (text, "fixy ab c"), (text, "lastffl"), (text, "wordlast"), (text, "nowhere"), ("a", "----"), (None, "a")], "t string, s string").coalesce(1)
    made = frame.select("s", sl.located(F.col("t"), F.col("s")).alias("f"), "t")
    assert "flatten(" not in made._jdf.queryExecution().optimizedPlan().toString()
    for s, f, t in made.collect():
        signs = [(c, i) for i, sign in enumerate(t or "") if sign not in " \u00a0-\x00" for c in {"ﬁ": "fi", "ﬃ": "ffi", "ﬄ": "ffl"}.get(sign, sign)]
        bare = "".join(c for c, _ in signs)
        wanted = s.replace(" ", "").replace("-", "")
        at = bare.find(wanted) if len(wanted) >= 4 else -1
        assert (f and tuple(f)) == (None if at < 0 else (signs[at][1], signs[at + len(wanted) - 1][1] + 1, "normal")), s
