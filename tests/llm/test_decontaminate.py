"""What the masks hit and what decontamination finds, against brute force."""

from itertools import combinations

import numpy as np
import pytest

from quillspark.llm.decontaminate import MASKS, MIN_SHARE, MIN_WORDS, _longest, overlaps, without_overlaps

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
ITEM = [f"i{k}" for k in range(30)]


@pytest.mark.parametrize("n", range(13, 26))
def test_masks_hit_every_accepted_stretch(n):
    """With as many substitutions as 70 in 100 allow; a stretch of 26 words or more falls into parts of 13 to 25 of which one has that share."""
    k = 3 * n // 10
    gone = np.bitwise_or.reduce(np.uint32(1) << np.array(list(combinations(range(n), k)), np.uint32), axis=1)
    hit = np.zeros(len(gone), bool)
    for mask in MASKS:
        picked = sum(1 << o for o in mask)
        for s in range(n - mask[-1]):
            hit |= (gone & np.uint32(picked << s)) == 0
    assert hit.all()


def test_longest_stretch():
    rng = np.random.default_rng(2)
    for _ in range(300):
        same = rng.random(int(rng.integers(1, 40))) < rng.uniform(0.3, 0.9)
        fits = [(y - x, -x) for x in range(len(same)) for y in range(x + 1, len(same) + 1) if 10 * same[x:y].sum() >= 7 * (y - x)]
        x, y, agree = _longest(same)
        assert (y - x, -x) == max(fits, default=(0, 0)) and agree == same[x:y].sum()


def test_substituted_words_do_not_hide_a_passage(spark):
    fourth = ["x" if k % 4 == 3 else w for k, w in enumerate(ITEM)]
    rng = np.random.default_rng(3)
    places = [p for p in combinations(range(13), 3)]
    texts = [" ".join(fourth)] + [" ".join([*"abcde", *("x" if k in p else w for k, w in enumerate(ITEM[8:21])), *"fghij"]) for p in places]
    clean = [" ".join(rng.choice(ITEM, 40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([*texts, *clean])), DOCS)
    bench = spark.createDataFrame([(1, " ".join(ITEM))], ITEMS)
    found = overlaps(docs, bench).collect()
    assert {r["doc_id"] for r in found} == set(range(len(texts)))
    assert all(r["n_words"] >= MIN_WORDS and r["n_equal"] >= MIN_SHARE * r["n_words"] for r in found)


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, " ".join(["a", *ITEM])), (2, "short one"), (3, "clean")], DOCS)
    bench = spark.createDataFrame([(None, " ".join(ITEM)), (None, "short one"), (7, "other words"), (None, None)], ITEMS)
    assert sorted((r["doc_id"], r["item_id"]) for r in overlaps(docs, bench).collect()) == [(1, None), (2, None)]
    assert [r["doc_id"] for r in without_overlaps(docs, bench).collect()] == [3]
