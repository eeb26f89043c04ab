"""Benchmark decontamination with spaced seeds.

Each mask picks some of the words in a short span and ignores the others; equal hashes of the picked words in a
benchmark item and a document align the two. Along each such alignment the words are compared one by one; it
counts if a stretch is long enough and enough of it agrees, so substituted words do not hide a passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, give_back, mix, slices

#: Offsets of the words that a mask picks. Together they hit every stretch of 13 to 25 words of which 70 in 100 agree,
#: wherever the others are; a longer stretch like that holds one of these lengths.
MASKS = (
    (0, 1, 2, 3, 5, 6), (0, 3, 4, 7, 9, 10), (0, 1, 5, 7, 8, 10), (0, 2, 4, 8, 9, 10), (0, 1, 2, 7, 11, 12),
    (0, 1, 3, 4, 8, 9), (0, 1, 3, 4, 5, 7), (0, 1, 2, 6, 7, 9), (0, 2, 8, 10, 11, 12), (0, 2, 4, 6, 7, 8),
    (0, 1, 2, 3, 9, 10), (0, 4, 7, 10, 11, 12), (0, 1, 2, 4, 7, 10), (0, 1, 2, 3, 4, 8), (0, 1, 2, 3, 4, 5),
)
MIN_WORDS, MIN_SHARE = 13, 0.7
#: Benchmark words that are broadcast at once, with a seed of each mask; more are taken in turns.
BLOCK_WORDS = 500_000
_POLY = np.uint64(0xD6E8FEB86659FD93)


def seed_hashes(hashes: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    total = np.full(len(at), hash(mask) & 0xFFFFFFFF, np.uint64)
    for o in mask:
        total *= _POLY
        total += hashes[at + o]
    return mix(total)


class Seeds:
    """The seeds of a block of benchmark items and the words to verify against."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = ids
        words = Words(pa.array(texts, pa.string()), lower=True)
        self.hashes, self.first = words.hashes, words.first
        counts = words.counts
        spans = sorted({tuple(range(int(n))) for n in counts if 0 < n < MIN_WORDS})  # short items only count whole
        self.masks = [*MASKS, *spans]
        self.whole = set(spans)
        keys, where = [], []
        last = np.repeat(self.first[1:], counts)
        many = np.repeat(counts, counts)
        place = np.arange(len(last))
        for mask in self.masks:
            fits = (place + len(mask) == last) & (many == len(mask)) if mask in self.whole else (place + mask[-1] < last) & (many >= MIN_WORDS)
            at = np.flatnonzero(fits)
            keys.append(seed_hashes(self.hashes, at, mask))
            where.append(at)
        keys, where = np.concatenate(keys), np.concatenate(where)
        order = np.lexsort((where, keys))
        keys, self.where = keys[order], where[order].astype(np.int32)
        # places of one seed in one item are a run
        item = self.item_of(self.where)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
        self.run = np.append(np.flatnonzero(new), len(keys))
        self.keys, self.item = keys[new], item[new]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def item_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def found(self, words: Words) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start in text, start in item, words, agreeing words), the longest stretch of each text and item."""
        places, runs = [], []
        last = np.repeat(words.first[1:], words.counts)
        place = np.arange(len(last))
        for mask in self.masks:
            at = place[place + mask[-1] < last]
            keys = seed_hashes(words.hashes, at, mask)
            some = self.maybe[(keys >> np.uint64(42)).astype(np.int64)]
            at, keys = at[some], keys[some]
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
            places.append(np.repeat(at, high - low))
            runs.append(_ranges(low, high - low))
        places, runs = np.concatenate(places), np.concatenate(runs)
        if not len(places):
            return []
        both = words.texts_of(places) * len(self.ids) + self.item[runs]
        pairs, of = np.unique(both, return_inverse=True)
        hits = np.bincount(of, np.diff(self.run)[runs]).astype(np.int64)
        text, item = pairs // len(self.ids), pairs % len(self.ids)
        in_text, in_item = words.counts[text], np.diff(self.first)[item]
        # an alignment is named by where the item's first word would be in the text; if hits outnumber the alignments that there are, all are looked at
        many = hits >= in_text + in_item
        rest = ~many[of]
        n = np.diff(self.run)[runs[rest]]
        at_item = self.where[_ranges(self.run[runs[rest]], n)]
        which, origin = np.repeat(of[rest], n), np.repeat(places[rest], n)
        origin = origin - at_item + self.first[item[which]]
        every = np.flatnonzero(many)
        span = in_text[every] + in_item[every] - 1
        which, origin = np.append(which, np.repeat(every, span)), np.append(origin, _ranges(words.first[text[every]] - in_item[every] + 1, span))
        start, end = np.maximum(origin, words.first[text[which]]), np.minimum(origin + in_item[which], words.first[text[which] + 1])
        order = np.lexsort((start, start - end, which))
        which, origin, start, end = which[order], origin[order], start[order], end[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (origin[1:] != origin[:-1])
        best: dict = {}
        for w, o, a, b in zip(which[new].tolist(), origin[new].tolist(), start[new].tolist(), end[new].tolist(), strict=True):
            # alignments come by falling length: one that can't beat the best so far is skipped
            if w in best and best[w][:3] >= (b - a, b - a, -a):
                continue
            t, i = int(text[w]), int(item[w])
            shift = int(self.first[i]) - o
            same = words.hashes[a:b] == self.hashes[a + shift : b + shift]
            need = min(MIN_WORDS, int(in_item[w]))
            if np.count_nonzero(same) < MIN_SHARE * need:
                continue
            x, y, agree = _stretch(same)
            if need == MIN_WORDS and (y - x < need or agree < MIN_SHARE * (y - x)):
                x, y, agree = _longest(same)
            if y - x >= need and agree >= MIN_SHARE * (y - x):
                stretch = (y - x, agree, -(a + x), t, i, a + x - int(words.first[t]), a + x - o)
                best[w] = max(best.get(w, stretch), stretch)
        return [(t, i, s, p, n, agree) for n, agree, _, t, i, s, p in best.values()]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, n of them."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the stretch with the greatest sum, where a word that agrees is worth 1 and another -2."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def _longest(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the first of the longest stretches of which MIN_SHARE agree; the sums are in tenths of a word."""
    miss = round(10 * MIN_SHARE)
    sums = np.concatenate([[0], np.cumsum(np.where(same, 10 - miss, -miss))])
    later = np.maximum.accumulate(sums[::-1])[::-1]  # the greatest sum from here on falls, so its last place of a height is sought
    ends = np.searchsorted(-later, -sums, side="right") - 1
    start = int(np.argmax(ends - np.arange(len(sums))))
    return start, int(ends[start]), int(same[start : ends[start]].sum())


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """Bounded parts of the benchmark, one at a time on the driver."""
    items = benchmark.select("item_id", "text")
    words = items.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    n = max(1, math.ceil(words / BLOCK_WORDS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        if any((r["text"] or "").strip() for r in rows):
            yield Seeds([r["item_id"] for r in rows], [r["text"] for r in rows])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): the longest overlap of each document with each item.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. An overlap has at least 13 aligned
    words (for a shorter item: all its words, exactly) of which 70 in 100 agree. Of an alignment the stretch in which
    a word that agrees is worth 1 and another -2 is reported, or, if that is none, the longest one. Null or empty texts
    overlap with nothing; rows without an id, of documents or of the benchmark, are reported with a null one; the
    documents are read once for each half million words of benchmark.
    """
    schema = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"
    names = [x.split()[0] for x in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def told(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, "text")):
                found = shared.value.found(Words(batch.column("text"), lower=True))
                ids = batch.column("doc_id")
                rows = [(ids[t].as_py(), shared.value.ids[i], s, p, n, agree) for t, i, s, p, n, agree in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * 6)], names=names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(told, schema))
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item; texts stay in place, nothing is shuffled."""
    schema = T.StructType(docs.schema.fields)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, "text")):
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in shared.value.found(Words(batch.column("text"), lower=True))]] = False
                yield batch.filter(pa.array(keep))
            give_back()

        docs = docs.mapInArrow(clean, schema)
    return docs
