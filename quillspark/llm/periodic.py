"""Runs: stretches of words that repeat with a period, found over tiles of each octave of periods.

A period q of the octave [w, 2w) has its run's matching words (those equal to the word q further on) over 2q words or more, so
two boundaries at least out of those at multiples of w lie among them, and behind the first of these w words in a row
match. So a document falls into tiles of five w around boundaries, for each octave; a tile where no window of w words
comes again q words later can hold nothing and isn't sent. (Periods under 8 have their own tiles with w = 8, as a run is
24 words long at least.) Tiles are dealt out over the cluster and solved for themselves: Z-functions forwards and
backwards from the boundary tell how far each period matches, and whether its root is itself a repetition. What a tile finds are
fragments; shuffled by document and period, those that meet are stitched into runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, mix, slices

#: A run has so many words and so many periods at least.
LEAST, TIMES = 24, 3
SMALL = 8
#: Words of a strip of neighbouring tiles that are sent as one row; a larger tile is a row of its own.
STRIP = 8192
_POLY = np.uint64(0xC2B2AE3D27D4EB4F)
TILES = "key string, w int, low int, at long, step0 int, n int, size int, wide int, codes binary"
RUN = "struct<start: long, length: long, period: long>"


def octaves(longest: int) -> Iterator[tuple[int, int, int]]:
    """(w, smallest period, end of periods) of each octave that a text of so many words can have."""
    if longest >= LEAST:
        yield SMALL, 1, SMALL
    w = SMALL
    while TIMES * w <= longest:
        yield w, w, 2 * w
        w *= 2


def boundaries(words: Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(w, smallest period, text, boundary) of the tiles of each octave that can hold a fragment."""
    hashes, width = words.hashes, 1
    n, end = words.counts, len(words.hashes)
    for w, low, high in octaves(int(n.max(initial=0))):
        while width < w:
            longer = mix(hashes[:-width] * _POLY + hashes[width:])
            hashes, width = longer, 2 * width
        many = np.where(n >= low + w, (n - low - w) // w + 1, 0)
        text = np.repeat(np.arange(len(n)), many)
        c = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * w
        padded = np.concatenate([hashes, np.zeros(high + end - len(hashes), np.uint64)])
        later = np.lib.stride_tricks.sliding_window_view(padded, high - low)
        kept = []
        for a in range(0, len(c), max(1, (1 << 20) // w)):
            part = slice(a, a + max(1, (1 << 20) // w))
            at = words.first[text[part]] + c[part]
            row, col = np.nonzero(later[at + low] == padded[at][:, None])
            row = row[c[part][row] + low + col + w <= n[text[part]][row]]
            kept.append(a + np.unique(row))
        found = np.concatenate([np.zeros(0, np.int64), *kept])
        yield w, low, text[found], c[found]


def tile_rows(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The tiles of some documents, neighbouring ones in strips (``TILES``): ``at`` is the first word, ``step0`` the first boundary in it, ``n`` their number."""
    words = Words(texts)
    out: list[tuple] = []
    codes = None
    for w, low, text, c in boundaries(words):
        if not len(text):
            continue
        if codes is None:
            codes = words.named().indices.to_numpy(zero_copy_only=False)
        island = np.cumsum(np.concatenate([[True], (text[1:] != text[:-1]) | (c[1:] != c[:-1] + w)]))
        place = np.arange(len(c)) - np.searchsorted(island, island)
        first = np.flatnonzero(place % max(1, STRIP // w - 4) == 0)
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(c)], strict=True):
            t = int(text[i])
            begin, stop = int(words.first[t]), int(words.first[t + 1])
            a, b = max(begin, begin + int(c[i]) - w), min(stop, begin + int(c[j - 1]) + 4 * w)
            distinct, local = np.unique(codes[a:b], return_inverse=True)
            wide = 2 if len(distinct) <= 1 << 16 else 4
            packed = pa.Codec("zstd", compression_level=1).compress(local.astype(f"<u{wide}").tobytes(), asbytes=True)
            out.append((keys[t].as_py(), w, low, a - begin, begin + int(c[i]) - a, j - i, b - a, wide, packed))
    names = [x.split()[0] for x in TILES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def z_function(x: np.ndarray) -> list[int]:
    """For each place how many values from there on are those at the beginning; 0 at the beginning itself."""
    z, s, n = [0] * len(x), x.tolist(), len(x)
    left = right = 0
    for i in (np.flatnonzero(x[1:] == x[0]) + 1).tolist() if n else []:
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            k = max(k, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def solve(x: np.ndarray, b: int, w: int, low: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the fragments of the tile around the boundary ``b``: the words from start up to end equal those a period later.

    Told are periods that go on for ``w`` words from the boundary and whose root is no repetition of a shorter one.
    """
    high = 2 * low if low >= SMALL else SMALL
    ahead = z_function(x[b : b + 4 * w])
    periods = [q for q in range(low, min(high, len(ahead))) if ahead[q] >= w]
    if not periods:
        return []
    multiple = {q for d in range(1, high // 2 + 1) if d < len(ahead) and ahead[d] >= d for q in range(2 * d, min(d + ahead[d], high - 1) + 1, d)}
    before, past = x[max(0, b - w) : b][::-1], x[max(0, b - w) : b + high][::-1]
    behind = z_function(np.concatenate([before, [-1], past])) if b else None
    out = []
    for q in periods:
        if q not in multiple:
            back = behind[len(before) + 1 + len(past) - min(b, w) - q] if b else 0
            out.append((q, b - back, b + min(ahead[q], 2 * w)))
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for key, w, low, at, step0, n, size, wide, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x = np.frombuffer(pa.Codec("zstd").decompress(packed, decompressed_size=wide * size, asbytes=True), f"<u{wide}").astype(np.int64)
            for i in range(n):
                b = step0 + i * w
                a = max(0, b - w)
                for q, start, end in solve(x[a : b + 4 * w], b - a, w, low):
                    keys.append(key)
                    found.append((q, at + a + start, at + a + end))
        columns = np.array(found, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(columns[:, k]) for k in range(3)]], names=["key", "period", "start", "stop"])


def run_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """What rows with the same id and text have in common; their runs are the same."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs): the runs of each text that has any, by start and period; ``key`` is ``run_key``."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield tile_rows(batch.column(0), batch.column(1))

    found = docs.select(run_key(id_col, text).alias("key"), F.col(text).alias("t")).mapInArrow(tiles, TILES)
    fragments = found.repartition("key", "w", "low", "at").mapInArrow(_solved, "key string, period long, start long, stop long")
    order = Window.partitionBy("key", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = fragments.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    stitched = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    whole = stitched.withColumn("length", F.col("stop") - F.col("start") + F.col("period")).where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    listed = whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("r"))  # a text has fewer runs than words
    return listed.select("key", F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def collapse(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, runs, text) of each row: its runs, and its words without those that a run holds after its first period, joined by one space.

    A run is a stretch of words with smallest period q, ``TIMES`` * q words long and ``LEAST`` at least, that no
    neighbouring word extends. A word is a run of bytes other than 0x20 and 0x09-0x0D; a null or empty text has none, no runs, and
    an empty text. Rows without an id or with a repeated one are judged for themselves; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), run_key(id_col, text).alias("key"))
    both = rows.hint("merge").join(runs(docs, id_col, text).hint("merge"), "key", "left").select("id", "t", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = []
            for t, told in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                mine = (t.as_py() or b"").split()
                if len(told):
                    edge = np.zeros(len(mine) + 1, np.int64)
                    for r in told.as_py():
                        edge[r["start"] + r["period"]] += 1
                        edge[r["start"] + r["length"]] -= 1
                    mine = [mine[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                texts.append(b" ".join(mine).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=[id_col, "runs", text])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(collapsed, f"`{id_col}` {kind}, runs array<{RUN}>, `{text}` string")
