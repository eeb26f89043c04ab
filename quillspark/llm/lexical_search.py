"""Ranked lexical search: Block-Max MaxScore over shards of posting lists.

A shard indexes some megabytes of whole documents. A posting list is cut into blocks of 64 documents that are packed
each for itself; beside a block stand its last document and its competitive pairs (occurrences, length), those that no other
pair of the block beats on both. What a block can add to a score follows from them exactly whatever the corpus's
counts are, so shards are built in one pass and can be added to later.

A search first sums each term's documents over all shards and finds the greatest impact of its whole list, the global
bound. Against the score of the k-th document found so far, the lists with the smallest bounds can't make a result
together: they are non-essential, and only documents of the other lists are candidates. The block maxima of the
non-essential lists then reject candidates before any block of these lists is unpacked. A task carries its heaps from shard
to shard, and the heaps of all tasks merge by a window over their best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .words import Words, slices

BLOCK = 64
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 8_000_000
#: Terms of queries that are broadcast at once; more are taken in turns, each over all shards.
MOST_TERMS = 200_000
#: Documents of a shard that are looked at before there are k results; each next window is twice as long.
WINDOW = 512
_HEAD = np.dtype([("last", "<i4"), ("at", "<i4"), ("gap", "u1"), ("tf", "u1")])
_PAIR = np.dtype([("block", "<i4"), ("tf", "<i4"), ("n", "<i4")])
# What separates terms, and the scale and shape of an impact.
NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
SCALE, TF_SCALE, M_SCALE, FULL, PART = 1_000_000_000, 1000, 20, 100, 50

INDEX = "shard long, term string, df int, docs long, terms long, heads binary, pairs binary, body binary"


def terms_of(text: Column) -> Column:
    """The terms of a text, as the index has them."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"[^{NO_TERM}]+"), F.lit(0))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (TF_SCALE * tf + M_SCALE * m)


def _sliced(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces of ``data`` between ``cuts`` as binary values."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _wide(most: np.ndarray) -> np.ndarray:
    """Bytes that hold numbers up to ``most``."""
    return np.select([most < 1 << 8, most < 1 << 16], [1, 2], 4).astype(np.uint8)


def shard_rows(ids: pa.Array, texts: pa.Array, shard: int) -> pa.RecordBatch:
    """The rows of one shard: its documents (term ""), then its posting lists by term."""
    words = Words(texts, lower=True, gaps=_GAPS)
    lengths, n_docs = words.counts, len(texts)
    named = words.named()
    order = np.argsort(np.array(named.dictionary.to_pylist(), object)) if len(named.dictionary) else np.zeros(0, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[named.indices.to_numpy(zero_copy_only=False)] * n_docs + np.repeat(np.arange(n_docs), lengths)
    key, tf = np.unique(key, return_counts=True)
    term, doc = np.divmod(key, max(n_docs, 1))
    df = np.bincount(term, minlength=len(order))
    first = np.cumsum(df) - df  # of each term's postings
    of_blocks = -(-df // BLOCK)
    block0 = np.concatenate([[0], np.cumsum(of_blocks)])  # of each term's blocks
    place = np.arange(len(key)) - first[term]
    block = block0[term] + place // BLOCK
    size = np.bincount(block, minlength=int(block0[-1]))
    begin = np.cumsum(size) - size
    gap = np.diff(doc, prepend=-1)
    gap[first] = doc[first] + 1  # from the document before the list's first
    heads = np.zeros(len(size), _HEAD)
    if len(size):
        heads["last"] = doc[begin + size - 1]
        heads["gap"] = _wide(np.maximum.reduceat(gap, begin))
        most = np.maximum.reduceat(tf, begin)
        heads["tf"] = np.where(most == 1, 0, _wide(most))
    room = size * (heads["gap"].astype(np.int64) + heads["tf"])
    upto = np.concatenate([[0], np.cumsum(room)])
    heads["at"] = upto[:-1] - np.repeat(upto[block0[:-1]], of_blocks)
    body = np.zeros(int(upto[-1]), np.uint8)
    within = np.arange(len(key)) - begin[block]
    at = upto[block]
    for numbers, wide, base in ((gap, heads["gap"][block], at), (tf, heads["tf"][block], at + size[block] * heads["gap"][block])):
        for j in range(4):
            held = wide > j
            body[(base + within * wide)[held] + j] = (numbers[held] >> (8 * j)) & 255
    # competitive pairs: from the most occurrences down, those shorter than all before
    n = lengths[doc]
    down = np.lexsort((n, -tf, block))
    step = n[down] - block[down] * (int(lengths.max(initial=0)) + 1)
    best = np.concatenate([[True], step[1:] < np.minimum.accumulate(step)[:-1]]) if len(step) else np.zeros(0, bool)
    kept = down[best]
    pairs = np.zeros(len(kept), _PAIR)
    pairs["block"], pairs["tf"], pairs["n"] = place[kept] // BLOCK, tf[kept], n[kept]
    of_pairs = np.searchsorted(term[kept], np.arange(len(order) + 1))
    known = ids.cast(pa.int64())
    own = [known.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known.is_null().to_numpy(zero_copy_only=False).tobytes(), lengths.astype("<i8").tobytes()]
    count = len(order)
    zeros = pa.array(np.zeros(count, np.int64))
    texts_of = named.dictionary.take(pa.array(order)).cast(pa.binary()).cast(pa.string()) if count else pa.array([], pa.string())
    many = [pa.array(np.full(count, shard)), texts_of, pa.array(df.astype(np.int32)), zeros, zeros, _sliced(heads, block0), _sliced(pairs, of_pairs), _sliced(body, upto[block0])]
    head = [pa.array([shard]), pa.array([""]), pa.array([n_docs], pa.int32()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), *[pa.array([x], pa.binary()) for x in own]]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(head, many, strict=True)], names=["shard", "term", "df", "docs", "terms", "heads", "pairs", "body"])


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHARD) -> DataFrame:
    """The index of all rows of ``docs``, a table (``INDEX``) in the shared folder, built where the documents are read, without a shuffle.

    A null or empty text and one without terms are documents without terms. Rows with a repeated id are documents of
    their own, rows without an id too. Ids are whole numbers; other columns are not read.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, 1, size)):
            if batch.num_rows:
                yield shard_rows(batch.column(0), batch.column(1), n)
                n += 1

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(build, INDEX), "index")


class PostingList:
    """A list of a shard; its blocks are unpacked when they are asked for."""

    def __init__(self, df: int, heads: bytes, pairs: bytes, body: bytes, m_of: np.ndarray, shape: tuple[int, int]):
        head, pair = np.frombuffer(heads, _HEAD), np.frombuffer(pairs, _PAIR)
        self.last, self.at, self.gap, self.tf = head["last"].astype(np.int64), head["at"].astype(np.int64), head["gap"].astype(np.int64), head["tf"].astype(np.int64)
        self.body, self.m_of = np.frombuffer(body, np.uint8), m_of
        self.size = np.full(len(head), BLOCK)
        self.size[-1] = df - BLOCK * (len(head) - 1)
        found = impact(pair["tf"].astype(np.int64), lengths_to_m(pair["n"].astype(np.int64), *shape))
        self.top = np.maximum.reduceat(found, np.searchsorted(pair["block"], np.arange(len(head))))
        self.docs = np.repeat(self.last, self.size)  # of a packed block, its last one
        self.impacts = np.zeros(df, np.int64)
        self.open = np.zeros(len(head), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        size = self.size[blocks]
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(first, size)

        def numbers(wide: np.ndarray, base: np.ndarray) -> np.ndarray:
            each, out = np.repeat(wide, size), np.zeros(len(within), np.int64)
            at = np.repeat(base, size) + within * each
            for j in range(int(wide.max())):
                held = each > j
                out[held] |= self.body[at[held] + j].astype(np.int64) << (8 * j)
            return out

        gaps = np.cumsum(numbers(self.gap[blocks], self.at[blocks]))
        before = np.where(blocks > 0, self.last[blocks - 1], -1)
        docs = gaps - np.repeat(np.where(first > 0, gaps[first - 1], 0), size) + np.repeat(before, size)
        tf = numbers(self.tf[blocks], self.at[blocks] + size * self.gap[blocks]) if self.tf[blocks].any() else np.ones(len(docs), np.int64)
        tf[np.repeat(self.tf[blocks] == 0, size)] = 1
        at = np.repeat(blocks * BLOCK, size) + within
        self.docs[at], self.impacts[at] = docs, impact(tf, self.m_of[docs])
        self.open[blocks] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) from ``low`` up to ``high``."""
        a, b = np.searchsorted(self.last, (low, high - 1))
        self.unpack(np.arange(a, min(b + 1, len(self.last))))
        i, j = np.searchsorted(self.docs, (low, high))
        return self.docs[i:j], self.impacts[i:j]

    def tops(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block of each document, the most that the block adds); behind the last block nothing is added."""
        block = np.searchsorted(self.last, docs)
        return block, np.append(self.top, 0)[block]

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The impacts of these documents."""
        out = np.zeros(len(docs), np.int64)
        inside = np.flatnonzero(block < len(self.last))
        self.unpack(np.unique(block[inside]))
        at = np.searchsorted(self.docs, docs[inside])
        same = self.docs[at] == docs[inside]
        out[inside[same]] = self.impacts[at[same]]
        return out


def lengths_to_m(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return FULL - PART + (PART * n * docs) // terms


class Heap:
    """The k best (score, id) of a query so far; equal scores by id, rows without an id behind."""

    def __init__(self, k: int):
        self.k, self.score, self.none, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.id, ids])
        best = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[best], none[best], ids[best]


def window_scores(lists: list[tuple[PostingList, int, int]], low: int, high: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) from ``low`` up to ``high`` with a score above 0 and not under ``bar``; ``lists``: (list, weight, bound), smallest bounds first."""
    bounds = np.cumsum([u for *_, u in lists])
    rest = int(np.searchsorted(bounds, bar))  # these lists together stay under the bar
    score = np.zeros(high - low, np.int64)
    for one, weight, _ in lists[rest:]:
        docs, found = one.between(low, high)
        score[docs - low] += weight * found
    docs = np.flatnonzero(score)
    score = score[docs]
    docs = docs + low
    if rest:
        near = score + bounds[rest - 1] >= bar
        docs, score = docs[near], score[near]
        told = [(one, weight, *one.tops(docs)) for one, weight, _ in reversed(lists[:rest])]
        can = score + sum(weight * top for _, weight, _, top in told)
        alive = np.flatnonzero(can >= bar)
        for one, weight, block, top in told:
            if not len(alive):
                break
            can[alive] += weight * (one.of(docs[alive], block[alive]) - top[alive])
            alive = alive[can[alive] >= bar]
        docs, score = docs[alive], can[alive]
    good = (score > 0) & (score >= bar)
    return docs[good], score[good]


def search_shard(rows: list[dict], asked: dict[int, list[str]], weights: dict[str, tuple[int, int]], heaps: dict[int, Heap], k: int, shape: tuple[int, int]) -> dict[str, PostingList]:
    """Brings the documents of one shard into the heaps; ``weights``: term to (weight, greatest impact), ``shape``: (documents, terms) of the corpus."""
    own = next(r for r in rows if r["term"] == "")
    ids, none, lengths = np.frombuffer(own["heads"], "<i8"), np.frombuffer(own["pairs"], bool), np.frombuffer(own["body"], "<i8")
    m_of = lengths_to_m(lengths, *shape)
    lists = {r["term"]: PostingList(r["df"], r["heads"], r["pairs"], r["body"], m_of, shape) for r in rows if r["term"] != ""}
    for q, terms in asked.items():
        found = [(lists[t], weights[t][0], weights[t][0] * weights[t][1]) for t in terms if t in lists]
        if not found:
            continue
        found.sort(key=lambda x: x[2])
        heap = heaps.setdefault(q, Heap(k))
        low, size = 0, WINDOW
        while low < len(ids):
            high = min(len(ids), low + size) if len(heap.score) < k else len(ids)
            docs, score = window_scores(found, low, high, heap.bar)
            if len(docs):
                heap.add(score, none[docs], ids[docs])
            low, size = high, 2 * size
    return lists


def search(index: DataFrame, queries: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): for each row of ``queries`` its ``k`` best documents with a score above 0, equal scores by id.

    A query's terms count once each. A null text or one without a known term finds nothing; rows that repeat an item are
    answered one by one; other columns are not read. Documents without an id come behind others of their score.
    """
    told = written(queries.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.array_distinct(terms_of(F.col(text))).alias("terms")), "queries")
    docs, terms, most = (x or 0 for x in [*index.agg(F.sum("docs"), F.sum("terms")).first(), told.agg(F.sum(F.size("terms"))).first()[0]])
    parts = [_turn(index, told.where(F.pmod(F.xxhash64("q"), F.lit(turns)) == turn), k, (docs, terms)) for turns in [max(1, -(-most // MOST_TERMS))] for turn in range(turns if docs else 0)]
    if not parts:
        return told.select(F.col("item").alias(item), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.hint("merge").join(told.select("q", "item").hint("merge"), "q").select(F.col("item").alias(item), "rank", "doc_id", "score")


def _turn(index: DataFrame, queries: DataFrame, k: int, shape: tuple[int, int]) -> DataFrame:
    """(q, doc_id, score): the heaps of all tasks for these queries."""
    asked = {r["q"]: r["terms"] for r in queries.where("size(terms) > 0").select("q", "terms").collect()}  # MOST_TERMS terms or one query
    names = queries.sparkSession.createDataFrame([(t,) for t in {t for x in asked.values() for t in x}], "term string")
    lists = index.join(F.broadcast(names), "term", "left_semi")

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for packed in batch.column("pairs"):
                pair = np.frombuffer(packed.as_py(), _PAIR)
                tops.append(int(impact(pair["tf"].astype(np.int64), lengths_to_m(pair["n"].astype(np.int64), *shape)).max()))
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("df"), pa.array(tops, pa.int64())], names=["term", "df", "top"])

    bounds = lists.select("term", "df", "pairs").mapInArrow(greatest, "term string, df int, top long").groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
    weights = {r["term"]: (math.floor(1000 * math.log((2 * shape[0] + 2) / (2 * r["df"] + 1))), r["top"]) for r in bounds.collect()}
    columns = ["shard", "term", "df", "heads", "pairs", "body"]
    rows = index.where("term = ''").select(columns).unionByName(lists.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Heap] = {}
        held: list[dict] = []
        for row in (row for batch in batches for row in batch.to_pylist()):
            if held and held[0]["shard"] != row["shard"]:
                search_shard(held, asked, weights, heaps, k, shape)
                held = []
            held.append(row)
        if held:
            search_shard(held, asked, weights, heaps, k, shape)
        for q, heap in heaps.items():
            ids = pa.array(heap.id, pa.int64(), mask=heap.none)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heap.id), q)), ids, pa.array(heap.score)], names=["q", "doc_id", "score"])

    return rows.repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(run, "q long, doc_id long, score long")
