"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are dealt by a hash of their id into shards of bounded size; each is packed on its own, largest piece
first. Open bins are kept in order of their residual. Each carries a bitmap of its sources and one of its
duplicate clusters. From the tightest bin that has room, the search goes on to its successors until one is
compatible with both; if none is, a bin is opened.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_store import with_token_counts
from .words import tidy

#: Documents in a shard, about.
SHARD = 4000


class Bins:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; source and cluster are bits, 0 where nothing can conflict."""
        order, at = self.order, bisect.bisect_left(self.order, (size, -1))
        while at < len(order):
            residual, i = order[at]
            if not (self.sources[i] & source or self.clusters[i] & cluster):
                del order[at]
                break
            at += 1
        else:
            residual, i = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[i] |= source
        self.clusters[i] |= cluster
        if residual > size:
            bisect.insort(order, (residual - size, i))
        return i, self.capacity - residual


def _bits(values: list, only_repeated: bool) -> list[int]:
    seen: dict = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    bit = {v: 1 << i for i, v in enumerate(v for v in sorted(seen) if seen[v] > 1 or not only_repeated)}
    return [bit.get(v, 0) for v in values]


def best_fit(docs: DataFrame, capacity: int = 2048, rows: int | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset) for ``docs`` (doc_id, source, cluster, size).

    No bin holds two pieces of one source or of one cluster; a null source or cluster conflicts with nothing.
    A document larger than ``capacity`` is cut into full pieces, each a bin of its own, and one rest, which is
    packed as any other document; nothing is dropped. A size below 1 or null makes no piece. Ties go to the
    smaller doc_id. Bins never mix shards; bin_id is unique over all. Rows without an id are dealt to all shards by their
    place, so ``docs`` has to be a table that is read in the same order again; rows that repeat an id are packed each for itself; other columns are not read. ``rows`` is about how many rows there
    are, where counting ``docs`` would be dear.
    """
    sized = docs.select("doc_id", "source", "cluster", F.col("size").cast("long").alias("size")).where("size >= 1")
    shards = max(1, math.ceil((docs.count() if rows is None else rows) / SHARD))

    def packed(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, sizes = table.column("doc_id").to_pylist(), np.array(table.column("size").to_pylist(), np.int64)
        source, cluster = _bits(table.column("source").to_pylist(), True), _bits(table.column("cluster").to_pylist(), True)
        rest = sizes % capacity
        out: list[tuple] = []
        bins = Bins(capacity)
        for i in sorted(range(len(ids)), key=lambda i: (-int(rest[i]), ids[i] is None, ids[i] or 0, int(sizes[i]))):
            if rest[i]:
                n = int(rest[i])
                b, at = bins.place(n, source[i], cluster[i])
                out.append((ids[i], int(sizes[i]) // capacity, int(sizes[i]) - n, n, b, at))
        more = len(bins.sources)
        for i in range(len(ids)):
            for p in range(int(sizes[i]) // capacity):
                out.append((ids[i], p, p * capacity, capacity, more, 0))
                more += 1
        names = ("doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset")
        columns = dict(zip(names, zip(*out, strict=True) if out else [()] * 6, strict=True))
        columns["bin_id"] = [(shard << 32) + b for b in columns["bin_id"]]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    dealt = sized.withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "size"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(tidy(packed), "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long")


def measured(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text, source) as best_fit takes them: size is the number of ids and an end id; exact copies share
    a cluster, and null or empty texts none. Near copies do too if the caller has a cluster for them."""
    counted = with_token_counts(docs.select("doc_id", "source", "text"), tokenizer)
    return counted.select("doc_id", "source", F.unhex(F.md5(F.nullif("text", F.lit("")))).alias("cluster"), (F.col("n_tokens") + 1).alias("size"))
