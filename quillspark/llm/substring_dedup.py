"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is the text from one word on; the trees are cut at a depth of ``width`` words, as a repeat that long is all
that is asked for. Which suffixes go into which subtree is told by prefixes of variable length: one first word where
few suffixes start with it, two, four, eight or all words where many do, until each prefix has few enough suffixes for a
task's memory. In a subtree suffixes are sorted by their words; neighbours with ``width`` words in common hang under one
internal node of that depth, and a node with suffixes of several blocks of documents is a repeat.

A suffix that no other block can share is left out before it is sent: of the eight-word stretches in a window the one
with the smallest hash is its anchor, equal windows have equal anchors, and anchors of one block alone are found first.
Suffixes travel with a 16-bit code of each word and a 64-bit name, and match when all of these agree. A block sends
each suffix once, so that a passage that a third of all documents hold is as many entries as there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, shuffle_partitions
from .words import Words, member, mix, offered_keys, pack, repeated_keys, run_hashes, runs_of, slices, told_keys, unpack

#: Prefix lengths in words that are tried in turn; the window's width follows as the last.
PREFIXES = (1, 2, 4, 8)
#: Suffixes in a subtree, about (34 bytes each).
TREE = 2_000_000
#: Counters of a prefix length: so many for each split of the input (some twenty subtrees), within these bounds.
BINS_A_SPLIT, FEWEST_BINS, MOST_BINS = 1 << 8, 1 << 12, 1 << 20
#: Words in an anchor.
ANCHOR = 8


def _counted(batches: Iterator[pa.RecordBatch], levels: tuple[int, ...], bins: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(levels), bins), np.int64)
    for batch in (part for whole in batches for part in slices(whole, 0)):
        words = Words(batch.column(0))
        at, _ = words.runs(levels[-1])
        for i, n in enumerate(levels[:-1]):
            total[i] += np.bincount(_bin(run_hashes(words.hashes, at, n), bins), minlength=bins)
        total[-1, 0] += len(at)
    level, at = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"level": level.astype(np.int32), "bin": at.astype(np.int32), "n": total[level, at]})


def _bin(prefix: np.ndarray, bins: int) -> np.ndarray:
    return (prefix >> np.uint64(40)).astype(np.int64) % bins


class Routes:
    """The subtree of a suffix: that of its shortest prefix whose counter is low enough, over all documents."""

    def __init__(self, heavy: np.ndarray, levels: tuple[int, ...], trees: int):
        self.heavy, self.levels, self.trees = heavy, levels, trees

    def __call__(self, words: Words, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        for i, n in enumerate(self.levels):
            prefix = run_hashes(words.hashes, at[todo], n)
            # a whole window that is still too frequent is one node: its copies are one entry for each block
            fits = ~self.heavy[i][_bin(prefix, self.heavy.shape[1])] if n < self.levels[-1] else np.ones(len(todo), bool)
            out[todo[fits]] = (mix(prefix[fits] + np.uint64(n)) % np.uint64(self.trees)).astype(np.int64)
            todo = todo[~fits]
        return out


def routes(docs: DataFrame, width: int, tree: int = TREE) -> Routes:
    """Counts the prefixes of all suffixes of ``docs`` (text); only the counters that are too high come to the driver, of which there are at most some tens for each subtree."""
    levels = (*[n for n in PREFIXES if n < width], width)
    bins = min(MOST_BINS, max(FEWEST_BINS, BINS_A_SPLIT * docs.rdd.getNumPartitions()))
    found = docs.mapInArrow(lambda it: _counted(it, levels, bins), "level int, bin int, n long").groupBy("level", "bin").agg(F.sum("n").alias("n"))
    found = found.persist()  # recomputed where an executor goes
    total = found.where(F.col("level") == len(levels) - 1).agg(F.sum("n")).first()[0] or 0
    trees = max(shuffle_partitions(docs), -(-total // tree))
    heavy = np.zeros((len(levels), bins), bool)
    for r in found.where((F.col("level") < len(levels) - 1) & (F.col("n") > max(1, total // (4 * trees)))).select("level", "bin").collect():
        heavy[r["level"], r["bin"]] = True
    found.unpersist()
    return Routes(heavy, levels, trees)


# --- suffixes -------------------------------------------------------------


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name, anchor) of each window of ``width`` words that lies in one text."""
    at, names = words.runs(width)
    n = min(ANCHOR, width)
    short = np.zeros(len(words.starts), np.uint64)
    place, hashes = words.runs(n)
    short[place] = hashes
    least = short[at]
    for j in range(1, width - n + 1):
        np.minimum(least, short[at + j], out=least)
    return at, names, least


def codes(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """16 bits of each of the ``width`` words from each position on, four words in a number, the first one highest."""
    out = np.zeros((-(-width // 4), len(at)), np.uint64)
    for j in range(width):
        out[j // 4] |= (hashes[at + j] >> np.uint64(48)) << np.uint64(48 - 16 * (j % 4))
    return out


def packed_suffixes(path: np.ndarray, names: np.ndarray, width: int) -> bytes:
    flat = np.concatenate([np.ascontiguousarray(path.T).astype(">u8").view(np.uint8).reshape(len(names), -1)[:, : 2 * width], names.astype("<u8")[:, None].view(np.uint8).reshape(-1, 8)], axis=1)
    return len(names).to_bytes(8, "little") + pa.Codec("zstd").compress(np.ascontiguousarray(flat.T).tobytes(), asbytes=True)


def unpacked_suffixes(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, wide = int.from_bytes(data[:8], "little"), 2 * width + 8
    flat = np.ascontiguousarray(np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=n * wide, asbytes=True), np.uint8).reshape(wide, n).T)
    path = np.zeros((n, -(-width // 4) * 8), np.uint8)
    path[:, : 2 * width] = flat[:, : 2 * width]
    return path.view(">u8").astype(np.uint64).T, np.ascontiguousarray(flat[:, 2 * width :]).view("<u8").ravel().astype(np.uint64)


def deep_nodes(path: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, which suffixes in it hang under the same node of full depth as the one before): a subtree as a sorted list."""
    order = np.lexsort((names, *path[::-1]))
    same = np.zeros(len(order), bool)
    same[1:] = names[order][1:] == names[order][:-1]
    for part in path:
        same[1:] &= part[order][1:] == part[order][:-1]
    return order, same


def _same_words(words: Words, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for j in range(width):
        out &= words.hashes[a + j] == words.hashes[b + j]
    return out


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")]))


def _known(table: pa.Table) -> bool:
    return bool(table.num_rows) and table.column("blk")[0].as_py() >= 0


def remove_repeats(docs: DataFrame, width: int = 13, tree: int = TREE) -> DataFrame:
    """(doc_id, n_words, n_removed, text): ``docs`` (doc_id, text) without words under an earlier document's window.

    A word is a run of bytes other than 0x20 and 0x09-0x0D. It goes when a window of ``width`` words of its
    document that covers it also starts in a document with a smaller doc_id; windows are judged on the input.
    Kept words are joined by one space. A null or empty text has no words and gives an empty text; a row without
    a doc_id is kept whole and is nobody's earlier document; rows with equal ids are one another's equals and
    do not remove from one another. Other columns of ``docs`` are not read. ``tree`` is about how many suffixes a
    subtree may hold.
    """
    blocks = in_blocks(docs, ["doc_id", "text"])
    parts = shuffle_partitions(docs)
    route = routes(docs.where(F.col("doc_id").isNotNull()).select("text"), width, tree)

    def anchors(table: pa.Table) -> pa.Table:
        keys = np.unique(_anchors(Words(table.column("text")), width)[2]) if _known(table) else np.zeros(0, np.uint64)
        return offered_keys(keys, table.column("blk")[0].as_py(), parts)

    def leaves(table: pa.Table, told: pa.Table) -> pa.Table:
        out = {"tree": [], "blk": [], "suffixes": []}
        if _known(table) and told.num_rows:
            words = Words(_sorted(table).column("text"))
            at, names, anchor = _anchors(words, width)
            some = np.flatnonzero(told_keys(anchor, told, parts))
            names, first = np.unique(names[some], return_index=True)
            at = at[some[first]]
            to, path = route(words, at), codes(words.hashes, at, width)
            order = np.lexsort((*path[::-1], to))
            for a, b in runs_of(to[order]):
                mine = order[a:b]
                out["tree"].append(int(to[mine[0]]))
                out["blk"].append(table.column("blk")[0].as_py())
                out["suffixes"].append(packed_suffixes(path[:, mine], names[mine], width))
        return pa.table(out, schema=pa.schema([("tree", pa.int64()), ("blk", pa.int32()), ("suffixes", pa.binary())]))

    def repeats(table: pa.Table) -> pa.Table:
        blk = table.column("blk").to_numpy()
        order = np.argsort(blk, kind="stable")
        lists = [unpacked_suffixes(table.column("suffixes")[int(i)].as_py(), width) for i in order]
        path, names = np.concatenate([x for x, _ in lists], axis=1), np.concatenate([x for _, x in lists])
        of = np.repeat(blk[order], [len(x) for _, x in lists])
        order, later = deep_nodes(path, names)  # equal suffixes stay in order of blocks: all but the first have an earlier one
        names, of = names[order][later], of[order][later]
        order = np.lexsort((names, of))
        names, of = names[order], of[order]
        out = [(int(of[a]), pack(names[a:b])) for a, b in runs_of(of)]
        return pa.table({"blk": pa.array([x[0] for x in out], pa.int32()), "nodes": pa.array([x[1] for x in out], pa.binary())})

    def judged(table: pa.Table, told: pa.Table) -> pa.Table:
        table = _sorted(table)
        words = Words(table.column("text"))
        gone = np.zeros(len(words.starts) + 1, np.int64)
        if _known(table):
            at, names = words.runs(width)
            late = member(names, np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack(x.as_py()) for x in told.column("nodes")]])))
            order = np.argsort(names, kind="stable")  # ids grow along each run of equal suffixes
            a, b = at[order[:-1]], at[order[1:]]
            same = names[order[1:]] == names[order[:-1]]
            same[same] = _same_words(words, a[same], b[same], width)
            owner = table.column("doc_id").to_numpy()[words.texts_of(at[order])]
            head = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order
            first = np.repeat(owner[head], np.diff([*head, len(order)]))
            late[order] |= owner > first
            np.add.at(gone, at[late], 1)
            np.add.at(gone, at[late] + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        kept = []
        for i, text in enumerate(table.column("text").cast(pa.large_binary())):
            mine = (text.as_py() or b"").split()
            if removed[i]:
                mine = [w for w, out in zip(mine, gone[words.first[i] : words.first[i + 1]].tolist(), strict=True) if not out]
            kept.append(b" ".join(mine).decode())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": words.counts.astype(np.int64), "n_removed": removed.astype(np.int64), "text": pa.array(kept, pa.string())})

    offers = blocks.groupBy("blk").applyInArrow(anchors, "part int, blk int, keys binary")
    told = offers.groupBy("part").applyInArrow(repeated_keys, "part int, blk int, keys binary")
    trees = blocks.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(leaves, "tree long, blk int, suffixes binary")
    nodes = trees.groupBy("tree").applyInArrow(repeats, "blk int, nodes binary")
    return blocks.groupBy("blk").cogroup(nodes.groupBy("blk")).applyInArrow(judged, "doc_id long, n_words long, n_removed long, text string")
