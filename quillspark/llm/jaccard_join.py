"""N-gram Jaccard join over count vectors in R-trees.

1. A document is the set of its word shingles. Size classes with a ratio of 1/threshold bound how much two
   linked sets can differ: by ``differ`` shingles. Shingles are hashed into more groups than that, so linked
   sets agree wholly on some group; the group's content is the key under which both arrive. Keys that only
   one document has are dropped first, as packed numbers.
2. Under a key, sets are points of 128 group counts. The sum of coordinate minima bounds the overlap, for two
   points and for two boxes of an R-tree. Surviving pairs meet the same bound with 64 to 128 groups for each
   shingle, which leaves few but the links; these are verified on whole sets.
3. Every document is first paired with the smallest id among its keys' documents; once these links are known, the
   R-trees only pair documents that are not in one component yet. So copies cost what they number, not its square.

No step samples or caps; the links between different components are all found, hence components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, shuffle_partitions
from .components import components
from .scratch import written
from .words import Words, give_back, member, mix, offered_keys, pack, repeated_keys, run_hashes, tidy, told_keys, unpack

GROUPS = 128
#: Rows of one key that meet in one task; larger keys are dealt out by pairs of chunks.
CHUNK = 10_000
#: Rows of all the neighbourhoods that are put together in one group, about.
BAG = 1_500
FANOUT = 16
#: Pairs that a task holds before the finer bound sifts them.
PENDING = 200_000
#: Ids that are broadcast to pick sets at their scan; with more of them the sets are shuffled whole.
MOST_IDS = 500_000
_SALT = np.uint64(0xA0761D6478BD642F)


class Threshold:
    """Jaccard >= num / den: size classes, and for each the number of groups that leaves agreement certain."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, lows[-1] * den // num + 1))
        self.lows = np.array(lows, np.int64)
        highs = self.lows[1:] - 1
        differ = 2 * highs * (den - num) // (den + num)
        spare = np.where(differ > 0, 2 + -(-differ // 20), 0)
        self.groups, self.spare = differ + 1 + spare, spare

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, side="right") - 1

    def least_overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-(self.num * (a + b)) // (self.num + self.den))


class Sets:
    """Shingle sets of a table (doc_id, text, blk) in order of doc_id."""

    def __init__(self, table: pa.Table, width: int, at: Threshold):
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        self.known = bool(table.num_rows) and table.column("blk")[0].as_py() >= 0
        self.ids = table.column("doc_id")
        words = Words(table.column("text"), lower=True)
        counts = words.counts
        starts, keys = words.runs(width)
        of = words.texts_of(starts)
        for n in range(1, width):
            short = np.flatnonzero(counts == n)
            if len(short):
                of = np.concatenate([of, short])
                keys = np.concatenate([keys, run_hashes(words.hashes, words.first[short], n)])
        order = np.argsort(keys)
        order = order[np.argsort(of[order], kind="stable")]
        of, keys = of[order], keys[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        self.of, self.hashes = of[new], keys[new]
        self.n = np.bincount(self.of, minlength=len(counts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.rep = np.arange(len(counts))
        seen: dict = {}
        full = np.flatnonzero(self.n)
        if len(full):
            total = np.add.reduceat(mix(self.hashes ^ _SALT), self.first[full])
            both = np.bitwise_xor.reduceat(self.hashes, self.first[full])
            for i, what in zip(full.tolist(), zip(self.n[full].tolist(), total.tolist(), both.tolist(), strict=True), strict=True):
                self.rep[i] = seen.setdefault(what, i)
        self.at = at

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, 0 or 1 for the size class, how many keys of that class a linked document shares at least).

        Linked sets agree on spare + 1 groups; those that may be empty, and so without a key, are taken off. Copies
        leave this to the first of them.
        """
        docs, keys, scheme_of, least = [], [], [], []
        if self.known:
            mine = np.flatnonzero((self.n > 0) & (self.rep == np.arange(len(self.n))))
            pick = np.isin(self.of, mine)
            of, hashes = np.searchsorted(mine, self.of[pick]), self.hashes[pick]
            own = self.at.size_class(self.n[mine])
            for which, scheme in enumerate((own, own + 1)):
                groups, spare = self.at.groups[scheme], self.at.spare[scheme]
                base = np.concatenate([[0], np.cumsum(groups)])
                salt = mix(scheme.astype(np.uint64) + _SALT)
                slot = base[of] + ((mix(hashes ^ salt[of]) >> np.uint64(11)) % groups[of].astype(np.uint64)).astype(np.int64)
                content = np.zeros(base[-1], np.uint64)
                np.add.at(content, slot, mix(hashes + _SALT))
                filled = np.bincount(slot, minlength=base[-1]) > 0
                doc = np.repeat(np.arange(len(mine)), groups)
                empty = groups - np.bincount(doc[filled], minlength=len(mine))
                use = filled | (empty > spare)[doc]
                group = (np.arange(base[-1]) - base[doc]).astype(np.uint64)
                need = np.where(empty > spare, spare + 1, spare + 1 - empty)
                scheme_of.append(np.full(int(use.sum()), which))
                least.append(need[doc[use]])
                docs.append(mine[doc[use]])
                keys.append(mix(content[use] + mix(group[use] + salt[doc[use]])))
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(docs), np.concatenate(keys), np.concatenate(scheme_of), np.concatenate(least)

    def points(self, docs: np.ndarray) -> np.ndarray:
        """Group counts of these documents, one row each."""
        at = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in docs]) if len(docs) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(docs)), self.n[docs])
        cell = row * GROUPS + (self.hashes[at] >> np.uint64(57)).astype(np.int64)
        return np.minimum(np.bincount(cell, minlength=len(docs) * GROUPS), 0xFFFFFFFF).astype("<u4").reshape(-1, GROUPS)


def fine_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the finer groups of a set of this size."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 6


def fine(hashes: np.ndarray) -> bytes:
    """The finer groups of a set (leading bits of its sorted hashes, repeats included)."""
    return pack(hashes >> np.uint64(64 - int(fine_bits(np.array(len(hashes))))))


def sifted(x: np.ndarray, y: np.ndarray, n: np.ndarray, groups: list[np.ndarray], at: Threshold) -> np.ndarray:
    """Which pairs (x, y) of these sets could still link, by their finer groups."""
    keep = np.zeros(len(x), bool)
    bits = fine_bits(n)
    order = np.argsort(x, kind="stable")
    cut = np.flatnonzero(np.diff(x[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        one, others = int(x[order[a]]), y[order[a:b]]
        level = min(int(bits[one]), int(bits[others].min()))
        has = np.zeros(1 << level, bool)
        has[groups[one] >> np.uint64(bits[one] - level)] = True
        for c in range(0, len(others), 256):
            some = others[c : c + 256]
            cells = np.concatenate([groups[o] >> np.uint64(bits[o] - level) for o in some.tolist()])
            most = np.add.reduceat(has[cells], np.concatenate([[0], np.cumsum(n[some])[:-1]]), dtype=np.int64)
            keep[order[a + c : a + c + len(some)]] = most >= at.least_overlap(n[one], n[some])
    return keep


class CountTree:
    """A packed R-tree over group counts; ``join`` walks it against itself."""

    def __init__(self, points: np.ndarray, n: np.ndarray, comp: np.ndarray):
        order = np.lexsort((points[:, int(np.argmax(points.var(axis=0)))], n))
        self.order = order
        level = (points[order], n[order], comp[order], comp[order])
        self.levels = [level]
        while len(level[1]) > FANOUT:
            cut = np.arange(0, len(level[1]), FANOUT)
            level = (np.maximum.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.minimum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)

    def join(self, at: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        top = np.arange(len(self.levels[-1][1]))
        i, j = np.triu_indices(len(top))
        yield from self._down(len(self.levels) - 1, i, j, at)

    def _down(self, depth: int, i: np.ndarray, j: np.ndarray, at: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        most, n, low, high = self.levels[depth]
        for a in range(0, len(i), 16_000):
            x, y = i[a : a + 16_000], j[a : a + 16_000]
            open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
            x, y = x[open_], y[open_]
            could = np.minimum(most[x], most[y]).sum(axis=1, dtype=np.int64) >= at.least_overlap(n[x], n[y])
            x, y = x[could], y[could]
            if depth == 0:
                keep = x != y
                yield self.order[x[keep]], self.order[y[keep]]
            elif len(x):
                size = len(self.levels[depth - 1][1])
                for b in range(0, len(x), 2_000):
                    u = (x[b : b + 2_000, None, None] * FANOUT + np.arange(FANOUT)[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
                    v = (y[b : b + 2_000, None, None] * FANOUT + np.arange(FANOUT)[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
                    inside = (u < size) & (v < size) & (u <= v)
                    yield from self._down(depth - 1, u[inside], v[inside], at)


def _verified(pairs: DataFrame, sets: DataFrame, at: Threshold) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity at the threshold or above."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = int(member(x, y).sum()) if len(x) <= len(y) else int(member(y, x).sum())
                keep.append(at.den * both >= at.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    def could(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column("n").to_numpy(), batch.column("m").to_numpy()])
            groups = [unpack(x) for x in [*batch.column("p").to_pylist(), *batch.column("q").to_pylist()]]
            x = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(sifted(x, x + batch.num_rows, n, groups, at), pa.bool_()))
            give_back()

    def sides(pairs: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        few = sets.join(ids.hint("broadcast"), "doc_id", "left_semi") if pairs.count() <= MOST_IDS // 2 else sets
        left = few.select(F.col("doc_id").alias("a"), *[F.col(c).alias(x) for c, (x, _) in columns.items()])
        right = few.select(F.col("doc_id").alias("b"), *[F.col(c).alias(y) for c, (_, y) in columns.items()])
        return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    # sizes and finer groups first: whole sets are only fetched for pairs that the bound lets through
    sized = sides(pairs, {"n": ("n", "m"), "fine": ("p", "q")}).where(F.lit(at.den) * F.least("n", "m") >= F.lit(at.num) * F.greatest("n", "m"))
    near = written(sized.mapInArrow(could, "a long, b long"), "near")
    return sides(near, {"hashes": ("x", "y")}).mapInArrow(exact, "a long, b long")


def _points(column: pa.ChunkedArray) -> np.ndarray:
    """Group counts, one row for each set, from bytes of 1, 2 or 4 to a count."""
    rows = column.to_pylist()
    size = np.array([len(x) for x in rows]) // GROUPS
    out = np.zeros((len(rows), GROUPS), "<u4")
    for wide in np.unique(size).tolist():
        at = np.flatnonzero(size == wide)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at]), f"<u{wide}").reshape(-1, GROUPS)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; the set holds distinct shingles
    of ``width`` words, or the whole sequence as one where there are fewer. Two documents link when
    den * intersection >= num * union. ``component_id`` is the smallest doc_id reachable by links, itself
    included. A null text or one without words has an empty set, which links with nothing. A row without a
    doc_id has no component (null). Rows that repeat a doc_id are one document. Other columns are not read.
    """
    at = Threshold(num, den)
    blocks = in_blocks(docs, ["doc_id", "text"])
    parts = shuffle_partitions(docs)

    def offered(table: pa.Table) -> pa.Table:
        return offered_keys(np.unique(Sets(table, width, at).keys()[1]), table.column("blk")[0].as_py(), parts)

    def described(table: pa.Table, told: pa.Table) -> pa.Table:
        sets = Sets(table, width, at)
        doc, key, which, least = sets.keys()
        order = np.argsort(key, kind="stable")
        doc, key, which, least = doc[order], key[order], which[order], least[order]
        keep = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep |= told_keys(key, told, parts)
        # a document that shares fewer keys than any linked one would is nobody's candidate
        shares = np.bincount(doc[keep] * 2 + which[keep], minlength=2 * len(sets.n))
        keep &= shares[doc * 2 + which] >= least
        doc, key = doc[keep], key[keep]
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order].view(np.int64)
        of = np.unique(doc)
        cut = np.searchsorted(doc, [*of, np.iinfo(np.int64).max])
        keys, points, finer, hashes = ([None] * len(sets.n) for _ in range(4))
        for i, row, a, b in zip(of.tolist(), sets.points(of), cut[:-1], cut[1:], strict=True):
            keys[i] = key[a:b]
            points[i] = row.astype(f"<u{1 if row.max() < 1 << 8 else 2 if row.max() < 1 << 16 else 4}").tobytes()
            mine = sets.hashes[sets.first[i] : sets.first[i + 1]]
            finer[i], hashes[i] = fine(mine), mine.tobytes()
        ids = sets.ids.combine_chunks() if isinstance(sets.ids, pa.ChunkedArray) else sets.ids
        return pa.table({"doc_id": ids, "n": pa.array(sets.n), "rep": ids.take(pa.array(sets.rep)), "keys": pa.array(keys, pa.list_(pa.int64())), "points": pa.array(points, pa.binary()), "fine": pa.array(finer, pa.binary()), "hashes": pa.array(hashes, pa.binary())})

    offers = blocks.groupBy("blk").applyInArrow(tidy(offered), "part int, blk int, keys binary")
    told = offers.groupBy("part").applyInArrow(tidy(repeated_keys), "part int, blk int, keys binary")
    kind = "doc_id long, n long, rep long, keys array<long>, points binary, fine binary, hashes binary"
    every = written(blocks.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(tidy(described), kind), "sets")
    sets = every.where("keys is not null")
    held = sets.select("doc_id", F.explode("keys").alias("key"))
    heads = held.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key", "a")
    # one pair for each document first: the smallest of the heads of its keys; the R-trees see to all that this leaves apart
    spokes = written(held.join(heads.hint("merge"), "key").where("doc_id > a").groupBy(F.col("doc_id").alias("b")).agg(F.min("a").alias("a")), "spokes")
    links = written(_verified(spokes, sets, at), "links")
    found = components(links)

    placed = sets.select("doc_id", "keys").join(found.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left")
    placed = placed.select("doc_id", F.coalesce("component", "doc_id").alias("comp"), F.explode("keys").alias("key"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "lo", "m")
    # keys of one neighbourhood go to one bag, where a pair that shares many keys is given out once; large ones are split
    wide = mixed.groupBy("lo").agg(F.ceil(F.sum("m") / F.lit(2 * CHUNK)).alias("split"))
    mixed = mixed.join(wide.hint("merge"), "lo").select("key", "m", F.xxhash64("lo", F.pmod(F.xxhash64("key"), "split")).alias("near"))
    chunks = F.ceil(F.col("m") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), chunks).cast("int")
    open_ = placed.join(mixed.hint("merge"), "key").select("key", "near", "doc_id", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    open_ = open_.select("key", "near", "doc_id", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # a document comes to a bag once, with all its keys there
    open_ = written(open_.groupBy("near", "i", "j", "doc_id", "comp").agg(F.collect_list("key").alias("keys")), "open")
    bags = max(parts, math.ceil(open_.count() / BAG))

    def surviving(table: pa.Table) -> pa.Table:
        ids, row, doc = np.unique(table.column("doc_id").to_numpy(), return_index=True, return_inverse=True)
        comp, n = (table.column(c).to_numpy()[row] for c in ("comp", "n"))
        points = _points(table.column("points").take(pa.array(row)))
        # as 32 bits wherever they fit: these arrays are most of a bag
        groups = [g.astype(np.uint32) if bits <= 32 else g for g, bits in zip(map(unpack, table.column("fine").take(pa.array(row)).to_pylist()), fine_bits(n), strict=True)]
        lists = table.column("keys").combine_chunks()
        of = np.repeat(np.arange(table.num_rows), pa.compute.list_value_length(lists).to_numpy())
        where = np.stack([pa.compute.list_flatten(lists).to_numpy(), *(table.column(c).to_numpy()[of] for c in ("i", "j"))])
        doc = doc[of]
        order = np.lexsort([doc, *where[::-1]])
        doc, where = doc[order], where[:, order]
        new = np.ones(len(doc), bool)
        new[1:] = np.any(where[:, 1:] != where[:, :-1], axis=0)
        cut = np.flatnonzero(new)
        out, pending, seen = [], [], set()

        def sift() -> None:
            both = np.unique(np.concatenate(pending))
            pending.clear()
            x, y = both // len(ids), both % len(ids)
            keep = sifted(x, y, n, groups, at)
            out.append(both[keep])

        waiting = 0
        for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
            here = doc[a:b]
            # keys with the same documents have the same pairs
            if b - a < 2 or (what := here.tobytes()) in seen:
                continue
            seen.add(what)
            for p, q in CountTree(points[here], n[here], comp[here]).join(at):
                if len(p):
                    pending.append(np.minimum(here[p], here[q]) * len(ids) + np.maximum(here[p], here[q]))
                    waiting += len(p)
                    if waiting > PENDING:
                        sift()
                        waiting = 0
        if pending:
            sift()
        both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pa.table({"a": ids[both // max(1, len(ids))], "b": ids[both % max(1, len(ids))]})

    with_points = open_.join(sets.select("doc_id", "n", "points", "fine").hint("merge"), "doc_id").withColumn("bag", F.pmod(F.xxhash64("near", "i", "j"), F.lit(bags)))
    rest = with_points.drop("near").groupBy("bag").applyInArrow(tidy(surviving), "a long, b long").distinct()
    more = written(_verified(written(rest, "pairs"), sets, at), "links")
    found = components(links.unionByName(more))
    out = every.select("doc_id", F.col("n").alias("n_shingles"), "rep")
    return out.join(found.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
