"""Words of whole texts as numpy arrays: what the word-based operators do inside their tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. These are all ASCII, so UTF-8 texts are cut
without decoding them.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POLY = np.uint64(0xD6E8FEB86659FD93)
#: Longer words are hashed one by one; there can be only one of them in so many bytes.
_LONG = 256


def give_back() -> None:
    """Gives memory that this worker has freed back to the machine. Workers live on from stage to stage, and an idle one keeps the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """``f`` of one table or two, after which freed memory is given back."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return one if f.__code__.co_argcount == 1 else two


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each stretch of bytes; up to eight bytes of one length never collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP)
    if not len(size):
        return out
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    todo, at = np.arange(len(size)), 0
    while len(todo):
        left = size[todo] - at
        part = eight[starts[todo] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[todo] = mix((out[todo] ^ part) * _STEP + np.uint64(at))
        todo, at = todo[(left > 8) & (size[todo] <= _LONG)], at + 8
    for i in np.flatnonzero(size > _LONG):
        whole = data[starts[i] : ends[i]].tobytes()
        out[i] = np.frombuffer(hashlib.blake2b(whole, digest_size=8).digest(), "<u8")[0]
    return out


class Words:
    """The words of an Arrow array of texts, in order; a null text has none.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of text ``i`` are
    ``first[i]`` to ``first[i + 1]``; ``hashes`` has 64 bits for each word. ``gaps`` tells the bytes that are in no word.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, gaps: np.ndarray = _SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.chunk(0) if texts.num_chunks else pa.array([], texts.type)
        texts = texts.cast(pa.large_string()).fill_null("")
        _, off, data = texts.buffers()
        n = len(texts)
        off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        if lower:
            self.data = LOWER[self.data]
        ink = ~gaps[self.data]
        edge = np.zeros(len(ink) + 1, bool)
        edge[self.offsets] = True
        begins = ink.copy()
        begins[1:] &= ~ink[:-1] | edge[1:-1]
        stops = ink
        if len(ink):
            stops = ink.copy()
            stops[:-1] &= ~ink[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hashes = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def named(self) -> pa.DictionaryArray:
        """The words as numbers of distinct words."""
        ink = np.zeros(len(self.data) + 1, np.int8)
        ink[self.starts] += 1
        ink[self.ends] -= 1
        flat = self.data[np.cumsum(ink[:-1], dtype=np.int8) > 0]
        upto = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(upto), pa.py_buffer(flat)]).dictionary_encode()

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(word at which it starts, hash) of each run of ``width`` words that lies in one text."""
        last = np.repeat(self.first[1:], self.counts) - width
        at = np.flatnonzero(np.arange(len(last)) <= last)
        return at, run_hashes(self.hashes, at, width)

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        """The text to which each of these words belongs."""
        return np.searchsorted(self.first, at, side="right") - 1


def run_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        total *= _POLY
        total += hashes[j : j + n]
    return mix(total[at])


def slices(batch: pa.RecordBatch, column: int | str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, so that a task's memory does not hang on Arrow's batch size."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // limit
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(size)], strict=True):
        yield batch.slice(a, b - a)


def pack(keys: np.ndarray, level: int = 1) -> bytes:
    """Sorted 64-bit numbers as zstd-compressed byte planes of their differences."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(planes.tobytes(), asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = pa.Codec("zstd").decompress(packed[8:], decompressed_size=8 * n, asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view("<u8"), dtype=np.uint64)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def runs_of(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    if len(sorted_values):
        cut = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(sorted_values)], strict=True)


# Which keys of a block another block has too: blocks offer their keys to parts, a part tells each block what it shares.
# Keys travel without their last bits, so now and then a key is told that is not shared; what is told is looked at again.

_CUT = np.uint64(24)


def offered_keys(keys: np.ndarray, blk: int, parts: int) -> pa.Table:
    """Rows (part, blk, keys) of a block's sorted, distinct keys."""
    out = {"part": [], "blk": [], "keys": []}
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for a, b in runs_of(part[order]):
        out["part"].append(int(part[order[a]]))
        out["blk"].append(blk)
        out["keys"].append(pack(np.unique(keys[order[a:b]] >> _CUT)))
    return pa.table(out, schema=pa.schema([("part", pa.int32()), ("blk", pa.int32()), ("keys", pa.binary())]))


def repeated_keys(table: pa.Table) -> pa.Table:
    """Of the rows that a part was offered, the same with the keys of two blocks or more."""
    lists = [unpack(x.as_py()) for x in table.column("keys")]
    keys = np.concatenate([np.zeros(0, np.uint64), *lists])
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    keys, of = keys[twice], of[twice]
    order = np.argsort(of, kind="stable")
    keys, of = keys[order], of[order]
    blk, part = table.column("blk"), table.column("part")
    out = [(part[int(of[a])].as_py(), blk[int(of[a])].as_py(), pack(keys[a:b])) for a, b in runs_of(of)]
    return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "blk": pa.array([x[1] for x in out], pa.int32()), "keys": pa.array([x[2] for x in out], pa.binary())})


def told_keys(keys: np.ndarray, told: pa.Table, parts: int) -> np.ndarray:
    """Which of a block's keys are among those that it was told (part, blk, keys)."""
    out = np.zeros(len(keys), bool)
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    begin = np.searchsorted(part[order], np.arange(parts + 1))
    for p, packed in zip(told.column("part").to_pylist(), told.column("keys"), strict=True):
        mine = order[begin[p] : begin[p + 1]]
        out[mine] = member(keys[mine] >> _CUT, unpack(packed.as_py()))
    return out
