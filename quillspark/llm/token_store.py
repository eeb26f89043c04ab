"""Token ids in binary shards with a minimal perfect hash index.

A shard holds a range of documents in ascending doc_id order: their raw ids, little-endian, 16 bits each where
the vocabulary allows and else 32, one after another; and an index of its keys. The index keeps no search
structure: levels of bits give every key a slot of its own without gaps, the slot has a 32-bit fingerprint of its key
and the document's place, so a lookup takes the same few steps however many keys there are, and a foreign key is
found out by its fingerprint. Shards are rows of a Parquet table, so Spark's committers see to lost executors.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_blocks
from .scratch import written
from .words import LOWER, Words, give_back, mix, slices, span_hashes

LEVELS, SPARE = 40, 2
#: Keys of a lookup that are broadcast (8 MB), and shards that are named in the scan's filter.
MOST_KEYS, FEW_SHARDS = 1_000_000, 1_000
_tokenizers: dict = {}


# --- minimal perfect hash -------------------------------------------------


class KeyIndex:
    """A minimal perfect hash of distinct 64-bit keys: level after level, a key that is alone at its bit stays there."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - x + b for x, b in zip(levels, before[:-1], strict=True)]
        self.placed = int(before[-1])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, keys: np.ndarray) -> KeyIndex:
        levels: list[np.ndarray] = []
        while len(keys) and len(levels) < LEVELS:
            size = SPARE * len(keys)
            at = cls._at(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels, np.sort(keys))  # what 40 levels leave, which is next to never anything

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; keys that were not indexed get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._at(keys[todo], level, len(bits))
            out[todo[bits[at]]] = rank[at[bits[at]]]
            todo = todo[~bits[at]]
        if len(self.left) and len(todo):
            at = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            same = self.left[at] == keys[todo]
            out[todo[same]] = self.placed + at[same]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), len(self.left), *[len(x) for x in self.levels]], "<u8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.left.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> KeyIndex:
        n, left = np.frombuffer(data, "<u8", 2).tolist()
        sizes, at, levels = np.frombuffer(data, "<u8", n, 16).tolist(), 16 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels, np.frombuffer(data, "<u8", left, at))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


# --- encoding -------------------------------------------------------------


def _settled_letters() -> np.ndarray:
    """Code points below 0x530 of old alphabets that are letters and stay letters alone when normalised and lower-cased."""
    out = np.zeros(0x800, bool)
    for i in (*range(0xC0, 0x250), *range(0x386, 0x400), *range(0x400, 0x482), *range(0x48A, 0x530)):
        lowered = unicodedata.normalize("NFC", chr(i)).lower()
        out[i] = all(unicodedata.category(c).startswith("L") for c in (chr(i), *lowered))
    return out


SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) != "<"]] = SIGN
_SETTLED = _settled_letters()


def units(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) bytes of the units into which ``words`` fall: the pre-tokenizer's cuts, as far as they are sure.

    The pre-tokenizer drops white space and takes runs of letters, single digits and runs of other signs apart. Words
    of ASCII and of settled letters are cut in the same way; an apostrophe that is a sign run of its own stays with
    the letters behind it, as both may be one contraction. A word with any other byte, or with a < (special tokens are
    told before anything else), is one unit: what normalisation makes of it is the library's business.
    """
    data = words.data
    kind = _CLASS[data]
    high = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0)) if len(data) else np.zeros(0, np.int64)
    code = ((data[high].astype(np.int64) & 0x1F) << 6) | (data[high + 1] & 0x3F) if len(high) else high
    settled = high[_SETTLED[code]]
    kind[settled] = kind[settled + 1] = LETTER
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut[words.starts] = True
    lone = np.flatnonzero((data == 0x27) & cut[:-1] & cut[1:])
    lone = lone[lone + 1 < len(data)]
    lone = lone[kind[lone + 1] == LETTER]
    # the next word's start is a cut that stays
    cut[lone + 1] = False
    cut[words.starts] = True
    odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
    whole = np.flatnonzero(odd[words.ends] > odd[words.starts])
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, words.starts[whole] + 1, 1)
    np.add.at(edge, words.ends[whole], -1)
    cut &= np.cumsum(edge) == 0
    starts = np.flatnonzero(cut[:-1] & (kind != SPACE)) if len(data) else np.zeros(0, np.int64)
    # a unit ends where the next begins or where its word does
    word_end = words.ends[np.searchsorted(words.starts, starts, side="right") - 1] if len(starts) else starts
    return starts, np.minimum(np.append(starts[1:], len(data)), word_end)


class Encoder:
    """A tokenizer of the tokenizers library, asked once for each distinct unit of a run of texts.

    The model is one whose normalizer and pre-tokenizer are those that ``units`` describes, so a text's ids are its units'
    ids one after another. Units that were asked for lately are found by their 64-bit hash in a table of fixed size.
    """

    SLOTS, KEEP = 1 << 19, 4_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = max(vocabulary.values()) > 0xFFFF
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.named, self.begin, self.size = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64), np.full(self.SLOTS, -1, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, found: list[bytes]) -> list[list[int]]:
        """Ids of units of letters only, many in one call: each ends with the one id that closes a word."""
        out: list[list[int]] = []
        for a in range(0, len(found), 1000):
            part = found[a : a + 1000]
            ids = self._ids([b" ".join(part).decode()])[0]
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(part):
                out += [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            else:
                out += self._ids([w.decode() for w in part])
        return out

    def _asked(self, found: list[bytes]) -> list[list[int]]:
        plain = [w.isalpha() for w in found]  # ASCII letters
        letters = iter(self._letters([w for w, p in zip(found, plain, strict=True) if p]))
        others = iter(self._ids([w.decode() for w, p in zip(found, plain, strict=True) if not p]))
        return [next(letters) if p else next(others) for p in plain]

    def _placed(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, number of ids) of each unit; new ones are asked for."""
        slot = (hashes >> np.uint64(45)).astype(np.int64)
        known = (self.named[slot] == hashes) & (self.size[slot] >= 0)
        begin, size = self.begin[slot], self.size[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            named, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            ids = self._asked([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            begins = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))])
            begin[new], size[new] = begins[which], sizes[which]
            slot = (named >> np.uint64(45)).astype(np.int64)
            self.named[slot], self.begin[slot], self.size[slot] = named, begins, sizes
        return begin, size

    def texts(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of all texts, number of ids of each text)."""
        words = Words(texts)
        if words.data.tobytes().find(b"<|") < 0:  # special tokens are told before lower-casing
            words.data = LOWER[words.data]
        starts, ends = units(words)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.flat) > self.KEEP:
            self._forget()
        begin, n = self._placed(words.data.tobytes(), starts, ends, span_hashes(words.data, starts, ends))
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(upto[-1])
        at += np.repeat(begin - upto[:-1], n)
        return self.flat[at], np.diff(upto[np.searchsorted(starts, words.offsets)])


def _encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def with_token_counts(docs: DataFrame, tokenizer: str, column: str = "n_tokens") -> DataFrame:
    """``docs`` (text and any others) with the number of ids of each text, 0 where it is null; an older ``column`` is replaced."""
    docs = docs.drop(column)
    names = docs.columns

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            n = _encoder(tokenizer).texts(pa.chunked_array([batch.column("text")]))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*names, column])
            give_back()

    return docs.mapInArrow(told, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


# --- files ----------------------------------------------------------------

SHARD_SCHEMA = "shard int, n_docs long, n_ids long, first_id long, last_id long, width int, keys binary, lengths binary, perfect binary, prints binary, places binary, payload binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each, writes the shards to ``path``.

    A null or empty text is the end id alone. Rows that repeat a doc_id are stored one after another and found
    together. Rows without a doc_id come first, in shards below 0, and can't be looked up.
    """

    def encoded(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        encoder = _encoder(tokenizer)
        ids, n = encoder.texts(table.column("text"))
        kind = "<u4" if encoder.wide or end_id > 0xFFFF else "<u2"
        payload = np.full(len(ids) + len(n), end_id, kind)
        ends = np.cumsum(n + 1) - 1
        keep = np.ones(len(payload), bool)
        keep[ends] = False
        payload[keep] = ids
        shard = table.column("blk")[0].as_py()
        keys = table.column("doc_id").fill_null(0).to_numpy()
        unique, place = np.unique(keys, return_index=True)
        unique = unique.astype(np.int64).view(np.uint64)
        index = KeyIndex.built(unique)
        slot = index.slots(unique)
        prints, places = np.zeros(len(unique), "<u4"), np.zeros(len(unique), "<u4")
        prints[slot], places[slot] = fingerprint(unique), place
        row = {"shard": shard, "n_docs": len(n), "n_ids": len(payload), "first_id": int(keys[0]), "last_id": int(keys[-1]), "width": payload.itemsize, "keys": keys.astype("<i8").tobytes(), "lengths": (n + 1).astype("<u4").tobytes()}
        row |= {"perfect": index.to_bytes(), "prints": prints.tobytes(), "places": places.tobytes(), "payload": payload.tobytes()}
        fields = [x.split() for x in SHARD_SCHEMA.split(", ")]
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table({name: pa.array([row[name]], types[kind]) for name, kind in fields})

    in_blocks(docs, ["doc_id", "text"]).groupBy("blk").applyInArrow(encoded, SHARD_SCHEMA).write.option("parquet.page.size.row.check.min", "1").option("parquet.block.size", str(32 << 20)).parquet(path)


class Shard:
    """Constant-time access to one shard by key."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.index = KeyIndex.from_bytes(row["perfect"])
        self.prints, self.places = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["places"], "<u4")
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first document with each key, or -1."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.index.slots(keys)
        known = (slot >= 0) & (slot < len(self.prints))
        known[known] = self.prints[slot[known]] == fingerprint(keys[known])
        return np.where(known, self.places[np.where(known, slot, 0)].astype(np.int64) if len(self.places) else -1, -1)

    def ids(self, place: int) -> np.ndarray:
        return self.payload[self.offsets[place] : self.offsets[place] + self.lengths[place]]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, fetched from its shard by its key."""
    stored = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                unique, repeats = np.unique(shard.keys, return_counts=True)
                first = shard.find(unique)
                if (first < 0).any():
                    raise ValueError(f"shard {row['shard']} does not find its own keys")
                places = np.repeat(first - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
                ids = [shard.ids(int(p)) for p in places]
                known = row["shard"] >= 0
                out = {"shard": [row["shard"]] * len(ids), "doc_id": pa.array(np.repeat(unique, repeats) if known else [None] * len(ids), pa.int64()), "offset": shard.offsets[places]}
                out |= {"n_tokens": np.array([len(x) for x in ids], np.int64), "ids_crc32": np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], np.int64)}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.int64()) for k, v in out.items()})

    documents = stored.mapInArrow(fetched, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    starts = stored.select("shard", "n_ids").select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return documents.join(starts.hint("merge"), "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) for the keys (doc_id) that are stored; several rows where an id is. Foreign keys give none.

    Keys are dealt to shards by the shards' ranges. Up to MOST_KEYS of them are sent to where the shards are read, and a
    few shards are picked at the scan, so no payload is shuffled; more keys are joined with the store by shard.
    """
    stored = spark.read.schema(SHARD_SCHEMA).parquet(path).where("shard >= 0")
    bounds = sorted((r["first_id"], r["shard"]) for r in stored.select("first_id", "shard").collect())  # one for each shard
    first, shards = np.array([b for b, _ in bounds], np.int64), np.array([s for _, s in bounds], np.int32)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(first, ids, side="right") - 1
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at >= 0], pa.int64()), "shard": pa.array(shards[at[at >= 0]], pa.int32())})

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, wanted = Shard(row), np.array(row["wanted"], np.int64)
                ids, found = [], []
                for key, place in zip(wanted.tolist(), shard.find(wanted).tolist(), strict=True):
                    while 0 <= place < len(shard.keys) and shard.keys[place] == key:
                        ids.append(key)
                        found.append(shard.ids(place).astype(np.int32))
                        place += 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(found, pa.list_(pa.int32()))})

    asked = keys.select("doc_id").where("doc_id is not null").distinct().mapInArrow(dealt, "doc_id long, shard int")
    asked = written(asked.groupBy("shard").agg(F.collect_list("doc_id").alias("wanted")), "asked")  # distinct keys: a list is no longer than its shard
    n = asked.agg(F.sum(F.size("wanted")), F.count(F.lit(1))).first()
    if (n[0] or 0) <= MOST_KEYS:
        if n[1] <= FEW_SHARDS:
            stored = stored.where(F.col("shard").isin([r["shard"] for r in asked.select("shard").collect()]))
        both = stored.join(F.broadcast(asked), "shard")
    else:
        both = stored.join(asked.hint("merge"), "shard")
    return both.mapInArrow(answered, "doc_id long, ids array<int>")
