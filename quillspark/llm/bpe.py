"""Byte-level BPE by a table of distinct words: ids of whole texts, and texts of ids.

Texts are split into words by Spark's own regular expressions, as the tokenizer's pre-tokenizer splits them. Documents
are packed into chunks of some megabytes: a chunk keeps its distinct words and, for each position of its documents, the
number of the word there. Only distinct words travel: every chunk sends them, sorted and packed, to the parts of one table of
words, dealt by a hash of the word. A part makes its words distinct once more, has the library encode each one once, and sends every
chunk the ids of its words, which are joined by position. The chunks' numbers lie in buckets by chunk and are not shuffled
for it. Ids become text through a join with the vocabulary's pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bucketed
from .words import span_hashes

#: Bytes of text in a chunk, and a slice or a longer text beyond them. The more, the fewer words are in several chunks.
CHUNK = 6_000_000
#: Bytes of text that are taken apart at a time.
SLICE = 2_000_000
#: A vocabulary is broadcast, so its size is checked.
MOST_PIECES = 1_000_000
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: the pre-tokenizer's pattern, with its white space spelled out.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Code points that Java doesn't know yet; the library may.
UNKNOWN = r"\p{Cn}"
#: What is set behind a word: one of those code points, so no text that Spark splits has it.
MARK = "\uffff"
_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def _byte_signs() -> dict[str, int]:
    """The sign by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


BYTE_OF = _byte_signs()


def _special(path: str) -> list[str]:
    """Strings that are one id wherever they stand; a file of another kind is refused."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cutter, model = made["pre_tokenizer"] or {}, made["model"]
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not made["normalizer"]
    if not plain or model["type"] != "BPE" or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in made["added_tokens"]):
        raise ValueError(f"{path} is no plain byte-level BPE")
    if len(made["added_tokens"]) > 1:
        raise ValueError(f"{path} has more than one special string")
    return [x["content"] for x in made["added_tokens"]]


def words_of(text: Column, special: list[str]) -> Column:
    """The text with ``MARK`` behind each of the pre-tokenizer's words; a special string is a word of its own."""
    cut = lambda t: F.regexp_replace(t, WORD, "$0" + MARK)
    if not special:
        return cut(text)
    mark = special[0]  # told before anything else, so it cuts the text first
    parts = F.transform(F.split(text, "\\Q" + mark + "\\E", -1), cut)
    return F.when(F.contains(text, F.lit(mark)), F.array_join(parts, mark + MARK)).otherwise(cut(text))


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def _packed_bytes(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.Codec("zstd").decompress(packed[8:], decompressed_size=4 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)


def _texts(flat: bytes, sizes: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(flat))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), off


PARTS = "array<struct<part: int, sizes: binary, n_bytes: long, words: binary>>"


def chunks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(chunk, ids, sizes, codes, places, parts): documents as numbers of the distinct words of their chunk, frequent words first.

    ``parts`` has the words themselves by the part of the table where they belong, sorted; ``places`` tells where in all
    of these each number's word is.
    """
    special, n_parts = _special(tokenizer), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    odd = (F.octet_length(text) > F.char_length(text)) & F.col(text).rlike(UNKNOWN)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"),
        F.when(odd, F.col(text)).alias("odd"), F.when(odd | F.col(text).isNull(), "").otherwise(words_of(F.col(text), special)).alias("words"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"chunk long, ids array<{kind}>, sizes array<int>, codes binary, places binary, parts {PARTS}"

    def packed(held: list[tuple], chunk: int) -> pa.RecordBatch:
        ids, words, sizes = (pa.concat_arrays([h[k] for h in held]) for k in range(3))
        held.clear()
        named = words.dictionary_encode()
        codes = named.indices.to_numpy(zero_copy_only=False)
        by_rank = np.argsort(-np.bincount(codes, minlength=len(named.dictionary)), kind="stable")
        rank = np.empty(len(by_rank), np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        del words
        data, off = _flat(named.dictionary)
        part = (span_hashes(data, off[:-1], off[1:]) % np.uint64(n_parts)).astype(np.int32)
        order = pc.sort_indices(pa.table({"part": part, "word": named.dictionary}), sort_keys=[("part", "ascending"), ("word", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        data, off = _flat(named.dictionary.take(pa.array(order)))
        cut = np.searchsorted(part[order], np.arange(n_parts + 1))
        told = [
            {"part": p, "sizes": _planes(np.diff(off[cut[p] : cut[p + 1] + 1])), "n_bytes": int(off[cut[p + 1]] - off[cut[p]]), "words": _packed_bytes(data[off[cut[p]] : off[cut[p + 1]]].tobytes())}
            for p in np.flatnonzero(np.diff(cut)).tolist()
        ]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        struct = pa.struct([("part", pa.int32()), ("sizes", pa.binary()), ("n_bytes", pa.int64()), ("words", pa.binary())])
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), one(ids), one(sizes), pa.array([_planes(rank[codes])], pa.binary()), pa.array([_planes(place[by_rank])], pa.binary()), pa.array([told], pa.list_(struct))],
            names=["chunk", "ids", "sizes", "codes", "places", "parts"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, bytes_held = TaskContext.get().partitionId() << 32, [], 0
        for batch in _odd_apart(batches):
            ids, marked, sizes = batch.column("id"), batch.column("words"), batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            strange = batch.column("odd").null_count == 0
            a = 0
            while a < batch.num_rows:
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), min(SLICE, size), side="right")))
                told = _strange_words(batch.column("odd").slice(a, b - a), _tokenizer(tokenizer).pre_tokenizer, special) if strange else _split(marked.slice(a, b - a))
                held.append((ids.slice(a, b - a), *told))
                bytes_held += int(sizes[a:b].sum())
                if bytes_held >= size:
                    yield packed(held, n)
                    pa.default_memory_pool().release_unused()
                    n, bytes_held = n + 1, 0
                a = b
            del batch, ids, marked
        if held:
            yield packed(held, n)

    return rows.mapInArrow(pack, schema)


def _odd_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that Spark has split, and of rows that the library has to split."""
    for batch in batches:
        strange = pc.is_valid(batch.column("odd"))
        if not pc.any(strange).as_py():
            if batch.num_rows:
                yield batch
            continue
        for part in (batch.filter(pc.invert(strange)), batch.filter(strange)):
            if part.num_rows:
                yield part


def _split(marked: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(words of all texts, number of words of each) of texts with ``MARK`` behind each word."""
    data, off = _flat(marked)
    data = data[off[0] : off[-1]]
    a, b, c = MARK.encode()
    at = np.flatnonzero(data[:-2] == a)
    at = at[(data[at + 1] == b) & (data[at + 2] == c)]
    kept = np.ones(len(data), bool)
    for k in range(3):
        kept[at + k] = False
    upto = np.concatenate([[0], at - 3 * np.arange(len(at))]).astype(np.int32)  # a chunk's bytes, or one text's
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(upto), pa.py_buffer(data[kept]))
    return words, pa.array(np.diff(np.searchsorted(at, off - off[0])), pa.int32())


def _strange_words(texts: pa.Array, cutter, special: list[str]) -> tuple[pa.Array, pa.Array]:
    """The same by the library's own pre-tokenizer, for texts with code points that are newer than Java."""
    out, sizes = [], []
    for text in texts.to_pylist():
        before = len(out)
        for i, part in enumerate(text.split(special[0]) if special else [text]):
            out += ([special[0]] if i else []) + [bytes(BYTE_OF[c] for c in w).decode() for w, _ in cutter.pre_tokenize_str(part)]
        sizes.append(len(out) - before)
    return pa.array(out, pa.string()), pa.array(sizes, pa.int32())


def pieces(tokenizer: str) -> list[bytes]:
    """The bytes of each id of the vocabulary, by id, and an empty piece for any other id; its size is checked, as every task gets it."""
    vocabulary = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 2)
    if len(out) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(out)} ids")
    for piece, i in vocabulary.items():
        out[i] = bytes(BYTE_OF[c] for c in piece)
    return out


def _joined(lists: pa.ListArray, known: list[bytes]) -> pa.Array:
    """The texts of lists of ids: each id is joined with its piece, which is at its place in the table, and the pieces with one another."""
    off = np.asarray(lists.offsets)
    ids = np.asarray(lists.values.slice(off[0], off[-1] - off[0]).fill_null(-1)).astype(np.int32)
    ids[(ids < 0) | (ids >= len(known))] = len(known) - 1  # the last piece is empty
    found = pa.array(known, pa.large_binary()).take(pa.array(ids))
    upto = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(upto[off - off[0]]), found.buffers()[2] or pa.py_buffer(b"")])
    try:
        texts = whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode(errors="replace") for x in whole.to_pylist()], pa.string())
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the ``text`` of its ``ids``: each id is joined with its piece, as a place in the table of pieces, and a row's pieces are put together by position.

    Nothing is skipped, special ids neither. Bytes that are no UTF-8 become U+FFFD; null ids are a null text, no ids an
    empty one; an id that the vocabulary lacks is nothing, as in the library. An older ``text`` is replaced.
    """
    names = [c for c in tokens.columns if c != text]
    out = T.StructType([*[tokens.schema[c] for c in names], T.StructField(text, T.StringType())])
    known = pieces(tokenizer)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _joined(batch.column(ids), known)], names=out.names)

    return tokens.select(*names).mapInArrow(told, out)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids) of each row of ``docs``: the ids of its whole text, as the library has them without added special ids.

    With ``decoded`` also the text of these ids, as ``decode`` would add it, by the same task that has put them together.

    A null text is an empty one: no ids. Rows without an id or with a repeated one are encoded like others; other
    columns are not read. A text of any length is one row.
    """
    table = bucketed(chunks(docs, tokenizer, id_col, text), "chunk", "words")
    sent = table.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.*")

    def encoded(sent: pa.Table) -> pa.Table:
        """The ids of one part's words: each distinct one is encoded once; every chunk gets those of its own, in the order in which it sent them."""
        sizes = [_numbers(x.as_py()) for x in sent.column("sizes")]
        flat = b"".join(pa.Codec("zstd").decompress(w.as_py(), decompressed_size=n.as_py(), asbytes=True) for w, n in zip(sent.column("words"), sent.column("n_bytes"), strict=True))
        named = _texts(flat, np.concatenate(sizes)).dictionary_encode()
        found: list[list[int]] = []
        for a in range(0, len(named.dictionary), 10_000):
            found += [x.ids for x in _tokenizer(tokenizer).encode_batch_fast(named.dictionary.slice(a, 10_000).to_pylist(), add_special_tokens=False)]
        lists, at, rows = pa.array(found, pa.large_list(pa.int32())), 0, []
        for n in map(len, sizes):
            mine = lists.take(named.indices.slice(at, n))
            rows.append((_planes(pc.list_value_length(mine).to_numpy(zero_copy_only=False)), _planes(mine.flatten().to_numpy(zero_copy_only=False))))
            at += n
        return pa.table([sent.column("chunk"), sent.column("part"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "part", "n_ids", "ids"])

    found = sent.groupBy("part").applyInArrow(encoded, "chunk long, part int, n_ids binary, ids binary")
    rows = table.select(F.col("chunk").alias("of"), F.col("ids").alias("keys"), "sizes", "codes", "places")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("text", T.StringType())] if decoded else [])])
    known = pieces(tokenizer) if decoded else []

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("part")))
        n_ids = np.concatenate([np.zeros(0, np.int64), *[_numbers(x.as_py()) for x in right.column("n_ids")]]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *[_numbers(x.as_py()) for x in right.column("ids")]]).astype(np.int32)
        begin = np.cumsum(n_ids, dtype=np.int32) - n_ids
        out = []
        for i in range(left.num_rows):  # one: a chunk is one row
            keys, sizes = _whole(left.column("keys"))[i].values, np.asarray(_whole(left.column("sizes"))[i].values)
            word = _numbers(left.column("places")[i].as_py())[_numbers(left.column("codes")[i].as_py())].astype(np.int32)
            n = n_ids[word]
            upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            at = np.arange(upto[-1], dtype=np.int32)
            at += np.repeat(begin[word] - upto[:-1], n)
            of_texts = upto[np.concatenate([[0], np.cumsum(sizes)])]
            del word, n, upto
            lists = pa.ListArray.from_arrays(pa.array(of_texts), pa.array(flat[at]))
            del at
            out.append(pa.table([keys, pa.array(np.diff(of_texts).astype(np.int64)), lists, *([_joined(lists, known)] if decoded else [])], names=schema.names))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return rows.groupBy("of").cogroup(found.groupBy("chunk")).applyInArrow(put_back, schema)


def _whole(column: pa.ChunkedArray, kind: pa.DataType | None = None) -> pa.Array:
    column = column.cast(kind) if kind else column
    made = column.combine_chunks()
    return made if not isinstance(made, pa.ChunkedArray) else made.chunk(0) if made.num_chunks else pa.array([], made.type)


def with_sha256(tokens: DataFrame, ids: str = "ids", column: str = "ids_sha256") -> DataFrame:
    """``tokens`` with the SHA-256 of its ``ids`` as little-endian unsigned 32-bit integers in place of them."""
    names = [c for c in tokens.columns if c != ids]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            flat, off = np.asarray(lists.values), np.asarray(lists.offsets).tolist()
            told = [hashlib.sha256(flat[a:b].astype("<u4")).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(told, pa.string())], names=[*names, column])

    return tokens.mapInArrow(digest, T.StructType([*[tokens.schema[c] for c in names], T.StructField(column, T.StringType())]))

