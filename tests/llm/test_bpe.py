"""Ids and texts of byte-level BPE against the library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def strange_texts():
    rng = random.Random(1)
    signs = [*" \n\t'sStrelvmd019.,!<|>éß中文\U0001fae0　 \u0085", "<|endoftext|>", "'re", " '", "\U0001d4b3"]
    made = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(1500)]
    return ["", None, " ", "it's  we'll'LL 'S 123abc\n\n\n x\t\ty  ", "  <|endoftext|>  <|endoftext|>", "<|endoftext", "a" * 5000, " " * 3000 + "x", "\U0001fae0 ok \uffff x\uffff", *made]


def test_every_row_as_the_library_has_it(spark, tokenizer):
    texts = strange_texts()
    rows = [(i, t, "c", 7) for i, t in enumerate(texts)] + [(None, "no id", "c", 7), (3, "repeated id", "c", 7), (3, "repeated id", "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, code int")
    out = bpe.with_sha256(bpe.encode(docs, PATH, decoded=True).withColumn("again", F.col("ids")))
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), tokenizer.decode(ids, skip_special_tokens=False), ids))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["text"], r["again"]) for r in out.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_chunks_and_letters_of_every_plane(spark, tokenizer):
    # signs of all planes, next to a letter, a digit and a sign
    signs = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}." for c in signs[k : k + 500]) for k in range(0, len(signs), 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect():
        assert r["ids"] == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["text"] == texts[r["doc_id"]]
    assert bpe.chunks(docs, PATH, size=20_000).count() > 20


def test_decode_any_ids(spark, tokenizer):
    rng = random.Random(2)
    rows = [(0, [1, 2, 50256, 99999]), (1, []), (2, None), (3, [188, 189, 190, 300, 255, 220]), (3, [1]), (None, [2]), *((4 + i, [rng.randrange(50257) for _ in range(20)]) for i in range(200))]
    tokens = spark.createDataFrame([(*r, "x", 5) for r in rows], "k long, ids array<int>, text string, id int")
    got = sorted(((r["k"] is None, r["k"] or 0, r["ids"] or [], r["text"], r["id"]) for r in bpe.decode(tokens, PATH).collect()), key=str)
    assert got == sorted(((k is None, k or 0, ids or [], None if ids is None else tokenizer.decode(ids, skip_special_tokens=False), 5) for k, ids in rows), key=str)


def test_empty_table_and_other_files(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError, match="plain"):
        bpe.encode(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
