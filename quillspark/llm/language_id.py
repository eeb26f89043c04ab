"""Language identification with string kernels.

A text is the set of its character n-grams of one to three code points (blended-spectrum presence), hashed into
DIMS places. The kernel of two texts is the number of shared n-grams over the geometric mean of their numbers.
Landmarks chosen from the training rows and the mean of all rows of each language give Nystroem features; one ridge
regression for each language, against the rest, is solved on those of all training rows. Scores are products of a batch of presence rows with the weights that landmarks
and regression come down to: K(x, landmarks) A = x (Z' A) / |x|.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .words import give_back, slices

DIMS = 1 << 14
#: Texts that features are made of besides each language's mean, and the weight against large coefficients. The regressions are solved on all rows.
LANDMARKS, RIDGE = 384, 1e-2
#: Parts of a row of n-grams that are added up apart.
PIECES = 16
BATCH = 128
#: Classes of size: there are 2^14 n-grams at most.
CLASSES = 15
#: Steps of a score that are told apart where floors are counted.
SCORE_STEPS = 10_000
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIMS presence matrix, whether a text has a letter). Other than letters counts as white space."""
    lowered = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 3 for t in lowered], np.int64)
    codes = np.frombuffer("".join(t + "   " for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.where(codes < 0x10000, _LETTER[np.minimum(codes, 0xFFFF)], True)
    # beyond the table: letters of the higher planes are told one by one
    for i in np.flatnonzero(codes >= 0x10000):
        letter[i] = chr(int(codes[i])).isalpha()
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint32)
    row = np.repeat(np.arange(len(texts)) * DIMS, size)
    out = np.zeros(len(texts) * DIMS, np.float32)
    blank = ~letter
    held = np.zeros(len(codes), np.uint32)
    only_blank = np.ones(len(codes), bool)
    for n in range(3):
        end = len(codes) - n
        held = held[:end] + codes[n:] * _FACTORS[n]
        only_blank = only_blank[:end] & blank[n:]
        mixed = held ^ (held >> np.uint32(15))
        mixed = mixed * np.uint32(0x2C1B3C6D) + np.uint32(n)
        at = (mixed >> np.uint32(18)).astype(np.int64)
        out[(row[:end] + at)[~only_blank]] = 1
    has = np.zeros(len(texts), bool)
    has[np.repeat(np.arange(len(texts)), size)[letter]] = True
    return out.reshape(len(texts), DIMS), has


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMS x languages

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        x, has = presence(texts)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.weights) / norm, has


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull())


def _landmarks(docs: DataFrame) -> list[str | None]:
    """Texts of LANDMARKS rows, those with the smallest hashes of their ids, of each language in turn; of rows with one id the least. Only these come to the driver."""
    known = _labelled(docs).where(F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= LANDMARKS)
    ids = [r["doc_id"] for r in chosen.orderBy("r", "lang").limit(LANDMARKS).collect()]
    rows = known.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).collect() if ids else []
    text = {r["doc_id"]: r["row"]["text"] for r in rows}
    return [text[i] for i in dict.fromkeys(ids)]


def _normed(texts: list[str | None]) -> np.ndarray:
    x = presence(texts)[0]
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def _added(rows: pa.Table) -> pa.Table:
    # in order of size, so that the sum doesn't hang on which task was first
    every = np.sort(rows["sums"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), axis=0)
    return pa.table({"at": rows["at"].slice(0, 1), "sums": pa.array([every.sum(axis=0)], pa.list_(pa.float64()))})


def _summed(docs: DataFrame, one: Callable[[list[str | None], list[str]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums, by place, of what ``one`` gives for the texts and languages of each batch of labelled rows. A task adds up its own, Spark those of the tasks."""

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, "text", 1_000_000)):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for i in range(0, len(texts), BATCH):
                for at, v in one(texts[i : i + BATCH], langs[i : i + BATCH]).items():
                    sums[at] = sums[at] + v if at in sums else v.astype(np.float64)
            give_back()
        if sums:
            yield pa.RecordBatch.from_pydict({"at": pa.array(list(sums), pa.int32()), "sums": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    kind = "at int, sums array<double>"
    parts = _labelled(docs).select("text", "lang").mapInArrow(partly, kind).groupBy("at").applyInArrow(_added, kind)
    return {r["at"]: np.array(r["sums"]) for r in parts.collect()}


def learned(docs: DataFrame) -> Model:
    """A model from all labelled rows of ``docs`` (doc_id, text, lang); rows without a language teach nothing.

    Features are kernels to landmarks, some chosen texts, and to the mean of all rows of each language, so an n-gram of any row
    counts. The regressions' sums of products run over all rows. What comes to the driver is a row of n-grams for each language,
    a matrix of features by features and one of languages by features, at any number of rows.
    """
    names = sorted(r["lang"] for r in _labelled(docs).select("lang").distinct().collect())
    if not names:
        return Model([], np.zeros((DIMS, 0), np.float32))
    place = {n: i for i, n in enumerate(names)}

    def ngrams(texts: list[str | None], langs: list[str]) -> dict[int, np.ndarray]:
        x, of = _normed(texts), np.array([place[n] for n in langs])
        return {k * PIECES + i: v for k in np.unique(of).tolist() for i, v in enumerate(np.split(x[of == k].sum(axis=0), PIECES))}

    sums, marks = _summed(docs, ngrams), _landmarks(docs)
    means = np.concatenate([sums[i] for i in range(len(names) * PIECES)]).reshape(len(names), DIMS)
    means = (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    z = np.concatenate([*(_normed(marks[i : i + BATCH]) for i in range(0, len(marks), BATCH)), means])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    if not good.any():  # no text has an n-gram
        return Model(names, np.zeros((DIMS, len(names)), np.float32))
    whiten = vectors[:, good] / np.sqrt(values[good])
    size = whiten.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast((z, whiten))

    def products(texts: list[str | None], langs: list[str]) -> dict[int, np.ndarray]:
        z, whiten = shared.value
        features, of = (_normed(texts) @ z.T).astype(np.float64) @ whiten, np.array([place[n] for n in langs])
        return {**dict(enumerate(features.T @ features)), **{size + k: features[of == k].sum(axis=0) for k in np.unique(of).tolist()}}

    sums = _summed(docs, products)
    gram, said = np.array([sums[i] for i in range(size)]), np.array([sums[size + k] for k in range(len(names))])
    solved = whiten @ np.linalg.solve(gram.reshape(size, size) + RIDGE * np.eye(size), said.T)
    return Model(names, (z.T @ solved.astype(np.float32)).astype(np.float32))


def _top(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(best score, class of size: the power of two of the number of n-grams, or -1 without a letter) of each text."""
    x, has = presence(texts)
    size = x.sum(axis=1)
    score = ((x @ model.weights) / np.sqrt(np.maximum(size, 1))[:, None]).max(axis=1, initial=0)
    return score, np.where(has, np.log2(np.maximum(size, 1)).astype(np.int64), -1)


def floors(model: Model, docs: DataFrame) -> np.ndarray:
    """The score that a text of each class of size has to come up to, from all labelled rows of ``docs``, which the model was not fitted on.

    Scores rise with the size of a text, so a class has its own floor: half of the median there. Scores are linear in
    the presence row, so half of what its size usually scores is a text of which half is in the language. The first
    halves, quarters and so on of the texts count too, so that small sizes are known in a corpus of long texts. Scores are
    counted to four digits behind the point: a class has some ten thousand counts at most, however many texts there are.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int]] = Counter()
        for batch in (part for whole in batches for part in slices(whole, "text", 1_000_000)):
            texts = batch.column("text").to_pylist()
            while texts:
                for i in range(0, len(texts), BATCH):
                    score, size = _top(model, texts[i : i + BATCH])
                    seen.update(zip(size.tolist(), np.rint(score * SCORE_STEPS).astype(np.int64).tolist(), strict=True))
                texts = [t[: len(t) // 2] for t in texts if len(t) >= 2]
            give_back()
        yield pa.RecordBatch.from_pydict({"size": pa.array([k for k, _ in seen], pa.int32()), "score": pa.array([v for _, v in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    if not model.languages:
        return np.zeros(CLASSES)
    held = _labelled(docs).where("text <> ''").where(F.col("lang").isin(model.languages)).select("text")
    counts = held.mapInArrow(counted, "size int, score long, n long").where("size >= 0").groupBy("size", "score").agg(F.sum("n").alias("n"))
    half = {r["size"]: r["median"] / SCORE_STEPS / 2 for r in counts.groupBy("size").agg(F.percentile("score", 0.5, F.col("n")).alias("median")).collect()}
    seen = sorted(half)
    return np.interp(np.arange(CLASSES), seen, [half[c] for c in seen], left=0) if seen else np.zeros(CLASSES)


def in_learned_language(docs: DataFrame, model: Model, floor: np.ndarray) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and comes up to the floor of its size in one of the languages."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1_000_000)):
            texts = batch.column("text").to_pylist()
            keep = [np.zeros(0, bool)]
            for i in range(0, len(texts), BATCH):
                score, size = _top(model, texts[i : i + BATCH])
                keep.append((size >= 0) & (score >= floor[size]) & bool(model.languages))
            yield batch.filter(pa.array(np.concatenate(keep)))
            give_back()

    return docs.mapInArrow(told, T.StructType(docs.schema.fields))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: the best regression's output).

    The prediction reads ``text`` alone. A text that is null or has no letter is ``und`` with score 0, and so is
    every text if the model knows no language. Ties go to the language first in the alphabet. Rows without an id or with a
    repeated one are told like any other; columns of ``docs`` called lang_pred or score are replaced.
    """
    kept = model
    docs = docs.drop("lang_pred", "score")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1_000_000)):
            names, best = [], []
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), BATCH):
                scores, has = kept.scores(texts[i : i + BATCH])
                for row, ok in zip(scores, has, strict=True):
                    top = int(np.argmax(row)) if ok and len(row) else -1
                    names.append(kept.languages[top] if top >= 0 else "und")
                    best.append(float(min(1.0, max(0.0, row[top]))) if top >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
            give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(told, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2
