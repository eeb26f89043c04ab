"""Embedding near-dedup with lattice hashing.

In each of several tables random projections take vectors to blocks of eight dimensions, where the nearest point of the
E8 lattice names a cell; the blocks' cells together are the vector's cell in the table. A vector is kept in its own
cell and looks into the neighbouring cells that are nearest to it. Vectors that meet are compared by cosine in double
precision. Equal vectors are one class and meet once.

The plan of the tables is one for all inputs, so what a pair comes to does not depend on how many other vectors there are.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written
from .words import mix

PROBES = 4
SEED = 20240101
#: (distinct vectors up to which it holds, blocks, tables, size of a cell): one plan. Measured in 64 dimensions on random pairs at a
#: cosine of exactly 0.9, both sides probing: one table finds 0.14 of 3,000, all tables 0.97; unrelated pairs that it brings
#: together are fewer than can be measured.
PLANS = ((float("inf"), 3, 24, 2.2),)


def _roots() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    whole = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.argmax(np.abs(off[odd]), axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(points), salt + 1, np.uint64)
    for c in np.rint(points * 2).astype(np.int64).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    return out


def cells(unit: np.ndarray, blocks: int, tables: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors x tables own cells, vectors x tables x PROBES neighbouring cells)."""
    dims = unit.shape[1]
    random = np.random.default_rng(SEED)
    own, near = np.zeros((len(unit), tables), np.int64), np.zeros((len(unit), tables, PROBES), np.int64)
    rows = np.arange(len(unit))
    for t in range(tables):
        whole, moved, gain = np.zeros(len(unit), np.uint64), [], []
        for b in range(blocks):
            at = unit @ random.normal(size=(dims, 8)) / cell + random.random(8) * 2
            point = decode(at)
            name = _name(point, t * blocks + b)
            whole += name
            toward = (at - point) @ ROOTS.T
            best = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
            gain.append(np.take_along_axis(toward, best, 1))
            # names add up, so a move in one block changes its part of the sum
            moved.append(np.stack([_name(point + ROOTS[best[:, k]], t * blocks + b) - name for k in range(PROBES)], axis=1))
        gain, moved = np.concatenate(gain, axis=1), np.concatenate(moved, axis=1)
        best = np.argpartition(-gain, PROBES - 1, axis=1)[:, :PROBES]
        own[:, t] = mix(whole).view(np.int64)
        for k in range(PROBES):
            near[:, t, k] = mix(whole + moved[rows, best[:, k]]).view(np.int64)
    return own, near


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which rows can be compared, their vectors at length 1)."""
    rows = [np.array(v, np.float64) if v is not None and None not in v else np.zeros(0) for v in column.to_pylist()]
    at = np.flatnonzero([bool(len(v)) and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in rows])
    out = []
    for i in at:
        v = rows[i] / np.abs(rows[i]).max()
        out.append(v / np.sqrt(v @ v))
    return at, out


def _cosines(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Products of unit vectors, row by row; -1 where they differ in length."""
    x, y = x.to_pylist(), y.to_pylist()
    size, other = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    out = np.full(len(x), -1.0)
    for n in np.unique(size[size == other]).tolist():
        at = np.flatnonzero((size == n) & (other == n))
        one, two = (np.frombuffer(b"".join([v[i] for i in at]), np.float64).reshape(len(at), -1) for v in (x, y))
        out[at] = np.einsum("ij,ij->i", one, two)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Two vectors link when their cosine is at least ``threshold``. A vector that is null, empty, zero or holds null or
    non-finite components links with nothing and is its own component; so do vectors of different lengths with one
    another. ``kept`` marks the smallest id of a component. Rows that repeat a vec_id are vectors of their own with the
    same id, one row each in the result. A row without an id has no component (null) and links with nothing. Other
    columns are not read.
    """

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = _unit(batch.column("embedding"))
            names, units = [None] * batch.num_rows, [None] * batch.num_rows
            for i, v in zip(at.tolist(), unit, strict=True):
                if batch.column("vec_id")[i].is_valid:
                    names[i], units[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest(), v.tobytes()
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "name": pa.array(names, pa.binary()), "unit": pa.array(units, pa.binary())})

    members = written(vectors.select("vec_id", "embedding").mapInArrow(known, "vec_id long, name binary, unit binary"), "vectors")
    good = members.where("name is not null")
    classes = good.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    # rows of one id may be several classes, so classes have numbers, which stay as they are written
    classes = written(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    _, blocks, tables, cell = PLANS[0]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("unit").to_pylist()
            for size in sorted({len(x) for x in raw}):
                pick = [i for i, x in enumerate(raw) if len(x) == size]
                for a in range(0, len(pick), 1000):
                    part = pick[a : a + 1000]
                    unit = np.frombuffer(b"".join(raw[i] for i in part), np.float64).reshape(len(part), -1)
                    own, near = cells(unit, blocks, tables, cell)
                    ids = batch.column("no").take(pa.array(part)).to_numpy()
                    salt = np.int64(size)
                    yield pa.RecordBatch.from_pydict({"cell": own.ravel() ^ salt, "no": np.repeat(ids, tables), "home": np.ones(own.size, bool)})
                    yield pa.RecordBatch.from_pydict({"cell": near.ravel() ^ salt, "no": np.repeat(ids, tables * PROBES), "home": np.zeros(near.size, bool)})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(_cosines(batch.column("x"), batch.column("y")) >= threshold))

    at = written(classes.select("no", "unit").mapInArrow(dealt, "cell long, no long, home boolean"), "cells")
    home, guest = at.where("home").select("cell", F.col("no").alias("x")), at.select("cell", F.col("no").alias("y"))
    met = home.join(guest.hint("merge"), "cell").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    units = classes.select("no", "unit")
    sides = met.join(units.select(F.col("no").alias("a"), F.col("unit").alias("x")).hint("merge"), "a").join(units.select(F.col("no").alias("b"), F.col("unit").alias("y")).hint("merge"), "b")
    links = written(sides.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), "links")
    of = classes.select("no", "rep", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(of.select(F.col("no").alias("b"), "copies").hint("merge"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    found = components(links).withColumnRenamed("id", "no")
    of_class = classes.select("name", "no", "rep", "copies").join(others.withColumnRenamed("a", "no").hint("merge"), "no", "left").join(found.hint("merge"), "no", "left")
    of_class = written(of_class.select("name", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "no").alias("component")), "class-links")
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest.hint("merge"), "component").select("name", "n_links", "component_id")
    placed = good.select("vec_id", "name").join(of_class.hint("merge"), "name").select("vec_id", "n_links", "component_id")
    alone = members.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
