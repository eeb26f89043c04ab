"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A canonical URL is a host (A-Z lower-cased) and the path up to ? or #. A listed entry stands for its host with all
subdomains and for all paths that start with its path. The names under which a URL could be listed are looked up in
the filter, one 256-bit block for each; those that pass are joined with the list, which removes false positives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix

BITS_PER_KEY, PROBES = 16, 8
#: Keys of a filter that is broadcast at once (64 MB); a longer list is taken in parts by a hash of its keys, one filter after another.
MAX_KEYS = 32_000_000
#: Entries of a counted list that is itself broadcast to the hash join, so that a rule that fits most URLs is no hot key.
FEW = 100_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    given = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(given, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(given, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hash(keys: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest() for k in keys), "<u8")


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, the 256-bit mask as four 64-bit words) of each key."""
    bits = np.zeros((len(hashes), 4), np.uint64)
    rows, more = np.arange(len(hashes)), mix(hashes)
    for i in range(PROBES):
        at = (more >> np.uint64(8 * i)) & np.uint64(255)
        bits[rows, (at >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (at & np.uint64(63))
    return (hashes % np.uint64(blocks)).astype(np.int64), bits


class BlockedBloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits  # blocks x 4

    def __call__(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        block, want = _places(_hash(keys), len(self.bits))
        return ((self.bits[block] & want) == want).all(axis=1)


def built(listed: DataFrame, n: int, part: int = 0, parts: int = 1) -> BlockedBloom:
    """The filter of those of ``listed`` (host, path) that fall to ``part``, about n / parts; partial blocks are or-ed by Spark, at most 2 bytes a key reach the driver."""
    blocks = max(1, -(-n * BITS_PER_KEY // (256 * parts)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _hash(_names(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            block, bits = _places(keys[_part(keys, parts) == part], blocks)
            yield pa.RecordBatch.from_pydict({"block": block, **{f"w{i}": bits[:, i].view(np.int64) for i in range(4)}})

    rows = listed.select("host", "path").mapInArrow(partial, "block long, w0 long, w1 long, w2 long, w3 long")
    out = np.zeros((blocks, 4), np.uint64)
    for r in rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]).collect():
        out[r["block"]] = np.array([r["w0"], r["w1"], r["w2"], r["w3"]], np.int64).view(np.uint64)
    return BlockedBloom(out)


def _names(hosts: list[str], paths: list[str]) -> list[str]:
    return [f"{h}\0{p}" for h, p in zip(hosts, paths, strict=True)]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(parts)


def _ancestors(host: str) -> list[str]:
    """The host and the domains above it."""
    cut = [-1, *[i for i, c in enumerate(host) if c == "."]]
    return [host[i + 1 :] for i in cut]


def judged(pages: DataFrame, listed: DataFrame, otherwise: str = "allow", most_keys: int = MAX_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url).

    ``listed`` (host, path, verdict) holds the rules; of those that fit the longest (host and path together, then
    host) gives rule and verdict. Where none fits, rule is null and the verdict is ``otherwise``: the filter's own,
    as the URL is not listed. A null url or one without :// has an empty host and path and fits no rule. Entries with
    a null part are no rules; of entries that repeat a host and path the alphabetically first verdict counts. Rows
    repeat if they do in ``pages``; other columns are not read. ``most_keys`` bounds the filter that is in memory at
    once; distinct URLs are looked up once for each part of a longer list.
    """
    rules = listed.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    n = rules.count()
    host, path = canonical(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # few: a path is a URL's part, and lengths are whole numbers up to the longest
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    parts = max(1, -(-n // most_keys))
    hits = None
    for part in range(parts):
        bloom = pages.sparkSession.sparkContext.broadcast(built(rules, n, part, parts))

        def possible(batches: Iterator[pa.RecordBatch], bloom=bloom) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts, paths, of = [], [], []
                for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                    above, starts = _ancestors(h), [p[:k] for k in lengths if k <= len(p)]
                    hosts += [a for a in above for _ in starts]
                    paths += starts * len(above)
                    of.append(len(above) * len(starts))
                keep = np.flatnonzero(bloom.value(_names(hosts, paths)))
                whole = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), of)[keep]))
                rule = [pa.array([x[i] for i in keep.tolist()], pa.string()) for x in (hosts, paths)]
                yield pa.RecordBatch.from_arrays([*whole.columns, *rule], names=["host", "path", "rule_host", "rule_path"])

        found = distinct.mapInArrow(possible, "host string, path string, rule_host string, rule_path string")
        hits = found if hits is None else hits.unionByName(found)
    entries = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    # a rule that fits most URLs is a hot key: a short list is broadcast, and of a long one each entry is there once for each salt
    if n <= FEW:
        exact = hits.join(F.broadcast(entries), ["rule_host", "rule_path"])
    else:
        salted = entries.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        exact = hits.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["rule_host", "rule_path", "salt"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.char_length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    with_host = urls.where("host <> ''").join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    without = urls.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    return with_host.unionByName(without)
