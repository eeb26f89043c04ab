"""Sources of records by slug: what a source answers becomes records of one form. Others are added by registering a function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import biblio as bib
from ..operators import reading as rd

#: The columns that records of all sources have; those that a source lacks are null.
RECORD = {"source": "string", "id": "string", "title": "string", "year": "int", "doi": "string", "arxiv_id": "string", "citations": "long"}


@dataclass(frozen=True)
class Adapter:
    """``records`` makes records of a table of answers; ``version`` goes up when it makes other ones, so that cached answers are read anew."""

    slug: str
    name: str
    version: int
    records: Callable[[DataFrame], DataFrame]


_known: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    """Adds a source, or replaces the one of that slug."""
    _known[adapter.slug] = adapter


def adapter(slug: str) -> Adapter:
    if slug not in _known:
        raise KeyError(f"no source {slug}; there are {', '.join(sorted(_known))}")
    return _known[slug]


def records(slug: str, raw: DataFrame) -> DataFrame:
    """``RECORD`` of the answers of one source."""
    made = adapter(slug).records(raw)
    have = set(made.columns)
    return made.select(F.lit(adapter(slug).name).alias("source"), *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD.items() if c != "source"])


def all_records(raw: dict[str, DataFrame]) -> DataFrame:
    """``RECORD`` of the answers of several sources, by slug."""
    return reduce(DataFrame.unionByName, [records(slug, table) for slug, table in raw.items()])


register(Adapter("arxiv", "arXiv", 1, lambda raw: bib.atom_records(raw).withColumn("id", F.col("arxiv_id"))))
register(Adapter("s2", "S2", 1, lambda raw: rd.graph_records(raw, [])))
register(Adapter("openalex", "OpenAlex", 1, lambda raw: rd.open_graph_records(raw, [])))
