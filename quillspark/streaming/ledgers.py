"""Progress, ledger and cache rules: each works on a stream of events and on a table alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def progress(events: DataFrame) -> DataFrame:
    """Deepest progress, latest scroll and section, done from 100 on."""
    out = events.groupBy("paper_id").agg(F.max("progress").alias("progress"), F.max_by("scroll_position", F.struct("ts", "event_id")).alias("scroll_position"), F.max_by("last_section", F.struct("ts", "event_id")).alias("last_section"))
    return out.withColumn("status", F.when(F.col("progress") >= 100, "done").otherwise("reading"))


def windowed_totals(usage: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Token totals of tumbling or sliding windows; on a stream, events later than ``late`` are dropped."""
    rows = usage.withWatermark("ts", late) if usage.isStreaming else usage
    out = rows.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "provider").agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("calls"))
    return out.select(F.col("window.start").alias("start"), "provider", "input_tokens", "calls")


def sessions(events: DataFrame, idle: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Activity of a user that ends when nothing happens for ``idle``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", idle), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def pending_sources(log: DataFrame, sources: list[str]) -> DataFrame:
    """Sources that a query still waits for, and whether all are in."""
    out = log.groupBy("query_norm").agg(F.collect_set("source").alias("seen"))
    left = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in sources]), "seen"))
    return out.select("query_norm", F.array_join(left, ",").alias("pending"), (F.size(left) == 0).alias("final"))


def run_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("task").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("tokens"))


def distinct_requests(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def _step(at: int | None, last: int | None, opens: bool, span: int, renew: bool) -> tuple[bool, int | None]:
    """(is it within ``span`` of the last opening, the last opening after it); an opening within one counts only where it renews."""
    within = at is not None and last is not None and at - last < span
    return within, at if opens and at is not None and (renew or not within) else last


def _within(rows: DataFrame, keys: list[str], span: int, renew: bool = False, late: str = "1 hour", per_milli: int = 1) -> DataFrame:
    """Rows (keys, event_id, at, opens, ts) with ``within``: less than ``span`` after the key's last opening; without a time it is not.

    ``at`` and ``span`` are in units of which ``per_milli`` make a millisecond.

    On a table a window brings a key's rows in order of time, and the fold keeps one number of the key it is in, so a key of any
    size streams through. On a stream that number is the key's state; it goes when the watermark, ``late`` behind, has passed its end.
    """
    names = [*keys, "event_id", "at", "within"]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in [*keys, "event_id"]], T.StructField("at", T.LongType()), T.StructField("within", T.BooleanType())])

    def stream_fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        told = pd.concat(list(parts)).sort_values(["at", "event_id"])
        out = []
        for i, at, opens in zip(told["event_id"], told["at"], told["opens"], strict=True):
            at = None if pd.isna(at) else int(at)
            within, last = _step(at, last, bool(opens), span, renew)
            out.append((*key, i, at, within))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(-(-(last + span) // per_milli), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    def table_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            told = []
            for at, opens, first in zip(*[batch.column(c).to_pylist() for c in ("at", "opens", "first")], strict=True):
                within, last = _step(at, None if first else last, opens, span, renew)
                told.append(within)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(told, pa.bool_())], names=names)

    if rows.isStreaming:
        timed = rows.withWatermark("ts", late)
        return timed.groupBy(*keys).applyInPandasWithState(stream_fold, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    ordered = rows.withColumn("first", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "event_id")) == 1)
    return ordered.mapInArrow(table_fold, schema)


def _timed(rows: DataFrame, keys: list, opens, clock=F.unix_millis) -> DataFrame:
    return rows.select(*keys, "event_id", clock(F.col("ts").cast("timestamp")).alias("at"), F.coalesce(opens, F.lit(False)).alias("opens"), F.col("ts").cast("timestamp").alias("ts"))


def throttled(events: DataFrame, key: str, millis: int = 600, late: str = "1 hour") -> DataFrame:
    """Of each key's events, those at least ``millis`` after the last one that was let through (a fold, not buckets)."""
    rows = _timed(events, [F.col(key).cast("long").alias("key")], F.lit(True))
    return _within(rows, ["key"], millis, late=late).where("NOT within").drop("within")


def throttled_batch(events: DataFrame, key: str, millis: int = 600) -> DataFrame:
    """The same on a table."""
    return throttled(events, key, millis)


def cached(log: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(event_id, hit): a repeat of (query, source) within the lifetime of the last store is a hit; a miss stores anew."""
    return _within(_timed(log, ["query_norm", "source"], F.lit(True)), ["query_norm", "source"], hours * 3_600_000, late=late).select("event_id", F.col("within").alias("hit"))


def cooling(log: DataFrame, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """(source, event_id, skipped): requests to a source within ``seconds`` after its last 429, by the whole time and not its milliseconds."""
    rows = _timed(log, ["source"], F.col("status") == 429, F.unix_micros)
    return _within(rows, ["source"], seconds * 1_000_000, renew=True, late=late, per_milli=1000).select("source", "event_id", F.col("within").alias("skipped"))


def current_only(events: DataFrame, current: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(paper_id, event_id) of events (paper_id, lang, state, event_id, ts) that still count, given what is ``current`` (paper_id, lang).

    Events of another paper are foreign; one with a language counts in its paper's current language alone. Behind a terminal one
    (``state`` done or failed) all of its paper are late, for so many hours; then a new round may begin. ``current`` is a table;
    on a stream each batch meets it as it then is.
    """
    own = current.select("paper_id", F.col("lang").alias("now")).distinct()
    joined = events.join(own.hint("shuffle_hash"), "paper_id").where(F.col("lang").isNull() | (F.col("lang") == F.col("now")))
    rows = _timed(joined, ["paper_id"], F.col("state").isin("done", "failed"))
    return _within(rows, ["paper_id"], hours * 3_600_000, late=late).where("NOT within").select("paper_id", "event_id")
