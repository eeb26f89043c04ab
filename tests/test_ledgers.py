"""Cache and throttle rules against a plain fold, with ties, rows without a time and keys of null."""

import datetime as dt
import random

from quillspark.streaming import ledgers as led


def plain(rows, millis):
    last, out = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        repeat = at is not None and key in last and at - last[key] < millis
        out[i] = repeat
        if not repeat and at is not None:
            last[key] = at
    return out


def test_rules(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(0, 40_000, 250)]), i) for i in range(600)]
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    ts = lambda at, unit: None if at is None else start + dt.timedelta(**{unit: at})
    events = spark.createDataFrame([(k, ts(at, "milliseconds"), i) for k, at, i in rows], "user_id long, ts timestamp, event_id long")
    want = plain(rows, 600)
    assert {r["event_id"] for r in led.throttled_batch(events, "user_id").collect()} == {i for i, repeat in want.items() if not repeat}
    log = spark.createDataFrame([(k, "s", ts(at, "minutes"), i) for k, at, i in rows], "query_norm long, source string, ts timestamp, event_id long")
    assert {r["event_id"]: r["hit"] for r in led.cached(log).collect()} == plain(rows, 24 * 60)
    assert led.throttled_batch(events.limit(0), "user_id").count() == 0
