"""Every rule on events as a stream that is started: what it gives over several batches is what the table gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import ledgers as led

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, paper_id long, progress double, scroll_position double, last_section string, query_norm long, source string, status int, provider string, task string, input_tokens long, output_tokens long, lang string, state string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng, at, rows = random.Random(11), START, []
    for i in range(900):
        at += datetime.timedelta(milliseconds=rng.choice([0, 100, 400, 5_000, 40_000, 3_600_000]))
        rows.append((i, at, rng.randrange(6), rng.randrange(5), rng.random() * 110, rng.random(), rng.choice("ab"), rng.randrange(4), rng.choice(["x", "y", "z"]), rng.choice([200, 200, 429]), rng.choice("pq"), rng.choice(["t", "u"]), rng.randrange(50), 1, rng.choice([None, "zh", "ja"]), rng.choice(["busy", "busy", "busy", "done", "failed"])))
    folder = str(tmp_path_factory.mktemp("events"))
    for part in (rows[:300], rows[300:600], rows[600:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(EVENTS).parquet(folder), folder


def ran(spark, folder, tmp_path, rule, mode):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = rule(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


CURRENT = [(0, "zh"), (1, "ja"), (3, "zh")]
RULES = {
    "progress": (led.progress, "complete"),
    "windows": (lambda e: led.windowed_totals(e, "1 hour"), "complete"),
    "sliding": (lambda e: led.windowed_totals(e, "2 hours", "1 hour"), "complete"),
    "sessions": (led.sessions, "complete"),
    "pending": (lambda e: led.pending_sources(e, ["x", "y", "z", "w"]), "complete"),
    "totals": (led.run_totals, "complete"),
    "distinct": (lambda e: led.distinct_requests(e, ["user_id", "source"], "900 days").select("user_id", "source"), "append"),
    "throttled": (lambda e: led.throttled(e, "user_id", 600), "append"),
    "cached": (lambda e: led.cached(e, 3), "append"),
    "cooling": (led.cooling, "append"),
}


@pytest.mark.parametrize("name", RULES)
def test_stream_and_table(spark, events, tmp_path, name):
    table, folder = events
    rule, mode = RULES[name]
    assert sorted(ran(spark, folder, tmp_path, rule, mode), key=str) == sorted((tuple(r) for r in rule(table).collect()), key=str)


def test_late_and_foreign(spark, events, tmp_path):
    table, folder = events
    current = spark.createDataFrame(CURRENT, "paper_id long, lang string")
    rule = lambda e: led.current_only(e, current, 2)
    ended: dict = {}
    want = []
    for r in table.orderBy("ts", "event_id").collect():
        if r["paper_id"] in dict(CURRENT) and r["lang"] in (None, dict(CURRENT)[r["paper_id"]]):
            since = ended.get(r["paper_id"])
            if since is None or r["ts"] - since >= datetime.timedelta(hours=2):
                want.append((r["paper_id"], r["event_id"]))
                if r["state"] in ("done", "failed"):
                    ended[r["paper_id"]] = r["ts"]
    assert sorted(tuple(r) for r in rule(table).collect()) == sorted(want)
    assert sorted(ran(spark, folder, tmp_path, rule, "append")) == sorted(want)
    assert 20 < len(want) < 800


def test_rules_by_example(spark):
    rows = [(1, 0, 200), (2, 10, 429), (3, 30, 429), (4, 75, 200), (5, 95, 200), (6, None, 200)]
    log = spark.createDataFrame([(i, None if s is None else START + datetime.timedelta(seconds=s), "a", "q", st) for i, s, st in rows], "event_id long, ts timestamp, source string, query_norm string, status int")
    assert {r["event_id"]: r["skipped"] for r in led.cooling(log).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False}
    assert {r["event_id"] for r in led.cached(log.where("ts IS NOT NULL"), 1).where("hit").collect()} == {2, 3, 4, 5}
    assert led.cached(log.limit(0)).count() == 0 and led.throttled(log.limit(0).withColumn("user_id", F.lit(1)), "user_id").count() == 0
