import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import in_order, limits

SCHEMA = "service int, event_id int, ts timestamp, key string, visitor string"


def told(spark, folder, batches, stream, name):
    """What a stream tells of batches that come as files, one a micro-batch; a last event long after lets the watermark pass all."""
    in_order.keep_state_in_rocksdb(spark)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "service int, event_id int, t bigint, key string, visitor string")
        df.select("service", "event_id", F.timestamp_seconds("t").alias("ts"), "key", "visitor").coalesce(1).write.parquet(f"{folder}/in/b={i}")
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in/*")
    q = stream(given).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.sql(f"select * from {name}").collect(), q.recentProgress


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, 1_700_000_000 + rng.randrange(1500), f"repo{rng.randrange(6)}", rng.choice([None, *(f"v{j}" for j in range(40))])) for i in range(400)]
    rng.shuffle(rows)
    return rows


#: Long after all others: the watermark passes what waits, and with the next one what is forgotten then.
CLOSING, LAST = [(9, 10_000, 1_700_500_000, "x", None)], [(9, 10_001, 1_700_900_000, "x", None)]


def test_rate_limit_whatever_the_batches(spark, tmp_path, events):
    batch = spark.createDataFrame(events, "service int, event_id int, t bigint, key string, visitor string")
    want = {(r.service, r.event_id, r.accepted) for r in limits.rate_limited(batch.withColumn("service", F.col("service").cast("bigint")), "service", 300, 20).collect()}
    got, progress = told(spark, tmp_path, [events[:150], events[150:170], events[170:], CLOSING, LAST], lambda s: in_order.rate_limited_stream(s, "service", "ts", 300, 20, "1 hour"), "limited_in_order")
    assert {(r.service, r.event_id, r.accepted) for r in got if r.service < 9} == want
    assert {True, False} == {r.accepted for r in got}
    assert progress[-1].stateOperators[0].numRowsTotal <= 4  # only the closing event's key is left


def test_dispatch_whatever_the_batches(spark, tmp_path, events):
    rules = {"cooldown": 60, "window": 60, "most": 3, "keep": 600}
    batch = spark.createDataFrame(events, "service int, event_id int, t bigint, key string, visitor string")
    want = {(r.service, r.event_id, r.accepted) for r in limits.dispatched(batch, "service", **rules).collect()}
    got, progress = told(spark, tmp_path, [events[:10], events[10:300], events[300:], CLOSING, LAST], lambda s: in_order.dispatched_stream(s, "service", "ts", "1 hour", **rules), "dispatched_in_order")
    assert {(r.service, r.event_id, r.accepted) for r in got if r.service < 9} == want and 20 < sum(r.accepted for r in got) < 400
    assert progress[-1].stateOperators[0].numRowsTotal <= 8


def test_waiting_events_are_few_entries(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(2), i, 1_700_000_000 + rng.randrange(9000), "a", None) for i in range(6000)]
    batch = spark.createDataFrame(rows, "service int, event_id int, t bigint, key string, visitor string")
    want = {(r.service, r.event_id, r.accepted) for r in limits.rate_limited(batch.withColumn("service", F.col("service").cast("bigint")), "service", 300, 20).collect()}
    half = [(9, 20_000, 1_700_000_000 + 4000 + 36_000, "x", None)]  # the watermark comes to stand within what waits
    got, progress = told(spark, tmp_path, [rows[:4000], rows[4000:], half, CLOSING, LAST], lambda s: in_order.rate_limited_stream(s, "service", "ts", 300, 20, "10 hours"), "few_entries")
    assert {(r.service, r.event_id, r.accepted) for r in got if r.service < 9} == want
    assert max(p.stateOperators[0].numRowsTotal for p in progress) < 100  # 6,000 events wait


def test_late_events_are_dropped(spark, tmp_path):
    rows = [[(1, 1, 1000, "a", None)], [(1, 2, 9000, "a", None)], [(1, 3, 9001, "a", None)], [(1, 4, 1500, "b", None)], CLOSING]
    got, _ = told(spark, tmp_path, rows, lambda s: in_order.rate_limited_stream(s, "service", "ts", 60, 5, "10 seconds"), "late_in_order")
    assert {r.event_id for r in got if r.service == 1} == {1, 2, 3}


def test_forgetting_keeps_up(spark):
    state, rules = limits.Dispatches(), limits.Rules(cooldown=10, window=1, most=1000, keep=50)
    n = 0
    for t in range(5000):
        n += state.take(t, f"k{t % 7}", f"v{t}", rules)
        assert len(state.last) <= 11 and len(state.visitors) <= 51
    assert n > 2000 and not state.take(5000, "k9", "v4999", rules)
