"""Queries of the limits over events, in batches and as streams, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.shared import new_folder
from siltstone.registry import query, read
from siltstone.streaming import in_order, limits

_LIMITED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, t, n, true AS accepted, [t] AS recent FROM e WHERE n = 1
      UNION ALL SELECT user_id, event_id, t, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END FROM (SELECT e.*, list_filter(r.recent, lambda x: e.t - x < 50000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, t, accepted FROM r"""


@query(_LIMITED)
def rate_limit_stream(spark, d):
    """The whole table as a stream (by a pattern, for a stream reads no path that is one file). The order in its files does not matter: events wait for the watermark."""
    given = read(spark, d, "events").schema
    events = spark.readStream.schema(given).parquet(f"{d}/events.parque[t]").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    key, out = "spark.sql.streaming.stateStore.providerClass", new_folder(spark, "limited")
    before = spark.conf.get(key)
    in_order.keep_state_in_rocksdb(spark)
    try:
        q = in_order.rate_limited_stream(events, "user_id", "ts", 50_000, 3, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "limited-state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out)


_EVENT = {"service": "concat(event_type, user_id % 40)", "key": "concat('r', event_id % 7)", "visitor": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('v', event_id % 200) END"}


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY t, event_id) AS n FROM (SELECT event_id, epoch_us(ts) // 1000000 AS t, {", ".join(f"{v} AS {k}" for k, v in _EVENT.items())} FROM events)),
    r AS (SELECT service, event_id, n, true AS accepted, [{{'name': 'k' || key, 't': t}}, {{'name': 'v' || visitor, 't': t}}] AS known, t AS began, 1 AS count FROM e WHERE n = 1
      UNION ALL SELECT service, event_id, n, ok, CASE WHEN ok THEN list_concat(known, [{{'name': 'k' || key, 't': t}}, {{'name': 'v' || visitor, 't': t}}]) ELSE known END, began, count + ok::INTEGER FROM
      (SELECT *, free AND count < 2 AS ok FROM (SELECT service, event_id, n, t, key, visitor, known, free, CASE WHEN free AND t - began > 100000 THEN t ELSE began END AS began, CASE WHEN free AND t - began > 100000 THEN 0 ELSE count END AS count FROM
        (SELECT e.*, r.known, r.began, r.count, len(list_filter(r.known, lambda x: (x.name = 'k' || e.key AND e.t - x.t < 40000) OR coalesce(x.name = 'v' || e.visitor AND e.t - x.t <= 400000, false))) = 0 AS free FROM r JOIN e ON e.service = r.service AND e.n = r.n + 1))))
    SELECT service, event_id, accepted FROM r""")
def dispatch_limits(spark, d):
    events = read(spark, d, "events").selectExpr("event_id", "unix_seconds(cast(ts AS timestamp)) AS t", *(f"{v} AS {k}" for k, v in _EVENT.items()))
    return limits.dispatched(events, "service", cooldown=40_000, window=100_000, most=2, keep=400_000)
