"""Cached searches and request logs, on the events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skillgap.operators import cache as C
from skillgap.streaming.rates import offered_counts
from workload.registry import query, stamp
from workload.views import events

NOW = dt.datetime(2024, 1, 31)
TTL = dt.timedelta(days=5)
CUT = "TIMESTAMP '2024-01-26 00:00:00'"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("within_ttl", f"SELECT event_id, {TS} AS ts FROM events WHERE ts >= {CUT}")
def _(spark, sf):
    return C.within_ttl(events(spark, sf), "ts", TTL, NOW).select("event_id", stamp("ts").alias("ts"))


@query("latest_cached", f"SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY ALL")
def _(spark, sf):
    newest = C.latest_per_key(events(spark, sf), ["user_id", "event_type"], "ts", ["event_id"])
    return newest.select("user_id", "event_type", "event_id", "value")


@query("latest_within_ttl", f"SELECT user_id, event_type, event_id, value, {TS} AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= {CUT}) WHERE rn = 1")
def _(spark, sf):
    newest = C.latest_within_ttl(events(spark, sf), ["user_id", "event_type"], "ts", TTL, NOW, ["event_id"])
    return newest.select("user_id", "event_type", "event_id", "value", stamp("ts").alias("ts"))


def _cache(spark, sf):
    e = events(spark, sf)
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    rows = e.select(key.alias("cache_key"), F.col("props").alias("response_json"), F.col("ts").alias("fetched_at"), "event_id")
    return C.latest_per_key(rows, ["cache_key"], "fetched_at", ["event_id"]).drop("event_id")


_CACHE_SQL = """
WITH c AS (SELECT concat(user_id, '|', event_type) AS cache_key, props AS response_json, ts AS fetched_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


@query("cache_lookup", _CACHE_SQL + f"""
SELECT event_id AS request_id, concat(user_id + 1, '|', event_type) AS cache_key, response_json,
  CASE WHEN fetched_at IS NULL THEN 'miss' WHEN fetched_at >= {CUT} + INTERVAL 4 DAY THEN 'fresh' ELSE 'stale' END AS status
FROM events LEFT JOIN c ON c.cache_key = concat(user_id + 1, '|', event_type)""")
def _(spark, sf):
    requests = events(spark, sf).select(
        F.col("event_id").alias("request_id"),
        F.concat_ws("|", (F.col("user_id") + 1).cast("string"), "event_type").alias("cache_key"),
    )
    found = C.cache_lookup(requests, _cache(spark, sf), dt.timedelta(days=1), NOW)
    return found.select("request_id", "cache_key", "response_json", "status")


# Every event puts its answer and asks for that of the next user, each at its own time.
@query("cache_lookup_asof", f"""
WITH puts AS (SELECT concat(user_id, '|', event_type) AS cache_key, ts AS fetched_at, arg_max(props, event_id) AS response_json FROM events GROUP BY ALL),
asked AS (SELECT event_id AS request_id, concat(user_id + 1, '|', event_type) AS cache_key, ts AS requested_at FROM events)
SELECT request_id, a.cache_key, p.response_json, strftime(p.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at,
  CASE WHEN p.fetched_at IS NULL THEN 'miss' WHEN p.fetched_at >= requested_at - INTERVAL 6 HOUR THEN 'fresh' ELSE 'stale' END AS status
FROM asked a ASOF LEFT JOIN puts p ON a.cache_key = p.cache_key AND a.requested_at >= p.fetched_at""")
def _(spark, sf):
    e = events(spark, sf)
    key = lambda user: F.concat_ws("|", user.cast("string"), "event_type").alias("cache_key")
    puts = e.select(key(F.col("user_id")), F.col("props").alias("response_json"), F.col("ts").alias("fetched_at"), "event_id")
    asked = e.select(F.col("event_id").alias("request_id"), key(F.col("user_id") + 1), F.col("ts").alias("requested_at"))
    found = C.cache_lookup_asof(asked, puts, dt.timedelta(hours=6), tie=["event_id"])
    return found.drop("requested_at").withColumn("fetched_at", stamp("fetched_at"))


@query("cache_put", _CACHE_SQL + """
, fresh AS (SELECT concat(user_id, '|', event_type) AS cache_key, min(props) AS response_json FROM events WHERE value > 50 GROUP BY ALL)
SELECT cache_key, coalesce(f.response_json, c.response_json) AS response_json,
  CASE WHEN f.cache_key IS NOT NULL THEN '2024-01-31 00:00:00' ELSE strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') END AS fetched_at
FROM c FULL JOIN fresh f USING (cache_key)""")
def _(spark, sf):
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    fresh = events(spark, sf).where("value > 50").groupBy(key.alias("cache_key")).agg(F.min("props").alias("response_json"))
    return C.cache_put(_cache(spark, sf), fresh, NOW).withColumn("fetched_at", stamp("fetched_at"))


# Users send few requests a minute here, so the window is a day.
WINDOW_S = 86_400


@query("rate_offered", f"""
SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS offered FROM events""")
def _(spark, sf):
    return offered_counts(events(spark, sf), "user_id", "ts", "event_id", WINDOW_S).select("event_id", "user_id", "offered")
