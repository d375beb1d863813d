"""The search cache as a table: newest row per key within its time to live."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap.functions.recency import moment
from skillgap.operators.skew import salted_lookup


def within_ttl(df: DataFrame, ts: str, ttl: dt.timedelta, now: dt.datetime) -> DataFrame:
    return df.where(F.col(ts) >= moment(now - ttl))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key, reduced in each task before the shuffle."""
    row = F.struct(*df.columns)
    newest = df.groupBy(*keys).agg(F.max_by(row, F.struct(ts, *tie)).alias("_row"))
    return newest.select("_row.*")


def latest_within_ttl(
    df: DataFrame, keys: Sequence[str], ts: str, ttl: dt.timedelta, now: dt.datetime, tie: Sequence[str] = ()
) -> DataFrame:
    return latest_per_key(within_ttl(df, ts, ttl, now), keys, ts, tie)


def cache_put(cache: DataFrame, fresh: DataFrame, now: dt.datetime) -> DataFrame:
    """The cache with each key's row replaced by its new one, stamped with the write time.

    A known key keeps its first parameters; only payload and time are replaced.
    """
    stamped = fresh.withColumn("fetched_at", moment(now))
    kept = [c for c in cache.columns if c not in ("cache_key", "response_json", "fetched_at")]
    both = cache.withColumn("_new", F.lit(0)).unionByName(stamped.withColumn("_new", F.lit(1)))
    return both.groupBy("cache_key").agg(
        *[F.min_by(c, "_new").alias(c) for c in kept],
        F.max_by("response_json", "_new").alias("response_json"),
        F.max_by("fetched_at", "_new").alias("fetched_at"),
    ).select(*cache.columns)


def cache_lookup(
    requests: DataFrame, cache: DataFrame, ttl: dt.timedelta, now: dt.datetime, request_id: str = "request_id"
) -> DataFrame:
    """Each request with its cached payload and whether that is fresh, stale or missing."""
    newest = latest_per_key(cache, ["cache_key"], "fetched_at").select("cache_key", "response_json", "fetched_at")
    found = salted_lookup(requests, newest, ["cache_key"], [request_id], "left")
    usable = F.col("fetched_at") >= moment(now - ttl)
    status = F.when(F.col("fetched_at").isNull(), "miss").when(usable, "fresh").otherwise("stale")
    return found.withColumn("status", status)


def cache_lookup_asof(
    requests: DataFrame, puts: DataFrame, ttl: dt.timedelta, at: str = "requested_at", tie: Sequence[str] = (),
    slot: dt.timedelta = dt.timedelta(hours=6),
) -> DataFrame:
    """Each request with the payload that was cached when it was made, and whether that was fresh, stale or missing.

    ``puts`` has (cache_key, response_json, fetched_at) and the ``tie`` columns that order puts of one instant; a put counts
    from its own instant on. Requests and puts are one table, cut by key and time slot. What a slot begins with, the last put
    of an earlier one, comes from one row per key and slot; inside a slot the last put before a request is seen in
    passing. So a key that most requests ask for is spread over its slots. Requests without a time find nothing.
    """
    micros = int(slot.total_seconds() * 1_000_000)
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / micros)
    put = F.struct(F.col("fetched_at"), F.col("response_json")).alias("put")
    order = F.struct("fetched_at", *tie)
    rows = puts.where(F.col("cache_key").isNotNull() & F.col("fetched_at").isNotNull())
    # One put per key and instant.
    rows = rows.groupBy("cache_key", "fetched_at").agg(F.max_by("response_json", order).alias("response_json"))
    rows = rows.withColumn("_slot", number("fetched_at"))
    asked = requests.withColumn("_slot", number(at))
    last = rows.groupBy("cache_key", "_slot").agg(F.max_by(put, "fetched_at").alias("last"))
    slots = last.unionByName(
        asked.where("cache_key IS NOT NULL").select("cache_key", "_slot").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    ).groupBy("cache_key", "_slot").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("cache_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("put", F.last("last", True).over(earlier)).where("put IS NOT NULL").select(
        "cache_key", "_slot", F.lit(0).alias("_turn"), F.lit(None).cast("timestamp_ntz").alias("_at"), "put"
    )
    nothing = F.lit(None).cast(last.schema["last"].dataType)
    own = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    every = (
        carried.withColumn("_request", F.lit(None).cast(asked.select(own.alias("r")).schema["r"].dataType))
        .unionByName(rows.select("cache_key", "_slot", F.lit(1).alias("_turn"), F.col("fetched_at").alias("_at"), put, F.lit(None).cast(asked.select(own.alias("r")).schema["r"].dataType).alias("_request")))
        .unionByName(asked.select("cache_key", "_slot", F.lit(2).alias("_turn"), F.col(at).alias("_at"), nothing.alias("put"), own.alias("_request")))
    )
    # What is carried in has no time and comes first; a put comes before a request of its instant.
    passing = Window.partitionBy("cache_key", "_slot").orderBy(F.col("_at").asc_nulls_first(), "_turn").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("put", F.last("put", True).over(passing)).where("_turn = 2")
    known = F.when(F.col("cache_key").isNotNull() & F.col("_at").isNotNull(), F.col("put"))
    usable = known["fetched_at"] >= F.col("_at") - F.expr(f"make_dt_interval(0, 0, 0, {ttl.total_seconds():.6f})")
    status = F.when(known.isNull(), "miss").when(usable, "fresh").otherwise("stale")
    return found.select("_request.*", known["response_json"].alias("response_json"), known["fetched_at"].alias("fetched_at"), status.alias("status"))
