"""How many requests of the same client a log's requests find before them in a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def offered_counts(df: DataFrame, key: str, ts: str, order_id: str, window_s: int = 60) -> DataFrame:
    """Adds ``at`` (epoch microseconds), ``slot`` and ``offered``: earlier requests of the client in the window.

    A client's timeline is cut into slots one window long, and each request is
    also shown to the next slot, so a busy client is counted in many tasks.
    """
    width = window_s * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slotted = df.withColumn("at", at).withColumn("_own", F.floor(F.col("at") / width))
    shown = slotted.withColumn("slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    in_slot = Window.partitionBy(key, "slot")
    earlier = F.row_number().over(in_slot.orderBy("at", order_id)) - 1
    expired = F.count("*").over(in_slot.orderBy("at").rangeBetween(Window.unboundedPreceding, -width))
    return (
        shown.withColumn("offered", (earlier - expired).cast("int"))
        .where(F.col("slot") == F.col("_own"))
        .drop("_own")
    )
