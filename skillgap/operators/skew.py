"""Joining many rows to a one-row-per-key side when few keys may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.sources.scratch import materialize

#: A key with more than one in so many rows is dealt out in parts of at most that share.
SHARE = 1000


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner", share: int = SHARE
) -> DataFrame:
    """Equi-join with the rows of a frequent key spread over several tasks.

    ``lookup`` has one row per key. Keys that hold more than one in ``share`` rows
    (fewer than ``share`` keys, so they may go to every task) are cut into as many
    parts as keep each at that size; only their ``lookup`` rows are repeated.
    ``spread_by`` tells the rows of a key apart, so a repeated task salts them the
    same way. Adaptive skew handling does not reach these joins: the lookup side
    ends in an aggregate, not in a bare shuffle.
    """
    keys = list(keys)
    # One pass over the keys: the total is the sum of the counts. Only frequent keys are kept.
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n")).scalar()
    hot = materialize(
        counted.where(F.col("_n") * share > total).select(*keys, F.ceil(F.col("_n") * share / total).cast("int").alias("_parts")), "hot"
    )
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", part).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copies = lookup.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(parts)).drop("_parts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
