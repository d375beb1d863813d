"""Ranks over a whole table, or over keys of any size, without a task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skillgap.sources.scratch import materialize


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, from 1 within ``keys`` along ``order`` (nulls last), without a task per key.

    ``order`` must tell the rows of a key apart, else equal rows are ranked by chance.
    """
    by = [F.col(c).asc_nulls_last() for c in keys + order]
    # Written, so that all that follows sees one and the same partitioning.
    dealt = materialize(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("part", *keys).agg(F.count("*").alias("n"))
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("part", *keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    on = [F.col("a.part") == F.col("b.part"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
    inner = dealt.withColumn("inside", inside)
    return inner.alias("a").join(starts.alias("b"), on).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col("a.inside") + F.col("b.start")).alias("rank")
    )
