"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words; every document of a source is wanted
equally often, target / source size times. Expected copies are added up
within the source from the smallest document to the largest, one random offset
per source is added, and a document is emitted once for each whole number that
its own share of the sum steps over. So a source's words come within about one
long document of its target, and no document is emitted more often than its
expected copies rounded up. ``emitted`` does this for any expected copies, also such as
differ within a group.

The sums are whole numbers, in units of 1 / ``UNIT``, so the same in any order of
adding. Rows are dealt out by range over (source, size, ...); each partition is added up by
itself, and what lies before it comes from one sum per partition and source. A source
that holds most rows is spread over many tasks. Whole copies before a partition
make no difference, so only the remainder is passed on, and no sum runs over.

Null texts have size 0; a null source is a source of its own, after the others.
Documents of a source without words are never taken. Repeated rows count as
often as they occur. Extra columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgap.llm.names import fresh
from skillgap.sources.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Targets stop at this multiple of what a source has.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Parts of a copy that sums are taken in.
UNIT = 2**32


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(group: Column, seed: str) -> Column:
    """A number of units below one copy for each group, the same on every run."""
    code = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), group), F.lit("null"))))
    return F.conv(F.substring(code, 1, 8), 16, 10).cast("long")


def summed(df: DataFrame, keys: list[str], order: list[str], value: str, modulus: int | None = None) -> DataFrame:
    """``df`` with ``upto``: ``value`` added up within ``keys`` along ``order`` (nulls last), the row itself included.

    ``order`` must tell the rows of a key apart, else equal rows are taken by chance. With a modulus, what lies
    before a partition is taken by it.
    """
    by = [F.col(c).asc_nulls_last() for c in keys + order]
    part, own, before = "_part", "_own", "_before"
    # Written, so that all that follows sees one and the same partitioning.
    spread = materialize(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "spread")
    each = spread.groupBy(part, *keys).agg(F.sum(value).alias(own))
    cut = lambda c: F.pmod(c, F.lit(modulus)) if modulus else c
    earlier = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = each.withColumn(before, cut(F.coalesce(F.sum(cut(F.col(own))).over(earlier), F.lit(0)))).drop(own)
    along = W.partitionBy(part, *keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    inside = spread.withColumn(own, F.sum(value).over(along))
    on = [F.col(f"a.{part}") == F.col(f"b.{part}"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
    return inside.alias("a").join(starts.alias("b"), on).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{own}") + F.col(f"b.{before}")).alias("upto")
    )


def emitted(rows: DataFrame, group: str, order: list[str], expected: str, seed: str = "mix") -> DataFrame:
    """``rows`` with ``copies``: the whole numbers that a row's ``expected`` copies step over in its group's sum.

    ``expected`` is a double, 0 or more; a group's offset is drawn from its name and ``seed``.
    """
    units = "_units"
    counted = rows.withColumn(units, F.floor(F.col(expected) * UNIT + 0.5).cast("long"))
    found = summed(counted, [group], order, units, UNIT)
    upto = F.shiftright(F.col("upto") + offset(F.col(group).cast("string"), seed), 32)
    before = F.shiftright(F.col("upto") - F.col(units) + offset(F.col(group).cast("string"), seed), 32)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], (upto - before).alias("copies"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of (source, size): weights over the sources in order.

    All sizes are shared by weight; a source above ``MOST`` times its size is
    held there and the rest shared again, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("upto") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = materialize(
        summed(totals.withColumn("one", F.lit(1).cast("long")), [], ["source"], "one").select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("most")
        ),
        "weights",
    )
    full, level = F.lit(False), 0.0
    held_before = -1
    while True:
        # One row per round, whatever the number of sources.
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("n"),
        ).first()
        if not row["open"] or row["n"] == held_before:
            break
        held_before = row["n"]
        level = (row["all"] - row["held"]) / row["open"]
        full = F.col("weight") * F.lit(level) > F.col("most")
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of (row, doc_id, source, size) with ``source_size``, ``target`` and the number of ``copies``."""
    goal = targets(sized)
    # Each document of the source is expected target / source_size times.
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "row", "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", share.alias("expected")
    )
    return emitted(wanted, "source", ["size", "doc_id", "row"], "expected", seed).drop("expected")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The narrow table everything else is done on, written once."""
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"),
            words(F.col(text)).alias("size"),
        ),
        "sizes",
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.

    ``docs`` must give the same rows in the same order when read twice (files, a written table).
    """
    row, times, copy = fresh(docs.columns, "row", "copies", "copy")
    taken = copies(sizes(docs, key, text, source), seed).filter("copies > 0").select(
        F.col("row").alias(row), F.col("copies").cast("int").alias(times)
    )
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    again = numbered.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    return copies(sizes(docs), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
