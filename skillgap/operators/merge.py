"""One row per posting id: the ordered merge of stored and incoming postings.

The merge is defined as a fold over the rows of an id, the stored row first and
then the batch in arrival order. Here every column has a closed form over
(first, last, earliest, union ...), so the fold becomes aggregates that combine
in each task before the shuffle. No list of all rows of an id is ever built, and
an id that holds a third of the batch is merged like any other. Ids that occur
once pass by; one narrow count tells them.

Stored rows of a small batch are looked for by their ids, which reach the files: where the table
is sorted by id, few pages of it are read. For a larger batch the store is read
once and dealt into the rows that the batch touches and the others. The rows that take part are
written once and read by what follows. Joins back to them have a plain
table on both sides, so Spark splits an id with many rows by itself.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.functions.postings import publisher
from skillgap.functions.text import empty_to_null, strip
from skillgap.schema import POSTING, conform_schema
from skillgap.sources.scratch import materialize

ARRIVAL = "arrival"
#: Ids of a batch that may be named one by one in a filter.
FEW_IDS = 10_000
#: Ids of one list in such a filter: the files' reader takes a list apart into a chain and goes down it by recursion.
LISTED_IDS = 256

# The last value that is not null wins; an empty string is a value.
_LAST_KNOWN = [
    "title", "company_name", "location", "via", "description", "schedule_type",
    "posted_at", "posted_days_ago", "via_platform", "source_gl",
]


def _first(c: Column | str, when: Column | None = None) -> Column:
    order = F.col("ord") if when is None else F.when(when, F.col("ord"))
    return F.min_by(c, order)


def _last(c: Column | str, when: Column | None = None) -> Column:
    order = F.col("ord") if when is None else F.when(when, F.col("ord"))
    return F.max_by(c, order)


def _has_text(c: Column) -> Column:
    return c.isNotNull() & (strip(c) != "")


def _ordered_rows(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored and incoming rows with ``ord``: the place of a row in its id's fold."""
    missing = F.lit(None).cast(batch.schema[ARRIVAL].dataType)
    stored = stored.withColumn("ord", F.struct(F.lit(0).alias("incoming"), missing.alias(ARRIVAL)))
    new = batch.withColumn("ord", F.struct(F.lit(1).alias("incoming"), F.col(ARRIVAL).alias(ARRIVAL)))
    shaped = [F.col(f.name).cast(f.dataType).alias(f.name) for f in POSTING.fields]
    return stored.unionByName(new.select(*shaped, "ord"))


def _single_values(rows: DataFrame) -> DataFrame:
    """Every column with a first/last/any/earliest rule, one row per id."""
    pay = F.coalesce(empty_to_null(F.col("salary_raw")), F.col("salary"))
    paid = _has_text(F.col("pay"))
    lpa = F.struct("salary_min_lpa", "salary_max_lpa")
    remote = F.coalesce(F.col("work_from_home"), F.lit(False)) | F.coalesce(
        F.col("location_type") == "Remote", F.lit(False)
    )
    whole_row = F.struct("salary", "salary_raw", "portal_count", "apply_options", "skills_required",
                         "source_queries", "source_query", "location_type", "apply_link")
    return rows.withColumn("pay", pay).groupBy("job_id").agg(
        F.count("*").alias("row_count"),
        *[_last(c, F.col(c).isNotNull()).alias(c) for c in _LAST_KNOWN],
        _first(whole_row).alias("first_row"),
        F.min("ord").alias("first_ord"),
        _first("pay", paid).alias("first_pay"),
        F.min(F.when(paid, F.col("ord"))).alias("paid_ord"),
        _first(lpa, paid).alias("paid_lpa"),
        _last("pay").alias("last_pay"),
        _last(lpa).alias("last_lpa"),
        F.min("scraped_at").alias("scraped_at"),
        F.bool_and(F.coalesce("is_snapshot", F.lit(False))).alias("is_snapshot"),
        _first("source_token", empty_to_null(F.col("source_token")).isNotNull()).alias("source_token"),
        F.bool_or(F.coalesce("work_from_home", F.lit(False))).alias("work_from_home"),
        F.bool_or(remote).alias("any_remote"),
    )


def _item(tag: str, key: Column, place: Column, title: Column, link: Column) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"), key.alias("key"), place.alias("place"), title.alias("title"), link.alias("link")
    )


def _list_items(rows: DataFrame) -> DataFrame:
    """Phrases, options and skills of each id, each kept once at its first place.

    The values are counted out per (id, value) first, so what is collected per
    id is the merged list itself.
    """
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    phrases = F.array_append(F.coalesce("source_queries", empty), F.col("source_query"))
    items = F.concat(
        F.transform(phrases, lambda p, i: _item("phrase", strip(p), i, none, none)),
        F.coalesce(
            F.transform("apply_options", lambda o, i: _item("option", publisher(o), i, o["title"], o["link"])),
            F.array(),
        ),
        F.transform(F.coalesce("skills_required", empty), lambda s, i: _item("skill", s, i, none, none)),
    )
    at = F.struct("ord", "item.place")
    first_seen = (
        rows.select("job_id", "ord", F.explode(items).alias("item"))
        .where(F.col("item.key").isNotNull() & ((F.col("item.tag") == "skill") | (F.col("item.key") != "")))
        .groupBy("job_id", "item.tag", "item.key")
        .agg(F.min(at).alias("at"), F.min_by(F.struct("item.title", "item.link"), at).alias("option"))
    )
    collected = first_seen.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("tag", "at", "key", "option"))).alias("items")
    )

    def of(tag: str, value) -> Column:
        return F.transform(F.filter("items", lambda x: x["tag"] == tag), value)

    return collected.select(
        "job_id",
        of("phrase", lambda x: x["key"]).alias("merged_phrases"),
        of("option", lambda x: x["option"]).alias("merged_options"),
        F.array_sort(of("skill", lambda x: x["key"])).alias("merged_skills"),
    )


def _late_values(rows: DataFrame, single: DataFrame) -> DataFrame:
    """What one pass cannot know: figures after the first salary, and the second row's arrangement.

    Only ids whose first salary came without a figure, or whose first row lacks
    an arrangement, take part.
    """
    first_place = empty_to_null(F.col("first_row.location_type"))
    open_pay = F.col("paid_ord").isNotNull() & (
        F.col("paid_lpa.salary_min_lpa").isNull() | F.col("paid_lpa.salary_max_lpa").isNull()
    )
    open_ids = single.where(
        (F.col("row_count") > 1) & (open_pay | (first_place.isNull() & ~F.col("any_remote")))
    ).select("job_id", "paid_ord", "first_ord")
    narrow = rows.select("job_id", "ord", "salary_min_lpa", "salary_max_lpa", "location_type")
    joined = narrow.join(open_ids, "job_id")
    paid_on = F.col("ord") >= F.col("paid_ord")
    return joined.groupBy("job_id").agg(
        _first("salary_min_lpa", paid_on & F.col("salary_min_lpa").isNotNull()).alias("late_min"),
        _first("salary_max_lpa", paid_on & F.col("salary_max_lpa").isNotNull()).alias("late_max"),
        _first("location_type", F.col("ord") > F.col("first_ord")).alias("second_place"),
    )


def _lone(rows: DataFrame) -> DataFrame:
    """Rows whose id occurs once, as the fold leaves them."""
    settled = {
        "is_snapshot": F.coalesce("is_snapshot", F.lit(False)),
        "source_token": empty_to_null(F.col("source_token")),
        "work_from_home": F.coalesce("work_from_home", F.lit(False)),
    }
    return rows.select(*[settled.get(f.name, F.col(f.name)).alias(f.name) for f in POSTING.fields])


def _fold_several(rows: DataFrame) -> DataFrame:
    """One merged row per id for ids with more than one row; ``rows`` are read several times."""
    single = materialize(_single_values(rows), "merge-ids")
    lists = _list_items(rows)
    late = _late_values(rows, single)
    x = single.join(lists, "job_id", "left").join(late, "job_id", "left")

    own = F.col("first_row")
    options = F.coalesce("merged_options", F.array())
    phrases = F.coalesce("merged_phrases", F.array().cast("array<string>"))
    pay = F.coalesce("first_pay", "last_pay")

    def figure(name: str, late_name: str) -> Column:
        with_pay = F.coalesce(F.col(f"paid_lpa.{name}"), F.col(late_name))
        return F.when(F.col("paid_ord").isNotNull(), with_pay).otherwise(F.col(f"last_lpa.{name}"))

    merged = {
        "salary": pay,
        "salary_raw": pay,
        "salary_min_lpa": figure("salary_min_lpa", "late_min"),
        "salary_max_lpa": figure("salary_max_lpa", "late_max"),
        "apply_options": options,
        "portal_count": F.greatest(F.lit(1), F.size(options)),
        "apply_link": F.when(empty_to_null(own["apply_link"]).isNotNull() | (F.size(options) == 0), own["apply_link"])
        .otherwise(F.try_element_at(options, F.lit(1))["link"]),
        "source_queries": phrases,
        "source_query": F.coalesce(empty_to_null(own["source_query"]), F.try_element_at(phrases, F.lit(1))),
        "skills_required": F.coalesce("merged_skills", F.array().cast("array<string>")),
        "location_type": F.when(F.col("any_remote"), "Remote").otherwise(
            F.coalesce(empty_to_null(own["location_type"]), empty_to_null(F.col("second_place")), F.lit("On-site"))
        ),
    }
    return x.select(*[merged.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in POSTING.fields])


@contextlib.contextmanager
def _values_in_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Lists of up to ``n`` values, LISTED_IDS at most, reach the files as such, and not as their smallest and largest."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(min(n, LISTED_IDS), int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass(frozen=True)
class Sides:
    """A store's rows that a batch leaves alone, those it touches, and the batch's ids in all."""

    untouched: DataFrame
    touched: DataFrame
    ids: int


def sides(store: DataFrame, batch: DataFrame, few: int = FEW_IDS) -> Sides:
    """The store's rows dealt by whether their id occurs in the batch; the touched ones are staged."""
    store, spark = conform_schema(store), store.sparkSession
    ids = materialize(batch.select("job_id").distinct(), "batch-ids")
    n = ids.count()
    if n <= few:
        touched, left = named_ids(store, [r["job_id"] for r in ids.collect()])
        with _values_in_files(spark, n):
            return Sides(left, materialize(touched, "touched"), n)
    tagged = store.join(ids.withColumn("touched", F.lit(True)), "job_id", "left").withColumn("touched", F.col("touched").isNotNull())
    both = materialize(tagged, "sides", by="touched")
    shaped = [f.name for f in POSTING.fields]
    return Sides(both.where(~F.col("touched")).select(*shaped), both.where("touched").select(*shaped), n)


def named_ids(store: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with one of the ids, and the others; rows without an id are others."""
    listed = sorted({i for i in ids if i is not None})
    if not listed:
        return store.where(F.lit(False)), store
    named = F.col("job_id").isin(listed)
    # One look-up settles a row; the short lists are for the files.
    return store.where(named & _in_lists(listed)), store.where(~named | F.col("job_id").isNull())


def _in_lists(ids: Sequence[str]) -> Column:
    """Whether the id is one of ``ids``, as a tree of equal depth over lists of at most LISTED_IDS."""
    if len(ids) <= LISTED_IDS:
        return F.col("job_id").isin(list(ids))
    middle = len(ids) // 2
    return _in_lists(ids[:middle]) | _in_lists(ids[middle:])


def touch_existing(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows whose id occurs in the batch."""
    return sides(store, batch).touched


@dataclass(frozen=True)
class Merged:
    """What a merge does: rows left alone, touched rows as they were, incoming rows alone under their id, and merged rows."""

    untouched: DataFrame
    before: DataFrame
    lone: DataFrame
    folded: DataFrame

    @property
    def after(self) -> DataFrame:
        """The rows of the touched and the new ids, as the merge leaves them."""
        return self.lone.unionByName(self.folded)


def merge_parts(store: DataFrame, batch: DataFrame) -> Merged:
    """The merge of a prepared batch in its parts; what the parts are made of is staged (see ``scratch_scope``)."""
    dealt = sides(store, batch)
    counted = batch.select("job_id").unionByName(dealt.touched.select("job_id")).groupBy("job_id").agg(F.count("*").alias("n"))
    several = materialize(counted.where("n > 1").select(F.col("job_id").alias("several")), "merge-several")
    # Each side's texts move once: the store's to find the touched rows, the batch's here.
    same = F.col("job_id").eqNullSafe(F.col("several"))
    tagged = batch.join(several.withColumn("again", F.lit(True)), same, "left").withColumn("again", F.col("again").isNotNull()).drop("several")
    arrived = materialize(tagged, "merge-batch", by="again")
    rows = _ordered_rows(dealt.touched, arrived.where("again").drop("again"))
    lone = arrived.where(~F.col("again")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in POSTING.fields])
    return Merged(dealt.untouched, dealt.touched, _lone(lone), _fold_several(rows))


def merge_postings(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store with a prepared batch merged in; one row per id.

    ``batch`` comes from ``prepare_batch`` and carries ``arrival``; it is read
    twice. Stored rows that the batch does not touch pass on as they are.
    """
    parts = merge_parts(store, batch)
    return parts.untouched.unionByName(parts.after)
