"""Corpus diagnostics: near-duplicates, zero-width characters, leaked literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgap.catalog import ZERO_WIDTH_CHARACTERS
from skillgap.functions.text import identity_prefix, normalize_text
from skillgap.operators.skew import salted_lookup
from skillgap.sources.scratch import materialize


def first_difference(a: Column, b: Column) -> Column:
    """Index from 0 of the first differing character; null if the texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    places = F.when(a != b, F.sequence(F.lit(1), longest))
    differing = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.try_element_at(differing, F.lit(1)) - 1


def near_duplicates(df: DataFrame) -> DataFrame:
    """Postings that agree in title, company and location with another one under a different id.

    Each member is compared with the first id of its group, so a group of any
    size gives one row per member, not one per pair. The normalised texts are staged (see ``scratch_scope``).
    """
    keys = ["title_key", "company_key", "location_key"]
    rows = materialize(
        df.select(
            "job_id",
            normalize_text(F.col("title")).alias(keys[0]),
            normalize_text(F.col("company_name")).alias(keys[1]),
            normalize_text(F.col("location")).alias(keys[2]),
            identity_prefix(F.col("description")).alias("prefix"),
        ),
        "identities",
    )
    groups = (
        rows.groupBy(*keys)
        .agg(
            F.min("job_id").alias("first_id"),
            F.max("job_id").alias("last_id"),
            F.count("*").alias("group_size"),
            F.min_by("prefix", "job_id").alias("first_prefix"),
        )
        .where("first_id <> last_id")
    )
    return (
        salted_lookup(rows, groups, keys, ["job_id"])
        .where("job_id <> first_id")
        .select(
            "first_id", "job_id", "group_size", first_difference(F.col("first_prefix"), F.col("prefix")).alias("differs_at")
        )
    )


def zero_width_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, zero_width): how many invisible characters each column holds in all."""
    pattern = F.lit(f"[{ZERO_WIDTH_CHARACTERS}]")
    totals = df.agg(*[F.coalesce(F.sum(F.regexp_count(c, pattern)), F.lit(0)).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).alias("zero_width")) for c in columns]
    return totals.select(F.inline(F.array(*pairs)))


def scan_literals(texts: DataFrame, literals: dict[str, str], text: str = "text") -> DataFrame:
    """Adds one flag per named literal, and ``clean`` where none is found."""
    flags = {f"has_{name}": F.col(text).contains(literal) for name, literal in literals.items() if literal}
    found = F.lit(False)
    for flag in flags:
        found = found | F.col(flag)
    return texts.withColumns(flags).withColumn("clean", ~found)


def redact(texts: DataFrame, literals: dict[str, str], text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    cleaned = F.col(text)
    for literal in literals.values():
        if literal:
            cleaned = F.replace(cleaned, F.lit(literal), F.lit(mark))
    return texts.withColumn(text, cleaned)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, -1 above ``most``."""
    return F.levenshtein(a, b, most)


def near_titles(df: DataFrame, most: int = 2, by: Sequence[str] = ("company_key", "location_key"), share: int = 256) -> DataFrame:
    """Postings of one company and place whose titles differ in up to ``most`` edits: one row per differing title.

    (company_key, location_key, title_key, first_title, postings, titles): every distinct title, the smallest of the titles
    that links reach, how many postings have it, and how many titles are linked to it directly.

    Titles are compared, not postings: postings of one title are one row from the start. Two titles within k edits
    share one of the k + 1 pieces that the longer's half would make: the pieces of the one stand in the other, off their place by
    k at most. Each title is listed under its own pieces and looked up under the stretches it has there for each
    length within k of its own. A piece with more than ``share`` titles is met in blocks, so that no task holds
    all of it. Titles of up to k characters have empty pieces and meet by length alone.
    """
    keys = list(by)
    titles = materialize(
        df.select(
            normalize_text(F.col("company_name")).alias("company_key"), normalize_text(F.col("location")).alias("location_key"),
            normalize_text(F.col("title")).alias("title_key"),
        ).groupBy(*keys, "title_key").agg(F.count("*").alias("postings")),
        "titles",
    )
    size = F.char_length("title_key")
    numbers = F.sequence(F.lit(0), F.lit(most))
    # Where piece i of a title of n characters begins and ends: n * i / (k + 1), rounded down.
    edge = lambda n, i: F.floor(n * i / F.lit(most + 1)).cast("int")
    piece = lambda text, begin, end: F.substring(text, begin + 1, end - begin)
    listed = titles.select(*keys, "title_key", F.explode(numbers).alias("number")).select(
        *keys, F.col("title_key").alias("other"), F.char_length("title_key").alias("length"), "number",
        piece(F.col("title_key"), edge(size, F.col("number")), edge(size, F.col("number") + 1)).alias("piece"),
    )
    lengths = F.sequence(F.greatest(F.lit(0), size - most), size)
    asked = (
        titles.select(*keys, "title_key", F.explode(lengths).alias("length"))
        .select("*", F.explode(numbers).alias("number"))
        .select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("off"))
        .withColumn("begin", edge(F.col("length"), F.col("number")) + F.col("off"))
        .withColumn("end", edge(F.col("length"), F.col("number") + 1) + F.col("off"))
        .where((F.col("begin") >= 0) & (F.col("end") <= F.char_length("title_key")))
        .select(*keys, "title_key", "length", "number", piece(F.col("title_key"), F.col("begin"), F.col("end")).alias("piece"))
        .distinct()
    )
    at = [*keys, "length", "number", "piece"]
    busy = materialize(listed.groupBy(*at).agg(F.ceil(F.count("*") / share).cast("int").alias("blocks")).where("blocks > 1"), "busy")
    block = F.pmod(F.xxhash64("other"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = listed.join(busy, at, "left").withColumn("block", block).drop("blocks")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    spread = asked.join(busy, at, "left").withColumn("block", every).drop("blocks")
    pairs = spread.join(dealt, [*at, "block"]).where("title_key <> other").select(*keys, "title_key", "other").distinct()
    near = pairs.where(edit_distance(F.col("title_key"), F.col("other"), most) >= 0)
    # Shorter titles are found from the longer ones; links go both ways.
    links = materialize(near.unionByName(near.select(*keys, F.col("other").alias("title_key"), F.col("title_key").alias("other"))).distinct(), "links")
    firsts = _smallest_reached(titles, links, keys)
    counted = links.groupBy(*keys, "title_key").agg(F.count("*").alias("titles"))
    return firsts.join(counted, [*keys, "title_key"], "left").select(
        *keys, "title_key", "first_title", "postings", F.coalesce("titles", F.lit(0)).alias("titles")
    )


def _smallest_reached(titles: DataFrame, links: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """``titles`` with ``first_title``: the smallest title that links reach; each round the smallest known passes on one
    link, and to what that has found, until nothing changes."""
    now = materialize(titles.withColumn("first_title", F.col("title_key")), "reached")
    for _ in range(rounds):
        found = now.select(*keys, "title_key", "first_title")
        offered = links.join(found.withColumnRenamed("title_key", "other"), [*keys, "other"]).groupBy(*keys, "title_key").agg(
            F.min("first_title").alias("offered")
        )
        lower = now.join(offered, [*keys, "title_key"], "left").withColumn("first_title", F.least("first_title", "offered")).drop("offered")
        lower = materialize(lower, "reached")
        # What a title points to may itself point further.
        onward = lower.select(*keys, F.col("title_key").alias("first_title"), F.col("first_title").alias("onward"))
        after = lower.join(onward, [*keys, "first_title"], "left").withColumn("first_title", F.least("first_title", "onward")).drop("onward")
        after = materialize(after.select(*now.columns), "reached")
        changed = after.join(found.withColumnRenamed("first_title", "was"), [*keys, "title_key"]).where("first_title <> was")
        now = after
        if changed.isEmpty():
            return now
    raise RuntimeError(f"titles are not settled after {rounds} rounds")
