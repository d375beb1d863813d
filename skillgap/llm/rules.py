"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule names what it rejects and what it reads for that beside the measures
every row gets. On a sample of ``SAMPLE_ROWS`` rows, those with the smallest
digests of key and text, wherever in the table they are, its selectivity is the
share of rows it rejects and its cost the mean of what it reads: numbers, and
characters gone through. The rules are tried in order of rejections per cost, and a row
stops at the first rule that rejects it. Both estimates are counts, so the order is the same
on every run and machine; seconds would not tell rules of a few thousand rows
apart. The verdict is the same in any order.

Null texts have no words. Repeated rows and null keys give a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Rows on which cost and selectivity are estimated.
SAMPLE_ROWS = 4000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    #: Numbers and characters that a row's answer takes, beside the measures.
    reads: Column


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``__text``."""
    body = F.coalesce(F.col(text), F.lit(""))
    # The ends are trimmed, so that only the empty text splits into an empty word.
    trimmed = F.regexp_replace(body, rf"^{SPACES}|{SPACES}$", "")
    split = docs.select(F.col(key).alias("doc_id"), body.alias("__text"), F.split(trimmed, SPACES).alias("__split"))
    rows = split.select(
        "doc_id", "__text", F.when(F.element_at("__split", 1) == "", F.array().cast("array<string>")).otherwise(F.col("__split")).alias("__words")
    )
    # A word's hash stands for it inside a window; a window's hash is taken over eight of them.
    rows = rows.withColumn("n_words", F.size("__words").cast("long"))
    windows = F.when(
        F.col("n_words") > WINDOW,
        F.transform(
            F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")),
            lambda i: F.xxhash64(F.slice("__words", i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id", "__text", "n_words", windows.alias("__windows"), lines.alias("__lines"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", WORD, ""))).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    # Only a text that repeats a window needs the places: windows sorted by hash, those with an equal neighbour kept.
    rows = rows.withColumn("__again", F.size(F.array_distinct("__windows")) < F.size("__windows"))
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__placed", F.when(F.col("__again"), placed))
    repeated = F.array_sort(
        F.filter(
            F.transform(
                "__placed",
                lambda x, n: F.when(
                    (F.get("__placed", n - 1)["h"] == x["h"]) | (F.get("__placed", n + 1)["h"] == x["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
    )
    rows = rows.withColumn("__at", F.when(F.col("__again"), repeated))
    # A window adds its eight words, or as many as lie before the next one.
    covered = F.aggregate(
        F.transform("__at", lambda i, n: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", n + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b,
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"), "__text",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Rules beside the base; a text without words is rejected by the base."""
    n, chars = F.col("n_words"), F.char_length("__text")
    letters = chars - F.char_length(F.regexp_replace("__text", r"\p{L}", ""))
    upper = chars - F.char_length(F.regexp_replace("__text", r"\p{Lu}", ""))
    two = F.lit(2).cast("long")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n, two),
        Rule("word_length", (F.col("word_chars") > 15 * n) | (F.col("word_chars") < 2 * n), two),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("__n_lines")), two),
        Rule("few_letters", 2 * letters < F.col("word_chars"), chars.cast("long") + 1),
        Rule("shouting", 2 * upper > letters, 2 * chars.cast("long")),
    ]


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows with the smallest digests of key and text; rows that equal the last of them are taken too.

    Only digests are ranked; the texts stay where they are.
    """
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    last = docs.select(digest.alias("digest")).orderBy("digest").limit(rows).agg(F.max("digest")).first()[0]
    return docs.select(key, text).filter(digest <= F.lit(last or ""))


def ordered(rows: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost, with share of rejected rows and mean cost over ``rows`` (measured)."""
    sums = [F.count("*").alias("n")]
    for i, rule in enumerate(rules):
        sums += [F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long")).alias(f"rejected{i}"), F.sum(rule.reads).alias(f"read{i}")]
    row = rows.agg(*sums).first()
    n = max(1, row["n"])
    found = [(rule, (row[f"rejected{i}"] or 0), max(1, row[f"read{i}"] or 0)) for i, rule in enumerate(rules)]
    return [(rule, a / n, b / n) for rule, a, b in sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules are not evaluated then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), rule.name).otherwise(out)
    return out


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``stopped_by`` per row; the base goes first."""
    rows = measures(docs, key, text)
    measured = measures(sample(docs, key, text), key, text)
    chosen = [r for r, _, _ in ordered(measured, standard_rules() if rules is None else rules)]
    stopped = cascade([Rule("base", base_failed(), F.lit(2)), *chosen])
    return rows.withColumn("base_failed", base_failed()).withColumn("stopped_by", stopped).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("stopped_by").isNull().alias("kept"), "stopped_by",
    )
