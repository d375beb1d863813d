"""The automaton over plain names against the expressions, on random text, and its time for long catalogs."""

import random
import time

from pyspark.sql import functions as F

from skillgap.catalog import SKILLS, SkillCatalog
from skillgap.functions.names import NameFinder, extract_names, mention_totals
from skillgap.functions.text import extract_skills
from skillgap.operators.market import mention_counts


def test_names_equal_the_expressions(spark):
    rnd = random.Random(11)
    catalog = SkillCatalog.of(
        ["a a", "Spring Data", "C", "dot.net", "x y z", "Zz", *SKILLS.names], SKILLS.aliases, SKILLS.long_forms, SKILLS.hints
    )
    parts = [*catalog.names, "a", " ", "  ", "\n", "\u00a0", "\x1c", "\u2003", "+", "#", "_", ".", "(", "é", "\u017f", "\u212a", "1", "x y", "Java", "rag", "RAG"]
    said = lambda: rnd.choice(parts) if rnd.random() < 0.6 else rnd.choice(parts).upper()
    texts = ["".join(said() + rnd.choice(["", " ", ", "]) for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "a a a a", "a  a\ta a"])]
    df = spark.createDataFrame(rows, "id int, text string")
    both = df.select("id", extract_names(F.col("text"), catalog).alias("one"), extract_skills(F.col("text"), catalog).alias("other")).collect()
    assert all(r["one"] == r["other"] for r in both) and any(len(r["one"]) > 4 for r in both)
    jobs = df.select(F.lit("").alias("title"), F.col("text").alias("description"))
    assert [tuple(r) for r in mention_totals(jobs, catalog).collect()] == [tuple(r) for r in mention_counts(jobs, catalog).collect()]
    assert mention_totals(jobs.limit(0), catalog).count() == 0


def test_time_does_not_follow_the_number_of_names():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(4, 9)))
    names = [f"{word()} {word()}" if i % 3 else word() for i in range(5000)]
    texts = [" ".join(word() for _ in range(400)) + " " + rnd.choice(names) for _ in range(300)]
    took = []
    for some in (names[:73], names):
        finder = NameFinder(tuple(some))
        finder.counts(texts[0])
        start = time.perf_counter()
        for t in texts:
            finder.counts(t)
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 0.05
