"""Unlocks and matches for a table of candidates against each candidate by itself."""

import random

import pytest
from pyspark.sql import functions as F

from skillgap.operators.candidates import matched_for, unlocks_for
from skillgap.operators.unlock import baseline, eligible, unlocks


@pytest.mark.parametrize("threshold,least", [(60, 3), (100, 2), (75, 4)])
def test_many_candidates_equal_each_by_itself(spark, threshold, least):
    rnd = random.Random(threshold)
    names = [f"s{i}" for i in range(12)]
    jobs = spark.createDataFrame(
        [(f"j{i}", f"t{i}", rnd.choice([None, rnd.sample(names, rnd.randint(0, 7)), ["s0", "s1", "s1", None, "s2"]])) for i in range(300)],
        "job_id string, title string, skills_required array<string>",
    ).cache()
    held = [rnd.sample(names, rnd.randint(0, 6)) for _ in range(6)] + [[], None, ["s0", None, "s0"], names, ["none"]]
    held += held[:3]
    people = spark.createDataFrame(list(enumerate(held)), "candidate_id int, skills array<string>")
    matched = {r["candidate_id"]: r["matched_jobs"] for r in matched_for(jobs, people, threshold, least).collect()}
    unlocked = {(r["candidate_id"], r["skill"]): r["unlocks"] for r in unlocks_for(jobs, people, threshold, least).collect()}
    assert len(matched) == len(held)
    want = {}
    for i, own in enumerate(held):
        own = [s for s in own or [] if s]
        elig = eligible(jobs, own, least).select("skills", "n", "m")
        assert matched[i] == baseline(elig, threshold).first()["matched_jobs"]
        want |= {(i, r["skill"]): r["unlocks"] for r in unlocks(elig, own, threshold).collect()}
    assert unlocked == want
    with pytest.raises(ValueError):
        unlocks_for(jobs, people, 30, 3)
    assert matched_for(jobs.limit(0), people, threshold, least).agg(F.sum("matched_jobs")).first()[0] == 0
