"""Unlock, path, fit: known answers and a plain-Python oracle."""

import random

import pytest
from pyspark.sql import functions as F

from skillgap.operators import fit, market, unlock
from skillgap.plans.reports import unlock_report

SEVEN = [
    ("J1", "Backend Dev 1", "Company A", "Bengaluru", "On-site", 2, ["Python", "SQL", "Docker"]),
    ("J2", "Cloud Dev 2", "Company B", "Remote", "Remote", 1, ["Python", "Docker", "AWS"]),
    ("J3", "Platform Dev 3", "Company C", "Remote", "Remote", 3, ["Python", "Docker", "Kubernetes", "AWS"]),
    ("J4", "Data Analyst 4", "Company D", "Bengaluru", "On-site", 1, ["SQL", "Tableau", "Excel"]),
    ("J5", "Enterprise Dev 5", "Company E", "Hyderabad", "On-site", 4, ["Java", "Spring Boot", "SQL", "AWS"]),
    ("J6", "Fullstack Dev 6", "Company F", "Remote", "Remote", 2, ["Python", "SQL", "Git", "Docker", "AWS"]),
    ("J7", "Junior Dev 7", "Company G", "Pune", "On-site", 1, ["Python", "Docker"]),
]
NARROW = "job_id string, title string, company_name string, location string, location_type string, portal_count int, skills_required array<string>"


@pytest.fixture(scope="module")
def seven(spark):
    return spark.createDataFrame(SEVEN, NARROW)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_known_answers(seven):
    held = ["Python", "SQL"]
    elig = unlock.eligible(seven, held)
    assert rows(unlock.baseline(elig)) == [(6, 1)]
    assert rows(unlock.unlocks(elig, held, top_n=10)) == [
        ("AWS", 2, 4), ("Docker", 2, 4), ("Excel", 1, 1), ("Git", 1, 1), ("Tableau", 1, 1),
    ]
    assert rows(unlock.unlock_path(elig, held)) == [(1, "AWS", 2, 2), (2, "Docker", 1, 3), (3, "Excel", 1, 4)]
    status = {r["job_id"]: r["status"] for r in fit.job_fit(seven, held).collect()}
    assert status == {
        "J1": "matched", "J2": "one_skill_away", "J4": "one_skill_away", "J6": "one_skill_away",
        "J3": "further", "J5": "further",
    }


@pytest.mark.parametrize("role", ["backend", "data", "devops_cloud", "frontend_fullstack"])
def test_one_eligible_posting_per_role(seven, role):
    assert unlock.baseline(unlock.eligible(seven, ["Python", "SQL"], role=role)).first()["eligible_jobs"] == 1


def test_unknown_role_and_bounds_are_rejected(seven):
    with pytest.raises(ValueError):
        unlock.eligible(seven, [], role="chef")
    with pytest.raises(ValueError):
        unlock.eligible(seven, [], min_skills=0)
    with pytest.raises(ValueError):
        unlock.unlocks(unlock.eligible(seven, []), [], threshold=0)
    assert unlock.eligible(seven, [], min_skills=11).count() == 0


def test_empty_corpus_gives_zeros(seven):
    report = unlock_report(seven.limit(0), ["Python"])
    assert rows(report.baseline) == [(0, 0)]
    assert rows(report.salary_benchmark) == [(0, None, None, None, None)]
    assert rows(report.path) == [] and rows(report.unlocks) == []
    assert rows(report.all_unlocks_count) == [(0,)]


def oracle(postings, held, threshold, k, steps=3):
    elig = []
    for job_id, skills in postings:
        s = {x for x in skills or [] if x is not None}
        if skills is not None and len(s) >= k:
            elig.append((job_id, s))

    def covered(s, r, extra=0):
        return (len(s & r) + extra) * 100 >= threshold * len(s)

    def ranking(r):
        found = []
        for skill in set().union(*[s for _, s in elig]) - r if elig else ():
            having = [(j, s) for j, s in elig if skill in s]
            hits = [(j, s) for j, s in having if not covered(s, r) and covered(s, r, 1)]
            if hits:
                found.append((-len(hits), -len(having), skill, hits))
        return sorted(found, key=lambda x: x[:3])

    r = set(held)
    first = ranking(r)
    unlocked = [(s, -u, -d) for u, d, s, _ in first]
    examples = {}
    for _, _, s, hits in first:
        best = sorted((-(len(x & r) * 100 // len(x)), j, (len(x & r) + 1) * 100 // len(x)) for j, x in hits)
        examples[s] = [(j, -b, a) for b, j, a in best[:3]]
    path, gain = [], 0
    for step in range(1, steps + 1):
        ranked = ranking(r)
        if not ranked:
            break
        u, _, s, _ = ranked[0]
        gain -= u
        path.append((step, s, -u, gain))
        r = r | {s}
    return (len(elig), sum(covered(s, set(held)) for _, s in elig)), unlocked, examples, path


@pytest.mark.parametrize("seed,threshold,k", [(1, 60, 3), (2, 20, 3), (3, 33, 2), (4, 100, 1), (5, 75, 2), (6, 1, 1)])
def test_against_plain_python(spark, seed, threshold, k):
    rnd = random.Random(seed)
    names = [f"s{i:02d}" for i in range(12)]
    postings = []
    for i in range(150):
        skills = None if rnd.random() < 0.05 else [
            None if rnd.random() < 0.05 else rnd.choice(names[: rnd.randint(3, 12)]) for _ in range(rnd.randint(0, 8))
        ]
        postings.append((f"j{i:03d}", skills))
    held = rnd.sample(names, 3) + ["unheard"]
    df = spark.createDataFrame(postings, "job_id string, skills_required array<string>").select(
        "job_id", F.lit("t").alias("title"), F.lit("c").alias("company_name"), "skills_required"
    )
    elig = unlock.eligible(df, held, k)
    base, unlocked, examples, path = oracle(postings, held, threshold, k)
    assert rows(unlock.baseline(elig, threshold)) == [base]
    assert rows(unlock.unlocks(elig, held, threshold).orderBy(*unlock.ranking())) == unlocked
    assert rows(unlock.unlock_path(elig, held, threshold)) == path
    top = unlock.unlocks(elig, held, threshold, 10)
    for r in unlock.attach_examples(top, unlock.unlock_examples(elig, top, threshold)).collect():
        assert [(e["job_id"], e["match_before"], e["match_after"]) for e in r["example_jobs"]] == examples[r["skill"]]
    gain = path[-1][3] if path else 0
    chosen = [p[1] for p in path]
    after = unlock.baseline(unlock.eligible(df, held + chosen, k), threshold).first()["matched_jobs"]
    assert after == base[1] + gain
    projected = rows(unlock.projected_matches(unlock.baseline(elig, threshold), unlock.unlock_path(elig, held, threshold)))
    assert [p[2] for p in sorted(projected)] == [base[1]] + [base[1] + p[3] for p in path]


def test_salary_benchmark_rounds_money_half_up(spark):
    data = [("a", ["x"] * 1, 7.25, 7.35), ("b", ["y"], 8.0, 10.45), ("c", ["x"], 9.0, 7.25)]
    df = spark.createDataFrame(data, "job_id string, skills_required array<string>, salary_min_lpa double, salary_max_lpa double").withColumn("title", F.lit(""))
    got = unlock.salary_benchmark(unlock.eligible(df, ["x"], 1)).first()
    lo, hi, top = 7.3, 7.4, 10.5
    assert tuple(got) == (2, lo, hi, top, round((top - hi) / hi * 100))


def test_role_summary(seven):
    summary = {r["role"]: r["jobs"] for r in market.role_summary(seven).collect()}
    assert summary == {
        "backend": 1, "data": 1, "ml_ai": 0, "devops_cloud": 1, "frontend_fullstack": 1, "any_role_unmatched": 2,
    }


def test_fit_report_is_ranked_in_many_tasks(spark):
    """No window of the plan has the postings in one partition: a single-partition exchange holds counts only."""
    import workload.coverage_queries  # noqa: F401
    from workload.registry import QUERIES

    found = QUERIES["fit_report"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line and "row_number()" in line and "part" not in line]
    assert not whole
    places = [r["place"] for r in found.collect()]
    assert sorted(places) == list(range(1, len(places) + 1)) and places
