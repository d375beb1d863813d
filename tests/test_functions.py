"""Derivations of one posting: known input and output pairs."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skillgap import catalog
from skillgap.catalog import ROLES, SKILLS
from skillgap.functions import coverage, postings, recency, salary, text
from skillgap.operators import resumes
from skillgap.operators.diagnostics import first_difference
from skillgap.schema import backfill, conform_schema, stringify


def apply(spark, values, fn, kind="string"):
    """fn over one column, results in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


def test_salary_to_lakh_per_annum(spark):
    cases = {
        "₹50,000–80,000 a month": (6.0, 9.6), "₹50,000 - 80,000 a month": (6.0, 9.6),
        "₹8–12 LPA": (8.0, 12.0), "8 - 12 LPA": (8.0, 12.0), "₹8-12 LPA": (8.0, 12.0),
        "₹6 lakh a year": (6.0, 6.0), "6.5 Lakhs / year": (6.5, 6.5),
        "INR 14,00,000 - 20,00,000 / year": (14.0, 20.0), "₹60,000 a month": (7.2, 7.2),
        "₹1.25L–₹2.5L a month": (15.0, 30.0), "₹1 LPA": (1.0, 1.0), "₹200 LPA": (200.0, 200.0),
        "₹50K–₹90K a month": (6.0, 10.8), "₹15L–₹21L a year": (15.0, 21.0), "₹900K a year": (9.0, 9.0),
        "₹50K a year": (None, None), "₹500 LPA": (None, None), "₹22–₹30 a year": (None, None),
        "$120K a year": (None, None), "€80,000 - €100,000 / year": (None, None), "£50,000 a year": (None, None),
        "₹300 an hour": (None, None), "Competitive": (None, None), "Not Disclosed": (None, None), "": (None, None),
    }
    got = apply(spark, [*cases, None], salary.salary_lpa)
    assert [(g["min"], g["max"]) for g in got] == [*cases.values(), (None, None)]


def test_salary_cleaning_and_picking(spark):
    bad = ["13 hours ago", "19 hours ago", "1 day ago", "3 weeks ago", "just now", "yesterday", "today", "Full-time", "", "   ", None]
    assert apply(spark, bad, salary.clean_salary) == [None] * len(bad)
    assert apply(spark, [" ₹300 an hour "], salary.clean_salary) == ["₹300 an hour"]
    exts = [["5 days ago", "₹15L–₹21L a year", "Full-time"], ["13 hours ago"], [], None]
    got = apply(spark, exts, lambda c: salary.pick_salary(F.lit(None).cast("string"), F.lit(None).cast("string"), c), "array<string>")
    assert got == ["₹15L–₹21L a year", None, None, None]


def test_relative_age(spark):
    cases = {
        "3 hours ago": 0, "today": 0, "just now": 0, "yesterday": 1, "1 day ago": 1, "5 days ago": 5, "2 weeks ago": 14,
        "1 month ago": 30, "3 months ago": 90, "1 year ago": 365, "2 years ago": 730, "": None, "soon": None,
        "99999999999999999999 days ago": None,
    }
    assert apply(spark, [*cases, None], recency.age_days) == [*cases.values(), None]
    exts = [["Full-time", "4 days ago", "15L - 25L a year"], ["Full-time"], None]
    nothing = F.lit(None).cast("string")
    assert apply(spark, exts, lambda c: recency.pick_posted_at(nothing, c), "array<string>") == ["4 days ago", "", ""]
    assert apply(spark, ["2 days ago"], lambda c: recency.pick_posted_at(c, F.array().cast("array<string>"))) == ["2 days ago"]


def test_instants_and_age_fallback(spark):
    naive = dt.datetime(2026, 10, 8, 18, 40, 32)
    got = apply(spark, ["2026-10-08T18:40:32+00:00", "2026-10-08T18:40:32Z", "2026-10-09T00:10:32+05:30", "2026-10-08 18:40:32", "2026-10-08", "bad", None], recency.parse_instant)
    assert got == [naive] * 4 + [dt.datetime(2026, 10, 8), None, None]
    now = dt.datetime(2026, 10, 10, 18, 40, 31)
    assert apply(spark, ["2026-10-08T18:40:32Z", "2026-10-20T00:00:00Z", "bad", None], lambda c: recency.age_fallback(c, now)) == [1, 0, 0, None]


def test_fresh_labels(spark):
    days = [0, 1, 5, 7, 8, 11, 30, 45, 75, 400]
    labels = ["Today", "1d ago", "5d ago", "7d ago", "1w ago", "2w ago", "4w ago", "2mo ago", "3mo ago", "13mo ago"]
    assert apply(spark, days, lambda c: recency.fresh_label(c, F.lit("")), "int") == labels
    assert apply(spark, [None], lambda c: recency.fresh_label(c, F.lit("3 days")), "int") == ["3 days"]
    assert apply(spark, [7, 30, 31], lambda c: recency.fresh_class(c, F.lit("")), "int") == ["fresh", "recent", "stale"]


SKILL_TEXTS = {
    "Looking for a JavaScript developer who loves TypeScript and React.": ["JavaScript", "React", "TypeScript"],
    "Please submit your GitHub profile and Git commit logs.": ["Git"],
    "We are formulating our go to market strategy.": [],
    "Clean the desk with a rag before writing code.": [],
    "Architecting production RAG pipelines with Vector DB.": ["RAG"],
    "Retrieval-Augmented Generation": ["RAG"],
    "Proficiency in C++ and C# with .NET microservices required.": [".NET", "C#", "C++", "Microservices"],
    "Postgres and K8s on Amazon Web Services with NodeJS, scikit-learn and Power BI.": ["AWS", "Kubernetes", "Node.js", "PostgreSQL", "Power BI", "scikit-learn"],
    "Enterprise Spring Boot and Apache Spark data engineering.": ["Spark", "Spring Boot"],
    "Hugging Face and hugging\n face; Kafka, SſQL mySQL": ["Hugging Face", "Kafka", "MySQL"],
    "ASP.NET C++17 python3 _Python Python_ #SQL": [],
    "RESTful APIs, the rest, LLMs, CI-CD, ms excel, c sharp, go  language, Google Cloud Platform": ["C#", "CI/CD", "Excel", "GCP", "Golang", "LLM", "REST API"],
    "": [],
}


def python_skills(value):
    """The same definition with Python regular expressions."""
    found = []
    for name in SKILLS.names:
        for form in SKILLS.forms(name):
            body = form.body
            if form.bounded:
                body = f"(?<![{catalog.SKILL_BOUNDARY_SET}])(?:{body})(?![{catalog.SKILL_BOUNDARY_SET}])"
            if re.search(body, value, re.IGNORECASE if form.any_case else 0):
                found.append(name)
                break
    return sorted(found)


def test_skills_in_text(spark):
    got = apply(spark, [*SKILL_TEXTS, None], lambda c: text.extract_skills(c, SKILLS))
    assert got == [*SKILL_TEXTS.values(), []]
    assert [python_skills(t) for t in SKILL_TEXTS] == [*SKILL_TEXTS.values()]


def test_hints_never_hide_a_match(spark):
    """Every alternative of every alias, in odd spacing and case, alone and inside a sentence."""
    samples = []
    for name in SKILLS.names:
        for form in SKILLS.forms(name):
            for alt in form.body.split("|"):
                plain = re.sub(r"\[(.)[^\]]*\]", r"\1", alt)
                plain = plain.replace(r"\s*", " ").replace(r"\s+", "  ").replace("?", "").replace("(", "").replace(")", "").replace("\\", "")
                samples += [plain, f"x {plain.upper()}, y", f"({plain.lower()})", plain.title()]
    assert len(samples) > 300
    assert apply(spark, samples, lambda c: text.extract_skills(c, SKILLS)) == [python_skills(s) for s in samples]


def test_resolving_typed_names(spark):
    cases = {
        "python": "Python", " SQL ": "SQL", "k8s": "Kubernetes", "RAG": "RAG", "rag": None, "Rag": None,
        "retrieval augmented generation": "RAG", "nodejs": "Node.js", "React.js": "React", "advanced excel": "Excel",
        "unknown": None, "": None, "  ": None, "spring boot": "Spring Boot", "C#": "C#", "RAG pipelines": None,
    }
    assert apply(spark, [*cases], lambda c: text.resolve_skill(c, SKILLS)) == [*cases.values()]


def test_candidates(spark):
    rows = [
        (1, "I know Python and SQL", None), (2, None, ["python", "nope", "Python", "k8s"]), (3, None, None),
        (4, "x", ["Python"]), (5, "nothing here", None), (6, None, ["nope"]), (7, "x" * 50001, None), (8, None, ["SQL"] * 101),
    ]
    df = spark.createDataFrame(rows, "candidate_id int, resume_text string, skills array<string>")
    got = {r["candidate_id"]: (r["skills"], r["ignored"], r["status"]) for r in resumes.candidate_skills(df, max_text=50_000, max_skills=100).collect()}
    assert got == {
        1: (["Python", "SQL"], [], "ok"), 2: (["Python", "Kubernetes"], ["nope"], "ok"), 3: ([], [], "provide_one"),
        4: ([], [], "provide_one"), 5: ([], [], "no_recognized_skills"), 6: ([], [], "no_recognized_skills"),
        7: ([], [], "text_too_long"), 8: ([], [], "too_many_skills"),
    }


def test_roles(spark):
    cases = {
        "ML Engineer Backend": "ml_ai", "Senior Cloud Data Engineer": "data", "DevOps Engineer": "devops_cloud",
        "Full Stack Developer": "frontend_fullstack", "Backend Developer": "backend", "Product Manager": "other",
    }
    assert apply(spark, [*cases], lambda c: postings.role_class(c, ROLES)) == [*cases.values()]
    flags = {
        ("Rapid Prototyping Engineer", "backend"): False, ("Cloud Storage Engineer", "ml_ai"): False,
        ("ETL Developer", "data"): True, ("RAG Engineer", "ml_ai"): True, ("REST API Developer", "backend"): True,
        ("Reactive Systems Engineer", "frontend_fullstack"): False, ("ReactJS Developer", "frontend_fullstack"): True,
    }
    for (title, role), wanted in flags.items():
        assert apply(spark, [title], lambda c: postings.role_flags(c, ROLES)[role]) == [wanted], title


def test_portals(spark):
    options = [[("Shine", "https://shine.com/1"), ("LinkedIn", "https://linkedin.com/2"), ("Greenhouse", "https://boards.greenhouse.io/3")]]
    kind = "array<struct<title:string,link:string>>"
    (got,) = apply(spark, options, postings.rank_portals, kind)
    assert [o["title"] for o in got] == ["Greenhouse", "LinkedIn", "Shine"]
    twice = [[("A", "x"), (" a ", "y"), (None, "x"), (None, None), ("", "x")], []]
    got = apply(spark, twice, postings.union_by_publisher, kind)
    assert [[(o["title"], o["link"]) for o in g] for g in got] == [[("A", "x"), (None, "x")], []]
    assert apply(spark, twice, postings.portal_count, kind) == [3, 1]
    assert apply(spark, [0, 1, 7, 8, 20], postings.portal_label, "int") == ["1 portals", "1 portals", "7 portals", "8+ portals", "8+ portals"]


def test_platforms_and_phrases(spark):
    vias = {"via LinkedIn": "LinkedIn", "via Foo": "Foo", "via ": "Direct Portal", "": "Direct Portal", "Naukri.com": "Naukri"}
    assert apply(spark, [*vias, None], postings.platform_name) == [*vias.values(), "Direct Portal"]
    lists = [[" a ", "", None, "b"], ["x"], None]
    assert apply(spark, lists, lambda c: postings.source_list(c, F.lit("x")), "array<string>") == [["a", "b", "x"], ["x"], ["x"]]


def test_identity(spark):
    long = "Word  \n" * 200
    want = hashlib.md5(f"a b|c||{' '.join(long.lower().split())[:300]}".encode()).hexdigest()
    df = spark.createDataFrame([(" A B ", "C", None, long)], "t string, c string, l string, d string")
    assert df.select(text.canonical_id(F.col("t"), F.col("c"), F.col("l"), F.col("d"))).first()[0] == want
    key = df.select(text.cache_key(F.lit(" Python "), F.lit("India"), F.lit(None).cast("string"), F.lit("en"), F.lit(None).cast("string"))).first()[0]
    assert key == hashlib.sha256(b"python|india|in|en|").hexdigest()


def test_digits_of_any_script(spark):
    figures = {"₹८–१२ LPA": (8.0, 12.0), "₹٨-١٢ LPA": (8.0, 12.0), "₹８–１２ LPA": (8.0, 12.0), "INR १४,००,००० - २०,००,००० / year": (14.0, 20.0)}
    df = spark.createDataFrame([(k,) for k in figures], "t string")
    got = {r["t"]: (r["v"]["min"], r["v"]["max"]) for r in df.select("t", salary.salary_lpa(F.col("t")).alias("v")).collect()}
    assert got == figures
    ages = {"५ days ago": 5, "٢ weeks ago": 14, "３ months ago": 90, "४ hours ago": 0}
    df = spark.createDataFrame([(k,) for k in ages], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", recency.age_days(F.col("t")).alias("d")).collect()} == ages


def test_list_semantics(spark):
    df = spark.createDataFrame([(["b", None, "a", "b"], ["a", None, "c"]), (None, ["a"])], "x array<string>, y array<string>")
    x, y = F.col("x"), F.col("y")
    got = df.select(coverage.distinct_list(x), coverage.intersect_list(x, y), coverage.except_list(x, y), coverage.ordered_union(x, y), coverage.sorted_union(x, y)).collect()
    assert tuple(got[0]) == (["b", "a"], ["a"], ["b"], ["b", "a", "c"], ["a", "b", "c"])
    assert tuple(got[1]) == (None, None, None, None, ["a"])


GOOD_RESUME = (
    "Jane Doe - Software Engineer\nEmail: jane.doe@example.com\nEDUCATION: Bachelor of Technology in Information Technology\n"
    "EXPERIENCE: 2 years building backend data pipelines at Tech Labs\nSKILLS: Proficient in Python, SQL, Docker, FastAPI, and Git."
)
INVOICE = (
    "INVOICE #INV-2026-9042\nBilled To: Acme Corporation\nDate: 2026-10-05\nPayment Terms: Due Upon Receipt\n"
    "Total Balance: USD $4,250.00\nThank you for your business!"
)


def test_resume_gate(spark):
    pad = " lorem ipsum" * 10
    rows = [("good", GOOD_RESUME), ("invoice", INVOICE), ("short", "too short"), ("none", "education and skills" + pad),
            ("few", "education skills engineer Python" + pad), ("null", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: (r["accepted"], r["reason"]) for r in resumes.resume_gate(df).collect()}
    assert got == {
        "good": (True, None), "invoice": (False, "not_resume_structure"), "short": (False, "no_extractable_text"),
        "none": (False, "no_identifiers"), "few": (False, "too_few_skills"), "null": (False, "no_extractable_text"),
    }


def test_match_summary(spark):
    df = spark.createDataFrame([("I know Python, SQL and Docker",), ("nothing",)], "text string")
    a, b = resumes.match_summary(df).collect()
    assert a["matched_skills"] == ["Docker", "Python", "SQL"] and a["match_score_percentage"] == 2 * int(3 / 73 * 100)
    assert a["missing_skills"] == [n for n in SKILLS.names if n not in a["matched_skills"]][:8]
    assert b["match_score_percentage"] == 0 and b["missing_skills"] == list(SKILLS.names[:8])


def test_backfill(spark):
    now = dt.datetime(2026, 10, 9, 1, 0)
    rows = [("a", "q", "3 days ago", "x", dt.datetime(2026, 10, 7, 23, 0), None), ("b", None, "₹8 LPA", "₹8 LPA", None, None), ("c", "q", None, " ", None, 4)]
    df = conform_schema(spark.createDataFrame(rows, "job_id string, source_query string, salary_raw string, salary string, scraped_at timestamp_ntz, posted_days_ago int"))
    once = backfill(df, now)
    got = {r["job_id"]: (r["source_queries"], r["salary_raw"], r["salary"], r["posted_days_ago"]) for r in once.collect()}
    assert got == {"a": (["q"], None, None, 2), "b": (None, "₹8 LPA", "₹8 LPA", 0), "c": (["q"], None, None, 4)}
    assert sorted(map(str, backfill(once, now).collect())) == sorted(map(str, once.collect()))


def test_stringify_and_first_difference(spark):
    df = spark.createDataFrame([(1, None, ["a"])], "i int, s string, l array<string>")
    assert tuple(stringify(df).first()) == ("1", "", '["a"]')
    pairs = spark.createDataFrame([("tricon's", "tricon//'s"), ("same", "same"), ("ab", "abc"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(first_difference(F.col("a"), F.col("b"))).collect()] == [6, None, 2, 0]


@pytest.mark.parametrize("fn", [ROLES.regex])
def test_unknown_role(fn):
    with pytest.raises(ValueError):
        fn("chef")
