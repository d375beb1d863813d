"""The merge against each column's rule over all rows of an id, and its known cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skillgap.operators.merge import ARRIVAL, merge_postings, touch_existing
from skillgap.operators.prepare import prepare_batch
from skillgap.schema import POSTING, conform_schema

NOW = dt.datetime(2026, 10, 9, 12, 0, 0)
NAMES = [f.name for f in POSTING.fields]


def merged_row(rows):
    """What the rows of one id, in order, must become: each column's rule over the whole list."""
    if len(rows) == 1:
        return rows[0]
    column = lambda c: [r[c] for r in rows]
    known = lambda c: [v for v in column(c) if v is not None]
    said = lambda c: next((v for v in column(c) if v), None)
    out = {c: known(c)[-1] if known(c) else None for c in (
        "title", "company_name", "location", "via", "description", "schedule_type", "posted_at", "posted_days_ago",
        "via_platform", "source_gl")}
    out |= {"job_id": rows[0]["job_id"], "scraped_at": min(known("scraped_at"), default=None), "source_token": said("source_token")}
    out["is_snapshot"] = all(column("is_snapshot"))
    out["work_from_home"] = any(column("work_from_home"))
    out["skills_required"] = sorted({s for own in known("skills_required") for s in own})
    every = [q for r in rows for q in [*(r["source_queries"] or []), r["source_query"] or ""]]
    out["source_queries"] = list(dict.fromkeys(q.strip() for q in every if q.strip()))
    out["source_query"] = rows[0]["source_query"] or next(iter(out["source_queries"]), None)
    offers = [((o["title"] or o["link"] or "").strip().lower(), o) for own in known("apply_options") for o in own]
    out["apply_options"] = list({k: o for k, o in reversed(offers) if k}.values())
    out["apply_options"].sort(key=offers_place(offers))
    out["portal_count"] = max(1, len(out["apply_options"]))
    first_offer = out["apply_options"][0]["link"] if out["apply_options"] else rows[0]["apply_link"]
    out["apply_link"] = rows[0]["apply_link"] or first_offer
    pays = [r["salary_raw"] or r["salary"] for r in rows]
    paid = [i for i, p in enumerate(pays) if p and p.strip()]
    out["salary"] = out["salary_raw"] = pays[paid[0]] if paid else pays[-1]
    for c in ("salary_min_lpa", "salary_max_lpa"):
        out[c] = next((r[c] for r in rows[paid[0]:] if r[c] is not None), None) if paid else rows[-1][c]
    remote = out["work_from_home"] or "Remote" in column("location_type")
    out["location_type"] = "Remote" if remote else rows[0]["location_type"] or rows[1]["location_type"] or "On-site"
    return out


def offers_place(offers):
    """The order in which publishers first come."""
    places = {}
    for i, (key, _) in enumerate(offers):
        places.setdefault(key, i)
    return lambda o: places[(o["title"] or o["link"] or "").strip().lower()]


def random_row(rnd, job_id):
    maybe = lambda x, p=0.3: None if rnd.random() < p else x
    link = lambda: maybe(f"http://x/{rnd.randint(1, 4)}", 0.2)
    pay = rnd.choice([None, "", "  ", "₹8 LPA", "₹9 LPA", "₹300 an hour"])
    return {
        "job_id": job_id,
        "title": maybe(f"t{rnd.randint(1, 3)}"), "company_name": maybe(f"c{rnd.randint(1, 3)}"),
        "location": maybe(rnd.choice(["", "Pune"])), "via": maybe("v"), "description": maybe(rnd.choice(["", "d"])),
        "schedule_type": maybe("Full-time"), "work_from_home": rnd.random() < 0.1,
        "salary": rnd.choice([pay, None]), "apply_link": rnd.choice([None, "", "http://own"]),
        "posted_at": maybe("1 day ago"),
        "scraped_at": maybe(dt.datetime(2026, 1, 1) + dt.timedelta(days=rnd.randint(0, 9)), 0.1),
        "via_platform": maybe("p"), "salary_raw": rnd.choice([pay, None]),
        "location_type": rnd.choice([None, "", "On-site", "Hybrid", "On-site", "Remote"] if rnd.random() < 0.5 else ["On-site", None]),
        "skills_required": maybe([rnd.choice("abcd") for _ in range(rnd.randint(0, 3))]),
        "apply_options": maybe([
            {"title": rnd.choice([None, "", "LinkedIn", " linkedin ", "Indeed"]), "link": link()}
            for _ in range(rnd.randint(0, 3))
        ]),
        "portal_count": rnd.randint(1, 5),
        "salary_min_lpa": maybe(float(rnd.randint(1, 9)), 0.5), "salary_max_lpa": maybe(float(rnd.randint(10, 19)), 0.5),
        "source_query": rnd.choice([None, "", "q1", "q2 "]), "source_gl": maybe("in"),
        "is_snapshot": rnd.random() < 0.7, "source_token": rnd.choice([None, "k1", "k2"]),
        "source_queries": maybe([rnd.choice(["", " q1", "q2", "q3"]) for _ in range(rnd.randint(0, 3))]),
        "posted_days_ago": maybe(rnd.randint(0, 9)),
    }


def to_df(spark, rows, arrivals=None):
    schema = POSTING
    data = [tuple(r[n] for n in NAMES) for r in rows]
    if arrivals is None:
        return spark.createDataFrame(data, schema)
    from pyspark.sql import types as T

    wide = T.StructType([*schema.fields, T.StructField(ARRIVAL, T.LongType())])
    return spark.createDataFrame([(*d, a) for d, a in zip(data, arrivals)], wide)


def plain(row):
    return {n: ([o.asDict() for o in row[n]] if n == "apply_options" and row[n] is not None else row[n]) for n in NAMES}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_equals_the_rules(spark, seed):
    rnd = random.Random(seed)
    ids = [f"id{i:03d}" for i in range(200)]
    stored = [random_row(rnd, i) for i in ids if rnd.random() < 0.5]
    batch = [random_row(rnd, rnd.choice(ids[:150])) for _ in range(400)] + [
        random_row(rnd, "hot") for _ in range(300)
    ]
    in_order = {}
    for r in stored + batch:
        in_order.setdefault(r["job_id"], []).append(r)
    expected = {k: merged_row(rows) for k, rows in in_order.items()}
    shuffled = list(enumerate(batch))
    rnd.shuffle(shuffled)
    merged = merge_postings(
        to_df(spark, stored), to_df(spark, [r for _, r in shuffled], [i for i, _ in shuffled]).repartition(5)
    ).collect()
    assert len(merged) == len(expected)
    for row in merged:
        got, want = plain(row), expected[row["job_id"]]
        for n in NAMES:
            if n == "source_token":
                assert (got[n] or None) == (want[n] or None)
            else:
                assert got[n] == want[n], (row["job_id"], n, got[n], want[n])


def incoming(spark, *jobs, **options):
    fields = {"arrival": "int", "extensions": "array<string>"}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POSTING.fields)
    schema += "".join(f", {k} {v}" for k, v in fields.items())
    names = NAMES + list(fields)
    rows = [tuple({"arrival": i, **j}.get(n) for n in names) for i, j in enumerate(jobs)]
    return prepare_batch(spark.createDataFrame(rows, schema), NOW, **options)


def empty(spark):
    return spark.createDataFrame([], POSTING)


BASE = {"title": "Staff Backend Engineer", "company_name": "Nimbus", "location": "Pune", "description": "Python and DuckDB."}


def test_same_posting_under_two_tokens(spark):
    a = {**BASE, "source_token": "alpha", "source_query": "Backend", "apply_options": [("LinkedIn", "https://l/1")]}
    b = {**BASE, "source_token": "beta", "source_query": "Python", "apply_options": [("Indeed", "https://i/1")]}
    one = merge_postings(empty(spark), incoming(spark, a))
    two = merge_postings(one, incoming(spark, b))
    assert touch_existing(one, incoming(spark, b)).count() == 1
    (r,) = two.collect()
    assert r["source_queries"] == ["Backend", "Python"] and r["source_query"] == "Backend"
    assert r["portal_count"] == 2 and r["source_token"] == "alpha"
    assert r["skills_required"] == ["DuckDB", "Python"]


def test_options_keep_the_first_link_of_a_publisher(spark):
    a = {**BASE, "source_token": "1", "apply_options": [("LinkedIn", "l1"), ("Company Careers", "c1")]}
    b = {**BASE, "source_token": "2", "apply_options": [("LinkedIn", "other"), ("Indeed", "i"), ("Glassdoor", "g")]}
    (r,) = merge_postings(empty(spark), incoming(spark, a, b)).collect()
    assert [o["title"] for o in r["apply_options"]] == ["LinkedIn", "Company Careers", "Indeed", "Glassdoor"]
    assert r["apply_options"][0]["link"] == "l1" and r["portal_count"] == 4


def test_salary_is_kept_or_taken(spark):
    paid = {**BASE, "source_token": "1", "salary_raw": "₹30–45 LPA", "salary_min_lpa": 30.0, "salary_max_lpa": 45.0}
    unpaid = {**BASE, "source_token": "2"}
    for order in ([paid, unpaid], [unpaid, paid]):
        (r,) = merge_postings(empty(spark), incoming(spark, *order)).collect()
        assert (r["salary_raw"], r["salary_min_lpa"], r["salary_max_lpa"]) == ("₹30–45 LPA", 30.0, 45.0)


def test_live_over_snapshot_clears_the_flag(spark):
    snap = merge_postings(empty(spark), incoming(spark, {**BASE, "source_token": "s"}, is_snapshot=True))
    assert snap.first()["is_snapshot"] is True
    assert merge_postings(snap, incoming(spark, {**BASE, "source_token": "l"})).first()["is_snapshot"] is False


def test_same_id_takes_new_title_and_keeps_salary(spark):
    old = {**BASE, "job_id": "x", "salary": "INR 18,00,000 / year"}
    new = {**BASE, "job_id": "x", "title": "Principal", "salary": "INR 20,00,000 / year"}
    (r,) = merge_postings(merge_postings(empty(spark), incoming(spark, old)), incoming(spark, new)).collect()
    assert (r["title"], r["salary"], r["salary_min_lpa"]) == ("Principal", "INR 18,00,000 / year", 18.0)


def test_remote_by_tag_and_place(spark):
    jobs = [
        {**BASE, "title": "a", "location": "India", "extensions": ["Full-time", "Work from home"]},
        {**BASE, "title": "b", "location": "Anywhere"},
        {**BASE, "title": "c", "location": "Remote, India"},
    ]
    for r in incoming(spark, *jobs).collect():
        assert r["location_type"] == "Remote" and r["work_from_home"] is True


def test_merging_a_merged_batch_again_changes_nothing(spark):
    rnd = random.Random(9)
    rows = [random_row(rnd, f"i{rnd.randint(1, 30)}") for _ in range(90)]
    rows = [{**r, "source_token": r["source_token"] or "k"} for r in rows]
    batch = to_df(spark, rows, range(len(rows)))
    once = merge_postings(merge_postings(empty(spark), batch), batch)
    again = merge_postings(once, batch)
    pick = [c for c in NAMES]
    key = lambda df: sorted(map(str, (plain(r) for r in df.select(*pick).collect())))
    assert key(once) == key(again)


def test_conform_adds_columns_once(spark):
    legacy = spark.createDataFrame([("legacy", "ETL", "P", "C", "Python ETL")], "job_id string, title string, company_name string, location string, source_query string")
    wide = conform_schema(legacy)
    assert wide.columns == NAMES and conform_schema(wide).columns == NAMES
    r = wide.first()
    assert r["portal_count"] == 1 and r["is_snapshot"] is False and r["source_queries"] is None


def test_merge_plan_stays_small(spark):
    """With broadcasting off, the whole merge has at most twelve exchanges, those of its staged parts included."""
    import skillgap.operators.merge as M

    plans = []
    real = M.materialize

    def noted(df, name="stage", **more):
        plans.append(df)
        return real(df, name, **more)

    rnd = random.Random(5)
    stored = to_df(spark, [random_row(rnd, f"i{n}") for n in range(40)])
    batch = to_df(spark, [random_row(rnd, f"i{n % 50}") for n in range(90)], range(90))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    M.materialize = noted
    try:
        plans.append(merge_postings(stored, batch))
        count = sum(str(p._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") for p in plans)
    finally:
        M.materialize = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert count <= 12


def test_identity_prefix_of_long_texts_is_that_of_the_whole(spark):
    import skillgap.functions.text as X

    blank, odd = " \t\u3000\n" * 600, "ΑΣ" * 900
    texts = [None, "", "short ", blank + "A b" * 400, "A\u00a0 b " * 900, odd, "x " * 150 + blank + "y" * 400, "ab" * 499 + "Σ" + " tail" * 9, "İ" * 1200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.substring(X.normalize_text(F.col("t")), 1, 300)
    assert all(a == b for a, b in df.select(X.identity_prefix(F.col("t")), whole).collect())
    plan = df.select(X.identity_prefix(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert f"{X._LEADING}" in plan


def test_a_merge_stages_a_batch_once(spark, tmp_path):
    """Texts of the batch are written once, and rows that are merged are not written again before they are."""
    import skillgap.operators.merge as M

    staged, real = [], M.materialize
    M.materialize = lambda df, name="stage", **how: staged.append((name, "description" in df.columns)) or real(df, name, **how)
    try:
        store = merge_postings(empty(spark), incoming(spark, BASE)).localCheckpoint()
        staged.clear()
        merge_postings(store, incoming(spark, BASE, {**BASE, "description": "another"})).collect()
    finally:
        M.materialize = real
    assert sorted(n for n, wide in staged if wide) == ["merge-batch", "merge-ids", "touched"]
