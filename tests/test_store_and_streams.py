"""Files, the stored table, streams, exports, and the log operators."""

import datetime as dt
import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skillgap.operators import browse, cache, console, market
from skillgap.operators.diagnostics import near_duplicates, redact, scan_literals
from skillgap.operators.fit import job_fit
from skillgap.operators.prepare import normalize_postings
from skillgap.operators.resumes import candidate_skills
from skillgap.operators.skew import salted_lookup
from skillgap.plans.ingest import ingest, refresh_snapshots
from skillgap.plans.reports import unlock_report
from skillgap.schema import POSTING, conform_schema
from skillgap.sources.export import export_csv, export_json, export_rows
from skillgap.sources.scratch import scratch_root, scratch_scope
from skillgap.sources.snapshots import read_snapshots, rejected_files
from skillgap.sources.store import Store, read_store, write_store
from skillgap.streaming.rates import offered_counts
from skillgap.streaming.upsert import stream_upsert

NOW = dt.datetime(2026, 10, 9, 12, 0, 0)


def posting(n, **more):
    return {"job_id": f"tok{n}", "title": f"Engineer {n % 7}", "company_name": "Acme", "location": "Pune",
            "description": "Python and SQL", "extensions": ["3 days ago", "₹8–12 LPA"],
            "apply_options": [{"title": f"Portal {n % 3}", "link": f"http://p/{n}"}], **more}


def write_file(folder, name, jobs, captured="2026-10-08T18:40:32+00:00", key="jobs", q="python"):
    os.makedirs(folder, exist_ok=True)
    body = {"captured_at": captured, "query_params": {"q": q, "gl": "in"}, key: jobs}
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)


def empty(spark):
    return spark.createDataFrame([], POSTING)


def state(df):
    cols = [c for c in df.columns]
    return sorted(json.dumps([r[c] for c in cols], default=str) for r in df.select(*cols).collect())


def test_snapshots_skip_a_bad_file_and_keep_order(spark, tmp_path):
    folder = str(tmp_path / "snap")
    write_file(folder, "b.json", [posting(1, title="T1"), posting(2, title="T1")], q="second")
    write_file(folder, "a.json", [posting(3, title="T1")], key="jobs_results", q="first")
    write_file(folder, "none.json", [])
    with open(os.path.join(folder, "bad.json"), "w") as f:
        f.write('{"captured_at": "x", "jobs": [')
    raw = read_snapshots(spark, folder)
    assert raw.count() == 3
    (r,) = ingest(empty(spark), raw, NOW).collect()
    assert r["source_queries"] == ["first", "second"] and r["source_token"] == "tok3"
    assert r["scraped_at"] == dt.datetime(2026, 10, 8, 18, 40, 32) and r["is_snapshot"] is True
    assert (r["salary_min_lpa"], r["posted_days_ago"], r["portal_count"]) == (8.0, 3, 3)


def test_refresh_is_idempotent_and_follows_newer_files(spark, tmp_path):
    folder = str(tmp_path / "snap")
    write_file(folder, "a.json", [posting(1)])
    disk = read_snapshots(spark, folder)
    once = refresh_snapshots(empty(spark), disk, NOW)
    assert once.count() == 1
    assert state(refresh_snapshots(once, disk, NOW)) == state(once)
    newer = str(tmp_path / "newer")
    write_file(newer, "a.json", [posting(2), posting(3)], captured="2026-10-20T00:00:00Z")
    assert refresh_snapshots(once, read_snapshots(spark, newer), NOW).count() == 2
    assert refresh_snapshots(once, disk, NOW, force=True).count() == 1


def batch_of(spark, tmp_path, numbers):
    folder = str(tmp_path / f"snap-{min(numbers)}")
    write_file(folder, "a.json", [posting(n) for n in numbers])
    return ingest(empty(spark), read_snapshots(spark, folder), NOW).withColumn("arrival", F.lit(1))


def test_store_merges_each_batch_of_a_stream_once(spark, tmp_path):
    batch = batch_of(spark, tmp_path, range(14))
    store = Store(spark, str(tmp_path / "store"))
    assert store.merge(batch, "s", 0) == 7
    assert store.merge(batch, "s", 0) == 0  # the same batch again
    assert read_store(spark, store.path).count() == 7
    assert store.merge(batch.where(F.col("title") == "Engineer 3"), "s", 1) == 1
    assert read_store(spark, store.path).count() == 7
    store.overwrite(batch.limit(0))
    assert read_store(spark, store.path).count() == 0
    # Batch 0 of another stream, and batches without one, are new.
    assert store.merge(batch.where(F.col("title") == "Engineer 2"), "t", 0) == 1
    assert store.merge(batch.where(F.col("title") == "Engineer 4")) == 1
    assert read_store(spark, store.path).count() == 2


def test_store_keeps_few_versions_and_one_writer(spark, tmp_path):
    batch = batch_of(spark, tmp_path, range(3))
    store = write_store(batch, str(tmp_path / "store"))
    other = Store(spark, store.path)
    for _ in range(5):
        store.overwrite(batch)
    assert len(os.listdir(tmp_path / "store" / "data")) == 3
    with pytest.raises(RuntimeError):
        other.overwrite(batch)
    assert len(os.listdir(tmp_path / "store" / "data")) == 3


def test_store_refuses_a_pointer_it_cannot_read(spark, tmp_path):
    store = write_store(batch_of(spark, tmp_path, range(3)), str(tmp_path / "store"))
    (tmp_path / "store" / "pointer" / "000000000002.json").write_text("{")
    with pytest.raises(ValueError):
        Store(spark, store.path)


def test_ingest_leaves_nothing_behind(spark, tmp_path):
    folder = str(tmp_path / "snap")
    write_file(folder, "a.json", [posting(n) for n in range(9)])
    held = lambda: set(os.listdir(scratch_root(spark)))
    batch = batch_of(spark, tmp_path, range(20, 24)).cache()
    batch.count()
    before = held()
    with scratch_scope(spark):
        assert ingest(empty(spark), read_snapshots(spark, folder), NOW).count() == 7
        assert held() > before
    assert held() == before
    store = Store(spark, str(tmp_path / "store"))
    assert store.merge(batch, "s", 0) == 4 and held() == before
    stream_upsert(spark, folder, store.path, str(tmp_path / "check"), NOW).awaitTermination()
    assert held() == before and read_store(spark, store.path).count() == 7


def test_stream_equals_batch(spark, tmp_path):
    folder, rnd = str(tmp_path / "in"), random.Random(4)
    for i in range(4):
        write_file(folder, f"f{i}.json", [posting(rnd.randint(0, 40)) for _ in range(6)], q=f"q{i}")
        os.utime(os.path.join(folder, f"f{i}.json"), (1_700_000_000 + i * 100,) * 2)
    target, checkpoint = str(tmp_path / "store"), str(tmp_path / "check")
    stream_upsert(spark, folder, target, checkpoint, NOW, files_per_batch=1).awaitTermination()
    assert state(read_store(spark, target)) == state(ingest(empty(spark), read_snapshots(spark, folder), NOW))
    # Nothing new: another run changes nothing.
    version = Store(spark, target).version
    stream_upsert(spark, folder, target, checkpoint, NOW).awaitTermination()
    assert Store(spark, target).version == version == 4
    # A fresh checkpoint is another stream; its first batch is not taken for one that is done.
    Store(spark, target).overwrite(empty(spark))
    stream_upsert(spark, folder, target, str(tmp_path / "fresh"), NOW).awaitTermination()
    assert read_store(spark, target).count() == ingest(empty(spark), read_snapshots(spark, folder), NOW).count()


FIVE = [
    ("1", "Applied AI Engineer", "KiteMetrics", "Bengaluru", "via LinkedIn", "Python pipelines", True, "INR 18", dt.datetime(2026, 10, 1)),
    ("2", "Data Engineer", "Synthetix", "Remote, India", "via Greenhouse", "DuckDB, hybrid team", False, "", dt.datetime(2026, 10, 2)),
    ("3", "Backend Engineer", "Veritas", "Gurgaon", "via Lever", "FastAPI", False, None, dt.datetime(2026, 10, 3)),
    ("4", "Full-Stack Engineer", "Aura", "Hyderabad (Hybrid)", "via Foo", "Next 100%", False, "x", None),
    ("5", "ML Engineer", "QuantEdge", None, None, r"back\slash", False, "y", dt.datetime(2026, 10, 5)),
]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "job_id string, title string, company_name string, location string, via string, description string, work_from_home boolean, salary string, scraped_at timestamp_ntz").withColumns(
        {"skills_required": F.array(F.lit("Python"), F.lit("SQL")), "is_snapshot": F.lit(True), "source_queries": F.array(F.lit("q"))}
    )


def ids(df):
    return [r["job_id"] for r in df.collect()]


def test_browse_filters(five):
    assert ids(browse.browse(five)) == ["5", "3", "2", "1", "4"]
    assert ids(browse.browse(five, sort_by="company")) == ["4", "1", "5", "2", "3"]
    assert ids(browse.browse(five, location_type="Remote")) == ["2", "1"]
    assert ids(browse.browse(five, location_type="Hybrid")) == ["2", "4"]
    assert ids(browse.browse(five, location_type="On-site")) == ["3"]
    assert ids(browse.browse(five, text="ENGINEER", has_salary=True)) == ["5", "1", "4"]
    assert ids(browse.browse(five, text="k\\s")) == ["5"]
    assert ids(browse.browse(five, text="'; DROP TABLE jobs; --")) == []
    assert ids(browse.browse(five, from_date="2026-10-02", to_date="2026-10-03")) == ["3", "2"]
    with pytest.raises(ValueError):
        browse.browse(five, from_date="2026-10-03", to_date="2026-10-02")
    pages = [ids(browse.browse(five.withColumn("scraped_at", F.lit(None).cast("timestamp_ntz")), limit=2, offset=o)) for o in (0, 2, 4)]
    assert sum(pages, []) == ["1", "2", "3", "4", "5"]


def test_counters_and_platforms(five):
    assert tuple(market.corpus_counters(five).first()) == (5, 2, 3, 3)
    assert tuple(market.corpus_counters(five.limit(0)).first()) == (0, 0, 0, 0)
    assert [r["platform"] for r in market.top_platforms(five).collect()] == ["Direct Portal", "Foo", "Greenhouse", "Lever", "LinkedIn"]
    empty_stats = market.corpus_stats(five.limit(0)).first()
    assert (empty_stats["jobs"], empty_stats["snapshot_share"], empty_stats["distinct_queries"]) == (0, 0.0, 0)
    counts = {r["skill"]: r["count"] for r in market.mention_counts(five).collect()}
    assert counts == {"Python": 1, "FastAPI": 1, "DuckDB": 1, "Next.js": 1}


def test_console_guard(spark, five):
    for text in ("DELETE FROM jobs", "SELECT 1; DROP TABLE x", "WITH a AS (SELECT 1) SELECT * FROM a", "select * from jobs -- set"):
        with pytest.raises(ValueError):
            console.check_readonly(text)
    many = spark.range(200).select(F.col("id"), F.lit(None).cast("string").alias("hole"))
    spark.range(3).createOrReplaceTempView("jobs")
    read = lambda text, **more: console.readonly_sql(spark, {"jobs": many}, text, **more)
    out = read("SELECT * FROM jobs LIMIT 1000;")
    assert out.count() == 50 and out.first()["hole"] == ""
    assert read("SELECT * FROM jobs", cap=None).count() == 200
    # The session's own view is untouched.
    assert spark.table("jobs").count() == 3
    assert read("SELECT id FROM jobs j WHERE id IN (SELECT max(id) FROM jobs) ORDER BY id").first()["id"] == "199"
    for text in (
        "SELECT TRANSFORM(id) USING 'id -un' AS (x) FROM jobs", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM other",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.name') FROM jobs", "SELECT id FROM jobs WHERE EXISTS (SELECT 1 FROM text.`/etc/hostname`)",
        "SELECT (SELECT reflect('java.lang.System', 'getProperty', 'user.name')) FROM jobs", "SELECT * FROM range(5)",
    ):
        with pytest.raises(ValueError):
            read(text)
    spark.catalog.dropTempView("jobs")


def test_exports(spark, five, tmp_path):
    export_csv(export_rows(five, limit=2), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert ids(back.orderBy(F.desc("scraped_at"))) == ["5", "3"] and "skills_required" in back.columns
    export_csv(five.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).first()["message"] == "No records found matching filters."
    export_json(five, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    assert export_rows(five, limit=None).count() == 5
    with pytest.raises(ValueError):
        export_rows(five, limit=0)


def test_cache(spark):
    at = lambda h: NOW - dt.timedelta(hours=h)
    stored = spark.createDataFrame([("a", "q", "old", at(30)), ("b", "q", "new", at(2))], "cache_key string, query string, response_json string, fetched_at timestamp_ntz")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "b")], "request_id int, cache_key string")
    got = {r["request_id"]: r["status"] for r in cache.cache_lookup(asked, stored, dt.timedelta(hours=24), NOW).collect()}
    assert got == {1: "stale", 2: "fresh", 3: "miss", 4: "fresh"}
    put = cache.cache_put(stored, spark.createDataFrame([("a", "other", "newer")], "cache_key string, query string, response_json string"), NOW)
    assert {tuple(r) for r in put.collect()} == {("a", "q", "newer", NOW), ("b", "q", "new", at(2))}


def test_offered_counts_equal_a_replay(spark):
    rnd, rows = random.Random(1), []
    for e in range(1500):
        user = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)
        rows.append((rnd.randint(0, 3000) if user else rnd.randint(0, 400), e, user))
    df = spark.createDataFrame([(e, u, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t)) for t, e, u in rows], "e int, u int, ts timestamp_ntz")
    times, want = defaultdict(list), {}
    for t, e, u in sorted(rows):
        want[e] = sum(t - x < 60 for x in times[u])
        times[u].append(t)
    assert {r["e"]: r["offered"] for r in offered_counts(df, "u", "ts", "e").collect()} == want


def test_near_duplicates_give_one_row_per_member(spark):
    rows = [(f"j{i:03d}", "T", "C", "L", f"text {i % 4}") for i in range(300)] + [("solo", "U", "C", "L", "x")]
    df = spark.createDataFrame(rows, "job_id string, title string, company_name string, location string, description string")
    found = near_duplicates(df).collect()
    assert len(found) == 299 and {r["first_id"] for r in found} == {"j000"}
    assert {r["differs_at"] for r in found} == {5, None}


def test_literals(spark):
    df = spark.createDataFrame([("a", "has api_key=SECRET1"), ("b", "fine")], "name string, text string")
    got = {r["name"]: (r["has_literal"], r["has_prefix"], r["clean"]) for r in scan_literals(df, {"literal": "api_key", "prefix": "SECRET", "unset": ""}).collect()}
    assert got == {"a": (True, True, False), "b": (False, False, True)}
    assert redact(df, {"k": "SECRET1"}).first()["text"] == "has api_key=[REDACTED]"


def test_no_hidden_ceilings(spark):
    skills = F.array(*[F.lit(x) for x in ("Python", "SQL", "Git")])
    many = spark.range(2500).select(F.format_string("%05d", "id").alias("job_id"), F.lit("t").alias("title"), F.lit("c").alias("company_name"), skills.alias("skills_required"))
    assert job_fit(many, ["SQL"], limit=2000).count() == 2000 and job_fit(many, ["SQL"], limit=None).count() == 2500
    long = "x " * 30_000 + "Python and SQL"
    df = spark.createDataFrame([("a", long, None), ("b", None, ["sql"] * 150)], "candidate_id string, resume_text string, skills array<string>")
    assert {r["candidate_id"]: r["skills"] for r in candidate_skills(df).collect()} == {"a": ["Python", "SQL"], "b": ["SQL"]}
    assert {r["status"] for r in candidate_skills(df, max_text=50_000, max_skills=100).collect()} == {"text_too_long", "too_many_skills"}


def test_cap_holds_for_each_fetch(spark, tmp_path):
    folder = str(tmp_path / "fetches")
    for q in ("one", "two"):
        write_file(folder, f"{q}.json", [posting(n) for n in range(9)], q=q)
    rows = normalize_postings(read_snapshots(spark, folder), NOW, cap=4).groupBy("source_query").count().collect()
    assert {r["source_query"]: r["count"] for r in rows} == {"one": 4, "two": 4}


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    folder = str(tmp_path / "land")
    write_file(f"{folder}/a", "x.json", [posting(1, title="T1")], q="first")
    write_file(f"{folder}/b", "x.json", [posting(2, title="T1")], q="second")
    with open(f"{folder}/b/bad.json", "w") as f:
        f.write("{")
    raw = read_snapshots(spark, f"{folder}/*")
    assert raw.select("arrival").distinct().count() == 2
    assert [r["file_name"] for r in rejected_files(spark, f"{folder}/b").collect()] == ["bad.json"]


def test_unlock_report_reads_the_corpus_twice(spark, tmp_path):
    skills = [["Python", "SQL", "Git"], ["Python", "SQL", "AWS"], ["SQL", "Excel", "Tableau"]]
    rows = [(f"j{i}", f"Engineer {i}", "c", skills[i % 3], ["q"]) for i in range(30)]
    spark.createDataFrame(rows, "job_id string, title string, company_name string, skills_required array<string>, source_queries array<string>").write.parquet(str(tmp_path / "jobs"))
    df = spark.read.parquet(str(tmp_path / "jobs"))
    with scratch_scope(spark):
        report = unlock_report(df, ["Python", "SQL"])
        parts = [report.baseline, report.salary_benchmark, report.unlocks, report.all_unlocks_count, report.path, report.projected, report.corpus]
        scans = [str(p._jdf.queryExecution().optimizedPlan()) for p in parts]
        assert sum("jobs" in str(f) for p in parts for f in p.inputFiles()) == 1 * len(df.inputFiles())
        assert report.baseline.first()["eligible_jobs"] == 30 and len(scans) == 7


@pytest.mark.parametrize("how,rows", [("inner", 3000), ("left", 4000), ("left_semi", 3000)])
def test_salted_lookup_keeps_every_row_once(spark, how, rows):
    hot = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 4 < 3, "hot").otherwise("cold").alias("k"))
    one = spark.createDataFrame([("hot", 1)], "k string, v int")
    got = salted_lookup(hot, one, ["k"], ["id"], how)
    assert got.count() == rows and got.select("id").distinct().count() == rows


def test_conform_reads_json_options(spark):
    df = spark.createDataFrame([("a", '[{"title": "L", "link": "x"}]')], "job_id string, apply_options string")
    assert conform_schema(df).first()["apply_options"][0]["title"] == "L"


def test_small_batch_and_store_are_the_whole_table(spark):
    from workload.ingest_queries import prepared, store_and_small_batch
    from workload.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    first, batch = (df.count() for df in store_and_small_batch(spark, sf))
    assert first + batch == spark.read.parquet(f"{sf}/documents.parquet").count() and 0 < batch < first
    found = QUERIES["merge_small_batch"](spark, sf).collect()
    assert sorted(r["job_id"] for r in found) == sorted(r["job_id"] for r in prepared(spark, sf).select("job_id").distinct().collect())
    assert all(r["stored"] or r["arrived"] for r in found) and len(found[0]) == 28


def test_a_compressed_export_holds_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\n\u00e9", None), (2, None, ["x", "y"])], "id int, text string, tags array<string>")
    export_json(rows, str(tmp_path / "json"), compression="gzip")
    names = [f.name for f in (tmp_path / "json").iterdir() if f.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    back = spark.read.schema(rows.schema).json(str(tmp_path / "json"))
    assert sorted(back.collect()) == sorted(rows.collect())
