"""Small batches on a large store, figures kept from changes, pages by key, answers as of a time, many resumes, near titles."""

import datetime as dt
import glob
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from skillgap.catalog import SkillCatalog
from skillgap.operators import browse, cache, kept, market
from skillgap.operators.diagnostics import near_titles
from skillgap.operators.merge import merge_parts, merge_postings, sides, touch_existing
from skillgap.operators.resumes import match_resume, match_resumes
from skillgap.schema import POSTING, conform_schema
from skillgap.sources.scratch import scratch_path, scratch_root, scratch_scope
from skillgap.sources.store import PAGE_ROWS, Store, read_store, write_store

NAMES = [f.name for f in POSTING.fields]


def postings(spark, ids, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in ids:
        rows.append({
            "job_id": f"id{i:07d}", "title": f"Engineer {rnd.randint(1, 9)}", "company_name": rnd.choice(["Acme", "Beta", None, f"c{rnd.randint(1, 30)}"]),
            "location": rnd.choice(["Pune", "Remote, India", None]), "via": rnd.choice(["via LinkedIn", "Lever", None, ""]), "description": "python " * rnd.randint(1, 30),
            "work_from_home": rnd.random() < 0.2, "salary": rnd.choice([None, "", "₹8 LPA"]), "salary_raw": rnd.choice([None, "₹8 LPA"]),
            "scraped_at": rnd.choice([None, dt.datetime(2026, 1, 1) + dt.timedelta(hours=rnd.randint(0, 900))]), "via_platform": rnd.choice([None, "Site 1", "Site 2"]),
            "location_type": rnd.choice(["On-site", "Hybrid", None]), "skills_required": rnd.sample(["a", "b", "c", "d"], rnd.randint(0, 3)),
            "source_queries": rnd.choice([None, ["q1"], ["q1", "q2", f"q{rnd.randint(3, 9)}"]]), "is_snapshot": rnd.random() < 0.5,
        })
    full = [[r.get(n) for n in NAMES] for r in rows]
    return spark.createDataFrame(full, POSTING)


def arriving(df):
    return df.withColumn("arrival", F.monotonically_increasing_id())


def scanned(df, metric="numOutputRows"):
    """Rows that came out of the files when a frame was computed, or how many files there were."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()

    def rows(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return rows(node.plan())
        if name == "FileSourceScanExec":
            return node.metrics().get(metric).get().value()
        kids = node.children()
        return sum(rows(kids.apply(i)) for i in range(kids.size()))

    return rows(plan)


def test_a_small_batch_reads_and_writes_few_files(spark, tmp_path):
    store = write_store(postings(spark, range(6000)), str(tmp_path / "store"), buckets=96)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(str(tmp_path / "store" / "data" / "*" / "*" / "*.parquet"))}
    before = files()
    assert len(before) >= 96
    batch = arriving(postings(spark, [*range(0, 6000, 600), *range(9000, 9010)], seed=2)).cache()
    whole = merge_postings(store.read(), batch)
    want = sorted(map(str, whole.select(*NAMES).collect()))
    assert store.merge(batch) == 20
    after = files()
    written = set(after) - set(before)
    assert len(written) <= 20 and all(after[f] == before[f] for f in before)
    assert sorted(map(str, read_store(spark, store.path).select(*NAMES).collect())) == want
    again = Store(spark, store.path)
    assert again.buckets == 96 and len(again.find(["id0000600", "id0009001", "none"]).inputFiles()) <= 3
    assert {r["job_id"] for r in again.find(["id0000600", "id0009001", "none"]).collect()} == {"id0000600", "id0009001"}


def test_files_of_forgotten_versions_go_and_others_stay(spark, tmp_path):
    store = write_store(postings(spark, range(400)), str(tmp_path / "store"), buckets=32)
    first = {os.path.basename(d) for d in glob.glob(str(tmp_path / "store" / "data" / "*"))}
    for n in range(4):
        store.merge(arriving(postings(spark, [n, 1000 + n], seed=n)))
    # Buckets that no batch touched still lie where the first commit put them.
    folders = {f.split("/")[1] for f in store.folders.values()}
    assert first <= folders and len(folders) > 2
    assert {os.path.basename(d) for d in glob.glob(str(tmp_path / "store" / "data" / "*"))} >= folders
    assert read_store(spark, store.path).count() == 404
    store.overwrite(postings(spark, range(3)))
    for _ in range(3):
        store.overwrite(postings(spark, range(3)))
    assert read_store(spark, store.path).count() == 3
    assert not first & {os.path.basename(d) for d in glob.glob(str(tmp_path / "store" / "data" / "*"))}


def test_a_pointer_is_never_overwritten(spark, tmp_path):
    store = write_store(postings(spark, range(9)), str(tmp_path / "store"))
    other = Store(spark, store.path)
    # Both get past the check; the file itself decides.
    other._check_alone = lambda: None
    store.merge(arriving(postings(spark, [1])))
    with pytest.raises(RuntimeError):
        other.merge(arriving(postings(spark, [2])))
    assert Store(spark, store.path).version == 2


def test_touched_rows_are_found_by_pages(spark, tmp_path):
    """One id in a thousand: less than a tenth of the stored rows is read."""
    n = 20_000
    store = write_store(postings(spark, range(n)), str(tmp_path / "store"), buckets=1)
    rnd = random.Random(3)
    ids = [f"id{i:07d}" for i in rnd.sample(range(n), n // 1000)]
    from skillgap.operators.merge import _values_in_files, named_ids

    with _values_in_files(spark, len(ids)):
        touched = named_ids(store.read(), ids)[0]
        read = scanned(touched)
    assert len(ids) <= read <= 1.2 * PAGE_ROWS * len(ids) and read < n / 10
    batch = arriving(store.read().where(F.col("job_id").isin(ids)))
    assert {r["job_id"] for r in touch_existing(store.read(), batch).collect()} == set(ids)


def test_thousands_of_ids_are_named_in_a_filter(spark, tmp_path):
    """As many as may be named; one chain of them went deeper than a task's stack."""
    store = write_store(postings(spark, range(12_000)), str(tmp_path / "store"), buckets=2)
    batch = arriving(postings(spark, range(1, 20_000, 2), seed=2))
    dealt = sides(store.read(), batch)
    assert dealt.ids == 10_000 and {r["job_id"] for r in dealt.touched.select("job_id").collect()} == {f"id{i:07d}" for i in range(1, 12_000, 2)}
    assert {r["job_id"] for r in dealt.untouched.select("job_id").collect()} == {f"id{i:07d}" for i in range(0, 12_000, 2)}


@pytest.mark.parametrize("few", [0, 10_000])
def test_sides_are_the_same_either_way(spark, few):
    store = postings(spark, range(300)).unionByName(postings(spark, [1]).withColumn("job_id", F.lit(None).cast("string")))
    path = scratch_path(spark, "plain")
    store.write.parquet(path)
    stored = spark.read.schema(POSTING).parquet(path)
    batch = arriving(postings(spark, range(250, 400)).unionByName(postings(spark, [7]).withColumn("job_id", F.lit(None).cast("string"))))
    dealt = sides(stored, batch, few)
    assert {r["job_id"] for r in dealt.touched.collect()} == {f"id{i:07d}" for i in range(250, 300)}
    assert dealt.untouched.count() == 251 and dealt.ids == 151
    if few == 0:
        # Read once: what follows reads the rows that were dealt out.
        assert not any(path in f for side in (dealt.touched, dealt.untouched) for f in side.inputFiles())


def figures(df):
    rows = lambda x: sorted(map(str, x.collect()))
    corpus = market.corpus_stats(df).drop("sample_note")
    return {
        "counters": rows(market.corpus_counters(df)), "skills": rows(market.top_skills(df)), "companies": rows(market.top_companies(df)),
        "platforms": rows(market.top_platforms(df)), "sites": rows(market.platform_disclosure(df)), "corpus": rows(corpus),
        "places": rows(market.arrangement_share(df).select("location_type", "total_jobs")),
    }


def kept_figures(counts):
    rows = lambda x: sorted(map(str, x.collect()))
    return {
        "counters": rows(kept.kept_counters(counts)), "skills": rows(kept.kept_top_skills(counts)), "companies": rows(kept.kept_top_companies(counts)),
        "platforms": rows(kept.kept_top_platforms(counts)), "sites": rows(kept.kept_platform_disclosure(counts)), "corpus": rows(kept.kept_corpus(counts)),
        "places": rows(kept.kept_arrangements(counts)),
    }


def test_kept_figures_equal_a_recount_after_every_merge(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=8, keep=True)
    assert kept_figures(store.counts()) == figures(store.read())
    for n, ids in enumerate([range(200), range(150, 260), [0, 3, 999]]):
        store.merge(arriving(postings(spark, ids, seed=n)))
        store = Store(spark, store.path)
        assert store.keep and not any("/data/" in f for f in store.counts().inputFiles())
        assert kept_figures(store.counts()) == figures(store.read())
    # The whole table replaced by less of it.
    store.overwrite(store.read().where("job_id < 'id0000100'"))
    assert kept_figures(Store(spark, store.path).counts()) == figures(store.read())
    with pytest.raises(ValueError):
        write_store(postings(spark, range(3)), str(tmp_path / "plain")).counts()


def test_parts_of_a_merge_add_up(spark):
    store, batch = conform_schema(postings(spark, range(100))), arriving(postings(spark, range(90, 120), seed=5))
    parts = merge_parts(store, batch)
    assert parts.untouched.count() == 90 and parts.before.count() == 10 and parts.after.count() == 30


def test_scopes_belong_to_their_thread(spark):
    staged, opened, done = [], threading.Event(), threading.Event()

    def stream():
        with scratch_scope(spark):
            opened.set()
            done.wait(60)

    thread = threading.Thread(target=stream)
    thread.start()
    opened.wait(60)
    path = scratch_path(spark, "mine")
    spark.range(3).write.parquet(path)
    staged.append(path)
    done.set()
    thread.join()
    assert spark.read.parquet(path).count() == 3
    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        spark.range(3).write.parquet(inner)
    assert not os.path.exists(inner) and os.path.exists(path) and path.startswith(scratch_root(spark))


def test_pages_by_key_equal_pages_by_offset(spark, tmp_path):
    jobs = conform_schema(postings(spark, range(1500)))
    pages = browse.Pages(spark, str(tmp_path / "pages"))
    pages.write(jobs)
    whole = [(r["scraped_at"], r["job_id"]) for r in browse.browse(jobs, limit=None).collect()]
    assert any(at is None for at, _ in whole)
    last, seen = None, []
    while True:
        found = [(r["scraped_at"], r["job_id"]) for r in pages.page(137, last).collect()]
        seen += found
        if len(found) < 137:
            break
        last = found[-1]
    assert seen == whole
    chosen = [r["job_id"] for r in pages.page(5, whole[40], company="acme").collect()]
    assert chosen == [r["job_id"] for r in browse.browse(jobs, company="acme", limit=None).where(browse.after_row(*whole[40])).collect()][:5]
    browse.Pages(spark, str(tmp_path / "none")).write(jobs.limit(0))
    assert browse.Pages(spark, str(tmp_path / "none")).page(5).count() == 0
    # A page deep in the table reads the days it shows.
    deep = pages.page(10, whole[700])
    assert 0 < scanned(deep, "numFiles") <= 4 * 2 < len(glob.glob(str(tmp_path / "pages" / "*" / "*.parquet"))) / 3


def test_answers_as_of_the_request(spark):
    rnd = random.Random(8)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 6000))
    key = lambda: rnd.choice(["hot", "hot", "hot", f"k{rnd.randint(0, 20)}", None])
    puts = [(key(), f"r{i}", rnd.choice([at(), at(), at(), None]), i) for i in range(600)]
    asked = [(i, key(), rnd.choice([at()] * 20 + [None]), "extra") for i in range(900)]
    ttl = dt.timedelta(hours=3)
    p = spark.createDataFrame(puts, "cache_key string, response_json string, fetched_at timestamp_ntz, n int").repartition(5)
    q = spark.createDataFrame(asked, "request_id int, cache_key string, requested_at timestamp_ntz, put string").repartition(3)
    want = []
    for i, k, t, _ in asked:
        own = [(f, n, r) for kk, r, f, n in puts if k is not None and t is not None and kk == k and f is not None and f <= t]
        f, _, r = max(own, default=(None, None, None))
        want.append((i, r, "miss" if f is None else "fresh" if f >= t - ttl else "stale"))
    for slot in (dt.timedelta(minutes=37), dt.timedelta(days=30)):
        found = cache.cache_lookup_asof(q, p, ttl, tie=["n"], slot=slot)
        assert sorted((r["request_id"], r["response_json"], r["status"]) for r in found.collect()) == sorted(want)
        assert found.columns == [*q.columns, "response_json", "fetched_at", "status"]
    assert cache.cache_lookup_asof(q.limit(0), p, ttl).count() == 0
    assert {r["status"] for r in cache.cache_lookup_asof(q, p.limit(0), ttl).collect()} == {"miss"}


def test_a_hot_key_is_spread_over_its_slots(spark):
    """A third of all rows under one key: the window's groups are slots, none of which holds many."""
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 60).cast("timestamp_ntz")
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("cache_key"), at.alias("t"), "id")
    puts = rows.select("cache_key", F.col("id").cast("string").alias("response_json"), F.col("t").alias("fetched_at"))
    found = cache.cache_lookup_asof(rows.withColumnRenamed("t", "requested_at"), puts, dt.timedelta(hours=1))
    assert found.where("response_json = cast(id as string)").count() == 30_000
    most = found.withColumn("task", F.spark_partition_id()).where("cache_key = 'hot'").groupBy("task").count().agg(F.max("count")).first()[0]
    assert most < 6_000


def test_many_resumes_at_once_equal_each_by_itself(spark):
    words = SkillCatalog.of(["alpha", "beta", "gamma", "delta", "rare"])
    rnd = random.Random(5)
    rows = [[f"j{i:03d}", f"t{i}", None, None, None, " ".join(rnd.sample(["alpha", "beta", "gammas", "delta", "x"], 2)) if i % 9 else None, dt.datetime(2026, 1, 1 + rnd.randint(0, 5)) if i % 7 else None] for i in range(80)]
    jobs = spark.createDataFrame(rows, "job_id string, title string, company_name string, location string, via string, description string, scraped_at timestamp_ntz")
    jobs = jobs.withColumns({c: F.lit(None).cast("string") for c in ("apply_link", "salary", "schedule_type")})
    texts = ["alpha", "beta and gamma", "", None, "nothing", "rare", "alpha beta gamma delta rare", "delta delta"]
    resumes = spark.createDataFrame(list(enumerate(texts)), "candidate_id int, text string")
    found = {r["candidate_id"]: r for r in match_resumes(jobs, resumes, words).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        if text is None:
            assert found[i]["matched_skills"] == [] and found[i]["recommended"] == []
            continue
        summary, recommended = match_resume(jobs, text, words)
        assert found[i]["matched_skills"] == summary.first()["matched_skills"]
        assert [p["job_id"] for p in found[i]["recommended"]] == [r["job_id"] for r in recommended.collect()]
    assert match_resumes(jobs.limit(0), resumes, words).where("size(recommended) > 0").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("most,share", [(1, 256), (2, 3), (3, 256)])
def test_near_titles_equal_all_pairs(spark, most, share):
    rnd = random.Random(most)
    titles = ["", "a", "ab", "data engineer", "senior data engineer"]
    for _ in range(120):
        t = list(rnd.choice(titles))
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randint(0, len(t))
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["x", "y", "", " z"])
        titles.append("".join(t))
    rows = [(rnd.choice(["Acme", "Beta", None]), "Pune", t) for t in titles for _ in range(rnd.randint(1, 3))]
    df = spark.createDataFrame(rows, "company_name string, location string, title string")
    norm = lambda t: " ".join((t or "").lower().split())
    groups = {}
    for c, place, t in rows:
        own = groups.setdefault((norm(c), norm(place)), {})
        own[norm(t)] = own.get(norm(t), 0) + 1
    want = []
    for (c, place), own in groups.items():
        near = {t: [u for u in own if u != t and distance(t, u) <= most] for t in own}
        for t in own:
            seen, todo = {t}, [t]
            while todo:
                for u in near[todo.pop()]:
                    if u not in seen:
                        seen.add(u)
                        todo.append(u)
            want.append((c, place, t, min(seen), own[t], len(near[t])))
    assert sorted(tuple(r) for r in near_titles(df, most, share=share).collect()) == sorted(want)
    assert near_titles(df.limit(0), most).count() == 0
