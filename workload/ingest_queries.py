"""Reading, preparing and merging postings, on documents and on the basket view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.functions.postings import union_by_publisher
from skillgap.operators import kept as K
from skillgap.operators.fit import job_fit
from skillgap.operators.merge import merge_postings, touch_existing
from skillgap.operators.prepare import normalize_postings, prepare_batch
from skillgap.plans.ingest import incoming, ingest, refresh_snapshots
from skillgap.plans.reports import as_rows
from skillgap.schema import POSTING, backfill, conform_schema
from skillgap.sources.scratch import materialize, scratch_path
from skillgap.sources.snapshots import read_snapshots
from skillgap.sources.store import Store, read_store
from skillgap.streaming.upsert import stream_upsert
from workload.coverage_queries import K as MIN_SKILLS
from workload.coverage_queries import T, eligible_sql
from workload.market_queries import PLATFORM, REMOTE
from workload.registry import joined, query, stamp
from workload.text_queries import (
    COMBINED_SQL, COMPANY_SQL, FALLBACK_SQL, LINK_SQL, NOW, PICK_SQL, PORTALS_SQL, POSTED_SQL, REMOTE_SQL, TITLE_SQL,
    age_sql, canonical_sql, lpa_sql, raw,
)
from workload.views import BASKET_SQL, HELD, ITEM_ROLES, RAW_SQL, WORDS, basket, raw_documents, skills_sql

_FILE_POSTINGS = 500


def arrived(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf).withColumn("arrival", F.col("doc_id"))


def prepared(spark: SparkSession, sf: str, **options) -> DataFrame:
    return prepare_batch(normalize_postings(arrived(spark, sf), NOW), NOW, skills=WORDS, **options)


def prep_sql(place: str = "coalesce(location, '')", captured: str = "captured_at", phrase: str = "source_query") -> str:
    """Prepared rows of the raw view, one per document."""
    ident = canonical_sql("t", "c", "l", "coalesce(description, '')")
    return f"""
WITH {RAW_SQL},
a AS (SELECT *, {TITLE_SQL} AS t, {COMPANY_SQL} AS c, {place} AS l, {PICK_SQL} AS pay, {POSTED_SQL} AS posted, {captured} AS cap, {phrase} AS phrase,
      {skills_sql(COMBINED_SQL)} AS skills FROM raw),
prep AS (
  SELECT doc_id, {ident} AS id, job_id AS token, t AS title, c AS company_name, l AS location, coalesce(via, 'Direct') AS via,
    coalesce(det_schedule, 'Full-time') AS schedule_type, {REMOTE_SQL.replace("coalesce(location, '')", "l")} AS remote, pay, {lpa_sql('pay')} AS lpa,
    {LINK_SQL} AS apply_link, apply_options, {PORTALS_SQL} AS portal_count, posted AS posted_at,
    coalesce({age_sql('posted')}, CASE WHEN cap IS NOT NULL THEN {FALLBACK_SQL.replace('captured_at', 'cap')} END) AS posted_days_ago,
    CAST(cap AS TIMESTAMP) AS scraped_at, phrase AS source_query, skills, description FROM a)"""


_PREP_OUT = """
SELECT id AS job_id, token AS source_token, title, company_name, location, via, schedule_type, remote AS work_from_home,
  CASE WHEN remote THEN 'Remote' ELSE 'On-site' END AS location_type, pay AS salary, lpa[1] AS salary_min_lpa, lpa[2] AS salary_max_lpa,
  apply_link, portal_count, posted_at, posted_days_ago, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, source_query,
  array_to_string(skills, '|') AS skills, md5(description) AS description FROM prep"""


def _prep_out(df: DataFrame) -> DataFrame:
    return df.select(
        "job_id", "source_token", "title", "company_name", "location", "via", "schedule_type", "work_from_home", "location_type",
        "salary", "salary_min_lpa", "salary_max_lpa", "apply_link", "portal_count", "posted_at", "posted_days_ago",
        stamp("scraped_at").alias("scraped_at"), "source_query", joined("skills_required").alias("skills"),
        F.md5("description").alias("description"),
    )


@query("prepare_batch", prep_sql() + _PREP_OUT)
def _(spark, sf):
    return _prep_out(prepared(spark, sf))


@query("scraped_default", prep_sql(captured="CASE WHEN doc_id % 4 <> 0 THEN captured_at END") + """
SELECT doc_id, strftime(coalesce(scraped_at, TIMESTAMP '2026-10-09 12:00:00'), '%Y-%m-%d %H:%M:%S') AS scraped_at, posted_days_ago FROM prep""")
def _(spark, sf):
    rows = arrived(spark, sf).withColumn("captured_at", F.when(F.col("doc_id") % 4 != 0, F.col("captured_at")))
    df = prepare_batch(normalize_postings(rows, NOW), NOW, skills=WORDS)
    return df.select(F.col("arrival").alias("doc_id"), stamp("scraped_at").alias("scraped_at"), "posted_days_ago")


# A live fetch: no capture time, the searched place where a result has none.
_LIVE = prep_sql(place="coalesce(location, 'Remote')", captured="CAST(NULL AS VARCHAR)", phrase="'python jobs'").replace(
    "CAST(cap AS TIMESTAMP) AS scraped_at", "TIMESTAMP '2026-10-09 12:00:00' AS scraped_at"
)


def _live(spark, sf, **options):
    rows = arrived(spark, sf).drop("captured_at").withColumn("source_query", F.lit("python jobs"))
    return prepare_batch(normalize_postings(rows, NOW, default_location="Remote", **options), NOW, skills=WORDS)


@query("normalize_live", _LIVE + _PREP_OUT)
def _(spark, sf):
    return _prep_out(_live(spark, sf))


@query("normalize_live_capped", _LIVE + _PREP_OUT + " ORDER BY doc_id LIMIT 20")
def _(spark, sf):
    return _prep_out(_live(spark, sf, cap=20))


# The merge: even documents are stored first, then the odd ones arrive.
def merged_sql(source: str, order: str, rows: str = "prep") -> str:
    return source + f"""
, o AS (SELECT *, {order} AS ord FROM {rows}),
phrases AS (SELECT id, string_agg(source_query, '|' ORDER BY ord) AS source_queries FROM (SELECT id, source_query, min(ord) AS ord FROM o GROUP BY ALL) GROUP BY id),
opts AS (SELECT id, ord, unnest(apply_options) AS opt, generate_subscripts(apply_options, 1) AS pos FROM o),
pubs AS (SELECT id, lower(trim(coalesce(opt.title, opt.link))) AS pub, min(ord * 10 + pos) AS spot, arg_min(coalesce(opt.link, ''), ord * 10 + pos) AS link FROM opts GROUP BY ALL),
merged_options AS (SELECT id, string_agg(concat(pub, '>', link), '|' ORDER BY spot) AS options, CAST(count(*) AS INTEGER) AS publishers, arg_min(nullif(link, ''), spot) AS first_link FROM pubs GROUP BY id),
held AS (SELECT id, string_agg(DISTINCT skill, '|' ORDER BY skill) AS skills FROM (SELECT id, unnest(skills) AS skill FROM o) GROUP BY id),
g AS (
  SELECT id, count(*) AS n, arg_max(title, ord) AS title, arg_max(location, ord) AS location, arg_max(via, ord) AS via, arg_max(schedule_type, ord) AS schedule_type,
    arg_max(posted_at, ord) AS posted_at, arg_max(posted_days_ago, ord) AS posted_days_ago, arg_min(source_query, ord) AS source_query,
    arg_min(pay, ord) FILTER (WHERE pay IS NOT NULL) AS salary, arg_min(lpa[1], ord) FILTER (WHERE lpa[1] IS NOT NULL) AS salary_min_lpa,
    arg_min(lpa[2], ord) FILTER (WHERE lpa[2] IS NOT NULL) AS salary_max_lpa, min(scraped_at) AS scraped_at,
    arg_max(company_name, ord) AS company_name, md5(arg_max(description, ord)) AS description,
    arg_min(token, ord) FILTER (WHERE token IS NOT NULL) AS source_token, bool_or(remote) AS work_from_home,
    arg_min(portal_count, ord) AS own_portals, arg_min(apply_link, ord) AS own_link FROM o GROUP BY id),
merged AS (
SELECT id AS job_id, title, location, via, schedule_type, posted_at, posted_days_ago, source_queries, source_query, coalesce(options, '') AS options,
  CASE WHEN n = 1 THEN own_portals ELSE greatest(1, coalesce(publishers, 0)) END AS portal_count,
  CASE WHEN n = 1 OR own_link <> '' OR publishers IS NULL THEN own_link ELSE first_link END AS apply_link,
  salary, salary_min_lpa, salary_max_lpa, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, source_token, coalesce(skills, '') AS skills,
  work_from_home, CASE WHEN work_from_home THEN 'Remote' ELSE 'On-site' END AS location_type,
  company_name, description, via AS via_platform, 'in' AS source_gl, TRUE AS is_snapshot, salary AS salary_raw
FROM g LEFT JOIN phrases USING (id) LEFT JOIN merged_options USING (id) LEFT JOIN held USING (id))"""


_MERGED_COLUMNS = [
    "job_id", "title", "location", "via", "schedule_type", "posted_at", "posted_days_ago", "source_queries", "source_query",
    "options", "portal_count", "apply_link", "salary", "salary_min_lpa", "salary_max_lpa", "scraped_at", "source_token",
    "skills", "work_from_home", "location_type", "company_name", "description", "via_platform", "source_gl", "is_snapshot",
    "salary_raw",
]


def _merged_out(df: DataFrame) -> DataFrame:
    # A lone row keeps its options as they came; the SQL lists publishers.
    shown = F.transform(
        union_by_publisher(F.col("apply_options")),
        lambda o: F.concat(F.lower(F.trim(F.coalesce(o["title"], o["link"]))), F.lit(">"), F.coalesce(o["link"], F.lit(""))),
    )
    return df.withColumns(
        {
            "options": joined(shown), "source_queries": joined("source_queries"), "skills": joined("skills_required"),
            "scraped_at": stamp("scraped_at"), "description": F.md5("description"),
        }
    ).select(*_MERGED_COLUMNS)


def _empty(spark):
    return spark.createDataFrame([], POSTING)


def _stored_and_batch(spark, sf):
    first = incoming(arrived(spark, sf).where("doc_id % 2 = 0"), NOW, True, WORDS)
    later = incoming(arrived(spark, sf).where("doc_id % 2 = 1"), NOW, True, WORDS)
    # The store is a written table, as it is between two batches.
    return materialize(merge_postings(_empty(spark), first), "stored"), later


_EVENS_FIRST = "(doc_id % 2) * 1000000000 + doc_id"


@query("merge_postings", merged_sql(prep_sql(), _EVENS_FIRST) + " SELECT * FROM merged")
def _(spark, sf):
    return _merged_out(merge_postings(*_stored_and_batch(spark, sf)))


# A small batch beside a stored table: what is not in the batch is stored, and every posting column is shown.
_SMALL_LAST = "CAST(doc_id % 20 = 1 AS BIGINT) * 1000000000 + doc_id"


def store_and_small_batch(spark, sf):
    """The table in two parts, prepared: one document in twenty has just arrived, all others are to be stored."""
    late = F.col("doc_id") % 20 == 1
    return tuple(incoming(arrived(spark, sf).where(part), NOW, True, WORDS) for part in (~late, late))


_SIDES_SQL = merged_sql(prep_sql(), _SMALL_LAST) + """
SELECT m.*, s.id IS NOT NULL AS stored, b.id IS NOT NULL AS arrived FROM merged m
LEFT JOIN (SELECT DISTINCT id FROM prep WHERE doc_id % 20 <> 1) s ON s.id = m.job_id
LEFT JOIN (SELECT DISTINCT id FROM prep WHERE doc_id % 20 = 1) b ON b.id = m.job_id"""


@query("merge_small_batch", _SIDES_SQL)
@query("merge_sides", _SIDES_SQL)
def _(spark, sf):
    first, batch = store_and_small_batch(spark, sf)
    stored = materialize(merge_postings(_empty(spark), first), "stored")
    side = lambda df, name: df.select("job_id").distinct().withColumn(name, F.lit(True))
    merged = _merged_out(merge_postings(stored, batch)).join(side(stored, "stored"), "job_id", "left").join(side(batch, "arrived"), "job_id", "left")
    return merged.select(
        *_MERGED_COLUMNS, F.coalesce("stored", F.lit(False)).alias("stored"), F.coalesce("arrived", F.lit(False)).alias("arrived"),
    )


_THIRDS = "(doc_id % 3) * 1000000000 + doc_id"


@query("kept_counters", merged_sql(prep_sql(), _THIRDS) + f"""
, counters AS (SELECT count(*) AS total_jobs, count(*) FILTER (WHERE {REMOTE}) AS remote_jobs, count(*) - count(*) FILTER (WHERE {REMOTE}) AS on_site_jobs,
  count(*) FILTER (WHERE salary IS NOT NULL AND salary <> '') AS salary_disclosed_jobs FROM merged),
top_skills AS (SELECT skill, count(*) AS count FROM (SELECT unnest(string_split(skills, '|')) AS skill FROM merged WHERE skills <> '') GROUP BY 1 ORDER BY count DESC, skill LIMIT 12),
top_companies AS (SELECT company_name, count(*) AS count FROM merged GROUP BY 1 ORDER BY count DESC, company_name LIMIT 8),
top_platforms AS (SELECT {PLATFORM} AS platform, count(*) AS count FROM merged GROUP BY 1 ORDER BY count DESC, platform LIMIT 6),
sites AS (SELECT coalesce(via_platform, 'Direct / Portal') AS platform, count(*) AS openings, count(salary_raw) AS stated FROM merged GROUP BY 1 ORDER BY openings DESC, platform LIMIT 10),
places AS (SELECT location_type, count(*) AS total_jobs FROM merged GROUP BY 1),
corpus AS (SELECT count(*) AS jobs, min(scraped_at) AS lo, max(scraped_at) AS hi, CAST(avg(CASE WHEN is_snapshot THEN 1.0 ELSE 0.0 END) * 10000 AS BIGINT) AS share FROM merged),
said AS (SELECT count(DISTINCT q) AS n FROM (SELECT unnest(string_split(source_queries, '|')) AS q FROM merged WHERE source_queries IS NOT NULL))
""" + " UNION ALL ".join(
    [f"SELECT 'counters' AS part, '{c}' AS key, CAST({c} AS VARCHAR) AS value FROM counters" for c in ("total_jobs", "remote_jobs", "on_site_jobs", "salary_disclosed_jobs")]
    + [f"SELECT '{p}', concat({c}, '/count'), CAST(count AS VARCHAR) FROM top_{p}" for p, c in (("skills", "skill"), ("companies", "company_name"), ("platforms", "platform"))]
    + ["SELECT 'sites', concat(platform, '/openings'), CAST(openings AS VARCHAR) FROM sites",
       "SELECT 'sites', concat(platform, '/tenths'), CAST(CAST(round(stated * 100.0 / openings, 1) * 10 AS BIGINT) AS VARCHAR) FROM sites",
       "SELECT 'places', concat(location_type, '/jobs'), CAST(total_jobs AS VARCHAR) FROM places",
       "SELECT 'corpus', 'jobs', CAST(jobs AS VARCHAR) FROM corpus", "SELECT 'corpus', 'lo', lo FROM corpus", "SELECT 'corpus', 'hi', hi FROM corpus",
       "SELECT 'corpus', 'share', CAST(share AS VARCHAR) FROM corpus", "SELECT 'corpus', 'phrases', CAST(n AS VARCHAR) FROM said"]
))
def _(spark, sf):
    # Three merges; the figures are read from the counts they kept, never from the table.
    store = Store(spark, scratch_path(spark, "counted"), keep=True)
    for third in (0, 1, 2):
        store.merge(incoming(arrived(spark, sf).where(F.col("doc_id") % 3 == third), NOW, True, WORDS), "thirds", third)
    kept = Store(spark, store.path).counts()
    count, corpus = {"count": F.col("count")}, K.kept_corpus(kept)
    counters = K.kept_counters(kept)
    return as_rows({
        "counters": (counters, None, {c: F.col(c) for c in counters.columns}), "skills": (K.kept_top_skills(kept), "skill", count),
        "companies": (K.kept_top_companies(kept), "company_name", count), "platforms": (K.kept_top_platforms(kept), "platform", count),
        "sites": (K.kept_platform_disclosure(kept), "platform", {"openings": F.col("openings"), "tenths": F.round(F.col("salary_disclosure_pct") * 10).cast("bigint")}),
        "places": (K.kept_arrangements(kept), "location_type", {"jobs": F.col("total_jobs")}),
        "corpus": (corpus, None, {
            "jobs": F.col("jobs"), "lo": stamp("as_of_min"), "hi": stamp("as_of_max"), "share": F.round(F.col("snapshot_share") * 10000).cast("bigint"),
            "phrases": F.col("distinct_queries")}),
    })


@query("touch_existing", prep_sql() + """
SELECT id AS job_id FROM prep WHERE doc_id % 2 = 0 INTERSECT SELECT id FROM prep WHERE doc_id % 2 = 1""")
def _(spark, sf):
    return touch_existing(*_stored_and_batch(spark, sf)).select("job_id")


@query("store_merge", merged_sql(prep_sql(), _EVENS_FIRST) + " SELECT * FROM merged")
def _(spark, sf):
    # The same two batches, each committed to a stored table.
    store = Store(spark, scratch_path(spark, "merged"))
    for half in (0, 1):
        store.merge(incoming(arrived(spark, sf).where(F.col("doc_id") % 2 == half), NOW, True, WORDS), "halves", half)
    return _merged_out(read_store(spark, store.path))


# Snapshot files: one JSON object each, a bounded number of postings inside.
_FILE_SQL = f"doc_id // {_FILE_POSTINGS}"


def write_snapshots(spark: SparkSession, sf: str) -> str:
    """Documents as snapshot files in document order, one unreadable file among them."""
    number = F.floor(F.col("doc_id") / _FILE_POSTINGS)
    posting = F.struct(*[c for c in raw_documents(spark, sf).columns if c not in ("captured_at", "source_query", "source_gl")])
    files = (
        raw_documents(spark, sf)
        .groupBy(number.alias("file"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", posting.alias("posting")))), lambda x: x["posting"]).alias("postings"))
        .select(
            "file",
            F.concat(F.lit("2026-10-0"), (F.col("file") % 9 + 1).cast("string"), F.lit("T10:00:00+00:00")).alias("captured_at"),
            F.struct(F.concat(F.lit("phrase "), (F.col("file") % 7).cast("string")).alias("q"), F.lit("in").alias("gl")).alias("query_params"),
            F.when(F.col("file") % 3 != 0, F.col("postings")).alias("jobs"),
            F.when(F.col("file") % 3 == 0, F.col("postings")).alias("jobs_results"),
        )
    )
    path = scratch_path(spark, "snapshots")
    files.orderBy("file").drop("file").write.option("maxRecordsPerFile", 1).json(path)
    # Spark writes no broken JSON itself; a text file under the expected name does.
    broken = spark.range(1).select(F.lit('{"captured_at": "2026-10-01", "jobs": [').alias("value"))
    broken.write.text(f"{path}/broken.json")
    return path


_FROM_FILES = prep_sql(
    captured=f"concat('2026-10-0', CAST(({_FILE_SQL}) % 9 + 1 AS VARCHAR), 'T10:00:00+00:00')",
    phrase=f"concat('phrase ', CAST(({_FILE_SQL}) % 7 AS VARCHAR))",
)


@query("read_snapshots", _FROM_FILES + _PREP_OUT)
def _(spark, sf):
    disk = read_snapshots(spark, write_snapshots(spark, sf))
    return _prep_out(prepare_batch(normalize_postings(disk, NOW), NOW, skills=WORDS))


@query("ingest_snapshots", merged_sql(_FROM_FILES, "doc_id") + " SELECT * FROM merged")
def _(spark, sf):
    return _merged_out(ingest(_empty(spark), read_snapshots(spark, write_snapshots(spark, sf)), NOW, skills=WORDS))


@query("stream_upsert", merged_sql(_FROM_FILES, "doc_id") + " SELECT * FROM merged")
def _(spark, sf):
    path, checkpoint = scratch_path(spark, "streamed"), scratch_path(spark, "stream-checkpoint")
    stream_upsert(spark, write_snapshots(spark, sf), path, checkpoint, NOW, WORDS, files_per_batch=100_000).awaitTermination()
    return _merged_out(read_store(spark, path))


@query("seed_refresh", merged_sql(_FROM_FILES, "doc_id").replace("WITH ", f"WITH {BASKET_SQL}, ", 1) + """
SELECT job_id, title, portal_count, TRUE AS is_snapshot FROM merged
UNION ALL SELECT job_id, title, portal_count, is_snapshot FROM jobs WHERE NOT is_snapshot""")
def _(spark, sf):
    # The stored snapshots are decades old, so the files on disk replace them.
    store = conform_schema(basket(spark, sf))
    fresh = refresh_snapshots(store, read_snapshots(spark, write_snapshots(spark, sf)), NOW, skills=WORDS)
    return fresh.select("job_id", "title", "portal_count", "is_snapshot")


_THEN = dt.datetime(1999, 1, 1, 6, 0, 0)
_LEAK = """CASE CAST(substring(job_id, 7, 3) AS INTEGER) % 6 WHEN 0 THEN ' 3 Days ago ' WHEN 1 THEN 'Yesterday' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE salary END"""


@query("backfill", f"""
WITH {BASKET_SQL},
w AS (SELECT *, {_LEAK} AS raw_pay, CAST(substring(job_id, 7, 3) AS INTEGER) % 6 IN (0, 1, 2) AS leaked FROM jobs)
SELECT job_id, CASE WHEN CAST(substring(job_id, 7, 3) AS INTEGER) % 4 = 0 THEN company_name ELSE array_to_string(source_queries, '|') END AS source_queries,
  CASE WHEN NOT leaked THEN raw_pay END AS salary_raw, CASE WHEN NOT leaked THEN salary END AS salary,
  CAST(coalesce(posted_days_ago, greatest(0, date_diff('day', scraped_at, TIMESTAMP '1999-01-01 06:00:00'))) AS INTEGER) AS posted_days_ago FROM w""")
def _(spark, sf):
    tail = F.substring("job_id", 7, 3).cast("int")
    leak = F.when(tail % 6 == 0, " 3 Days ago ").when(tail % 6 == 1, "Yesterday").when(tail % 6 == 2, "  ").when(tail % 6 != 3, F.col("salary"))
    old = basket(spark, sf).withColumns(
        {"salary_raw": leak, "source_query": F.col("company_name"), "source_queries": F.when(tail % 4 != 0, F.col("source_queries"))}
    )
    done = backfill(conform_schema(old), _THEN)
    return done.select("job_id", joined("source_queries").alias("source_queries"), "salary_raw", "salary", "posted_days_ago")


@query("null_shape", eligible_sql() + f"""
SELECT job_id, CASE WHEN n = 4 THEN '' ELSE location END AS location, CASE WHEN n = 5 THEN 'On-site' ELSE location_type END AS location_type,
  CASE WHEN n = 3 OR n = 6 THEN 1 ELSE portal_count END AS portal_count, '' AS description_snippet
FROM (SELECT *, m * 100 // n AS match_pct FROM elig) ORDER BY match_pct DESC, title, job_id LIMIT 500""")
def _(spark, sf):
    n = F.size("skills_required")
    holes = basket(spark, sf).withColumns(
        {
            "location": F.when(n != 4, F.col("location")),
            "location_type": F.when(n == 5, F.lit("")).otherwise(F.col("location_type")),
            "portal_count": F.when(n == 6, F.lit(0)).when(n != 3, F.col("portal_count")),
        }
    ).drop("description")
    fit = job_fit(holes, HELD, T, MIN_SKILLS, roles=ITEM_ROLES)
    return fit.select("job_id", "location", "location_type", "portal_count", "description_snippet")

