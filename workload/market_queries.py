"""Market counts, browsing, export and the console, on the basket view."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgap.catalog import CORPUS_NOTE, PLATFORM_NAMES
from skillgap.functions.postings import platform_name, portal_label
from skillgap.functions.recency import fresh_class, fresh_label
from skillgap.operators import browse as B
from skillgap.operators import market as M
from skillgap.operators.console import readonly_sql
from skillgap.plans.reports import as_rows, market_report
from skillgap.schema import POSTING, conform_schema, stringify
from skillgap.sources.export import export_csv, export_json, export_rows
from skillgap.sources.scratch import scratch_path
from skillgap.sources.store import read_store, write_store
from workload.coverage_queries import role_sql
from workload.registry import joined, query, stamp
from workload.views import BASKET_SQL, BRANDS, ITEM_ROLES, basket

JOBS = f"WITH {BASKET_SQL} "
STAMP = "strftime(scraped_at, '%Y-%m-%d %H:%M:%S')"
REMOTE = "(work_from_home OR lower(location) LIKE '%remote%')"
PLATFORM = (
    "CASE " + " ".join(f"WHEN via LIKE '%{p}%' THEN '{p}'" for p in PLATFORM_NAMES)
    + " ELSE coalesce(nullif(replace(via, 'via ', ''), ''), 'Direct Portal') END"
)

_NO_ROLE = " OR ".join(role_sql("title", r) for r in ITEM_ROLES.patterns)


@query("role_summary", JOBS + ", e AS (SELECT * FROM jobs WHERE len(skills_required) >= 3) " + " UNION ALL ".join(
    [f"SELECT '{r}' AS role, '{ITEM_ROLES.labels.get(r, r)}' AS label, count(*) FILTER (WHERE {role_sql('title', r)}) AS jobs FROM e" for r in ITEM_ROLES.patterns]
    + [f"SELECT 'any_role_unmatched', 'Unmatched', count(*) FILTER (WHERE NOT ({_NO_ROLE})) FROM e"]
))
def _(spark, sf):
    return M.role_summary(basket(spark, sf), ITEM_ROLES)


_CORPUS = JOBS + f"""
, stats AS (SELECT count(*) AS jobs, min(scraped_at) AS lo, max(scraped_at) AS hi, round(avg(CASE WHEN is_snapshot THEN 1.0 ELSE 0.0 END), 4) AS snapshot_share FROM jobs),
phrases AS (SELECT count(DISTINCT q) AS distinct_queries FROM (SELECT unnest(source_queries) AS q FROM jobs))"""


@query("corpus_stats", _CORPUS + f"""
SELECT jobs, strftime(lo, '%Y-%m-%d %H:%M:%S') AS as_of_min, strftime(hi, '%Y-%m-%d %H:%M:%S') AS as_of_max, CAST(snapshot_share AS DOUBLE) AS snapshot_share, distinct_queries,
       replace('{CORPUS_NOTE}', '{{n}}', CAST(distinct_queries AS VARCHAR)) AS sample_note FROM stats, phrases""")
def _(spark, sf):
    return M.corpus_stats(basket(spark, sf)).withColumns({"as_of_min": stamp("as_of_min"), "as_of_max": stamp("as_of_max")})


@query("corpus_note", _CORPUS + """
SELECT CASE WHEN snapshot_share >= 0.999 THEN 'All listings come from saved Google Jobs snapshots.'
       ELSE concat(CAST(CAST(floor(snapshot_share * 100 + 0.5) AS INTEGER) AS VARCHAR), '% of listings come from saved Google Jobs snapshots.') END AS snapshot_sentence,
       strftime(hi, '%Y-%m-%d') AS as_of FROM stats""")
def _(spark, sf):
    return M.corpus_note(M.corpus_stats(basket(spark, sf))).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


@query("distinct_queries", _CORPUS + " SELECT distinct_queries FROM phrases")
def _(spark, sf):
    return M.distinct_queries(basket(spark, sf))


_COUNTERS = JOBS + f"""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE {REMOTE}) AS remote_jobs,
       greatest(0, count(*) - count(*) FILTER (WHERE {REMOTE})) AS on_site_jobs,
       count(*) FILTER (WHERE salary IS NOT NULL AND salary <> '') AS salary_disclosed_jobs FROM jobs"""


@query("corpus_counters", _COUNTERS)
def _(spark, sf):
    return M.corpus_counters(basket(spark, sf))


_COUNTED = ["total_jobs", "remote_jobs", "on_site_jobs", "salary_disclosed_jobs"]


@query("market_report", JOBS + f"""
, counters AS ({_COUNTERS.removeprefix(JOBS)}),
skills AS (SELECT skill, count(*) AS count FROM (SELECT unnest(skills_required) AS skill FROM jobs) GROUP BY 1 ORDER BY count DESC, skill LIMIT 12),
companies AS (SELECT company_name, count(*) AS count FROM jobs GROUP BY 1 ORDER BY count DESC, company_name LIMIT 8),
platforms AS (SELECT {PLATFORM} AS platform, count(*) AS count FROM jobs GROUP BY 1 ORDER BY count DESC, platform LIMIT 6)
""" + " UNION ALL ".join(
    [f"SELECT 'counters' AS part, '{c}' AS key, CAST({c} AS VARCHAR) AS value FROM counters" for c in _COUNTED]
    + [f"SELECT '{p}', concat({c}, '/count'), CAST(count AS VARCHAR) FROM {p}" for p, c in (("skills", "skill"), ("companies", "company_name"), ("platforms", "platform"))]
))
def _(spark, sf):
    r = market_report(basket(spark, sf), BRANDS)
    count = {"count": F.col("count")}
    return as_rows({
        "counters": (r.counters, None, {c: F.col(c) for c in _COUNTED}), "skills": (r.top_skills, "skill", count),
        "companies": (r.top_companies, "company_name", count), "platforms": (r.top_platforms, "platform", count),
    })


@query("indexed_count", JOBS + "SELECT count(*) AS indexed_jobs_count FROM jobs")
def _(spark, sf):
    return M.indexed_count(basket(spark, sf))


@query("top_companies", JOBS + "SELECT company_name, count(*) AS count FROM jobs GROUP BY 1 ORDER BY count DESC, company_name LIMIT 8")
def _(spark, sf):
    return M.top_companies(basket(spark, sf))


@query("top_platforms", JOBS + f"SELECT {PLATFORM} AS platform, count(*) AS count FROM jobs GROUP BY 1 ORDER BY count DESC, platform LIMIT 6")
def _(spark, sf):
    return M.top_platforms(basket(spark, sf))


@query("platform_name", JOBS + f"SELECT job_id, {PLATFORM} AS platform FROM jobs")
def _(spark, sf):
    return basket(spark, sf).select("job_id", platform_name(F.col("via")).alias("platform"))


@query("top_skills", JOBS + """SELECT skill, count(*) AS count FROM (SELECT unnest(skills_required) AS skill FROM jobs)
GROUP BY 1 ORDER BY count DESC, skill LIMIT 12""")
def _(spark, sf):
    return M.top_skills(basket(spark, sf))


@query("preset_skill_demand", JOBS + """SELECT skill, count(*) AS demand_count FROM (SELECT unnest(skills_required) AS skill FROM jobs)
GROUP BY 1 ORDER BY demand_count DESC, skill LIMIT 10""")
def _(spark, sf):
    return M.skill_demand(basket(spark, sf))


@query("platform_disclosure", JOBS + """
SELECT coalesce(via_platform, 'Direct / Portal') AS platform, count(*) AS openings,
       round(avg(CASE WHEN salary_raw IS NOT NULL THEN 100.0 ELSE 0.0 END), 1) AS salary_disclosure_pct
FROM jobs GROUP BY 1 ORDER BY openings DESC, platform LIMIT 10""")
def _(spark, sf):
    return M.platform_disclosure(basket(spark, sf))


@query("arrangement_share", JOBS + """
SELECT location_type, count(*) AS total_jobs, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS DOUBLE) AS share_percentage FROM jobs GROUP BY 1""")
def _(spark, sf):
    return M.arrangement_share(basket(spark, sf)).withColumn("share_percentage", F.col("share_percentage").cast("double"))


@query("snapshot_watermark", JOBS + f"SELECT count(*) AS snapshot_rows, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS latest_capture FROM jobs WHERE is_snapshot")
def _(spark, sf):
    return M.snapshot_watermark(basket(spark, sf)).withColumn("latest_capture", stamp("latest_capture"))


_PAGE = f"SELECT job_id, title, company_name, location, {STAMP} AS scraped_at, salary FROM jobs"


def _page(df):
    return df.select("job_id", "title", "company_name", "location", stamp("scraped_at").alias("scraped_at"), "salary")


@query("browse", JOBS + _PAGE + " ORDER BY jobs.scraped_at DESC NULLS LAST, job_id LIMIT 50 OFFSET 100")
def _(spark, sf):
    return _page(B.browse(basket(spark, sf), limit=50, offset=100))


@query("browse_after", JOBS + _PAGE + " ORDER BY jobs.scraped_at DESC NULLS LAST, job_id LIMIT 50 OFFSET 100")
def _(spark, sf):
    # The third page, each asked for by the last row of the one before it.
    pages = B.Pages(spark, scratch_path(spark, "pages"), "month")
    pages.write(basket(spark, sf))
    last = None
    for _ in range(2):
        row = pages.page(50, last).collect()[-1]
        last = row["scraped_at"], row["job_id"]
    return _page(pages.page(50, last))


@query("browse_by_company", JOBS + _PAGE + " ORDER BY company_name, jobs.scraped_at DESC, job_id LIMIT 100")
def _(spark, sf):
    return _page(B.browse(basket(spark, sf), sort_by="company", limit=100))


@query("browse_by_title", JOBS + _PAGE + " WHERE lower(company_name) LIKE '%company 1%' ORDER BY title, jobs.scraped_at DESC, job_id LIMIT 100")
def _(spark, sf):
    return _page(B.browse(basket(spark, sf), company=" company 1", sort_by="title", limit=100))


_KW = "lower({c}) LIKE '%re_ b%'"


@query("keyword", JOBS + "SELECT job_id, title FROM jobs WHERE " + " OR ".join(_KW.format(c=c) for c in ("title", "description", "company_name")))
def _(spark, sf):
    return B.filtered(basket(spark, sf), text=" Re_ B ").select("job_id", "title")


@query("browse_location_remote", JOBS + f"SELECT job_id FROM jobs WHERE {REMOTE}")
def _(spark, sf):
    return B.filtered(basket(spark, sf), location_type="Remote").select("job_id")


@query("browse_location_hybrid", JOBS + "SELECT job_id FROM jobs WHERE lower(location) LIKE '%hybrid%' OR lower(description) LIKE '%hybrid%' OR lower(title) LIKE '%gizmo%'")
def _(spark, sf):
    # The items named gizmo are advertised as hybrid here: no order says so by itself.
    jobs = basket(spark, sf)
    worded = F.when(F.lower("title").contains("gizmo"), F.concat("description", F.lit(" (Hybrid)"))).otherwise(F.col("description"))
    return B.filtered(jobs.withColumn("description", worded), location_type="Hybrid").select("job_id")


@query("browse_location_onsite", JOBS + "SELECT job_id FROM jobs WHERE NOT work_from_home AND lower(location) NOT LIKE '%remote%' AND lower(location) NOT LIKE '%hybrid%'")
def _(spark, sf):
    return B.filtered(basket(spark, sf), location_type="On-site").select("job_id")


@query("company_like", JOBS + "SELECT job_id, company_name FROM jobs WHERE lower(company_name) LIKE '%y 2%'")
def _(spark, sf):
    return B.filtered(basket(spark, sf), company="Y 2").select("job_id", "company_name")


@query("has_salary", JOBS + "SELECT job_id, salary FROM jobs WHERE salary IS NOT NULL AND salary <> ''")
def _(spark, sf):
    return B.filtered(basket(spark, sf), has_salary=True).select("job_id", "salary")


@query("scrape_date_range", JOBS + f"SELECT job_id, {STAMP} AS scraped_at FROM jobs WHERE CAST(jobs.scraped_at AS DATE) >= DATE '1996-02-01' AND CAST(jobs.scraped_at AS DATE) <= DATE '1998-06-30'")
def _(spark, sf):
    found = B.filtered(basket(spark, sf), from_date="1996-02-01", to_date="1998-06-30")
    return found.select("job_id", stamp("scraped_at").alias("scraped_at"))


@query("any_skill_text", JOBS + "SELECT job_id FROM jobs WHERE lower(description) LIKE '%brand#2%' OR lower(description) LIKE '%gear%'")
def _(spark, sf):
    # Brand#2 is found inside Brand#21 too: a plain substring, by definition.
    found = B.any_skill_text(F.col("description"), F.array(F.lit("Brand#2"), F.lit("Gear")))
    return basket(spark, sf).where(found).select("job_id")


@query("fresh_label", JOBS + """
SELECT job_id, CASE WHEN posted_days_ago = 0 THEN 'Today' WHEN posted_days_ago <= 1 THEN '1d ago'
  WHEN posted_days_ago <= 7 THEN concat(posted_days_ago, 'd ago')
  WHEN posted_days_ago <= 30 THEN concat(CAST(round(posted_days_ago / 7) AS INTEGER), 'w ago')
  WHEN posted_days_ago IS NOT NULL THEN concat(CAST(round(posted_days_ago / 30) AS INTEGER), 'mo ago') ELSE posted_at END AS label,
  CASE WHEN posted_days_ago <= 7 THEN 'fresh' WHEN posted_days_ago <= 30 THEN 'recent' WHEN posted_days_ago IS NOT NULL THEN 'stale' ELSE 'recent' END AS class
FROM jobs""")
def _(spark, sf):
    days, raw = F.col("posted_days_ago"), F.col("posted_at")
    return basket(spark, sf).select("job_id", fresh_label(days, raw).alias("label"), fresh_class(days, raw).alias("class"))


@query("portal_label", JOBS + "SELECT job_id, CASE WHEN portal_count >= 8 THEN '8+ portals' ELSE concat(portal_count, ' portals') END AS label FROM jobs")
def _(spark, sf):
    return basket(spark, sf).select("job_id", portal_label(F.col("portal_count")).alias("label"))


@query("stringify", JOBS + """
SELECT job_id, CAST(is_snapshot AS VARCHAR) AS is_snapshot, coalesce(CAST(posted_days_ago AS VARCHAR), '') AS posted_days_ago,
       coalesce(salary, '') AS salary, coalesce(CAST(salary_min_lpa AS VARCHAR), '') AS salary_min_lpa FROM jobs""")
def _(spark, sf):
    return stringify(basket(spark, sf).select("job_id", "is_snapshot", "posted_days_ago", "salary", "salary_min_lpa"))


@query("readonly_sql", JOBS + """
SELECT company_name, CAST(count(*) AS VARCHAR) AS openings, coalesce(CAST(min(posted_days_ago) AS VARCHAR), '') AS newest
FROM jobs WHERE location_type = 'Remote' GROUP BY company_name ORDER BY count(*) DESC, company_name LIMIT 50""")
def _(spark, sf):
    return readonly_sql(
        spark,
        {"jobs": basket(spark, sf)},
        "SELECT company_name, count(*) AS openings, min(posted_days_ago) AS newest FROM jobs "
        "WHERE location_type = 'Remote' GROUP BY company_name ORDER BY openings DESC, company_name LIMIT 1000;",
    )


# Every column of the basket, read back as text.
_LISTS = ["skills_required", "source_queries"]
_TEXTS = ["job_id", "title", "company_name", "location", "location_type", "salary", "salary_raw", "via", "via_platform",
          "description", "apply_link", "posted_at", "schedule_type"]
_NUMBERS = {"work_from_home": "boolean", "is_snapshot": "boolean", "posted_days_ago": "int", "portal_count": "int",
            "salary_min_lpa": "double", "salary_max_lpa": "double"}
_EXPORTED = [*_TEXTS, *_NUMBERS, "scraped_at", *_LISTS]
_EXPORT = JOBS + f"""
SELECT {', '.join(_TEXTS)}, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _NUMBERS)}, {STAMP} AS scraped_at,
       {', '.join(f"array_to_string({c}, '|') AS {c}" for c in _LISTS)}
FROM jobs WHERE work_from_home ORDER BY jobs.scraped_at DESC, job_id LIMIT 1000"""


@query("export_csv", _EXPORT)
def _(spark, sf):
    path = scratch_path(spark, "export-csv")
    export_csv(export_rows(basket(spark, sf), limit=1000, location_type="Remote"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*_EXPORTED).withColumns(
        {**{c: joined(F.from_json(c, "array<string>")) for c in _LISTS}, "scraped_at": stamp(F.col("scraped_at").cast("timestamp_ntz"))}
    )


def _from_json(spark, path):
    kinds = _NUMBERS | {"scraped_at": "timestamp_ntz"} | {c: "array<string>" for c in _LISTS}
    back = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in _EXPORTED)).json(path)
    return back.withColumns(
        {**{c: F.col(c).cast("string") for c in _NUMBERS}, **{c: joined(c) for c in _LISTS}, "scraped_at": stamp("scraped_at")}
    )


@query("export_json", _EXPORT)
def _(spark, sf):
    path = scratch_path(spark, "export-json")
    export_json(export_rows(basket(spark, sf), limit=1000, location_type="Remote"), path)
    return _from_json(spark, path)


@query("export", _EXPORT.replace("WHERE work_from_home ORDER BY jobs.scraped_at DESC, job_id LIMIT 1000", ""))
def _(spark, sf):
    # The whole table, without a limit.
    path = scratch_path(spark, "export-all")
    export_json(export_rows(basket(spark, sf), limit=None), path, compression="gzip")
    return _from_json(spark, path)


_ADDED = "CAST(NULL AS VARCHAR) AS source_token, 'in' AS source_gl"
_STORED = JOBS + f"SELECT job_id, title, {STAMP} AS scraped_at, array_to_string(skills_required, '|') AS skills, portal_count, is_snapshot, salary_max_lpa FROM jobs"


def _stored(df):
    return df.select("job_id", "title", stamp("scraped_at").alias("scraped_at"), joined("skills_required").alias("skills"), "portal_count", "is_snapshot", "salary_max_lpa")


@query("store", _STORED)
def _(spark, sf):
    path = scratch_path(spark, "store")
    write_store(basket(spark, sf), path)
    return _stored(read_store(spark, path))


@query("conform_schema", JOBS + f"""
SELECT job_id, title, {STAMP} AS scraped_at, CAST(1 AS INTEGER) AS portal_count, FALSE AS is_snapshot,
       CAST(NULL AS DOUBLE) AS salary_max_lpa, CAST({len(POSTING.fields)} AS INTEGER) AS columns FROM jobs""")
def _(spark, sf):
    legacy = basket(spark, sf).select("job_id", "title", "company_name", "scraped_at")
    wide = conform_schema(conform_schema(legacy))
    return wide.select("job_id", "title", stamp("scraped_at").alias("scraped_at"), "portal_count", "is_snapshot", "salary_max_lpa", F.lit(len(wide.columns)).alias("columns"))
