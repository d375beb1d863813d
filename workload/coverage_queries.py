"""Unlock, path, fit and the set expressions below them, on the basket view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap.functions import coverage as C
from skillgap.functions import postings as P
from skillgap.functions.text import snippet
from skillgap.operators import unlock as U
from skillgap.operators.candidates import matched_for, unlocks_for
from skillgap.operators.fit import job_fit
from skillgap.operators.ranks import ranked
from skillgap.catalog import ROLES
from skillgap.plans.reports import as_rows, unlock_report
from skillgap.sources.scratch import materialize
from workload.registry import joined, query, sql_list, stamp
from workload.views import BASKET_SQL, BRANDS, HELD, ITEM_ROLES, basket, table

T, K = 60, 3
R_SQL = sql_list(HELD)


def eligible_sql(extra: str = "", k: int = K) -> str:
    return f"""WITH {BASKET_SQL},
elig AS (
  SELECT *, skills_required AS skills, len(skills_required) AS n, len(list_intersect(skills_required, {R_SQL})) AS m
  FROM jobs WHERE len(skills_required) >= {k} {extra}
)"""


def role_sql(column: str, role: str) -> str:
    return f"regexp_matches({column}, '{ITEM_ROLES.patterns[role]}', 'i')"


ONE_AWAY = f"(m * 100 < {T} * n AND (m + 1) * 100 >= {T} * n)"


def elig(spark, sf, **kw):
    return U.eligible(basket(spark, sf), HELD, K, roles=ITEM_ROLES, **kw)


@query("eligible", eligible_sql() + """
SELECT job_id, array_to_string(list_sort(skills), '|') AS skills, CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m FROM elig""")
def _(spark, sf):
    return elig(spark, sf).select("job_id", joined(F.array_sort("skills")).alias("skills"), "n", "m")


@query("by_location_type", eligible_sql("AND location_type = 'Hybrid'") + " SELECT job_id, CAST(n AS INTEGER) AS n FROM elig")
def _(spark, sf):
    return elig(spark, sf, location_type="Hybrid").select("job_id", "n")


@query("by_role", eligible_sql(f"AND {role_sql('title', 'machines')}") + " SELECT job_id, title FROM elig")
def _(spark, sf):
    return elig(spark, sf, role="machines").select("job_id", "title")


@query("by_age", eligible_sql("AND posted_days_ago <= 14") + " SELECT job_id, posted_days_ago FROM elig")
def _(spark, sf):
    return elig(spark, sf, max_age_days=14).select("job_id", "posted_days_ago")


@query("narrow_table", eligible_sql() + f"""
SELECT count(*) AS eligible_jobs, count(*) FILTER (WHERE m * 100 >= {T} * n) AS matched_jobs,
       CAST(0 AS BIGINT) AS disclosed_count, CAST(NULL AS DOUBLE) AS unlocked_max_lpa FROM elig""")
def _(spark, sf):
    narrow = basket(spark, sf).select("job_id", "title", "company_name", "skills_required")
    e = U.eligible(narrow, HELD, K, max_age_days=7, roles=ITEM_ROLES)
    pay = U.salary_benchmark(e, T)
    return U.baseline(e, T).select(
        "eligible_jobs", "matched_jobs",
        pay.select("disclosed_count").scalar().alias("disclosed_count"),
        pay.select("unlocked_max_lpa").scalar().alias("unlocked_max_lpa"),
    )


@query("coverage", eligible_sql() + """
SELECT job_id, CAST(m AS INTEGER) AS m, CAST(n AS INTEGER) AS n,
       m * 100 // n AS match_pct, (m + 1) * 100 // n AS match_after FROM elig""")
def _(spark, sf):
    m, n = F.col("m"), F.col("n")
    return elig(spark, sf).select(
        "job_id", "m", "n", C.percent(m, n).alias("match_pct"), C.percent(m + 1, n).alias("match_after")
    )


@query("candidate_overlap", eligible_sql() + f"""
SELECT CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m, count(*) AS jobs,
  min(array_to_string(list_sort(list_intersect(skills, {R_SQL})), '|')) AS least FROM elig GROUP BY ALL""")
def _(spark, sf):
    shared = joined(F.array_sort(C.intersect_list(F.col("skills"), C.string_array(HELD))))
    return elig(spark, sf).groupBy("n", "m").agg(F.count("*").alias("jobs"), F.min(shared).alias("least"))


@query("fit_status", eligible_sql() + f"""
SELECT CASE WHEN m * 100 >= {T} * n THEN 'matched' WHEN (m + 1) * 100 >= {T} * n THEN 'one_skill_away' ELSE 'further' END AS status,
       count(*) AS jobs FROM elig GROUP BY 1""")
def _(spark, sf):
    status = C.fit_status(F.col("m"), F.col("n"), T).alias("status")
    return elig(spark, sf).groupBy(status).agg(F.count("*").alias("jobs"))


MATCHED_SQL = f"array_to_string(list_sort(list_intersect(skills, {R_SQL})), '|')"
MISSING_SQL = f"array_to_string(list_sort(list_filter(skills, lambda x: NOT list_contains({R_SQL}, x))), '|')"


@query("matched_missing", eligible_sql() + f" SELECT job_id, {MATCHED_SQL} AS matched, {MISSING_SQL} AS missing FROM elig")
def _(spark, sf):
    matched, missing = C.matched_missing(F.col("skills"), HELD)
    return elig(spark, sf).select("job_id", joined(matched).alias("matched"), joined(missing).alias("missing"))


@query("anti_skills", eligible_sql() + f" SELECT job_id, {MISSING_SQL} AS missing FROM elig")
def _(spark, sf):
    return elig(spark, sf).select(
        "job_id", joined(F.array_sort(C.except_list(F.col("skills"), C.string_array(HELD)))).alias("missing")
    )


@query("not_in_skills", eligible_sql() + f"""
SELECT skill, count(*) AS demand FROM (SELECT unnest(skills) AS skill FROM elig)
WHERE NOT list_contains({R_SQL}, skill) GROUP BY skill""")
def _(spark, sf):
    skills = elig(spark, sf).select(F.explode("skills").alias("skill"))
    return skills.where(~F.col("skill").isin(*HELD)).groupBy("skill").agg(F.count("*").alias("demand"))


@query("baseline", eligible_sql() + f"""
SELECT count(*) AS eligible_jobs, count(*) FILTER (WHERE m * 100 >= {T} * n) AS matched_jobs FROM elig""")
def _(spark, sf):
    return U.baseline(elig(spark, sf), T)


SALARY_SQL = f"""
pay AS (
  SELECT count(salary_min_lpa) FILTER (WHERE m * 100 >= {T} * n) AS disclosed_count,
         round(min(salary_min_lpa) FILTER (WHERE m * 100 >= {T} * n), 1) AS matched_min_lpa,
         round(max(salary_max_lpa) FILTER (WHERE m * 100 >= {T} * n), 1) AS matched_max_lpa,
         round(max(salary_max_lpa), 1) AS unlocked_max_lpa FROM elig
)"""


@query("salary_benchmark", eligible_sql() + "," + SALARY_SQL + """
SELECT *, CASE WHEN matched_max_lpa > 0 AND unlocked_max_lpa > matched_max_lpa
  THEN CAST(round_even((unlocked_max_lpa - matched_max_lpa) / matched_max_lpa * 100, 0) AS INTEGER) END AS ceiling_boost_pct FROM pay""")
def _(spark, sf):
    return U.salary_benchmark(elig(spark, sf), T)


def unlocks_cte(name: str, source: str, held: str) -> str:
    return f"""
{name} AS (
  SELECT skill, count(*) FILTER (WHERE {ONE_AWAY}) AS unlocks, count(*) AS demand
  FROM (SELECT m, n, unnest(skills) AS skill FROM {source})
  WHERE NOT list_contains({held}, skill) GROUP BY skill HAVING count(*) FILTER (WHERE {ONE_AWAY}) > 0
  ORDER BY unlocks DESC, demand DESC, skill
)"""


UNLOCKS_SQL = unlocks_cte("ranked", "elig", R_SQL)
ALL_UNLOCKS = eligible_sql() + "," + UNLOCKS_SQL


@query("unlocks", ALL_UNLOCKS + " SELECT * FROM ranked")
def _(spark, sf):
    return U.unlocks(elig(spark, sf), HELD, T)


@query("unlock_order", ALL_UNLOCKS + """
SELECT CAST(row_number() OVER (ORDER BY unlocks DESC, demand DESC, skill) AS INTEGER) AS place, skill, unlocks, demand
FROM ranked ORDER BY place LIMIT 10""")
def _(spark, sf):
    # The ten rows of the report, numbered in its order.
    top = U.unlocks(elig(spark, sf), HELD, T, 10)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*U.ranking())))


@query("best_single", ALL_UNLOCKS + " SELECT * FROM ranked ORDER BY unlocks DESC, demand DESC, skill LIMIT 1")
def _(spark, sf):
    return U.unlocks(elig(spark, sf), HELD, T, 1)


EXAMPLES_SQL = f"""
top AS (SELECT * FROM ranked ORDER BY unlocks DESC, demand DESC, skill LIMIT 10),
examples AS (
  SELECT * FROM (
    SELECT skill, job_id, title, company_name, CAST(m * 100 // n AS INTEGER) AS match_before, CAST((m + 1) * 100 // n AS INTEGER) AS match_after,
           CAST(row_number() OVER (PARTITION BY skill ORDER BY m * 100 // n DESC, job_id) AS INTEGER) AS rn
    FROM (SELECT *, unnest(skills) AS skill FROM elig WHERE {ONE_AWAY})
    WHERE skill IN (SELECT skill FROM top))
  WHERE rn <= 3
)"""


def staged_elig(spark, sf):
    """The eligible postings as the report stages them: read once, whatever follows."""
    return materialize(elig(spark, sf).select("job_id", "title", "company_name", "skills", "n", "m"), "eligible")


@query("unlock_examples", ALL_UNLOCKS + "," + EXAMPLES_SQL + " SELECT * FROM examples")
def _(spark, sf):
    e = staged_elig(spark, sf)
    return U.unlock_examples(e, U.unlocks(e, HELD, T, 10), T)


@query("example_order", ALL_UNLOCKS + "," + EXAMPLES_SQL + """
SELECT CAST(row_number() OVER (ORDER BY t.unlocks DESC, t.demand DESC, t.skill, e.rn) AS INTEGER) AS place, t.skill, e.job_id
FROM top t JOIN examples e USING (skill)""")
def _(spark, sf):
    # The order in which the report shows them, as a number.
    e = staged_elig(spark, sf)
    top = U.unlocks(e, HELD, T, 10)
    shown = U.attach_examples(top, U.unlock_examples(e, top, T)).select(
        "skill", "unlocks", "demand", F.posexplode(F.transform("example_jobs", lambda x: x["job_id"])).alias("rn", "job_id")
    )
    return shown.select(F.row_number().over(Window.orderBy(*U.ranking(), "rn")).alias("place"), "skill", "job_id")


ATTACHED_SQL = ALL_UNLOCKS + "," + EXAMPLES_SQL + """
SELECT t.skill, t.unlocks, t.demand, string_agg(e.job_id, '|' ORDER BY e.rn) AS example_jobs
FROM top t JOIN examples e USING (skill) GROUP BY ALL"""


@query("attach_examples", ATTACHED_SQL)
def _(spark, sf):
    e = staged_elig(spark, sf)
    top = U.unlocks(e, HELD, T, 10)
    return _example_ids(U.attach_examples(top, U.unlock_examples(e, top, T)))


def _example_ids(df):
    return df.withColumn("example_jobs", joined(F.transform("example_jobs", lambda x: x["job_id"])))




def _step(number: int, before: str, held: str) -> str:
    return f"""
, e{number} AS (SELECT * REPLACE (m + CAST(list_contains(skills, (SELECT skill FROM b{number - 1})) AS INTEGER) AS m) FROM {before}),
{unlocks_cte(f"r{number}", f"e{number}", held)},
b{number} AS (SELECT * FROM r{number} ORDER BY unlocks DESC, demand DESC, skill LIMIT 1)"""


PATH_CTES = (
    ALL_UNLOCKS
    + ", b1 AS (SELECT * FROM ranked ORDER BY unlocks DESC, demand DESC, skill LIMIT 1)"
    + _step(2, "elig", f"list_concat({R_SQL}, [(SELECT skill FROM b1)])")
    + _step(3, "e2", f"list_concat({R_SQL}, [(SELECT skill FROM b1), (SELECT skill FROM b2)])")
    + """
, steps AS (SELECT 1 AS step, skill, unlocks FROM b1 UNION ALL SELECT 2, skill, unlocks FROM b2 UNION ALL SELECT 3, skill, unlocks FROM b3),
path AS (SELECT step, skill, unlocks, CAST(sum(unlocks) OVER (ORDER BY step) AS BIGINT) AS cumulative_gain FROM steps)"""
)


@query("unlock_path", PATH_CTES + " SELECT * FROM path")
def _(spark, sf):
    return U.unlock_path(elig(spark, sf), HELD, T)


@query("projected_matches", PATH_CTES + f"""
, base AS (SELECT count(*) AS total, count(*) FILTER (WHERE m * 100 >= {T} * n) AS matched FROM elig)
SELECT 0 AS step, 'NOW' AS skill, matched AS jobs, least(100.0, matched / greatest(total, 1) * 100) AS share_pct FROM base
UNION ALL
SELECT step, skill, matched + cumulative_gain, least(100.0, unlocks / greatest(total, 1) * 100) FROM path, base""")
def _(spark, sf):
    e = elig(spark, sf)
    return U.projected_matches(U.baseline(e, T), U.unlock_path(e, HELD, T))


# Every conversation is a candidate who holds six of the brands, by its number.
_CANDIDATES_SQL = f"""WITH {BASKET_SQL},
c AS (SELECT DISTINCT conv_id AS candidate_id FROM conversations),
h AS (SELECT candidate_id, list_sort(list_filter({sql_list(BRANDS.names)}, lambda x: (candidate_id * 7 + CAST(replace(x, 'Brand#', '') AS BIGINT) * 11) % 25 < 6)) AS held FROM c),
s AS (SELECT held, len(skills_required) AS n, len(list_intersect(skills_required, held)) AS m, skills_required AS skills
  FROM (SELECT DISTINCT held FROM h), jobs WHERE len(skills_required) >= {K})"""


def _candidates(spark, sf):
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("candidate_id")).distinct()
    number = lambda x: F.replace(x, F.lit("Brand#"), F.lit("")).cast("bigint")
    held = F.filter(C.string_array(BRANDS.names), lambda x: (F.col("candidate_id") * 7 + number(x) * 11) % 25 < 6)
    return conv.withColumn("skills", held)


@query("matched_for_candidates", _CANDIDATES_SQL + f"""
, x AS (SELECT held, count(*) FILTER (WHERE m * 100 >= {T} * n) AS matched_jobs FROM s GROUP BY held)
SELECT candidate_id, coalesce(matched_jobs, 0) AS matched_jobs FROM h LEFT JOIN x USING (held)""")
def _(spark, sf):
    return matched_for(basket(spark, sf), _candidates(spark, sf), T, K)


@query("unlocks_for_candidates", _CANDIDATES_SQL + f"""
, x AS (SELECT held, skill, count(*) AS unlocks FROM (SELECT held, unnest(skills) AS skill FROM s WHERE {ONE_AWAY})
  WHERE NOT list_contains(held, skill) GROUP BY ALL)
SELECT candidate_id, skill, unlocks FROM h JOIN x USING (held)""")
def _(spark, sf):
    return unlocks_for(basket(spark, sf), _candidates(spark, sf), T, K)


ROLE_CASE = "CASE " + " ".join(f"WHEN {role_sql('title', r)} THEN '{r}'" for r in ITEM_ROLES.priority) + " ELSE 'other' END"

def _part(part: str, source: str, values: dict[str, str], row: str = "") -> str:
    """Rows (part, key, value) of a small table in SQL."""
    lead = f"concat(CAST({row} AS VARCHAR), '/'), " if row else ""
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, concat({lead}'{k}') AS key, coalesce(CAST({v} AS VARCHAR), '') AS value FROM {source}"
        for k, v in values.items()
    )


_TENTHS = ("matched_min_lpa", "matched_max_lpa", "unlocked_max_lpa")


@query("unlock_report", PATH_CTES + "," + EXAMPLES_SQL + "," + SALARY_SQL + f"""
, base AS (SELECT count(*) AS total, count(*) FILTER (WHERE m * 100 >= {T} * n) AS matched FROM elig),
attached AS (SELECT t.skill, t.unlocks, t.demand, string_agg(e.job_id, '|' ORDER BY e.rn) AS example_jobs FROM top t JOIN examples e USING (skill) GROUP BY ALL),
everything AS (SELECT count(*) AS n FROM ranked),
projected AS (
  SELECT 0 AS step, 'NOW' AS skill, matched AS jobs, least(100.0, matched / greatest(total, 1) * 100) AS share_pct FROM base
  UNION ALL SELECT step, skill, matched + cumulative_gain, least(100.0, unlocks / greatest(total, 1) * 100) FROM path, base),
stats AS (SELECT count(*) AS jobs, strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') AS lo, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS hi,
  CAST(round(avg(CASE WHEN is_snapshot THEN 1.0 ELSE 0.0 END), 4) * 10000 AS BIGINT) AS share FROM jobs),
phrases AS (SELECT count(DISTINCT q) AS n FROM (SELECT unnest(source_queries) AS q FROM jobs))
""" + " UNION ALL ".join([
    _part("baseline", "base", {"eligible_jobs": "total", "matched_jobs": "matched"}),
    _part("salary", "pay", {"disclosed_count": "disclosed_count", **{c: f"CAST(round({c} * 10) AS BIGINT)" for c in _TENTHS},
          "ceiling_boost_pct": "CASE WHEN matched_max_lpa > 0 AND unlocked_max_lpa > matched_max_lpa THEN CAST(round_even((unlocked_max_lpa - matched_max_lpa) / matched_max_lpa * 100, 0) AS INTEGER) END"}),
    _part("unlocks", "attached", {"unlocks": "unlocks", "demand": "demand", "example_jobs": "example_jobs"}, "skill"),
    _part("unlocks", "everything", {"all": "n"}),
    _part("path", "path", {"skill": "skill", "unlocks": "unlocks", "cumulative_gain": "cumulative_gain"}, "step"),
    _part("projected", "projected", {"skill": "skill", "jobs": "jobs", "share": "CAST(round(share_pct * 1000) AS BIGINT)"}, "step"),
    _part("corpus", "stats", {"jobs": "jobs", "as_of_min": "lo", "as_of_max": "hi", "snapshot_share": "share"}),
    _part("corpus", "phrases", {"distinct_queries": "n"}),
]))
def _(spark, sf):
    r = unlock_report(basket(spark, sf), HELD, T, K, roles=ITEM_ROLES)
    whole = lambda c, by: F.round(F.col(c) * by).cast("bigint")
    parts = {
        "baseline": (r.baseline, None, {c: F.col(c) for c in ("eligible_jobs", "matched_jobs")}),
        "salary": (r.salary_benchmark, None, {
            "disclosed_count": F.col("disclosed_count"), **{c: whole(c, 10) for c in _TENTHS}, "ceiling_boost_pct": F.col("ceiling_boost_pct")}),
        "unlocks": (_example_ids(r.unlocks), "skill", {c: F.col(c) for c in ("unlocks", "demand", "example_jobs")}),
        "all": (r.all_unlocks_count, None, {"all": F.col("all_unlocks_count")}),
        "path": (r.path, "step", {c: F.col(c) for c in ("skill", "unlocks", "cumulative_gain")}),
        "projected": (r.projected, "step", {"skill": F.col("skill"), "jobs": F.col("jobs"), "share": whole("share_pct", 1000)}),
        "corpus": (r.corpus, None, {
            "jobs": F.col("jobs"), "as_of_min": stamp("as_of_min"), "as_of_max": stamp("as_of_max"),
            "snapshot_share": whole("snapshot_share", 10000), "distinct_queries": F.col("distinct_queries")}),
    }
    return as_rows(parts).withColumn("part", F.when(F.col("part") == "all", "unlocks").otherwise(F.col("part")))


FIT_SQL = eligible_sql() + f"""
SELECT job_id, title, company_name, coalesce(location, '') AS location, location_type, portal_count,
       CAST(m * 100 // n AS INTEGER) AS match_pct, {MATCHED_SQL} AS matched, {MISSING_SQL} AS missing, {ROLE_CASE} AS role,
       CASE WHEN m * 100 >= {T} * n THEN 'matched' WHEN (m + 1) * 100 >= {T} * n THEN 'one_skill_away' ELSE 'further' END AS status,
       salary, apply_link, posted_at, substring(description, 1, 260) AS description_snippet, posted_days_ago
FROM elig ORDER BY match_pct DESC, title, job_id LIMIT 500"""


@query("fit", FIT_SQL)
def _(spark, sf):
    fit = job_fit(basket(spark, sf), HELD, T, K, roles=ITEM_ROLES)
    return fit.withColumns({"matched": joined("matched"), "missing": joined("missing")}).drop("apply_options")


# Four ways to apply, of four classes, from the least wanted to the employer's own page.
_OFFERS = [("Shine", "https://shine.com/"), ("Some board", "https://board/"), ("LinkedIn", "https://l/"), ("Own page", "https://boards.greenhouse.io/")]


@query("fit_report", eligible_sql() + f"""
SELECT CAST(row_number() OVER (ORDER BY m * 100 // n DESC, title, job_id) AS INTEGER) AS place, job_id,
  CASE WHEN n % 4 = 1 THEN 'Shine' WHEN n % 4 = 2 THEN 'Some board|Shine' WHEN n % 4 = 3 THEN 'LinkedIn|Some board|Shine'
       ELSE 'Own page|LinkedIn|Some board|Shine' END AS portals FROM elig""")
def _(spark, sf):
    # All postings, in the order of the report, with their ways to apply as it sorts them.
    offers = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(u).alias("link")) for t, u in _OFFERS])
    n = F.size("skills_required")
    jobs = basket(spark, sf).withColumn("apply_options", F.slice(offers, 1, F.when(n % 4 == 0, 4).otherwise(n % 4)))
    fit = job_fit(jobs, HELD, T, K, roles=ITEM_ROLES, limit=None)
    portals = joined(F.transform("apply_options", lambda o: o["title"])).alias("portals")
    rows = fit.select((-F.col("match_pct")).alias("least"), "title", "job_id", portals)
    return ranked(rows, [], ["least", "title", "job_id"]).select(F.col("rank").cast("int").alias("place"), "job_id", "portals")


_ROLE_WORDS = "['Engineer', 'ML Engineer Backend', 'Senior Cloud Data Engineer', 'DevOps Engineer', 'Full Stack Developer', 'Backend Developer', 'Rapid Prototyping', 'ReactJS Developer']"


def _real_role(role: str) -> str:
    return f"regexp_matches(title, '{ROLES.patterns[role]}', 'i')"


@query("role_class_full", f"""WITH {BASKET_SQL},
titled AS (SELECT job_id, concat(title, ' ', ({_ROLE_WORDS})[CAST(CAST(job_id AS BIGINT) % 8 AS INTEGER) + 1]) AS title FROM jobs)
SELECT job_id, CASE """ + " ".join(f"WHEN {_real_role(r)} THEN '{r}'" for r in ROLES.priority) + " ELSE 'other' END AS role FROM titled")
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in _ROLE_WORDS.strip("[]'").split("', '")])
    title = F.concat("title", F.lit(" "), F.element_at(words, (F.col("job_id").cast("bigint") % 8 + 1).cast("int")))
    return basket(spark, sf).select("job_id", P.role_class(title, ROLES).alias("role"))


@query("role_class", f"WITH {BASKET_SQL} SELECT {ROLE_CASE} AS role, count(*) AS jobs FROM jobs GROUP BY 1")
def _(spark, sf):
    return basket(spark, sf).groupBy(P.role_class(F.col("title"), ITEM_ROLES).alias("role")).agg(F.count("*").alias("jobs"))


@query("role_flags", f"WITH {BASKET_SQL} SELECT job_id, " + ", ".join(
    f"{role_sql('title', r)} AS {r}" for r in ITEM_ROLES.patterns) + " FROM jobs")
def _(spark, sf):
    flags = P.role_flags(F.col("title"), ITEM_ROLES)
    return basket(spark, sf).select("job_id", *[c.alias(r) for r, c in flags.items()])


@query("snippet", f"WITH {BASKET_SQL} SELECT job_id, substring(description, 1, 40) AS snippet FROM jobs")
def _(spark, sf):
    return basket(spark, sf).select("job_id", snippet(F.col("description"), 40).alias("snippet"))


def _sets(name, spark_expr, sql_expr, nulls=False):
    @query(name, f"WITH {BASKET_SQL} SELECT job_id, array_to_string({sql_expr}, '|') AS list FROM jobs")
    def _(spark, sf):
        return basket(spark, sf).select("job_id", joined(spark_expr()).alias("list"))


# Lists with repeated values and nulls: the skills twice around a null.
def _noisy():
    return F.concat(F.col("skills_required"), F.array(F.lit(None).cast("string")), F.col("skills_required"))


_sets("distinct_list", lambda: F.array_sort(C.distinct_list(_noisy())), "list_sort(list_distinct(list_concat(skills_required, [NULL], skills_required)))")
_sets("intersect_list", lambda: F.array_sort(C.intersect_list(_noisy(), C.string_array(HELD))), f"list_sort(list_intersect(skills_required, {R_SQL}))")
_sets("except_list", lambda: F.array_sort(C.except_list(_noisy(), C.string_array(HELD))), f"list_sort(list_filter(skills_required, lambda x: NOT list_contains({R_SQL}, x)))")
_sets(
    "ordered_union",
    lambda: C.ordered_union(C.string_array(HELD), F.col("skills_required")),
    f"list_concat({R_SQL}, list_filter(skills_required, lambda x: NOT list_contains({R_SQL}, x)))",
)
_sets("sorted_union", lambda: C.sorted_union(_noisy(), C.string_array(HELD)), f"list_sort(list_distinct(list_concat(skills_required, {R_SQL})))")


@query("array_sorts", f"""WITH {BASKET_SQL}
SELECT job_id, array_to_string(list_sort(skills_required), '|') AS up, array_to_string(list_reverse_sort(skills_required), '|') AS down,
  array_to_string(list_sort(list_distinct(source_queries)), '|') AS phrases FROM jobs""")
def _(spark, sf):
    down = F.sort_array("skills_required", asc=False)
    return basket(spark, sf).select(
        "job_id", joined(F.array_sort("skills_required")).alias("up"), joined(down).alias("down"),
        joined(C.sorted_union(F.col("source_queries"), F.lit(None).cast("array<string>"))).alias("phrases"),
    )
