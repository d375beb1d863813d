"""Postings-shaped views of the driver tables, as DataFrames and as DuckDB SQL.

basket: one order is one posting, the distinct brands of its parts its skills.
documents: one document is one raw posting.
events: one event is one request, cached search or dated remark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.catalog import RoleCatalog, SkillCatalog

BRANDS = SkillCatalog.of([f"Brand#{i}" for i in range(1, 26)])

# Words that occur in the documents, with aliases, one phrase and one acronym.
WORDS = SkillCatalog.of(
    ["the", "REST API", "thatin", "inoran", "That Is", "elle", "queux", "Schie", "LA", "der die", "anea", "Hehely"],
    aliases={"REST API": r"REST(\s*APIs?)?|RESTful(\s*APIs?)?", "Hehely": r"hehely|ononst"},
    long_forms={"LA": r"la[ -]la"},
    hints={"REST API": ["rest"], "Hehely": ["hehely", "ononst"], "LA": ["la"]},
)

ITEM_ROLES = RoleCatalog(
    {
        "fasteners": r"\bbolt\b|\brod\b",
        "machines": r"gear|gizmo|widget",
        "urgent": r"1-urgent|2-high",
        "old": r"\bold\b|rust",
    },
    ("urgent", "machines", "old", "fasteners"),
    {"fasteners": "Fasteners", "machines": "Machines", "urgent": "Urgent"},
)

HELD = [f"Brand#{i}" for i in range(1, 7)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings from the star schema; the lineitem side is reduced per order before it meets the orders."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    per_order = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.collect_set("p_brand")).alias("skills_required"),
            F.array_sort(F.collect_set("p_type")).alias("source_queries"),
            F.max("p_name").alias("item"),
            F.size(F.collect_set("l_suppkey")).alias("portal_count"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    title = F.concat_ws(" ", "item", "o_orderpriority")
    paid = key % 3 == 0
    rupees = F.floor(price * 10).cast("bigint").cast("string")
    vias = F.array(*[F.lit(v) for v in VIAS])
    return (
        orders.join(per_order, key == F.col("l_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            F.lpad(key.cast("string"), 9, "0").alias("job_id"),
            title.alias("title"),
            F.concat(F.lit("Company "), F.col("c_nationkey").cast("string")).alias("company_name"),
            F.col("n_name").alias("location"),
            F.when(F.col("o_orderstatus") == "O", "Remote")
            .when(F.col("o_orderstatus") == "P", "Hybrid")
            .otherwise("On-site")
            .alias("location_type"),
            (F.col("o_orderstatus") == "O").alias("work_from_home"),
            "skills_required",
            "source_queries",
            F.col("o_orderdate").cast("timestamp_ntz").alias("scraped_at"),
            (key % 5 != 0).alias("is_snapshot"),
            F.when(key % 17 != 0, (key % 400).cast("int")).alias("posted_days_ago"),
            F.when(paid, (F.floor(price / 50000) + 1).cast("double")).alias("salary_min_lpa"),
            F.when(paid, (F.floor(price / 40000) + 2).cast("double")).alias("salary_max_lpa"),
            F.col("portal_count").cast("int").alias("portal_count"),
            F.when(paid, F.concat(F.lit("INR "), rupees, F.lit(" / year"))).alias("salary"),
            F.when(paid, F.concat(F.lit("INR "), rupees, F.lit(" / year"))).alias("salary_raw"),
            F.element_at(vias, (key % len(VIAS)).cast("int") + 1).alias("via"),
            F.when(key % 7 != 0, F.concat(F.lit("Site "), (key % 7).cast("string"))).alias("via_platform"),
            F.concat(title, F.lit(" needs "), F.array_join("skills_required", ", ")).alias("description"),
            F.concat(F.lit("https://jobs.example/"), key.cast("string")).alias("apply_link"),
            F.concat((key % 400).cast("string"), F.lit(" days ago")).alias("posted_at"),
            F.lit("Full-time").alias("schedule_type"),
        )
    )


VIAS = [
    "via LinkedIn", "via Greenhouse Boards", "Lever", "via Workday", "via Indeed", "Naukri.com", "via Somewhere",
    "via ", "via LinkedIn", "Shine",
]

_VIA_LIST = ", ".join(f"'{v}'" for v in VIAS)

BASKET_SQL = f"""
jobs AS (
SELECT lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS job_id,
       concat(s.pn, ' ', o.o_orderpriority) AS title,
       concat('Company ', CAST(c.c_nationkey AS VARCHAR)) AS company_name,
       n.n_name AS location,
       CASE o.o_orderstatus WHEN 'O' THEN 'Remote' WHEN 'P' THEN 'Hybrid' ELSE 'On-site' END AS location_type,
       o.o_orderstatus = 'O' AS work_from_home,
       s.skills AS skills_required, s.qs AS source_queries,
       o.o_orderdate AS scraped_at, o.o_orderkey % 5 <> 0 AS is_snapshot,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderkey % 400 AS INTEGER) END AS posted_days_ago,
       CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(floor(o.o_totalprice / 50000) + 1 AS DOUBLE) END AS salary_min_lpa,
       CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(floor(o.o_totalprice / 40000) + 2 AS DOUBLE) END AS salary_max_lpa,
       CAST(s.np AS INTEGER) AS portal_count,
       CASE WHEN o.o_orderkey % 3 = 0 THEN concat('INR ', CAST(CAST(floor(o.o_totalprice * 10) AS BIGINT) AS VARCHAR), ' / year') END AS salary,
       CASE WHEN o.o_orderkey % 3 = 0 THEN concat('INR ', CAST(CAST(floor(o.o_totalprice * 10) AS BIGINT) AS VARCHAR), ' / year') END AS salary_raw,
       ([{_VIA_LIST}])[CAST(o.o_orderkey % {len(VIAS)} AS INTEGER) + 1] AS via,
       CASE WHEN o.o_orderkey % 7 <> 0 THEN concat('Site ', CAST(o.o_orderkey % 7 AS VARCHAR)) END AS via_platform,
       concat(s.pn, ' ', o.o_orderpriority, ' needs ', array_to_string(s.skills, ', ')) AS description,
       concat('https://jobs.example/', CAST(o.o_orderkey AS VARCHAR)) AS apply_link,
       concat(CAST(o.o_orderkey % 400 AS VARCHAR), ' days ago') AS posted_at,
       'Full-time' AS schedule_type
FROM orders o
JOIN (SELECT l_orderkey, list_sort(array_agg(DISTINCT p_brand)) AS skills,
             list_sort(array_agg(DISTINCT p_type)) AS qs, max(p_name) AS pn,
             count(DISTINCT l_suppkey) AS np
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def first_line(text):
    return F.split_part(text, F.lit("\n"), F.lit(1))


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings with only their text columns."""
    docs = documents(spark, sf_dir)
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("job_id"),
        first_line(F.col("text")).alias("title"),
        F.col("source").alias("company_name"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
    )


DOCUMENTS_SQL = r"""
docs AS (
SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS job_id,
       split_part(text, chr(10), 1) AS title,
       source AS company_name, lang AS location, text AS description, doc_id
FROM documents
)"""


# White space as the text derivations see it, for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{WS}+', ' ', 'g'))"


def skill_hit_sql(name: str, text: str, catalog: SkillCatalog = WORDS) -> str:
    """Whether a skill occurs; the boundaries are matched instead of looked at."""
    hits = []
    for form in catalog.forms(name):
        body = form.body.replace(r"\s", WS)
        if form.bounded:
            body = f"(^|[^a-zA-Z0-9_#+])({body})($|[^a-zA-Z0-9_#+])"
        hits.append(f"regexp_matches({text}, '{body}', '{'i' if form.any_case else 'c'}')")
    return "(" + " OR ".join(hits) + ")"


def skills_sql(text: str, catalog: SkillCatalog = WORDS) -> str:
    cases = ", ".join(f"CASE WHEN {skill_hit_sql(n, text, catalog)} THEN '{n}' END" for n in sorted(catalog.names))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


ASCII_DIGITS, DEVANAGARI, FULL_WIDTH = "0123456789", "०१२३४५६७८९", "０１２３４５６７८９"


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw upstream postings, with gaps, tags, pay texts and apply options by id."""
    d = F.col("doc_id")
    n = lambda k: (d % k).cast("string")
    ext = F.array(
        F.when(d % 3 == 0, F.concat(n(40), F.lit(" days ago"))),
        F.when(d % 3 == 1, F.concat(n(30), F.lit(" hours ago"))),
        F.when(d % 8 == 1, F.concat(F.lit("₹"), n(30), F.lit("L–₹"), n(45), F.lit("L a year"))),
        F.when(d % 8 == 2, F.concat(F.lit("₹"), n(90), F.lit(",000 a month"))),
        F.when(d % 8 == 3, F.concat(F.lit("INR "), n(40), F.lit(",00,000 / year"))),
        F.when(d % 8 == 4, F.lit("₹300 an hour")),
        F.when(d % 8 == 5, F.concat(F.lit("₹"), F.translate(n(30), ASCII_DIGITS, DEVANAGARI), F.lit("–१२० LPA"))),
        F.when(d % 9 == 0, F.lit("Work from home")),
        F.lit("Full-time"),
    )
    options = F.array(
        F.struct(F.lit("LinkedIn").alias("title"), F.concat(F.lit("https://linkedin.com/"), n(50)).alias("link")),
        F.struct(F.lit("Company").alias("title"), F.concat(F.lit("https://boards.greenhouse.io/"), n(3)).alias("link")),
        F.struct(F.lit(" linkedin ").alias("title"), F.concat(F.lit("https://linkedin.com/"), n(25)).alias("link")),
        F.struct(F.lit("Shine").alias("title"), F.lit(None).cast("string").alias("link")),
    )
    nothing = F.lit(None).cast("string")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.when(d % 4 != 0, F.concat(F.lit("tok"), d.cast("string"))).alias("job_id"),
        F.when(d % 11 != 0, first_line(F.col("text"))).alias("title"),
        F.when(d % 13 != 0, F.concat(F.lit("Company "), F.col("lang"))).alias("company_name"),
        F.when(F.col("lang") == "es", "Remote, India").when(F.col("lang") == "de", "Anywhere").when(F.col("lang") == "en", "Pune").alias("location"),
        F.when(d % 5 != 0, F.element_at(F.array(*[F.lit(v) for v in VIAS]), (d % len(VIAS)).cast("int") + 1)).alias("via"),
        F.col("text").alias("description"),
        F.array_compact(ext).alias("extensions"),
        F.slice(options, 1, (d % 5).cast("int")).alias("apply_options"),
        F.when(d % 20 == 1, "6.5 Lakhs / year").alias("salary"),
        F.when(d % 15 == 0, F.concat(F.lit("https://own/"), d.cast("string"))).alias("apply_link"),
        F.struct(
            F.when(d % 10 == 0, F.concat(F.lit(" "), n(5), F.lit(" weeks ago ")))
            .when(d % 10 == 7, F.concat(F.translate(n(70), ASCII_DIGITS, FULL_WIDTH), F.lit(" days ago"))).otherwise(nothing).alias("posted_at"),
            F.when(d % 16 == 5, F.concat(F.lit("₹"), n(50), F.lit("K–₹90K a month"))).otherwise(nothing).alias("salary"),
            F.when(d % 7 == 0, "Contract").otherwise(nothing).alias("schedule_type"),
            F.when(d % 14 == 0, F.lit(True)).alias("work_from_home"),
        ).alias("detected_extensions"),
        F.when(
            d % 6 == 0,
            F.array(F.struct(F.lit("Needs").alias("title"), F.array(F.lit("restful apis"), F.lit("Elle")).alias("items"))),
        ).alias("job_highlights"),
        F.concat(F.lit("2026-10-0"), (d % 9 + 1).cast("string"), F.lit("T10:00:00+00:00")).alias("captured_at"),
        F.col("source").alias("source_query"),
        F.lit("in").alias("source_gl"),
    )


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _mod(k: int) -> str:
    return f"CAST(doc_id % {k} AS VARCHAR)"


RAW_SQL = f"""
raw AS (
SELECT doc_id,
  CASE WHEN doc_id % 4 <> 0 THEN concat('tok', CAST(doc_id AS VARCHAR)) END AS job_id,
  CASE WHEN doc_id % 11 <> 0 THEN split_part(text, chr(10), 1) END AS title,
  CASE WHEN doc_id % 13 <> 0 THEN concat('Company ', lang) END AS company_name,
  CASE lang WHEN 'es' THEN 'Remote, India' WHEN 'de' THEN 'Anywhere' WHEN 'en' THEN 'Pune' END AS location,
  CASE WHEN doc_id % 5 <> 0 THEN ([{_VIA_LIST}])[CAST(doc_id % {len(VIAS)} AS INTEGER) + 1] END AS via,
  text AS description,
  list_filter([
    CASE WHEN doc_id % 3 = 0 THEN {_cat(_mod(40), "' days ago'")} END,
    CASE WHEN doc_id % 3 = 1 THEN {_cat(_mod(30), "' hours ago'")} END,
    CASE WHEN doc_id % 8 = 1 THEN {_cat("'₹'", _mod(30), "'L–₹'", _mod(45), "'L a year'")} END,
    CASE WHEN doc_id % 8 = 2 THEN {_cat("'₹'", _mod(90), "',000 a month'")} END,
    CASE WHEN doc_id % 8 = 3 THEN {_cat("'INR '", _mod(40), "',00,000 / year'")} END,
    CASE WHEN doc_id % 8 = 4 THEN '₹300 an hour' END,
    CASE WHEN doc_id % 8 = 5 THEN concat('₹', translate({_mod(30)}, '0123456789', '०१२३४५६७८९'), '–१२० LPA') END,
    CASE WHEN doc_id % 9 = 0 THEN 'Work from home' END,
    'Full-time'], lambda x: x IS NOT NULL) AS extensions,
  list_slice([
    {{'title': 'LinkedIn', 'link': {_cat("'https://linkedin.com/'", _mod(50))}}},
    {{'title': 'Company', 'link': {_cat("'https://boards.greenhouse.io/'", _mod(3))}}},
    {{'title': ' linkedin ', 'link': {_cat("'https://linkedin.com/'", _mod(25))}}},
    {{'title': 'Shine', 'link': CAST(NULL AS VARCHAR)}}], 1, doc_id % 5) AS apply_options,
  CASE WHEN doc_id % 20 = 1 THEN '6.5 Lakhs / year' END AS salary,
  CASE WHEN doc_id % 15 = 0 THEN concat('https://own/', CAST(doc_id AS VARCHAR)) END AS apply_link,
  CASE WHEN doc_id % 10 = 0 THEN {_cat("' '", _mod(5), "' weeks ago '")}
       WHEN doc_id % 10 = 7 THEN concat(translate({_mod(70)}, '0123456789', '０１２３４５６７８９'), ' days ago') END AS det_posted,
  CASE WHEN doc_id % 16 = 5 THEN {_cat("'₹'", _mod(50), "'K–₹90K a month'")} END AS det_salary,
  CASE WHEN doc_id % 7 = 0 THEN 'Contract' END AS det_schedule,
  coalesce(doc_id % 14 = 0, FALSE) AS det_wfh,
  CASE WHEN doc_id % 6 = 0 THEN 'restful apis Elle' ELSE '' END AS highlights,
  concat('2026-10-0', CAST(doc_id % 9 + 1 AS VARCHAR), 'T10:00:00+00:00') AS captured_at,
  source AS source_query, lang
FROM documents
)"""
