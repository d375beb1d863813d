"""Derivations of text and of raw postings, on the documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap import catalog
from skillgap.catalog import SKILLS, SkillCatalog
from skillgap.functions import postings as P
from skillgap.functions import recency as R
from skillgap.functions import salary as S
from skillgap.functions import text as X
from skillgap.functions.names import extract_names, mention_totals
from skillgap.operators import diagnostics as D
from skillgap.operators import resumes as Q
from skillgap.operators.market import mention_counts
from skillgap.plans.reports import as_rows
from skillgap.sources.scratch import scratch_path
from skillgap.sources.texts import read_resumes
from workload.registry import joined, query, stamp
from workload.views import (
    BASKET_SQL, DOCUMENTS_SQL, RAW_SQL, WORDS, WS, basket, document_postings, documents, norm_sql, raw_documents, skill_hit_sql, skills_sql,
    strip_sql, table,
)

NOW = dt.datetime(2026, 10, 9, 12, 0, 0)
RAW = f"WITH {RAW_SQL} "
DOCS = f"WITH {DOCUMENTS_SQL} "


def det(name: str):
    return F.col("detected_extensions")[name]


CANONICAL_SQL = (
    f"md5(concat({norm_sql('{t}')}, '|', {norm_sql('{c}')}, '|', {norm_sql('{l}')}, '|', substring({norm_sql('{d}')}, 1, 300)))"
)


def canonical_sql(t: str, c: str, loc: str, d: str) -> str:
    # Not str.format: the white-space class holds braces.
    return CANONICAL_SQL.replace("{t}", t).replace("{c}", c).replace("{l}", loc).replace("{d}", d)


TITLE_SQL = "coalesce(title, 'Untitled Role')"
COMPANY_SQL = "coalesce(company_name, 'Unknown Company')"
PLACE_SQL = "coalesce(location, '')"
ID_SQL = canonical_sql(TITLE_SQL, COMPANY_SQL, PLACE_SQL, "coalesce(description, '')")


def raw(spark, sf):
    return raw_documents(spark, sf)


def raw_with_defaults(spark, sf):
    df = raw(spark, sf).withColumns({"schedule_type": det("schedule_type"), "posted_at": det("posted_at")})
    return df.withColumns(P.with_defaults())


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS normalized, length({norm_sql('text')}) AS chars FROM documents")
def _(spark, sf):
    normal = X.normalize_text(F.col("text"))
    return documents(spark, sf).select("doc_id", F.md5(normal).alias("normalized"), F.length(normal).cast("bigint").alias("chars"))


@query("canonical_id", DOCS + f"SELECT job_id, {canonical_sql('title', 'company_name', 'location', 'description')} AS id FROM docs")
def _(spark, sf):
    c = [F.col(x) for x in ("title", "company_name", "location", "description")]
    return document_postings(spark, sf).select("job_id", X.canonical_id(*c).alias("id"))


@query("choose_id", RAW + f"""
SELECT doc_id, CASE WHEN job_id IS NOT NULL THEN {ID_SQL} ELSE concat('given', CAST(doc_id AS VARCHAR)) END AS id FROM raw""")
def _(spark, sf):
    df = raw_with_defaults(spark, sf)
    given = F.concat(F.lit("given"), F.col("doc_id").cast("string"))
    return df.select("doc_id", P.choose_id(F.col("job_id"), given).alias("id"))


@query("defaults", RAW + f"""
SELECT doc_id, {TITLE_SQL} AS title, {COMPANY_SQL} AS company_name, {PLACE_SQL} AS location, coalesce(via, 'Direct') AS via,
       coalesce(det_schedule, 'Full-time') AS schedule_type, coalesce(det_posted, '') AS posted_at FROM raw""")
def _(spark, sf):
    return raw_with_defaults(spark, sf).select("doc_id", "title", "company_name", "location", "via", "schedule_type", "posted_at")


REMOTE_SQL = (
    "(det_wfh OR list_contains(list_transform(extensions, lambda e: lower(e) LIKE '%work from home%'), TRUE) "
    "OR lower(coalesce(location, '')) LIKE '%remote%' OR lower(coalesce(location, '')) LIKE '%anywhere%')"
)


@query("remote_flag", RAW + f"SELECT doc_id, {REMOTE_SQL} AS remote, CASE WHEN {REMOTE_SQL} THEN 'Remote' ELSE 'On-site' END AS location_type FROM raw")
def _(spark, sf):
    remote = P.remote_flag(det("work_from_home"), F.col("extensions"), F.col("location"))
    return raw(spark, sf).select("doc_id", remote.alias("remote"), F.when(remote, "Remote").otherwise("On-site").alias("location_type"))


COMBINED_SQL = f"concat({TITLE_SQL}, ' ', description, ' ', highlights)"


@query("combined_text", RAW + f"SELECT doc_id, md5({COMBINED_SQL}) AS combined FROM raw")
def _(spark, sf):
    df = raw_with_defaults(spark, sf)
    combined = X.combined_text(F.col("title"), F.col("description"), P.highlights_text(F.col("job_highlights")))
    return df.select("doc_id", F.md5(combined).alias("combined"))


@query("extract_skills", f"SELECT doc_id, array_to_string({skills_sql('text')}, '|') AS skills FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", joined(X.extract_skills(F.col("text"), WORDS)).alias("skills"))


# Names a candidate may have typed: the first word of each document, some padded or prefixed.
_NAME_SQL = f"""
names AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(' ', w, ' ') WHEN doc_id % 7 = 0 THEN concat('senior rest ', w)
  WHEN doc_id % 11 = 0 THEN 'la' WHEN doc_id % 17 = 0 THEN 'LA' WHEN doc_id % 19 = 0 THEN '' ELSE w END AS name
  FROM (SELECT doc_id, split_part(split_part(text, chr(10), 1), ' ', 1) AS w FROM documents))"""


def _typed_name():
    d, w = F.col("doc_id"), F.split_part(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1))
    return (
        F.when(d % 5 == 0, F.concat(F.lit(" "), w, F.lit(" ")))
        .when(d % 7 == 0, F.concat(F.lit("senior rest "), w))
        .when(d % 11 == 0, "la").when(d % 17 == 0, "LA").when(d % 19 == 0, "").otherwise(w)
    )


def resolve_sql(name: str) -> str:
    clean = strip_sql(name)
    exact = " ".join(f"WHEN lower({clean}) = '{n.lower()}' THEN '{n}'" for n in WORDS.names if not WORDS.is_acronym(n))
    patterns = []
    for n in WORDS.resolution_order():
        if WORDS.is_acronym(n):
            patterns.append(f"WHEN regexp_full_match({clean}, '(?i){WORDS.long_forms[n]}') THEN '{n}'")
        else:
            patterns.append(f"WHEN {skill_hit_sql(n, clean)} THEN '{n}'")
    refused = " ".join(f"WHEN lower({clean}) = '{n.lower()}' AND {clean} <> '{n}' THEN NULL WHEN {clean} = '{n}' THEN '{n}'" for n in WORDS.long_forms)
    return f"CASE WHEN {clean} = '' THEN NULL {refused} {exact} {' '.join(patterns)} END"


@query("resolve_skill", f"WITH {_NAME_SQL} SELECT doc_id, name, {resolve_sql('name')} AS canonical FROM names")
def _(spark, sf):
    names = documents(spark, sf).select("doc_id", _typed_name().alias("name"))
    return Q.resolve_skills(names, WORDS)


_CANDIDATES_SQL = f"""
WITH {_NAME_SQL}, c AS (
  SELECT d.doc_id AS candidate_id, CASE WHEN d.doc_id % 3 <> 0 THEN text END AS resume_text,
         CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 10 = 1 THEN [name, 'REST api', 'thatin', 'no such thing', 'Rest API'] END AS typed
  FROM documents d JOIN names USING (doc_id)),
resolved AS (
  SELECT *, {skills_sql('resume_text')} AS from_text, {resolve_sql('typed[1]')} AS first FROM c),
s AS (
  SELECT *, CASE WHEN (resume_text IS NULL) = (typed IS NULL) THEN 'provide_one' WHEN resume_text IS NOT NULL AND len(from_text) = 0 THEN 'no_recognized_skills' ELSE 'ok' END AS status,
    CASE WHEN first IS NULL OR first = 'REST API' THEN ['REST API', 'thatin'] WHEN first = 'thatin' THEN ['thatin', 'REST API'] ELSE [first, 'REST API', 'thatin'] END AS from_list
  FROM resolved)
SELECT candidate_id, CASE WHEN status <> 'ok' THEN '' WHEN resume_text IS NOT NULL THEN array_to_string(from_text, '|') ELSE array_to_string(from_list, '|') END AS skills,
  CASE WHEN status = 'ok' AND typed IS NOT NULL THEN CASE WHEN first IS NULL THEN concat(typed[1], '|no such thing') ELSE 'no such thing' END ELSE '' END AS ignored, status FROM s"""


@query("candidate_skills", _CANDIDATES_SQL)
def _(spark, sf):
    d = F.col("doc_id")
    typed = F.array(_typed_name(), *[F.lit(x) for x in ("REST api", "thatin", "no such thing", "Rest API")])
    df = documents(spark, sf).select(
        d.alias("candidate_id"),
        F.when(d % 3 != 0, F.col("text")).alias("resume_text"),
        F.when((d % 3 == 0) | (d % 10 == 1), typed).alias("skills"),
    )
    return Q.candidate_skills(df, WORDS).withColumns({"skills": joined("skills"), "ignored": joined("ignored")})


_WORDS_OUT = ", ".join(f"'{w}'" for w in catalog.RELATIVE_TIME_WORDS + catalog.NON_SALARY_WORDS)


def clean_sql(c: str) -> str:
    t = strip_sql(c)
    return (
        f"CASE WHEN {t} <> '' AND lower({t}) NOT IN ({_WORDS_OUT}) "
        rf"AND NOT regexp_matches(lower({t}), '^\d+\s+(minute|hour|day|week|month)s?\s+ago$') THEN {t} END"
    )


@query("clean_salary", RAW + f"""
, e AS (SELECT doc_id, unnest(extensions) AS e, generate_subscripts(extensions, 1) AS place FROM raw)
SELECT doc_id, CAST(place AS INTEGER) AS place, {clean_sql('e')} AS salary FROM e""")
def _(spark, sf):
    each = raw(spark, sf).select("doc_id", F.posexplode("extensions").alias("place", "e"))
    return each.select("doc_id", (F.col("place") + 1).alias("place"), S.clean_salary(F.col("e")).alias("salary"))


PAY_MARK = r"(?i)(₹|INR|\bRs\.?\s*\d|\bLPA\b|\blakhs?\b|\b(a|per|/)\s*(year|annum|month|hour)\b)"
PICK_SQL = (
    f"coalesce({clean_sql('coalesce(det_salary, salary)')}, "
    f"list_filter(list_transform(extensions, lambda e: {clean_sql('e')}), lambda e: e IS NOT NULL AND regexp_matches(e, '{PAY_MARK}'))[1])"
)


@query("pick_salary", RAW + f"SELECT doc_id, {PICK_SQL} AS salary FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("doc_id", S.pick_salary(det("salary"), F.col("salary"), F.col("extensions")).alias("salary"))


# The pay texts of the raw view and a few more forms, parsed by the same precedence in SQL.
def digits_sql(c: str) -> str:
    return f"translate({c}, '०१२३४५६७८९０１２３４５６７８９', '01234567890123456789')"


# Every form in full, as RE2 reads it.
_K_YEAR = r"(?i)(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*k\s*(?:-\s*(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*k)?\s*(?:a\s+year|/\s*year|per\s+annum|per\s+year|\bannually\b)"
_K_MONTH = r"(?i)(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*k\s*(?:-\s*(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*k)?\s*(?:a\s+month|/\s*month|per\s+month|\bmonthly\b)"
_LAKH_MONTH = r"(?i)(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*(?:LPA|lakhs?|lacs?|lac|L)\s*(?:-\s*(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*(?:LPA|lakhs?|lacs?|lac|L)?)?\s*(?:a\s+month|/\s*month|per\s+month|\bmonthly\b)"
_LAKH_YEAR = r"(?i)(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*(?:LPA|lakhs?|lacs?|lac|L)?\s*(?:-\s*(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*)?\s*(?:LPA|lakhs?|lacs?|lac|L)\b"
_RUPEES_MONTH = r"(?i)(?:₹|INR|Rs\.?)\s*(\d+(?:\.\d+)?)\s*(?:-\s*(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*)?\s*(?:a\s+month|/\s*month|per\s+month|\bmonthly\b)"
_RUPEES_YEAR = r"(?i)(?:₹|INR|Rs\.?)\s*(\d+(?:\.\d+)?)\s*(?:-\s*(?:₹|INR|Rs\.?)?\s*(\d+(?:\.\d+)?)\s*)?\s*(?:a\s+year|/\s*year|per\s+annum|per\s+year|\bannually\b)"
_SAYS_MONTH = r"\b(?:a\s+month|/\s*month|per\s+month|\bmonthly\b)"


def lpa_sql(c: str) -> str:
    """SELECT-able CASE chain giving [min, max] or NULL."""
    norm = digits_sql(f"replace(replace(replace(replace({strip_sql(c)}, '–', '-'), '—', '-'), chr(160), ' '), ',', '')")

    def branch(pattern, expr, extra="", raw_check=False):
        low = f"CAST(nullif(regexp_extract({norm}, '{pattern}', 1), '') AS DOUBLE)"
        high = f"coalesce(CAST(nullif(regexp_extract({norm}, '{pattern}', 2), '') AS DOUBLE), {low})"
        a, b = expr.replace("v", low), expr.replace("v", high)
        ra, rb = (a, b) if raw_check else (f"round({a}, 2)", f"round({b}, 2)")
        ok = f"{ra} BETWEEN 1 AND 200 AND {rb} BETWEEN 1 AND 200"
        return f"WHEN regexp_matches({norm}, '{pattern}') {extra} THEN CASE WHEN {ok} THEN [round({a}, 2), round({b}, 2)] END"

    first_yearly = f"CAST(nullif(regexp_extract({norm}, '{_RUPEES_YEAR}', 1), '') AS DOUBLE)"
    marks = " OR ".join(f"contains(lower({c}), '{m}')" for m in catalog.RUPEE_MARKS)
    foreign = " OR ".join(f"contains({c}, '{m}')" for m in catalog.FOREIGN_CURRENCY_MARKS)
    branches = [
        branch(_K_YEAR, "(v * 1000 / 100000.0::DOUBLE)"),
        branch(_K_MONTH, "(v * 1000 * 12 / 100000.0::DOUBLE)"),
        branch(_LAKH_MONTH, "(v * 12.0::DOUBLE)"),
        branch(_LAKH_YEAR, "(v)", f"AND NOT regexp_matches({norm}, '{_SAYS_MONTH}')", True),
        branch(_RUPEES_MONTH, "(v * 12 / 100000.0::DOUBLE)"),
        branch(_RUPEES_YEAR, "(v / 100000.0::DOUBLE)", f"AND {first_yearly} >= 100000"),
    ]
    return (
        rf"CASE WHEN {c} IS NULL OR regexp_matches({c}, '(?i)\b(hour|hr|day|daily)\b') OR {foreign} OR NOT ({marks}) THEN NULL "
        + " ".join(branches) + " END"
    )


_PAY_TEXT_SQL = """
pay AS (SELECT doc_id, unnest(list_concat(extensions, [salary, det_salary, concat('Rs. ', CAST(doc_id * 7 AS VARCHAR), ' per annum'),
   concat(CAST(doc_id % 250 AS VARCHAR), '.5 - ', CAST(doc_id % 300 AS VARCHAR), ' LPA'), concat('$', CAST(doc_id AS VARCHAR), 'K a year')])) AS pay FROM raw)"""


@query("salary_lpa", RAW + "," + _PAY_TEXT_SQL + f"""
, parsed AS (SELECT doc_id, pay, {lpa_sql('pay')} AS lpa FROM pay WHERE pay IS NOT NULL)
SELECT doc_id, pay, lpa[1] AS min_lpa, lpa[2] AS max_lpa FROM parsed""")
def _(spark, sf):
    d = F.col("doc_id").cast("bigint")
    pays = F.concat(
        "extensions",
        F.array(
            F.col("salary"), det("salary"),
            F.concat(F.lit("Rs. "), (d * 7).cast("string"), F.lit(" per annum")),
            F.concat((d % 250).cast("string"), F.lit(".5 - "), (d % 300).cast("string"), F.lit(" LPA")),
            F.concat(F.lit("$"), d.cast("string"), F.lit("K a year")),
        ),
    )
    rows = raw(spark, sf).select("doc_id", F.explode(pays).alias("pay")).where("pay IS NOT NULL")
    return rows.withColumn("lpa", S.salary_lpa(F.col("pay"))).select(
        "doc_id", "pay", F.col("lpa.min").alias("min_lpa"), F.col("lpa.max").alias("max_lpa")
    )


_TIME_OF = rf"lower(e) IN ('just now', 'yesterday', 'today') OR regexp_matches(lower(e), '\b(hour|day|week|month|year)s?\s+ago\b') OR regexp_matches(lower(e), '^\d+\s+(minute|hour|day|week|month|year)s?\s+ago$')"
POSTED_SQL = f"coalesce(nullif({strip_sql('det_posted')}, ''), list_filter(list_transform(extensions, lambda e: {strip_sql('e')}), lambda e: {_TIME_OF})[1], '')"


def age_sql(posted: str) -> str:
    c = digits_sql(posted)
    units = " ".join(
        rf"WHEN regexp_matches(lower({c}), '\d+\s+{u}') THEN CAST(regexp_extract(lower({c}), '(\d+)\s+{u}', 1) AS INTEGER) * {k}"
        for u, k in (("day", 1), ("week", 7), ("month", 30), ("year", 365))
    )
    return (
        f"CASE WHEN {c} LIKE '%hour%' OR {c} LIKE '%minute%' OR {c} LIKE '%today%' OR {c} LIKE '%just now%' THEN 0 "
        f"WHEN {c} LIKE '%yesterday%' THEN 1 {units} END"
    )


@query("pick_posted_at", RAW + f"SELECT doc_id, {POSTED_SQL} AS posted_at FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("doc_id", R.pick_posted_at(det("posted_at"), F.col("extensions")).alias("posted_at"))


@query("age_days", RAW + f", p AS (SELECT doc_id, {POSTED_SQL} AS posted FROM raw) SELECT doc_id, posted, {age_sql('posted')} AS days FROM p")
def _(spark, sf):
    posted = R.pick_posted_at(det("posted_at"), F.col("extensions"))
    return raw(spark, sf).select("doc_id", posted.alias("posted")).withColumn("days", R.age_days(F.col("posted")))


FALLBACK_SQL = "CAST(greatest(0, floor(epoch(TIMESTAMP '2026-10-09 12:00:00' - CAST(captured_at AS TIMESTAMP)) / 86400)) AS INTEGER)"


@query("age_fallback", RAW + f"SELECT doc_id, {FALLBACK_SQL} AS days FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("doc_id", R.age_fallback(F.col("captured_at"), NOW).alias("days"))


LINK_SQL = "coalesce(apply_link, CASE WHEN len(apply_options) > 0 THEN apply_options[1].link ELSE '' END)"
PORTALS_SQL = "CASE WHEN len(apply_options) > 0 THEN CAST(len(list_distinct(list_transform(apply_options, lambda o: coalesce(o.link, o.title)))) AS INTEGER) ELSE 1 END"


@query("apply_link_portals", RAW + f"SELECT doc_id, {LINK_SQL} AS apply_link, {PORTALS_SQL} AS portal_count FROM raw")
def _(spark, sf):
    options = F.col("apply_options")
    return raw(spark, sf).select(
        "doc_id", P.apply_link(F.col("apply_link"), options).alias("apply_link"), P.portal_count(options).alias("portal_count")
    )


@query("source_list", RAW + """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('q|', source_query) ELSE concat(source_query, '|q') END AS phrases FROM raw""")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" q "), F.lit(""))).otherwise(F.array("source_query", F.lit("q")))
    return raw(spark, sf).select("doc_id", joined(P.source_list(given, F.col("source_query"))).alias("phrases"))


_INSTANT_TEXTS = "[captured_at, replace(captured_at, '+00:00', 'Z'), replace(captured_at, '+00:00', '+05:30'), 'soon', CAST(NULL AS VARCHAR)]"


@query("parse_instant", RAW + f"""
, t AS (SELECT doc_id, unnest({_INSTANT_TEXTS}) AS text, CAST(captured_at AS TIMESTAMP) AS moment FROM raw)
SELECT doc_id, text, CASE WHEN text LIKE '%+05:30' THEN strftime(moment - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') WHEN text LIKE '%T%' THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS instant FROM t""")
def _(spark, sf):
    c = F.col("captured_at")
    texts = F.array(
        c, F.replace(c, F.lit("+00:00"), F.lit("Z")), F.replace(c, F.lit("+00:00"), F.lit("+05:30")), F.lit("soon"),
        F.lit(None).cast("string"),
    )
    return raw(spark, sf).select("doc_id", F.explode(texts).alias("text")).withColumn("instant", stamp(R.parse_instant(F.col("text"))))


_RANK_SQL = "CASE WHEN o.link LIKE '%greenhouse.io%' THEN 0 WHEN lower(o.title) LIKE '%linkedin%' THEN 1 WHEN o.title = 'Shine' THEN 4 ELSE 3 END"


@query("rank_portals", RAW + f"""
, o AS (SELECT doc_id, unnest(apply_options) AS o, generate_subscripts(apply_options, 1) AS pos FROM raw)
SELECT doc_id, coalesce(portals, '') AS portals FROM raw LEFT JOIN (
  SELECT doc_id, string_agg(o.title, '|' ORDER BY {_RANK_SQL}, pos) AS portals FROM o GROUP BY doc_id) USING (doc_id)""")
def _(spark, sf):
    options = F.col("apply_options")
    ranked = P.rank_portals(options)
    return raw(spark, sf).select("doc_id", joined(F.transform(ranked, lambda o: o["title"])).alias("portals"))


@query("union_by_publisher", RAW + """
, o AS (SELECT doc_id, unnest(apply_options) AS o, generate_subscripts(apply_options, 1) AS pos FROM raw),
k AS (SELECT doc_id, lower(trim(coalesce(o.title, o.link))) AS pub, min(pos) AS pos, arg_min(coalesce(o.link, ''), pos) AS link FROM o GROUP BY ALL)
SELECT doc_id, coalesce(options, '') AS options, coalesce(portals, 0) AS portals FROM raw LEFT JOIN (
  SELECT doc_id, string_agg(concat(pub, '>', link), '|' ORDER BY pos) AS options, CAST(count(*) AS INTEGER) AS portals FROM k GROUP BY doc_id) USING (doc_id)""")
def _(spark, sf):
    merged = P.union_by_publisher(F.col("apply_options"))
    shown = F.transform(merged, lambda o: F.concat(P.publisher(o), F.lit(">"), F.coalesce(o["link"], F.lit(""))))
    return raw(spark, sf).select("doc_id", joined(shown).alias("options"), F.size(merged).alias("portals"))


@query("cache_key", RAW + f"""
SELECT doc_id, sha256(concat(lower({strip_sql('source_query')}), '|', lower(coalesce(location, '')), '|', 'in', '|', lang, '|', CASE WHEN doc_id % 2 = 0 THEN 'week' ELSE '' END)) AS key FROM raw""")
def _(spark, sf):
    df = raw(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    recency = F.when(F.col("doc_id") % 2 == 0, "week")
    key = X.cache_key(F.concat(F.lit(" "), F.upper("source_query")), F.col("location"), F.lit(None).cast("string"), F.col("lang"), recency)
    return df.select("doc_id", key.alias("key"))


def _edges(pattern: str) -> str:
    """Word edges beyond ASCII, matched instead of looked at."""
    word = r"[\p{L}\p{N}_]".replace("[", "[^")
    return pattern.replace(r"\b(", f"(^|{word})(", 1)[: -len(r"\b")] + f"($|{word})"


_GATE_SQL = f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' Education. Skills. ') WHEN doc_id % 3 = 1 THEN concat(text, ' Education. Skills. Engineer at a college') ELSE text END AS text FROM documents),
s AS (SELECT doc_id AS id, {strip_sql('text')} AS text FROM t),
g AS (SELECT id, length(text) AS chars, {skills_sql('text')} AS skills,
  {' + '.join(f"CAST(regexp_matches(text, '{_edges(p)}', 'i') AS INTEGER)" for p in catalog.RESUME_SECTIONS)} AS sections,
  {' OR '.join([f"regexp_matches(text, '{p}')" for p in catalog.RESUME_IDENTIFIERS_EXACT_CASE] + [f"regexp_matches(text, '{_edges(p)}', 'i')" for p in catalog.RESUME_IDENTIFIERS])} AS identified FROM s),
r AS (SELECT *, CASE WHEN chars < 80 THEN 'no_extractable_text' WHEN sections < 2 THEN 'not_resume_structure' WHEN NOT identified THEN 'no_identifiers' WHEN len(skills) < 2 THEN 'too_few_skills' END AS reason FROM g)
SELECT id, reason IS NULL AS accepted, reason, array_to_string(skills, '|') AS skills, CAST(chars AS INTEGER) AS char_count FROM r"""


@query("resume_gate", _GATE_SQL)
def _(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    extra = F.when(d % 3 == 0, " Education. Skills. ").when(d % 3 == 1, " Education. Skills. Engineer at a college").otherwise("")
    df = documents(spark, sf).select(d.alias("id"), F.concat(text, extra).alias("text"))
    return Q.resume_gate(df, WORDS).withColumn("skills", joined("skills"))


@query("resume_gate_conversations", _GATE_SQL.replace("FROM documents", "FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"))
def _(spark, sf):
    talk = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    d, text = F.col("doc_id"), F.col("text")
    extra = F.when(d % 3 == 0, " Education. Skills. ").when(d % 3 == 1, " Education. Skills. Engineer at a college").otherwise("")
    df = talk.select(d.alias("id"), F.concat(text, extra).alias("text"))
    return Q.resume_gate(df, WORDS).withColumn("skills", joined("skills"))


_ALL_NAMES = "[" + ", ".join(f"'{n}'" for n in WORDS.names) + "]"


@query("match_summary", f"""
WITH m AS (SELECT doc_id, {skills_sql('text')} AS held FROM documents)
SELECT doc_id, array_to_string(held, '|') AS matched, array_to_string(list_filter({_ALL_NAMES}, lambda s: NOT list_contains(held, s))[1:8], '|') AS missing,
       CAST(least(2 * floor(len(held) / {len(WORDS.names)} * 100), 100) AS INTEGER) AS score FROM m""")
def _(spark, sf):
    summary = Q.match_summary(documents(spark, sf).select("doc_id", "text"), WORDS)
    return summary.select("doc_id", joined("matched_skills").alias("matched"), joined("missing_skills").alias("missing"), F.col("match_score_percentage").alias("score"))


_RESUME = "Knows REST api and hehely, thatin too"


@query("match_resume", DOCS + f"""
, dated AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 100) AS scraped_at FROM docs)
, best AS (SELECT job_id, title, company_name, location, row_number() OVER (ORDER BY scraped_at DESC, job_id) AS place FROM dated
  WHERE lower(description) LIKE '%hehely%' OR lower(description) LIKE '%rest api%' OR lower(description) LIKE '%thatin%'),
held AS (SELECT ['Hehely', 'REST API', 'thatin'] AS h)
SELECT 'summary' AS part, 'matched_skills' AS key, array_to_string(h, '|') AS value FROM held
UNION ALL SELECT 'summary', 'missing_skills', array_to_string(list_filter({_ALL_NAMES}, lambda s: NOT list_contains(h, s))[1:8], '|') FROM held
UNION ALL SELECT 'summary', 'match_score_percentage', CAST(CAST(least(2 * floor(len(h) / {len(WORDS.names)} * 100), 100) AS INTEGER) AS VARCHAR) FROM held
UNION ALL SELECT 'postings', concat(CAST(place AS VARCHAR), '/', k), CASE k WHEN 'job_id' THEN job_id WHEN 'title' THEN title WHEN 'company_name' THEN company_name ELSE location END
FROM best, (SELECT unnest(['job_id', 'title', 'company_name', 'location']) AS k) WHERE place <= 6""")
def _(spark, sf):
    jobs = document_postings(spark, sf).withColumns(
        {
            "scraped_at": F.timestamp_add("HOUR", (F.col("job_id").cast("int") % 100), F.lit("2024-01-01").cast("timestamp_ntz")),
            **{c: F.lit(None).cast("string") for c in ("via", "apply_link", "salary", "schedule_type")},
        }
    )
    summary, found = Q.match_resume(jobs, _RESUME, WORDS)
    # Six rows; numbered as they stand.
    numbered = found.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    return as_rows({
        "summary": (summary, None, {
            "matched_skills": joined("matched_skills"), "missing_skills": joined("missing_skills"),
            "match_score_percentage": F.col("match_score_percentage")}),
        "postings": (numbered, "place", {c: F.col(c) for c in ("job_id", "title", "company_name", "location")}),
    })


# Every document is a resume, and every document a posting.
@query("match_resumes", DOCS + f"""
, dated AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 100) AS scraped_at FROM docs)
, m AS (SELECT doc_id, {skills_sql('text')} AS held FROM documents)
, said AS (SELECT job_id, scraped_at, list(skill) AS said FROM (SELECT job_id, scraped_at, description, unnest({_ALL_NAMES}) AS skill FROM dated)
  WHERE contains(lower(description), lower(skill)) GROUP BY ALL)
, ranked AS (SELECT held, job_id, row_number() OVER (PARTITION BY held ORDER BY scraped_at DESC, job_id) AS place
  FROM (SELECT DISTINCT held FROM m) JOIN said ON list_has_any(held, said))
, rec AS (SELECT held, string_agg(job_id, '|' ORDER BY place) AS ids FROM ranked WHERE place <= 6 GROUP BY held)
SELECT doc_id, array_to_string(held, '|') AS matched, CAST(least(2 * floor(len(held) / {len(WORDS.names)} * 100), 100) AS INTEGER) AS score,
  coalesce(ids, '') AS recommended
FROM m LEFT JOIN rec USING (held)""")
def _(spark, sf):
    jobs = document_postings(spark, sf).withColumns(
        {
            "scraped_at": F.timestamp_add("HOUR", (F.col("job_id").cast("int") % 100), F.lit("2024-01-01").cast("timestamp_ntz")),
            **{c: F.lit(None).cast("string") for c in ("via", "apply_link", "salary", "schedule_type")},
        }
    )
    found = Q.match_resumes(jobs, documents(spark, sf).select(F.col("doc_id").alias("candidate_id"), "text"), WORDS)
    return found.select(
        F.col("candidate_id").alias("doc_id"), joined("matched_skills").alias("matched"), F.col("match_score_percentage").alias("score"),
        joined(F.transform("recommended", lambda p: p["job_id"])).alias("recommended"),
    )


def _mentions_sql(names: SkillCatalog = WORDS) -> str:
    """Each boundary character is doubled, so that two neighbouring mentions do not share one.

    Real names hold such characters themselves; they never stand side by side here.
    """
    subject = "wide" if names is WORDS else "text"
    counts = []
    for i, n in enumerate(names.names):
        parts = []
        for form in names.forms(n):
            flag = "i" if form.any_case else "c"
            body = form.body.replace(r"\s", WS)
            if form.bounded:
                body = f"(^|[^a-zA-Z0-9_#+])({body})($|[^a-zA-Z0-9_#+])"
                parts.append(f"len(regexp_extract_all({subject}, '{body}', 0, '{flag}'))")
            else:
                parts.append(f"len(regexp_extract_all(text, '{body}', 0, '{flag}'))")
        counts.append(f"SELECT '{n}' AS skill, CAST(sum({' + '.join(parts)}) AS BIGINT) AS count FROM w")
    return " UNION ALL ".join(counts)


@query("mention_counts", DOCS + r"""
, t AS (SELECT concat(title, ' ', description, ' ') AS text FROM docs),
w AS (SELECT text, regexp_replace(text, '([^a-zA-Z0-9_#+])', '\1\1', 'g') AS wide FROM t),
c AS (""" + _mentions_sql() + ") SELECT skill, count FROM c WHERE count > 0")
def _(spark, sf):
    return mention_counts(document_postings(spark, sf), WORDS)


def _with_names(text, key):
    """Two real skill names, by row, in the middle of words of the text's own."""
    names = F.array(*[F.lit(n) for n in SKILLS.names])
    pick = lambda k: F.element_at(names, (k % len(SKILLS.names) + 1).cast("int"))
    return F.concat(F.lit("Knows "), pick(key), F.lit(" and ("), pick(key * 7 + 3), F.lit("). "), text)


_REAL_NAMES = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in SKILLS.names) + "]"
_NAMED_SQL = f"""WITH named AS (SELECT doc_id, concat('Knows ', {_REAL_NAMES}[doc_id % {len(SKILLS.names)} + 1], ' and (',
  {_REAL_NAMES}[(doc_id * 7 + 3) % {len(SKILLS.names)} + 1], '). ', text) AS text FROM documents)"""


@query("extract_skills_full", _NAMED_SQL + f" SELECT doc_id, array_to_string({skills_sql('text', SKILLS)}, '|') AS skills FROM named")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", _with_names(F.col("text"), F.col("doc_id")).alias("text"))
    return docs.select("doc_id", joined(X.extract_skills(F.col("text"), SKILLS)).alias("skills"))


@query("mention_counts_full", _NAMED_SQL + r"""
, t AS (SELECT concat(' ', text, '  ') AS text FROM named),
w AS (SELECT text, regexp_replace(text, '([^a-zA-Z0-9_#+])', '\1\1', 'g') AS wide FROM t),
c AS (""" + _mentions_sql(SKILLS) + ") SELECT skill, count FROM c WHERE count > 0")
def _(spark, sf):
    docs = documents(spark, sf).select(F.lit("").alias("title"), _with_names(F.col("text"), F.col("doc_id")).alias("description"))
    return mention_counts(docs, SKILLS)


# The same by one automaton over all names.
@query("extract_names_full", _NAMED_SQL + f" SELECT doc_id, array_to_string({skills_sql('text', SKILLS)}, '|') AS skills FROM named")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", _with_names(F.col("text"), F.col("doc_id")).alias("text"))
    return docs.select("doc_id", joined(extract_names(F.col("text"), SKILLS)).alias("skills"))


@query("mention_totals_full", _NAMED_SQL + r"""
, t AS (SELECT concat(' ', text, '  ') AS text FROM named),
w AS (SELECT text, regexp_replace(text, '([^a-zA-Z0-9_#+])', '\1\1', 'g') AS wide FROM t),
c AS (""" + _mentions_sql(SKILLS) + ") SELECT skill, count FROM c WHERE count > 0")
def _(spark, sf):
    docs = documents(spark, sf).select(F.lit("").alias("title"), _with_names(F.col("text"), F.col("doc_id")).alias("description"))
    return mention_totals(docs, SKILLS)


_PREFIX = f"substring({norm_sql('description')}, 1, 300)"
# Every document a second time under another id, with a word more in its text, so that groups arise.
_NEAR_SQL = DOCS + f"""
, twice AS (SELECT job_id, title, company_name, location, description FROM docs
  UNION ALL SELECT concat('x', job_id), title, company_name, location, concat('Again ', description) FROM docs),
k AS (SELECT job_id, {norm_sql('title')} AS t, {norm_sql('company_name')} AS c, {norm_sql('location')} AS l, {_PREFIX} AS prefix FROM twice),
g AS (SELECT t, c, l, min(job_id) AS first_id, count(*) AS group_size, arg_min(prefix, job_id) AS first_prefix FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT first_id, job_id, group_size,
  CAST(CASE WHEN prefix <> first_prefix THEN list_filter(range(1, 302), lambda i: substring(prefix, i, 1) <> substring(first_prefix, i, 1))[1] - 1 END AS INTEGER) AS differs_at
FROM k JOIN g USING (t, c, l) WHERE job_id <> first_id"""


@query("near_duplicates", _NEAR_SQL)
def _(spark, sf):
    jobs = document_postings(spark, sf)
    again = jobs.withColumns({"job_id": F.concat(F.lit("x"), "job_id"), "description": F.concat(F.lit("Again "), "description")})
    return D.near_duplicates(jobs.unionByName(again))


# Titles of the items: one word or a mark apart within a company and a place.
@query("near_titles", f"""
WITH RECURSIVE {BASKET_SQL},
t AS (SELECT {norm_sql('company_name')} AS company_key, {norm_sql('location')} AS location_key, {norm_sql('title')} AS title_key, count(*) AS postings FROM jobs GROUP BY ALL),
l AS (SELECT a.company_key, a.location_key, a.title_key, b.title_key AS other FROM t a JOIN t b
  ON a.company_key = b.company_key AND a.location_key = b.location_key AND a.title_key <> b.title_key AND abs(length(a.title_key) - length(b.title_key)) <= 2
  WHERE levenshtein(a.title_key, b.title_key) <= 2),
reached AS (SELECT company_key, location_key, title_key, title_key AS first_title FROM t
  UNION SELECT l.company_key, l.location_key, l.title_key, r.first_title FROM l JOIN reached r ON l.company_key = r.company_key AND l.location_key = r.location_key AND l.other = r.title_key),
firsts AS (SELECT company_key, location_key, title_key, min(first_title) AS first_title FROM reached GROUP BY ALL),
counted AS (SELECT company_key, location_key, title_key, count(*) AS titles FROM l GROUP BY ALL)
SELECT company_key, location_key, title_key, first_title, postings, coalesce(titles, 0) AS titles
FROM t JOIN firsts USING (company_key, location_key, title_key) LEFT JOIN counted USING (company_key, location_key, title_key)""")
def _(spark, sf):
    return D.near_titles(basket(spark, sf), most=2)


_ZERO = "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]"


@query("zero_width_scan", DOCS + f"""
, m AS (SELECT title, concat(description, CASE WHEN doc_id % 5 = 0 THEN chr(8203) || chr(65279) ELSE '' END) AS description FROM docs)
SELECT 'title' AS field, CAST(sum(len(regexp_extract_all(title, '{_ZERO}'))) AS BIGINT) AS zero_width FROM m
UNION ALL SELECT 'description', CAST(sum(len(regexp_extract_all(description, '{_ZERO}'))) AS BIGINT) FROM m""")
def _(spark, sf):
    marked = F.when(F.col("job_id").cast("int") % 5 == 0, "​﻿").otherwise("")
    jobs = document_postings(spark, sf).withColumn("description", F.concat("description", marked))
    return D.zero_width_scan(jobs, ["title", "description"])


@query("literal_scan", """
SELECT doc_id, contains(text, 'sk-') AS has_prefix, contains(text, '@') AS has_at, NOT (contains(text, 'sk-') OR contains(text, '@')) AS clean FROM documents""")
def _(spark, sf):
    return D.scan_literals(documents(spark, sf), {"prefix": "sk-", "at": "@"}).select("doc_id", "has_prefix", "has_at", "clean")


@query("redact", "SELECT doc_id, md5(replace(replace(text, 'sk-', '[REDACTED]'), '@', '[REDACTED]')) AS text FROM documents")
def _(spark, sf):
    return D.redact(documents(spark, sf), {"prefix": "sk-", "at": "@"}).select("doc_id", F.md5("text").alias("text"))


@query("read_text", "SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def _(spark, sf):
    # Text files of a hundred documents each, read back whole.
    path, end = scratch_path(spark, "resumes"), "\u0000"
    documents(spark, sf).select("text").write.option("maxRecordsPerFile", 100).option("lineSep", end).text(path)
    ends = F.regexp_count("text", F.lit(end))
    return read_resumes(spark, path).agg(
        F.sum(ends).alias("documents"), F.sum(F.length("text") - ends).alias("chars")
    )
