"""Queries over the tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, rules, text
from ..operators import batches, cells, extract, profile, trust
from ..sources import delimited
from . import oracle as O
from .leads import LEADS, leads, table
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

WITH = f"WITH leads AS ({LEADS}) "


def lead_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.to_cells(leads(spark, sf_dir), "row_number")


def lead_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.normalize_cells(lead_cells(spark, sf_dir), compose=False)


# sources


@query(WITH + "SELECT * FROM leads")
def lead_table(spark, sf_dir):
    return leads(spark, sf_dir)


def lead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited file for every hundred customers, as ``binaryFile`` rows."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), quoted(F.concat("c_name", F.lit(';"x"'))), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, F.lit("more")))
    rows = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 100").alias("g"), "c_custkey", line.alias("line"))
    files = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("l"))
    body = F.concat(F.lit("key;name;segment\r\n;;\r\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n"))
    return files.select(F.concat(F.lit("file"), F.col("g").cast("string")).alias("path"), F.encode(body, "UTF-8").alias("content")).withColumn("length", F.length("content"))


@query("""
WITH r AS (SELECT *, 'file' || CAST(c_custkey // 100 AS VARCHAR) AS upload_id FROM customer)
SELECT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY c_custkey) AS BIGINT) AS row_number, CAST(c_custkey AS VARCHAR) AS key, c_name || ';"x"' AS name, c_mktsegment AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN 'recovered' ELSE 'ok' END AS status
FROM r
""")
def parse_delimited(spark, sf_dir):
    _, rows = delimited.parse(delimited.read_records(lead_files(spark, sf_dir)))
    return rows.select("upload_id", "row_number", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("key", "name", "segment"))), "status")


@query("""
SELECT 'file' || CAST(c_custkey // 100 AS VARCHAR) AS upload_id, 'key,name,segment' AS headers, ';' AS delimiter, 'UTF-8' AS encoding, CAST(count(*) AS BIGINT) AS row_count, CAST(1 AS BIGINT) AS blank_rows
FROM customer GROUP BY ALL
""")
def parsed_datasets(spark, sf_dir):
    datasets, _ = delimited.parse(delimited.read_records(lead_files(spark, sf_dir)))
    return datasets.select("upload_id", F.array_join("headers", ",").alias("headers"), "delimiter", "encoding", F.col("row_count").cast("long").alias("row_count"), F.col("blank_rows").cast("long").alias("blank_rows"))


@query("""
SELECT upload_id, code, count FROM (
  SELECT 'file' || CAST(c_custkey // 100 AS VARCHAR) AS upload_id, CAST(count(*) FILTER (c_custkey % 5 = 0) AS BIGINT) AS ragged FROM customer GROUP BY ALL) s,
  LATERAL (SELECT * FROM (VALUES ('BLANK_ROWS_SKIPPED', CAST(1 AS BIGINT)), ('RAGGED_ROWS_ADJUSTED', s.ragged)) t(code, count)) WHERE count > 0
""")
def parse_warnings(spark, sf_dir):
    return delimited.parse_warnings(*delimited.parse(delimited.read_records(lead_files(spark, sf_dir))))


# profiles

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def _profile_sql(columns: list[str], source: str, row: str, prefix: str = "WITH ") -> str:
    return f"""{prefix}cells AS ({O.cells(columns, source, row)}), t AS (SELECT *, {O.trim("coalesce(raw_value, '')")} AS v FROM cells),
a AS (SELECT column_index, header, count(*) AS total_count, count(DISTINCT nullif(v, '')) AS unique_count, count(*) FILTER (v = '') AS missing_count, count(*) FILTER (v <> '') AS n,
  coalesce(sum(length(v)), 0) AS chars, coalesce(max(length(nullif(v, ''))), 0) AS max_length, coalesce(min(length(nullif(v, ''))), 0) AS min_length,
  count(*) FILTER ({O.email('v')}) AS e, count(*) FILTER (v <> '' AND {O.phone('v')}) AS p, count(*) FILTER ({O.date('v')}) AS d, count(*) FILTER ({O.numeric('v')}) AS m FROM t GROUP BY ALL),
f AS (SELECT column_index, v, min(row_number) AS r, row_number() OVER (PARTITION BY column_index ORDER BY min(row_number), v) AS k FROM t WHERE v <> '' GROUP BY column_index, v),
s AS (SELECT column_index, string_agg(v, '|' ORDER BY k) AS samples FROM f WHERE k <= 5 GROUP BY column_index),
x AS (SELECT *, CASE WHEN n > 0 THEN greatest(e, p, d, m) / n ELSE 0 END AS best FROM a)
SELECT x.column_index, x.header, CAST(total_count AS BIGINT) AS total_count, CAST(unique_count AS BIGINT) AS unique_count, CAST(missing_count AS BIGINT) AS missing_count,
  CASE WHEN n > 0 THEN round(CAST(chars AS DOUBLE) / n, 9) ELSE 0.0 END AS average_length, CAST(max_length AS INTEGER) AS max_length, CAST(min_length AS INTEGER) AS min_length,
  CAST(e AS BIGINT) AS email_matches, CAST(p AS BIGINT) AS phone_matches, CAST(d AS BIGINT) AS date_matches, CAST(m AS BIGINT) AS numeric_matches,
  CASE WHEN n = 0 THEN 'empty' WHEN best < 0.5 THEN 'text' WHEN e = greatest(e, p, d, m) THEN 'email' WHEN p = greatest(e, p, d, m) THEN 'phone' WHEN d = greatest(e, p, d, m) THEN 'date' ELSE 'numeric' END AS type_guess,
  CASE WHEN n = 0 OR best < 0.5 THEN 0.0 ELSE round(best, 9) END::DOUBLE AS type_confidence, coalesce(samples, '') AS samples
FROM x LEFT JOIN s USING (column_index)"""


def _profiled(df: DataFrame) -> DataFrame:
    return df.select("column_index", "header", "total_count", "unique_count", "missing_count", F.round("average_length", 9).alias("average_length"), "max_length", "min_length", "email_matches", "phone_matches", "date_matches", "numeric_matches", "type_guess", F.round("type_confidence", 9).alias("type_confidence"), F.array_join("samples", "|").alias("samples"))


@query(_profile_sql(CUSTOMER, "customer", "c_custkey"))
def column_profile(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("row", F.col("c_custkey"))
    return _profiled(profile.column_profiles(cells.to_cells(df, "row", CUSTOMER)))


@query(_profile_sql(O.LEAD_COLUMNS, "leads", "row_number", WITH.rstrip() + ", "))
def lead_profile(spark, sf_dir):
    return _profiled(profile.column_profiles(lead_cells(spark, sf_dir)))


@query(f"""WITH p AS ({_profile_sql(O.LEAD_COLUMNS, 'leads', 'row_number', WITH.rstrip() + ', ')})
SELECT type_guess, CAST(count(*) AS BIGINT) AS column_count, string_agg(header, ',' ORDER BY column_index) AS columns FROM p GROUP BY type_guess""")
def columns_by_type(spark, sf_dir):
    got = profile.dataset_intelligence(profile.column_profiles(lead_cells(spark, sf_dir)))
    return got.select("type_guess", "column_count", F.array_join("columns", ",").alias("columns"))


@query(WITH.rstrip() + f""", cells AS ({O.cells()}), a AS (SELECT count(DISTINCT row_number) AS r, count(DISTINCT column_index) AS c, count(*) AS n, count(*) FILTER (trim(coalesce(raw_value, '')) = '') AS m FROM cells)
SELECT CAST(r AS BIGINT) AS row_count, CAST(c AS BIGINT) AS column_count, CAST(n AS BIGINT) AS cell_count, CAST(m AS BIGINT) AS missing_count,
  CASE WHEN n <= 10000 THEN 'low' WHEN n <= 200000 THEN 'medium' ELSE 'high' END AS complexity, CAST(floor(100 - 30 * (m / n) + 0.5) AS BIGINT) AS quality_score FROM a""")
def dataset_quality(spark, sf_dir):
    got = profile.dataset_metadata(lead_cells(spark, sf_dir))
    return got.select("row_count", "column_count", "cell_count", "missing_count", "complexity", "quality_score")


@query(WITH + "SELECT * FROM leads WHERE row_number <= 50")
def lead_preview(spark, sf_dir):
    return profile.preview(leads(spark, sf_dir))


# rules


@query(WITH.rstrip() + f""", c AS (SELECT row_number, email AS v, {O.parts('email', O.EMAIL_PARTS)} AS p FROM leads)
SELECT row_number, lower(p[1]) AS primary_email, array_to_string(list_transform(p[2:], lambda x: lower(x)), '|') AS additional, coalesce({O.email('lower(p[1])')}, false) AS is_valid FROM c WHERE len(p) > 0 AND len(list_filter(p, lambda x: regexp_matches(x, '^[^\\s@]+@[^\\s@]+$'))) > 0""")
def email_rule(spark, sf_dir):
    rows = leads(spark, sf_dir).withColumn("p", rules.email_parts(F.col("email"))).filter(rules.applies_email(F.col("p"))).withColumn("o", rules.email_rule(F.col("p")))
    return rows.select("row_number", F.col("o.value").alias("primary_email"), F.array_join("o.details.email.additional", "|").alias("additional"), F.col("o.details.email.is_valid").alias("is_valid"))


@query(WITH.rstrip() + f""", c AS (SELECT row_number, {O.parts('phone', O.PHONE_PARTS)}[1] AS p FROM leads WHERE len(list_filter({O.parts('phone', O.PHONE_PARTS)}, lambda p: {O.phone('p')})) > 0)
, d AS (SELECT *, {O.digits('p')} AS n, p[1] = '+' AND regexp_matches({O.digits('p')}, '^91[6-9]\\d{{9}}$') AS ok FROM c)
SELECT row_number, CASE WHEN ok THEN '+' || n END AS e164, CASE WHEN ok THEN '+91' END AS country_code, CASE WHEN ok THEN n[3:] ELSE n END AS national_number, CASE WHEN ok THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM d""")
def phone_rule(spark, sf_dir):
    rows = leads(spark, sf_dir).withColumn("p", rules.phone_parts(F.col("phone"))).filter(rules.applies_phone(F.col("p"))).withColumn("o", rules.phone_rule(F.col("p")))
    return rows.select("row_number", "o.details.phone.e164", "o.details.phone.country_code", "o.details.phone.national_number", "o.confidence")


@query(WITH + f"SELECT row_number, created, {O.iso('created')} AS iso, {O.ambiguous('created')} AS ambiguous FROM leads")
def date_rule(spark, sf_dir):
    return leads(spark, sf_dir).withColumn("o", rules.parse_date(F.col("created"))).select("row_number", "created", "o.iso", "o.ambiguous")


@query(WITH + "SELECT row_number, CAST(replace(replace(replace(budget, '$', ''), ',', ''), '%', '') AS DOUBLE) AS number, CASE WHEN budget[1] = '$' THEN '$' END AS currency_symbol FROM leads")
def number_rule(spark, sf_dir):
    return leads(spark, sf_dir).withColumn("o", rules.number_rule(F.col("budget"))).select("row_number", F.col("o.details.number.value").alias("number"), "o.details.number.currency_symbol")


@query(WITH + "SELECT row_number, lower(interested) IN ('yes', 'y', 'true', 't') AS is_true FROM leads WHERE lower(interested) IN ('yes','y','true','t','no','n','false','f')")
def boolean_rule(spark, sf_dir):
    return leads(spark, sf_dir).filter(rules.applies_boolean(F.col("interested"))).withColumn("o", rules.boolean_rule(F.col("interested"))).select("row_number", F.col("o.details.bool.value").alias("is_true"))


@query(WITH + "SELECT row_number, upper(trim(name)[1:1]) || lower(trim(name)[2:]) AS name, translate(remarks, '“”‘’', '\"\"''''') AS remarks FROM leads")
def text_and_location_rules(spark, sf_dir):
    return leads(spark, sf_dir).select("row_number", rules.location_rule(F.col("name")).alias("name"), rules.text_rule(F.col("remarks")).alias("remarks"))


@query("WITH " + O.fields(LEADS) + "SELECT row_number, column_index, header, normalized_value, confidence, applied_rules, CASE WHEN confidence < 1 THEN 'warning' WHEN applied_rules = '' THEN 'unchanged' ELSE 'normalized' END AS status FROM fields")
def normalize_cells(spark, sf_dir):
    return lead_fields(spark, sf_dir).select("row_number", "column_index", "header", "normalized_value", "confidence", F.array_join("applied_rules", ",").alias("applied_rules"), "status")


@query("WITH " + O.fields(LEADS) + """, a AS (SELECT count(*) AS t, count(*) FILTER (contains(applied_rules, 'whitespace')) AS w, count(*) FILTER (kind = 'null') AS z, count(*) FILTER (kind = 'email' AND confidence = 1) AS e, count(*) FILTER (kind = 'email' AND confidence < 1) AS f,
  count(*) FILTER (kind = 'phone' AND confidence = 1) AS p, count(*) FILTER (kind = 'phone' AND confidence < 1) AS q, count(*) FILTER (kind = 'date' AND confidence = 1) AS d, count(*) FILTER (kind = 'date' AND confidence < 1) AS g,
  count(*) FILTER (kind = 'number') AS n, count(*) FILTER (kind = 'boolean') AS b, count(*) FILTER (confidence < 1) AS x FROM fields)
SELECT CAST(t AS BIGINT) AS total_fields, CAST(w AS BIGINT) AS whitespace_normalized, CAST(z AS BIGINT) AS null_values_detected, CAST(e AS BIGINT) AS emails_normalized, CAST(f AS BIGINT) AS invalid_emails, CAST(p AS BIGINT) AS phones_normalized,
  CAST(q AS BIGINT) AS invalid_phones, CAST(d AS BIGINT) AS dates_parsed, CAST(g AS BIGINT) AS failed_date_parses, CAST(n AS BIGINT) AS numbers_normalized, CAST(b AS BIGINT) AS booleans_normalized, CAST(x AS BIGINT) AS fields_with_warnings,
  CAST(floor(100 - x / t * 40 + 0.5) AS BIGINT) AS health_score FROM a""")
def normalization_report(spark, sf_dir):
    return profile.normalization_report(lead_fields(spark, sf_dir)).drop("upload_id", "unicode_normalized", "fields_failed")


@query("WITH " + O.fields(LEADS) + """SELECT code, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT CASE kind WHEN 'email' THEN 'INVALID_EMAILS' WHEN 'phone' THEN 'PHONES_WITHOUT_COUNTRY' ELSE 'UNRESOLVED_DATES' END AS code FROM fields WHERE confidence < 1) GROUP BY code""")
def report_warnings(spark, sf_dir):
    return profile.report_warnings(profile.normalization_report(lead_fields(spark, sf_dir))).drop("upload_id")


@query("WITH " + O.fields(LEADS) + """, i AS (SELECT row_number() OVER (ORDER BY row_number, column_index) AS issue_rank, row_number, header, count(*) OVER () AS total_issue_count,
  CASE kind WHEN 'email' THEN 'INVALID_EMAIL_SYNTAX' WHEN 'phone' THEN 'PHONE_COUNTRY_UNKNOWN' ELSE CASE WHEN confidence < 0.25 THEN 'UNPARSEABLE_DATE' ELSE 'AMBIGUOUS_DATE' END END AS code FROM fields WHERE confidence < 1)
SELECT CAST(issue_rank AS INTEGER) AS issue_rank, row_number, header, code, CAST(total_issue_count AS BIGINT) AS total_issue_count FROM i WHERE issue_rank <= 25""")
def field_issues(spark, sf_dir):
    return profile.field_issues(lead_fields(spark, sf_dir)).select("issue_rank", "row_number", "header", "code", "total_issue_count")


# extraction and trust


def lead_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(lead_fields(spark, sf_dir))


_TARGET = f"""CASE WHEN {O.email('normalized_value')} THEN 'email' WHEN {O.date('normalized_value')} THEN 'created_at' WHEN {O.phone('normalized_value')} THEN 'mobile_without_country_code'
  WHEN header = 'name' THEN 'name' WHEN header = 'country' THEN 'country' WHEN header = 'status' THEN 'crm_status' WHEN header = 'remarks' THEN 'crm_note' END"""
_EXTRACT = "WITH " + O.fields(LEADS) + f""", g AS (SELECT *, {_TARGET} AS target FROM fields WHERE normalized_value <> ''),
x AS (SELECT row_number, target, arg_min(normalized_value, column_index) AS value FROM g WHERE target IS NOT NULL GROUP BY row_number, target),
rec AS (SELECT l.row_number, max(value) FILTER (target = 'created_at') AS created_at, max(value) FILTER (target = 'name') AS name, max(value) FILTER (target = 'email') AS email, max(value) FILTER (target = 'mobile_without_country_code') AS mobile,
  max(value) FILTER (target = 'country') AS country, max(value) FILTER (target = 'crm_status') AS raw_status, max(value) FILTER (target = 'crm_note') AS crm_note FROM leads l LEFT JOIN x USING (row_number) GROUP BY l.row_number),
rec2 AS (SELECT *, CASE WHEN raw_status IN ({O.quoted(trust.CRM_STATUS)}) THEN raw_status END AS crm_status FROM rec)
"""


@query(_EXTRACT + "SELECT row_number, created_at, name, email, mobile, country, crm_status, crm_note FROM rec2")
def extract_records(spark, sf_dir):
    return extract.wide(lead_records(spark, sf_dir)).select("row_number", "created_at", "name", "email", F.col("mobile_without_country_code").alias("mobile"), "country", "crm_status", "crm_note")


@query(_EXTRACT + "SELECT row_number, 'INVALID_CRM_STATUS' AS code, raw_status AS value FROM rec2 WHERE raw_status IS NOT NULL AND crm_status IS NULL")
def enum_warnings(spark, sf_dir):
    return lead_records(spark, sf_dir).select("row_number", F.explode_outer("extraction_warnings").alias("w")).filter("w is not null").select("row_number", "w.code", "w.value")


@query(WITH.rstrip() + f""", s AS (SELECT row_number, status, regexp_replace(lower(trim(status)), '[\\s-]+', '_', 'g') AS p FROM leads WHERE status IS NOT NULL),
d AS (SELECT s.*, a, i, levenshtein(p, lower(a)) AS d FROM s, (VALUES {', '.join(f"('{a}', {i})" for i, a in enumerate(trust.CRM_STATUS))}) t(a, i))
SELECT row_number, status, CASE WHEN min(d) <= 3 THEN arg_min(a, d * 10 + i) END AS repaired FROM d GROUP BY row_number, status""")
def enum_repair(spark, sf_dir):
    return leads(spark, sf_dir).filter("status is not null").select("row_number", "status", trust.closest(F.col("status"), trust.CRM_STATUS, 3).alias("repaired"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads taken as they are, so that all repairs and violations occur."""
    made = {"created_at": "created", "name": "name", "email": "email", "mobile_without_country_code": "phone", "country": "country", "crm_status": "status", "description": "remarks"}
    value = lambda f: F.nullif(F.col(made[f]), F.lit("")) if f in made else F.lit(None).cast("string")
    fields = F.array(*(F.struct(F.lit(f).alias("target_field"), value(f).alias("value"), F.when(value(f).isNotNull(), 0.9).otherwise(0.0).alias("confidence"), F.lit(made.get(f, "")).alias("source_header")) for f in trust.FIELDS))
    return leads(spark, sf_dir).select("row_number", fields.alias("fields"))


_RAW = WITH.rstrip() + rf""", r AS (SELECT row_number, nullif(created, '') AS created, nullif(name, '') AS name, nullif(email, '') AS email, nullif(phone, '') AS phone, country, status, nullif(remarks, '') AS remarks FROM leads),
n AS (SELECT row_number, status, regexp_replace(lower(trim(status)), '[\s-]+', '_', 'g') AS p FROM r),
dd AS (SELECT n.row_number, n.status, min(levenshtein(p, lower(a))) AS d, arg_min(a, levenshtein(p, lower(a)) * 10 + i) AS a FROM n, (VALUES {', '.join(f"('{a}', {i})" for i, a in enumerate(trust.CRM_STATUS))}) t(a, i) WHERE status IS NOT NULL GROUP BY ALL),
f AS (SELECT r.row_number, r.email, r.phone, r.name, r.created,
  CASE WHEN r.status IS NULL OR r.status IN ({O.quoted(trust.CRM_STATUS)}) OR dd.d > 3 THEN r.status ELSE dd.a END AS status2, r.status,
  CASE WHEN regexp_matches(r.email, '[;,]|\s+(and|or)\s+') THEN r.email ELSE lower(r.email) END AS email2,
  CASE WHEN regexp_matches(r.phone, '[;,]|\s+(and|or)\s+') THEN r.phone ELSE {O.digits('r.phone')} END AS phone2,
  coalesce({O.iso('r.created')}, r.created) AS created2, trim(r.name) AS name2, r.country, r.remarks FROM r LEFT JOIN dd USING (row_number, status)),
e AS (SELECT *, coalesce(status2 NOT IN ({O.quoted(trust.CRM_STATUS)}), false) AS bad_status, coalesce(NOT {O.email('email2')}, false) AS bad_email,
  coalesce(length({O.digits('phone2')}) NOT BETWEEN 7 AND 12, false) AS bad_phone, NOT {O.date('created2')} AS bad_date,
  coalesce(status2 <> status, false)::INT AS r1, coalesce(email2 <> email, false)::INT AS r2, coalesce(phone2 <> phone, false)::INT AS r3, (created2 <> created)::INT AS r4, (name2 <> name)::INT AS r5,
  coalesce(regexp_matches(email2, '[;,]|\s+(and|or)\s+'), false) AS many FROM f),
s AS (SELECT *, (status IS NULL)::INT + (email IS NULL)::INT + (phone IS NULL)::INT + 8 AS missing, r1 + r2 + r3 + r4 + r5 AS repairs,
  bad_status::INT + bad_date::INT AS b_err, many::INT AS b_warn, bad_status::INT + bad_email::INT + bad_phone::INT + bad_date::INT AS errs,
  CASE WHEN status IS NULL THEN 0 ELSE 0.9 * CASE WHEN bad_status THEN 0.3 ELSE 1 END * CASE WHEN r1 = 1 AND NOT bad_status THEN 0.8 ELSE 1 END END::DOUBLE
  + CASE WHEN email IS NULL THEN 0 ELSE 0.9 * CASE WHEN bad_email THEN 0.3 ELSE 1 END * CASE WHEN r2 = 1 AND NOT bad_email THEN 0.8 ELSE 1 END END::DOUBLE
  + CASE WHEN phone IS NULL THEN 0 ELSE 0.9 * CASE WHEN bad_phone THEN 0.3 ELSE 1 END * CASE WHEN r3 = 1 AND NOT bad_phone THEN 0.8 ELSE 1 END END::DOUBLE
  + 0.9 * CASE WHEN bad_date THEN 0.3 ELSE 1 END * CASE WHEN r4 = 1 AND NOT bad_date THEN 0.8 ELSE 1 END::DOUBLE
  + 0.9 * CASE WHEN r5 = 1 THEN 0.8 ELSE 1 END + 0.9 + 0.9 AS conf FROM e),
c AS (SELECT *, greatest(0, conf / (15 - missing) - least(0.3, repairs * 0.05) - least(0.5, b_err * 0.2) - least(0.2, b_warn * 0.05)) AS rc FROM s),
q AS (SELECT *, CAST(floor(greatest(0, 100 - least(missing, 6) * 2 - repairs * 4 - (b_err + b_warn) * 8 - errs * 10) * ((rc * 40 + 0.9 * 20) / 60) + 0.5) AS BIGINT) AS qs FROM c),
z AS (SELECT *, CASE WHEN email IS NULL AND phone IS NULL THEN 'skipped' WHEN b_err > 0 THEN 'rejected' WHEN rc >= 0.75 AND qs >= 70 AND repairs <= 3 THEN 'approved' WHEN rc < 0.4 OR qs < 40 THEN 'rejected' ELSE 'needs_review' END AS st FROM q)
"""


@query(_RAW + "SELECT row_number, CAST(repairs AS INTEGER) AS repair_count, CAST(missing AS INTEGER) AS missing_count, CAST(b_err + b_warn AS INTEGER) AS violation_count, CAST(errs AS INTEGER) AS error_count, round(rc, 9)::DOUBLE AS record_confidence, qs AS quality_score, st AS approval_status FROM z")
def trust_records(spark, sf_dir):
    got = trust.run_trust(raw_records(spark, sf_dir))
    return got.select("row_number", "repair_count", "missing_count", "violation_count", "error_count", F.round("record_confidence", 9).alias("record_confidence"), "quality_score", "approval_status")


@query(_RAW + "SELECT CAST(count(*) AS BIGINT) AS record_count, CAST(count(*) FILTER (st = 'approved') AS BIGINT) AS approved_count, CAST(count(*) FILTER (st = 'needs_review') AS BIGINT) AS needs_review_count, CAST(count(*) FILTER (st = 'rejected') AS BIGINT) AS rejected_count, CAST(count(*) FILTER (st = 'skipped') AS BIGINT) AS skipped_count, round(avg(rc), 6) AS average_confidence, round(avg(qs), 6) AS average_quality, CAST(sum(repairs) AS BIGINT) AS repair_count FROM z")
def trust_summary(spark, sf_dir):
    got = trust.trust_summary(trust.run_trust(raw_records(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 6) for c in ("average_confidence", "average_quality")})


@query(_RAW + "SELECT row_number, email2 AS email, phone2 AS mobile, created2 AS created_at, status2 AS crm_status, name2 AS name FROM z")
def field_repair(spark, sf_dir):
    got = trust.run_trust(raw_records(spark, sf_dir))
    pick = lambda n: trust.value_of(F.col("reports"), n)
    return got.select("row_number", pick("email").alias("email"), pick("mobile_without_country_code").alias("mobile"), pick("created_at").alias("created_at"), pick("crm_status").alias("crm_status"), pick("name").alias("name"))


@query(_RAW + "SELECT row_number FROM z WHERE st = 'skipped'")
def skip_rule(spark, sf_dir):
    return raw_records(spark, sf_dir).filter(trust.skip_reason(F.col("fields")).isNotNull()).select("row_number")


@query(_RAW + """SELECT row_number, 'INVALID_CRM_STATUS' AS code, 'error' AS severity FROM z WHERE bad_status UNION ALL SELECT row_number, 'INVALID_CREATED_AT', 'error' FROM z WHERE bad_date UNION ALL SELECT row_number, 'MULTIPLE_EMAILS_NOT_IN_NOTE', 'warning' FROM z WHERE many""")
def business_rules(spark, sf_dir):
    got = trust.run_trust(raw_records(spark, sf_dir)).select("row_number", F.explode_outer("issues").alias("i")).filter("i.category = 'business'")
    return got.select("row_number", "i.code", "i.severity")


# batches, prompts, answers


@query(_RAW + "SELECT 'import-batch-' || CAST(CAST(floor((row_number - 1) / 25) AS BIGINT) + 1 AS VARCHAR) AS batch_id, CAST(count(*) AS BIGINT) AS record_count, CAST(count(*) FILTER (st = 'approved') AS BIGINT) AS approved_count, CAST(sum(repairs) AS BIGINT) AS repair_count FROM z GROUP BY ALL")
def batch_summaries(spark, sf_dir):
    got = batches.assign_batches(trust.run_trust(raw_records(spark, sf_dir)), 25)
    return trust.trust_summary(got, ["batch_id"]).select("batch_id", "record_count", "approved_count", "repair_count")


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, sha256(text)[1:16] AS hash FROM conversations")
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.estimate_tokens(t).alias("tokens"), text.prompt_hash(t).alias("hash"))


@query(rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \t\n\r\x0B\f]+'), lambda w: {O.email('w')})) AS BIGINT) AS emails, CAST(len(list_filter(string_split_regex(text, '[ \t\n\r\x0B\f]+'), lambda w: {O.phone('w')})) AS BIGINT) AS phones FROM documents")
def personal_data_scan(spark, sf_dir):
    words = F.split("text", r"[ \t\n\r\x0B\f]+")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, detect.looks_like_email)).cast("long").alias("emails"), F.size(F.filter(words, detect.looks_like_phone)).cast("long").alias("phones"))


@query("SELECT CAST(c_custkey AS BIGINT) AS row_number, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'SALE_DONE' END AS crm_status, 'c' || CAST(c_custkey AS VARCHAR) || '@x.io' AS email FROM customer")
def answers_to_records(spark, sf_dir):
    name = F.to_json(F.struct(F.struct(F.col("c_name").alias("value"), F.lit("Name").alias("sourceHeader")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "SALE_DONE").otherwise("sold").alias("crm_status"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.io")).alias("email")))
    answer = F.concat(F.lit('Here it is:\n```json\n{"records":[{"row":'), F.col("c_custkey").cast("string"), F.lit(',"fields":'), name, F.lit("},7]}\n```"))
    got = table(spark, sf_dir, "customer").select(text.json_candidate(answer).alias("text"))
    return extract.wide(extract.records_from_json(got)).select("row_number", "name", "crm_status", "email")
