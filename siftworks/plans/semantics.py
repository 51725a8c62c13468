"""Queries about what columns mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as V
from ..operators import profile, semantic, similar
from . import oracle as O
from .leads import LEADS, leads, table
from .queries import lead_fields
from .registry import query

#: Tables whose columns are taken as the headers of an upload each.
TABLES = ["customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all tables, and those of the leads."""
    named = {name: table(spark, sf_dir, name).columns for name in TABLES} | {"leads": leads(spark, sf_dir).columns[1:]}
    rows = [(upload, i, column) for upload, columns in named.items() for i, column in enumerate(columns)]
    return profile.header_profiles(spark.createDataFrame(rows, "upload_id string, column_index int, header string"))


def _describe(upload: str, source: str) -> str:
    return f"SELECT '{upload}' AS upload_id, CAST(row_number() OVER () - 1 AS INTEGER) AS column_index, column_name AS header FROM (DESCRIBE SELECT * FROM {source})"


_HEADERS = "h AS (" + " UNION ALL ".join(_describe(t, t) for t in TABLES) + " UNION ALL " + _describe("leads", "(SELECT * EXCLUDE (row_number) FROM leads)") + """),
n AS (SELECT *, lower(regexp_replace(regexp_replace(header, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS normalized FROM h)"""
_ALIASES = "al(alias_order, alias, field_id) AS (VALUES " + ", ".join(f"({i}, '{a.replace(' ', '_').replace('-', '_')}', '{f}')" for i, (a, f) in enumerate(semantic._pairs(None))) + ")"
_MATCH = f"""{_HEADERS}, {_ALIASES},
g AS (SELECT n.upload_id, n.column_index, n.normalized, al.*, list_transform(range(1, length(n.normalized)), lambda i: n.normalized[i:i+1]) AS x, list_transform(range(1, length(al.alias)), lambda i: al.alias[i:i+1]) AS y FROM n, al
  WHERE normalized NOT IN (SELECT alias FROM al)),
s AS (SELECT *, CASE WHEN length(normalized) < 2 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_distinct(x), lambda b: least(len(list_filter(x, lambda c: c = b)), len(list_filter(y, lambda c: c = b))))) / (len(x) + len(y)) END AS score FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY upload_id, column_index, field_id ORDER BY score DESC, alias_order) AS k, min(alias_order) OVER (PARTITION BY upload_id, column_index, field_id) AS f FROM s WHERE score >= 0.45),
t AS (SELECT *, row_number() OVER (PARTITION BY upload_id, column_index ORDER BY score DESC, f) AS j FROM b WHERE k = 1),
m AS (SELECT upload_id, column_index, normalized, field_id, 1.0::DOUBLE AS score, 'exact_alias' AS match_type, alias AS matched_alias, alias_order FROM n JOIN al ON normalized = alias
  UNION ALL SELECT upload_id, column_index, normalized, field_id, score::DOUBLE, 'fuzzy', alias, alias_order FROM t WHERE j <= 3)
"""
_WITH = f"WITH leads AS ({LEADS}), "


@query(_WITH + _HEADERS + " SELECT upload_id, column_index, header, normalized, count(*) OVER (PARTITION BY upload_id, normalized) > 1 AS is_duplicate FROM n")
def header_names(spark, sf_dir):
    return headers(spark, sf_dir).select("upload_id", "column_index", "header", "normalized", "is_duplicate")


@query(_WITH + _MATCH + "SELECT upload_id, column_index, normalized, field_id, round(score, 9) AS score, match_type, matched_alias FROM m")
def alias_match(spark, sf_dir):
    return semantic.match_headers(headers(spark, sf_dir)).select("upload_id", "column_index", "normalized", "field_id", F.round("score", 9).alias("score"), "match_type", "matched_alias")


@query(_WITH + _MATCH + ", a AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY upload_id, column_index ORDER BY score DESC, alias_order)) SELECT upload_id, column_index, field_id AS top_field, coalesce(score - nxt < 0.1, false) AS is_ambiguous FROM a WHERE r = 1")
def header_ambiguity(spark, sf_dir):
    return semantic.header_ambiguity(semantic.match_headers(headers(spark, sf_dir))).select("upload_id", "column_index", "top_field", "is_ambiguous")


_REGISTRY = """al AS (SELECT replace(p_name, ' ', '_') AS alias, p_type AS field_id, min(p_partkey) AS alias_order FROM part GROUP BY 1, 2),
n AS (SELECT p_brand AS upload_id, p_partkey AS column_index, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') ELSE split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) END AS normalized FROM part),
d AS (SELECT DISTINCT normalized FROM n WHERE normalized NOT IN (SELECT alias FROM al)),
g AS (SELECT normalized, alias, list_transform(range(1, length(normalized)), lambda i: normalized[i:i+1]) AS x, list_transform(range(1, length(alias)), lambda i: alias[i:i+1]) AS y FROM d, (SELECT DISTINCT alias FROM al)),
z AS (SELECT normalized, alias, 2.0 * list_sum(list_transform(list_distinct(x), lambda b: least(len(list_filter(x, lambda c: c = b)), len(list_filter(y, lambda c: c = b))))) / (len(x) + len(y)) AS score FROM g),
b AS (SELECT n.*, al.*, score, row_number() OVER (PARTITION BY upload_id, column_index, field_id ORDER BY score DESC, alias_order) AS k, min(alias_order) OVER (PARTITION BY upload_id, column_index, field_id) AS f FROM n JOIN z USING (normalized) JOIN al USING (alias) WHERE score >= 0.45),
t AS (SELECT *, row_number() OVER (PARTITION BY upload_id, column_index ORDER BY score DESC, f) AS j FROM b WHERE k = 1)
SELECT upload_id, column_index, normalized, field_id, 1.0::DOUBLE AS score, 'exact_alias' AS match_type, alias AS matched_alias FROM n JOIN al ON normalized = alias
UNION ALL SELECT upload_id, column_index, normalized, field_id, round(score::DOUBLE, 9), 'fuzzy', alias FROM t WHERE j <= 3"""


@query("WITH " + _REGISTRY)
def registry_match(spark, sf_dir):
    """Headers made of the parts' names, some turned round, against a registry of all names by type."""
    part = table(spark, sf_dir, "part")
    registry = part.select(text.header_name(F.col("p_name")).alias("alias"), F.col("p_type").alias("field_id"), F.col("p_partkey").alias("alias_order"))
    turned = F.regexp_replace("p_name", r"^(\S+) (\S+)$", "$2 $1")
    names = part.select(F.col("p_brand").alias("upload_id"), F.col("p_partkey").alias("column_index"), text.header_name(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(turned)).alias("normalized"))
    got = semantic.match_headers(names, registry=registry)
    return got.select("upload_id", "column_index", "normalized", "field_id", F.round("score", 9).alias("score"), "match_type", "matched_alias")


@query("""WITH a AS (SELECT DISTINCT w AS alias FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents)), p AS (SELECT DISTINCT replace(p_name, ' ', '') AS name FROM part),
g AS (SELECT *, list_transform(range(1, length(name)), lambda i: name[i:i+1]) AS x, list_transform(range(1, length(alias)), lambda i: alias[i:i+1]) AS y FROM p, a WHERE length(name) > 1 AND length(alias) > 1),
z AS (SELECT name, alias, 2.0 * list_sum(list_transform(list_distinct(x), lambda b: least(len(list_filter(x, lambda c: c = b)), len(list_filter(y, lambda c: c = b))))) / (len(x) + len(y)) AS score FROM g)
SELECT name, alias, round(score::DOUBLE, 9) AS score FROM z WHERE score >= 0.45""")
def similar_words(spark, sf_dir):
    """All words of the documents that are similar to a part's name."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("alias"))
    got = similar.similar_names(table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "").alias("name")), words)
    return got.select("name", "alias", F.round("score", 9).alias("score"))


_KINDS = "w(place, kind, word) AS (VALUES " + ", ".join(f"({i}, '{k}', '{word}')" for i, (k, words) in enumerate(V.DATASET_KINDS.items()) for word in words) + ")"


@query(_WITH + _HEADERS + f""", {_KINDS}, u AS (SELECT upload_id, count(*) AS n FROM n GROUP BY upload_id),
c AS (SELECT u.upload_id, u.n, w.place, w.kind, least(1.0, count(DISTINCT CASE WHEN contains(n.normalized, w.word) THEN w.word END) / 2) AS score FROM u JOIN n USING (upload_id), w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, place) AS k FROM c),
p AS (SELECT upload_id, any_value(n) AS n, max(score) FILTER (k = 1) AS a, max(score) FILTER (k = 2) AS b, max(kind) FILTER (k = 1) AS kind FROM r GROUP BY upload_id)
SELECT upload_id, CASE WHEN a = 0 THEN CASE WHEN n <= 3 THEN 'manual_spreadsheet' ELSE 'unknown' END WHEN b > 0 AND a - b < 0.15 THEN 'mixed' ELSE kind END AS detected_kind,
  round(CASE WHEN a = 0 THEN CASE WHEN n <= 3 THEN 0.4 ELSE 0 END WHEN b > 0 AND a - b < 0.15 THEN a * 0.7 ELSE a END, 9)::DOUBLE AS confidence FROM p""")
def dataset_kind(spark, sf_dir):
    return semantic.dataset_kind(headers(spark, sf_dir)).select("upload_id", "detected_kind", F.round("confidence", 9).alias("confidence"))


# statistics of values

_V = "normalized_value"
_T = O.trim(_V)
_SHAPES = {
    "email": O.email(_V),
    "phone": O.phone(_V),
    "date": O.date(_V),
    "currency": rf"regexp_matches({_T}, '(?i)^[+-]?(?:[$€£¥₹]|Rs\.?|USD|EUR|GBP|INR)\s?[\d,]+(?:\.\d+)?%?$')",
    "company": rf"regexp_matches({_T}, '(?i)\b({'|'.join(V.COMPANY_SUFFIXES)})\.?\s*$')",
    "location": f"lower({_T}) IN ({O.quoted([*V.COUNTRIES, *V.STATES, *V.CITIES])})",
    "name": rf"(NOT {O.email(_V)} AND NOT {O.phone(_V)} AND NOT {O.date(_V)} AND NOT {O.numeric(_V)} AND length({_T}) BETWEEN 2 AND 60 AND regexp_matches({_T}, '^\p{{L}}[\p{{L}}''.-]*(?:\s+\p{{L}}[\p{{L}}''.-]*){{0,3}}$') AND len(list_intersect(string_split_regex(lower({_T}), '\s+'), [{O.quoted(V.NOT_NAMES)}])) = 0)",
    "status": f"lower({_T}) IN ({O.quoted(V.STATUS_WORDS)})",
}
_STATS = "WITH " + O.fields(LEADS) + f""", v AS (SELECT column_index, header, count(*) AS total_count, count(nullif({_V}, '')) AS n, count(DISTINCT nullif({_V}, '')) AS u,
  {', '.join(f"count(*) FILTER ({_V} <> '' AND {sql}) AS n_{k}" for k, sql in _SHAPES.items())} FROM fields GROUP BY column_index, header),
e AS (SELECT header, -sum(c / t * log2(c / t)) AS h FROM (SELECT header, {_V}, count(*) AS c, sum(count(*)) OVER (PARTITION BY header) AS t FROM fields WHERE {_V} <> '' GROUP BY header, {_V}) GROUP BY header),
st AS (SELECT column_index, header, total_count, n, u, u / n AS uniqueness, CASE WHEN u > 1 THEN e.h / log2(u) ELSE 0 END AS entropy,
  {', '.join(f"n_{k} / n AS {k}_ratio" for k in _SHAPES if k != 'status')},
  CASE WHEN n_status > 0 THEN n_status / n WHEN n >= 5 AND u / n <= 0.3 AND u <= 15 THEN 0.3 ELSE 0 END AS status_ratio FROM v JOIN e USING (header))"""
_RATIOS = ["uniqueness", "entropy", *(f"{k}_ratio" for k in _SHAPES)]


@query(_STATS + f" SELECT header, CAST(total_count AS BIGINT) AS total_count, CAST(n AS BIGINT) AS non_empty_count, CAST(u AS BIGINT) AS unique_count, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _RATIOS)} FROM st")
def column_semantics(spark, sf_dir):
    names = spark.createDataFrame([(i, c) for i, c in enumerate(O.LEAD_COLUMNS)], "column_index int, header string")
    got = semantic.analyze_columns(lead_fields(spark, sf_dir)).join(F.broadcast(names), "column_index")
    return got.select("header", "total_count", "non_empty_count", "unique_count", *(F.round(c, 6).alias(c) for c in _RATIOS))


@query("WITH " + O.fields(LEADS) + ", c AS (" + " UNION ALL ".join(f"SELECT column_index, '{k}' AS classifier, {_V} AS value, min(row_number) AS first_row FROM fields WHERE {_V} <> '' AND {sql} GROUP BY column_index, {_V}" for k, sql in _SHAPES.items()) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY column_index, classifier ORDER BY first_row, value) AS k FROM c) SELECT column_index, classifier, string_agg(value, '|' ORDER BY k) AS evidence FROM r WHERE k <= 3 GROUP BY column_index, classifier""")
def classifier_evidence(spark, sf_dir):
    return semantic.classifier_evidence(lead_fields(spark, sf_dir)).select("column_index", "classifier", F.array_join("evidence", "|").alias("evidence"))


@query("WITH " + O.fields(LEADS) + f""", a AS (SELECT column_index, header, count(*) AS n, count(*) FILTER ({_V} IS NULL) AS z FROM fields GROUP BY column_index, header),
kc AS (SELECT column_index, kind, count(*) AS n, min(row_number) AS f FROM fields WHERE {_V} IS NOT NULL AND kind NOT IN ('null', 'text') GROUP BY column_index, kind),
t AS (SELECT column_index, kind, row_number() OVER (PARTITION BY column_index ORDER BY n DESC, f) AS r FROM kc),
s AS (SELECT column_index, {_V} AS value, row_number() OVER (PARTITION BY column_index ORDER BY min(row_number), {_V}) AS r FROM fields WHERE {_V} IS NOT NULL GROUP BY column_index, {_V}),
g AS (SELECT column_index, string_agg(value, '|' ORDER BY r) AS samples FROM s WHERE r <= 5 GROUP BY column_index)
SELECT a.column_index, a.header, CAST(n AS BIGINT) AS record_count, round(z / n, 9) AS null_ratio, t.kind AS type_hint, coalesce(samples, '') AS samples FROM a LEFT JOIN t ON a.column_index = t.column_index AND t.r = 1 LEFT JOIN g ON a.column_index = g.column_index""")
def dataset_context(spark, sf_dir):
    got = semantic.dataset_context(lead_fields(spark, sf_dir))
    return got.select("column_index", "header", "record_count", F.round("null_ratio", 9).alias("null_ratio"), "type_hint", F.array_join("samples", "|").alias("samples"))


# confidence of fields

_ORDER = "[" + O.quoted(list(V.ALIASES)) + "]"
_RANKED = _STATS + ", " + _MATCH.replace(" UNION ALL ".join(_describe(t, t) for t in TABLES) + " UNION ALL ", "") + f""", sig AS (
  SELECT column_index, field_id, 0 AS rule, 'header' AS source, score * 0.85 AS weight FROM m WHERE match_type = 'fuzzy'
  UNION ALL SELECT column_index, field_id, 1, 'knowledge', 0.97 FROM m WHERE match_type = 'exact_alias'
  UNION ALL SELECT column_index, f, 2, 'regex', r FROM (SELECT column_index, unnest(['email', 'phone', 'created_at']) AS f, unnest([email_ratio, phone_ratio, date_ratio]) AS r FROM st) WHERE r > 0
  UNION ALL SELECT column_index, f, 3, 'pattern', r * 0.6 FROM (SELECT column_index, unnest(['name', 'company', 'crm_status']) AS f, unnest([name_ratio, company_ratio, status_ratio]) AS r FROM st) WHERE r > 0
  UNION ALL SELECT m.column_index, field_id, 3, 'pattern', location_ratio * 0.6 FROM m JOIN st USING (column_index) WHERE field_id IN ('city', 'state', 'country') AND location_ratio > 0),
ba AS (SELECT column_index, field_id, 1 - product(1 - greatest(0, least(1, weight))) AS base, min(rule) AS rule, list_sort(list_distinct(list(source))) AS evidence FROM sig GROUP BY column_index, field_id),
co AS (SELECT ba.*, round(greatest(0, least(1, base + CASE WHEN st.n < 3 OR NOT EXISTS (SELECT 1 FROM m WHERE m.column_index = ba.column_index AND m.field_id = ba.field_id) THEN 0
    WHEN field_id IN ({O.quoted(V.VARIED)}) THEN CASE WHEN uniqueness >= 0.6 THEN 0.2 ELSE -0.2 END WHEN field_id IN ({O.quoted(V.REPEATED)}) THEN CASE WHEN uniqueness <= 0.5 THEN 0.2 ELSE -0.2 END ELSE 0 END)), 12) AS confidence
  FROM ba JOIN st USING (column_index)),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_index ORDER BY confidence DESC, rule, list_position({_ORDER}, field_id)) AS rank FROM co WHERE confidence >= 0.05),
ti AS (SELECT st.column_index, st.header, rk.field_id, rk.confidence, CASE WHEN rk.confidence IS NULL THEN 'unknown' WHEN rk.confidence >= 0.85 THEN 'deterministic' WHEN rk.confidence >= 0.4 THEN 'ai_candidate' ELSE 'ai_required' END AS tier
  FROM st LEFT JOIN rk ON st.column_index = rk.column_index AND rk.rank = 1)
"""


def _analysis(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    heads = profile.header_profiles(spark.createDataFrame([("", i, c) for i, c in enumerate(O.LEAD_COLUMNS)], "upload_id string, column_index int, header string"))
    return semantic.analyze_semantics(heads, lead_fields(spark, sf_dir))


@query(_RANKED + "SELECT column_index, field_id, round(confidence, 9)::DOUBLE AS confidence, CAST(rank AS INTEGER) AS rank, array_to_string(evidence, ',') AS evidence FROM rk WHERE rank <= 5")
def field_confidences(spark, sf_dir):
    return _analysis(spark, sf_dir)["ranked"].select("column_index", "field_id", F.round("confidence", 9).alias("confidence"), "rank", F.array_join("evidence", ",").alias("evidence"))


@query(_RANKED + """SELECT ti.column_index, tier, ti.field_id AS top_field, round(coalesce(ti.confidence, 0), 9)::DOUBLE AS top_confidence,
  coalesce((SELECT string_agg(rk.field_id || ' ' || CAST(round(rk.confidence * 1000) AS INTEGER)::VARCHAR, ',' ORDER BY rk.rank) FROM rk WHERE rk.column_index = ti.column_index AND rk.rank BETWEEN 2 AND 5), '') AS alternates FROM ti""")
def semantic_context(spark, sf_dir):
    said = F.transform("alternates", lambda x: F.concat(x["field_id"], F.lit(" "), F.round(x["confidence"] * 1000).cast("int").cast("string")))
    return _analysis(spark, sf_dir)["context"].select("column_index", "tier", "top_field", F.round("top_confidence", 9).alias("top_confidence"), F.array_join(said, ",").alias("alternates"))


_TIERS = ("deterministic", "ai_candidate", "ai_required", "unknown")


@query(_RANKED + "SELECT CAST(count(*) AS BIGINT) AS columns_analyzed, " + ", ".join(f"CAST(count(*) FILTER (tier = '{t}') AS BIGINT) AS {t}_count, coalesce(string_agg(CAST(column_index AS VARCHAR), ',' ORDER BY column_index) FILTER (tier = '{t}'), '') AS {t}_columns" for t in _TIERS) + ", count(*) FILTER (tier IN ('deterministic', 'ai_candidate')) / count(*) AS coverage, round(avg(coalesce(confidence, 0)), 9)::DOUBLE AS average_confidence FROM ti")
def semantic_report(spark, sf_dir):
    got = _analysis(spark, sf_dir)["report"]
    return got.select("columns_analyzed", *(f"{t}_count" for t in _TIERS), *(F.array_join(F.transform(f"{t}_columns", lambda i: i.cast("string")), ",").alias(f"{t}_columns") for t in _TIERS), "coverage", F.round("average_confidence", 9).alias("average_confidence"))
