"""Queries about files, records that aren't well formed, batches and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import answers, batches, cells, closest, incremental, ledger, semantic, trust
from ..sources import datasource, delimited, large
from ..sources.storage import shared_path, stored
from . import oracle as O
from .leads import spread, table
from .queries import _RAW, raw_records
from .registry import query

# files

#: Contents of all sorts, in SQL that both engines understand.
_BODY = "case when k % 7 = 0 then '' when k % 7 = 1 then concat('  ', chr(10), ' ') when k % 17 = 0 then repeat('x', 300) when k % 5 = 0 then repeat('ab,', 30) else concat('name,email', chr(10), c_name) end"
_FILES = f"""WITH b AS (SELECT c_custkey AS k, {_BODY} AS body FROM customer),
f AS (SELECT k, body, length(body) AS n, CASE WHEN k % 7 = 2 THEN 2 + 2 * length(body) ELSE length(body) END AS raw FROM b),
u AS (SELECT *, 'file' || CAST(k AS VARCHAR) AS upload_id, CASE WHEN raw > 256 THEN raw ELSE n END AS size, CASE WHEN k % 3 = 0 THEN n + 1 ELSE raw END AS declared FROM f)
"""


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without content, blank, long or in UTF-16, some without name or type or with a wrong size, as ``binaryFile`` rows."""
    rows = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")).select("k", F.expr(_BODY).alias("body"))
    marked = F.concat(F.unhex(F.lit("FFFE")), F.encode("body", "UTF-16LE"))
    content = F.when(F.col("k") % 7 == 2, marked).otherwise(F.encode("body", "UTF-8"))
    rows = rows.select("k", "body", F.concat(F.lit("file"), F.col("k").cast("string")).alias("path"), content.alias("content")).withColumn("length", F.length("content"))
    return rows.select(
        "path", "content", "length", F.when(F.col("k") % 11 != 0, "a.csv").alias("file_name"), F.when(F.col("k") % 13 == 0, " ").otherwise("text/csv").alias("mime_type"),
        F.when(F.col("k") % 3 == 0, F.length("body") + 1).otherwise(F.col("length")).alias("declared_bytes"),
    )


@query(_FILES + """, e AS (SELECT *, list_filter([CASE WHEN k % 11 = 0 THEN 'MISSING_FILE_NAME' END, CASE WHEN k % 13 = 0 THEN 'MISSING_MIME_TYPE' END, CASE WHEN raw <= 256 AND k % 7 IN (0, 1) THEN 'EMPTY_FILE' END, CASE WHEN size > 64 THEN 'FILE_TOO_LARGE' END], lambda c: c IS NOT NULL) AS codes FROM u)
SELECT upload_id, unnest(codes) AS code, 'error' AS severity FROM e UNION ALL SELECT upload_id, 'DECLARED_SIZE_MISMATCH', 'warning' FROM e WHERE len(codes) = 0 AND declared <> size""")
def upload_checks(spark, sf_dir):
    return delimited.verify_uploads(odd_files(spark, sf_dir), 64)


@query(_FILES + "SELECT upload_id, CASE WHEN raw > 64 THEN 'FILE_TOO_LARGE' WHEN body = '' THEN 'EMPTY_DATASET' WHEN k % 7 = 1 THEN 'HEADERLESS_FILE' END AS error, CAST(CASE WHEN raw > 64 OR k % 7 IN (0, 1) THEN 0 ELSE 1 END AS BIGINT) AS n_rows FROM u")
def parse_errors(spark, sf_dir):
    datasets, rows = delimited.parse(delimited.read_records(odd_files(spark, sf_dir), 64))
    counts = rows.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))
    return datasets.join(counts, "upload_id", "left").select("upload_id", "error", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("""SELECT 'file' || CAST(c_custkey AS VARCHAR) AS upload_id, 'name|' || c_mktsegment || '|Column 3|name (2)|' || c_mktsegment || ' (2)|Column 6|name (3)' AS headers,
  'true|true|false|true|true|false|true' AS repeated FROM customer""")
def header_repeats(spark, sf_dir):
    line = F.concat(F.lit("name,"), "c_mktsegment", F.lit(",,name,"), "c_mktsegment", F.lit(", ,name\n1,2"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("file"), F.col("c_custkey").cast("string")).alias("path"), F.encode(line, "UTF-8").alias("content")).withColumn("length", F.length("content"))
    datasets, _ = delimited.parse(delimited.read_records(files))
    return datasets.select("upload_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("dup_flags", lambda x: x.cast("string")), "|").alias("repeated"))


@query("""SELECT CAST(c_custkey % 4 AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) - 1 AS BIGINT) AS ordinal,
  c_name || chr(10) || '"' || c_mktsegment || '"' || chr(10) || ',|' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '|5" pipe' ELSE '' END AS raw_cells FROM customer""")
def split_files(spark, sf_dir):
    """Files whose cells hold line ends, quotes and delimiters, written and read in ranges of some kilobytes."""
    k = F.col("c_custkey")
    line = F.concat(F.lit('"'), "c_name", F.lit('\n""'), "c_mktsegment", F.lit('""\n,", "'), k.cast("string"), F.lit('"'), F.when(k % 3 == 0, F.lit(',5" pipe')).otherwise(""))
    rows = table(spark, sf_dir, "customer").select((k % 4).alias("part"), k, line.alias("value")).repartition("part").sortWithinPartitions("part", "c_custkey")
    path = shared_path(spark, "split-files")
    rows.select("part", "value").write.partitionBy("part").text(path)
    got = large.read_large(spark, path, 1 << 12)
    return got.select(F.regexp_extract("upload_id", r"part=(\d+)", 1).cast("int").alias("part"), "ordinal", F.array_join("raw_cells", "|").alias("raw_cells"))


@query("""SELECT CAST(c_custkey % 4 AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS BIGINT) AS row_number, CAST(c_custkey AS VARCHAR) AS key, c_name || ';"x"' AS name,
  CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' ' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN 'recovered' ELSE 'ok' END AS status FROM customer""")
def source_files(spark, sf_dir):
    """Files written by line and read through the data source in ranges of some kilobytes; every seventh leaves a quote open."""
    k = F.col("c_custkey")
    line = F.concat(k.cast("string"), F.lit(';"'), "c_name", F.lit(';""x"""'), F.lit(";"), F.when(k % 5 == 0, F.concat("c_mktsegment", F.when(k % 7 == 0, F.lit(" ")).otherwise(""), F.lit(";more"))).when(k % 7 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit(" "))).otherwise(F.col("c_mktsegment")))
    rows = table(spark, sf_dir, "customer").select((k % 4).cast("int").alias("part"), k, line.alias("value"))
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("long").alias("c_custkey"), F.lit("key;name;segment\n;;").alias("value"))
    path = shared_path(spark, "source-files")
    rows.select("part", k.cast("long"), "value").unionByName(heads).repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path)
    records = spark.read.format(datasource.register(spark)).option("multiline", "false").option("range_bytes", 1 << 14).load(path)
    _, got = delimited.parse(stored(records, "source-records"))  # read by Python once, not once for each of the heads, counts and rows
    cell = lambda i: F.get("cells", F.lit(i))
    return got.select(F.regexp_extract("upload_id", r"part=(\d+)", 1).cast("int").alias("part"), "row_number", cell(0).alias("key"), cell(1).alias("name"), cell(2).alias("segment"), "status")


# records

_NAMES = f"[{O.quoted(trust.FIELDS)}]"


@query(f"""WITH r AS (SELECT c_custkey AS k, list_filter({_NAMES}, lambda f: (list_position({_NAMES}, f) + c_custkey) % 4 <> 0) AS has FROM customer)
SELECT k AS row_number, array_to_string(list_filter({_NAMES}, lambda f: NOT list_contains(has, f)), ',') AS missing, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'nickname' END, CASE WHEN k % 5 = 0 THEN 'age' END) AS unknown FROM r""")
def schema_diff(spark, sf_dir):
    k = F.col("c_custkey")
    names = F.array(*(F.when((k + i + 1) % 4 != 0, F.lit(f)) for i, f in enumerate(trust.FIELDS)), F.when(k % 3 == 0, F.lit("nickname")), F.when(k % 5 == 0, F.lit("age")))
    fields = F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("target_field"), F.lit("x").alias("value")))
    got = table(spark, sf_dir, "customer").select(k.alias("row_number"), trust.schema_issues(fields).alias("i"))
    of = lambda code: F.array_join(F.transform(F.filter("i", lambda x: x["code"] == code), lambda x: F.substring_index(x["message"], ":", 1)), ",")
    return got.select("row_number", of("MISSING_FIELD").alias("missing"), of("UNKNOWN_FIELD").alias("unknown"))


_ODD = {
    "data_source": "case k % 4 when 0 then 'eden_park' when 1 then 'Eden Park' when 2 then 'Varah-Swamy ' else 'nowhere at all' end",
    "country_code": "case k % 3 when 0 then '+91' when 1 then '12345' else ' 44 ' end",
    "description": "case when k % 50 = 0 then repeat('x', 2001) when k % 7 = 0 then '   ' else ' ok' end",
}


@query(f"""WITH r AS (SELECT c_custkey AS k FROM customer), v AS ({' UNION ALL '.join(f"SELECT k, '{f}' AS target_field, {sql} AS value FROM r" for f, sql in _ODD.items())}),
d AS (SELECT v.*, a, i, levenshtein(regexp_replace(lower(trim(value)), '[\\s-]+', '_', 'g'), a) AS d FROM v, (VALUES {', '.join(f"('{a}', {i})" for i, a in enumerate(trust.DATA_SOURCE))}) t(a, i) WHERE target_field = 'data_source'),
n AS (SELECT k, CASE WHEN min(d) <= 3 THEN arg_min(a, d * 10 + i) END AS near FROM d GROUP BY k),
f AS (SELECT v.*, CASE WHEN target_field = 'data_source' AND value NOT IN ({O.quoted(trust.DATA_SOURCE)}) AND near IS NOT NULL THEN 'enum_closest_match' WHEN trim(value) <> value THEN 'trim_whitespace' END AS repair,
  CASE WHEN target_field = 'data_source' AND value NOT IN ({O.quoted(trust.DATA_SOURCE)}) AND near IS NOT NULL THEN near ELSE trim(value) END AS fixed FROM v JOIN n USING (k))
SELECT k AS row_number, target_field, repair, CAST(length(fixed) AS INTEGER) AS fixed_length,
  CAST(CASE target_field WHEN 'data_source' THEN fixed NOT IN ({O.quoted(trust.DATA_SOURCE)}) WHEN 'country_code' THEN NOT regexp_matches(fixed, '^\\+?\\d{{1,4}}$') ELSE false END AS INTEGER) AS errors,
  CAST(target_field = 'description' AND (fixed = '' OR length(fixed) > 2000) AS INTEGER) AS warnings FROM f""")
def field_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    fields = F.array(*(F.struct(F.lit(f).alias("target_field"), F.expr(sql).alias("value"), F.lit(1.0).alias("confidence"), F.lit("").alias("source_header")) for f, sql in _ODD.items()))
    got = rows.select("k", F.explode(trust.repaired(fields)).alias("f")).select(F.col("k").alias("row_number"), "f.*")
    got = got.withColumn("p", trust.field_problems(F.col("target_field"), F.col("fixed")))
    return got.select("row_number", "target_field", "repair", F.length("fixed").alias("fixed_length"), F.size("p.errors").alias("errors"), F.size("p.warnings").alias("warnings"))


@query(_RAW + """SELECT row_number, CASE WHEN email IS NULL AND phone IS NULL THEN 'skipped' WHEN b_err > 0 THEN 'business_errors' WHEN rc >= 0.75 AND qs >= 70 AND repairs <= 3 THEN 'clears_thresholds'
  WHEN rc < 0.4 OR qs < 40 THEN 'below_floor' WHEN repairs > 3 THEN 'many_repairs' ELSE 'uncertain' END AS decision_code, CASE st WHEN 'approved' THEN '' ELSE 'APPROVAL_' || upper(st) END AS issue FROM z""")
def decision_reasons(spark, sf_dir):
    got = trust.run_trust(raw_records(spark, sf_dir))
    issue = F.coalesce(F.get(F.filter("issues", lambda i: i["category"] == "approval"), F.lit(0))["code"], F.lit(""))
    return got.select("row_number", "decision_code", issue.alias("issue"))


# batches

_BATCHES = _RAW + """, bt AS (SELECT CAST(floor((row_number - 1) / 25) AS BIGINT) + 1 AS i, count(*) AS record_count FROM z GROUP BY 1),
rs AS (SELECT *, 'import-batch-' || CAST(i AS VARCHAR) AS batch_id, CASE WHEN i % 7 = 3 THEN 'cancelled' WHEN i % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN i % 7 = 3 THEN 'BATCH_CANCELLED' WHEN i % 5 = 0 THEN 'PROVIDER_ERROR' ELSE '' END AS errors, CASE WHEN i % 7 <> 3 AND i % 4 = 0 THEN 'RAGGED_ROWS_ADJUSTED' ELSE '' END AS warnings,
  CASE WHEN i % 7 <> 3 THEN i * 1000 END AS s, CASE WHEN i % 7 <> 3 THEN i * 1000 + record_count * 10 + i % 3 END AS e, CASE WHEN i % 7 <> 3 THEN i / 64 END AS c FROM bt)
"""


def import_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The reconciled batches of the leads and their validated records; every seventh batch has no result."""
    records = batches.assign_batches(trust.run_trust(raw_records(spark, sf_dir)), 25)
    records = stored(records.select("row_number", "batch_id", "batch_index", "approval_status"), "import-records")  # used for the batches and for each split
    made = records.groupBy("batch_id", "batch_index").agg(F.count(F.lit(1)).alias("record_count"))
    i = F.col("batch_index")
    codes = lambda holds, code: F.when(holds, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    results = made.filter(i % 7 != 3).select(
        "batch_id", F.when(i % 5 == 0, "failed").otherwise("completed").alias("status"), (i * 1000).alias("started_ms"), (i * 1000 + F.col("record_count") * 10 + i % 3).alias("ended_ms"),
        (i / 64).alias("cost_usd"), codes(i % 4 == 0, "RAGGED_ROWS_ADJUSTED").alias("warnings"), codes(i % 5 == 0, "PROVIDER_ERROR").alias("errors"),
    )
    return batches.reconcile(made.drop("batch_index"), results), records


@query(_BATCHES + "SELECT batch_id, CAST(record_count AS BIGINT) AS record_count, status, errors, warnings FROM rs")
def batch_results(spark, sf_dir):
    got, _ = import_batches(spark, sf_dir)
    return got.select("batch_id", "record_count", "status", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(_BATCHES + """SELECT 'records' AS kind, st AS name, CAST(count(*) AS BIGINT) AS n FROM z JOIN rs ON CAST(floor((z.row_number - 1) / 25) AS BIGINT) + 1 = rs.i WHERE rs.status = 'completed' GROUP BY st
UNION ALL SELECT 'batches', status, count(*) FROM rs WHERE status <> 'completed' GROUP BY status
UNION ALL SELECT 'error', errors, count(*) FROM rs WHERE errors <> '' GROUP BY errors UNION ALL SELECT 'warning', warnings, count(*) FROM rs WHERE warnings <> '' GROUP BY warnings""")
def import_outcome(spark, sf_dir):
    got = batches.outcome(*import_batches(spark, sf_dir))
    count = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = [count(got[s], "records", "approval_status") for s in ("approved", "needs_review", "rejected", "skipped")]
    parts += [count(got["failed"], "batches", "status"), count(got["issues"], F.col("severity"), "code")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(_BATCHES + """SELECT st AS part, batch_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(row_number) AS BIGINT) AS total, '' AS code FROM z JOIN rs ON CAST(floor((z.row_number - 1) / 25) AS BIGINT) + 1 = rs.i WHERE rs.status = 'completed' GROUP BY ALL
UNION ALL SELECT 'failed', batch_id, 1, CAST(record_count AS BIGINT), status FROM rs WHERE status <> 'completed'
UNION ALL SELECT 'issues', batch_id, 1, NULL, 'error ' || errors FROM rs WHERE errors <> '' UNION ALL SELECT 'issues', batch_id, 1, NULL, 'warning ' || warnings FROM rs WHERE warnings <> ''""")
def outcome_ledger(spark, sf_dir):
    """The outcome of an import, written twice in one pass each, read back by part."""
    made, records = import_batches(spark, sf_dir)
    path, one = shared_path(spark, "ledger"), F.lit(1).cast("long")
    ledger.write_outcome(made, records.filter("row_number % 2 = 0"), path, "leads")
    ledger.write_outcome(made, records, path, "leads", version=2)
    read = lambda part, schema: ledger.read_part(spark, path, part, schema)
    out = read("failed", made.schema).select(F.lit("failed").alias("part"), "batch_id", one.alias("n"), F.col("record_count").alias("total"), F.col("status").alias("code"))
    out = out.unionByName(read("issues", "").select(F.lit("issues").alias("part"), "batch_id", one.alias("n"), F.lit(None).cast("long").alias("total"), F.concat_ws(" ", "severity", "code").alias("code")))
    for part in ledger.STATUSES:
        got = read(part, records.schema).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_number").cast("long").alias("total"))
        out = out.unionByName(got.select(F.lit(part).alias("part"), "batch_id", "n", "total", F.lit("").alias("code")))
    return out


@query(_BATCHES + """SELECT CAST(count(*) AS BIGINT) AS batch_count, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed_count, CAST(count(*) FILTER (status <> 'completed') AS BIGINT) AS failed_count, CAST(sum(record_count) AS BIGINT) AS record_count,
  sum(c)::DOUBLE AS cost_usd, CAST(max(e) - min(s) AS BIGINT) AS elapsed_ms, CAST(sum(e - s) AS BIGINT) AS busy_ms, round(least(1, sum(e - s) / ((max(e) - min(s)) * 8)), 9)::DOUBLE AS utilization,
  round(sum(record_count) / ((max(e) - min(s)) / 1000), 9)::DOUBLE AS records_per_second, round(count(*) FILTER (status = 'completed') / count(*) * 100, 9)::DOUBLE AS percent_complete,
  round((max(e) - min(s)) / count(e) * (count(*) - count(e)), 6)::DOUBLE AS remaining_ms FROM rs""")
def execution_metrics(spark, sf_dir):
    got = batches.execution_metrics(import_batches(spark, sf_dir)[0], 8)
    rounded = [F.round(c, 9).alias(c) for c in ("utilization", "records_per_second", "percent_complete")]
    return got.select("batch_count", "completed_count", "failed_count", "record_count", "cost_usd", "elapsed_ms", "busy_ms", *rounded, F.round("remaining_ms", 6).alias("remaining_ms"))


@query(_RAW + "SELECT CAST(count(*) AS BIGINT) AS record_count, CAST(count(*) FILTER (st = 'approved') AS BIGINT) AS approved_count, CAST(count(*) FILTER (st = 'needs_review') AS BIGINT) AS needs_review_count, CAST(count(*) FILTER (st = 'rejected') AS BIGINT) AS rejected_count, CAST(count(*) FILTER (st = 'skipped') AS BIGINT) AS skipped_count, round(avg(rc), 6) AS average_confidence, round(avg(qs), 6) AS average_quality, CAST(sum(repairs) AS BIGINT) AS repair_count FROM z")
def incremental_summary(spark, sf_dir):
    """Batches that come out of order, twice, and once with numbers that a later run corrects."""
    got = batches.assign_batches(trust.run_trust(raw_records(spark, sf_dir)), 25)
    got = stored(got.select("batch_id", "batch_index", "approval_status", "repair_count", "quality_score", "record_confidence"), "incremental-records")
    path, i = shared_path(spark, "incremental"), F.col("batch_index")
    incremental.record_batches(got.filter(i % 3 > 0).withColumn("repair_count", F.col("repair_count") + F.when(i % 2 == 0, 1).otherwise(0)), path)
    incremental.record_batches(got.filter(i % 2 == 0), path, version=2)
    incremental.record_batches(got.filter(i % 3 == 0), path)
    incremental.record_batches(got.filter(i % 2 == 1), path)
    out = incremental.merged_summary(incremental.latest(spark, path))
    return out.withColumns({c: F.round(c, 6) for c in ("average_confidence", "average_quality")})


# answers

_BROKEN = """case event_id % 12
  when 0 then concat('{"said": "', event_type, '", "list": [1, 2,], "open": {"a": ', cast(event_id as string))
  when 1 then concat('{“said”: “', event_type, '”}')
  when 2 then concat('{said: "', event_type, '", other: ', cast(event_id as string), '}')
  when 3 then concat('{"said": "', event_type, chr(9), 'x"')
  when 4 then concat('{"said": "', event_type, '"}')
  when 5 then concat('nothing said of ', event_type)
  when 6 then concat('{"said": "', event_type, '’s ‘', cast(event_id as string), '’"}')
  when 7 then concat('{said: NaN, id: ', cast(event_id as string), '}')
  when 8 then concat('{"said": "', event_type, '\\\\q"}')
  when 9 then concat('{"said": "', event_type)
  when 10 then concat('[{"said": "', event_type, ', }"}, ]')
  else concat('{"said": "', event_type, '"]') end"""

_KEY = '{"said": "'


@query(f"""WITH b AS (SELECT event_id, event_type AS t, CAST(event_id AS VARCHAR) AS i, event_id % 12 AS k FROM events)
SELECT event_id, k NOT IN (4, 5, 6, 7, 11) AS success,
  CASE k WHEN 0 THEN 'TRAILING_COMMA_REMOVED,UNBALANCED_BRACKETS_CLOSED' WHEN 1 THEN 'SMART_QUOTES_NORMALIZED' WHEN 2 THEN 'UNQUOTED_KEY_QUOTED' WHEN 3 THEN 'CONTROL_CHARACTER_ESCAPED,UNBALANCED_BRACKETS_CLOSED'
    WHEN 7 THEN 'UNQUOTED_KEY_QUOTED' WHEN 8 THEN 'INVALID_ESCAPE_FIXED' WHEN 9 THEN 'UNTERMINATED_STRING_CLOSED,UNBALANCED_BRACKETS_CLOSED' WHEN 10 THEN 'TRAILING_COMMA_REMOVED' ELSE '' END AS repairs,
  CASE k WHEN 0 THEN '{_KEY}' || t || '", "list": [1, 2], "open": {{"a": ' || i || '}}}}' WHEN 1 THEN '{_KEY}' || t || '"}}' WHEN 2 THEN '{_KEY}' || t || '", "other": ' || i || '}}' WHEN 3 THEN '{_KEY}' || t || '\\tx"}}'
    WHEN 7 THEN '{{"said": NaN, "id": ' || i || '}}' WHEN 8 THEN '{_KEY}' || t || '\\\\q"}}' WHEN 9 THEN '{_KEY}' || t || '"}}' WHEN 10 THEN '[{_KEY}' || t || ', }}"}} ]' END AS repaired FROM b""")
def json_repair(spark, sf_dir):
    got = table(spark, sf_dir, "events").select("event_id", text.repair_json(F.expr(_BROKEN)).alias("r"))
    return got.select("event_id", "r.success", F.array_join("r.repairs", ",").alias("repairs"), F.col("r.text").alias("repaired"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'EMPTY_RESPONSE' WHEN 1 THEN 'SURROUNDING_TEXT_STRIPPED' WHEN 2 THEN 'MARKDOWN_CODE_BLOCK_STRIPPED' WHEN 3 THEN 'MARKDOWN_CODE_BLOCK_STRIPPED,SURROUNDING_TEXT_STRIPPED' WHEN 4 THEN 'JSON_PARSE_FAILED' ELSE '' END AS codes,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 4 THEN event_type ELSE '{"a": "' || event_type || '"}' END AS candidate FROM events""")
def answer_parts(spark, sf_dir):
    k, json = F.col("event_id") % 6, F.concat(F.lit('{"a": "'), "event_type", F.lit('"}'))
    answer = F.when(k == 0, F.lit(" \n")).when(k == 1, F.concat(F.lit("So: "), json, F.lit(". Done"))).when(k == 2, F.concat(F.lit("Here:\n```JSON\n"), json, F.lit("\n```\nor [1]")))
    answer = answer.when(k == 3, F.concat(F.lit("```\nthis is it: "), json, F.lit(" \n```"))).when(k == 4, F.col("event_type")).otherwise(F.concat(F.lit(" "), json))
    return spread(table(spark, sf_dir, "events"), "event_id").select("event_id", F.array_join(text.answer_diagnostics(answer), ",").alias("codes"), text.json_candidate(answer).alias("candidate"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'EMPTY_RESPONSE' WHEN 1 THEN 'JSON_PARSE_FAILED' END AS problem FROM events")
def answer_problems(spark, sf_dir):
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.lit(" \n")).when(k == 1, F.concat("event_type", F.lit(': {"a": 1'))).when(k == 2, F.concat(F.lit('So: {"a": "'), "event_type", F.lit('"}.'))).otherwise(F.concat(F.lit('```json\n{"a": "'), "event_type", F.lit('"}\n```')))
    return spread(table(spark, sf_dir, "events"), "event_id").select("event_id", text.answer_problem(answer).alias("problem"))


@query("""WITH p(model, a, b) AS (VALUES ('user', 0.25, 1.5), ('assistant', 3.0, 0.125)), t AS (SELECT conv_id, turn, role, CAST(ceil(length(text) / 4) AS BIGINT) AS prompt_tokens, CAST(greatest(turn, 0) * 60 AS BIGINT) AS completion_tokens FROM conversations)
SELECT conv_id, turn, prompt_tokens, completion_tokens, round(prompt_tokens / 1000 * a + completion_tokens / 1000 * b, 9)::DOUBLE AS cost_usd FROM t LEFT JOIN p ON role = model""")
def cost_estimates(spark, sf_dir):
    prices = spark.createDataFrame([("user", 0.25, 1.5), ("assistant", 3.0, 0.125)], "model string, prompt_price double, completion_price double")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.estimate_tokens(F.col("text")).alias("prompt_tokens"), text.completion_tokens(F.col("turn")).alias("completion_tokens"))
    return text.with_cost(rows, prices, "role").select("conv_id", "turn", "prompt_tokens", "completion_tokens", F.round("cost_usd", 9).alias("cost_usd"))


def _provider(prompt: str) -> str:
    number, keys = prompt.removeprefix("batch ").split(":")
    if int(number) % 5 == 0:
        raise TimeoutError("no answer in time")
    if int(number) % 7 == 0:
        return "I don't know"
    listed = ", ".join(f'{{"key": {k}, "twice": {2 * int(k)}}}' for k in keys.split(","))
    return f"Here it is:\n```json\n[{listed}]\n```"


@query("""WITH b AS (SELECT c_custkey // 25 AS i, count(*) AS n, sum(2 * c_custkey) AS total FROM customer GROUP BY 1)
SELECT CAST(i AS VARCHAR) AS batch_id, CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN i % 5 = 0 THEN 'PROVIDER_ERROR' WHEN i % 7 = 0 THEN 'JSON_PARSE_FAILED' ELSE '' END AS problem,
  CASE WHEN i % 5 = 0 THEN '' WHEN i % 7 = 0 THEN 'JSON_PARSE_FAILED' ELSE 'MARKDOWN_CODE_BLOCK_STRIPPED' END AS diagnostics, CAST(CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN 0 ELSE n END AS INTEGER) AS record_count, CAST(CASE WHEN i % 5 <> 0 AND i % 7 <> 0 THEN total END AS BIGINT) AS total FROM b""")
def resumed_answers(spark, sf_dir):
    """Batches of customers, asked about in two runs of which the second asks for the rest."""
    b = F.floor(F.col("c_custkey") / 25).cast("long")
    rows = table(spark, sf_dir, "customer").groupBy(b.alias("b")).agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))
    prompts = rows.select(F.col("b").cast("string").alias("batch_id"), F.format_string("batch %s:%s", F.col("b").cast("string"), F.array_join(F.col("keys").cast("array<string>"), ",")).alias("prompt"))
    path = shared_path(spark, "answers-kept")
    answers.ask(prompts.filter("batch_id % 2 = 0"), _provider, path)
    answers.ask(prompts, _provider, path, attempt=2)
    got = answers.split_answers(answers.answered(prompts, path), "struct<key:long,twice:long>")
    sums = got["records"].groupBy("batch_id").agg(F.sum("twice").alias("total"))
    return got["report"].join(sums, "batch_id", "left").select("batch_id", "status", F.coalesce("problem", F.lit("")).alias("problem"), F.array_join("diagnostics", ",").alias("diagnostics"), "record_count", "total")


# rules and classifiers of the caller


def _key_of(value: str) -> str:
    number = int(value.removeprefix("Customer#"))
    if number % 10 == 0:
        raise ValueError("a round number")
    return str(number)


CALLERS_RULES = [
    rules.Rule("segment", lambda v: v.rlike("^[A-Z]+$"), lambda v: rules.outcome(F.lower(v), 0.9, [(v == "BUILDING", "OLD_SEGMENT", "no longer used")], F.when(v == "MACHINERY", F.lit("no such segment")))),
    rules.python_rule("customer_key", lambda v: v.startswith("Customer#"), _key_of),
    *rules.CONTENT,
]


@query("""WITH c AS (SELECT c_custkey AS row_number, 'c_name' AS header, c_name AS v, CAST(substr(c_name, 10) AS BIGINT) AS n FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer),
f AS (SELECT *, CASE WHEN header = 'c_name' THEN n % 10 = 0 ELSE v = 'MACHINERY' END AS failed FROM c)
SELECT row_number, header, CASE WHEN failed THEN v WHEN header = 'c_name' THEN CAST(n AS VARCHAR) ELSE lower(v) END AS normalized_value, CASE WHEN failed THEN '' WHEN header = 'c_name' THEN 'customer_key' ELSE 'segment' END AS applied,
  CASE WHEN failed THEN 'failed' WHEN v = 'BUILDING' THEN 'warning' ELSE 'normalized' END AS status, CASE WHEN failed THEN 0.0 WHEN header = 'c_name' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN failed THEN 'NORMALIZATION_RULE_ERROR' WHEN v = 'BUILDING' THEN 'OLD_SEGMENT' ELSE '' END AS codes FROM f""")
def callers_rules(spark, sf_dir):
    rows = cells.to_cells(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"])
    got = cells.normalize_cells(rows, compose=False, content=CALLERS_RULES)
    return got.select("row_number", "header", "normalized_value", F.array_join("applied_rules", ",").alias("applied"), "status", "confidence", F.array_join("warnings.code", ",").alias("codes"))


@query("""WITH c AS (SELECT 'c_name' AS header, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', lower(c_mktsegment) FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT header, CAST(count(*) AS BIGINT) AS total_count, round(count(*) FILTER (regexp_matches(v, '^[a-z]+$')) / count(*), 9)::DOUBLE AS small_ratio, round(count(*) FILTER (regexp_matches(v, '[05]$')) / count(*), 9)::DOUBLE AS round_ratio FROM c GROUP BY header""")
def callers_classifiers(spark, sf_dir):
    rows = cells.to_cells(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"])
    fields = cells.normalize_cells(rows, compose=False, content=[CALLERS_RULES[0]])
    got = semantic.analyze_columns(fields, {"small": lambda v: v.rlike("^[a-z]+$"), "round": lambda v: v.rlike("[05]$")})
    header = F.element_at(F.array(F.lit("c_name"), F.lit("c_mktsegment")), F.col("column_index") + 1)
    return got.select(header.alias("header"), "total_count", F.round("small_ratio", 9).alias("small_ratio"), F.round("round_ratio", 9).alias("round_ratio"))


#: Countries of the fixture and others: calling code and the first digits of a number that its plan has.
_NUMBERS = [("213", "551"), ("54", "911"), ("55", "119"), ("86", "139"), ("39", "061"), ("254", "712"), ("7", "912"), ("966", "501"), ("84", "912"), ("44", "712"), ("1", "2125"), ("962", "790"), ("999", "555")]
_LENGTHS = {"213": 9, "54": 11, "55": 11, "86": 11, "39": 10, "254": 9, "7": 10, "966": 9, "84": 9, "44": 10, "1": 10, "962": 9, "999": 9}


@query(f"""WITH p(i, code, lead_, n) AS (VALUES {', '.join(f"({i}, '{c}', '{d}', {_LENGTHS[c]})" for i, (c, d) in enumerate(_NUMBERS))}),
d AS (SELECT c_custkey AS row_number, code, lead_ || lpad(CAST(c_custkey AS VARCHAR), CAST(n - length(lead_) AS INTEGER), '7') AS national, c_custkey % 4 = 3 AS long, code <> '999' AND c_custkey % 4 <> 3 AS ok FROM customer JOIN p ON c_custkey % {len(_NUMBERS)} = i),
e AS (SELECT *, CASE WHEN long THEN national || '1234' ELSE national END AS said FROM d)
SELECT row_number, CASE WHEN ok THEN '+' || code || said ELSE code || said END AS value, CASE WHEN ok THEN '+' || code END AS country_code, CASE WHEN ok THEN said ELSE code || said END AS national_number, CASE WHEN ok THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence
FROM e WHERE length(code || said) <= 15""")
def phone_plans(spark, sf_dir):
    k = F.col("c_custkey")
    plans = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(d).alias("lead_"), F.lit(_LENGTHS[c] - len(d)).alias("rest")) for c, d in _NUMBERS))
    rows = table(spark, sf_dir, "customer").select(k.alias("row_number"), F.get(plans, (k % len(_NUMBERS)).cast("int")).alias("p"))
    said = F.concat(F.lit("+"), "p.code", F.lit(" "), "p.lead_", F.lit("-"), F.expr("lpad(cast(row_number as string), p.rest, '7')"), F.when(F.col("row_number") % 4 == 3, F.lit("1234")).otherwise(""))
    rows = rows.withColumn("parts", rules.phone_parts(said)).filter(rules.applies_phone(F.col("parts"))).withColumn("o", rules.phone_rule(F.col("parts")))
    return rows.select("row_number", "o.value", "o.details.phone.country_code", "o.details.phone.national_number", "o.confidence")


_MARKED = "concat(c_name, 'e\u0301 A\u030a \u200b', case when c_custkey % 2 = 0 then 'o\u0323\u0302' else '\u1112\u1161\u11ab' end, chr(7), c_mktsegment)"


@query(f"SELECT c_custkey AS row_number, regexp_replace(nfc_normalize({_MARKED}), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS composed FROM customer")
def composed_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_number"), rules.unicode_rule(F.expr(_MARKED), compose=True).alias("composed"))


_TYPED = "case p_partkey % 5 when 0 then split_part(p_name, ' ', 2) when 1 then substr(split_part(p_name, ' ', 2), 2) when 2 then concat(split_part(p_name, ' ', 2), 'xyz') when 3 then concat(replace(split_part(p_name, ' ', 2), 'i', 'e'), 'o') else p_name end"


@query(f"""WITH w AS (SELECT term, min(doc_id) AS place FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS term FROM documents) GROUP BY term HAVING length(term) <= 24),
v AS (SELECT DISTINCT {_TYPED} AS value FROM part), d AS (SELECT value, term, place, levenshtein(regexp_replace(lower(trim(value)), '[\\s-]+', '_', 'g'), term) AS d FROM v, w),
b AS (SELECT value, min(struct_pack(d := d, place := place, term := term)) AS b FROM d WHERE d <= 3 GROUP BY value)
SELECT v.value, b.term AS closest, CAST(b.d AS INTEGER) AS distance FROM v LEFT JOIN b USING (value)""")
def closest_words(spark, sf_dir):
    """Misspelled words and the closest of all words of the documents."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("term")).filter(F.length("term") <= 24)
    words = words.groupBy("term").agg(F.min("doc_id").alias("place"))
    return closest.closest_terms(table(spark, sf_dir, "part").select(F.expr(_TYPED).alias("value")), words)
