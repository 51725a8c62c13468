"""Profiles of columns and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import detect, text

COLUMN = ["upload_id", "column_index", "header"]


def header_profiles(headers: DataFrame) -> DataFrame:
    """``upload_id, column_index, header`` with the normalized name and whether it repeats."""
    name = text.header_name(F.col("header"))
    rows = headers.withColumn("normalized", name)
    flagged = F.coalesce(F.col("raw_duplicate"), F.lit(False)) if "raw_duplicate" in headers.columns else F.lit(False)
    return rows.withColumn("is_duplicate", (F.count(F.lit(1)).over(W.partitionBy("upload_id", "normalized")) > 1) | flagged)


def disambiguate_headers(headers: DataFrame) -> DataFrame:
    """Blank headers become ``Column n``; the n-th repeat of a text ``text (n)``."""
    same = W.partitionBy("upload_id", "raw_header")
    n = F.row_number().over(same.orderBy("column_index"))
    blank = detect.trim(F.col("raw_header")) == ""
    named = F.when(blank, F.concat(F.lit("Column "), (F.col("column_index") + 1).cast("string"))).when(n > 1, F.concat("raw_header", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("raw_header"))
    return headers.withColumn("header", named).withColumn("raw_duplicate", ~blank & (F.count(F.lit(1)).over(same) > 1))


def column_profiles(cells: DataFrame, samples: int = 5) -> DataFrame:
    """Counts, lengths, shapes and a guessed type of each column.

    Cells are first counted per distinct value, with partial aggregation, so
    a frequent value costs one row, and distinct values need no expansion.
    The first ``samples`` distinct values, by row, are found by rank.
    """
    value = detect.trim(F.coalesce(F.col("raw_value"), F.lit("")))
    values = cells.groupBy(*COLUMN, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))
    some = F.col("value") != ""
    amount = lambda flag: F.coalesce(F.sum(F.when(some & flag, F.col("n"))), F.lit(0)).cast("long")
    total = F.sum("n").cast("long")
    size = F.length("value")
    v = F.col("value")
    base = values.groupBy(*COLUMN).agg(
        total.alias("total_count"),
        F.count_if(some).alias("unique_count"),
        F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).cast("long").alias("missing_count"),
        F.coalesce(F.sum(F.when(some, size * F.col("n"))), F.lit(0)).cast("long").alias("_chars"),
        F.max(F.when(some, size)).alias("max_length"),
        F.min(F.when(some, size)).alias("min_length"),
        amount(detect.looks_like_email(v)).alias("email_matches"),
        amount(detect.looks_like_phone(v)).alias("phone_matches"),
        amount(detect.looks_like_date(v)).alias("date_matches"),
        amount(detect.looks_like_numeric(v)).alias("numeric_matches"),
    )
    filled = F.col("total_count") - F.col("missing_count")
    ratio = lambda c: F.when(filled > 0, F.col(c) / filled).otherwise(0.0)
    base = base.withColumns({
        "null_percentage": F.when(F.col("total_count") > 0, F.col("missing_count") / F.col("total_count") * 100).otherwise(0.0),
        "average_length": F.when(filled > 0, F.col("_chars") / filled).otherwise(0.0),
        "max_length": F.coalesce("max_length", F.lit(0)),
        "min_length": F.coalesce("min_length", F.lit(0)),
    }).drop("_chars")
    ranked = values.filter(some).withColumn("rank", F.row_number().over(W.partitionBy(*COLUMN).orderBy("first_row", "value"))).filter(F.col("rank") <= samples)
    first = ranked.groupBy(*COLUMN).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_first"))
    out = base.join(first, COLUMN, "left").withColumn("samples", F.coalesce(F.transform("_first", lambda s: s["value"]), F.array().cast("array<string>"))).drop("_first")
    return classify_columns(out, ratio, filled)


def classify_columns(profiles: DataFrame, ratio, filled: Column) -> DataFrame:
    """The guessed type: the best ratio, of equal ones the first of email, phone, date, numeric; from one half on."""
    kinds = ["email", "phone", "date", "numeric"]
    best = F.greatest(*(ratio(f"{k}_matches") for k in kinds))
    pick = F.when(filled == 0, "empty").when(best < 0.5, "text")
    for k in kinds:
        pick = pick.when(ratio(f"{k}_matches") == best, k)
    confidence = F.when((filled == 0) | (best < 0.5), 0.0).otherwise(best)
    return profiles.withColumns({"type_guess": pick, "type_confidence": confidence, **{f"likely_{k}": ratio(f"{k}_matches") >= 0.5 for k in kinds}})


def quality_score(malformed: Column, rows: Column, blank: Column, missing: Column, cells: Column, duplicates: Column, columns: Column) -> Column:
    """From 100 down by shares of malformed rows, blank rows, missing cells and repeated headers."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    score = 100 - 40 * share(malformed, rows) - 10 * share(blank, rows + blank) - 30 * share(missing, cells) - 20 * share(duplicates, columns)
    return text.round_half_up(text.clamp(score, 0.0, 100.0)).cast("long")


def dataset_metadata(cells: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Per dataset: rows, columns, missing cells, complexity, quality.

    ``parsed`` may give ``upload_id, malformed_rows, blank_rows, duplicate_headers, n_bytes``.
    """
    blank = detect.trim(F.coalesce(F.col("raw_value"), F.lit(""))) == ""
    counted = cells.groupBy("upload_id", "column_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("missing"))
    out = counted.groupBy("upload_id").agg(F.max("n").alias("row_count"), F.count(F.lit(1)).alias("column_count"), F.sum("n").alias("cell_count"), F.sum("missing").alias("missing_count"))
    if parsed is not None:
        out = out.join(parsed, "upload_id", "left")
    for c in ("malformed_rows", "blank_rows", "duplicate_headers", "n_bytes"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long") if parsed is not None else F.lit(0).cast("long"))
    size = F.col("cell_count")
    return out.withColumns({
        "complexity": F.when(size <= 10_000, "low").when(size <= 200_000, "medium").otherwise("high"),
        "estimated_memory_bytes": F.col("n_bytes") * 3,
        "quality_score": quality_score(*(F.col(c) for c in ("malformed_rows", "row_count", "blank_rows", "missing_count", "cell_count", "duplicate_headers", "column_count"))),
    })


def dataset_intelligence(profiles: DataFrame) -> DataFrame:
    """The columns of each guessed type, in order."""
    grouped = profiles.groupBy("upload_id", "type_guess").agg(F.array_sort(F.collect_list(F.struct("column_index", "header"))).alias("_columns"), F.count(F.lit(1)).alias("column_count"))
    return grouped.withColumn("columns", F.transform("_columns", lambda c: c["header"])).drop("_columns")


def preview(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows, by number; a preview is a report of bounded size."""
    return rows.filter(F.col("row_number") <= limit)


def normalization_report(fields: DataFrame) -> DataFrame:
    """Counts of what normalization did, and the health of the dataset."""
    did = lambda rule: F.array_contains("applied_rules", rule)
    kind = F.col("details.kind")
    counts = {
        "total_fields": F.lit(True),
        "whitespace_normalized": did("whitespace"),
        "unicode_normalized": did("unicode"),
        "null_values_detected": did("null"),
        "emails_normalized": (kind == "email") & F.col("details.email.is_valid"),
        "invalid_emails": (kind == "email") & ~F.col("details.email.is_valid"),
        "phones_normalized": (kind == "phone") & F.col("details.phone.e164").isNotNull(),
        "invalid_phones": (kind == "phone") & F.col("details.phone.e164").isNull(),
        "dates_parsed": (kind == "date") & F.col("details.date.iso").isNotNull(),
        "failed_date_parses": (kind == "date") & F.col("details.date.iso").isNull(),
        "numbers_normalized": (kind == "number") & F.col("details.number.value").isNotNull(),
        "booleans_normalized": (kind == "boolean") & F.col("details.bool.value").isNotNull(),
        "fields_with_warnings": F.col("status") == "warning",
        "fields_failed": F.col("status") == "failed",
    }
    out = fields.groupBy("upload_id").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))
    total = F.col("total_fields")
    penalty = F.when(total > 0, F.col("fields_with_warnings") / total * 40 + F.col("fields_failed") / total * 60).otherwise(0.0)
    return out.withColumn("health_score", text.clamp(text.round_half_up(100 - penalty), 0, 100).cast("long"))


def report_warnings(report: DataFrame) -> DataFrame:
    """One row for each kind of problem that occurred."""
    kinds = [("INVALID_EMAILS", "invalid_emails"), ("PHONES_WITHOUT_COUNTRY", "invalid_phones"), ("UNRESOLVED_DATES", "failed_date_parses"), ("FIELDS_FAILED", "fields_failed")]
    items = F.array(*(F.struct(F.lit(code).alias("code"), F.col(c).alias("count")) for code, c in kinds))
    return report.select("upload_id", F.explode(items).alias("_w")).select("upload_id", "_w.code", "_w.count").filter(F.col("count") > 0)


def field_issues(fields: DataFrame, cap: int = 25) -> DataFrame:
    """The first ``cap`` issues of each dataset, by row and column, with the true total; a bounded report."""
    # an outer generator: a filter on the cells' own columns would be pushed into, and repeat, the rules' expressions
    rows = fields.select("upload_id", "row_number", "column_index", "header", F.posexplode_outer("warnings").alias("_i", "_w")).filter("_w is not null")
    totals = rows.groupBy("upload_id").agg(F.count(F.lit(1)).alias("total_issue_count"))
    order = W.partitionBy("upload_id").orderBy("row_number", "column_index", "_i")
    first = rows.withColumn("issue_rank", F.row_number().over(order)).filter(F.col("issue_rank") <= cap)
    return first.join(totals, "upload_id").select("upload_id", "issue_rank", "row_number", "header", F.col("_w.code").alias("code"), F.col("_w.message").alias("message"), "total_issue_count")
