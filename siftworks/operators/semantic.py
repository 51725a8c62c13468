"""What columns mean: header aliases, value statistics, combined confidence.

All joins here are with small fixed vocabularies, broadcast because their
size is that of the lists in ``vocabulary``; data is aggregated per distinct
value first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import detect, text
from ..functions import vocabulary as V
from .similar import similar_names

COLUMN = ["upload_id", "column_index"]


def _pairs(extra: dict[str, list[str]] | None) -> list[tuple[str, str]]:
    return [(a, f) for source in (V.ALIASES, extra or {}) for f, names in source.items() for a in names]


def alias_table(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``alias, field_id, alias_order``: normalized aliases in order of registration; ``extra`` come last."""
    rows = spark.createDataFrame([(i, a, f) for i, (a, f) in enumerate(_pairs(extra))], "alias_order int, raw string, field_id string")
    rows = rows.select(text.header_name(F.col("raw")).alias("alias"), "field_id", "alias_order")
    return rows.groupBy("alias", "field_id").agg(F.min("alias_order").alias("alias_order"))


def match_headers(headers: DataFrame, threshold: float = 0.45, most: int = 3, extra: dict[str, list[str]] | None = None, registry: DataFrame | None = None) -> DataFrame:
    """``upload_id, column_index, normalized`` with candidates ``field_id, score, match_type, matched_alias``.

    Exact aliases, and only where there are none, the best similar alias of
    each field from ``threshold`` on, the ``most`` best fields. ``registry``
    (``alias, field_id, alias_order``, aliases as ``header_name`` gives them)
    takes the place of the fixed list and of ``extra``; it may have any size,
    is never broadcast by a hint, and only aliases that pass the filters of
    ``similar_names`` are compared.
    """
    names = headers.select("upload_id", "column_index", "normalized")
    aliases = F.broadcast(alias_table(headers.sparkSession, extra)) if registry is None else registry.groupBy("alias", "field_id").agg(F.min("alias_order").alias("alias_order"))
    exact = names.join(aliases, names["normalized"] == aliases["alias"]).select("upload_id", "column_index", "normalized", "field_id", F.lit(1.0).alias("score"), F.lit("exact_alias").alias("match_type"), F.col("alias").alias("matched_alias"), "alias_order")
    rest = names.join(aliases.select("alias"), names["normalized"] == F.col("alias"), "left_anti")
    if registry is None:
        # a generator over the fixed list of aliases, inside each header's row
        entries: dict[tuple[str, str], int] = {}
        for i, (alias, field) in enumerate(_pairs(extra)):
            entries.setdefault((re.sub(r"[\W_]+", "_", alias.lower()).strip("_"), field), i)
        listed = F.array(*(F.struct(F.lit(i).alias("alias_order"), F.lit(a).alias("alias"), F.lit(f).alias("field_id")) for (a, f), i in entries.items()))
        scored = rest.withColumn("e", F.explode(listed)).withColumn("score", text.dice(F.col("normalized"), F.col("e.alias"))).filter(F.col("score") >= threshold)
    else:
        near = similar_names(rest.select(F.col("normalized").alias("name")), aliases, threshold)
        scored = rest.join(near, F.col("normalized") == F.col("name")).join(aliases, "alias").select("upload_id", "column_index", "normalized", F.struct("alias_order", "alias", "field_id").alias("e"), "score")
    of_field = W.partitionBy(*COLUMN, "e.field_id")
    best = scored.withColumns({"_first": F.min("e.alias_order").over(of_field), "_n": F.row_number().over(of_field.orderBy(F.col("score").desc(), "e.alias_order"))}).filter("_n = 1")
    top = best.withColumn("_n", F.row_number().over(W.partitionBy(*COLUMN).orderBy(F.col("score").desc(), "_first"))).filter(F.col("_n") <= most)
    fuzzy = top.select("upload_id", "column_index", "normalized", F.col("e.field_id").alias("field_id"), "score", F.lit("fuzzy").alias("match_type"), F.col("e.alias").alias("matched_alias"), F.col("e.alias_order").alias("alias_order"))
    return exact.unionByName(fuzzy)


def header_ambiguity(matches: DataFrame, gap: float = 0.1) -> DataFrame:
    """Whether the two best candidates of a header lie less than ``gap`` apart."""
    order = W.partitionBy(*COLUMN).orderBy(F.col("score").desc(), "alias_order")
    second = matches.withColumn("_next", F.lead("score").over(order)).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return second.select("upload_id", "column_index", "normalized", F.col("field_id").alias("top_field"), "score", F.coalesce(F.col("score") - F.col("_next") < gap, F.lit(False)).alias("is_ambiguous"))


# shapes of values


def is_currency(v: Column) -> Column:
    return detect.trim(v).rlike(r"(?i)^[+-]?(?:[$€£¥₹]|Rs\.?|USD|EUR|GBP|INR)\s?[\d,]+(?:\.\d+)?%?\z")


def is_company(v: Column) -> Column:
    return detect.trim(v).rlike(r"(?i)\b(" + "|".join(V.COMPANY_SUFFIXES) + r")\.?\s*\z")


def is_location(v: Column) -> Column:
    return F.lower(detect.trim(v)).isin(*V.COUNTRIES, *V.STATES, *V.CITIES)


def is_name(v: Column) -> Column:
    t = detect.trim(v)
    odd = detect.looks_like_email(v) | detect.looks_like_phone(v) | detect.looks_like_date(v) | detect.looks_like_numeric(v)
    words = F.split(F.lower(t), r"(?U)\s+")
    return ~odd & F.length(t).between(2, 60) & t.rlike(r"^\p{L}[\p{L}'.-]*(?:\s+\p{L}[\p{L}'.-]*){0,3}\z") & ~F.arrays_overlap(words, F.array(*map(F.lit, V.NOT_NAMES)))


def is_status(v: Column) -> Column:
    return F.lower(detect.trim(v)).isin(*V.STATUS_WORDS)


CLASSIFIERS = {"email": detect.looks_like_email, "phone": detect.looks_like_phone, "date": detect.looks_like_date, "currency": is_currency, "company": is_company, "location": is_location, "name": is_name, "status": is_status}


def analyze_columns(fields: DataFrame, classifiers: dict | None = None) -> DataFrame:
    """Statistics of the normalized values of each column: cardinality, entropy, share of each shape.

    ``classifiers``, by default ``CLASSIFIERS``, are functions from a value's
    column to whether it has a shape; each gives a column ``<name>_ratio``.

    Values are counted first, so entropy and distinct counts come from one
    partial aggregate and no value list is ever collected.
    """
    classifiers = CLASSIFIERS if classifiers is None else classifiers
    some = F.col("value").isNotNull() & (F.col("value") != "")
    values = fields.groupBy(*COLUMN, F.col("normalized_value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("n_some", F.when(some, F.col("n")).otherwise(0))
    shapes = {k: F.coalesce(F.sum(F.when(f(F.col("value")), F.col("n_some"))), F.lit(0)) for k, f in classifiers.items()}
    out = values.groupBy(*COLUMN).agg(
        F.sum("n").cast("long").alias("total_count"),
        F.sum("n_some").cast("long").alias("non_empty_count"),
        F.count_if(some).alias("unique_count"),
        F.coalesce(F.sum(F.length("value") * F.col("n_some")), F.lit(0)).alias("_chars"),
        F.coalesce(F.sum(F.when(some, F.col("n_some") * F.log2("n_some"))), F.lit(0.0)).alias("_nlogn"),
        *(c.alias(f"_{k}") for k, c in shapes.items()),
    )
    n = F.col("non_empty_count")
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    entropy = F.when(F.col("unique_count") > 1, (F.log2(n) - F.col("_nlogn") / n) / F.log2("unique_count")).otherwise(0.0)
    uniqueness = share(F.col("unique_count"))
    few = (n >= 5) & (uniqueness <= 0.3) & (F.col("unique_count") <= 15)
    status = F.when(F.col("_status") > 0, share(F.col("_status"))).when(few, 0.3).otherwise(0.0) if "status" in classifiers else None
    return out.select(
        *COLUMN, "total_count", "non_empty_count", "unique_count", uniqueness.alias("uniqueness"),
        F.when(F.col("total_count") > 0, (F.col("total_count") - n) / F.col("total_count")).otherwise(0.0).alias("null_ratio"),
        share(F.col("_chars")).alias("average_length"), entropy.alias("entropy"),
        *((status if k == "status" else share(F.col(f"_{k}"))).alias(f"{k}_ratio") for k in classifiers),
    )


def classifier_evidence(fields: DataFrame, most: int = 3, classifiers: dict | None = None) -> DataFrame:
    """``upload_id, column_index, classifier, evidence``: the first different values, by row, that each classifier takes; at most ``most``."""
    values = fields.filter(F.col("normalized_value") != "").groupBy(*COLUMN, F.col("normalized_value").alias("value")).agg(F.min("row_number").alias("first_row"))
    kinds = F.filter(F.array(*(F.when(f(F.col("value")), F.lit(k)) for k, f in (CLASSIFIERS if classifiers is None else classifiers).items())), lambda k: k.isNotNull())
    found = values.select(*COLUMN, "value", "first_row", F.explode(kinds).alias("classifier"))
    rank = F.row_number().over(W.partitionBy(*COLUMN, "classifier").orderBy("first_row", "value"))
    first = found.withColumn("rank", rank).filter(F.col("rank") <= most)
    return first.groupBy(*COLUMN, "classifier").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("evidence"))


#: Kinds of values that normalization tells apart.
VALUE_KINDS = ("email", "phone", "date", "number", "boolean")


def dataset_context(fields: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: share of nulls, the most frequent kind of value (of equal ones the first seen), the first different values.

    One aggregate per different value comes first, so no step sees more of
    a column than its values.
    """
    value, kind = F.col("normalized_value"), F.col("details.kind")
    values = fields.groupBy(*COLUMN, "header", value.alias("value"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))
    of = lambda k: F.col("value").isNotNull() & (F.col("kind") == k)
    counted = [c for k in VALUE_KINDS for c in (F.sum(F.when(of(k), F.col("n"))).alias(f"_n_{k}"), F.min(F.when(of(k), F.col("first_row"))).alias(f"_f_{k}"))]
    totals = values.groupBy(*COLUMN, "header").agg(F.sum("n").alias("record_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("_nulls"), *counted)
    best = F.array_max(F.filter(F.array(*(F.struct(F.col(f"_n_{k}").alias("n"), (-F.col(f"_f_{k}")).alias("first"), F.lit(k).alias("kind")) for k in VALUE_KINDS)), lambda x: x["n"].isNotNull()))
    seen = values.filter("value is not null").groupBy(*COLUMN, "value").agg(F.min("first_row").alias("first_row"))
    rank = F.row_number().over(W.partitionBy(*COLUMN).orderBy("first_row", "value"))
    first = seen.withColumn("rank", rank).filter(F.col("rank") <= samples).groupBy(*COLUMN).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
    out = totals.join(first, COLUMN, "left")
    return out.select(*COLUMN, "header", "record_count", (F.col("_nulls") / F.col("record_count")).alias("null_ratio"), best["kind"].alias("type_hint"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def dataset_kind(headers: DataFrame) -> DataFrame:
    """The kind of each dataset by the words in its headers, with a confidence."""
    per = headers.groupBy("upload_id").agg(F.count(F.lit(1)).alias("_n"), *(F.max(F.col("normalized").contains(w)).cast("int").alias(f"_{k}_{i}") for k, words in V.DATASET_KINDS.items() for i, w in enumerate(words)))
    score = {k: F.least(F.lit(1.0), sum(F.col(f"_{k}_{i}") for i in range(len(words))) / 2) for k, words in V.DATASET_KINDS.items()}
    ranked = F.array_sort(F.array(*(F.struct((-s).alias("minus"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(score.items()))))
    top, second = -F.get(ranked, F.lit(0))["minus"], -F.get(ranked, F.lit(1))["minus"]
    few = F.col("_n") <= 3
    kind = F.when(top == 0, F.when(few, "manual_spreadsheet").otherwise("unknown")).when((second > 0) & (top - second < 0.15), "mixed").otherwise(F.get(ranked, F.lit(0))["kind"])
    confidence = F.when(top == 0, F.when(few, 0.4).otherwise(0.0)).when((second > 0) & (top - second < 0.15), top * 0.7).otherwise(top)
    return per.select("upload_id", kind.alias("detected_kind"), confidence.alias("confidence"))


#: How much a signal of each source counts, in order of the rules.
SOURCE_WEIGHTS = {"header": 0.85, "knowledge": 0.97, "regex": 1.0, "pattern": 0.6}


def signals(matches: DataFrame, columns: DataFrame, more: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """``upload_id, column_index, field_id, source, weight`` of all rules but the statistical one.

    ``more`` gives sources of the caller: for each, pairs of a field and the
    column of ``columns`` that holds its weight, such as a classifier's ratio.
    """
    key = [*COLUMN, "field_id"]
    header = matches.filter("match_type = 'fuzzy'").select(*key, F.lit("header").alias("source"), F.col("score").alias("weight"))
    known = matches.filter("match_type = 'exact_alias'").select(*key, F.lit("knowledge").alias("source"), F.lit(1.0).alias("weight"))
    shaped = lambda source, pairs: columns.select(*COLUMN, F.explode(F.array(*(F.struct(F.lit(f).alias("field_id"), F.col(c).alias("weight")) for f, c in pairs))).alias("_s")).select(*COLUMN, "_s.field_id", F.lit(source).alias("source"), "_s.weight").filter("weight > 0")
    regex = shaped("regex", [("email", "email_ratio"), ("phone", "phone_ratio"), ("created_at", "date_ratio")])
    pattern = shaped("pattern", [("name", "name_ratio"), ("company", "company_ratio"), ("crm_status", "status_ratio")])
    places = matches.filter(F.col("field_id").isin("city", "state", "country")).join(columns, COLUMN).filter("location_ratio > 0").select(*key, F.lit("pattern").alias("source"), F.col("location_ratio").alias("weight"))
    found = header.unionByName(known).unionByName(regex).unionByName(pattern).unionByName(places)
    for source, pairs in (more or {}).items():
        found = found.unionByName(shaped(source, pairs))
    return found


def confidences(matches: DataFrame, columns: DataFrame, most: int = 5, least: float = 0.05, weights: dict[str, float] | None = None, more: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Noisy-or of all signals of a column and field, moved by value statistics; the ``most`` best fields.

    ``weights``, by default ``SOURCE_WEIGHTS``, say how much each source
    counts, one that isn't there not at all; ``more`` as for ``signals``.
    """
    weights = SOURCE_WEIGHTS if weights is None else weights
    coefficient = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))))
    order = F.create_map(*(x for i, k in enumerate(weights) for x in (F.lit(k), F.lit(i))))
    rows = signals(matches, columns, more).filter(F.col("source").isin(*weights)).withColumn("_miss", 1 - text.clamp(F.col("weight") * F.element_at(coefficient, F.col("source"))))
    base = rows.groupBy(*COLUMN, "field_id").agg((1 - F.product("_miss")).alias("base"), F.min(F.element_at(order, F.col("source"))).alias("_rule"), F.array_sort(F.collect_set("source")).alias("evidence"))
    hinted = matches.select(*COLUMN, "field_id").distinct().withColumn("_hinted", F.lit(True))
    base = base.join(hinted, [*COLUMN, "field_id"], "left").join(columns.select(*COLUMN, "uniqueness", "non_empty_count"), COLUMN)
    move = F.when(~F.coalesce(F.col("_hinted"), F.lit(False)) | (F.col("non_empty_count") < 3), 0.0)
    move = move.when(F.col("field_id").isin(*V.VARIED), F.when(F.col("uniqueness") >= 0.6, 0.2).otherwise(-0.2)).when(F.col("field_id").isin(*V.REPEATED), F.when(F.col("uniqueness") <= 0.5, 0.2).otherwise(-0.2)).otherwise(0.0)
    place = F.array_position(F.array(*map(F.lit, V.ALIASES)), F.col("field_id"))
    out = base.withColumn("confidence", F.round(text.clamp(F.col("base") + move), 12)).filter(F.col("confidence") >= least)
    rank = F.row_number().over(W.partitionBy(*COLUMN).orderBy(F.col("confidence").desc(), "_rule", place))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most).select(*COLUMN, "field_id", "confidence", "rank", "evidence")


def tiers(columns: DataFrame, ranked: DataFrame) -> DataFrame:
    """For each column its best field and whether it may be mapped without, with, or only by a model."""
    top = ranked.filter("rank = 1").select(*COLUMN, "field_id", "confidence")
    c = F.col("confidence")
    tier = F.when(c.isNull(), "unknown").when(c >= 0.85, "deterministic").when(c >= 0.4, "ai_candidate").otherwise("ai_required")
    return columns.select(*COLUMN).join(top, COLUMN, "left").withColumn("tier", tier)


def semantic_context(mapped: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per column its tier, its best field and the others as ``alternates``, best first: what a model is told."""
    rest = ranked.filter("rank > 1").groupBy(*COLUMN).agg(F.array_sort(F.collect_list(F.struct("rank", "field_id", "confidence"))).alias("_rest"))
    alternates = F.coalesce(F.transform("_rest", lambda x: F.struct(x["field_id"].alias("field_id"), x["confidence"].alias("confidence"))), F.array().cast("array<struct<field_id:string,confidence:double>>"))
    return mapped.join(rest, COLUMN, "left").select(*COLUMN, "tier", F.col("field_id").alias("top_field"), F.coalesce("confidence", F.lit(0.0)).alias("top_confidence"), alternates.alias("alternates"))


def semantic_report(mapped: DataFrame) -> DataFrame:
    """Per dataset the columns of each tier and their number, coverage and the mean of the best confidences."""
    names = ("deterministic", "ai_candidate", "ai_required", "unknown")
    count = lambda t: F.count_if(F.col("tier") == t).alias(f"{t}_count")
    listed = lambda t: F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.col("column_index")))).alias(f"{t}_columns")
    covered = F.count_if(F.col("tier").isin("deterministic", "ai_candidate"))
    return mapped.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("columns_analyzed"), *map(count, names), *map(listed, names),
        (covered / F.count(F.lit(1))).alias("coverage"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("average_confidence"),
    )


def analyze_semantics(headers: DataFrame, fields: DataFrame, extra: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """All that is known of the columns' meaning, from ``headers`` (profiles) and normalized ``fields``.

    ``matches`` of headers with fields, ``columns`` with statistics,
    ``ranked`` fields of each column, its tier (``mapped``), the dataset's
    ``kind``, a ``report`` and the ``context`` for a model. The first three
    have some rows a column of the data and are used by all others, so they
    are cached; ``unpersist`` them when done.
    """
    matches, columns = match_headers(headers, extra=extra).cache(), analyze_columns(fields).cache()
    ranked = confidences(matches, columns).cache()
    mapped = tiers(columns, ranked)
    kind = dataset_kind(headers)
    return {"matches": matches, "columns": columns, "ranked": ranked, "mapped": mapped, "kind": kind, "report": semantic_report(mapped).join(kind, "upload_id", "left"), "context": semantic_context(mapped, ranked)}
