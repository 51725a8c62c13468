"""From cells to records of the lead schema, without a model or from a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..functions import vocabulary as V
from .trust import ENUMS, FIELDS, value_of


def guess_field(header: Column, value: Column) -> Column:
    """The field a value goes to: by its shape, else by the first matching header pattern."""
    out = F.when(detect.looks_like_email(value), "email").when(detect.looks_like_date(value), "created_at").when(detect.looks_like_phone(value), "mobile_without_country_code")
    for pattern, field in V.HEADER_HINTS:
        out = out.when(header.rlike(f"(?i){pattern}"), field)
    return out


def extract(fields: DataFrame) -> DataFrame:
    """One record per row: all schema fields, each the first column (by index) that maps to it.

    ``fields`` are normalized cells. Per row and field one value survives a
    partial aggregate, then a row's few fields meet in one array.
    """
    value = F.col("normalized_value")
    target = guess_field(F.col("header"), value)
    key = ["upload_id", "row_number"]
    # headers that are integers come first, in order of their value
    order = F.when(F.col("header").rlike(r"^(0|[1-9]\d{0,8})\z"), F.struct(F.lit(0).alias("k"), F.col("header").try_cast("long").alias("n"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("column_index").cast("long").alias("n")))
    filled = value.isNotNull() & (detect.trim(value) != "")
    # a projection of its own: each cell's field is found once, not once for each field
    found = fields.select(*key, F.when(filled, target).alias("_target"), F.struct(order.alias("o"), value.alias("value"), F.col("header").alias("header")).alias("_cell"))
    firsts = [F.min(F.when(F.col("_target") == f, F.col("_cell"))).alias(f"_{f}") for f in FIELDS]
    rows = found.groupBy(*key).agg(*firsts)
    made = F.array(*(F.struct(F.lit(f).alias("target_field"), F.col(f"_{f}.value").alias("value"), F.when(F.col(f"_{f}").isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.col(f"_{f}.header").alias("source_header")) for f in FIELDS))
    return check_enums(rows.select(*key, made.alias("fields")))


def check_enums(records: DataFrame) -> DataFrame:
    """Values outside an enumeration become null, with a warning in ``extraction_warnings``."""
    bad = lambda f: F.coalesce(*(F.when((f["target_field"] == name) & f["value"].isNotNull(), ~f["value"].isin(*allowed)) for name, allowed in ENUMS.items()), F.lit(False))
    warned = F.transform(F.filter("fields", bad), lambda f: F.struct(F.concat(F.lit("INVALID_"), F.upper(f["target_field"])).alias("code"), f["value"].alias("value")))
    cleared = F.transform("fields", lambda f: F.struct(f["target_field"].alias("target_field"), F.when(~bad(f), f["value"]).alias("value"), F.when(bad(f), 0.0).otherwise(f["confidence"]).alias("confidence"), f["source_header"].alias("source_header")))
    return records.withColumn("extraction_warnings", warned).withColumn("fields", cleared)


def records_from_json(answers: DataFrame, column: str = "text") -> DataFrame:
    """Records of answers ``{"records": [{"row": n, "fields": {field: value or {"value", "sourceHeader"}}}]}``.

    Items without a numeric row are skipped; a field may be a bare string,
    number or truth value; what can't be parsed gives no records.
    """
    parsed = F.try_parse_json(F.col(column))
    items = answers.withColumn("_json", parsed).withColumn("_item", F.explode(F.try_variant_get("_json", "$.records", "array<variant>")))
    items = items.withColumn("row_number", F.try_variant_get("_item", "$.row", "long")).filter("row_number is not null")

    def field(f: str) -> Column:
        raw = F.try_variant_get("_item", f"$.fields.{f}", "variant")
        kind = F.schema_of_variant(raw)
        nested = kind.startswith("OBJECT")
        inner = lambda k: F.when(F.schema_of_variant(F.try_variant_get(raw, f"$.{k}", "variant")) == "STRING", F.try_variant_get(raw, f"$.{k}", "string"))
        value = F.when(nested, inner("value")).when(~kind.startswith("ARRAY") & (kind != "VOID"), F.try_variant_get(raw, "$", "string"))
        return F.struct(F.lit(f).alias("target_field"), value.alias("value"), F.when(value.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.when(nested, inner("sourceHeader")).alias("source_header"))

    keys = [c for c in answers.columns if c != column]
    return check_enums(items.select(*keys, "row_number", F.array(*map(field, FIELDS)).alias("fields")))


def wide(records: DataFrame) -> DataFrame:
    """A column for every field of the schema."""
    keys = [c for c in records.columns if c in ("upload_id", "row_number")]
    return records.select(*keys, *(value_of(F.col("fields"), n).alias(n) for n in FIELDS))
