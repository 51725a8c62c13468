"""Tables as cells: one row per value, keyed by dataset, row and column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def to_cells(df: DataFrame, row_id: str, columns: list[str] | None = None, upload_id: Column | None = None) -> DataFrame:
    """``upload_id, row_number, column_index, header, raw_value``: all columns but ``row_id``, as text.

    A generator over each row; nothing is shuffled.
    """
    names = [c for c in df.columns if c != row_id] if columns is None else columns
    cells = F.array(*(F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("header"), F.col(c).cast("string").alias("raw_value")) for i, c in enumerate(names)))
    return df.select((F.lit("") if upload_id is None else upload_id).alias("upload_id"), F.col(row_id).cast("long").alias("row_number"), F.explode(cells).alias("_cell")).select("upload_id", "row_number", "_cell.*")


def parsed_to_cells(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """The cells of parsed files: ``rows`` joined with the headers of their ``datasets``."""
    heads = datasets.select("upload_id", "headers")
    at = rows.select("upload_id", "row_number", F.posexplode("cells").alias("column_index", "raw_value"))
    return at.join(heads, "upload_id").select("upload_id", "row_number", "column_index", F.get("headers", F.col("column_index")).alias("header"), "raw_value")


def normalize_cells(cells: DataFrame, compose: bool = True, **options) -> DataFrame:
    """``cells`` with the outcome of all normalization rules; a projection."""
    return rules.normalize(cells, "raw_value", compose, **options)
