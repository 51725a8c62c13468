"""A first look at parsed files: profiles, quality, what normalization did and what columns mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, profile, semantic


def preview(datasets: DataFrame, rows: DataFrame, compose: bool = True, limit: int = 50) -> dict[str, DataFrame]:
    """Tables of ``datasets`` and ``rows`` as ``sources.delimited.parse`` gives them.

    ``headers``, ``profiles`` of columns, ``types`` (columns by guessed type),
    ``metadata``, the first ``rows``, ``normalization`` (counts and health),
    ``issues``, and the tables of ``semantic.analyze_semantics``. Nothing runs
    before a table is used; ``rows`` should be stored if several are.
    """
    heads = datasets.select("upload_id", F.posexplode(F.arrays_zip("headers", "dup_flags")).alias("column_index", "_h")).select("upload_id", "column_index", F.col("_h.headers").alias("header"), F.col("_h.dup_flags").alias("raw_duplicate"))
    headers = profile.header_profiles(heads)
    long = cells.parsed_to_cells(rows, datasets)
    fields = cells.normalize_cells(long, compose)
    columns = profile.column_profiles(long)
    recovered = rows.groupBy("upload_id").agg(F.count_if(F.col("status") == "recovered").alias("malformed_rows"))
    repeated = headers.groupBy("upload_id").agg(F.count_if("is_duplicate").alias("duplicate_headers"))
    parsed = datasets.select("upload_id", "blank_rows").join(recovered, "upload_id", "left").join(repeated, "upload_id", "left").withColumn("n_bytes", F.lit(0))
    return {
        "headers": headers,
        "profiles": columns,
        "types": profile.dataset_intelligence(columns),
        "metadata": profile.dataset_metadata(long, parsed),
        "rows": profile.preview(rows, limit),
        "normalization": profile.normalization_report(fields),
        "issues": profile.field_issues(fields),
        **semantic.analyze_semantics(headers, fields),
    }
