"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, m int, key string, fp string, target string"


def documents(spark: SparkSession, texts: list, ids: list | None = None, langs: list | None = None, sources: list | None = None) -> DataFrame:
    """Rows with extra columns whose names operators use inside."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = langs or [None] * n
    sources = sources or ["a"] * n
    rows = [(i, t, g, s, None if t is None else len(t), "x", 1, "k", "f", "t") for i, t, g, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


AWKWARD = [None, "", " \n\t ", "one", "two words", "a\x00b ́c  x", "same text again and again", "same text again and again", "x" * 5000, "ab " * 3000, "Ünï cødé 😀 " * 40, "1234 !!! ???", "<|endoftext|> a <|endoftext|>b", "  lead and trail  ", "line\n\nline\r\n\x1cend"]
