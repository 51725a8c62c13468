"""Delimited files of unknown encoding, delimiter and shape.

Files are read whole through ``binaryFile`` (their size is bounded by the
upload limit, tested before the content is read) and tokenized by a Python
table function, one call a file: records may span lines and the delimiter is
found from the content. Everything after it is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import detect
from ..operators.profile import disambiguate_headers

#: Fixed value: the largest file, in bytes.
MAX_BYTES = 25 * 1024 * 1024

#: Byte order marks and what they say.
MARKS = [(b"\xff\xfe", "utf-16-le", "UTF-16LE"), (b"\xfe\xff", "utf-16-be", "UTF-16BE"), (b"\xef\xbb\xbf", "utf-8", "UTF-8 (BOM)")]

#: Delimiters, the first of equally good ones wins.
DELIMITERS = [",", ";", "|", "\t"]


def decode(content: bytes) -> tuple[str, str]:
    """The text and the name of its encoding, by the byte order mark; bad bytes become U+FFFD."""
    for mark, codec, name in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(codec, errors="replace"), name
    return content.decode(errors="replace"), "UTF-8"


def delimiter_counts(line: str) -> list[int]:
    """How often each delimiter stands outside quotes in a line."""
    bare = re.sub(r'"[^"]*"', "", line)
    return [bare.count(d) for d in DELIMITERS]


def best_delimiter(counts: list[list[int]]) -> str:
    """The delimiter that stands most often in the poorest of some lines."""
    least = [min(c) for c in zip(*counts, strict=True)] or [0]
    return DELIMITERS[least.index(max(least))]


def find_delimiter(text: str) -> str:
    """The delimiter that stands, outside quotes, most often in the poorest of the first five lines."""
    return best_delimiter([delimiter_counts(x) for x in re.split(r"\r\n|\r|\n", text) if x.strip()][:5])


def closing(text: str, at: int) -> int:
    """The place of the quote that closes a cell whose content begins at ``at``, or -1; doubled quotes are content."""
    while True:
        at = text.find('"', at)
        if at < 0 or text[at + 1 : at + 2] != '"':
            return at
        at += 2


def tokenize(text: str, delimiter: str) -> Iterator[list[str]]:
    """Records of cells: a quote opens where its cell is blank so far, doubles itself, and may hold delimiters and line ends."""
    upto_quote = re.compile(rf'[^{re.escape(delimiter)}\r\n"]*')
    upto_end = re.compile(rf"[^{re.escape(delimiter)}\r\n]*")
    at, end = 0, len(text)
    record: list[str] = []
    cell = ""
    while at < end:
        blank = not cell.strip(" \t")
        got = (upto_quote if blank else upto_end).match(text, at)
        cell += got[0]
        at = got.end()
        if at >= end:
            break
        c = text[at]
        if c == '"':
            if cell.strip(" \t"):  # a quote inside a cell is part of it
                cell += c
                at += 1
                continue
            stop = closing(text, at + 1)
            cell = text[at + 1 : stop if stop >= 0 else end].replace('""', '"')
            at = stop + 1 if stop >= 0 else end  # never closed: the rest belongs to it
            continue
        record.append(cell)
        cell = ""
        if c == delimiter:
            at += 1
            continue
        at += 2 if text.startswith("\r\n", at) else 1
        yield record
        record = []
    if cell or record:
        yield [*record, cell]


@F.udtf(returnType="ordinal bigint, raw_cells array<string>, delimiter string, encoding string")
class TokenizeFile:
    """All records of a file, the header as number 0."""

    def eval(self, content: bytes):
        text, encoding = decode(bytes(content or b""))
        text = text.removeprefix("﻿")
        delimiter = find_delimiter(text)
        i = -1
        for i, record in enumerate(tokenize(text, delimiter)):
            yield i, record, delimiter, encoding
        if i < 0:
            yield -1, None, delimiter, encoding


@F.udtf(returnType="n_chars bigint, n_bytes bigint, is_blank boolean")
class MeasureFile:
    """Length of the decoded text, in characters and UTF-8 bytes, and whether it is blank."""

    def eval(self, content: bytes):
        text, _ = decode(bytes(content or b""))
        yield len(text), len(text.encode(errors="replace")), not text.strip().strip("\ufeff")


def verify_uploads(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """``upload_id, code, severity`` of what is wrong with each of ``files``.

    ``files`` are ``binaryFile`` rows; ``file_name, mime_type, declared_bytes``
    are checked where they are columns. Sizes are those of the decoded text
    as UTF-8, so a mark or UTF-16 makes the declared size differ, which is a
    warning. All other codes are errors: such a file isn't parsed. A file
    whose raw size is over four times the limit can't decode to less and is
    not read.
    """
    has = set(files.columns)
    col = lambda c: F.col(c) if c in has else F.lit("-")
    blank = lambda c: F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) == ""
    read = F.when(F.col("length") <= 4 * most, F.col("content"))
    kept = [F.col(c) for c in ("file_name", "mime_type", "declared_bytes") if c in has]
    rows = files.select(F.col("path").alias("upload_id"), "length", read.alias("content"), *kept)
    rows = rows.lateralJoin(MeasureFile(F.col("content").outer()))
    size = F.when(F.col("content").isNull() & (F.col("length") > 4 * most), F.col("length")).otherwise(F.col("n_bytes"))
    problem = lambda holds, code, severity="error": F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    errors = [
        problem(blank("file_name"), "MISSING_FILE_NAME"),
        problem(blank("mime_type"), "MISSING_MIME_TYPE"),
        problem(F.col("is_blank") & (F.col("length") <= 4 * most), "EMPTY_FILE"),
        problem(size > most, "FILE_TOO_LARGE"),
    ]
    found = F.filter(F.array(*errors), lambda x: x.isNotNull())
    if "declared_bytes" in has:
        differs = problem(F.col("declared_bytes") != size, "DECLARED_SIZE_MISMATCH", "warning")
        found = F.when((F.size(found) == 0) & (F.col("declared_bytes") != size), F.array(differs)).otherwise(found)
    return rows.select("upload_id", F.explode(found).alias("_p")).select("upload_id", "_p.code", "_p.severity")


def read_records(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """``upload_id, ordinal, raw_cells, delimiter, encoding`` of ``binaryFile`` rows no larger than ``most``.

    Larger ones give one row without cells, so that ``parse`` can say so; of
    a file without records there is one, too.
    """
    rows = files.select(F.col("path").alias("upload_id"), F.when(F.col("length") <= most, F.col("content")).alias("content"), (F.col("length") > most).alias("_large"))
    return rows.lateralJoin(TokenizeFile(F.col("content").outer())).select("upload_id", F.when(~F.col("_large"), F.col("ordinal")).alias("ordinal"), "raw_cells", "delimiter", "encoding")


def parse(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``datasets`` and ``rows`` of tokenized files.

    Blank records go, row numbers count the others; short rows are padded,
    long ones cut, and marked ``recovered``; blank headers are numbered,
    repeated ones get a suffix. ``error`` of a dataset is null or one of
    ``FILE_TOO_LARGE``, ``EMPTY_DATASET``, ``HEADERLESS_FILE``; such a file
    has a dataset and no rows. Records with a ``block`` column, their range
    of the file, are numbered range by range, with running totals of what
    lies before, so that a large file is no single task.
    """
    if "block" not in records.columns:
        records = records.withColumn("block", F.lit(0).cast("long"))
    head = records.filter("ordinal = 0")
    names = head.select("upload_id", F.posexplode("raw_cells").alias("column_index", "raw_header"))
    named = disambiguate_headers(names).withColumn("blank", detect.trim(F.col("raw_header")) == "")
    heads = named.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("column_index", "header", "raw_duplicate", "blank"))).alias("h"))
    body = records.filter("ordinal > 0").withColumn("is_blank", F.forall("raw_cells", lambda c: detect.trim(c) == ""))
    counts = body.groupBy("upload_id").agg(F.count_if(F.col("is_blank")).alias("blank_rows"), F.count_if(~F.col("is_blank")).alias("row_count"))
    first = records.filter("ordinal is null or ordinal <= 0").select("upload_id", "ordinal", "delimiter", "encoding")
    none = F.array().cast("array<string>")
    datasets = (
        first.join(heads, "upload_id", "left").join(counts, "upload_id", "left")
        .select(
            "upload_id", F.coalesce(F.transform("h", lambda x: x["header"]), none).alias("headers"), F.coalesce(F.transform("h", lambda x: x["raw_duplicate"]), F.array().cast("array<boolean>")).alias("dup_flags"), "delimiter", "encoding",
            F.coalesce("row_count", F.lit(0)).alias("row_count"), F.when(F.col("h").isNull(), 0).otherwise(F.size("h")).alias("column_count"), F.coalesce("blank_rows", F.lit(0)).alias("blank_rows"),
            F.when(F.col("ordinal").isNull(), "FILE_TOO_LARGE").when(F.col("ordinal") < 0, "EMPTY_DATASET").when(F.forall("h", lambda x: x["blank"]), "HEADERLESS_FILE").alias("error"),
        )
    )
    width = F.col("column_count")
    have = F.size("raw_cells")
    full = body.filter("not is_blank")
    earlier = W.partitionBy("upload_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = full.groupBy("upload_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    known = before.join(datasets.filter("error is null").select("upload_id", "column_count"), "upload_id")
    rows = full.withColumn("place", F.row_number().over(W.partitionBy("upload_id", "block").orderBy("ordinal"))).join(known, ["upload_id", "block"])
    rows = rows.select(
        "upload_id", (F.col("before") + F.col("place")).cast("long").alias("row_number"), "raw_cells",
        F.slice(F.concat("raw_cells", F.array_repeat(F.lit(""), width)), F.lit(1), width).alias("cells"),
        F.when(have == width, "ok").otherwise("recovered").alias("status"),
        F.when(have < width, "ROW_PADDED").when(have > width, "ROW_TRUNCATED").alias("warning"),
    )
    return datasets, rows


def parse_warnings(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """``upload_id, code, count`` of what was adjusted in each file."""
    ragged = rows.groupBy("upload_id").agg(F.count_if(F.col("status") == "recovered").alias("ragged"))
    d = datasets.join(ragged, "upload_id", "left")
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    items = F.array(
        F.struct(F.lit("BLANK_ROWS_SKIPPED").alias("code"), F.col("blank_rows").cast("long").alias("count")),
        F.struct(F.lit("DUPLICATE_HEADERS_RENAMED").alias("code"), count("dup_flags", lambda x: x).alias("count")),
        F.struct(F.lit("EMPTY_HEADER_NAMES").alias("code"), count("headers", lambda x: x.rlike(r"^Column \d+\z")).alias("count")),
        F.struct(F.lit("RAGGED_ROWS_ADJUSTED").alias("code"), F.coalesce("ragged", F.lit(0)).cast("long").alias("count")),
    )
    return d.select("upload_id", F.explode(items).alias("w")).select("upload_id", "w.*").filter("count > 0")


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of all files at ``path``, empty ones too, which Spark lists but doesn't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    listed = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return files.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``datasets`` and ``rows`` of all files at ``path``; a file that can't be taken is a dataset with an ``error``."""
    return parse(read_records(files_at(spark, path)))
