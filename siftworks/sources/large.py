"""Delimited files of any size, read by many tasks.

Spark's text source cuts a file into ranges that begin at a line feed. Whether
a range begins inside a quoted cell depends on all that lies before it, so a
first pass says for each range what it makes of either beginning: the state
at its end and the number of records that end in it. These transitions are
composed from range to range, a scan over one row a range, which also gives
the number of records before each. The second pass then tokenizes every range
in its known state. A record that goes over the end of a range leaves pieces,
one a range, that are joined and tokenized by themselves.

At a line feed there are no more than two states: outside quotes a record has
just ended; inside, the cell's content holds a line feed and isn't blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import DELIMITERS, best_delimiter, closing, delimiter_counts, files_at, read_records, tokenize
from .storage import stored

LINE_END = re.compile(r"\r\n|\r|\n")
#: Rows of the table of ranges up to which it is broadcast; beyond, the lines are numbered and sorted into their ranges.
MOST_RANGES = 100_000
#: Bytes of small ranges that one task may take, once there are more ranges than twice the cores.
TASK_BYTES = 128 << 20


def record_ends(line: str, inside: bool, delimiter: str) -> tuple[list[int], bool]:
    """Where records end in a ``line`` that begins outside or inside quotes, and the state after it."""
    at, ends, blank = 0, [], True
    if inside:
        at = closing(line, 0) + 1
        if not at:
            return ends, True
        blank = False
    while True:
        quote = line.find('"', at)
        stop = len(line) if quote < 0 else quote
        ends += [m.end() for m in LINE_END.finditer(line, at, stop)]
        if quote < 0:
            return ends, False
        cut = max(line.rfind(c, at, stop) for c in (delimiter, "\n", "\r"))
        blank = not line[max(at, cut + 1) : stop].strip(" \t") and (blank or cut >= 0)
        at = quote + 1
        if blank:
            stop = closing(line, at)
            if stop < 0:
                return ends, True
            blank, at = not line[at:stop].strip(" \t"), stop + 1


class Transition:
    """What a range makes of each delimiter and beginning: the state after it and the number of records that end in it."""

    def __init__(self) -> None:
        self.state = {(d, s): s for d in DELIMITERS for s in (False, True)}
        self.ends = dict.fromkeys(self.state, 0)

    def add(self, lines: list[str]) -> None:
        quiet = 0  # records that end in the lines since the last one with a quote
        for line in lines:
            if '"' not in line:
                quiet += 1 + line.count("\r") - line.endswith("\r")
                continue
            self._pass(quiet)
            quiet, known = 0, {}
            for key, inside in self.state.items():
                own = (key[0] if key[0] in line else "", inside)  # delimiters that aren't there all do the same
                if own not in known:
                    ends, after = record_ends(line + "\n", inside, key[0])
                    known[own] = len(ends), after
                n, self.state[key] = known[own]
                self.ends[key] += n
        self._pass(quiet)

    def _pass(self, quiet: int) -> None:
        for key, inside in self.state.items():
            if not inside:
                self.ends[key] += quiet


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame, bool]]:
    """The rows of a task by range, in order: key, rows, and whether they are the range's first."""
    at = None
    for pdf in batches:
        for key, part in pdf.groupby(["upload_id", "block"], sort=False):
            yield key, part, key != at
            at = key


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a range: its transition, its bytes, and what its first lines say of the delimiter."""
    at = made = None
    size, whole, head, mark = 0, 0, [], ""

    def row() -> pd.DataFrame:
        keys = [(d, s) for d in DELIMITERS for s in (False, True)]
        return pd.DataFrame({"upload_id": [at[0]], "block": [at[1]], "states": [[made.state[k] for k in keys]], "ends": [[made.ends[k] for k in keys]], "n_bytes": [size], "file_bytes": [whole], "head": [head], "mark": [mark]})

    for key, part, new in _ranges(batches):
        if new:
            if at is not None:
                yield row()
            at, made, size, head = key, Transition(), 0, []
            whole, mark = int(part["file_bytes"].iloc[0]), part["mark"].iloc[0] if key[1] == 0 else ""
        lines = part["line"].tolist()
        made.add(lines)
        size += int(part["n_bytes"].sum())
        if len(head) < 5:
            head += [delimiter_counts(y) for x in lines for y in LINE_END.split(x) if y.strip()][: 5 - len(head)]
    if at is not None:
        yield row()


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The scan over the ranges of one file: the state and the number of records at the beginning of each."""
    pdf = pdf.sort_values("block")
    delimiter = best_delimiter([list(x) for head in pdf["head"] for x in head][:5])
    first = 2 * DELIMITERS.index(delimiter)
    over = int(pdf["n_bytes"].sum()) - int(pdf["file_bytes"].iloc[0])  # the source leaves out a byte order mark, and adds a line feed that isn't there
    inside, before, rows = False, 0, []
    for block, states, ends in zip(pdf["block"], pdf["states"], pdf["ends"], strict=True):
        rows.append((block, inside, before))
        before += int(ends[first + inside])
        inside = bool(states[first + inside])
    out = pd.DataFrame(rows, columns=["block", "inside", "before"])
    out["upload_id"], out["delimiter"], out["mark"] = pdf["upload_id"].iloc[0], delimiter, pdf["mark"].iloc[0]
    out["encoding"] = "UTF-8 (BOM)" if over < 0 or pdf["mark"].iloc[0] == "EFBBBF" else "UTF-8"
    out["open_end"] = (out["block"] == out["block"].max()) & (over in (1, -2))
    return out[["upload_id", "block", "inside", "before", "delimiter", "encoding", "mark", "open_end"]]


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of ranges whose beginning is known, and pieces of those that go over an end."""
    rows: list[tuple] = []
    first = None
    inside, joined, number, open_, held = False, False, 0, [], None

    def take(line: str) -> None:
        nonlocal inside, joined, number, open_
        d = first.delimiter
        if not open_ and not inside and '"' not in line and line.count("\r") == line.endswith("\r\n"):
            if line.endswith("\n"):
                rows.append((first.upload_id, first.block, number, line[: -2 if line.endswith("\r\n") else -1].split(d), None, d))
                number += 1
            else:
                open_ = [line]
            return
        ends, inside = record_ends(line, inside, d)
        at = 0
        for end in ends:
            text = "".join([*open_, line[at:end]])
            rows.append((first.upload_id, first.block, number, *((None, text) if joined else (next(tokenize(text, d)), None)), d))
            number, joined, open_, at = number + 1, False, [], end
        if at < len(line):
            open_.append(line[at:])

    def close() -> None:
        if held is not None:
            take(held if first.open_end else held + "\n")
        if open_:
            rows.append((first.upload_id, first.block, number, None, "".join(open_), first.delimiter))

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["upload_id", "block", "ordinal", "raw_cells", "piece", "delimiter"])
        rows.clear()
        return out

    for _, part, new in _ranges(batches):
        if new:
            if first is not None:
                close()
            first = next(part.itertuples(index=False))
            inside, joined, number, open_, held = bool(first.inside), bool(first.inside), int(first.before), [], None
        for line in part["line"]:
            if held is not None:
                take(held + "\n")
            held = line  # the file's last line may have no line feed
        if rows:
            yield frame()
    if first is not None:
        close()
        yield frame()


@F.udtf(returnType="raw_cells array<string>")
class TokenizeRecord:
    """The record that a text holds, if it holds any."""

    def eval(self, text: str, delimiter: str):
        for cells in tokenize(text, delimiter):
            yield (cells,)


@contextmanager
def _splits(spark: SparkSession, size: int):
    """Both passes must cut files alike: by size alone, whatever the number of cores."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _grouped(lines: DataFrame, range_bytes: int) -> DataFrame:
    """``lines`` with many small ranges a task: each stays whole and in order, none costs a task's start."""
    spark = lines.sparkSession
    ranges = lines.rdd.getNumPartitions()
    return lines.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-ranges * range_bytes // TASK_BYTES), 1))


def read_large(spark: SparkSession, path: str, range_bytes: int = 128 << 20, most_ranges: int = MOST_RANGES) -> DataFrame:
    """``upload_id, ordinal, raw_cells, delimiter, encoding, block`` of all files at ``path``, for ``parse``; of no limited size.

    The rows are those of ``read_records``, stored in the shared folder.
    Files are cut into ranges of about ``range_bytes``, of which a task takes
    one or, where they are many and small, several; they end at line feeds, so a file whose lines end in carriage returns alone is one range.
    Only the pieces of a record that goes over ranges meet in one task. Files
    in UTF-16 are read whole. A table of more than ``most_ranges`` ranges is
    not broadcast but joined to the lines by range.
    """
    with _splits(spark, range_bytes):
        raw = F.col("value").cast("binary")
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^file:/+", "file:/").alias("upload_id"), F.col("_metadata.file_block_start").alias("block"),
            F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", "").alias("line"), (F.octet_length("value") + 1).cast("long").alias("n_bytes"), F.col("_metadata.file_size").alias("file_bytes"),
            F.when(F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF"), F.hex(F.substring(raw, 1, 2))).when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", "EFBBBF").otherwise("").alias("mark"),
        )
        lines = _grouped(lines, range_bytes)
        made = lines.mapInPandas(_summaries, "upload_id string, block long, states array<boolean>, ends array<long>, n_bytes long, file_bytes long, head array<array<int>>, mark string")
        known = made.groupBy("upload_id").applyInPandas(_composed, "upload_id string, block long, inside boolean, before long, delimiter string, encoding string, mark string, open_end boolean")
        known = stored(known, "large-ranges")
        wide = known.filter("mark in ('FFFE', 'FEFF')").select("upload_id").distinct()
        plan = known.filter("mark not in ('FFFE', 'FEFF')").drop("mark", "encoding")
        numbered = lines.select("upload_id", "block", "line")
        if known.count() <= most_ranges:
            work = numbered.join(F.broadcast(plan), ["upload_id", "block"])  # keeps the order of lines in a task
        else:
            numbered = numbered.withColumn("line_number", F.monotonically_increasing_id())
            work = stored(numbered, "large-lines").join(plan, ["upload_id", "block"])
            work = work.repartition("upload_id", "block").sortWithinPartitions("upload_id", "block", "line_number").drop("line_number")
        found = work.mapInPandas(_records, "upload_id string, block long, ordinal long, raw_cells array<string>, piece string, delimiter string")
        found = stored(found, "large-records")
    names = ["upload_id", "ordinal", "raw_cells", "delimiter", "block"]
    pieces = found.filter("piece is not null").groupBy("upload_id", "ordinal", "delimiter").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("ps"))  # of one record
    pieces = pieces.select("upload_id", "ordinal", "delimiter", F.col("ps")[0]["block"].alias("block"), F.array_join("ps.piece", "").alias("text"))
    joined = pieces.lateralJoin(TokenizeRecord(F.col("text").outer(), F.col("delimiter").outer())).select(*names)
    records = found.filter("piece is null").select(*names).unionByName(joined)
    records = records.join(known.filter("block = 0").select("upload_id", "encoding"), "upload_id")
    files = files_at(spark, path)
    whole = read_records(files.join(F.broadcast(wide), F.col("path") == F.col("upload_id"), "left_semi") if wide.count() <= most_ranges else files.join(wide, F.col("path") == F.col("upload_id"), "left_semi"), 1 << 62)
    records = stored(records.unionByName(whole.withColumn("block", F.lit(0).cast("long"))), "large-all")
    none = files.select(F.col("path").alias("upload_id")).join(records.select("upload_id").distinct(), "upload_id", "left_anti")
    none = none.select("upload_id", F.lit(-1).cast("long").alias("ordinal"), F.lit(None).cast("array<string>").alias("raw_cells"), F.lit(",").alias("delimiter"), F.lit("UTF-8").alias("encoding"), F.lit(0).cast("long").alias("block"))
    return records.unionByName(none)
