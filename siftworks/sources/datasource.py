"""Delimited files as a data source of Spark: ``spark.read.format("siftworks_files")``, batch and stream.

Options: ``path`` (also ``load(path)``), ``delimiter`` and ``encoding`` where
they are known, ``multiline`` (true: a quoted cell may hold line ends, and a
file is read whole, up to ``max_bytes``; false: a quote ends with its line,
and a file of any size is cut into ranges), ``range_bytes``. Columns are those
of ``read_records`` and ``block``, the range's beginning; a schema given with
``.schema(...)`` may name fewer, the others aren't built. Ordinals grow within
a file; they count records of a file read whole, and are byte offsets of one
read in ranges, so no range waits for another. ``parse`` takes either.

Filters of equality on ``upload_id`` leave out files when they are planned;
``register`` turns on the session's setting for that.

A stream keeps in the folder ``log`` which files each batch takes, written
before the batch begins: it takes every file once, whatever its time or name,
and after a stop a batch takes the same files again. Files must appear whole.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .delimited import MARKS, MAX_BYTES, find_delimiter, tokenize
from .large import LINE_END, record_ends

SCHEMA = "upload_id string, ordinal long, raw_cells array<string>, delimiter string, encoding string, block long"
NAME = "siftworks_files"


def _opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what stands before paths in ids."""
    local = re.sub("^file:/+", "/", uri)
    if "://" not in local:
        return fs.LocalFileSystem(), local, "file:"
    system, inner = fs.FileSystem.from_uri(uri)
    return system, inner, uri[: len(uri) - len(inner)] if uri.endswith(inner) else ""


def _listed(uri: str) -> list[tuple[str, int]]:
    """Paths and sizes of all files at a path, without those whose name, or a folder's, begins with ``_`` or ``.``."""
    system, inner, _ = _opened(uri)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.is_file:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = re.compile(r"(^|/)[_.]")
    return sorted((x.path, x.size) for x in found if x.is_file and not hidden.search(x.path[len(inner.rstrip("/")) :]))


@dataclass
class Ranges(InputPartition):
    """What one task reads: ``path, start, end, size`` of each range."""

    ranges: list[tuple[str, int, int, int]]


class _Files:
    """Planning and reading, the same for batches and streams."""

    def __init__(self, schema, options) -> None:
        self.schema = schema
        self.uri = options.get("path")
        if not self.uri:
            raise ValueError("a path is needed")
        self.delimiter, self.encoding = options.get("delimiter"), options.get("encoding")
        self.multiline = options.get("multiline", "true").lower() == "true"
        self.most = int(options.get("max_bytes", MAX_BYTES))
        self.size = int(options.get("range_bytes", 64 << 20))
        if self.size < 1 or len(self.delimiter or ",") != 1:
            raise ValueError("range_bytes must be positive, a delimiter one character")

    def planned(self, files: list[tuple[str, int]]) -> list[Ranges]:
        """Large files cut, small ones together, about ``range_bytes`` a task."""
        tasks: list[Ranges] = []
        room = 0
        for path, size in files:
            step = max(size, 1) if self.multiline else self.size
            for start in range(0, max(size, 1), step):
                end = min(start + step, size)
                if end - start > room or not tasks:
                    tasks.append(Ranges([]))
                    room = self.size
                tasks[-1].ranges.append((path, start, end, size))
                room -= end - start
        return tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _, prefix = _opened(self.uri)
        arrow = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        held = 0
        for path, start, end, size in partition.ranges:
            with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
                for ordinal, cells, delimiter, encoding in self._records(f, start, end, size):
                    rows.append((prefix + path, ordinal, cells, delimiter, encoding, start))
                    held += sum(map(len, cells or ())) + 64
                    if held > 4 << 20:
                        yield self._batch(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, arrow)

    @staticmethod
    def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        wanted = [(names.index(x.name), x.type) for x in arrow]
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in wanted], schema=arrow)

    def _records(self, f: io.BufferedReader, start: int, end: int, size: int) -> Iterator[tuple]:
        mark = f.read(3)
        skip, codec, name = next(((len(m), c, n) for m, c, n in MARKS if mark.startswith(m)), (0, "utf-8", "UTF-8"))
        if self.encoding:
            codec, name = self.encoding, self.encoding
        wide = re.match("utf.?(16|32)", codec, re.I) is not None
        if self.multiline and size > self.most:
            yield None, None, self.delimiter or ",", name
            return
        if self.multiline or wide:
            if start:
                return  # the first range reads it all
            f.seek(skip)
            text = f.read().decode(codec, errors="replace").removeprefix("﻿")
            delimiter = self.delimiter or find_delimiter(text)
            n = -1
            if self.multiline:
                for n, cells in enumerate(tokenize(text, delimiter)):
                    yield n, cells, delimiter, name
            else:
                raw = text.encode("utf-8", errors="replace")
                for n, cells in _lines(io.BytesIO(raw), 0, len(raw), "utf-8", delimiter):
                    yield n, cells, delimiter, name
        else:
            delimiter = self.delimiter or _head_delimiter(f, skip, codec)
            n = -1
            for n, cells in _lines(f, max(start, skip), end, codec, delimiter, skip):
                yield n, cells, delimiter, name
            if start or n >= 0:
                return
            n = next((n for n, _ in _lines(f, skip, skip + 1, codec, delimiter, skip)), -1)  # the first line may be another range's
        if n < 0:
            yield -1, None, delimiter, name


def _head_delimiter(f: io.BufferedReader, skip: int, codec: str) -> str:
    """The delimiter that the first five lines that aren't blank show."""
    f.seek(skip)
    seen: list[str] = []
    while len(seen) < 5 and (raw := f.readline()):
        seen += [x for x in LINE_END.split(raw.decode(codec, errors="replace")) if x.strip()]
    return find_delimiter("\n".join(seen[:5]))


def _lines(f, start: int, end: int, codec: str, delimiter: str, skip: int = 0) -> Iterator[tuple[int, list[str]]]:
    """Records of the lines that begin in a range, each with its place in the file; the first line's place is 0."""
    f.seek(start)
    if start > skip:
        f.seek(start - 1)
        f.readline()
    at = f.tell()
    while at < end and (raw := f.readline()):
        text = raw.decode(codec, errors="replace")
        if text.endswith("\n"):
            text = text[: -2 if text.endswith("\r\n") else -1]
            text += '"\n' if '"' in text and record_ends(text + "\n", False, delimiter)[1] else "\n"
        if at == skip:
            text = text.removeprefix("﻿")
        for i, cells in enumerate(tokenize(text, delimiter)):
            yield at - skip + i, cells
        at += len(raw)


class _BatchReader(_Files, DataSourceReader):
    def __init__(self, schema, options) -> None:
        super().__init__(schema, options)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802
        for x in filters:
            if isinstance(x, (EqualTo, In)) and x.attribute == ("upload_id",):
                values = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield x

    def partitions(self):
        prefix = _opened(self.uri)[2]
        return self.planned([x for x in _listed(self.uri) if self.wanted is None or prefix + x[0] in self.wanted]) or [Ranges([])]


class _StreamReader(_Files, DataSourceStreamReader):
    """Offsets number the batches; ``log`` says which files each takes."""

    def __init__(self, schema, options) -> None:
        super().__init__(schema, options)
        self.log = options.get("log")
        if not self.log:
            raise ValueError("a stream needs a folder for its log")

    def _entries(self) -> list[str]:
        system, inner, _ = _opened(self.log)
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return sorted(x.path for x in found if re.search(r"/\d{12}\.json$", x.path))

    def _files(self, entries: list[str]) -> list[tuple[str, int]]:
        system = _opened(self.log)[0]
        out: list[tuple[str, int]] = []
        for path in entries:
            with system.open_input_stream(path) as f:
                out += [tuple(x) for x in json.loads(f.read())]
        return out

    def initialOffset(self):  # noqa: N802
        return {"batch": 0}

    def latestOffset(self):  # noqa: N802
        entries = self._entries()
        taken = {p for p, _ in self._files(entries)}
        new = [x for x in _listed(self.uri) if x[0] not in taken]
        if new:
            system, inner, _ = _opened(self.log)
            system.create_dir(inner, recursive=True)
            path = f"{inner.rstrip('/')}/{len(entries) + 1:012d}.json"
            with system.open_output_stream(path + ".tmp") as f:
                f.write(json.dumps(new).encode())
            system.move(path + ".tmp", path)
        return {"batch": len(entries) + bool(new)}

    def partitions(self, start, end):
        return self.planned(self._files(self._entries()[start["batch"] : end["batch"]])) or [Ranges([])]

    def commit(self, end) -> None:
        """Nothing to do: the log stays, for what was taken is never taken again."""


class DelimitedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(schema, self.options)


def register(spark: SparkSession) -> str:
    """Make the source known to a session and let it take filters; returns the name of its format."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DelimitedFiles)
    return NAME
