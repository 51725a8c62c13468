"""Files as they arrive: the batch operators over a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import delimited


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], glob: str = "*.csv", files_per_batch: int = 100) -> StreamingQuery:
    """Parse every new file of ``folder`` once and hand ``(datasets, rows, batch)`` to ``sink``.

    Which files were taken is kept in ``checkpoint``; the trigger takes all
    that is there and ends.
    """

    def take(files: DataFrame, batch: int) -> None:
        datasets, rows = delimited.parse(delimited.read_records(files.select("path", "length", "content")))
        sink(datasets, rows, batch)

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
