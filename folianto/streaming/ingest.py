"""Continuous indexing: new files of a folder become a new generation of the index with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folianto.operators.indexing import append
from folianto.sources.files import enrich, parse_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, index: str, checkpoint: str, genre_map: DataFrame | None = None, language: str | None = "russian", once: bool = True) -> StreamingQuery:
    """Index the files of ``folder`` that the checkpoint hasn't seen; ``once`` ends when all are done.

    A batch that is repeated after a failure adds nothing twice: books that are in the index are skipped.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            append(batch.sparkSession, index, enrich(parse_files(batch), genre_map), language)

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
