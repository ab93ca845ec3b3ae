"""Files that arrive as a stream: chunk, keep what is new, track. Beyond the batch commands, with the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.commands import Repository


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path (below folder), content of each file that appears."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    from ..functions.scalars import relative_path

    return rows.where("length > 0").select(relative_path(F.col("path"), folder.removeprefix("file:")).alias("path"), "content", "modificationTime")


def ingest(repo: Repository, files: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add each micro-batch's files. A batch that is tried again adds nothing twice: chunks are anti-joined and files upserted."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            repo.add(batch.select("path", "content").dropDuplicates(["path"]))

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(files: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files and bytes by window of their modification time, with a watermark for late ones."""
    rows = files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window))
    return rows.agg(F.count("*").alias("files"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))
