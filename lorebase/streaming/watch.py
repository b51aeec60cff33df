"""Watching a folder: new files are ingested in micro-batches, each in path order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.knowledge_base import KnowledgeBase

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, base: KnowledgeBase, checkpoint: str, once: bool = True, files_per_batch: int = 1000, pdf: bool = False) -> StreamingQuery:
    """Ingest what is in ``folder`` and, unless ``once``, what comes later.

    Spark's checkpoint remembers which files were taken. A batch that is repeated after a failure finds its sources
    registered already, so each file counts once.
    """
    stream = (
        spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        names = [r["path"] for r in batch.select("path").collect()]  # at most ``files_per_batch`` paths
        if names:
            base.ingest(names, pdf=pdf)

    writer = stream.select("path").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
