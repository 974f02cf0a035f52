"""Optional streaming ingest: new and edited Markdown files of a folder reach the index in micro-batches.

A file stream cannot report deletions, so pruning stays with the batch command.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.config import Workspace, canonical
from inkwell.plans import indexer
from inkwell.sources.vault import found_among

def watch(spark: SparkSession, ws: Workspace, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Index the files of each micro-batch that a walk of the folder would find; unchanged ones are skipped by their hash, all others stay as they are.

    The stream carries paths only; contents are read of changed files alone. Files with a name that Spark's file sources pass over
    (those that begin with `_`) and empty ones are left to the batch command.
    """
    root = canonical(folder)
    if root is None:
        raise FileNotFoundError(f"can't resolve {folder}")
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)

    def apply(batch: DataFrame, _: int) -> None:
        paths = batch.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
        indexer.ship(batch.sparkSession)
        indexer.run(batch.sparkSession, ws, [root], found=found_among(paths, root, ws.config.ignore.globs))

    writer = files.select("path").writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
