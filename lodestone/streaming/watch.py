"""Watch a folder: new files are indexed as they come, in micro-batches with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import epoch_seconds, is_blank
from ..plans.catalog import Catalog, latest
from ..plans.ingest import embedder_of
from ..sources.convert import convert

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(catalog: Catalog, corpus: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index files of a folder, one entry a file.  A batch that is run again replaces the same entries, so
    every file counts once."""
    embedder = embedder_of(catalog, corpus)
    found = catalog.spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(folder)

    def index(batch: DataFrame, number: int) -> None:
        files = batch.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), epoch_seconds(F.col("modificationTime")).alias("mtime"), F.col("length").alias("size"), "content")
        entries = latest(convert(files).filter("status = 'ok'"), ["path"], "mtime").filter(~is_blank(F.col("text")))
        entries = entries.select("path", F.col("path").alias("source_path"), F.lit(None).cast("string").alias("description"), "mtime", "size", "text")
        if not entries.isEmpty():
            catalog.put_files(corpus, entries, embedder)

    writer = found.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
