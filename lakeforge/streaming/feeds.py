"""Folder feeds as streams: new files are read once, in bounded batches, and written under the batch's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from lakeforge.functions.cleaning import row_hash
from lakeforge.sources.files import Feed


def read_stream(spark: SparkSession, feed: Feed, columns: list[str], max_files: int = 1000) -> DataFrame:
    """The feed's files as a stream of text columns with audit columns. ValueError for formats that don't stream."""
    if feed.format not in ("csv", "jsonl"):
        raise ValueError(f"format {feed.format!r} does not stream")
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", feed.dated_folders)
    if feed.format == "csv":
        df = reader.csv(feed.path, header=feed.header, sep=feed.delimiter, encoding=feed.encoding, mode="PERMISSIVE")
    else:
        df = reader.json(feed.path)
    return df.withColumns({"_ingest_ts": F.current_timestamp(), "_source_system": F.lit(feed.system), "_source_file": F.col("_metadata.file_path"), "_row_hash": row_hash(columns)})


def ingest_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there and ends. Files are noted in the checkpoint, so a run that is repeated loads none twice."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def without_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key and event time; repeats are dropped within `delay`: the state that is held stays bounded."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*keys, event_time])


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts a tumbling window; a window is given out once, when the watermark has passed it."""
    grouped = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n")
