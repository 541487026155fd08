"""The row-wise operators on streams, and counts of detections per event-time window.

Detection and masking are projections, so the batch functions run unchanged
on a streaming DataFrame; only the counts keep state. They leave it, in append
mode, as soon as the watermark has passed their window, for a file sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MaskingConfig
from ..operators.detect import detect
from ..operators.mask_text import mask_text
from ..sources.lines import partitions_of
from ..storage import own_path

STREAM_CONFIG = MaskingConfig(as_of="2025-06-15", confidence_threshold=0.5)
#: When a document arrives: SQL of either engine, given its spelling of 7 * doc_id minutes.
EVENT_TIME = "timestamp '2024-01-01 00:00:00' + {interval}"


def detect_stream(stream: DataFrame, text_col: str = "text", config: MaskingConfig | None = None) -> DataFrame:
    return detect(stream, text_col, config)


def mask_stream(stream: DataFrame, text_col: str = "text", config: MaskingConfig | None = None) -> DataFrame:
    return mask_text(stream, text_col, config)


def windowed_counts(stream: DataFrame, time_col: str, text_col: str = "text", window: str = "1 hour", late: str = "2 hours", config: MaskingConfig | None = None) -> DataFrame:
    """(window_start, type, n): detections per tumbling window; later rows than the watermark are dropped."""
    found = detect(stream.withWatermark(time_col, late), text_col, config, keep=[time_col])
    return found.groupBy(F.window(time_col, window), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "type", "n")


def append_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream to the end of what there is, appending closed windows to Parquet files in path."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def counts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windowed_counts over the texts of documents read as a stream to its end, seven minutes apart by id.

    Only windows that the watermark (two hours behind the latest) has passed are there.
    """
    batch, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/document[s].parquet")  # a pattern, since a stream's plain path has to be a folder
    if partitions_of(batch) < cores:
        stream = stream.repartition(cores)
    arrival = EVENT_TIME.format(interval="make_dt_interval(0, 0, cast(7 * doc_id as int), 0)")
    rows = stream.selectExpr(f"cast({arrival} as timestamp) as ts", "text")
    path = own_path(spark, "counts")
    counts = windowed_counts(rows, "ts", config=STREAM_CONFIG)
    append_to_files(counts, path, own_path(spark, "progress"))
    return spark.read.schema(counts.schema).parquet(path).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
