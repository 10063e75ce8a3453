"""Streaming extension: hunting on a stream, and counts per rule within a time frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracequarry.operators.hunt import hunt
from tracequarry.rules.parse import Rule
from tracequarry.sources.store import resolve


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream, whether it is a single file or a folder of parts that others are added to."""
    path = f"{folder}/{name}.parquet"
    system, inner = resolve(path)
    reader = spark.readStream.schema(schema)
    if system.get_file_info(inner).type.name == "Directory":
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def hunt_stream(stream: DataFrame, rules: Sequence[Rule], **options) -> DataFrame:
    """Hits of a streaming DataFrame; stateless, so any output mode with append works."""
    return hunt(stream, rules, **options)


def count_in_windows(hits: DataFrame, timestamp: str, keys: Sequence[str], length: str = "5 minutes", late: str = "10 minutes", least: int = 1) -> DataFrame:
    """Hits per rule, keys and window of event time, for groups with at least ``least``; late rows count
    until the watermark passes them. Works on streams and on tables."""
    marked = hits.withWatermark(timestamp, late) if hits.isStreaming else hits
    counted = marked.groupBy(F.window(timestamp, length).alias("w"), "rule", *keys).agg(F.count("*").alias("n_hits"))
    return counted.where(F.col("n_hits") >= least).select(F.col("w.start").alias("window_start"), "rule", *keys, "n_hits")
