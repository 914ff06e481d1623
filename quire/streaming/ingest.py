"""Structured Streaming over a folder of text files: the batch plan, kept up to date. An extension; the batch operators have no streaming counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify, text


def classified_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, arrived, raw_text, class for each line that isn't blank."""
    lines = spark.readStream.schema("value string").format("text").load(folder)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"), text.normalize_whitespace(F.col("value")).alias("raw_text"))
    return rows.where(F.length("raw_text") > 0).withColumn("class", classify.paragraph_class(F.col("raw_text"), F.rlike("raw_text", F.lit(r"^(\d+\.|-)\s"))))


def class_counts(lines: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Lines by class and window of arrival; state older than the watermark is dropped."""
    return lines.withWatermark("arrived", late).groupBy(F.window("arrived", window), "class").agg(F.count("*").alias("n"))
