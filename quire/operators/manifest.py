"""Which contents have been dealt with, from run to run.

A content is known by its SHA-256. A manifest is a folder to which each run adds its rows as a folder of its own that shows when it is whole, so runs at the same time lose nothing; what
two runs did at the same time is there twice, and `known` takes the earlier.

Defined cases: a null content has no hash and is never a repeat; rows that repeat both path and content are one file's; of files with one content the first in order of path components is
the one to do; a content that most files have is aggregated before it is shuffled; empty listings and manifests give no rows; extra columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.sources.shared import append, appended, written

ROWS = "content_hash string, path string, output_path string, at timestamp"


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def known(spark: SparkSession, manifest: str) -> DataFrame:
    """content_hash, path, output_path, at: the earliest row of each content in a manifest."""
    rows = appended(spark, manifest, StructType.fromDDL(ROWS))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("at", "path", "output_path")).alias("first"))
    return first.select("content_hash", "first.path", "first.output_path", "first.at")


def add(manifest: str, rows: DataFrame) -> None:
    """Adds content_hash, path, output_path to a manifest, as of now."""
    append(rows.select("content_hash", "path", "output_path", F.current_timestamp().alias("at")), manifest)


def repeats(files: DataFrame, path: str = "path") -> DataFrame:
    """path, content_hash, ... -> with first_path: the first path of each content, in order of path components; a path's own where it has no hash."""
    parts = F.split(F.col(path).cast("string"), "/") if dict(files.dtypes)[path] == "string" else F.col(path)
    first = files.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct(parts.alias("parts"), F.col(path).alias("first_path"))).alias("least"))
    # written first, so that the join with a content that most files have can be split
    first = written(first.select("content_hash", "least.first_path"), "first")
    return files.join(first, "content_hash", "left").withColumn("first_path", F.coalesce("first_path", path)).select(*files.columns, "first_path")


def told(files: DataFrame, manifest: str) -> DataFrame:
    """path, content_hash, ... -> with first_path and done_path (where an earlier run's manifest has the content) and status: new, repeat (of first_path) or done."""
    before = known(files.sparkSession, manifest).select("content_hash", F.col("path").alias("done_path"))
    out = repeats(files).join(written(before, "known"), "content_hash", "left")
    status = F.when(F.col("done_path").isNotNull(), "done").when(F.col("path") != F.col("first_path"), "repeat").otherwise("new")
    return out.select(*files.columns, "first_path", "done_path", status.alias("status"))
