"""Batches of files as sets: which are read, which repeat a name, what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def sources(files: DataFrame, glob_suffix: str = ".docx") -> DataFrame:
    """Paths that end in the glob's suffix, and .doc siblings when that is .docx. The match is on exact case, as in a POSIX glob."""
    main = files.where(F.endswith("path", F.lit(glob_suffix)))
    if glob_suffix != ".docx":
        return main
    more = files.where(F.endswith("path", F.lit(".doc"))).join(main.select("path"), "path", "left_anti")
    return main.unionByName(more.select(main.columns))


def duplicates(files: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """With `duplicate`: whether an earlier path, in order of path components, has the same name, but for case unless that counts.

    The earliest path of each name comes from an aggregation, which combines before it shuffles, so a name that most files have is no window."""
    name = F.element_at(F.split("path", "/"), -1) if case_sensitive else basename(F.col("path"))
    files = files.withColumn("name", name)
    first = files.groupBy("name").agg(F.min(F.struct(F.split("path", "/").alias("parts"), "path")).alias("least")).select("name", F.col("least.path").alias("first_path"))
    return files.join(first, "name").withColumn("duplicate", F.col("path") != F.col("first_path")).drop("first_path")


def outcomes(files: DataFrame) -> DataFrame:
    """path, status, reason of each file of a listing: one row a file, whatever is wrong with it."""
    suffix = F.regexp_extract(F.lower("path"), r"\.[^./]*$", 0)
    status = F.when(F.col("duplicate"), "skipped").when(suffix == ".docx", "success").otherwise("failed")
    reason = F.when(F.col("duplicate"), "duplicate name").when(suffix == ".doc", "no converter").when(suffix != ".docx", "unsupported type")
    return duplicates(files).select("path", status.alias("status"), reason.alias("reason"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def output_collisions(outputs: DataFrame) -> DataFrame:
    """With `collides`: whether another row has the same output name. A name that most rows have is counted before it is shuffled."""
    n = outputs.groupBy("output_name").agg(F.count("*").alias("n"))
    return outputs.join(n, "output_name").select(*outputs.columns, (F.col("n") > 1).alias("collides"))


def first_of_each(outputs: DataFrame) -> DataFrame:
    """doc_id, output_name of the first document, in order of path components, of each output name."""
    first = outputs.groupBy("output_name").agg(F.min(F.struct(F.split("doc_id", "/").alias("parts"), "doc_id")).alias("least"))
    return first.select("output_name", F.col("least.doc_id").alias("doc_id"))
