"""Materials and mix tables: the i-th table of a kind takes the i-th heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import classify, text


def titled_rows(rows: DataFrame, headings: DataFrame, width: int, exact: bool, default: str) -> DataFrame:
    """rows: doc_id, table_ord, row_ord, cells. headings: doc_id, ord, heading. -> doc_id, table_no, row_ord, heading, cells, bold.

    Tables count whose first row has `width` cells (exact) or two or more. Tables left without rows keep their number.
    """
    first = F.first(F.size("cells")).over(Window.partitionBy("doc_id", "table_ord").orderBy("row_ord"))
    rows = rows.withColumn("n_cols", first).where(F.col("n_cols") == width if exact else F.col("n_cols") >= 2)
    rows = rows.withColumn("table_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("table_ord")) - 1)
    kept = rows.where(~classify.is_header_row(F.col("cells"))).withColumn("cells", text.pad_cells(F.col("cells"), width))
    named = kept.join(headings.select("doc_id", F.col("ord").alias("table_no"), "heading"), ["doc_id", "table_no"], "left")
    bold = classify.is_bold_row(F.get("cells", F.lit(0))) if exact else F.lit(False)
    return named.select("doc_id", "table_no", "row_ord", F.coalesce("heading", F.lit(default)).alias("heading"), "cells", bold.alias("bold"))


def materials(rows: DataFrame, headings: DataFrame) -> DataFrame:
    return titled_rows(rows, headings, 3, False, "Reagents")


def mixes(rows: DataFrame, headings: DataFrame, documents: DataFrame) -> DataFrame:
    """Only for documents (doc_id) that have a mixes segment."""
    return titled_rows(rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi"), headings, 2, True, "Reagent Mix")
