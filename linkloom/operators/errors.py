"""Worksheets of wrong answers: their export for reading by hand, and the summary of what was filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.runner import observed

#: Categories that a worksheet may have at most.
CATEGORIES = 6


class WorksheetError(Exception):
    """A worksheet is not filled in as it has to be."""


def worksheet(rows: DataFrame, label: str, predicted: str, score: str, key: list[str], context: list[str], each: int | None = None) -> DataFrame:
    """The wrong answers, the surest first (`each`: so many of each kind), with their context and two columns to fill in."""
    kind = F.when(F.col(label) == 0, "false positive").otherwise("false negative")
    sure = F.when(F.col(label) == 0, -F.col(score)).otherwise(F.col(score))
    wrong = rows.where(F.col(label) != F.col(predicted)).withColumns({"error_type": kind, "_sure": sure})
    if each is not None:
        place = F.row_number().over(Window.partitionBy("error_type").orderBy("_sure", *key))
        wrong = wrong.withColumn("_place", place).where(F.col("_place") <= each)
    blank = F.lit("")
    return wrong.select(
        *key, "error_type", F.when(F.col(label) == 0, "benign").otherwise("suspicious/malicious").alias("true_label"), F.when(F.col(predicted) == 0, "benign (below threshold)").otherwise("malicious (at/above threshold)").alias("prediction"),
        F.bround(score, 3).alias("risk_score"), *context, blank.alias("your_category"), blank.alias("evidence_note"),
    )


def summarised(filled: DataFrame, most: int = CATEGORIES) -> DataFrame:
    """(error_type, category, n_rows); an error if a row lacks a category or a note, or if there are more than `most` categories."""
    category, note = (F.lower(F.trim(F.coalesce("your_category", F.lit("")))), F.trim(F.coalesce("evidence_note", F.lit(""))))
    lacking = observed(filled, {"category": F.count_if(_blank(category)), "note": F.count_if(_blank(note))})
    if any(lacking.values()):
        raise WorksheetError(f"{lacking['category']} rows lack a category and {lacking['note']} lack a note")
    counts = filled.groupBy("error_type", category.alias("category")).agg(F.count("*").alias("n_rows"))
    n = counts.select("category").distinct().limit(most + 1).count()
    if n > most:
        raise WorksheetError(f"more than {most} categories: merge some")
    return counts


def _blank(x: Column) -> Column:
    return x == ""
