"""Text files by numbered lines, and what can be read from such lines: Markdown tables and pinned versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Module names that reach the network or a browser.
NETWORK = "requests|httpx|aiohttp|urllib[.]request|urllib3|http[.]client|socket|webbrowser|selenium|playwright"
#: A line of code that imports one of them.
FORBIDDEN = rf"^\s*(import|from)\s+({NETWORK})\b"


def lines_of(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, line (from 1) and value of every line of `text`.

    Lines end at \\n, \\r\\n or \\r; a break at the end opens no further line. Null and
    empty texts have no lines.
    """
    breaks = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n\\z", "")
    found = rows.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(breaks, "\n", -1)).alias("line", "value"))
    return found.withColumn("line", F.col("line") + 1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line and value of every line of the text files at `path`.

    Each file is read whole, as splits of a file do not know how many lines lie
    before them; many files are read side by side.
    """
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("whole"))
    return lines_of(whole, "whole", "file")


def matching_lines(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("value").rlike(pattern))


def markdown_rows(lines: DataFrame, file: str = "file") -> DataFrame:
    """`file`, line, table (the line of its first row), row (from 0, the header) and cells of each row of a Markdown table.

    A table is a run of lines that begin with '|'; rules of dashes are no rows, and
    '\\|' is a bar inside a cell.
    """
    bars = lines.where(F.ltrim("value").startswith("|")).withColumn("inner", F.regexp_replace(F.trim("value"), r"^[|]|(?<!\\)[|]$", ""))
    bars = bars.withColumn("cells", F.transform(F.split("inner", r"(?<!\\)[|]", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))
    of_file = Window.partitionBy(file)  # the lines of one file, which was read whole
    bars = bars.withColumn("run", F.col("line") - F.row_number().over(of_file.orderBy("line")))
    bars = bars.withColumn("table", F.min("line").over(Window.partitionBy(file, "run")))
    rows = bars.where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    order = Window.partitionBy(file, "table").orderBy("line")
    return rows.select(file, "line", "table", (F.row_number().over(order) - 1).alias("row"), "cells")


def pins(lines: DataFrame, *keep: str) -> DataFrame:
    """`keep`, line, name (lower case, '_' as '-') and version of each line name==version."""
    pattern = r"^\s*([A-Za-z0-9_.\-]+)==([^\s;]+)"
    found = lines.where(F.col("value").rlike(pattern))
    return found.select(*keep, "line", F.translate(F.lower(F.regexp_extract("value", pattern, 1)), "_", "-").alias("name"), F.regexp_extract("value", pattern, 2).alias("version"))
