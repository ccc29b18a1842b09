"""File sources and sinks with explicit contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkloom.operators import ranks
from linkloom.sources.scratch import stored


# Fields that the usual CSV dialect takes for missing ones.
NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: Fixed value: the name under which an index without name is read back.
INDEX = "Unnamed: 0"


class ContractError(Exception):
    """A table does not keep what its reader asks for."""


def read_csv(spark: SparkSession, path: str, schema: str, nulls: str = "empty") -> DataFrame:
    """A CSV file with header and quoted fields. nulls: 'keep' (empty fields stay empty texts), 'empty' (they are null) or 'default' (all fields of NA are)."""
    if nulls == "default":  # tokens are looked for in the fields as written, before they are cast
        wanted = spark.createDataFrame([], schema).schema
        raw = spark.read.csv(path, header=True, schema=", ".join(f"`{f.name}` string" for f in wanted), quote='"', escape='"', multiLine=True)
        return raw.select(*(F.when(~F.col(f"`{f.name}`").isin(NA), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in wanted))
    df = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True, nullValue="" if nulls == "empty" else "\0", emptyValue="")
    if nulls == "keep":
        df = df.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    return df


def read_labelled(spark: SparkSession, path: str, url: str, label: str, labels: dict[str, int], source: str) -> DataFrame:
    """(url, label, source) of a raw CSV file; missing columns and unknown labels are errors."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    missing = [c for c in (url, label) if c not in raw.columns]
    if missing:
        raise ContractError(f"{path} lacks {missing}")
    known = F.create_map(*(F.lit(x) for k, v in labels.items() for x in (k.strip().lower(), v)))
    out = raw.select(F.col(url).alias("url"), known[F.lower(F.trim(label))].alias("label"), F.lit(source).alias("source"))
    if not out.where("label is null").isEmpty():
        raise ContractError(f"{path} has labels other than {sorted(labels)}")
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_name().alias("path"))


def read_images(spark: SparkSession, path: str, pattern: str = "*.pgm") -> DataFrame:
    """(path, content) of image files, as bytes; nothing is decoded here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="errorifexists")


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CORRUPT = "_corrupt"
#: What quoted empty fields are read as at first, so that they differ from missing ones.
EMPTY = "\x01empty\x01"


def save(df: DataFrame, path: str) -> None:
    """A CSV table and, beside it, its schema: read_saved() gives the same rows and types."""
    df.write.csv(path, header=True, quote='"', escape='"', timestampFormat=STAMP, mode="errorifexists")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{path}-schema")


def read_saved(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a saved table that its schema takes, and the lines that it does not (_corrupt)."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}-schema").first()["value"]))
    asked = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = spark.read.csv(path, header=True, schema=asked, quote='"', escape='"', multiLine=True, timestampFormat=STAMP, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, emptyValue=EMPTY)
    rows = stored(parsed, "parsed")  # corrupt lines alone can't be asked of the file itself
    texts = {f.name for f in schema.fields if f.dataType == StringType()}
    plain = [F.when(F.col(c) != EMPTY, F.col(c)).when(F.col(c) == EMPTY, "").alias(c) if c in texts else F.col(c) for c in schema.names]
    return rows.where(F.col(CORRUPT).isNull()).select(*plain), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def with_index(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their place in `order` (from 0) as a first column without name, as tables with an index are written."""
    placed = ranks.numbered(df, order, "_index")
    return placed.select(F.col("_index").alias(INDEX), *df.columns)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_once(df: DataFrame, path: str) -> None:
    """A frozen table: writing it again is an error."""
    df.write.mode("errorifexists").parquet(path)
