"""Integrity checks: table differences, digests, uniqueness and leakage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import ranks
from linkloom.sources import files
from linkloom.sources.files import ContractError
from linkloom.sources.scratch import folder


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One row for each compared column: rows of one side only, differing texts or null places, largest numeric difference."""
    columns = [c for c in left.columns if c not in keys]
    kinds = dict(left.dtypes)
    both = left.withColumn("_l", F.lit(True)).alias("l").join(right.withColumn("_r", F.lit(True)).alias("r"), keys, "full")
    alone = F.count_if(F.col("_l").isNull() | F.col("_r").isNull())
    out = []
    for c in columns:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        paired = F.col("_l").isNotNull() & F.col("_r").isNotNull()
        numeric = kinds[c] in ("double", "float", "int", "bigint")
        gap = F.max(F.when(paired, F.abs(a - b))).cast("double") if numeric else F.lit(None).cast("double")
        odd = F.count_if(paired & (a.isNull() != b.isNull())) if numeric else F.count_if(paired & ~a.eqNullSafe(b))
        out.append(F.struct(F.lit(c).alias("column_name"), alone.alias("one_sided"), odd.alias("differing"), gap.alias("max_abs_diff")))
    rows = both.agg(F.array(*out).alias("c")).select(F.inline("c"))
    return rows.withColumn("status", F.when((F.col("one_sided") == 0) & (F.col("differing") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance), "PASS").otherwise("FAIL"))


def digest(rows: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """n, levels and sha256 of the keys, as text, in their order: a tree of digests.

    Sorted keys are hashed in blocks of `block`, joined by line breaks, and so are the
    digests of each level until one is left; a task holds one block at a time. Null
    keys are empty texts; no keys have the digest of an empty text and no levels.
    """
    parts = ranks.numbered(rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("part")), ["part"], "at")
    n = parts.count()
    levels, left = 0, n
    while left > 1 or (levels == 0 and n):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n")
        parts = parts.groupBy(F.expr(f"at div {block}").alias("at")).agg(F.sha2(joined, 256).alias("part"))
        levels, left = levels + 1, -(-left // block)
    root = parts.agg(F.coalesce(F.max("part"), F.sha2(F.lit(""), 256)).alias("sha256"))  # one row at most
    return root.select(F.lit(n).cast("bigint").alias("n"), F.lit(levels).alias("levels"), "sha256")


def digest_of(rows: DataFrame, key: str, block: int = 1024) -> str:
    return digest(rows, key, block).first()["sha256"]


def file_manifest(spark: SparkSession, path: str, block: int = 1024) -> tuple[DataFrame, str]:
    """Name, size and SHA-256 of each file below `path`, and one digest of them all, by name."""
    found = files.file_digests(spark, path)
    return found, digest_of(found.select(F.concat_ws(" ", "file", "n_bytes", "sha256").alias("entry")), "entry", block)


def same_as_saved(fresh: DataFrame, path: str, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """table_diff() of a table that was saved with a fresh one, which is saved and read back first, so both have passed through the same file form.

    Lines that the saved schema does not take are a row of their own (column_name
    '_corrupt'), and so are columns that differ ('_columns').
    """
    spark = fresh.sparkSession
    saved, corrupt = files.read_saved(spark, path)
    again = f"{folder(spark)}/again-{uuid.uuid4().hex}"
    files.save(fresh, again)
    back, _ = files.read_saved(spark, again)
    broken = corrupt.count()
    notes = [("_corrupt", 0, broken, None, "FAIL")] if broken else []
    if saved.columns != back.columns:
        notes.append(("_columns", 0, len(set(saved.columns) ^ set(back.columns)), None, "FAIL"))
    both = [c for c in saved.columns if c in back.columns]
    found = table_diff(saved.select(*both), back.select(*both), keys, tolerance)
    return found.unionByName(spark.createDataFrame(notes, found.schema)) if notes else found


def row_keys(df: DataFrame, key: str) -> DataFrame:
    """`row`: each row as text, its key first, the columns in order of their names."""
    return df.select(F.concat_ws("\t", F.col(key).cast("string"), F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})).alias("row"))


def check(name: str, df: DataFrame, failures: Column) -> DataFrame:
    return df.agg(failures.cast("bigint").alias("failures")).select(F.lit(name).alias("check_name"), F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status"), "failures")


def unique(name: str, df: DataFrame, key: str) -> DataFrame:
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return check(name, repeated, F.count("*"))


def not_shared(name: str, df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand in several parts."""
    spread = df.groupBy(group).agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a <> b")
    return check(name, spread, F.count("*"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def _ask_unique(df: DataFrame, keys: list[str], side: str) -> None:
    if not df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        raise ContractError(f"keys {keys} repeat on the {side} side of a join")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that is an error if the keys repeat on either side."""
    _ask_unique(left, keys, "left")
    _ask_unique(right, keys, "right")
    return left.join(right, keys, how)


def one_to_many(one: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    """`many` joined with `one`; an error if the keys repeat in `one`."""
    _ask_unique(one, keys, "one")
    return many.join(one, keys)
