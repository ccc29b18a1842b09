"""Frozen folders: tables published together, once, under a manifest of their digests.

Tables and manifest are written to a staging folder, which one rename makes the
frozen one. Whoever reads checks what is there against the manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators import checks

MANIFEST = "manifest.json"


class FrozenError(Exception):
    """A frozen folder is written again, or does not hold what its manifest says."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _files(spark, path)
    return files.exists(there)


def staged(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, str]], facts: dict) -> str:
    """Writes tables (with the column that tells their rows apart) and manifest to a new staging folder beside `path`."""
    staging = f"{path}-staging-{uuid.uuid4().hex}"
    entries = {}
    for name, (df, key) in tables.items():
        df.write.parquet(f"{staging}/{name}")
        entries[name] = {"key": key, **_state(spark.read.parquet(f"{staging}/{name}"), key)}
    text = json.dumps({"tables": entries, "facts": facts}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{staging}/{MANIFEST}")
    return staging


def _state(df: DataFrame, key: str) -> dict:
    found = checks.digest(checks.row_keys(df, key), "row").first()
    return {"n": found["n"], "sha256": found["sha256"]}


def publish(spark: SparkSession, staging: str, path: str) -> None:
    """The staging folder becomes `path`, if nothing has that name yet."""
    if exists(spark, path):
        raise FrozenError(f"{path} is frozen")
    files, there = _files(spark, path)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    files.mkdirs(there.getParent())
    name = staging.rstrip("/").rsplit("/", 1)[-1]
    moved = files.rename(source, there)
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not moved or files.exists(inside):  # another writer was first: a rename onto a folder moves into it
        if files.exists(inside):
            files.rename(inside, source)
        raise FrozenError(f"{path} is frozen")


def freeze(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, str]], facts: dict) -> None:
    """Publishes tables under `path`; a second time is an error. A job that dies before the rename leaves a staging folder only."""
    if exists(spark, path):
        raise FrozenError(f"{path} is frozen")
    publish(spark, staged(spark, path, tables, facts), path)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/{MANIFEST}").collect()))


def opened(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables of a frozen folder, all if none is named; an error if one is not as it was frozen."""
    entries = manifest(spark, path)["tables"]
    out = {}
    for name in names or entries:
        out[name] = spark.read.parquet(f"{path}/{name}")
        if _state(out[name], entries[name]["key"]) != {k: entries[name][k] for k in ("n", "sha256")}:
            raise FrozenError(f"table {name} of {path} is not the frozen one")
    return out


def asked_for(spark: SparkSession, path: str, name: str, rows: DataFrame) -> None:
    """An error if `rows` are not those of table `name` as it was frozen."""
    entry = manifest(spark, path)["tables"][name]
    if _state(rows, entry["key"]) != {k: entry[k] for k in ("n", "sha256")}:
        raise FrozenError(f"these rows are not the frozen table {name}")
