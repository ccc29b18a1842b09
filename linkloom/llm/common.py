"""What the training-data operators share: table access and intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.scratch import stored

__all__ = ["documents", "fold_of", "packed_texts", "partition_keys", "slices", "stored", "stored_counting", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id and text of every document; whatever else the table holds is left unread."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def fold_of(column: str, buckets: int):
    """crc32 of the id as text, modulo `buckets`: which rows a learner may see."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(buckets)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partition_keys(spark, count: int) -> list[int]:
    """An integer for each of `count` hash partitions."""
    rows = spark.range(40 * count).selectExpr("cast(id as int) as id", f"pmod(hash(cast(id as int)), {count}) as part").groupBy("part").agg(F.min("id").alias("id")).collect()
    return sorted(r["id"] for r in rows)


def stored_counting(df: DataFrame, label: str, condition: str = "true") -> tuple[DataFrame, int]:
    """stored(), and how many of the rows meet a condition: counted while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), label)
    return out, seen.get["n"]


def packed_texts(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and the text's UTF-8 bytes, compressed for the shuffle."""
    schema = rows.select(*keep, F.lit(b"").alias("packed")).schema

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            packed = [squeeze.compress((t or "").encode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            yield pa.record_batch([*(b.column(k) for k in keep), pa.array(packed, pa.binary())], [*keep, "packed"])

    return rows.select(*keep, "text").mapInArrow(run, schema)
