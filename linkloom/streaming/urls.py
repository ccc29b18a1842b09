"""The URL features on streams: they are stateless expressions, so a stream of URLs needs nothing more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls


def featured(stream: DataFrame, url: str = "url") -> DataFrame:
    """Adds parts and features to a stream (or table) of URLs."""
    return urls.with_features(urls.with_parts(stream, url), url)


def windowed_hosts(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """URLs by host in tumbling windows, with late data up to `late`."""
    rows = urls.with_parts(stream).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), "host").agg(F.count("*").alias("n"), F.count_if(F.col("scheme") == "https").alias("n_https"))
