"""Cleaning and sampling of labelled URL tables.

Random choices order rows by the md5 of seed and key, so they are the same on
every cluster, partitioning and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import ranks

WHITE = r"(?U)^\s+|\s+$"


def hashed(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def judged(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds the canonical url and `verdict`: why a row goes ('kept' if it stays).

    Rows go, in this order, for being empty or holding white space, for over
    2,000 characters, for labels that contradict another copy of the canonical
    url, as exact and as canonical duplicates of an earlier row. The first two need
    no other row; for the rest, least and greatest values of a url are aggregated
    in part before the shuffle and joined back, so no task holds all copies of one.
    """
    rows = rows.withColumn("url", F.regexp_replace(F.coalesce("url", F.lit("")), WHITE, ""))
    rows = urls.with_columns(urls.with_parts(rows), [("canonical_url", urls.canonical(urls.SPARK))])
    bad = F.col("url").isin("", "nan", "None") | F.col("url").rlike(r"(?U)\s")
    alone = F.when(bad, "empty_or_whitespace").when(F.length("url") > urls.MAX_URL, "over_2000_chars")
    rows = rows.withColumn("_alone", alone)
    usable = rows.where("_alone is null")
    least = usable.groupBy("canonical_url", "url").agg(F.min(row_id).alias("_first_same"), F.min("label").alias("_least"), F.max("label").alias("_most"))
    one = least.groupBy("canonical_url").agg(F.min("_first_same").alias("_first"), (F.min("_least") != F.max("_most")).alias("_contrary"))
    found = usable.join(least.select("canonical_url", "url", "_first_same").join(one, "canonical_url"), ["canonical_url", "url"])
    verdict = (
        F.when(F.col("_contrary"), "conflicting_label").when(F.col("_first_same") != F.col(row_id), "exact_duplicate")
        .when(F.col("_first") != F.col(row_id), "canonical_duplicate").otherwise("kept")
    )
    names = [c for c in rows.columns if c != "_alone"]
    settled = rows.where("_alone is not null").select(*names, F.col("_alone").alias("verdict"))
    return found.select(*names, verdict.alias("verdict")).unionByName(settled)


def drop_report(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_malicious"))


def capped(rows: DataFrame, group: str, cap: int, seed: int, key: str) -> DataFrame:
    """At most `cap` rows of each group, chosen by hash."""
    order = F.row_number().over(Window.partitionBy(group).orderBy(hashed(seed, key), key))
    return rows.withColumn("_n", order).where(F.col("_n") <= cap).drop("_n")


def balanced(rows: DataFrame, per_class: int, seed: int, key: str, label: str = "label") -> DataFrame:
    """`per_class` rows of each label, chosen by hash; too few of one is an error."""
    short = [r for r in rows.groupBy(label).count().collect() if r["count"] < per_class]
    if short:
        raise ValueError(f"fewer than {per_class} rows of label {short[0][label]}")
    return capped(rows, label, per_class, seed, key)


def least_hashed(rows: DataFrame, by: list[str], keep: str, seed: int, key: str, digits: int = 3) -> DataFrame:
    """Of each group of `by`, the rows of the `keep` smallest hashes (`keep`: a column, one number a group).

    Hashes are counted by their first hex digits; whole ranges below a group's limit
    stay, and only the range that holds the limit is ordered. `keep` goes.
    """
    rows = rows.withColumns({"_hash": hashed(seed, key), "_range": F.substring(hashed(seed, key), 1, digits)})
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.first(keep).alias("_keep"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))  # 16 ** digits rows a group
    limits = counts.withColumn("_upto", upto).where("_upto - _n < _keep").select(*by, "_range", F.when(F.col("_upto") > F.col("_keep"), F.col("_keep") - F.col("_upto") + F.col("_n")).alias("_some"))
    near = rows.join(limits, [*by, "_range"])
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", key))
    some = near.where("_some is not null").withColumn("_place", place).where("_place <= _some").drop("_place")
    return near.where("_some is null").unionByName(some).drop("_hash", "_range", "_some", keep)


def built(rows: DataFrame, group: str, cap: int, per_class: int, seed: int, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The dataset of record and the report of what went: cleaned, at most `cap` rows of a `group`, `per_class` rows of each label, shuffled and numbered (sample_id).

    `group` is a part of the URL, or registered_domain. A class with too few rows is
    an error.
    """
    verdicts = judged(rows, row_id)
    kept = urls.with_parts(verdicts.where("verdict = 'kept'").select(row_id, "label", "url", "canonical_url"))
    some = balanced(capped(kept, group, cap, seed, row_id), per_class, seed, row_id)
    shuffled = ranks.numbered(some.select(row_id, "label", "url", "canonical_url", group, hashed(seed, row_id).alias("_hash")), ["_hash", row_id], "_place")
    return shuffled.select(F.format_string("Q%05d", "_place").alias("sample_id"), row_id, "label", "url", "canonical_url", group), drop_report(verdicts)
