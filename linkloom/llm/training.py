"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, visible, per_class: int) -> DataFrame:
    """`docs` rows with their `label`, at most `per_class` of each of 0 and 1.

    `visible` is the condition on doc_id that a label may be learnt from. The
    rows with the lowest hash of the id are taken, so the choice is stable; ids
    with two different labels are left out. Only their ids, 2 * per_class of
    them, are broadcast.
    """
    known = (
        labels.where(visible & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other").select("doc_id", "label")
    )
    picked = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    first = docs.join(F.broadcast(picked), "doc_id").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    return first.where("copy = 1").drop("copy")
