"""A corpus from raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import jaccard, packing, quality, suffixes, toxicity
from linkloom.llm.common import fold_of, stored, table

#: Score from which a document counts as toxic, or as good.
ACCEPT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay, repeated rows are judged each, equal texts get equal scores, every window of a very long text counts, other columns pass as they are, whatever their names; an empty table stays empty."""
    return toxicity.below(docs, table(spark, sf_dir, "labels"), "toxic", fold_of("doc_id", 3) != 1, ACCEPT)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; repeated rows are judged each, equal texts get equal scores, very long texts are judged whole, other columns pass as they are, whatever their names; an empty table stays empty."""
    return quality.at_least(docs, table(spark, sf_dir, "labels"), "quality", fold_of("doc_id", 4) != 2, ACCEPT)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one of smallest id stays; rows without id, text or words stay, of repeated rows one does; very long texts are compared whole; other columns pass as they are, and an empty table stays empty."""
    return jaccard.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier ones are cut out; all documents stay, with the text that is left.

    Bytes of a character that was cut apart are left out; n_chars counts the new
    text. Copies of a whole text are left empty, repeated rows are one document,
    a very long text is searched whole, and an empty table stays empty.
    """
    cut = suffixes.drop_repeats(docs, as_text=True)
    rows = cut.select("doc_id", F.col("kept").alias("text"), "rest")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return rows.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is packed into sequences of 2048 tokens; an empty table gives no pieces, repeated rows are packed each, very long texts in pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("similar documents", drop_similar),
    ("repeated passages", drop_repeats),
    ("packing", pack),
]

#: Fitted models and subword tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
