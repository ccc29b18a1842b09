import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from linkloom.llm import jaccard, quality, toxicity
from linkloom.llm.common import fold_of

from .test_suffixes import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_do_what_their_operators_say(spark, stages):
    docs, clean, good, single, cut, packed = stages
    assert all(s.columns == docs.columns and s.dtypes == docs.dtypes for s in stages[1:5])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    low = toxicity.score_documents(docs, labels, "toxic", fold_of("doc_id", 3) != 1).where(F.col("score") < 0.7)
    assert ids(clean) == ids(low)
    high = quality.score_documents(clean, labels, "quality", fold_of("doc_id", 4) != 2).where(F.col("score") >= 0.7)
    assert ids(good) == ids(high)
    assert ids(single) == {r["component"] for r in jaccard.similar_documents(good).select("component").collect()}
    want = brute([(r["doc_id"], r["text"]) for r in single.collect()], 100)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert got == {i: (t := kept.decode("utf-8", "ignore"), len(t)) for i, (_, _, kept) in want.items()}
    assert ids(packed) == ids(cut)
    total = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert total.where("n > 2048").isEmpty()


def test_run_is_the_stages(spark, stages):
    got = p.run(spark, SF)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert got.select(key).exceptAll(stages[-1].select(key)).isEmpty() and got.count() == stages[-1].count()


def test_odd_and_empty_tables(spark, tmp_path):
    (tmp_path / "s").mkdir()
    spark.createDataFrame([(2, 1, 0), (4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "s/labels.parquet"))
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (4, "a b c d e f", None, "s", 11, 3), (4, "a b c d e f", None, "s", 11, 3), (None, "x" * 400, "en", None, 400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long")
    for table in (docs, docs.limit(0)):
        now = table
        for k, (_, stage) in enumerate(p.STAGES):
            now = stage(spark, now, str(tmp_path / "s"))
            if k < 4:
                assert now.columns == docs.columns
            path = str(tmp_path / f"{table is docs}-{k}")
            now.write.parquet(path)
            now = spark.read.parquet(path)
        assert (now.count() > 0) == (table is docs)
