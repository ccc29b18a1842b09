import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.llm import licenses, merkle, queries

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    return sorted((tuple(None if r[n] is None else round(float(r[n]), 6) if isinstance(r[n], float) else r[n] for n in names) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op3_merkle_fingerprints", "op5_license_scan", "op9_jaccard_join"])
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(queries.SQL[name]).df().astype(object)
    want = [{k: None if v is None or v != v else v for k, v in r.items()} for r in want.to_dict("records")]
    assert plain([r.asDict() for r in got.collect()], sorted(got.columns)) == plain(want, sorted(got.columns))


def test_equal_roots_and_located_edits(spark):
    base = "First paragraph, long enough for two blocks of text.\nSecond one.\n\nA section of its own.\n"
    rows = spark.createDataFrame([(1, base, base), (2, base, base.replace("Second one", "Second two")), (3, base, base + "More."), (4, "", "")], "id int, a string, b string")
    both = merkle.with_tree(merkle.with_tree(rows, "a", "ta"), "b", "tb")
    got = both.orderBy("id").select((F.col("ta.root") == F.col("tb.root")).alias("same"), merkle.likeness("ta", "tb").alias("near"), merkle.first_difference("ta", "tb").alias("at")).collect()
    assert [r["same"] for r in got] == [True, False, False, True]
    assert [r["at"] for r in got] == [None, "0/1/0", "1/1/0", None]
    assert got[0]["near"] == got[3]["near"] == 1.0 and 0.5 < got[1]["near"] < 1


def test_fingerprints_of_odd_rows(odd, empty):
    got = merkle.compare_with_edit(odd)
    assert got.count() == odd.count()
    assert got.where(merkle.likeness("tree", "next_tree").isNull() | merkle.likeness("tree", "edited_tree").isNull()).isEmpty()
    assert merkle.compare_with_edit(empty).count() == 0
    (one,) = merkle.compare_with_edit(odd.where("doc_id = 7")).collect()
    assert one["tree"]["root"] == one["next_tree"]["root"]


def test_licence_labels(spark, odd, empty):
    text = "Foo. Licensed under the Apache License, Version 2.0. Apache license! Licensed under CC BY-NC 4.0, MIT\nLicense. gnu general public"
    (got,) = licenses.digest(licenses.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert (got["n_base"], got["first_word"], got["last_word"]) == (4, 4, 18)
    assert got["base_labels"] == "apache,cc-by,mit" and got["labels"] == "apache,apache-2.0,cc-by,cc-by-nc,mit" and got["score"] == 1.0
    none = licenses.digest(licenses.scan_documents(odd))
    assert none.count() == odd.count() and none.where("n_base <> 0 or first_word is not null or labels <> '' or score <> 0").isEmpty()
    assert licenses.scan_documents(empty).count() == 0
