import unicodedata

import duckdb
import pandas as pd
import pytest

from linkloom.operators import text
from linkloom.plans import catalog, datasets, explanations, reports, training  # noqa: F401  the latter four add their queries to the catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def comparable(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in row) for row in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert comparable(catalog.QUERIES[name](spark, sf).toPandas()) == comparable(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_display_escape(spark):
    texts = ["plain text", "a\u202eb\u00a0c\td", "x" * 305 + "\u200b", "\U000e0001", "", "😀 é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def by_hand(t):
        odd = [c for c in t[:300]]
        out = "".join(c if c == " " or unicodedata.category(c)[0] not in "CZ" else f"\\u{ord(c):04x}" if ord(c) < 65536 else f"\\U{ord(c):08x}" for c in odd)
        return out + (f" ... [{len(t) - 300} more characters not shown]" if len(t) > 300 else "")

    got = {r["i"]: r["s"] for r in rows.select("i", text.escaped(text.F.col("t")).alias("s")).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
