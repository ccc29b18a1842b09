import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from linkloom.llm import ranking


def brute(docs, items, k=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    own = [(d, Counter(words(t))) for d, t in docs if d is not None and words(t)]
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, c in own:
            m = 75 + 25 * sum(c.values()) * len(own) // total
            score = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, d))
        out += [(item, n, d, -s) for n, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **options):
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("item", F.lit(None).cast("int"))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    return sorted((tuple(r) for r in ranking.ranked(left.repartition(3), right, **options).collect()), key=str)


def tables(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, text(rng.randrange(0, 80))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties
    return docs, [(i, text(12)) for i in range(15)]


def test_ranks(spark, monkeypatch):
    docs, items = tables(0)
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(ranking, "SHARD_DOCS", 37)
    assert got(spark, docs, items, stages=7) == want
    assert got(spark, docs, items, k=3, stages=1) == brute(docs, items, 3)


def test_items_in_passes(spark, monkeypatch):
    docs, items = tables(1)
    monkeypatch.setattr(ranking, "PASS_TERMS", 100)
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "Ünï-code ÄB_c ab C 1st"), (4, "Ünï-code ÄB_c ab C 1st"), (None, "c c c"), (5, "c " * 200_000), (6, "ÜNï KK end"), (7, "c d e f"), (8, "c")]
    items = [(1, "C c ab"), (1, "C c ab"), (1, "end"), (None, "ÜNï"), (2, None), (3, ""), (4, "nowhere"), (5, "c d")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items[4:7]) == [] and got(spark, [], items) == [] and got(spark, docs, []) == []
