import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import quality, toxicity
from linkloom.llm.common import fold_of

NO_LABELS = "doc_id long, quality int, toxic int"


def invented(n, seed):
    """Texts of made-up words; every fourth holds two words of an unkind stem with endings of its own."""
    rng = np.random.default_rng(seed)
    parts = ["an", "the", "re", "in", "ou", "st", "er", "ble", "ing", "ha", "or", "ti"]

    def word():
        return "".join(rng.choice(parts, rng.integers(1, 4)))

    out = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(10, 80))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            words.insert(rng.integers(0, len(words)), "zorgle" + word()[:2])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_unseen_spellings_are_caught():
    seen, new = invented(600, 1), invented(300, 2)
    model = toxicity.fit([t for _, t, _ in seen], [y for _, _, y in seen])
    score = toxicity.Scorer(model).scores([t for _, t, _ in new] + ["zorglexq was here, zorglyng too", "", None, "***"])
    y = np.array([y for _, _, y in new])
    assert ((score[:300] >= 0.7) == (y == 1)).mean() > 0.97
    assert score[300] > 0.5 and (score[301:] < 0.7).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_documents(docs, labels, "quality", fold_of("doc_id", 4) != 2).join(labels, "doc_id").where(fold_of("doc_id", 4) == 2).toPandas()
    assert ((scored["score"] >= 0.7) == (scored["quality"] == 1)).mean() > 0.95
    kept = quality.at_least(docs, labels, "quality", fold_of("doc_id", 4) != 2, 0.7)
    assert kept.columns == docs.columns
    want = quality.score_documents(docs, labels, "quality", fold_of("doc_id", 4) != 2).where("score >= 0.7")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in want.collect()}


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, odd, empty, operator):
    label = "quality" if operator is quality else "toxic"
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 1), (5, 0, 0), (5, 1, 0), (6, 0, 1), (7, None, None), (8, 0, 0), (None, 1, 1)], NO_LABELS)
    scored = operator.score_documents(odd, labels, label, F.lit(True))
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1 or isnan(score)").isEmpty()
    assert operator.score_documents(empty, labels, label, F.lit(True)).count() == 0
    none = operator.score_documents(odd, labels.limit(0), label, F.lit(True)).select((F.col("score") >= 0.7).alias("p")).distinct().collect()
    assert [r["p"] for r in none] == [operator is quality]
    if operator is quality:
        kept = quality.at_least(odd, labels.limit(0), label, F.lit(True), 0.7)
    else:
        kept = toxicity.below(odd, labels.limit(0), label, F.lit(True), 0.7)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def measured_by_hand(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    size, n = len(text or ""), len(words)

    def share(test):
        return sum(map(test, text or "")) / (size + 1)

    return {
        "log_size": math.log(1 + size), "log_words": math.log(1 + n), "upper_share": share(lambda c: unicodedata.category(c) == "Lu"), "letter_share": share(lambda c: unicodedata.category(c)[0] == "L"),
        "digit_share": share("0123456789".__contains__), "mark_share": share("*&%$#!".__contains__), "bar_share": share("|".__contains__), "stop_share": share(".,;:?".__contains__), "line_share": share("\n".__contains__),
        "word_length": sum(map(len, words)) / (n + 1), "repeat_share": sum(a == b for a, b in zip(words, words[1:])) / (n + 1), "distinct_share": len(set(words)) / (n + 1),
    }


def test_statistics_and_compiled_rules_by_hand(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    ensemble = quality.learn(docs, labels, "quality", fold_of("doc_id", 4) != 2)
    assert len(ensemble.rules) > 3
    texts = docs.unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(-1, " " * 1_000_000), (-2, "A\n" * 500_000), (-3, "b" * 1_000_000)], docs.schema))
    rows = quality.statistics(texts.withColumn("whole", F.col("text")), "whole").select(F.col("whole").alias("text"), *quality.NAMES, ensemble.column().alias("score")).toPandas()
    want = [measured_by_hand(t) for t in rows["text"]]
    for name in quality.NAMES:
        assert np.allclose(rows[name], [w[name] for w in want], rtol=0, atol=1e-9), name
    x = rows[quality.NAMES].to_numpy(float)
    total = ensemble.bias + sum(w * quality.holds(rule, x) for rule, w in ensemble.rules)
    assert np.allclose(rows["score"], 1 / (1 + np.exp(-total)), atol=1e-12)


def test_toxicity_of_every_text_by_hand(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    visible = fold_of("doc_id", 3) != 1
    model = toxicity.learn(docs, labels, "toxic", visible)

    def by_hand(text):
        words, last = [], None
        for run in (text or "").lower().split():
            word = run.strip(toxicity.EDGES)
            if run != last and word:
                whole = "<" + word + ">"
                grams = {whole} | {whole[i : i + n] for n in (3, 4, 5) for i in range(len(whole) - n + 1)}
                words.append(np.mean([model.rows[zlib.crc32(g.encode("utf-8", "replace")) % toxicity.BUCKETS] for g in grams]))
            last = run
        windows = [sum(words[i : i + toxicity.WINDOW]) for i in range(max(1, len(words) - toxicity.WINDOW + 1))]
        return 1 / (1 + math.exp(-(model.bias + max(windows) / toxicity.WINDOW)))

    texts = docs.where("doc_id % 5 = 0").unionByName(odd.select("doc_id", "text")).collect()
    texts = [r["text"] for r in texts] + [" " * 1_000_000, "\n" * 1_000_000, "b" * 100_000, "ab " * 300_000]
    assert np.allclose(toxicity.Scorer(model).scores(texts), [by_hand(t) for t in texts], atol=1e-9)

    scored = toxicity.score_documents(docs, labels, "toxic", visible).toPandas().set_index("doc_id")["score"]
    shown = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 7 = 0").collect()}
    assert np.allclose([scored[i] for i in shown], [by_hand(t) for t in shown.values()], atol=1e-9)
    held = labels.where(fold_of("doc_id", 3) == 1).toPandas().set_index("doc_id")["toxic"].dropna()
    said = scored[held.index] >= 0.7
    assert (said & (held == 0)).sum() == 0 and (said & (held == 1)).sum() >= 0.4 * (held == 1).sum()
