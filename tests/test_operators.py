import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.operators import checks, clean, explain, groups, images, metrics
from linkloom.plans import catalog
from linkloom.sources import files


def test_clean_verdicts(spark):
    rows = [(0, "http://a.com/", 0), (1, "http://a.com/", 1), (2, "http://b.com/", 0), (3, " http://b.com/ ", 0), (4, "HTTP://B.com", 0), (5, "", 0), (6, "http://c.com/x y", 1), (7, "http://d.com/" + "x" * 2000, 1), (8, None, 0)]
    got = clean.judged(spark.createDataFrame(rows, "row_id long, url string, label int")).orderBy("row_id").select("verdict").collect()
    assert [r["verdict"] for r in got] == ["conflicting_label", "conflicting_label", "kept", "exact_duplicate", "canonical_duplicate", "empty_or_whitespace", "empty_or_whitespace", "over_2000_chars", "empty_or_whitespace"]


def test_cap_and_balance(spark):
    rows = spark.range(30).select(F.col("id"), F.lit("one").alias("host"), (F.col("id") % 2).alias("label"))
    assert clean.capped(rows, "host", 5, 42, "id").count() == 5
    assert clean.balanced(rows, 10, 42, "id").groupBy("label").count().select("count").distinct().collect()[0][0] == 10
    with pytest.raises(ValueError):
        clean.balanced(rows, 16, 42, "id")


def test_confusion_and_empty_denominators(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    got = metrics.confusion(rows, "y", "p").first()
    assert (got["tp"], got["fn"], got["fp"], got["tn"], got["f1"]) == (1, 1, 1, 1, 0.5)
    assert metrics.confusion(rows.where("y = 0 and p = 0"), "y", "p").first()["precision"] == 0


def test_threshold_rules(spark):
    low = spark.createDataFrame([(1, 0.1), (1, 0.9), (0, 0.8), (0, 0.85)], "y int, p double")
    assert metrics.choose_threshold(metrics.sweep(low, "y", "p")).first()["rule"].startswith("fallback")
    good = spark.createDataFrame([(1, 0.7), (1, 0.9), (0, 0.2), (0, 0.3)], "y int, p double")
    got = metrics.choose_threshold(metrics.sweep(good, "y", "p")).first()
    assert (got["rule"], got["threshold"]) == ("target met", 0.7)


def test_auc_and_spearman_with_ties(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 300), rng.integers(0, 2, 300)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x int, y int")
    pos, neg = x[y == 1], x[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.auc(rows, "y", "x").first()["auc"] == pytest.approx(want)

    def rank(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert metrics.spearman(rows, "x", "y").first()["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_wilson_edges(spark):
    got = metrics.with_rate(spark.createDataFrame([(150, 150), (0, 0)], "k long, n long"), "k", "n", "r").orderBy("k").collect()
    assert got[0]["r_ci_low"] is None
    assert got[1]["r_ci_high"] == 1.0 and 0.97 < got[1]["r_ci_low"] < 1


def test_mcnemar_and_holm(spark):
    pairs = [(k, True, False) for k in (1, 2) for _ in range(8)] + [(2, False, True)] * 8 + [(3, True, True)]
    tests = metrics.mcnemar(spark.createDataFrame(pairs, "k int, a_right boolean, b_right boolean"), "k")
    p = {r["k"]: r["p_exact"] for r in tests.collect()}
    assert p[1] == pytest.approx(2 / 256) and p[2] == 1.0 and p[3] == 1.0
    adjusted = [r["p_holm"] for r in metrics.holm(tests, "p_exact", "k").orderBy("p_exact", "k").collect()]
    assert adjusted == sorted(adjusted) and adjusted[0] == pytest.approx(6 / 256)


def test_mcnemar_of_many_pairs(spark):
    """Against exact integers; two billion pairs would need an array of a billion terms if each had one."""
    counts = [(0, 5), (1, 1), (3, 40), (15, 16), (16, 17), (17, 60), (480, 520), (5000, 5200), (49000, 50000)]
    pairs = [(i, x, not x, n) for i, c in enumerate(counts) for x, n in zip((True, False), c, strict=True)]
    rows = spark.createDataFrame(pairs, "k int, a_right boolean, b_right boolean, n long").withColumn("n", F.explode(F.expr("array_repeat(0, int(n))")))
    got = {r["k"]: r["p_exact"] for r in metrics.mcnemar(rows, "k").collect()}
    for i, (b, c) in enumerate(counts):
        term, total = 1, 0
        for j in range(min(b, c) + 1):
            total += term
            term = term * (b + c - j) // (j + 1)
        assert got[i] == pytest.approx(min(1.0, float(Fraction(2 * total, 2 ** (b + c)))), rel=1e-9), (b, c)
    large = spark.createDataFrame([(10**9, 10**9 + 60000)], "a_right_b_wrong long, a_wrong_b_right long")
    z = (60000 - 1) / math.sqrt(2 * 10**9 + 60000)
    assert metrics.with_mcnemar_p(large).first()["p_exact"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_whole_mcnemar_counts_every_line(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.month("l_shipdate").alias("m"), "l_quantity", "l_discount").toPandas()
    a, b = lines["l_quantity"] > 25, lines["l_discount"] > 0.05
    want = {m: (int((a & ~b)[own].sum()), int((~a & b)[own].sum())) for m, own in lines.groupby("m").groups.items()}
    got = catalog.mcnemar_exact_whole(spark, sf).collect()
    assert {r["l_shipmonth"]: (r["a_right_b_wrong"], r["a_wrong_b_right"]) for r in got} == want
    p = {m: min(1.0, 2 * sum(math.comb(x + y, i) for i in range(min(x, y) + 1)) / 2 ** (x + y)) for m, (x, y) in want.items()}
    assert all(r["p_exact"] == pytest.approx(p[r["l_shipmonth"]], abs=1e-6) for r in got)
    least = 0.0
    adjusted = {r["l_shipmonth"]: r["p_holm"] for r in catalog.holm_adjust_whole(spark, sf).collect()}
    for k, m in enumerate(sorted(p, key=p.get)):
        least = max(least, min(1.0, (len(p) - k) * p[m]))
        assert adjusted[m] == pytest.approx(least, abs=2e-5)


def test_whole_bootstrap_by_hand(spark, sf):
    """Two thousand resamples of the sources, rows repeated as often as drawn."""
    rows = catalog.judged_lengths(spark, sf).select("source", "n_chars", "quality", "predicted").toPandas()

    def md5(*parts):
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

    units = sorted(rows["source"].unique(), key=lambda u: (md5(42, u), u))
    parts = [rows[rows["source"] == u].to_numpy()[:, 1:].astype(float) for u in units]
    found = {"precision": [], "recall": [], "f1": [], "roc_auc": []}
    for draw in range(2000):
        x, y, p = np.concatenate([parts[int(md5(42, draw, at)[:8], 16) % len(units)] for at in range(len(units))]).T
        tp, fp, fn = ((y == 1) & (p == 1)).sum(), ((y == 0) & (p == 1)).sum(), ((y == 1) & (p == 0)).sum()
        for name, k, n in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("f1", 2 * tp, 2 * tp + fp + fn)):
            found[name].append(k / n if n else 0.0)
        above = x[y == 1][:, None] - x[y == 0]
        if above.size:
            found["roc_auc"].append(((above > 0).sum() + (above == 0).sum() / 2) / above.size)
    got = {r["metric"]: (r["draws"], r["ci95_low"], r["ci95_high"]) for r in catalog.bootstrap_ci_whole(spark, sf).collect()}
    assert got.keys() == found.keys()
    for name, values in found.items():
        assert got[name] == pytest.approx((len(values), *np.percentile(values, [2.5, 97.5])), abs=2e-6), name


def test_matched_classes_are_equal(spark):
    rows = spark.range(400).select("id", (F.col("id") % 97).alias("n"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = {(r["bin"], r["label"]): r["count"] for r in metrics.matched(rows, "n", "label", "id", 42).groupBy("bin", "label").count().collect()}
    assert got and all(got[b, 0] == got[b, 1] for b, _ in got)


def test_split_groups_and_candidates(spark):
    rows = [(k, k // 2, 100 if k in (0, 5, 9) else 1000 + k, k % 2) for k in range(12)] + [(100 + k, 100 + k, 7, k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "key long, domain long, template long, label int")
    got = {r["key"]: r["group_id"] for r in groups.split_groups(df, "key", "domain", "template").collect()}
    assert {got[k] for k in (0, 1, 4, 5, 8, 9)} == {0} and got[2] == 2 and len({got[100 + k] for k in range(40)}) == 40
    per = spark.createDataFrame([(i, 1, 1) for i in range(100)], "group_id long, zeros long, ones long")
    tried = groups.greedy_candidates(per, 3, 42, 200)
    sizes = {(r["candidate"], r["split"]): r["count"] for r in tried.groupBy("candidate", "split").count().collect()}
    assert sizes[0, "test"] == 15 and sizes[0, "val"] == 15 and sizes[0, "train"] == 70
    assert groups.best_candidate(groups.score_candidates(tried)).first()["candidate"] == 0
    assert [r["name"] for r in groups.numbered_groups(per).orderBy("group_id").limit(2).collect()] == ["G00000", "G00001"]


def folded(per, candidate, total):
    """(group_id -> split) of one candidate, by hand."""
    filled, out = {"test": [0, 0], "val": [0, 0]}, {}
    for _, g, z, o in sorted((hashlib.md5(f"42|{candidate}|{g}".encode()).hexdigest(), g, z, o) for g, z, o in per):
        out[g] = next((s for s, f in filled.items() if f[0] + z <= 0.075 * total and f[1] + o <= 0.075 * total), "train")
        if out[g] != "train":
            filled[out[g]][0] += z
            filled[out[g]][1] += o
    return out


@pytest.mark.parametrize("least", [0, 3])
def test_candidates_in_ranges(spark, least):
    """Ranges of a few groups give what one fold of all gives; with groups of 3 and more, splits stay open to the end."""
    rng = np.random.default_rng(least)
    per = [(i, int(z) + least, int(o) + least) for i, (z, o) in enumerate(rng.integers(0, 4, (150, 2))) if z + o]
    total = sum(z + o for _, z, o in per)
    df = spark.createDataFrame(per, "group_id long, zeros long, ones long")
    tried = groups.greedy_candidates(df, [0, 3], 42, total, most=20)
    got = {}
    for r in tried.collect():
        assert got.setdefault(r["candidate"], {}).setdefault(r["group_id"], r["split"]) == r["split"]
    assert got == {c: folded(per, c, total) for c in (0, 3)} and tried.count() == 2 * len(per)
    scores = {r["candidate"]: r["score"] for r in groups.searched_candidates(df, 8, 42, most=20).collect()}
    want = {r["candidate"]: r["score"] for r in groups.score_candidates(groups.greedy_candidates(df, 8, 42, total)).collect()}
    assert scores == pytest.approx(want) and len(scores) == 8


def test_search_is_dealt_over_tasks(spark, monkeypatch):
    """A table of one file is hashed by many tasks; a split that stays open to the end takes few rounds, and the splits are those of one fold."""
    per = [(i - 40, 4, 2) if i % 30 else (i - 40, 0, 1) for i in range(160)]
    df = spark.createDataFrame(per, "group_id long, zeros long, ones long").coalesce(1)
    monkeypatch.setattr(groups, "TRIES", 1000)
    assert groups._dealt(df, 500, len(per)).rdd.getNumPartitions() == 80
    rounds = []
    real = groups._asked
    monkeypatch.setattr(groups, "_asked", lambda dealt, asked, *a: rounds.append(asked) or real(dealt, asked, *a))
    got = {(r["candidate"], r["group_id"]): r["split"] for r in groups.greedy_candidates(df, [0, 7], 42, sum(z + o for _, z, o in per), most=2).collect()}
    assert got == {(c, g): s for c in (0, 7) for g, s in folded(per, c, sum(z + o for _, z, o in per)).items()}
    assert len(rounds) <= 20 and len(rounds) < sum(e - f for a in rounds for c, (f, e) in a.items() if c == 0)


def test_best_split_of_all_candidates(spark, sf):
    scores = catalog.split_candidates(spark, sf).collect()
    assert sorted(r["candidate"] for r in scores) == list(range(500))
    (chosen,) = [r["candidate"] for r in scores if r["chosen"]]
    assert chosen == min((r["score"], r["candidate"]) for r in scores)[1]
    per = [(r["group_id"], r["zeros"], r["ones"]) for r in catalog.customer_groups(spark, sf).collect()]
    best = catalog.best_split(spark, sf).collect()
    assert {r["candidate"] for r in best} == {chosen} and len(best) == len(per)
    assert {r["group_id"]: r["split"] for r in best} == folded(per, chosen, sum(z + o for _, z, o in per))


def test_contributions_add_up(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(50)], "id long, url_length double, url_entropy double")
    weights = {"url_length": 0.5, "url_entropy": -1.0}
    scaling = explain.fitted_scaling(rows, list(weights), ["url_length"])
    parts = explain.with_parts(rows, scaling, weights, ["url_length"])
    a = np.log1p(np.arange(50) % 7)
    b = np.arange(50) % 3
    want = 0.5 * (a - a.mean()) / a.std() - (b - b.mean()) / b.std() + 0.1
    got = explain.scored(parts, 0.1).select("id", "logit", "score").orderBy("id").toPandas()
    assert np.allclose(got["logit"], want) and np.allclose(got["score"], 1 / (1 + np.exp(-want)))


def test_table_diff_and_digest(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k int, v double, s string")
    assert {r["status"] for r in checks.table_diff(a, a, ["k"], 0.0).collect()} == {"PASS"}
    b = spark.createDataFrame([(1, 1.5, "x"), (2, 2.0, "z")], "k int, v double, s string")
    assert {r["column_name"]: r["status"] for r in checks.table_diff(a, b, ["k"], 0.1).collect()} == {"v": "FAIL", "s": "FAIL"}
    assert checks.digest(a, "k").first() == checks.digest(a.orderBy(F.desc("k")), "k").first()
    assert {r["status"] for r in checks.report([checks.unique("u", a, "k"), checks.not_shared("n", a, "s", "k")]).collect()} == {"PASS"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,type\n"http://a.com/,x",Benign\nhttp://b.com,phishing\n')
    got = files.read_labelled(spark, str(tmp_path / "a.csv"), "url", "type", {"benign": 0, "phishing": 1}, "s").orderBy("url").collect()
    assert [(r["url"], r["label"]) for r in got] == [("http://a.com/,x", 0), ("http://b.com", 1)]
    with pytest.raises(files.ContractError):
        files.read_labelled(spark, str(tmp_path / "a.csv"), "url", "type", {"benign": 0}, "s")
    with pytest.raises(files.ContractError):
        files.read_labelled(spark, str(tmp_path / "a.csv"), "link", "type", {"benign": 0}, "s")
    (tmp_path / "b.csv").write_text("a,b\n,NA\n")
    assert tuple(files.read_csv(spark, str(tmp_path / "b.csv"), "a string, b string", "keep").first()) == ("", "NA")
    assert tuple(files.read_csv(spark, str(tmp_path / "b.csv"), "a string, b string").first()) == (None, "NA")
    files.write_once(spark.range(3), str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        files.write_once(spark.range(3), str(tmp_path / "once"))


def test_images():
    x = np.full((300, 300), 255, np.uint8)
    assert images.statistics(x)["qr_dark_ratio"] == 0 and np.isnan(images.statistics(x)["qr_quiet_zone_ratio"])
    x[100:200, 100:200] = 0
    big = np.kron(x, np.ones((2, 2), np.uint8))
    for name, value in images.statistics(x).items():
        if name != "qr_blur_score":
            assert images.statistics(big)[name] == pytest.approx(value, rel=0.02)
    for kernel, value in (("gaussian_blur", 7), ("low_resolution", 0.3), ("rotation", 10.0), ("perspective", 0.1)):
        out = images.KERNELS[kernel](x, value)
        assert out.dtype == np.uint8 and (out == images.KERNELS[kernel](x, value)).all() and 0 < (out < 128).mean() < 0.3
    assert len(images.GRID) == 17


def test_qr_versions(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (14, 15, 2331, 2332)], "t string").select(images.qr_version(F.col("t")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [1, 2, 40, None]


def test_default_missing_values(spark, tmp_path):
    fields = [*files.NA[1:], "na", "text", " NA", "\"\""]
    path = tmp_path / "na.csv"
    path.write_text("a,b,c d\n" + "".join(f"{f},{i if i % 3 else 'NA'},{i / 4 if i % 2 else 'nan'}\n" for i, f in enumerate(fields)))
    got = files.read_csv(spark, str(path), "a string, b bigint, `c d` double", "default").collect()
    want = pd.read_csv(path)
    assert [tuple(r) for r in got] == [tuple(None if pd.isna(v) else v for v in row) for row in want.itertuples(index=False)]
    assert got[0].b is None and got[1].b == 1 and sum(r.a is not None for r in got) == 3


def test_image_statistics_are_counted(spark):
    """Counted grey values and whole Laplacians give what sorting all pixels gives; shares of bright pixels leave their task without the pixels."""
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 256, (37, 700), dtype=np.uint8), np.kron(rng.integers(0, 2, (33, 33)).astype(np.uint8) * 255, np.ones((4, 4), np.uint8))):
        g = np.clip(np.rint(images.area_resized(x.astype(float), 512, 512)), 0, 255)
        p = np.pad(g, 1, mode="reflect")
        low, high = np.percentile(g, [1, 99])
        got = images.statistics(x)
        assert got["qr_contrast"] == pytest.approx((high - low) / 255, abs=1e-12) and got["qr_gray_std"] == pytest.approx(g.std() / 255, abs=1e-12) and got["qr_gray_mean"] == pytest.approx(g.mean() / 255)
        assert got["qr_blur_score"] == pytest.approx((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var(), rel=1e-12) and got["qr_dark_ratio"] == (g < 128).mean()
    drawn = images.patterned(spark.createDataFrame([(i, f"u{i}") for i in range(3)], "id long, url string"), "id", "url", modules=21, scale=3)
    grid = spark.createDataFrame(images.GRID, "type string, severity string, value double")
    want = {(r["id"], r["type"], r["severity"]): (np.frombuffer(r["pixels"], np.uint8) >= 128).mean() for r in images.distorted(drawn, "id", grid).collect()}
    found = images.bright_shares(drawn, "id", images.GRID)
    assert "pixels" not in found.columns and {(r["id"], r["type"], r["severity"]): r["bright"] for r in found.collect()} == pytest.approx(want) and len(want) == 42
