import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import checks, clean, domains, freeze, groups, metrics, ranks, runner, splits
from linkloom.sources import files


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


# ---------------------------------------------------------------- numbering, digests, sampling


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 3, 7).select("id", F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 4).alias("g"))
    want = sorted(md5(i) for i in range(0, 5000, 3))
    assert {r["h"]: r["n"] for r in ranks.numbered(rows, ["h"], "n").collect()} == {h: n for n, h in enumerate(want)}
    got = ranks.numbered_within(rows, ["g"], ["h"], "n").collect()
    for g in range(4):
        own = sorted((md5(i), i) for i in range(0, 5000, 3) if i % 4 == g)
        assert {r["id"]: r["n"] for r in got if r["g"] == g} == {i: n for n, (_, i) in enumerate(own)}
    assert ranks.numbered(rows.limit(0), ["h"], "n").count() == 0


def test_groups_are_numbered_by_first_appearance(spark):
    rows = spark.createDataFrame([(7, 30), (3, 20), (3, 40), (9, 10), (7, 15)], "group_id long, at long")
    assert {r["group_id"]: r["name"] for r in groups.numbered_groups(rows, "at").collect()} == {9: "G00000", 7: "G00001", 3: "G00002"}


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 17, 70])
def test_digest_trees(spark, n):
    level, levels = sorted(str(i) for i in range(n)), 0
    while len(level) > 1 or (n and not levels):
        level = [hashlib.sha256("\n".join(level[k : k + 4]).encode()).hexdigest() for k in range(0, len(level), 4)]
        levels += 1
    got = checks.digest(spark.range(n), "id", block=4).first()
    assert tuple(got) == (n, levels, level[0] if n else hashlib.sha256(b"").hexdigest())


def test_file_manifests(spark, tmp_path):
    for name in ("b.bin", "a.bin"):
        (tmp_path / name).write_bytes(name.encode() * 1000)
    found, root = checks.file_manifest(spark, str(tmp_path))
    want = {n: (5000, hashlib.sha256(n.encode() * 1000).hexdigest()) for n in ("a.bin", "b.bin")}
    assert {r["file"]: (r["n_bytes"], r["sha256"]) for r in found.collect()} == want
    assert root == hashlib.sha256("\n".join(f"{n} 5000 {s}" for n, (_, s) in sorted(want.items())).encode()).hexdigest()
    (tmp_path / "a.bin").write_bytes(b"changed")
    assert checks.file_manifest(spark, str(tmp_path))[1] != root


def test_least_hashes_of_each_group(spark):
    keep = {0: 0, 1: 1, 2: 40, 3: 500}
    rows = spark.range(1000).select("id", (F.col("id") % 4).alias("g")).withColumn("k", F.element_at(F.create_map(*(F.lit(x) for p in keep.items() for x in p)), F.col("g").cast("int")))
    got = clean.least_hashed(rows, ["g"], "k", 42, "id", digits=1)
    assert got.columns == ["g", "id"]
    for g, n in keep.items():
        assert {r["id"] for r in got.where(F.col("g") == g).collect()} == {i for _, i in sorted((md5(42, i), i) for i in range(g, 1000, 4))[:n]}


# ---------------------------------------------------------------- folds and bootstrap


def plain_folds(per, k, seed):
    """The same rule, group by group."""
    held, fold = [[0, 0] for _ in range(k)], {}
    totals = [max(1, sum(g[1 + x] for g in per)) for x in (0, 1)]
    for g, z, o in sorted(per, key=lambda g: (-abs(g[1] - g[2]), -g[1], -g[2], md5(seed, g[0]), g[0])):
        best = None
        for f in range(k):
            after = [[h[0] + z * (i == f), h[1] + o * (i == f)] for i, h in enumerate(held)]
            uneven = round(sum(np.sqrt(k * sum(a[x] ** 2 for a in after) - sum(a[x] for a in after) ** 2) / totals[x] for x in (0, 1)), 12)
            best = min(best or (uneven, sum(held[f]), f), (uneven, sum(held[f]), f))
        fold[g] = best[2]
        held[best[2]][0] += z
        held[best[2]][1] += o
    return fold


def test_stratified_group_folds(spark):
    rng = np.random.default_rng(5)
    per = [(i, int(z), int(o)) for i, (z, o) in enumerate(rng.geometric(0.4, (700, 2)) - 1) if z + o] + [(1000, 60, 0), (1001, 3, 45)]
    df = spark.createDataFrame(per, "group_id long, zeros long, ones long")
    got = {r["group_id"]: r["fold"] for r in groups.stratified_folds(df, 5, 42).collect()}
    assert got == plain_folds(per, 5, 42)
    shares = [[sum(g[1 + x] for g in per if got[g[0]] == f) for f in range(5)] for x in (0, 1)]
    assert all(max(s) - min(s) <= 0.05 * sum(s) for s in shares)
    assert groups.stratified_folds(df.limit(0), 5, 42).count() == 0


def test_turns_of_alike_groups_are_not_counted_one_by_one():
    turns = groups.dealt_classes([(1, 0, 10**12), (0, 1, 10**12 + 3), (2, 7, 11)], 5)
    assert all(len(first) + len(cycle) < 100 for first, cycle in turns.values())


def auc_by_hand(x, y):
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    below = np.searchsorted(x, x[y == 1], "left"), np.searchsorted(x, x[y == 1], "right")
    zeros = np.concatenate([[0], np.cumsum(y == 0)])
    return (zeros[below[0]] + zeros[below[1]]).sum() / 2 / max(1, (y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("digits", [1, 9])
def test_bootstrap_of_rows(spark, digits):
    """Intervals and points of single rows against resampling by hand, with few and with all different scores."""
    rng = np.random.default_rng(digits)
    y = rng.integers(0, 2, 1500)
    x = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.25), 0, 1), digits)
    rows = spark.createDataFrame([(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, x, strict=True)], "y int, x double, p int")
    got = {r["metric"]: r for r in metrics.rows_bootstrap(rows, "y", "p", "x", 2000, 42, cells=256).collect()}
    found = {m: [] for m in ("precision", "recall", "f1", "roc_auc")}
    for draw in [np.arange(1500), *(rng.integers(0, 1500, 1500) for _ in range(2000))]:
        a, b = y[draw], x[draw]
        p = b >= 0.5
        tp, fp, fn = ((a == 1) & p).sum(), ((a == 0) & p).sum(), ((a == 1) & ~p).sum()
        for m, v in (("precision", tp / (tp + fp)), ("recall", tp / (tp + fn)), ("f1", 2 * tp / (2 * tp + fp + fn)), ("roc_auc", auc_by_hand(b, a))):
            found[m].append(v)
    for m, values in found.items():
        assert got[m]["draws"] == 2000 and got[m]["point"] == pytest.approx(values[0], abs=1e-9), m
        assert (got[m]["ci95_low"], got[m]["ci95_high"]) == pytest.approx(tuple(np.percentile(values[1:], [2.5, 97.5])), abs=0.5 * np.std(values)), m  # both sides are random: ends of 2,000 draws move by a tenth of the deviation
    alone = {r["metric"]: r for r in metrics.rows_bootstrap(rows.where("y = 1"), "y", "p", "x", 20, 42).collect()}
    assert alone["roc_auc"]["point"] is None and alone["roc_auc"]["draws"] is None and alone["recall"]["draws"] == 20


# ---------------------------------------------------------------- checks


def test_a_broken_check_is_a_row(spark):
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (2, None)], "k int, v string")
    report = runner.Report(spark)
    report.run("A", "fine", lambda: (True, "all"))
    report.run("A", "raises", lambda: 1 / 0)
    report.run("A", "warns", lambda: ("WARN", "a little"))
    report.run("A", "says", lambda: (None, 3))
    report.none_of("B", "unique", lambda: runner.repeated(rows, "k"))
    report.none_of("B", "no table", lambda: spark.read.parquet("/nowhere"))
    report.none_of("B", "fails while it runs", lambda: rows.where(F.col("v").cast("int") > 0))
    report.each_row("C", lambda: rows, {"null": lambda: F.col("v").isNull(), "negative": lambda: F.col("k") < 0, "no column": lambda: F.col("gone") > 1, "cast": lambda: F.col("v").cast("int") < 0})
    report.each_row("D", lambda: spark.read.parquet("/nowhere"), {"a": lambda: F.col("k") > 0, "b": lambda: F.col("k") > 1})
    got = {r["check_name"]: (r["status"], r["failures"]) for r in report.table().collect()}
    assert got == {
        "fine": ("PASS", None), "raises": ("ERROR", None), "warns": ("WARN", None), "says": ("INFO", None), "unique": ("FAIL", 1), "no table": ("ERROR", None), "fails while it runs": ("ERROR", None),
        "null": ("FAIL", 1), "negative": ("PASS", 0), "no column": ("ERROR", None), "cast": ("ERROR", None), "a": ("ERROR", None), "b": ("ERROR", None),
    }
    assert [r["place"] for r in report.table().orderBy("place").collect()] == list(range(1, 14)) and not report.passed
    assert "ZeroDivisionError" in report.table().where("check_name = 'raises'").first()["detail"]


def test_checks_of_rows_share_a_pass(spark):
    """One action for all of them; accumulated reads count how often a row passes."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(count, "id long")
    report = runner.Report(spark)
    report.each_row("A", lambda: rows, {f"c{i}": (lambda i=i: F.col("id") < i) for i in range(6)})
    assert [r[3] for r in report.rows] == list(range(6)) and seen.value == 100


def test_saved_tables(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'a,"b"', 0.1D, timestamp'2024-01-02 03:04:05.000006', true), (2, 'two\nlines', null, null, null), (3, '', -1e300D, timestamp'1999-12-31 23:59:59', false), (4, null, 0D, null, true) t(k, s, x, t, b)""")
    path = str(tmp_path / "t")
    files.save(rows.coalesce(1), path)
    back, corrupt = files.read_saved(spark, path)
    assert back.dtypes == rows.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) and corrupt.count() == 0
    assert {r["status"] for r in checks.same_as_saved(rows, path, ["k"]).collect()} == {"PASS"}
    (part,) = [p for p in os.listdir(path) if p.endswith(".csv")]
    text = (tmp_path / "t" / part).read_text()
    os.remove(tmp_path / "t" / f".{part}.crc")
    (tmp_path / "t" / part).write_text(text.replace("-1.0E300", "much"))
    got = {r["column_name"]: (r["one_sided"], r["differing"], r["status"]) for r in checks.same_as_saved(rows, path, ["k"]).collect()}
    assert got["_corrupt"] == (0, 1, "FAIL") and got["s"][0] == 1 and got["s"][2] == "FAIL"
    changed = checks.same_as_saved(rows.drop("b"), path, ["k"])
    assert changed.where("column_name = '_columns'").first()["status"] == "FAIL"


def test_tables_with_an_index(spark, tmp_path):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, s string")
    files.write_csv(files.with_index(rows, ["k"]).orderBy("k").coalesce(1), str(tmp_path / "i"))
    back = files.read_csv(spark, str(tmp_path / "i"), f"`{files.INDEX}` long, k int, s string")
    assert sorted(map(tuple, back.collect())) == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")]


# ---------------------------------------------------------------- frozen splits


def test_frozen_once(spark, tmp_path):
    path = str(tmp_path / "frozen")
    rows = spark.createDataFrame([(i, f"v{i}", None) for i in range(50)], "id long, v string, n int")
    staging = freeze.staged(spark, path, {"t": (rows, "id")}, {"a": 1})
    assert not freeze.exists(spark, path)  # a job that dies here has frozen nothing
    freeze.freeze(spark, path, {"t": (rows, "id")}, {"a": 2})
    assert freeze.manifest(spark, path)["facts"] == {"a": 2} and freeze.opened(spark, path)["t"].count() == 50
    for again in (lambda: freeze.publish(spark, staging, path), lambda: freeze.freeze(spark, path, {"t": (rows, "id")}, {})):
        with pytest.raises(freeze.FrozenError):
            again()
    assert freeze.exists(spark, staging) and sorted(p for p in os.listdir(path) if not p.startswith(".")) == ["manifest.json", "t"]
    freeze.asked_for(spark, path, "t", rows.orderBy(F.desc("id")))
    for changed in (rows.where("id > 0"), rows.withColumn("v", F.when(F.col("id") == 3, "x").otherwise(F.col("v"))), rows.withColumn("n", F.when(F.col("id") == 4, 0))):
        with pytest.raises(freeze.FrozenError):
            freeze.asked_for(spark, path, "t", changed)
    rows.where("id > 0").write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(freeze.FrozenError):
        freeze.opened(spark, path, "t")


def test_a_second_writer_does_not_mix_in(spark, tmp_path, monkeypatch):
    """Both found the folder absent; the later rename is undone."""
    path, rows = str(tmp_path / "f"), spark.range(3)
    first, second = (freeze.staged(spark, path, {"t": (rows, "id")}, {"writer": w}) for w in (1, 2))
    freeze.publish(spark, first, path)
    monkeypatch.setattr(freeze, "exists", lambda *_: False)
    with pytest.raises(freeze.FrozenError):
        freeze.publish(spark, second, path)
    assert freeze.manifest(spark, path)["facts"] == {"writer": 1} and sorted(p for p in os.listdir(path) if not p.startswith(".")) == ["manifest.json", "t"]


def test_split_from_urls_to_frozen_tables(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"http://s{i}.d{rng.integers(0, 250)}.co.uk/" + ("kit/login?id=7" if i % 100 == 0 else f"p{i}"), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, label long")
    path = str(tmp_path / "split")
    audit = {r["split"]: r for r in splits.run_split(df, domains.default_rules(spark), path, 42, candidates=30).collect()}
    assert sum(r["n"] for r in audit.values()) == 600 and all(abs(audit[s]["fraction"] - 0.15) <= 0.03 for s in ("test", "val"))
    frozen = freeze.opened(spark, path)
    manifest = frozen["split_manifest"].collect()
    parts = {r["page_id"]: r["split"] for r in manifest}
    assert len({parts[i] for i in range(0, 600, 100)}) == 1  # one template, six domains
    by_domain = {}
    for i, url, _ in rows:
        by_domain.setdefault(url.split("/")[2].split(".", 1)[1], set()).add(parts[i])
    assert all(len(s) == 1 for s in by_domain.values()) and len(by_domain) == sum(r["n_domains"] for r in audit.values())
    report = frozen["template_report"].collect()
    assert {(r["url_template"], r["n_urls"], r["action"]) for r in report} == {("/kit/login?id=<V>", 6, "merged"), ("/p<N>", 495, "reported_generic_not_merged")}
    numbers = sorted({r["split_group_id"] for r in manifest}, key=lambda g: min(r["page_id"] for r in manifest if r["split_group_id"] == g))
    assert numbers == [f"G{n:05d}" for n in range(len(numbers))]
    with pytest.raises(freeze.FrozenError):
        splits.run_split(df, domains.default_rules(spark), path, 42)
    test = df.join(frozen["test_ids"].select("page_id"), "page_id")
    assert splits.gated_test_rows(spark, path, test, {}).count() == audit["test"]["n"]
    with pytest.raises(freeze.FrozenError):
        splits.gated_test_rows(spark, path, test.where(F.col("page_id") != test.first()["page_id"]), {})


def test_a_leak_is_an_error(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"http://d{i}.com/", i % 2) for i in range(40)], "page_id long, url string, label long")
    real = groups.greedy_candidates
    monkeypatch.setattr(splits.groups, "greedy_candidates", lambda *a, **k: (x := real(*a, **k)).unionByName(x.limit(1).withColumn("split", F.lit("val"))).unionByName(x.limit(1).withColumn("split", F.lit("train"))))
    with pytest.raises(splits.LeakError):
        splits.run_split(df, domains.default_rules(spark), str(tmp_path / "leak"), 42, candidates=3)
    assert not freeze.exists(spark, str(tmp_path / "leak"))


def test_copies_of_one_url_and_blank_rows(spark):
    """Verdicts of a thousand copies and a thousand blank rows, first copies by id."""
    rows = [(i, "" if i % 2 else "HTTP://One.example.com" if i % 4 == 0 else "http://one.example.com/", 1) for i in range(2000)]
    got = clean.judged(spark.createDataFrame(rows, "row_id long, url string, label int").repartition(5)).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"empty_or_whitespace": 1000, "kept": 1, "exact_duplicate": 499 + 499, "canonical_duplicate": 1}
    assert urls.MAX_URL == 2000


def test_datasets_of_record(spark):
    rows = [(i, f"http://h{i % 9}.test/{i % 50}", i % 50 % 2) for i in range(100)] + [(200 + i, f"http://h0.test/{i}", 1) for i in range(0, 50, 10)] + [(300, "no url", 0), (301, "", 1)]
    df = spark.createDataFrame(rows, "row_id long, url string, label int")
    found, report = clean.built(df, "host", 4, 6, 42)
    got = found.collect()
    assert sorted(r["sample_id"] for r in got) == [f"Q{n:05d}" for n in range(12)] and sorted(r["label"] for r in got) == [0] * 6 + [1] * 6
    assert max(sum(1 for r in got if r["host"] == h) for h in {r["host"] for r in got}) <= 4
    assert [r["row_id"] for r in sorted(got, key=lambda r: r["sample_id"])] == [i for _, i in sorted((md5(42, r["row_id"]), r["row_id"]) for r in got)]
    assert sum(r["n"] for r in report.collect()) == len(rows)
    with pytest.raises(ValueError, match="fewer than"):
        clean.built(df, "host", 1, 50, 42)


# ---------------------------------------------------------------- readers and writers


def test_json_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\"b", None), (2, "two\nlines", 0.5)], "k int, s string, x double")
    files.write_json(rows, str(tmp_path / "out"))
    back = files.read_json(spark, str(tmp_path / "out")).selectExpr("cast(k as int) as k", "s", "x")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "whole.json").write_text('{"a": {"b": [1,\n 2]},\n "c": null}')
    assert files.read_json(spark, str(tmp_path / "whole.json")).first()["a"]["b"] == [1, 2]
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    assert sorted((r["value"], r["path"].rsplit("/", 1)[-1]) for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()) == [("one", "l.txt"), ("two", "l.txt")]


def test_csv_with_and_without_missing_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a, \"b\""), (2, None), (3, "c\nd")], "k int, s string")
    files.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "k int, s string").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        files.write_csv(rows, str(tmp_path / "c"))


def test_joins_that_have_to_be_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (3, "q")], "k int, b string")
    assert [tuple(r) for r in checks.one_to_one(a, b, ["k"]).collect()] == [(1, "x", "p")]
    for left, right in ((a.unionByName(a), b), (a, b.unionByName(b))):
        with pytest.raises(files.ContractError):
            checks.one_to_one(left, right, ["k"])
