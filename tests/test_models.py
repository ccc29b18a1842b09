import numpy as np
import pytest

from linkloom.operators import checks, metrics, models, ranks
from linkloom.sources.files import ContractError


def by_hand(z, y, c):
    """Newton steps on the whole matrix, standardised columns."""
    w = np.zeros(z.shape[1] + 1)
    z1, ridge = np.c_[z, np.ones(len(z))], np.r_[np.full(z.shape[1], 1 / c), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1 @ w))
        w -= np.linalg.solve((z1 * (p * (1 - p))[:, None]).T @ z1 + np.diag(ridge), z1.T @ (p - y) + ridge * w)
    return w


def test_training_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 400
    a, b = rng.exponential(5, n), rng.normal(0, 2, n)
    y = (0.6 * b + 0.5 * np.log1p(a) + rng.normal(0, 1, n) > 0.8).astype(int)
    a_null = [None if i % 37 == 0 else float(v) for i, v in enumerate(a)]
    rows = spark.createDataFrame([(i, a_null[i], float(b[i]), 1.0, int(i == 5), int(y[i]), i % 5) for i in range(n)], "id int, a double, b double, same double, rare int, label int, fold int")
    (model, means, dropped), (single, _, _) = models.train(rows, {"both": ["a", "b", "same", "rare"], "one": ["b"]}, ["a"], "label", "fold")
    assert dropped == {"same": "zero variance", "rare": "rare flag"} and model.features == ("a", "b") and single.features == ("b",)
    known = np.array([v for v in a_null if v is not None])
    x = np.c_[np.log1p([np.median(known) if v is None else v for v in a_null]), b]
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose([*model.weights, model.intercept], by_hand(z, y, model.strength), atol=1e-6)

    def f1(c):
        out = []
        for k in range(5):
            own, rest = np.arange(n) % 5 == k, np.arange(n) % 5 != k
            mean, std = x[rest].mean(0), x[rest].std(0)
            w = by_hand((x[rest] - mean) / std, y[rest], c)
            said = ((x[own] - mean) / std) @ w[:-1] + w[-1] >= 0
            out.append(2 * (said & (y[own] == 1)).sum() / (said.sum() + y[own].sum()))
        return np.mean(out)

    assert np.allclose([means[c] for c in models.GRID], [f1(c) for c in models.GRID])
    assert model.strength == max(models.GRID, key=lambda c: (round(f1(c), 4), -c))
    score = np.array([r["s"] for r in rows.orderBy("id").select(model.score().alias("s")).collect()])
    assert np.allclose(score, 1 / (1 + np.exp(-(z @ np.array(model.weights) + model.intercept))), atol=1e-9)

    digest = models.lock(spark, model, f"{tmp_path}/m")
    assert models.load(spark, f"{tmp_path}/m", digest) == model
    with pytest.raises(ContractError):
        models.load(spark, f"{tmp_path}/m", "0" * 64)
    with pytest.raises(ContractError):
        models.train(rows.where("fold = 0"), {"one": ["b"]}, [], "label", "fold")
    with pytest.raises(ContractError):
        models.train(rows, {"none": ["same"]}, [], "label", "fold")


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(1)
    values = [(None if i % 3 == 0 else str(i % 2), float(v)) for i, v in enumerate(rng.integers(0, 200, 900) / 7)] + [("x", 4.0), ("1", None)]
    rows = spark.createDataFrame(values, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.quantiles(rows, ["g"], "v", {"a": 0.5, "b": 0.25, "c": 1.0}).collect()}
    for g in (None, "0", "1", "x"):
        own = [v for h, v in values if h == g and v is not None]
        assert np.allclose(got[g], np.quantile(own, [0.5, 0.25, 1.0]))
    assert ranks.quantiles(rows.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
    assert ranks.quantiles(rows.limit(0), [], "v", {"a": 0.5}).first()["a"] is None


def test_rank_correlations_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 9)), float(rng.normal()), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {(r["a"], r["b"]): r["spearman"] for r in ranks.rank_correlations(df, "id", ["a", "b", "c"]).collect()}
    assert got["a", "c"] is None and got["b", "c"] is None
    assert got["a", "b"] == pytest.approx(metrics.spearman(df, "a", "b").first()["spearman"])


def test_paired_differences_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 40), int(rng.integers(0, 2)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "unit int, label int, a int, b int")
    got = {r["metric"]: r for r in metrics.bootstrap_differences(df, "unit", "label", "a", "b", 200, 7).collect()}
    times = {}
    for r in metrics.resampled(df.select("unit").distinct(), "unit", 200, 7).collect():
        times.setdefault(r["draw"], {})[r["unit"]] = r["times"]

    def gap(weight):
        def recall(p):
            tp = sum(weight(u) for u, y, *x in rows if y == 1 and x[p] == 1)
            return tp / max(1, sum(weight(u) for u, y, *_ in rows if y == 1))
        return recall(0) - recall(1)

    drawn = [gap(lambda u, t=t: t.get(u, 0)) for t in times.values()]
    assert got["recall"]["point"] == pytest.approx(gap(lambda u: 1))
    assert [got["recall"]["ci95_low"], got["recall"]["ci95_high"]] == pytest.approx(np.quantile(drawn, [0.025, 0.975]).tolist())


def test_sums_of_resamples(spark, monkeypatch):
    """Draws are dealt to many tasks by stretches of slots, and small ranges of units give the sums of the resamples; the unit without name is one of them, as in the SQL of bootstrap_ci."""
    monkeypatch.setattr(metrics, "SLOTS", 16)
    monkeypatch.setattr(metrics, "PART", 8)
    units = spark.createDataFrame([(None if i == 3 else i, i, i * i) for i in range(50)], "unit int, x long, y long").coalesce(1)
    drawn = metrics.resampled(units.select("unit"), "unit", 300, 7)
    assert metrics._stretches(units, 300, 50).rdd.getNumPartitions() > 8 and metrics._stretches(units, 300, 50).count() == 1200
    want: dict = {}
    for r in drawn.collect():
        u = 3 if r["unit"] is None else r["unit"]
        x, y = want.get(r["draw"], (0, 0))
        want[r["draw"]] = (x + r["times"] * u, y + r["times"] * u**2)
    assert {r["draw"]: (r["x"], r["y"]) for r in metrics.resampled_sums(units, "unit", ["x", "y"], 300, 7).collect()} == want and len(want) == 300
    assert metrics.resampled_sums(units.limit(0), "unit", ["x"], 300, 7).count() == 0


def test_joins_that_have_to_be_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    assert checks.one_to_one(a, b.limit(1), ["k"]).count() == 1
    assert checks.one_to_many(a, b, ["k"]).count() == 2
    with pytest.raises(ContractError):
        checks.one_to_one(a, b, ["k"])
    with pytest.raises(ContractError):
        checks.one_to_many(b, a, ["k"])
