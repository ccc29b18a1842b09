import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import errors, explain, ranks
from linkloom.plans import catalog, training

GROUP = {f: g for g, fs in urls.GROUPS.items() for f in fs}


def shown(feature, raw):
    """Values as Python's own formatting shows them."""
    return {
        "characters": lambda: f"{raw:.0f} character" + ("" if round(raw) == 1 else "s"), "number": lambda: f"{raw:.0f}", "percent": lambda: f"{100 * raw:.0f}%", "bits": lambda: f"{raw:.2f} bits/char", "yes or no": lambda: "yes" if raw >= 0.5 else "no",
    }[explain.LABELS[feature][1]]()


def by_hand(url, raw, z, weights):
    contribution = {f: z[f] * w for f, w in weights.items()}
    total = {}
    for f, c in contribution.items():
        total[GROUP[f]] = total.get(GROUP[f], 0.0) + c
    items = []
    if abs(total["Keywords"]) >= 0.05:
        words = [t for t in urls.TOKENS if t in url.lower()]
        first = "Watch-list words found in the URL text: " + ", ".join(f"'{w}'" for w in words) if words else "No watch-list words found in the URL text"
        items.append((total["Keywords"], "keywords", f"{first}. Together, the keyword features {'raise' if total['Keywords'] > 0 else 'lower'} the risk score."))
    for f, c in contribution.items():
        g = GROUP[f]
        if g != "Keywords" and abs(c) >= 0.05 and abs(total[g]) >= 0.05 and (c > 0) == (total[g] > 0):
            side = "." if f.startswith("url_has_") else f" ({'above' if z[f] > 0 else 'below'} the training average)."
            items.append((c, f, f"{explain.LABELS[f][0]}: {shown(f, raw[f])}{side} This {'raises' if c > 0 else 'lowers'} the risk score."))
    items.sort(key=lambda i: (-abs(round(i[0], 9)), i[1]))
    return [t for c, _, t in items if c > 0][:3], [t for c, _, t in items if c < 0][:3]


def test_sentences(spark):
    texts = ["http://login.shop.test/verify?id=1", "https://a.test/", "http://1.2.3.4:99/%41//x-y-z/12345?q=1&r=2", "http://xn--b.test/" + "a1" * 40, "https://www.museum.test/halls/wing", "http://q.test/?=&=&="]
    rows = urls.with_features(urls.with_parts(spark.createDataFrame(list(enumerate(texts)), "page_id int, url string")))
    weights = catalog._WEIGHTS
    parts = explain.with_parts(rows, explain.fitted_scaling(rows, list(weights), urls.LOGGED), weights, urls.LOGGED)
    got = explain.explained(explain.scored(parts, -0.2)).orderBy("page_id").collect()
    raw = rows.orderBy("page_id").toPandas()
    values = {f: np.log1p(raw[f].astype(float)) if f in urls.LOGGED else raw[f].astype(float) for f in weights}
    for k, (url, r) in enumerate(zip(texts, got, strict=True)):
        z = {f: (v[k] - v.mean()) / (v.std(ddof=0) if round(v.std(ddof=0), 12) else 1.0) for f, v in values.items()}
        logit = -0.2 + sum(z[f] * w for f, w in weights.items())
        assert r["logit"] == pytest.approx(logit) and r["score"] == pytest.approx(1 / (1 + math.exp(-logit)))
        assert r["recommendation"] == explain.RECOMMENDATIONS[r["band"]]
        assert (r["raising"], r["lowering"]) == by_hand(url, {f: float(raw[f][k]) for f in weights}, z, weights)
    totals = explain.group_totals(parts, "page_id").groupBy("page_id").agg(F.sum("total").alias("t")).orderBy("page_id").collect()
    assert [t["t"] - 0.2 for t in totals] == pytest.approx([r["logit"] for r in got])


@pytest.mark.parametrize(("feature", "raw"), [("url_length", 1.0), ("url_length", 0.0), ("url_digit_ratio", 0.125), ("url_digit_ratio", 0.135), ("url_entropy", 3.14159), ("url_entropy", 0.0), ("url_has_https", 1.0), ("url_dot_count", 12.0)])
def test_shown_values(spark, feature, raw):
    part = F.struct(F.lit(feature).alias("feature"), F.lit(raw).alias("raw"), F.lit(1.0).alias("z"), F.lit(1.0).alias("contribution"))
    assert spark.range(1).select(explain.sentence(part)).first()[0].startswith(f"{explain.LABELS[feature][0]}: {shown(feature, raw)}")


def test_no_row_meets_another(spark, sf):
    rows = catalog.page_parts(spark, sf)
    for df in (explain.scored(rows, 0.0), explain.factors(rows, "page_id"), explain.group_totals(rows, "page_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_missing_values_take_the_median(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 4.0), (3, 5.0, 9.0), (4, 9.0, 9.0)], "id int, url_length double, url_entropy double")
    scaling = explain.fitted_scaling(rows, ["url_length", "url_entropy"], [])
    got = scaling.first()
    assert got["url_length__median"] == 5.0 and got["url_entropy__median"] is None and got["url_length__mean"] == 5.0
    parts = explain.with_parts(rows, scaling, {"url_length": 1.0}, []).where("id = 2").first()["parts"]
    assert (parts[0]["raw"], parts[0]["z"]) == (5.0, 0.0)


def test_worksheets(spark):
    rows = spark.createDataFrame([(i, i % 2, 1 - i % 2, i / 10, "c") for i in range(8)] + [(9, 1, 1, 0.9, "right")], "id int, y int, p int, s double, note string")
    sheet = errors.worksheet(rows, "y", "p", "s", ["id"], ["note"], 2)
    assert sheet.columns == ["id", "error_type", "true_label", "prediction", "risk_score", "note", "your_category", "evidence_note"]
    assert {(r["id"], r["error_type"]) for r in sheet.collect()} == {(6, "false positive"), (4, "false positive"), (1, "false negative"), (3, "false negative")}
    assert errors.worksheet(rows, "y", "p", "s", ["id"], []).count() == 8
    with pytest.raises(errors.WorksheetError, match="4 rows lack a category and 4 lack a note"):
        errors.summarised(sheet)
    filled = sheet.withColumns({"your_category": F.concat(F.lit(" Kind "), (F.col("id") % 3).cast("string")), "evidence_note": F.lit("seen")})
    assert {tuple(r) for r in errors.summarised(filled).collect()} == {("false positive", "kind 0", 1), ("false positive", "kind 1", 1), ("false negative", "kind 1", 1), ("false negative", "kind 0", 1)}
    with pytest.raises(errors.WorksheetError, match="more than 1 categories"):
        errors.summarised(filled, most=1)
    assert errors.summarised(filled.limit(0)).count() == 0


def test_rank_correlations_of_looked_up_and_joined_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    data = [(i, float(a), None if i % 7 == 0 else float(round(b)), float(a + b > 0), float(c), 3.0, None) for i, (a, b, c) in enumerate(x)]
    names = ["a", "b", "flag", "c", "same", "none"]
    rows = spark.createDataFrame(data, "id int, " + ", ".join(f"{n} double" for n in names))

    def rank(v):
        return np.array([np.nan if np.isnan(t) else np.nansum(v < t) + (np.nansum(v == t) + 1) / 2 for t in v])

    ranked = {n: rank(np.array([np.nan if r[k + 1] is None else r[k + 1] for r in data])) for k, n in enumerate(names)}
    for few in (10_000, 5):
        got = {(r["a"], r["b"]): (r["n"], r["spearman"]) for r in ranks.rank_correlations(rows, "id", names, few).collect()}
        assert len(got) == 15
        for (p, q), (n, rho) in got.items():
            both = ~np.isnan(ranked[p]) & ~np.isnan(ranked[q])
            assert n == both.sum()
            if "same" in (p, q) or "none" in (p, q):
                assert rho is None
            else:
                assert rho == pytest.approx(np.corrcoef(ranked[p][both], ranked[q][both])[0, 1])
    assert ranks.rank_correlations(rows.limit(0), "id", names).count() == 0


def test_models_are_trained_once(spark, sf, monkeypatch):
    first = training.c_selection(spark, sf).collect()
    monkeypatch.setattr(training.models, "train", lambda *a: pytest.fail("trained again"))
    assert training.c_selection(spark, sf).collect() == first
    explained = training.model_explanations(spark, sf).collect()
    rows, fits, _, _ = training.trained(spark, sf)
    (model,) = (m for m in fits if m.name == "E1_url_only")
    scores = {r["page_id"]: r["s"] for r in rows.where("split = 'test'").select("page_id", model.score().alias("s")).collect()}
    assert {r["page_id"]: r["score"] for r in explained} == pytest.approx(scores, abs=1e-6)
