"""Queries that choose, fit, lock and score models of the URL features.

Fixture: pages, labelled by page_id % 2 and split by groups of three rows. The module
count of the QR code that would hold the URL stands for image features. Fits have
no SQL twin; tests compare them with a fit in numpy.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import checks, errors, explain, freeze, groups, images, metrics, models
from linkloom.plans.catalog import SEED, query, r6, table
from linkloom.sources.scratch import folder, stored

QR = ["qr_decoded_modules_per_side"]
#: The models, in their order.
ORDER = ("M1_length_only", "M1_plus_QR", "E1_url_only", "E2_qr_only", "E3_fusion", "E3_reducedQR")
LEAST_RECALL, MOST_FPR, MOST_RHO = 0.9, 0.5, 0.9


def labelled(spark, sf) -> DataFrame:
    """Features, label, group and split of each page; a group is in one split only."""
    rows = urls.with_features(urls.with_parts(table(spark, sf, "pages").select("page_id", "url"))).withColumn("group_id", F.expr("page_id div 3"))
    part = F.pmod(F.crc32(F.col("group_id").cast("string")), F.lit(10))
    split = F.when(part < 6, "train").when(part < 8, "val").otherwise("test")
    side = images.modules_per_side(images.qr_version(F.col("url"))).cast("double")
    return rows.select("page_id", (F.col("page_id") % 2).alias("label"), "group_id", split.alias("split"), *urls.FEATURES, side.alias(QR[0]))


def train_rows(rows: DataFrame) -> DataFrame:
    """The training rows with the fold of their group; folds keep groups whole. An error if one of them is a test row."""
    own = rows.where("split = 'train'")
    per = own.groupBy("group_id").agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
    folds = groups.stratified_folds(per, 5, SEED).select("group_id", "fold")
    out = checks.one_to_many(folds, own, ["group_id"])
    if not out.join(rows.where("split = 'test'").select("group_id").distinct(), "group_id", "left_semi").isEmpty():
        raise checks.ContractError("a group of the training rows is in the test split")
    return out


def specs(train: DataFrame) -> dict[str, list[str]]:
    """Feature lists by model; the reduced one leaves out what follows the URL length in the training rows."""
    rho = {f: metrics.spearman(train, "url_length", f).first()["spearman"] for f in QR}
    reduced = [f for f in QR if rho[f] is not None and rho[f] == rho[f] and abs(rho[f]) <= MOST_RHO]
    return {
        "M1_length_only": ["url_length"], "M1_plus_QR": ["url_length", *QR], "E1_url_only": urls.FEATURES,
        "E2_qr_only": QR, "E3_fusion": [*urls.FEATURES, *QR], "E3_reducedQR": [*urls.FEATURES, *reduced],
    }


def trained(spark, sf) -> tuple[DataFrame, list[models.Model], dict[str, dict[float, float]], dict[str, dict[str, str]]]:
    """The stored rows and, of each model, its fit with thresholds of the validation rows, mean F1 by strength, and dropped features.

    Models are trained once for the same rows: they are frozen under the digest of
    their input, from where further queries read them.
    """
    rows = stored(labelled(spark, sf), "labelled")
    path = f"{folder(spark)}/trained-{checks.digest_of(checks.row_keys(rows, 'page_id'), 'row')}"
    if not freeze.exists(spark, path):
        found = [(m.name, m.text(), json.dumps(list(f1.items())), json.dumps(gone)) for m, f1, gone in _fits(rows)]
        try:
            freeze.freeze(spark, path, {"models": (spark.createDataFrame(found, "name string, model string, f1 string, dropped string"), "name")}, {})
        except freeze.FrozenError:  # another query was first, with the same rows
            pass
    locked = sorted(freeze.opened(spark, path, "models")["models"].collect(), key=lambda r: ORDER.index(r["name"]))
    fits = [models.parsed(r["model"]) for r in locked]
    return rows, fits, {r["name"]: {c: f for c, f in json.loads(r["f1"])} for r in locked}, {r["name"]: json.loads(r["dropped"]) for r in locked}


def _fits(rows: DataFrame) -> list[tuple[models.Model, dict[float, float], dict[str, str]]]:
    train = stored(train_rows(rows), "train")
    out = []
    for model, f1, dropped in models.train(train, specs(train), urls.LOGGED, "label", "fold"):
        swept = metrics.sweep(rows.where("split = 'val'").select("label", model.score().alias("score")), "label", "score")
        views = {"primary": metrics.choose_threshold(swept, LEAST_RECALL, MOST_FPR), "f1_optimal": metrics.choose_threshold(swept, 2.0)}
        out.append((replace(model, thresholds=(*((v, float(df.first()["threshold"])) for v, df in views.items()), ("fixed_0.50", 0.5))), f1, dropped))
    return out


@query()
def c_selection(spark, sf):
    """Mean F1 over five grouped folds for each model and strength, and the strength chosen."""
    _, fits, found, _ = trained(spark, sf)
    rows = [(m.name, c, round(f1, 4), c == m.strength) for m in fits for c, f1 in found[m.name].items()]
    return spark.createDataFrame(rows, "model string, c double, mean_f1 double, chosen boolean")


@query()
def model_manifest(spark, sf):
    """Models as locked: written once, with their digests, read back and compared with these."""
    _, fits, _, gone = trained(spark, sf)
    base = f"{folder(spark)}/models-{uuid.uuid4().hex}"
    rows = []
    for m in fits:
        digest = models.lock(spark, m, f"{base}/{m.name}")
        back = models.load(spark, f"{base}/{m.name}", digest)
        rows.append((m.name, len(m.features), len(gone[m.name]), m.strength, *(round(t, 6) for _, t in m.thresholds), back == m))
    return spark.createDataFrame(rows, "model string, n_features int, n_dropped int, c double, t_primary double, t_f1_optimal double, t_fixed double, verified boolean")


@query()
def model_test_metrics(spark, sf):
    """All models at all thresholds, and constant answers, on the test rows: counts, rates, area under the curve and Brier score."""
    rows, fits, _, _ = trained(spark, sf)
    scored = rows.where("split = 'test'").select("label", *(m.score().alias(m.name) for m in fits))
    y = F.col("label") == 1
    said = [(m.name, v, t, F.col(m.name) >= t) for m in fits for v, t in m.thresholds] + [("REF_constant_negative", "n/a", None, F.lit(False)), ("REF_constant_positive", "n/a", None, F.lit(True))]
    counts = {"tp": lambda p: y & p, "fp": lambda p: ~y & p, "tn": lambda p: ~y & ~p, "fn": lambda p: y & ~p}
    wide = scored.agg(*(F.count_if(f(p)).alias(f"{c}{i}") for i, (*_, p) in enumerate(said) for c, f in counts.items()), *(F.avg(F.pow(F.col(m.name) - F.col("label"), F.lit(2.0))).alias(f"b_{m.name}") for m in fits))
    brier = {m.name: F.col(f"b_{m.name}") for m in fits}
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(v).alias("threshold_view"), F.lit(t).cast("double").alias("threshold"), *(F.col(f"{c}{i}").alias(c) for c in counts), brier.get(m, F.lit(None)).cast("double").alias("brier")) for i, (m, v, t, _) in enumerate(said)))
    areas = reduce(DataFrame.unionByName, (metrics.auc(scored, "label", m.name).select(F.lit(m.name).alias("model"), F.col("auc").alias("roc_auc")) for m in fits))
    long = wide.select(F.inline(cells)).join(F.broadcast(areas), "model", "left")  # a row a model
    rated = long.withColumns(metrics.rates(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))
    return rated.select("model", "threshold_view", F.round("threshold", 6).alias("threshold"), *counts, *(F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "roc_auc", "brier")))


@query()
def model_differences(spark, sf):
    """Paired differences of models over 2,000 resamples of test groups, at the primary thresholds."""
    rows, fits, _, _ = trained(spark, sf)
    by = {m.name: m for m in fits}
    test = rows.where("split = 'test'").select("group_id", "label", *((m.score() >= dict(m.thresholds)["primary"]).cast("int").alias(m.name) for m in fits))
    pairs = [("E3_fusion", "E1_url_only"), ("M1_plus_QR", "M1_length_only"), ("E2_qr_only", "M1_length_only"), ("E3_reducedQR", "E1_url_only")]
    found = metrics.paired_differences(test, "group_id", "label", [(a, b) for a, b in pairs if a in by and b in by], 2000, SEED)
    return found.select("difference", "metric", "draws", *(r6(c, c) for c in ("point", "ci95_low", "ci95_high")))


@query()
def evaluation(spark, sf):
    """Everything an evaluation leaves behind, frozen together: predictions, metrics, paired differences, and the errors of each model. Its tables and how many rows they have."""
    rows, fits, _, _ = trained(spark, sf)
    test = rows.where("split = 'test'")
    scores = [m.score().alias(f"{m.name}_score") for m in fits]
    answers = [(m.score() >= dict(m.thresholds)["primary"]).cast("int").alias(f"{m.name}_pred") for m in fits]
    predictions = stored(test.select("page_id", "group_id", "label", "url_length", *scores, *answers), "predictions")
    wrong = [errors.worksheet(predictions, "label", f"{m.name}_pred", f"{m.name}_score", ["page_id"], ["url_length"]).select(F.concat_ws("/", F.lit(m.name), "page_id").alias("error"), F.lit(m.name).alias("model"), "*") for m in fits]
    found = {
        "predictions": (predictions, "page_id"), "test_metrics": (model_test_metrics(spark, sf).withColumn("cell", F.concat_ws("/", "model", "threshold_view")), "cell"),
        "differences": (model_differences(spark, sf).withColumn("cell", F.concat_ws("/", "difference", "metric")), "cell"), "errors": (reduce(DataFrame.unionByName, wrong), "error"),
    }
    path = f"{folder(spark)}/evaluation-{uuid.uuid4().hex}"
    freeze.freeze(spark, path, found, {"models": {m.name: m.digest() for m in fits}})
    entries = freeze.manifest(spark, path)["tables"]
    return spark.createDataFrame([(name, e["n"]) for name, e in sorted(entries.items())], "name string, n bigint")


@query()
def model_explanations(spark, sf):
    """Scores of the locked E1 model on the test rows with band, advice and what raises and lowers them; tests add the parts up."""
    rows, fits, _, _ = trained(spark, sf)
    (model,) = (m for m in fits if m.name == "E1_url_only")
    test = rows.where("split = 'test'").join(table(spark, sf, "pages").select("page_id", "url"), "page_id")
    scaling = spark.createDataFrame([tuple(x for f in zip(model.medians, model.means, model.deviations, strict=True) for x in f)], ", ".join(f"{f}__{s} double" for f in model.features for s in ("median", "mean", "std")))
    whole = explain.explained(explain.scored(explain.with_parts(test, scaling, dict(zip(model.features, model.weights, strict=True)), list(model.logged)), model.intercept))
    return whole.select("page_id", r6("score", "score"), "band", "recommendation", *(F.array_join(c, " | ").alias(c) for c in ("raising", "lowering")))
