"""The split of a labelled URL table, from groups to frozen tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import checks, domains, freeze, groups
from linkloom.operators.runner import spread
from linkloom.sources.scratch import stored

CANDIDATES = 500


class LeakError(Exception):
    """Something that has to stay together stands in several splits."""


def grouped_urls(rows: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """Parts, registered domain, canonical url, template (null if trivial) and group of each row of (key, url, label)."""
    parts = domains.with_registered_domain(urls.with_parts(rows), rules)
    shaped = urls.with_columns(parts, [("canonical_url", urls.canonical(urls.SPARK)), ("url_template", urls.template(urls.SPARK))])
    shaped = shaped.withColumn("url_template", F.when(F.expr(urls.nontrivial()), F.col("url_template")))
    out = groups.split_groups(stored(shaped, "shaped"), key, "registered_domain", "url_template")
    return out


def template_report(grouped: DataFrame) -> DataFrame:
    """Templates in use, whether they were merged, and their rows by split."""
    per = grouped.where("url_template is not null").groupBy("url_template").agg(
        F.count("*").alias("n_urls"), F.count_if(F.col("label") == 0).alias("n_benign"), F.count_if(F.col("label") == 1).alias("n_malicious"),
        *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")),
    ).where(F.col("n_urls") >= groups.LEAST)
    return per.withColumn("action", F.when(F.col("n_urls") > groups.MOST, "reported_generic_not_merged").otherwise("merged"))


def split_audit(assigned: DataFrame) -> DataFrame:
    """Rows, classes, groups, largest group and domains of each split."""
    sizes = assigned.groupBy("split", "split_group_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("zeros"))
    per = sizes.groupBy("split").agg(F.sum("n").alias("n"), F.sum("zeros").alias("n_benign"), F.count("*").alias("n_groups"), F.max("n").alias("largest_group"))
    spans = assigned.groupBy("split").agg(F.countDistinct("registered_domain").alias("n_domains"))
    total = per.agg(F.sum("n").alias("total"))
    found = per.join(spans, "split").crossJoin(F.broadcast(total))  # three rows and one
    return found.select("split", "n", F.round(F.col("n") / F.col("total"), 4).alias("fraction"), "n_benign", (F.col("n") - F.col("n_benign")).alias("n_malicious"), "n_groups", "largest_group", "n_domains")


def run_split(rows: DataFrame, rules: DataFrame, path: str, seed: int, key: str = "page_id", candidates: int = CANDIDATES) -> DataFrame:
    """Groups, searches, checks and freezes a split of (key, url, label) under `path`; returns its audit.

    Linked rows (one registered domain, or a template that is used, but not in
    general) are one group and stay together. Of all candidate splits the one of
    lowest score is taken. The frozen folder holds manifest, test ids, candidate
    scores, template report and audit. A folder that is there already is an error,
    found before any work, and so is a leak.
    """
    spark = rows.sparkSession
    if freeze.exists(spark, path):
        raise freeze.FrozenError(f"{path} is frozen: a split is made once")
    grouped = stored(grouped_urls(rows, rules, key), "grouped")
    per = stored(grouped.groupBy("group_id").agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones")), "groups")
    scores = stored(groups.searched_candidates(per, candidates, seed), "scores")
    best = groups.best_candidate(scores).first()
    total = per.agg(F.sum(F.col("zeros") + F.col("ones")).alias("n")).first()["n"] or 0
    chosen = groups.greedy_candidates(per, [best["candidate"]], seed, total).select("group_id", "split")
    names = groups.numbered_groups(grouped, key).withColumnRenamed("name", "split_group_id")
    whole = grouped.join(chosen, "group_id", "left").withColumn("split", F.coalesce("split", F.lit("train"))).join(names, "group_id")
    whole = stored(whole.select(key, "label", "registered_domain", "url_template", "split_group_id", "split"), "split")
    report = stored(template_report(whole), "templates")
    merged = whole.join(report.where("action = 'merged'").select("url_template"), "url_template", "left_semi")
    for part, group in ((whole, "split_group_id"), (whole, "registered_domain"), (merged, "url_template")):
        if not spread(part, group, "split").isEmpty():
            raise LeakError(f"a value of {group} stands in several splits")
    manifest = whole.select(key, "label", "registered_domain", "split_group_id", "split")
    test = manifest.where("split = 'test'").select(key, "label", "split_group_id")
    facts = {
        "selected_candidate": best["candidate"], "seed": seed, "score": round(best["score"], 6), "n_groups": per.count(), "templates_merged": report.where("action = 'merged'").count(),
        "templates_generic_reported": report.where("action <> 'merged'").count(), "test_ids_sha256": checks.digest_of(test, key),
    }
    audit = stored(split_audit(manifest), "audit")
    tables = {"split_manifest": (manifest, key), "test_ids": (test, key), "candidate_scores": (scores, "candidate"), "template_report": (report, "url_template"), "split_audit": (audit, "split")}
    freeze.freeze(spark, path, tables, facts)
    return freeze.opened(spark, path, "split_audit")["split_audit"]


def gated_test_rows(spark: SparkSession, path: str, test_rows: DataFrame, models: dict[str, str], key: str = "page_id") -> DataFrame:
    """The rows that may be evaluated: those of the frozen test ids, once these and the digests of the models are found unchanged.

    models: what each model's digest is now; the frozen facts name what it was
    (facts['models'], if models were frozen too).
    """
    ids = freeze.opened(spark, path, "test_ids")["test_ids"]
    facts = freeze.manifest(spark, path)["facts"]
    if checks.digest_of(test_rows.select(key), key) != facts["test_ids_sha256"] or checks.digest_of(ids, key) != facts["test_ids_sha256"]:
        raise freeze.FrozenError("the test ids are not the frozen ones")
    for name, was in facts.get("models", {}).items():
        if models.get(name) != was:
            raise freeze.FrozenError(f"model {name} is not the frozen one")
    return checks.one_to_one(test_rows, ids.select(key, "split_group_id"), [key])
