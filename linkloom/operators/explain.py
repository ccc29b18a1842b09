"""Linear risk scores as column expressions, and exact per-feature contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import ranks

#: Risk bands of a probability.
SUSPICIOUS, HIGH = 0.30, 0.70
#: Contributions smaller than this are not told.
TOLD = 0.05


#: Factors of each direction that are told.
FACTORS = 3

#: What each feature is called, and how its value is shown.
LABELS = {
    "url_length": ("Total URL length", "characters"),
    "url_hostname_length": ("Domain name length", "characters"),
    "url_path_length": ("Path length", "characters"),
    "url_query_length": ("Query-string length", "characters"),
    "url_dot_count": ("Number of dots", "number"),
    "url_hyphen_count": ("Number of hyphens", "number"),
    "url_digit_count": ("Number of digits", "number"),
    "url_digit_ratio": ("Share of characters that are digits", "percent"),
    "url_special_char_count": ("Number of special characters", "number"),
    "url_at_count": ("Number of '@' symbols", "number"),
    "url_percent_count": ("Number of '%' encodings", "number"),
    "url_entropy": ("Character randomness", "bits"),
    "url_subdomain_count": ("Number of subdomain parts", "number"),
    "url_path_depth": ("Path depth (folders)", "number"),
    "url_query_param_count": ("Number of query parameters", "number"),
    "url_question_count": ("Number of '?' symbols", "number"),
    "url_equals_count": ("Number of '=' symbols", "number"),
    "url_ampersand_count": ("Number of '&' symbols", "number"),
    "url_has_double_slash_path": ("Double slash inside the path", "yes or no"),
    "url_has_https": ("Uses https", "yes or no"),
    "url_has_ip": ("Uses a raw IP address as the host", "yes or no"),
    "url_has_punycode": ("Contains punycode (xn--)", "yes or no"),
    "url_has_nonstandard_port": ("Uses a non-standard port", "yes or no"),
    "url_suspicious_token_count": ("Number of watch-list words present", "number"),
    "url_has_token_login": ("Contains the word 'login'", "yes or no"),
    "url_has_token_verify": ("Contains the word 'verify'", "yes or no"),
    "url_has_token_account": ("Contains the word 'account'", "yes or no"),
    "url_has_token_secure": ("Contains the word 'secure'", "yes or no"),
    "url_has_token_update": ("Contains the word 'update'", "yes or no"),
    "url_has_token_bank": ("Contains the word 'bank'", "yes or no"),
}

#: What is advised in each risk band.
RECOMMENDATIONS = {
    "LOW RISK": "Fewer risk indicators were detected by this prototype. This is not a guarantee of safety; still verify the destination before entering sensitive information.",
    "SUSPICIOUS": "Some risk indicators were detected. Verify the destination through an independent trusted source before proceeding.",
    "HIGH RISK": "Multiple risk indicators were detected. Do not navigate to this destination unless it is independently verified.",
}


def fitted_scaling(rows: DataFrame, features: list[str], logged: list[str]) -> DataFrame:
    """One row: median, mean and population deviation of each feature, after log(1 + x) where asked.

    Medians are taken of columns that miss a value; the others have null.
    """
    missing = rows.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in features)).first()
    holes = [f for f in features if missing[f]]
    medians = rows.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(f"{f}__median") for f in features if f not in holes))
    if holes:
        long = rows.select(*(F.col(f).cast("double").alias(f) for f in holes)).unpivot([], holes, "feature", "value")
        found = ranks.quantiles(long, ["feature"], "value", {"median": 0.5})
        medians = medians.crossJoin(found.agg(*(F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"{f}__median") for f in holes)))
    filled = rows.crossJoin(F.broadcast(medians)) if holes else rows.select("*", *(F.lit(None).cast("double").alias(f"{f}__median") for f in features))
    values = {f: transformed(F.coalesce(F.col(f), F.col(f"{f}__median")), f, logged) for f in features}
    rest = filled.agg(*(e for f, v in values.items() for e in (F.avg(v).alias(f"{f}__mean"), F.stddev_pop(v).alias(f"{f}__std"))))
    return medians.crossJoin(rest)


def transformed(value: Column, feature: str, logged: list[str]) -> Column:
    return F.log1p(value.cast("double")) if feature in logged else value.cast("double")


def with_parts(rows: DataFrame, scaling: DataFrame, weights: dict[str, float], logged: list[str]) -> DataFrame:
    """Adds `parts`: feature, feature_group, raw, z and contribution (weight times standardised value) of each feature, within the row."""
    wide = rows.crossJoin(F.broadcast(scaling))  # one row of constants
    raw = {f: F.coalesce(F.col(f).cast("double"), F.col(f"{f}__median")) for f in weights}
    deviation = {f: F.when(F.round(F.col(f"{f}__std"), 12) == 0, 1.0).otherwise(F.col(f"{f}__std")) for f in weights}
    z = {f: (transformed(raw[f], f, logged) - F.col(f"{f}__mean")) / deviation[f] for f in weights}
    group = {f: g for g, fs in urls.GROUPS.items() for f in fs}
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(group.get(f)).alias("feature_group"), raw[f].alias("raw"), z[f].alias("z"), (z[f] * w).alias("contribution")) for f, w in weights.items()))
    return wide.select(*rows.columns, parts.alias("parts"))


def contributions(rows: DataFrame, key: str, scaling: DataFrame, weights: dict[str, float], logged: list[str]) -> DataFrame:
    """(key, feature, z, contribution), a row for each feature of each row."""
    return with_parts(rows, scaling, weights, logged).select(key, F.inline("parts")).select(key, "feature", "z", "contribution")


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["contribution"])


def scored(rows: DataFrame, intercept: float) -> DataFrame:
    """Adds logit, score and band to rows with parts; no row meets another."""
    logit = rows.withColumn("logit", F.lit(intercept) + _sum(F.col("parts")))
    return logit.withColumn("score", 1 / (1 + F.exp(-F.col("logit")))).withColumn("band", risk_band(F.col("score")))


def risk_band(p: Column) -> Column:
    return F.when(p >= HIGH, "HIGH RISK").when(p >= SUSPICIOUS, "SUSPICIOUS").otherwise("LOW RISK")


def recommendation(band: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in RECOMMENDATIONS.items() for x in p))[band]


def _group_total(parts: Column, group: Column) -> Column:
    return _sum(F.filter(parts, lambda p: p["feature_group"] == group))


def group_totals(rows: DataFrame, key: str) -> DataFrame:
    """(key, feature_group, total) of the groups that rows with parts have."""
    groups = F.array_distinct(F.transform("parts", lambda p: p["feature_group"]))
    totals = F.transform(groups, lambda g: F.struct(g.alias("feature_group"), _group_total(F.col("parts"), g).alias("total")))
    return rows.select(key, F.inline(totals))


def _shown(kind: Column, raw: Column) -> Column:
    whole = F.bround(raw).cast("bigint").cast("string")
    return (
        F.when(kind == "characters", F.concat(whole, F.when(whole == "1", " character").otherwise(" characters")))
        .when(kind == "percent", F.concat(F.bround(raw * 100).cast("bigint").cast("string"), F.lit("%")))
        .when(kind == "bits", F.concat(F.format_string("%.2f", F.bround(raw, 2)), F.lit(" bits/char")))
        .when(kind == "yes or no", F.when(raw >= 0.5, "yes").otherwise("no")).otherwise(whole)
    )


def sentence(part: Column) -> Column:
    """What one part says: the feature, its value, on which side of the training average it lies, and what it does to the score."""
    label, kind = (F.create_map(*(F.lit(x) for f, names in LABELS.items() for x in (f, names[i])))[part["feature"]] for i in (0, 1))
    side = F.when(part["feature"].startswith("url_has_"), ".").otherwise(F.concat(F.lit(" ("), F.when(part["z"] > 0, "above").otherwise("below"), F.lit(" the training average).")))
    return F.concat(label, F.lit(": "), _shown(kind, part["raw"]), side, F.lit(" This "), F.when(part["contribution"] > 0, "raises").otherwise("lowers"), F.lit(" the risk score."))


def words_sentence(url: Column, total: Column) -> Column:
    """What the watch-list words in a url do together."""
    found = F.filter(F.array(*map(F.lit, urls.TOKENS)), lambda t: F.contains(F.lower(url), t))
    words = F.concat(F.lit("Watch-list words found in the URL text: "), F.array_join(F.transform(found, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "))
    return F.concat(F.when(F.size(found) > 0, words).otherwise("No watch-list words found in the URL text"), F.lit(". Together, the keyword features "), F.when(total > 0, "raise").otherwise("lower"), F.lit(" the risk score."))


def told(url: Column | None = None) -> Column:
    """The factors of a row with parts worth telling: (contribution, factor, sentence), strongest first.

    A feature is told if it agrees in sign with its group's total and both are strong
    enough; watch-list words go as one. Without `url` there are no sentences.
    """
    parts = F.col("parts")
    words = _group_total(parts, F.lit("Keywords"))
    has = F.exists(parts, lambda p: p["feature_group"] == "Keywords")
    one = F.struct(words.alias("contribution"), F.lit("keywords").alias("factor"), (words_sentence(url, words) if url is not None else F.lit("")).alias("sentence"))

    def agrees(p: Column) -> Column:
        total = _group_total(parts, p["feature_group"])
        return (p["feature_group"] != "Keywords") & (F.abs(p["contribution"]) >= TOLD) & (F.abs(total) >= TOLD) & (F.signum(p["contribution"]) == F.signum(total))

    others = F.transform(F.filter(parts, agrees), lambda p: F.struct(p["contribution"].alias("contribution"), p["feature"].alias("factor"), (sentence(p) if url is not None else F.lit("")).alias("sentence")))
    items = F.concat(F.when(has & (F.abs(words) >= TOLD), F.array(one)).otherwise(F.slice(F.array(one), 1, 0)), others)
    placed = F.array_sort(F.transform(items, lambda i: F.struct((-F.abs(F.round(i["contribution"], 9))).alias("order"), i["factor"].alias("factor"), i["contribution"].alias("contribution"), i["sentence"].alias("sentence"))))
    return F.transform(placed, lambda i: F.struct(i["contribution"].alias("contribution"), i["factor"].alias("factor"), i["sentence"].alias("sentence")))


def factors(rows: DataFrame, key: str, k: int = FACTORS, url: str | None = None) -> DataFrame:
    """(key, direction, place, factor, contribution, sentence): the k strongest factors of each direction of each row with parts."""
    items = rows.select(key, told(F.col(url) if url else None).alias("told"))
    sides = [items.select(key, F.lit(name).alias("direction"), F.posexplode(F.slice(F.filter("told", keep), 1, k)).alias("place", "f")) for name, keep in (("raises", lambda i: i["contribution"] > 0), ("lowers", lambda i: i["contribution"] < 0))]
    return sides[0].unionByName(sides[1]).select(key, "direction", (F.col("place") + 1).alias("place"), "f.factor", "f.contribution", "f.sentence")


def explained(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds recommendation, raising and lowering (sentences) to rows with parts, score and band."""
    items = rows.withColumn("told", told(F.col(url)))
    lists = {name: F.transform(F.slice(F.filter("told", keep), 1, FACTORS), lambda i: i["sentence"]) for name, keep in (("raising", lambda i: i["contribution"] > 0), ("lowering", lambda i: i["contribution"] < 0))}
    return items.withColumns({"recommendation": recommendation(F.col("band")), **lists}).drop("told")
