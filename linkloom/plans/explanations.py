"""Queries that explain scores in words and tables, and put rows back into an order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import errors, explain, metrics, ranks
from linkloom.plans import catalog
from linkloom.plans.catalog import _INTERCEPT, _LONG, _SCORED, _Z, query, r6, table

# ---------------------------------------------------------------- sentences

_SHOWN = {
    "characters": "concat(round_even(raw, 0)::BIGINT::VARCHAR, CASE WHEN round_even(raw, 0) = 1 THEN ' character' ELSE ' characters' END)", "number": "round_even(raw, 0)::BIGINT::VARCHAR",
    "percent": "concat(round_even(raw * 100, 0)::BIGINT::VARCHAR, '%')", "bits": "concat(format('{:.2f}', round_even(raw, 2)), ' bits/char')", "yes or no": "CASE WHEN raw >= 0.5 THEN 'yes' ELSE 'no' END",
}
_LABEL = "CASE feature " + " ".join("WHEN '{}' THEN '{}'".format(f, label.replace("'", "''")) for f, (label, _) in explain.LABELS.items()) + " END"
_VALUE = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f, (_, k) in explain.LABELS.items() if k == kind)}) THEN {sql}" for kind, sql in _SHOWN.items()) + " END"
_SIDE = "CASE WHEN feature LIKE 'url\\_has\\_%' ESCAPE '\\' THEN '.' WHEN z > 0 THEN ' (above the training average).' ELSE ' (below the training average).' END"
_WORDS = f"list_filter({list(urls.TOKENS)}, lambda t: contains(lower(url), t))"
_WORD_TEXT = f"concat(CASE WHEN len({_WORDS}) > 0 THEN concat('Watch-list words found in the URL text: ', array_to_string(list_transform({_WORDS}, lambda t: concat(chr(39), t, chr(39))), ', ')) ELSE 'No watch-list words found in the URL text' END, '. Together, the keyword features ', CASE WHEN total > 0 THEN 'raise' ELSE 'lower' END, ' the risk score.')"


@query(f"""WITH z AS ({_Z}), t AS (SELECT *, sum(contribution) OVER (PARTITION BY page_id, feature_group) AS total FROM ({_LONG})),
i AS (SELECT page_id, feature AS factor, contribution, concat({_LABEL}, ': ', {_VALUE}, {_SIDE}, ' This ', CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END, ' the risk score.') AS sentence FROM t
 WHERE feature_group <> 'Keywords' AND sign(contribution) = sign(total) AND abs(contribution) >= 0.05 AND abs(total) >= 0.05
 UNION ALL SELECT page_id, 'keywords', total, {_WORD_TEXT} FROM (SELECT DISTINCT page_id, round(total, 12) AS total FROM t WHERE feature_group = 'Keywords' AND abs(total) >= 0.05) JOIN pages USING (page_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, sign(contribution) ORDER BY abs(round(contribution, 9)) DESC, factor) AS place FROM i)
SELECT page_id, CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END AS direction, place::INT AS place, sentence FROM k WHERE place <= 3""")
def factor_texts(spark, sf):
    """What raises and what lowers each score, in plain words."""
    return explain.factors(catalog.page_parts(spark, sf), "page_id", url="url").select("page_id", "direction", "place", "sentence")


_ADVICE = "CASE " + " ".join(f"WHEN {test} THEN '{explain.RECOMMENDATIONS[band]}'" for band, test in (("HIGH RISK", "p >= 0.7"), ("SUSPICIOUS", "p >= 0.3"), ("LOW RISK", "true"))) + " END"
_PAGE_SCORES = f"SELECT page_id, 1 / (1 + exp(-(sum(contribution) + {_INTERCEPT}))) AS p FROM ({_LONG}) GROUP BY page_id"


@query(f"WITH z AS ({_Z}) SELECT page_id, round(p, 6) AS score, {_ADVICE} AS recommendation FROM ({_PAGE_SCORES})")
def recommendations(spark, sf):
    """The score of each page and what is advised; the sentences of factor_texts go with it in explain.explained."""
    rows = explain.explained(explain.scored(catalog.page_parts(spark, sf), _INTERCEPT))
    return rows.select("page_id", r6("score", "score"), "recommendation")


# ---------------------------------------------------------------- examples and errors

_CELLED = f"SELECT page_id, round(p, 9) AS p, page_id % 2 AS label, CASE WHEN p >= 0.7 THEN 'HIGH RISK' WHEN p >= 0.3 THEN 'SUSPICIOUS' ELSE 'LOW RISK' END AS band FROM ({_PAGE_SCORES})"


@query(f"""WITH z AS ({_Z}), c AS ({_CELLED}), e AS (SELECT label, band, page_id FROM (SELECT *, row_number() OVER (PARTITION BY label, band ORDER BY p, page_id) AS k, count(*) OVER (PARTITION BY label, band) AS n FROM c) WHERE k = (n - 1) // 2 + 1)
SELECT label, band, page_id, feature, round(contribution, 6) + 0.0 AS logit_contribution, row_number() OVER (PARTITION BY label, band ORDER BY abs(round(contribution, 9)) DESC, feature)::INT AS place FROM e JOIN ({_LONG}) USING (page_id)""")
def example_contributions(spark, sf):
    """The row of lower median score of each label and band, and all its contributions, the strongest first."""
    rows = explain.scored(catalog.page_parts(spark, sf), _INTERCEPT).select("page_id", (F.col("page_id") % 2).alias("label"), "band", F.round("score", 9).alias("p"), "parts")
    values = ranks.running_by(rows.groupBy("label", "band", "p").agg(F.count("*").alias("n")), ["label", "band"], "p", ["n"])
    held = values.where("below_n <= (all_n - 1) div 2 and (all_n - 1) div 2 < below_n + n").selectExpr("label", "band", "p", "(all_n - 1) div 2 - below_n + 1 as seat")
    tied = rows.join(F.broadcast(held), ["label", "band", "p"])  # one row a cell
    picked = tied.withColumn("k", F.row_number().over(Window.partitionBy("label", "band", "p").orderBy("page_id"))).where("k = seat")
    ordered = F.array_sort(F.transform("parts", lambda p: F.struct((-F.abs(F.round(p["contribution"], 9))).alias("o"), p["feature"].alias("feature"), p["contribution"].alias("contribution"))))
    return picked.select("label", "band", "page_id", F.posexplode(ordered).alias("at", "part")).select("label", "band", "page_id", "part.feature", (F.round("part.contribution", 6) + 0.0).alias("logit_contribution"), (F.col("at") + 1).alias("place"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = 0 THEN -score ELSE score END, l_orderkey, l_linenumber) AS k FROM {_SCORED} WHERE label <> predicted)
SELECT l_orderkey, l_linenumber, CASE WHEN label = 0 THEN 'false positive' ELSE 'false negative' END AS error_type, CASE WHEN label = 0 THEN 'benign' ELSE 'suspicious/malicious' END AS true_label,
 CASE WHEN predicted = 0 THEN 'benign (below threshold)' ELSE 'malicious (at/above threshold)' END AS prediction, round_even(score, 3) AS risk_score, l_suppkey, o_orderpriority, '' AS your_category, '' AS evidence_note
FROM s JOIN orders ON o_orderkey = l_orderkey WHERE k <= 25""")
def error_worksheet(spark, sf):
    """The 25 surest errors of each kind with columns of their order, ready to be filled in."""
    sheet = errors.worksheet(catalog.scored(spark, sf), "label", "predicted", "score", ["l_orderkey", "l_linenumber"], ["l_suppkey"], 25)
    context = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    names = [c for c in sheet.columns if c not in ("your_category", "evidence_note")]
    return context.join(F.broadcast(sheet), "l_orderkey").select(*names, "o_orderpriority", "your_category", "evidence_note")  # fifty rows


# ---------------------------------------------------------------- orders


@query("SELECT o_clerk_group, n, row_number() OVER (ORDER BY first) - 1 AS place FROM (SELECT o_custkey % 7 AS o_clerk_group, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def first_seen_groups(spark, sf):
    """Groups in the order in which they first appear."""
    per = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 7).alias("o_clerk_group")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return ranks.numbered(per, ["first", "o_clerk_group"], "place").select("o_clerk_group", "n", "place")


@query("""SELECT feature, value, row_number() OVER (ORDER BY value NULLS LAST, feature)::INT AS place FROM (SELECT feature, value, row_number() OVER (ORDER BY abs(value) DESC NULLS LAST, feature) AS k FROM
 (SELECT n_name AS feature, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE round(avg(c_acctbal) - 4500, 6) END AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey)) WHERE k <= 12""")
def strongest_resorted(spark, sf):
    """The twelve values that are largest without their sign, missing ones last, put back in order of their value."""
    per = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    named = per.join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("feature"), F.expr("if(n_nationkey % 6 = 0, null, round(mean - 4500, 6))").alias("value"))
    top = named.orderBy(F.abs("value").desc_nulls_last(), "feature").limit(12)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("value"), "feature")))  # twelve rows


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS original FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 20")
def restored_order(spark, sf):
    """Chosen rows with the places that they had in the whole table, by which their order is restored."""
    whole = ranks.numbered(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderkey"], "original")
    k = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return whole.withColumn("k", k).where("k <= 20").orderBy("original").select("o_orderkey", "o_totalprice", "original")


# ---------------------------------------------------------------- length matching

_AREA = """SELECT '{0}' AS rows, count(*) AS n, round((sum(CASE WHEN quality = 1 THEN k END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2.0) / (count_if(quality = 1) * count_if(quality = 0)), 6) AS roc_auc
FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM ({1}))"""


@query(_AREA.format("all", "SELECT quality, n_chars FROM documents JOIN labels USING (doc_id)") + " UNION ALL " + _AREA.format("length-matched", f"SELECT m.quality, n_chars FROM ({catalog.SQL['length_matched']}) m JOIN documents USING (doc_id)"))
def length_matched_auc(spark, sf):
    """How far length alone tells the classes apart, before and after matching."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    matched = catalog.length_matched(spark, sf).select("doc_id", "quality").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    found = None
    for name, own in (("all", rows), ("length-matched", matched)):
        one = metrics.auc(own, "quality", "n_chars").select("auc").crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))).select(F.lit(name).alias("rows"), "n", r6("auc", "roc_auc"))  # one row
        found = one if found is None else found.unionByName(one)
    return found




# ---------------------------------------------------------------- payloads, tiers, controls and formats

#: How far a matched subset of so many rows can be read.
TIERS = ((200, "strong"), (150, "useful (show CIs)"), (100, "exploratory"), (0, "descriptive only"))
#: What a control explains, by the share of the effect that it reproduces.
CONTROL = ((0.10, "none"), (0.60, "part"), (float("inf"), "most"))


def tier(n):
    """How far n rows can be read."""
    out = F.lit(TIERS[-1][1])
    for least, name in reversed(TIERS[:-1]):
        out = F.when(n >= least, name).otherwise(out)
    return out


def control_verdict(share):
    """What a control explains; a share that is missing explains nothing."""
    size = F.coalesce(F.abs(share), F.lit(0.0))
    return F.when(size < CONTROL[0][0], CONTROL[0][1]).when(size < CONTROL[1][0], CONTROL[1][1]).otherwise(CONTROL[2][1])


_TIER = "CASE " + " ".join(f"WHEN n >= {least} THEN '{name}'" for least, name in TIERS) + " END"


@query(f"SELECT bins, n, zeros, ones, {_TIER} AS tier FROM (SELECT bins, count(*) AS n, count_if(quality = 0)::BIGINT AS zeros, count_if(quality = 1)::BIGINT AS ones FROM ({catalog.SQL['length_matched']}) GROUP BY bins)")
def matched_tier(spark, sf):
    """Size of the length-matched subset and how far it can be read."""
    per = catalog.length_matched(spark, sf).groupBy("bins").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("zeros"), F.count_if(F.col("quality") == 1).alias("ones"))
    return per.withColumn("tier", tier(F.col("n")))


_SHIFTS = "SELECT user_id % 5 AS condition, avg(CASE WHEN event_type = 'click' THEN value END) AS effect, avg(CASE WHEN event_type = 'view' THEN value END) - 40 AS control FROM events GROUP BY 1"


@query(f"SELECT condition, round(share, 3) AS share, CASE WHEN coalesce(abs(share), 0) < 0.1 THEN 'none' WHEN abs(share) < 0.6 THEN 'part' ELSE 'most' END AS verdict FROM (SELECT condition, CASE WHEN abs(effect) > 1e-9 THEN control / effect END AS share FROM ({_SHIFTS}))")
def control_shares(spark, sf):
    """The share of an effect that a control reproduces, and what follows from it; no effect has no share."""
    per = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("condition")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("effect"), (F.avg(F.when(F.col("event_type") == "view", F.col("value"))) - 40).alias("control"))
    share = per.withColumn("share", F.when(F.abs("effect") > 1e-9, F.col("control") / F.col("effect")))
    return share.select("condition", F.round("share", 3).alias("share"), control_verdict(F.col("share")).alias("verdict"))


@query("""SELECT l_shipmode, l_returnflag, n, concat(CASE WHEN shift >= 0 THEN '+' ELSE '' END, format('{:.2f}', shift)) AS shift, concat(format('{:.1f}', share), '%') AS share FROM
 (SELECT l_linestatus AS l_shipmode, l_returnflag, count(*) AS n, round_even(avg(l_quantity) - 25, 2) AS shift, round_even(100.0 * count_if(l_discount > 0.05) / count(*), 1) AS share FROM lineitem GROUP BY ALL)""")
def formatted_numbers(spark, sf):
    """Signed numbers and percentages as they stand in a report; halves go to even digits."""
    per = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("l_shipmode"), "l_returnflag").agg(F.count("*").alias("n"), F.bround(F.avg("l_quantity") - 25, 2).alias("shift"), F.bround(100.0 * F.count_if(F.col("l_discount") > 0.05) / F.count("*"), 1).alias("share"))
    return per.select("l_shipmode", "l_returnflag", "n", F.concat(F.when(F.col("shift") >= 0, "+").otherwise(""), F.format_string("%.2f", "shift")).alias("shift"), F.concat(F.format_string("%.1f", "share"), F.lit("%")).alias("share"))


@query("SELECT bin, n, mean_score, share FROM (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share FROM " + _SCORED + " GROUP BY 1) WHERE n >= 5")
def reliability_points(spark, sf):
    """Mean score and share of positives of each bin that holds five rows or more."""
    number = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int")
    per = catalog.scored(spark, sf).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("score"), "mean_score"), r6(F.avg("label"), "share"))
    return per.where("n >= 5")


@query("""SELECT band, y AS label, sum(exact)::BIGINT AS exact, sum(attempted)::BIGINT AS attempted, round(sum(exact) / sum(attempted), 6) AS rate FROM (SELECT l_suppkey, CASE WHEN l_quantity <= 15 THEN 'v1-v3' WHEN l_quantity <= 30 THEN 'v4-v6' ELSE 'v7+' END AS band, l_orderkey % 2 AS y, count_if(l_returnflag = 'N') AS exact, count(*) AS attempted FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL) GROUP BY ALL""")
def strong_condition_bands(spark, sf):
    """Named sums over two keys, version band and label, under one strong condition only."""
    rows = table(spark, sf, "lineitem").where("l_discount >= 0.05").withColumn("band", catalog.images.version_band(F.col("l_quantity") / 5))
    per = rows.groupBy("band", (F.col("l_orderkey") % 2).alias("label")).agg(F.count_if(F.col("l_returnflag") == "N").alias("exact"), F.count("*").alias("attempted"))
    return per.withColumn("rate", F.round(F.col("exact") / F.col("attempted"), 6))


#: What is said of payloads that are not analysed.
MESSAGES = {"undecodable": "no payload was decoded", "non_url": "not a web URL: shown as text, not analysed", "too_long": "longer than any URL in training: shown as text, not analysed"}

_ANALYSED = urls.sql_with(urls.parts(urls.DUCKDB, "payload"), catalog._PAYLOADS)
_PAYLOAD_FEATURES = f"SELECT page_id, {urls.triage(urls.DUCKDB)} AS kind, {', '.join(f'{e} AS {n}' for n, e in urls.features(urls.DUCKDB, 'payload'))} FROM {_ANALYSED}"
_STATS = f"SELECT {', '.join(f'avg({catalog._value(f)}) AS {f}_m, CASE WHEN round(stddev_pop({catalog._value(f)}), 12) = 0 THEN 1.0 ELSE stddev_pop({catalog._value(f)}) END AS {f}_s' for f in catalog._WEIGHTS)} FROM ({catalog._FEATURES})"
_PAYLOAD_LOGIT = " + ".join(f"{w} * ({catalog._value(f)} - {f}_m) / {f}_s" for f, w in catalog._WEIGHTS.items())


@query(f"WITH p AS ({_PAYLOAD_FEATURES}), s AS ({_STATS}) SELECT page_id, kind, CASE WHEN kind = 'url' THEN round(1 / (1 + exp(-({_PAYLOAD_LOGIT} + {_INTERCEPT}))), 6) END AS score, CASE kind {' '.join(f'WHEN {k!r} THEN {m!r}' for k, m in MESSAGES.items())} END AS message FROM p, s")
def payload_analysis(spark, sf):
    """Decoded payloads: what they are, and the score of those that are URLs; the others are only spoken of."""
    rows = catalog.page_features(spark, sf)
    scaling = explain.fitted_scaling(rows, list(catalog._WEIGHTS), urls.LOGGED)
    payload = F.expr("CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN url || ' x' WHEN 2 THEN 'mailto:a@b.c' WHEN 3 THEN url || repeat('a', 2000) WHEN 4 THEN 'http://' ELSE url END")
    shown = urls.with_parts(table(spark, sf, "pages").select("page_id", payload.alias("payload")), "payload").withColumn("kind", F.expr(urls.triage(urls.SPARK)))
    scored = explain.scored(explain.with_parts(urls.with_features(shown, "payload"), scaling, catalog._WEIGHTS, urls.LOGGED), _INTERCEPT)
    said = F.create_map(*(F.lit(x) for p in MESSAGES.items() for x in p))
    return scored.select("page_id", "kind", F.when(F.col("kind") == "url", F.round("score", 6)).alias("score"), F.try_element_at(said, F.col("kind")).alias("message"))


_SOURCES = ("documents", "pages", "customer", "not_there")


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, 'audited' AS status, count(*)::BIGINT AS n, count(DISTINCT {k})::BIGINT AS n_keys FROM {t}" for t, k in (("documents", "doc_id"), ("pages", "page_id"), ("customer", "c_custkey"))) + " UNION ALL SELECT 'not_there', 'skipped', NULL, NULL")
def source_audit(spark, sf):
    """Rows and keys of every source that is there; one that is missing is said to be, and stops nothing."""
    out = None
    for name in _SOURCES:
        try:
            rows = table(spark, sf, name)
            one = rows.agg(F.count("*").alias("n"), F.countDistinct(rows.columns[0]).alias("n_keys")).select(F.lit(name).alias("source"), F.lit("audited").alias("status"), "n", "n_keys")
        except AnalysisException:
            one = spark.createDataFrame([(name, "skipped", None, None)], "source string, status string, n bigint, n_keys bigint")
        out = one if out is None else out.unionByName(one)
    return out
