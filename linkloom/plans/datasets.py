"""Queries of whole datasets: domains by rules, numbering, validation, and the frozen split."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import checks, clean, domains, freeze, groups, images, metrics, ranks, runner, splits
from linkloom.plans import catalog
from linkloom.plans.catalog import _FEATURES, _PARTS, _SHAPES, SEED, query, r6, table
from linkloom.sources import files, text
from linkloom.sources.scratch import folder, stored

_OUTCOME_SQL = "CASE WHEN page_id % 5 = 0 THEN 'failure' WHEN page_id % 7 = 0 THEN 'mismatch' ELSE 'exact' END"

# ---------------------------------------------------------------- registered domains

#: Ends that take the place of every host's own end in turn, so that rules of all kinds are met.
_ENDS = ("", "shop.com", "a.shop.co.uk", "b.c.ck", "www.ck", "x.city.kawasaki.jp", "y.z.kawasaki.jp", "食狮.公司.cn", "xn--85x722f.xn--55qx5d.cn", "co.uk", "unlisted.zone")
_HOSTS = f"CASE page_id % {len(_ENDS)} " + " ".join(f"WHEN {i} THEN concat(split_part(host, '.', 1), '.{e}')" for i, e in enumerate(_ENDS) if e) + " ELSE host END"


def _rule_rows() -> str:
    found = set()
    for rule in domains.RULES:
        kind = "exception" if rule.startswith("!") else "wildcard" if rule.startswith("*.") else "exact"
        key = rule.lstrip("!").removeprefix("*.")
        found |= {(key, kind), (key.encode("idna").decode(), kind)}
    return ", ".join(str(r) for r in sorted(found))


_DOMAINS = f"""h AS (SELECT page_id, {_HOSTS} AS host, is_ip FROM {_PARTS}),
d AS (SELECT DISTINCT host, is_ip, string_split(host, '.') AS l FROM h),
e AS (SELECT host, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, l FROM d WHERE NOT is_ip),
m AS (SELECT e.host, n, n - i + 1 AS held, kind FROM e JOIN (VALUES {_rule_rows()}) r(key, kind) ON r.key = array_to_string(l[i:], '.') WHERE kind <> 'wildcard' OR i > 1),
b AS (SELECT host, max({{'wins': kind = 'exception', 'held': CASE kind WHEN 'exact' THEN held WHEN 'wildcard' THEN held + 1 ELSE held - 1 END}}) AS best FROM m GROUP BY host),
o AS (SELECT d.host, is_ip, l, coalesce(best.held, 1) AS held FROM d LEFT JOIN b USING (host)),
f AS (SELECT host, CASE WHEN is_ip THEN '' ELSE array_to_string(l[len(l) - held + 1:], '.') END AS public_suffix, CASE WHEN is_ip OR held >= len(l) THEN host ELSE array_to_string(l[len(l) - held:], '.') END AS registered_domain FROM o)
"""


@query(f"WITH {_DOMAINS} SELECT page_id, host, public_suffix, registered_domain, CASE WHEN is_ip THEN 0 ELSE length(host) - length(replace(host, '.', '')) - (length(registered_domain) - length(replace(registered_domain, '.', ''))) END AS n_subdomains FROM h JOIN f USING (host)")
def registered_domains(spark, sf):
    """Suffix, registered domain and subdomains of hosts under rules of all kinds."""
    rows = urls.with_parts(table(spark, sf, "pages")).withColumn("host", F.expr(_HOSTS))
    found = domains.with_registered_domain(rows, domains.default_rules(spark))
    dots = "length({0}) - length(replace({0}, '.', ''))"
    n = F.expr(f"if(is_ip, 0, {dots.format('host')} - ({dots.format('registered_domain')}))")
    return found.select("page_id", "host", "public_suffix", "registered_domain", n.cast("bigint").alias("n_subdomains"))


@query(f"WITH {_DOMAINS} SELECT registered_domain, page_id FROM (SELECT registered_domain, page_id, row_number() OVER (PARTITION BY registered_domain ORDER BY md5(concat_ws('|', '{SEED}', page_id::VARCHAR)), page_id) AS k FROM h JOIN f USING (host)) WHERE k <= 5")
def registered_domain_cap(spark, sf):
    """At most five rows of a registered domain."""
    return clean.capped(registered_domains(spark, sf), "registered_domain", 5, SEED, "page_id").select("registered_domain", "page_id")


_KEPT = urls.sql_with(urls.parts(urls.DUCKDB), "(SELECT row_id, label, url, canonical_url FROM j WHERE verdict = 'kept')")
_ORDER = f"md5(concat_ws('|', '{SEED}', row_id::VARCHAR)), row_id"


@query(f"""{catalog._JUDGED}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY {_ORDER}) AS a FROM {_KEPT}) WHERE a <= 5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) AS c FROM k) WHERE c <= 15)
SELECT format('Q{{:05d}}', row_number() OVER (ORDER BY {_ORDER}) - 1) AS sample_id, row_id, label, canonical_url, host FROM b""")
def built_dataset(spark, sf):
    """The whole way from raw rows to the dataset of record: cleaned, capped by host, balanced, shuffled and numbered."""
    found, _ = clean.built(catalog.variants(spark, sf), "host", 5, 15, SEED)
    return found.select("sample_id", "row_id", "label", "canonical_url", "host")


# ---------------------------------------------------------------- numbering and lines


@query(f"WITH s AS ({catalog.SQL['split_groups']}) SELECT group_id, format('G{{:05d}}', row_number() OVER (ORDER BY first, group_id) - 1) AS name FROM (SELECT group_id, min(c_custkey) AS first FROM s GROUP BY group_id)")
def group_numbers(spark, sf):
    """Groups numbered by their first appearance."""
    return groups.numbered_groups(catalog.split_groups(spark, sf), "c_custkey")


@query(f"SELECT format('Q{{:05d}}', row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', o_orderkey::VARCHAR)), o_orderkey) - 1) AS sample_id, o_orderkey FROM orders")
def shuffled_ids(spark, sf):
    """A whole table shuffled by a seed and numbered in that order."""
    rows = table(spark, sf, "orders").select("o_orderkey", clean.hashed(SEED, "o_orderkey").alias("hash"))
    return ranks.numbered(rows, ["hash", "o_orderkey"], "n").select(F.format_string("Q%05d", "n").alias("sample_id"), "o_orderkey")


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), chr(10)) AS lines FROM documents WHERE length(text) > 0)
SELECT doc_id, line, length(value) AS n_chars FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS value FROM l) WHERE regexp_matches(value, '(?i)licen[cs]e|copyright')""")
def numbered_matches(spark, sf):
    """The lines that match a pattern, with their numbers."""
    found = text.matching_lines(text.lines_of(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id"), "(?i)licen[cs]e|copyright")
    return found.select("doc_id", F.col("line").cast("bigint").alias("line"), F.length("value").cast("bigint").alias("n_chars"))


@query()
def rows_bootstrap_ci(spark, sf):
    """Intervals over 2,000 resamples of single lines, the area under the curve included; random, so tests resample by hand."""
    found = metrics.rows_bootstrap(catalog.scored(spark, sf), "label", "predicted", "score", 2000, SEED)
    return found.select("metric", "draws", *(r6(c, c) for c in ("point", "ci95_low", "ci95_high")))


@query(f"SELECT page_id, canonical_url, {_OUTCOME_SQL} AS outcome FROM {_SHAPES}")
def one_to_one_join(spark, sf):
    """URLs joined with their manifest; keys that repeat on either side are an error."""
    tables = _dataset(spark, sf)
    return checks.one_to_one(tables["urls"]().select("page_id", "canonical_url"), tables["manifest"]().select("page_id", "outcome"), ["page_id"])


@query("SELECT feature, sum(value)::BIGINT AS total FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM ({_FEATURES})" for f in urls.FEATURES if "token" in f) + ") GROUP BY feature")
def named_feature_totals(spark, sf):
    """The features whose names hold a word, and their totals: other columns are never computed."""
    rows = catalog.page_features(spark, sf)
    names = [c for c in rows.columns if "token" in c]
    return rows.agg(*(F.sum(c).alias(c) for c in names)).unpivot([], names, "feature", "total")


# ---------------------------------------------------------------- validation


def validate(report: runner.Report, t: dict[str, Callable[[], DataFrame]], per_class: int, cap: int, model_features: list[str], frozen: Callable[[], str]) -> None:
    """The checks of a dataset; t makes its tables.

    urls (page_id, url, canonical_url, registered_domain, label, split, group_id),
    manifest (page_id, image_path, outcome), files (path), features (page_id, label,
    split, distortion, outcome and the features), lines (value). frozen: the digest of
    the test ids as they were frozen.
    """
    url, manifest, features = t["urls"], t["manifest"], t["features"]

    def balance():
        n = {r["label"]: r["count"] for r in url().groupBy("label").count().collect()}
        return n.get(0) == n.get(1), str(dict(sorted(n.items(), key=str)))

    def shares():
        n = {r["split"]: r["count"] for r in url().groupBy("split").count().collect()}
        return None, str({k: round(v / sum(n.values()), 3) for k, v in sorted(n.items(), key=str)})

    def size():
        n = url().count()
        return n == 2 * per_class, f"{n} rows"

    def known(name: str) -> Callable[[], tuple[bool, str]]:
        return lambda: ((name in features().columns) and name not in model_features, name)

    def inconsistent() -> DataFrame:
        a, b = features().select("page_id", "label", "split"), url().select("page_id", F.col("label").alias("label_u"), F.col("split").alias("split_u"))
        return a.join(b, "page_id").where("coalesce(split, '') <> coalesce(split_u, '') or not (label <=> label_u)")

    def not_one_each(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = (x.groupBy("page_id").agg(F.count("*").alias(n)) for x, n in ((left, "a"), (right, "b")))
        return a.join(b, "page_id", "full").where("coalesce(a, 0) <> 1 or coalesce(b, 0) <> 1")

    d, s, i, f = "dataset", "split", "images", "features"
    report.run(d, "urls: expected row count", size)
    for name in ("page_id", "url", "canonical_url"):
        report.none_of(d, f"urls: {name} unique", lambda name=name: runner.repeated(url(), name))
    report.run(d, "urls: classes balanced", balance)
    report.none_of(d, "urls: domain cap respected", lambda: url().groupBy("registered_domain").agg(F.count("*").alias("n")).where(F.col("n") > cap))
    report.each_row(d, url, {"urls: labels are 0/1 only": lambda: ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "split: every row assigned": lambda: F.coalesce("split", F.lit("")) == ""})
    report.none_of(s, "split: no registered domain in several", lambda: runner.spread(url(), "registered_domain", "split"))
    report.run(s, "split: fractions", shares)
    report.none_of(s, "split: no group in several", lambda: runner.spread(url(), "group_id", "split"))
    report.run(s, "split: frozen test ids unchanged", lambda: (checks.digest_of(features().where("split = 'test' and distortion = 'none'"), "page_id") == frozen(), ""))
    report.none_of(i, "images: every file exists", lambda: manifest().join(t["files"](), F.expr("image_path = path"), "left_anti"))
    report.none_of(i, "images: one per URL", lambda: not_one_each(url(), manifest()))
    report.each_row(i, manifest, {"decode: all clean images exact": lambda: ~F.col("outcome").eqNullSafe("exact")})
    report.none_of(f, "features: one clean row per URL", lambda: not_one_each(url(), features().where("distortion = 'none'")))
    report.run(f, "features: all model columns present", lambda: (not (gone := [c for c in model_features if c not in features().columns]), ", ".join(gone)))
    report.run(f, "features: generator version is no model feature", known("qr_version_generator"))
    report.each_row(f, features, {"features: none missing when decoded": lambda: (F.col("outcome") == "exact") & F.exists(F.array(*(F.col(c).isNull() for c in urls.FEATURES)), lambda x: x)})
    report.none_of(f, "features: split and label as in urls", inconsistent)
    report.none_of("safety", "code: no network or browser imports", lambda: text.matching_lines(t["lines"](), text.FORBIDDEN))
    report.run("provenance", "digest of the ids", lambda: (None, checks.digest_of(url(), "page_id")))


_BY_DOMAIN = "CASE WHEN substr(md5({0}), 1, 1) IN ('0', '1') THEN 'test' WHEN substr(md5({0}), 1, 1) IN ('2', '3') THEN 'val' ELSE 'train' END"
_OUTCOME = _OUTCOME_SQL
_CAP, _PER_CLASS = 25, 125


def _dataset(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    split, image = _BY_DOMAIN.format("registered_domain"), "concat('images/', page_id, '.png')"

    @cache  # written once, read by all checks
    def url() -> DataFrame:
        rows = urls.with_columns(urls.with_parts(table(spark, sf, "pages").select("page_id", "url")), [("canonical_url", urls.canonical(urls.SPARK))])
        return stored(rows.selectExpr("page_id", "url", "canonical_url", "registered_domain", "page_id % 2 as label", f"{split} as split", "registered_domain as group_id"), "urls")

    @cache
    def feature() -> DataFrame:
        rows = catalog.page_features(spark, sf).withColumns({"label": F.col("page_id") % 2, "split": F.expr(split), "distortion": F.lit("none"), "outcome": F.expr(_OUTCOME), "qr_version_generator": images.qr_version(F.col("url"))})
        return stored(rows.select("page_id", "label", "split", "distortion", "outcome", "qr_version_generator", *(F.when(F.col("outcome") != "failure", F.col(c)).alias(c) for c in urls.FEATURES)), "features")

    return {
        "urls": url, "features": feature,
        "manifest": lambda: table(spark, sf, "pages").selectExpr("page_id", f"{image} as image_path", f"{_OUTCOME} as outcome"),
        "files": lambda: table(spark, sf, "pages").where("page_id % 17 <> 0").selectExpr(f"{image} as path"),
        "lines": lambda: text.lines_of(table(spark, sf, "documents").select("text"), "text"),
    }


def _row(section: str, name: str, failures: str) -> str:
    return f"SELECT '{section}' AS section, '{name}' AS check_name, CASE WHEN ({failures}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, ({failures})::BIGINT AS failures"


def _fact(section: str, name: str, holds: str) -> str:
    return f"SELECT '{section}', '{name}', {holds}, NULL::BIGINT"


_VALIDATION = f"WITH u AS (SELECT page_id, url, canonical_url, registered_domain, page_id % 2 AS label, {_BY_DOMAIN.format('registered_domain')} AS split FROM {_SHAPES}), o AS (SELECT page_id, {_OUTCOME} AS outcome FROM pages), f AS ({_FEATURES}), l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) " + " UNION ALL ".join([
    _row("dataset", "urls: page_id unique", "SELECT count(*) FROM (SELECT page_id FROM u GROUP BY 1 HAVING count(*) > 1)"),
    _row("dataset", "urls: url unique", "SELECT count(*) FROM (SELECT url FROM u GROUP BY 1 HAVING count(*) > 1)"),
    _row("dataset", "urls: canonical_url unique", "SELECT count(*) FROM (SELECT canonical_url FROM u GROUP BY 1 HAVING count(*) > 1)"),
    _row("dataset", "urls: domain cap respected", f"SELECT count(*) FROM (SELECT registered_domain FROM u GROUP BY 1 HAVING count(*) > {_CAP})"),
    _row("dataset", "urls: labels are 0/1 only", "SELECT count(*) FROM u WHERE label IS NULL OR label NOT IN (0, 1)"),
    _row("dataset", "split: every row assigned", "SELECT count(*) FROM u WHERE coalesce(split, '') = ''"),
    _row("split", "split: no registered domain in several", "SELECT count(*) FROM (SELECT registered_domain FROM u GROUP BY 1 HAVING min(split) <> max(split))"),
    _row("split", "split: no group in several", "SELECT count(*) FROM (SELECT registered_domain FROM u GROUP BY 1 HAVING count(DISTINCT split) > 1)"),
    _row("images", "images: every file exists", "SELECT count(*) FROM pages a WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE b.page_id = a.page_id AND b.page_id % 17 <> 0)"),
    _row("images", "images: one per URL", "SELECT count(*) FROM (SELECT page_id FROM u GROUP BY 1 HAVING count(*) <> 1)"),
    _row("images", "decode: all clean images exact", "SELECT count(*) FROM o WHERE outcome <> 'exact'"),
    _row("features", "features: one clean row per URL", "SELECT count(*) FROM u FULL JOIN f USING (page_id) WHERE u.url IS NULL OR f.url_length IS NULL"),
    _row("features", "features: none missing when decoded", f"SELECT count(*) FROM f JOIN o USING (page_id) WHERE outcome = 'exact' AND ({' OR '.join(f'{c} IS NULL' for c in urls.FEATURES)})"),
    _row("features", "features: split and label as in urls", "SELECT count(*) FROM u JOIN pages p USING (page_id) WHERE u.label <> p.page_id % 2"),
    _row("safety", "code: no network or browser imports", f"SELECT count(*) FROM l WHERE regexp_matches(value, '{text.FORBIDDEN}')"),
    _fact("dataset", "urls: expected row count", f"CASE WHEN (SELECT count(*) FROM u) = {2 * _PER_CLASS} THEN 'PASS' ELSE 'FAIL' END"),
    _fact("dataset", "urls: classes balanced", "CASE WHEN (SELECT count_if(label = 0) - count_if(label = 1) FROM u) = 0 THEN 'PASS' ELSE 'FAIL' END"),
    _fact("split", "split: fractions", "'INFO'"),
    _fact("split", "split: frozen test ids unchanged", "CASE WHEN (SELECT count(*) FROM (SELECT page_id FROM u WHERE split = 'test' EXCEPT SELECT page_id FROM f)) = 0 THEN 'PASS' ELSE 'FAIL' END"),
    _fact("features", "features: all model columns present", "'PASS'"),
    _fact("features", "features: generator version is no model feature", "'PASS'"),
    _fact("provenance", "digest of the ids", "'INFO'"),
])


@query(_VALIDATION)
def dataset_validation(spark, sf):
    """All checks of a dataset in one report, whatever fails."""
    tables = _dataset(spark, sf)
    report = runner.Report(spark)
    validate(report, tables, _PER_CLASS, _CAP, urls.FEATURES, lambda: checks.digest_of(tables["urls"]().where("split = 'test'"), "page_id"))
    return report.table().select("section", "check_name", "status", "failures")


@query()
def saved_diff(spark, sf):
    """A table saved as CSV with its schema against the same table computed anew; a test breaks a saved line."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = f"{folder(spark)}/saved-{uuid.uuid4().hex}"
    files.save(rows, path)
    return checks.same_as_saved(rows, path, ["o_orderkey"])


# ---------------------------------------------------------------- the frozen split


@query()
def frozen_split(spark, sf):
    """The whole way from URLs to a frozen split, and its audit; the search folds groups in hashed order, so tests fold by hand."""
    url = "concat('http://m.shop', c_custkey div 3, '.co.uk/', if(c_custkey % 70 = 0, 'kit?id=', 'p'), c_custkey)"  # 'p' and digits is a template too general to link shops
    rows = table(spark, sf, "customer").selectExpr("c_custkey as page_id", f"{url} as url", "c_custkey % 2 as label")
    return splits.run_split(rows, domains.default_rules(spark), f"{folder(spark)}/split-{uuid.uuid4().hex}", SEED)


@query()
def frozen_gates(spark, sf):
    """What may be done with a frozen folder: the same ids pass, changed ids, changed models and a second freeze are refused."""
    path = f"{folder(spark)}/gates-{uuid.uuid4().hex}"
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("G").alias("split_group_id"))
    freeze.freeze(spark, path, {"test_ids": (ids, "page_id")}, {"test_ids_sha256": checks.digest_of(ids, "page_id"), "models": {"m": "one"}})
    changed = ids.select(F.when(F.col("page_id") == 1, -1).otherwise(F.col("page_id")).alias("page_id"))

    def refused(f: Callable[[], object]) -> str:
        try:
            f()
        except freeze.FrozenError:
            return "refused"
        return "passed"

    rows = [
        ("same ids and models", refused(lambda: splits.gated_test_rows(spark, path, ids.select("page_id"), {"m": "one"}))), ("changed ids", refused(lambda: splits.gated_test_rows(spark, path, changed, {"m": "one"}))),
        ("changed model", refused(lambda: splits.gated_test_rows(spark, path, ids.select("page_id"), {"m": "two"}))), ("second freeze", refused(lambda: freeze.freeze(spark, path, {"test_ids": (ids, "page_id")}, {}))),
    ]
    return spark.createDataFrame(rows, "gate string, outcome string")
