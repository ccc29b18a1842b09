"""The named queries of the URL engine, each with its SQL twin where SQL can say it.

Fixtures are the driver's tables: pages for URLs (label: page_id % 2), lineitem
for scores (quantity / 50, label: returned), customers for the split graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import checks, clean, explain, groups, images, metrics, ranks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# ---------------------------------------------------------------- URLs

_PARTS = urls.sql_with(urls.parts(urls.DUCKDB), "pages")
_NAMES = [n for n, _ in urls.parts(urls.SPARK)]


@query(f"SELECT page_id, {', '.join(_NAMES)} FROM {_PARTS}")
def url_parts(spark, sf):
    return urls.with_parts(table(spark, sf, "pages")).select("page_id", *_NAMES)


_SHAPES = urls.sql_with([("canonical_url", urls.canonical(urls.DUCKDB)), ("url_template", urls.template(urls.DUCKDB))], _PARTS)


@query(f"SELECT page_id, canonical_url, url_template, cast({urls.nontrivial()} AS INT) AS nontrivial, {', '.join(f'{e} AS {n}' for n, e in urls.shape_flags())} FROM {_SHAPES}")
def url_canonical(spark, sf):
    rows = urls.with_columns(urls.with_parts(table(spark, sf, "pages")), [("canonical_url", urls.canonical(urls.SPARK)), ("url_template", urls.template(urls.SPARK))])
    return rows.select("page_id", "canonical_url", "url_template", F.expr(f"cast({urls.nontrivial()} as int)").alias("nontrivial"), *(F.expr(e).alias(n) for n, e in urls.shape_flags()))


_FEATURES = f"SELECT page_id, host, scheme, {', '.join(f'{e} AS {n}' for n, e in urls.features(urls.DUCKDB))} FROM {_PARTS}"


def page_features(spark, sf) -> DataFrame:
    return urls.with_features(urls.with_parts(table(spark, sf, "pages").select("page_id", "url")))


@query(f"SELECT page_id, {', '.join(f'round({n}, 6) AS {n}' if n in ('url_digit_ratio', 'url_entropy') else n for n in urls.FEATURES)} FROM ({_FEATURES})")
def url_features_30(spark, sf):
    return page_features(spark, sf).select("page_id", *(r6(n, n) if n in ("url_digit_ratio", "url_entropy") else F.col(n) for n in urls.FEATURES))


_SUMMED = urls.FEATURES


@query(" UNION ALL ".join(f"SELECT scheme, '{n}' AS feature, round(median({n})::DOUBLE, 6) AS median, round(min({n})::DOUBLE, 6) AS least, round(max({n})::DOUBLE, 6) AS most FROM ({_FEATURES}) GROUP BY scheme" for n in _SUMMED))
def url_feature_summary(spark, sf):
    long = page_features(spark, sf).select("scheme", *(F.col(n).cast("double").alias(n) for n in _SUMMED)).unpivot(["scheme"], _SUMMED, "feature", "value")
    per = long.groupBy("scheme", "feature").agg(r6(F.min("value"), "least"), r6(F.max("value"), "most"))
    return ranks.with_quantiles(per, long, ["scheme", "feature"], "value", {"median": 0.5}).withColumn("median", F.round("median", 6)).select("scheme", "feature", "median", "least", "most")


_PAYLOADS = "(SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN url || ' x' WHEN 2 THEN 'mailto:a@b.c' WHEN 3 THEN url || repeat('a', 2000) WHEN 4 THEN 'http://' ELSE url END AS payload FROM pages)"


@query(f"SELECT page_id, length(payload) AS n, {urls.triage(urls.DUCKDB)} AS kind FROM {urls.sql_with(urls.parts(urls.DUCKDB, 'payload'), _PAYLOADS)}")
def payload_triage(spark, sf):
    payload = F.expr("CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN url || ' x' WHEN 2 THEN 'mailto:a@b.c' WHEN 3 THEN url || repeat('a', 2000) WHEN 4 THEN 'http://' ELSE url END")
    rows = urls.with_parts(table(spark, sf, "pages").select("page_id", payload.alias("payload")), "payload")
    return rows.select("page_id", F.length("payload").cast("bigint").alias("n"), F.expr(urls.triage(urls.SPARK)).alias("kind"))


# ---------------------------------------------------------------- cleaning and sampling

_VARIANTS = """(SELECT page_id * 6 + k AS row_id, CASE WHEN k = 4 AND page_id % 7 = 0 THEN 1 - page_id % 2 ELSE page_id % 2 END AS label,
  CASE k WHEN 1 THEN concat(upper(split_part(url, '/', 1)), '//', upper(split_part(url, '/', 3)), substr(url, 1 + length(split_part(url, '/', 1)) + 2 + length(split_part(url, '/', 3))))
         WHEN 2 THEN concat('  ', url, ' ') WHEN 3 THEN CASE WHEN page_id % 11 = 0 THEN concat(url, ' x') WHEN page_id % 13 = 0 THEN '' ELSE concat(url, repeat('y', CAST(page_id % 3 AS INT) * 1000)) END
         ELSE url END AS url
  FROM pages, (SELECT unnest(range(0, 5)) AS k))"""


def variants(spark, sf) -> DataFrame:
    """Labelled rows with copies that differ in case and padding, contradictions, blanks and overlong URLs."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(F.expr("sequence(0, 4)")).alias("k"))
    head = "length(split_part(url, '/', 1)) + 2 + length(split_part(url, '/', 3))"
    return rows.selectExpr(
        "page_id * 6 + k as row_id",
        "cast(case when k = 4 and page_id % 7 = 0 then 1 - page_id % 2 else page_id % 2 end as bigint) as label",
        f"""case k when 1 then concat(upper(split_part(url, '/', 1)), '//', upper(split_part(url, '/', 3)), substr(url, 1 + {head}))
                   when 2 then concat('  ', url, ' ') when 3 then case when page_id % 11 = 0 then concat(url, ' x') when page_id % 13 = 0 then '' else concat(url, repeat('y', cast(page_id % 3 as int) * 1000)) end
                   else url end as url""",
    )


_JUDGED = f"""
WITH v AS (SELECT row_id, label, trim(url) AS url FROM {_VARIANTS}),
c AS (SELECT *, {urls.canonical(urls.DUCKDB)} AS canonical_url, (url IN ('', 'nan', 'None') OR regexp_matches(url, '\\s')) AS bad FROM {urls.sql_with(urls.parts(urls.DUCKDB), 'v')}),
u AS (SELECT *, (NOT bad AND length(url) <= 2000) AS usable FROM c),
w AS (SELECT *, min(label) OVER a <> max(label) OVER a AS contrary, min(row_id) OVER a AS first, min(row_id) OVER (PARTITION BY usable, canonical_url, url) AS first_same FROM u WINDOW a AS (PARTITION BY usable, canonical_url)),
j AS (SELECT row_id, label, url, canonical_url, CASE WHEN bad THEN 'empty_or_whitespace' WHEN NOT usable THEN 'over_2000_chars' WHEN contrary THEN 'conflicting_label'
  WHEN first_same <> row_id THEN 'exact_duplicate' WHEN first <> row_id THEN 'canonical_duplicate' ELSE 'kept' END AS verdict FROM w)
"""


@query(_JUDGED + "SELECT verdict, count(*) AS n, count_if(label = 1)::BIGINT AS n_malicious FROM j GROUP BY verdict")
def clean_drop_report(spark, sf):
    return clean.drop_report(clean.judged(variants(spark, sf)))


@query(_JUDGED + "SELECT row_id, label, url, canonical_url FROM j WHERE verdict = 'kept'")
def clean_rows(spark, sf):
    return clean.judged(variants(spark, sf)).where("verdict = 'kept'").select("row_id", "label", "url", "canonical_url")


@query(f"SELECT page_id, host FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY md5(concat_ws('|', '{SEED}', page_id::VARCHAR)), page_id) AS n FROM {_PARTS}) WHERE n <= 5")
def domain_cap(spark, sf):
    return clean.capped(urls.with_parts(table(spark, sf, "pages")), "host", 5, SEED, "page_id").select("page_id", "host")


@query(f"SELECT format('Q{{:05d}}', row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', page_id::VARCHAR)), page_id) - 1) AS sample_id, page_id, label FROM (SELECT page_id, page_id % 2 AS label, row_number() OVER (PARTITION BY page_id % 2 ORDER BY md5(concat_ws('|', '{SEED}', page_id::VARCHAR)), page_id) AS n FROM pages) WHERE n <= 20")
def balanced_sample(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 2).alias("label"))
    some = clean.balanced(rows, 20, SEED, "page_id")  # 40 rows are numbered
    return some.select(F.format_string("Q%05d", F.row_number().over(Window.orderBy(clean.hashed(SEED, "page_id"), "page_id")) - 1).alias("sample_id"), "page_id", "label")


@query(f"SELECT count(*) AS n_domains, max(n) AS largest, count_if(n >= 5)::BIGINT AS with_5_plus FROM (SELECT host, count(*) AS n FROM {_PARTS} GROUP BY host)")
def domain_concentration(spark, sf):
    per = urls.with_parts(table(spark, sf, "pages")).groupBy("host").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_domains"), F.max("n").alias("largest"), F.count_if(F.col("n") >= 5).alias("with_5_plus"))


@query(f"SELECT url_template, count(*) AS n_urls, count_if(page_id % 2 = 0)::BIGINT AS n_benign, count_if(page_id % 2 = 1)::BIGINT AS n_malicious, CASE WHEN count(*) > 30 THEN 'reported_generic_not_merged' ELSE 'merged' END AS action FROM {_SHAPES} WHERE {urls.nontrivial()} GROUP BY url_template HAVING count(*) >= 3")
def template_report(spark, sf):
    rows = urls.with_columns(urls.with_parts(table(spark, sf, "pages")), [("url_template", urls.template(urls.SPARK))]).where(urls.nontrivial())
    label = F.col("page_id") % 2
    per = rows.groupBy("url_template").agg(F.count("*").alias("n_urls"), F.count_if(label == 0).alias("n_benign"), F.count_if(label == 1).alias("n_malicious")).where("n_urls >= 3")
    return per.withColumn("action", F.when(F.col("n_urls") > 30, "reported_generic_not_merged").otherwise("merged"))


@query(f"""WITH l AS (SELECT length(url) AS n, page_id % 2 AS label, scheme, path, query FROM {_PARTS}),
r AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS k FROM l),
a AS (SELECT (sum(CASE WHEN label = 1 THEN k END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1) * count_if(label = 0)) AS auc FROM r)
SELECT label, count(*) AS n, median(n)::DOUBLE AS median_length, quantile_cont(n, 0.25)::DOUBLE AS q1, quantile_cont(n, 0.75)::DOUBLE AS q3,
 round(avg((scheme = 'https')::INT), 6) AS share_https, round(avg((query <> '')::INT), 6) AS share_query, (SELECT round(greatest(auc, 1 - auc), 6) FROM a) AS length_only_auc FROM l GROUP BY label""")
def dataset_audit(spark, sf):
    rows = urls.with_parts(table(spark, sf, "pages")).withColumns({"n": F.length("url"), "label": F.col("page_id") % 2})
    area = metrics.auc(rows, "label", "n").select(F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("length_only_auc"))
    per = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        r6(F.avg((F.col("scheme") == "https").cast("int")), "share_https"), r6(F.avg((F.col("query") != "").cast("int")), "share_query"),
    )
    per = ranks.with_quantiles(per, rows, ["label"], "n", {"median_length": 0.5, "q1": 0.25, "q3": 0.75})
    return per.crossJoin(F.broadcast(area)).select("label", per["n"], "median_length", "q1", "q3", "share_https", "share_query", "length_only_auc")  # one row


@query("""SELECT label, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM
 (SELECT page_id % 2 AS label, least(49, greatest(0, floor(50 * ln(length(url) / 5.0) / ln(400.0))))::BIGINT AS bin FROM pages) GROUP BY label, bin""")
def length_histogram(spark, sf):
    number = F.least(F.lit(49), F.greatest(F.lit(0), F.floor(50 * F.log(F.length("url") / 5.0) / F.log(F.lit(400.0))))).cast("bigint")
    per = table(spark, sf, "pages").groupBy((F.col("page_id") % 2).alias("label"), number.alias("bin")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


# ---------------------------------------------------------------- joins


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def inner_join(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'O'"), F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def three_way_join(spark, sf):
    per = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))
    named = per.join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return named.select("r_name", "n_name", "n", F.round("balance", 2).alias("balance"))


_SEGMENTS = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3}


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 0 END AS code FROM customer")
def lookup_join(spark, sf):
    code = F.create_map(*(F.lit(x) for k, v in _SEGMENTS.items() for x in (k, v)))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.try_element_at(code, "c_mktsegment"), F.lit(0)).alias("code"))


@query(f"SELECT n_nationkey, type, severity, value, concat_ws('__', n_name, type, severity) AS qr_id FROM nation, (VALUES {', '.join(str(g) for g in images.GRID)}) g(type, severity, value)")
def cross_grid(spark, sf):
    grid = spark.createDataFrame(images.GRID, "type string, severity string, value double")
    return table(spark, sf, "nation").crossJoin(F.broadcast(grid)).select("n_nationkey", "type", "severity", "value", F.concat_ws("__", "n_name", "type", "severity").alias("qr_id"))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def pair_join(spark, sf):
    n = table(spark, sf, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT count(*) AS n, count_if(a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)::BIGINT AS n_changed FROM orders a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) b USING (o_orderkey)")
def consistency_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    return o.join(changed, "o_orderkey").agg(F.count("*").alias("n"), F.count_if(~F.col("o_orderstatus").eqNullSafe(F.col("status"))).alias("n_changed"))


# ---------------------------------------------------------------- aggregation, windows, order, sets


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS n_suppliers, count_if(l_discount > 0.05)::BIGINT AS n_discounted FROM lineitem GROUP BY ALL")
def group_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"))


@query("SELECT l_returnflag, count_if(l_linestatus = 'O')::BIGINT AS o_lines, count_if(l_linestatus = 'F')::BIGINT AS f_lines FROM lineitem GROUP BY l_returnflag")
def pivot_counts(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().na.fill(0)
    return p.select("l_returnflag", F.col("O").alias("o_lines"), F.col("F").alias("f_lines"))


@query("SELECT l_returnflag, median(l_extendedprice) AS median_price, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, min(l_tax) AS least, max(l_tax) AS most, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY l_returnflag")
def group_quantiles(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_tax", "l_quantity")
    per = rows.groupBy("l_returnflag").agg(F.min("l_tax").alias("least"), F.max("l_tax").alias("most"), r6(F.stddev_pop("l_quantity"), "std"))
    found = ranks.with_quantiles(per, rows, ["l_returnflag"], "l_extendedprice", {"median_price": 0.5, "q1": 0.25, "q3": 0.75})
    return found.select("l_returnflag", "median_price", "q1", "q3", "least", "most", "std")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderpriority")
def share_of_total(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a few rows


@query("SELECT max(abs(o_totalprice - p)) AS max_abs_diff FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def max_abs_diff(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("p"))
    return table(spark, sf, "orders").join(sums, "o_orderkey").agg(F.max(F.abs(F.col("o_totalprice") - F.col("p"))).alias("max_abs_diff"))


@query("SELECT kind, o_orderkey, o_totalprice FROM ((SELECT 'top' AS kind, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'bottom' AS kind, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10))")
def top_k_errors(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select(F.lit("top").alias("kind"), "*")
    return top.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(10).select(F.lit("bottom").alias("kind"), "*"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = (n - 1) // 2 + 1")
def lower_median_pick(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    values = ranks.running_by(o.groupBy("o_orderpriority", "o_totalprice").agg(F.count("*").alias("n")), ["o_orderpriority"], "o_totalprice", ["n"])
    held = values.where("below_n <= (all_n - 1) div 2 and (all_n - 1) div 2 < below_n + n").selectExpr("o_orderpriority", "o_totalprice", "(all_n - 1) div 2 - below_n + 1 as place")
    tied = o.join(F.broadcast(held), ["o_orderpriority", "o_totalprice"])  # one row a group
    return tied.withColumn("k", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))).where("k = place").select("o_orderpriority", "o_orderkey")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def top_abs_per_group(spark, sf):
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.abs(F.col("c_acctbal")).desc(), "c_custkey"))
    return table(spark, sf, "customer").withColumn("k", k).where("k <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS highest_so_far FROM orders")
def running_max(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(w).alias("highest_so_far"))


@query("SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_right")
def set_equality(spark, sf):
    a, b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).distinct(), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


# ---------------------------------------------------------------- metrics

_SCORED = "(SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS score, (l_returnflag = 'R')::BIGINT AS label, (l_quantity >= 25)::BIGINT AS predicted, l_suppkey, l_linestatus, l_returnflag FROM lineitem)"
_RATES = "round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr"
_RATE_NAMES = ("accuracy", "precision", "recall", "f1", "fpr")
_COUNTS = "count_if(label = 1 AND predicted = 1)::BIGINT AS tp, count_if(label = 0 AND predicted = 1)::BIGINT AS fp, count_if(label = 0 AND predicted = 0)::BIGINT AS tn, count_if(label = 1 AND predicted = 0)::BIGINT AS fn"


def scored(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity / 50.0 as score", "cast(l_returnflag = 'R' as bigint) as label", "cast(l_quantity >= 25 as bigint) as predicted", "l_suppkey", "l_linestatus", "l_returnflag"
    )


@query(f"SELECT l_linestatus, tp, fp, tn, fn, {_RATES} FROM (SELECT l_linestatus, {_COUNTS} FROM {_SCORED} GROUP BY l_linestatus)")
def confusion_metrics(spark, sf):
    c = metrics.confusion(scored(spark, sf), "label", "predicted", "l_linestatus")
    return c.select("l_linestatus", "tp", "fp", "tn", "fn", *(r6(n, n) for n in _RATE_NAMES))


_SWEEP = f"""(SELECT t AS threshold, (p - bp)::BIGINT AS tp, (n - bn - p + bp)::BIGINT AS fp, (bn - bp)::BIGINT AS tn, bp::BIGINT AS fn FROM
 (SELECT t, (SELECT count(*) FROM {_SCORED}) AS n, (SELECT sum(label) FROM {_SCORED}) AS p, coalesce(sum(c) OVER w, 0) AS bn, coalesce(sum(k) OVER w, 0) AS bp FROM
  (SELECT t, sum(c) AS c, sum(k) AS k FROM (SELECT score AS t, count(*) AS c, sum(label) AS k FROM {_SCORED} GROUP BY score UNION ALL SELECT 0.5, 0, 0) GROUP BY t)
  WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query(f"SELECT threshold, tp, fp, tn, fn, {_RATES} FROM {_SWEEP}")
def threshold_sweep(spark, sf):
    return metrics.sweep(scored(spark, sf), "label", "score").select("threshold", "tp", "fp", "tn", "fn", *(r6(n, n) for n in _RATE_NAMES))


@query(f"""WITH r AS (SELECT round(threshold, 6) AS threshold, {_RATES.replace(', 6)', ', 4)')} FROM {_SWEEP}),
f AS (SELECT *, recall >= 0.9 AND fpr <= 0.5 AS ok FROM r)
SELECT CASE WHEN ok THEN 'target met' ELSE 'fallback: best F1' END AS rule, threshold, f1, recall, precision, fpr FROM f
ORDER BY ok DESC, CASE WHEN ok THEN threshold ELSE f1 END DESC, threshold DESC LIMIT 1""")
def choose_threshold(spark, sf):
    return metrics.choose_threshold(metrics.sweep(scored(spark, sf), "label", "score"))


@query(f"SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share_positive FROM {_SCORED} GROUP BY 1")
def calibration_bins(spark, sf):
    return metrics.calibration(scored(spark, sf), "label", "score").select("bin", "n", r6("mean_score", "mean_score"), r6("share_positive", "share_positive"))


@query(f"SELECT (SELECT round(avg((score - label) ** 2), 6) FROM {_SCORED}) AS brier, (SELECT round(sum(n * abs(a - b)) / sum(n), 6) FROM (SELECT count(*) AS n, avg(score) AS a, avg(label) AS b FROM {_SCORED} GROUP BY least(floor(score * 10), 9))) AS ece")
def brier_ece(spark, sf):
    return metrics.brier_ece(scored(spark, sf), "label", "score").select(r6("brier", "brier"), r6("ece", "ece"))


@query(f"SELECT least(floor(score * 25), 24)::INT AS bin, label, count(*) AS n FROM {_SCORED} GROUP BY ALL")
def score_histogram(spark, sf):
    return scored(spark, sf).groupBy(F.least(F.floor(F.col("score") * 25), F.lit(24)).cast("int").alias("bin"), "label").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM {_SCORED})
SELECT count(*) AS n, round((sum(CASE WHEN label = 1 THEN k END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1) * count_if(label = 0)), 6) AS auc FROM r""")
def roc_auc(spark, sf):
    return metrics.auc(scored(spark, sf), "label", "score").select("n", r6("auc", "auc"))


_RHO = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT {_RHO.format('n_chars')} AS a, {_RHO.format('quality')} AS b FROM documents JOIN labels USING (doc_id))")
def spearman(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return metrics.spearman(rows, "n_chars", "quality").select("n", r6("spearman", "spearman"))


def rounded(f: str) -> str:
    """A feature in SQL; ratios are rounded, so that both engines find the same ties."""
    return f"round({f}, 9)" if f in ("url_digit_ratio", "url_entropy") else f


def rounded_features(spark, sf) -> DataFrame:
    return page_features(spark, sf).select("page_id", *(F.expr(f"cast({rounded(f)} as double)").alias(f) for f in urls.FEATURES))


_RANKED = f"SELECT {', '.join(f'{_RHO.format(rounded(f))} AS {f}' for f in urls.FEATURES)} FROM ({_FEATURES})"
_PAIRS = [(a, b) for i, a in enumerate(urls.FEATURES) for b in urls.FEATURES[i + 1 :]]
_RHO_OF = "CASE WHEN min({0}) < max({0}) AND min({1}) < max({1}) THEN round(corr({0}, {1}), 6) END"


@query(f"WITH r AS MATERIALIZED ({_RANKED}), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {_RHO_OF.format(a, b)} AS spearman FROM r" for a, b in _PAIRS) + ") SELECT *, coalesce(abs(spearman) <= 0.9, true) AS kept FROM c")
def feature_corr_table(spark, sf):
    """Rank correlations of all pairs of the features; those with a constant one have none, and are kept."""
    pairs = ranks.rank_correlations(rounded_features(spark, sf), "page_id", urls.FEATURES)
    return pairs.withColumn("spearman", F.round("spearman", 6)).withColumn("kept", F.coalesce(F.abs("spearman") <= 0.9, F.lit(True)))


_WILSON = "CASE WHEN {n} > 0 THEN round({f}({b}, ({k}/{n} + 1.9208/{n} {s} 1.96 * sqrt(({k}/{n}) * (1 - {k}/{n}) / {n} + 0.9604/({n}*{n}::DOUBLE))) / (1 + 3.8416/{n})), 6) END"


def _wilson(k: str, n: str) -> str:
    return f"round({k} / {n}, 6) AS exact_rate, {_WILSON.format(k=k, n=n, f='greatest', b='0', s='-')} AS exact_ci_low, {_WILSON.format(k=k, n=n, f='least', b='1', s='+')} AS exact_ci_high"


@query(f"SELECT l_suppkey, k, n, {_wilson('k', 'n')} FROM (SELECT l_suppkey, count(*) AS n, count_if(l_linestatus = 'O')::BIGINT AS k FROM lineitem GROUP BY l_suppkey)")
def wilson_rates(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("k"))
    return metrics.with_rate(per, "k", "n", "exact").select("l_suppkey", "k", "n", *(r6(c, c) for c in ("exact_rate", "exact_ci_low", "exact_ci_high")))


_MCNEMAR = """(SELECT l_shipmonth, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
  lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) END AS p FROM
 (SELECT month(l_shipdate)::INT AS l_shipmonth, count_if(l_quantity > 25 AND l_discount <= 0.05)::BIGINT AS b, count_if(l_quantity <= 25 AND l_discount > 0.05)::BIGINT AS c FROM lineitem GROUP BY 1))"""


def monthly_tests(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), (F.col("l_quantity") > 25).alias("a_right"), (F.col("l_discount") > 0.05).alias("b_right"))
    return metrics.mcnemar(rows, "l_shipmonth")


@query(f"SELECT l_shipmonth, b AS a_right_b_wrong, c AS a_wrong_b_right, round(p, 6) AS p_exact FROM {_MCNEMAR}")
def mcnemar_exact(spark, sf):
    return monthly_tests(spark, sf).withColumn("p_exact", F.round("p_exact", 6))


@query(f"SELECT l_shipmonth, round(max(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS p_holm FROM (SELECT l_shipmonth, k, least(1.0, (count(*) OVER () - k + 1) * p) AS s FROM (SELECT *, row_number() OVER (ORDER BY p, l_shipmonth) AS k FROM (SELECT l_shipmonth, round(p, 9) AS p FROM {_MCNEMAR})))")
def holm_adjust(spark, sf):
    return metrics.holm(monthly_tests(spark, sf).withColumn("p_exact", F.round("p_exact", 9)), "p_exact", "l_shipmonth").select("l_shipmonth", F.round("p_holm", 5).alias("p_holm"))


@query(SQL["mcnemar_exact"])
def mcnemar_exact_whole(spark, sf):
    """The name under which mcnemar_exact took all lines before it did so itself; tests compare it with exact integers."""
    return mcnemar_exact(spark, sf)


@query(SQL["holm_adjust"])
def holm_adjust_whole(spark, sf):
    """As mcnemar_exact_whole, for holm_adjust."""
    return holm_adjust(spark, sf)


def judged_lengths(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumn("predicted", (F.col("n_chars") >= 400).cast("bigint"))


#: As many resamples as the intervals of the reports take.
_DRAWS = 2000


@query(f"""WITH s AS (SELECT *, (n_chars >= 400)::BIGINT AS predicted, quality AS label FROM documents JOIN labels USING (doc_id)),
u AS (SELECT source, {_COUNTS} FROM s GROUP BY source),
m AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', source)), source) - 1 AS slot FROM u),
d AS (SELECT draw, ('0x' || substr(md5(concat_ws('|', '{SEED}', draw::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % (SELECT count(*) FROM u) AS slot FROM range({_DRAWS}) a(draw), (SELECT unnest(range(0, (SELECT count(*) FROM u))) AS k)),
c AS (SELECT draw, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM d JOIN m USING (slot) GROUP BY draw),
v AS (SELECT draw, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c),
l AS (SELECT 'precision' AS metric, precision AS x FROM v UNION ALL SELECT 'recall', recall FROM v UNION ALL SELECT 'f1', f1 FROM v)
SELECT metric, count(*) AS draws, round(quantile_cont(x, 0.025), 6) AS ci95_low, round(quantile_cont(x, 0.975), 6) AS ci95_high FROM l GROUP BY metric""")
def bootstrap_ci(spark, sf):
    """2,000 draws, as in its SQL; bootstrap_ci_whole adds the area under the curve."""
    return metrics.bootstrap(judged_lengths(spark, sf), "source", "quality", "predicted", _DRAWS, SEED).select("metric", "draws", r6("ci95_low", "ci95_low"), r6("ci95_high", "ci95_high"))


@query()
def bootstrap_ci_whole(spark, sf):
    """2,000 draws, with the area under the curve of the length; no SQL twin, tests resample by hand."""
    rows = judged_lengths(spark, sf)
    rates = metrics.bootstrap(rows, "source", "quality", "predicted", 2000, SEED)
    return rates.unionByName(metrics.bootstrap_auc(rows, "source", "quality", "n_chars", 2000, SEED)).select("metric", "draws", r6("ci95_low", "ci95_low"), r6("ci95_high", "ci95_high"))


@query("""WITH e AS (SELECT list_distinct(quantile_cont(n_chars, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges FROM documents)
SELECT bin, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT n_chars, greatest(1, len(list_filter(edges, lambda x: x < n_chars)))::INT AS bin FROM documents, e) GROUP BY bin""")
def quantile_bins(spark, sf):
    return metrics.quantile_bins(table(spark, sf, "documents").select("n_chars"), "n_chars", 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


_MATCHED = "SELECT *, min(k) OVER (PARTITION BY o) AS worst FROM (SELECT o, bin, least(count_if(quality = 0), count_if(quality = 1)) AS k FROM b GROUP BY o, bin)"


@query(f"""WITH s AS (SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
e AS (SELECT o, list_distinct(list_transform(range(0, o + 1), lambda i: (SELECT quantile_cont(n_chars, 0.5) FROM s WHERE false))) AS x FROM (VALUES (10), (8), (5)) t(o)),
q AS (SELECT 10 AS o, quantile_cont(n_chars, [i / 10.0 FOR i IN range(0, 11)]) AS edges FROM s UNION ALL SELECT 8, quantile_cont(n_chars, [i / 8.0 FOR i IN range(0, 9)]) FROM s UNION ALL SELECT 5, quantile_cont(n_chars, [i / 5.0 FOR i IN range(0, 6)]) FROM s),
b AS (SELECT o, doc_id, n_chars, quality, greatest(1, len(list_filter(list_distinct(edges), lambda x: x < n_chars)))::INT AS bin FROM s, q),
c AS ({_MATCHED}),
h AS (SELECT o FROM (SELECT DISTINCT o, worst FROM c) WHERE worst >= 5 OR o = 5 ORDER BY o DESC LIMIT 1),
r AS (SELECT b.*, c.k, row_number() OVER (PARTITION BY b.bin, quality ORDER BY md5(concat_ws('|', '{SEED}', doc_id::VARCHAR)), doc_id) AS n FROM b JOIN c ON b.o = c.o AND b.bin = c.bin WHERE b.o = (SELECT o FROM h) AND c.k >= 5)
SELECT doc_id, quality, bin, o::INT AS bins FROM r WHERE n <= k""".replace("e AS (SELECT o, list_distinct(list_transform(range(0, o + 1), lambda i: (SELECT quantile_cont(n_chars, 0.5) FROM s WHERE false))) AS x FROM (VALUES (10), (8), (5)) t(o)),\n", ""))
def length_matched(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return metrics.matched(rows, "n_chars", "quality", "doc_id", SEED).select("doc_id", "quality", "bin", "bins")


_OUTCOME = "CASE WHEN l_returnflag = 'N' THEN 'exact' WHEN l_returnflag = 'A' THEN 'mismatch' ELSE 'failure' END"


@query(f"""SELECT l_linestatus AS condition, attempted, round(exact / attempted, 6) AS exact_rate, round(mismatch / attempted, 6) AS mismatch_rate, round(failure / attempted, 6) AS failure_rate,
 exact_0::VARCHAR || '/' || n_0::VARCHAR AS exact_benign, exact_1::VARCHAR || '/' || n_1::VARCHAR AS exact_malicious, CASE WHEN least(exact_0, exact_1) >= 30 THEN 'ok' ELSE 'exploratory (<30/class)' END AS status,
 round(caught / nullif(n_1, 0), 6) AS e2e_recall FROM
 (SELECT l_linestatus, count(*) AS attempted, count_if(o = 'exact') AS exact, count_if(o = 'mismatch') AS mismatch, count_if(o = 'failure') AS failure, count_if(o = 'exact' AND y = 0) AS exact_0, count_if(y = 0) AS n_0,
  count_if(o = 'exact' AND y = 1) AS exact_1, count_if(y = 1) AS n_1, count_if(o = 'exact' AND y = 1 AND l_quantity >= 25) AS caught FROM (SELECT *, {_OUTCOME} AS o, l_orderkey % 2 AS y FROM lineitem) GROUP BY l_linestatus)""")
def robustness_summary(spark, sf):
    exact, y = F.col("o") == "exact", F.col("y") == 1
    rows = table(spark, sf, "lineitem").withColumns({"o": F.expr(_OUTCOME), "y": F.col("l_orderkey") % 2})
    per = rows.groupBy(F.col("l_linestatus").alias("condition")).agg(
        F.count("*").alias("attempted"), *(F.count_if(F.col("o") == o).alias(o) for o in ("exact", "mismatch", "failure")),
        F.count_if(exact & ~y).alias("exact_0"), F.count_if(~y).alias("n_0"), F.count_if(exact & y).alias("exact_1"), F.count_if(y).alias("n_1"), F.count_if(exact & y & (F.col("l_quantity") >= 25)).alias("caught"),
    )
    return per.select(
        "condition", "attempted", *(r6(F.col(o) / F.col("attempted"), f"{o}_rate") for o in ("exact", "mismatch", "failure")),
        F.concat_ws("/", "exact_0", "n_0").alias("exact_benign"), F.concat_ws("/", "exact_1", "n_1").alias("exact_malicious"),
        F.when(F.least("exact_0", "exact_1") >= 30, "ok").otherwise("exploratory (<30/class)").alias("status"), r6(F.try_divide("caught", "n_1"), "e2e_recall"),
    )


@query(f"""SELECT l_linestatus AS condition, band, y AS label, k, n, {_wilson('k', 'n')}, n < 10 AS sparse FROM
 (SELECT l_linestatus, CASE WHEN l_quantity <= 15 THEN 'v1-v3' WHEN l_quantity <= 30 THEN 'v4-v6' ELSE 'v7+' END AS band, l_orderkey % 2 AS y, count(*) AS n, count_if({_OUTCOME} = 'exact')::BIGINT AS k FROM lineitem GROUP BY ALL)""")
def band_by_class(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("o", F.expr(_OUTCOME))
    per = rows.groupBy(F.col("l_linestatus").alias("condition"), images.version_band(F.col("l_quantity") / 5).alias("band"), (F.col("l_orderkey") % 2).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("o") == "exact").alias("k"))
    return metrics.with_rate(per, "k", "n", "exact").select("condition", "band", "label", "k", "n", *(r6(c, c) for c in ("exact_rate", "exact_ci_low", "exact_ci_high")), (F.col("n") < 10).alias("sparse"))


@query(f"SELECT band, count(*) AS n, sum(label)::BIGINT AS n_positive, round(avg(label), 6) AS share_positive, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT label, CASE WHEN score >= 0.7 THEN 'HIGH RISK' WHEN score >= 0.3 THEN 'SUSPICIOUS' ELSE 'LOW RISK' END AS band FROM {_SCORED}) GROUP BY band")
def band_composition(spark, sf):
    per = scored(spark, sf).groupBy(explain.risk_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), r6(F.avg("label"), "share_positive"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # three rows


# ---------------------------------------------------------------- grouped splits


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey", "cast(floor(c_custkey / 3) as bigint) as domain", "cast(floor(c_acctbal) as bigint) as template", "c_custkey % 2 as label")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k, floor(c_custkey / 3)::BIGINT AS d, floor(c_acctbal)::BIGINT AS t FROM customer),
u AS (SELECT t FROM c GROUP BY t HAVING count(*) BETWEEN 3 AND 30),
e AS MATERIALIZED (SELECT DISTINCT x.d AS a, y.d AS b FROM c x JOIN c y ON x.t = y.t WHERE x.t IN (SELECT t FROM u) AND x.d <> y.d),
r AS (SELECT DISTINCT d AS a, d AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT r.a AS d, min(c.k) AS g FROM r JOIN c ON c.d = r.b GROUP BY r.a)
SELECT k AS c_custkey, g AS group_id FROM c JOIN m USING (d)""")
def split_groups(spark, sf):
    return groups.split_groups(customers(spark, sf), "c_custkey", "domain", "template").select("c_custkey", "group_id")


def customer_groups(spark, sf) -> DataFrame:
    grouped = groups.split_groups(customers(spark, sf), "c_custkey", "domain", "template")
    return grouped.groupBy("group_id").agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))


_CANDIDATES = 500


@query()
def split_candidates(spark, sf):
    """The score of every candidate and which one is chosen. The greedy fold has state, so it has no SQL twin; tests fold by hand."""
    scores = groups.stored(groups.searched_candidates(groups.stored(customer_groups(spark, sf), "groups"), _CANDIDATES, SEED), "scores")
    return scores.crossJoin(F.broadcast(groups.best_candidate(scores).select(F.col("candidate").alias("best")))).select("candidate", F.round("score", 6).alias("score"), "splits", (F.col("candidate") == F.col("best")).alias("chosen"))  # one row


@query()
def best_split(spark, sf):
    """The split of each group in the chosen one of all candidates; no SQL twin, as for split_candidates."""
    per = groups.stored(customer_groups(spark, sf), "groups")
    best = groups.best_candidate(groups.searched_candidates(per, _CANDIDATES, SEED)).first()
    total = per.agg(F.sum(F.col("zeros") + F.col("ones")).alias("n")).first()["n"]
    return groups.greedy_candidates(per, [best["candidate"]], SEED, total).withColumn("score", F.lit(round(best["score"], 6)))


# ---------------------------------------------------------------- models and explanations

#: Weights of all 30 features, in their order, for queries that need a scorer but no training; plans/training.py fits real ones.
_WEIGHTS = dict(zip(urls.FEATURES, (0.4, 0.15, -0.1, 0.3, 0.2, 0.35, 0.25, -0.2, 0.9, 0.1, 0.6, 0.05, -0.15, 0.1, 0.3, 0.2, -0.05, -0.7, 0.8, 0.5, 0.45, 0.3, -0.3, 1.1, 0.5, -0.25, 0.2, 0.15, -0.1, 0.4), strict=True))
_INTERCEPT = -0.2


def page_parts(spark, sf) -> DataFrame:
    rows = page_features(spark, sf)
    return explain.with_parts(rows, explain.fitted_scaling(rows, list(_WEIGHTS), urls.LOGGED), _WEIGHTS, urls.LOGGED)


def _value(f: str) -> str:
    return f"ln(1 + {f})" if f in urls.LOGGED else f"{f}::DOUBLE"


_Z = f"SELECT page_id, {', '.join(f'{f}::DOUBLE AS raw_{f}' for f in _WEIGHTS)}, " + ", ".join(f"({_value(f)} - avg({_value(f)}) OVER ()) / CASE WHEN round(stddev_pop({_value(f)}) OVER (), 12) = 0 THEN 1.0 ELSE stddev_pop({_value(f)}) OVER () END AS {f}" for f in _WEIGHTS) + f" FROM ({_FEATURES})"
_LONG = " UNION ALL ".join(f"SELECT page_id, '{f}' AS feature, {f} AS z, raw_{f} AS raw, {f} * {w} AS contribution, '{next(g for g, fs in urls.GROUPS.items() if f in fs)}' AS feature_group FROM z" for f, w in _WEIGHTS.items())


@query(f"WITH z AS ({_Z}) SELECT page_id, feature, round(z, 6) + 0.0 AS z, round(contribution, 6) + 0.0 AS contribution FROM ({_LONG})")
def contributions(spark, sf):
    return page_parts(spark, sf).select("page_id", F.inline("parts")).select("page_id", "feature", *((F.round(c, 6) + 0.0).alias(c) for c in ("z", "contribution")))  # no negative zeros


@query(f"WITH z AS ({_Z}), s AS (SELECT page_id, sum(contribution) + {_INTERCEPT} AS logit FROM ({_LONG}) GROUP BY page_id) SELECT page_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS score, CASE WHEN 1 / (1 + exp(-logit)) >= 0.7 THEN 'HIGH RISK' WHEN 1 / (1 + exp(-logit)) >= 0.3 THEN 'SUSPICIOUS' ELSE 'LOW RISK' END AS band FROM s")
def linear_score(spark, sf):
    return explain.scored(page_parts(spark, sf), _INTERCEPT).select("page_id", r6("logit", "logit"), r6("score", "score"), "band")


@query(f"WITH z AS ({_Z}) SELECT page_id, feature_group, round(sum(contribution), 6) AS total FROM ({_LONG}) GROUP BY ALL")
def group_contributions(spark, sf):
    return explain.group_totals(page_parts(spark, sf), "page_id").withColumn("total", F.round("total", 6))


@query(f"""WITH z AS ({_Z}), o AS (SELECT page_id, feature_group, CASE WHEN feature_group = 'Keywords' THEN 'keywords' ELSE feature END AS factor, sum(contribution) AS contribution FROM ({_LONG}) GROUP BY ALL),
t AS (SELECT *, sum(contribution) OVER (PARTITION BY page_id, feature_group) AS total FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, sign(contribution) ORDER BY abs(round(contribution, 9)) DESC, factor) AS place FROM t WHERE sign(contribution) = sign(total) AND abs(contribution) >= 0.05 AND abs(total) >= 0.05)
SELECT page_id, CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END AS direction, place::INT AS place, factor, round(contribution, 6) AS contribution FROM k WHERE place <= 3""")
def factor_sentences(spark, sf):
    return explain.factors(page_parts(spark, sf), "page_id").drop("sentence").withColumn("contribution", F.round("contribution", 6))


@query(f"WITH f AS ({_FEATURES}) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN count(DISTINCT {rounded(f)}) < 2 THEN 'zero variance' WHEN bool_and({f} IN (0, 1)) AND sum({f}) < 2 THEN 'rare flag' ELSE 'kept' END AS verdict FROM f" for f in urls.FEATURES))
def training_filter(spark, sf):
    """Which of the features a model may take; least and most values tell whether one varies, so nothing is counted by value."""
    long = rounded_features(spark, sf).unpivot(["page_id"], urls.FEATURES, "feature", "value")
    per = long.groupBy("feature").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("flag"), F.sum("value").alias("s"))
    varies = F.coalesce(F.col("least") < F.col("most"), F.lit(False))
    return per.select("feature", F.when(~varies, "zero variance").when(F.col("flag") & (F.col("s") < 2), "rare flag").otherwise("kept").alias("verdict"))


@query()
def lr_fit(spark, sf):
    """L2 logistic regression of returned lines on standardised columns (regParam = 1 / (C n)); no SQL twin."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 50.0 as score", "cast(l_returnflag = 'R' as bigint) as label", "l_discount", "l_tax", "l_extendedprice")
    names = ["score", "l_discount", "l_tax", "l_extendedprice"]
    scale = rows.agg(F.count("*").alias("n"), *(e for c in names for e in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s")))).first()
    ready = rows.select("l_orderkey", "l_linenumber", F.col("label").cast("double").alias("label"), *((F.col(c) - scale[f"{c}_m"]) / (scale[f"{c}_s"] or 1.0) for c in names)).toDF("l_orderkey", "l_linenumber", "label", *names)
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(ready)
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / scale["n"], elasticNetParam=0.0, standardization=False, maxIter=100).fit(vectors)
    return model.transform(vectors).select("l_orderkey", "l_linenumber", "label", F.round(vector_to_array("probability")[1], 4).alias("probability"))


# ---------------------------------------------------------------- errors, examples, folds and paired shifts


@query(f"""SELECT kind, l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'false positive' THEN -score ELSE score END, l_orderkey, l_linenumber) AS k FROM
 (SELECT *, CASE WHEN label = 0 THEN 'false positive' ELSE 'false negative' END AS kind FROM {_SCORED} WHERE label <> predicted)) WHERE k <= 10""")
def confident_errors(spark, sf):
    """The ten most confident errors of each kind, ties by id."""
    wrong = scored(spark, sf).where("label <> predicted").withColumn("kind", F.when(F.col("label") == 0, "false positive").otherwise("false negative"))
    sure = F.when(F.col("label") == 0, -F.col("score")).otherwise(F.col("score"))
    k = F.row_number().over(Window.partitionBy("kind").orderBy(sure, "l_orderkey", "l_linenumber"))
    return wrong.withColumn("k", k).where("k <= 10").select("kind", "l_orderkey", "l_linenumber", "score")


@query(f"""SELECT label, predicted, l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY label, predicted ORDER BY score, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY label, predicted) AS n FROM {_SCORED}) WHERE k = (n - 1) // 2 + 1""")
def example_picker(spark, sf):
    """The row of lower median score in each cell of the confusion table: its place is found by counts of scores, not in one sorted cell."""
    rows = scored(spark, sf)
    values = ranks.running_by(rows.groupBy("label", "predicted", "score").agg(F.count("*").alias("n")), ["label", "predicted"], "score", ["n"])
    hit = values.where("below_n <= (all_n - 1) div 2 and (all_n - 1) div 2 < below_n + n").selectExpr("label", "predicted", "score", "(all_n - 1) div 2 - below_n + 1 as place")
    tied = rows.join(F.broadcast(hit), ["label", "predicted", "score"])  # one row a cell
    k = F.row_number().over(Window.partitionBy("label", "predicted", "score").orderBy("l_orderkey", "l_linenumber"))
    return tied.withColumn("k", k).where("k = place").select("label", "predicted", "l_orderkey", "l_linenumber", "score")


@query(f"""WITH RECURSIVE s AS ({SQL["split_groups"]}), g AS (SELECT group_id, count_if(c_custkey % 2 = 0)::BIGINT AS zeros, count_if(c_custkey % 2 = 1)::BIGINT AS ones FROM s GROUP BY 1),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY abs(zeros - ones) DESC, zeros DESC, ones DESC, md5(concat_ws('|', '{SEED}', group_id::VARCHAR)), group_id) AS at FROM g),
t AS (SELECT greatest(1, sum(zeros)) AS z, greatest(1, sum(ones)) AS o FROM g),
f AS (SELECT 0::BIGINT AS at, [0, 0, 0, 0, 0]::BIGINT[] AS z, [0, 0, 0, 0, 0]::BIGINT[] AS o, 0 AS fold
 UNION ALL SELECT k.at, list_transform(range(1, 6), lambda i: p.z[i] + CASE WHEN i = p.best THEN k.zeros ELSE 0 END), list_transform(range(1, 6), lambda i: p.o[i] + CASE WHEN i = p.best THEN k.ones ELSE 0 END), p.best::INT - 1
 FROM (SELECT f.at, f.z, f.o, list_sort(list_transform(range(1, 6), lambda j: {{'u': round(
   sqrt(5 * (list_sum(list_transform(f.z, lambda x: x * x)) + 2 * f.z[j] * n.zeros + n.zeros * n.zeros) - (list_sum(f.z) + n.zeros) * (list_sum(f.z) + n.zeros)) / t.z
   + sqrt(5 * (list_sum(list_transform(f.o, lambda x: x * x)) + 2 * f.o[j] * n.ones + n.ones * n.ones) - (list_sum(f.o) + n.ones) * (list_sum(f.o) + n.ones)) / t.o, 12), 'n': f.z[j] + f.o[j], 'j': j}}))[1].j AS best
   FROM f JOIN k n ON n.at = f.at + 1, t) p JOIN k ON k.at = p.at + 1)
SELECT k.group_id, k.zeros, k.ones, f.fold FROM f JOIN k ON k.at = f.at""")
def group_folds(spark, sf):
    """The fold of each group of customers that a domain or a template links, so linked rows never part."""
    return groups.stratified_folds(groups.stored(customer_groups(spark, sf), "groups"), 5, SEED)


_SHIFTED = urls.FEATURES
_CHANGED = f"SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in urls.features(urls.DUCKDB) if n in _SHIFTED)} FROM {urls.sql_with(urls.parts(urls.DUCKDB), '(SELECT page_id, concat(url, repeat(chr(45), (page_id % 3)::INT), page_id::VARCHAR) AS url FROM pages)')}"


def _moved(f: str) -> str:
    old, new = (_value(f).replace(f, f"{t}.{f}", 1) for t in ("a", "b"))
    std = f"(SELECT stddev_pop({_value(f)}) FROM a)"
    return f"avg({new} - {old}) / CASE WHEN round({std}, 12) = 0 THEN 1.0 ELSE {std} END"


@query(f"WITH a AS ({_FEATURES}), b AS ({_CHANGED}) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, round(avg(b.{f} - a.{f}), 6) AS mean_shift, round(median(b.{f} - a.{f})::DOUBLE, 6) AS median_shift, round(avg((b.{f} <> a.{f})::INT), 6) AS share_changed, round({_moved(f)}, 6) + 0.0 AS transformed_delta, round({_WEIGHTS[f]} * ({_moved(f)}), 6) + 0.0 AS mean_logit_shift FROM a JOIN b USING (page_id)" for f in _SHIFTED))
def paired_shift(spark, sf):
    """How the features of one row differ between two versions of it, and what that does to its score."""
    changed = table(spark, sf, "pages").select("page_id", F.expr("concat(url, repeat('-', cast(page_id % 3 as int)), page_id)").alias("url"))
    second = urls.with_features(urls.with_parts(changed)).select("page_id", *(F.col(f).alias(f"new_{f}") for f in _SHIFTED))
    first = page_features(spark, sf).select("page_id", *_SHIFTED)
    both = first.join(second, "page_id").crossJoin(F.broadcast(explain.fitted_scaling(first, _SHIFTED, urls.LOGGED)))  # one row of constants
    moved = {f: (explain.transformed(F.col(f"new_{f}"), f, urls.LOGGED) - explain.transformed(F.col(f), f, urls.LOGGED)) / F.when(F.round(f"{f}__std", 12) == 0, 1.0).otherwise(F.col(f"{f}__std")) for f in _SHIFTED}
    long = both.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f"new_{f}") - F.col(f)).cast("double").alias("shift"), moved[f].alias("moved"), F.lit(_WEIGHTS[f]).alias("weight")) for f in _SHIFTED))))
    per = long.groupBy("feature").agg(
        F.count("*").alias("n"), r6(F.avg("shift"), "mean_shift"), r6(F.avg((F.col("shift") != 0).cast("int")), "share_changed"), r6(F.avg("moved"), "transformed_delta"), r6(F.avg(F.col("moved") * F.col("weight")), "mean_logit_shift"),
    )
    found = ranks.with_quantiles(per, long, ["feature"], "shift", {"median_shift": 0.5})
    return found.select("feature", "n", "mean_shift", F.round("median_shift", 6).alias("median_shift"), "share_changed", *((F.col(c) + 0.0).alias(c) for c in ("transformed_delta", "mean_logit_shift")))  # no negative zeros


# ---------------------------------------------------------------- checks and images


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders),
j AS (SELECT o_totalprice, p, o_orderstatus, s FROM orders JOIN b USING (o_orderkey))
SELECT 'o_totalprice' AS column_name, 0::BIGINT AS one_sided, 0::BIGINT AS differing, max(abs(o_totalprice - p)) AS max_abs_diff, CASE WHEN max(abs(o_totalprice - p)) > 0.001 THEN 'FAIL' ELSE 'PASS' END AS status FROM j
UNION ALL SELECT 'o_orderstatus', 0, count_if(o_orderstatus <> s)::BIGINT, NULL, CASE WHEN count_if(o_orderstatus <> s) > 0 THEN 'FAIL' ELSE 'PASS' END FROM j""")
def table_diff(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = o.select("o_orderkey", F.expr("if(o_orderkey % 100 = 0, o_totalprice + 1, o_totalprice)").alias("o_totalprice"), F.expr("if(o_orderkey % 50 = 0, 'X', o_orderstatus)").alias("o_orderstatus"))
    return checks.table_diff(o, changed, ["o_orderkey"], 0.001)


@query("""SELECT 'orders unique' AS check_name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS failures FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orders have customers', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'orders in one status', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus))
UNION ALL SELECT 'prices known', CASE WHEN count_if(o_totalprice IS NULL OR isnan(o_totalprice)) = 0 THEN 'PASS' ELSE 'FAIL' END, count_if(o_totalprice IS NULL OR isnan(o_totalprice))::BIGINT FROM orders""")
def dataset_checks(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return checks.report([
        checks.unique("orders unique", o, "o_orderkey"),
        checks.check("orders have customers", o.join(c, F.expr("o_custkey = c_custkey"), "left_anti"), F.count("*")),
        checks.not_shared("orders in one status", o, "o_custkey", "o_orderstatus"),
        checks.check("prices known", o, F.count_if(F.col("o_totalprice").isNull() | F.isnan("o_totalprice"))),
    ])


@query("""WITH k AS (SELECT o_orderkey::VARCHAR AS part, row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 1 AS pos FROM orders),
a AS (SELECT pos // 1024 AS pos, sha256(string_agg(part, chr(10) ORDER BY pos)) AS part FROM k GROUP BY pos // 1024),
b AS (SELECT pos // 1024 AS pos, sha256(string_agg(part, chr(10) ORDER BY pos)) AS part FROM a GROUP BY pos // 1024),
c AS (SELECT sha256(string_agg(part, chr(10) ORDER BY pos)) AS part FROM b),
n AS (SELECT (SELECT count(*) FROM k) AS n, (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2)
SELECT n, CASE WHEN n1 = 1 THEN 1 WHEN n2 = 1 THEN 2 ELSE 3 END::INT AS levels, CASE WHEN n1 = 1 THEN (SELECT min(part) FROM a) WHEN n2 = 1 THEN (SELECT min(part) FROM b) ELSE (SELECT min(part) FROM c) END AS sha256 FROM n""")
def id_digest(spark, sf):
    return checks.digest(table(spark, sf, "orders"), "o_orderkey")


_VERSION = "CASE " + " ".join(f"WHEN strlen(url) <= {most} THEN {v}" for v, most in enumerate(images.CAPACITY_M, 1)) + " END"


@query(f"SELECT version, 17 + 4 * version AS modules_per_side, CASE WHEN version <= 3 THEN 'v1-v3' WHEN version <= 6 THEN 'v4-v6' ELSE 'v7+' END AS band, count(*) AS n FROM (SELECT {_VERSION} AS version FROM pages) GROUP BY version")
def qr_version(spark, sf):
    rows = table(spark, sf, "pages").select(images.qr_version(F.col("url")).alias("version"))
    return rows.groupBy("version").agg(F.count("*").alias("n")).select("version", images.modules_per_side(F.col("version")).alias("modules_per_side"), images.version_band(F.col("version")).alias("band"), "n")


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'failure' WHEN page_id % 7 = 0 THEN 'mismatch' ELSE 'exact' END AS outcome, count(*) AS n FROM pages GROUP BY 1")
def decode_outcome(spark, sf):
    payload = F.when(F.col("page_id") % 5 == 0, F.lit("")).when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").groupBy(images.decode_outcome(F.col("url"), payload).alias("outcome")).agg(F.count("*").alias("n"))


@query()
def image_features(spark, sf):
    """Pixel statistics of drawn module grids; pixels have no SQL twin, tests use a direct computation."""
    drawn = images.patterned(table(spark, sf, "pages").select("page_id", "url"), "page_id", "url")
    return images.with_statistics(drawn, "page_id").select("page_id", *(F.round(s, 6).alias(s) for s in images.STATISTICS))


@query()
def feature_shift(spark, sf):
    """Mean change of the dark share under each distortion that has a kernel."""
    drawn = images.patterned(table(spark, sf, "pages").select("page_id", "url"), "page_id", "url", modules=21, scale=3)
    shares = images.bright_shares(drawn, "page_id", images.GRID)
    return shares.groupBy("type", "severity").agg(F.count("*").alias("n"), r6(F.avg(F.col("bright") - F.col("clean")), "mean_shift"))
