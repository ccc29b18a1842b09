"""Report queries: ordering, escaping, claims, gates and views over the tables of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import errors, ranks, text
from linkloom.plans.catalog import query, r6, table

# ---------------------------------------------------------------- columns, order and sets


@query("SELECT n_nationkey, 'N' || n_nationkey::VARCHAR AS code, n_name FROM nation")
def insert_column(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return text.inserted(n, 1, "code", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))


_PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(f"SELECT o_orderpriority, count(*) AS n, list_position({_PRIORITIES}, o_orderpriority)::INT AS place FROM orders GROUP BY o_orderpriority")
def explicit_order(spark, sf):
    """Groups in a stated order; others would come first, at place 0."""
    per = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.array_position(F.array(*map(F.lit, _PRIORITIES)), F.col("o_orderpriority")).cast("int")).orderBy("place")


@query("SELECT key, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS key, count(*) AS customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS key, count(*) AS suppliers FROM supplier GROUP BY 1) s USING (key)")
def column_concat(spark, sf):
    """Columns of two tables side by side by their index; what one side lacks counts 0."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "key", "full").na.fill(0)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE k = n // 2 + 1")
def middle_row(spark, sf):
    """The row at n // 2 (from 0) of each band. Values are counted first: only rows of the one value that holds the place are ordered."""
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    values = ranks.running_by(rows.groupBy("c_nationkey", "c_acctbal").agg(F.count("*").alias("n")), ["c_nationkey"], "c_acctbal", ["n"])
    held = values.where("below_n <= all_n div 2 and all_n div 2 < below_n + n").selectExpr("c_nationkey", "c_acctbal", "all_n div 2 - below_n + 1 as place")
    own = rows.join(F.broadcast(held), ["c_nationkey", "c_acctbal"])  # one row a nation
    return own.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey", "c_acctbal").orderBy("c_custkey"))).where("k = place").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT l_linestatus, sum(split_part(rate, '/', 1)::BIGINT)::BIGINT AS k, sum(split_part(rate, '/', 2)::BIGINT)::BIGINT AS n FROM (SELECT l_linestatus, l_suppkey, concat(count_if(l_quantity > 25)::VARCHAR, '/', count(*)::VARCHAR) AS rate FROM lineitem GROUP BY ALL) GROUP BY l_linestatus")
def parsed_counts(spark, sf):
    """Rates written as 'k/n' are taken apart and added up."""
    rates = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_suppkey").agg(F.concat_ws("/", F.count_if(F.col("l_quantity") > 25).cast("string"), F.count("*").cast("string")).alias("rate"))
    k, n = (F.split_part("rate", F.lit("/"), F.lit(i)).cast("bigint") for i in (1, 2))
    return rates.groupBy("l_linestatus").agg(F.sum(k).alias("k"), F.sum(n).alias("n"))


_SPLIT = "CASE WHEN page_id % 10 < 7 THEN 'train' WHEN page_id % 10 < 8 THEN 'val' ELSE 'test' END"
_HOSTS = urls.sql_with(urls.parts(urls.DUCKDB), "pages")


@query(f"SELECT t.host, t.n_urls, train, val, test FROM (SELECT host, count(*) AS n_urls FROM {_HOSTS} GROUP BY host HAVING count(*) >= 3) t JOIN (SELECT host, count_if({_SPLIT} = 'train')::BIGINT AS train, count_if({_SPLIT} = 'val')::BIGINT AS val, count_if({_SPLIT} = 'test')::BIGINT AS test FROM {_HOSTS} GROUP BY host) p ON t.host = p.host")
def report_by_split(spark, sf):
    """A report joined with a pivot of the same rows by split; one aggregation gives both sides."""
    rows = urls.with_parts(table(spark, sf, "pages")).select("host", F.expr(_SPLIT).alias("split"))
    per = rows.groupBy("host").pivot("split", ["train", "val", "test"]).count().na.fill(0)
    return per.withColumn("n_urls", F.expr("train + val + test")).where("n_urls >= 3").select("host", "n_urls", "train", "val", "test")


# ---------------------------------------------------------------- views, references, claims and gates

_MODELS = {"quantity": "l_quantity / 50.0", "discount": "l_discount * 10.0", "all_negative": "0.0", "all_positive": "1.0"}
_VIEWS = (0.3, 0.5, 0.7)


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, {t}::DOUBLE AS threshold, count_if({x} >= {t} AND l_returnflag = 'R')::BIGINT AS tp, count_if({x} >= {t} AND l_returnflag <> 'R')::BIGINT AS fp, count_if({x} < {t} AND l_returnflag = 'R')::BIGINT AS fn, count_if({x} < {t} AND l_returnflag <> 'R')::BIGINT AS tn FROM lineitem" for m, x in _MODELS.items() for t in _VIEWS))
def model_views(spark, sf):
    """Every model, constant references included, at every threshold: counts of one pass, turned into rows afterwards."""
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag = 'R' as positive", *(f"{x} as {m}" for m, x in _MODELS.items()))
    wide = rows.agg(*(F.count_if(condition & (F.col("positive") == positive)).alias(f"{m}__{i}__{name}") for m in _MODELS for i, t in enumerate(_VIEWS) for name, positive, condition in (("tp", True, F.col(m) >= t), ("fp", False, F.col(m) >= t), ("fn", True, F.col(m) < t), ("tn", False, F.col(m) < t))))
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(t).alias("threshold"), *(F.col(f"{m}__{i}__{n}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for m in _MODELS for i, t in enumerate(_VIEWS)))
    return wide.select(F.inline(cells))


_CLAIMS = [("mean quantity", "avg(l_quantity)", 25.5, 0), ("most quantity", "max(l_quantity)", 50.0, 2), ("mean tax", "avg(l_tax)", 0.04, 2), ("share returned", "avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)", 0.9, 1)]


@query(" UNION ALL ".join(f"SELECT '{name}' AS claim, CASE WHEN abs(round({x}::DOUBLE, {dp}) - round({quoted}::DOUBLE, {dp})) < 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem" for name, x, quoted, dp in _CLAIMS))
def number_claims(spark, sf):
    """Quoted numbers against computed ones, rounded to the places that were quoted."""
    wide = table(spark, sf, "lineitem").agg(*(F.expr(f"cast({x} as double)").alias(f"c{i}") for i, (_, x, _, _) in enumerate(_CLAIMS)))
    same = [F.abs(F.round(f"c{i}", dp) - F.round(F.lit(quoted), dp)) < 1e-9 for i, (_, _, quoted, dp) in enumerate(_CLAIMS)]
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c[0]).alias("claim"), F.when(ok, "PASS").otherwise("FAIL").alias("status")) for c, ok in zip(_CLAIMS, same, strict=True)))))


_GATE = "CASE WHEN (SELECT count(*) FROM ({0} EXCEPT ALL {1})) + (SELECT count(*) FROM ({1} EXCEPT ALL {0})) = 0 THEN 'PASS' ELSE 'FAIL' END"
_ORDER_IDS, _CHANGED_IDS = "SELECT o_orderkey AS k FROM orders", "SELECT CASE WHEN o_orderkey = 1 THEN -1 ELSE o_orderkey END AS k FROM orders"
_LINE_IDS = "SELECT DISTINCT l_orderkey AS k FROM lineitem"


@query(f"SELECT 'ids of the lines' AS gate, {_GATE.format(_ORDER_IDS, _LINE_IDS)} AS status UNION ALL SELECT 'changed ids', {_GATE.format(_ORDER_IDS, _CHANGED_IDS)}")
def hash_gate(spark, sf):
    """A frozen digest of the ids of orders against those that lines speak of, and against ids of which one was changed."""
    ids = table(spark, sf, "orders").select("o_orderkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    changed = ids.select(F.when(F.col("o_orderkey") == 1, -1).otherwise(F.col("o_orderkey")).alias("o_orderkey"))
    return text.gate("ids of the lines", ids, lines, "o_orderkey").unionByName(text.gate("changed ids", ids, changed, "o_orderkey"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'ERROR' WHEN value < 0 THEN 'FAIL' WHEN value > 90 THEN 'WARN' ELSE 'PASS' END AS status FROM events) GROUP BY status")
def status_counts(spark, sf):
    status = F.when(F.col("value").isNull(), "ERROR").when(F.col("value") < 0, "FAIL").when(F.col("value") > 90, "WARN").otherwise("PASS")
    return table(spark, sf, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_FILLED = "concat(CASE WHEN l_quantity > 25 THEN ' Large ' ELSE 'small' END)"


@query(f"SELECT error_type, category, count(*) AS n_rows FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'false negative' ELSE 'false positive' END AS error_type, lower(trim({_FILLED})) AS category FROM lineitem) GROUP BY ALL")
def worksheet_summary(spark, sf):
    """The categories of a filled worksheet by kind of error; blank ones, missing notes and too many categories are refused."""
    rows = table(spark, sf, "lineitem").selectExpr("case when l_returnflag = 'R' then 'false negative' else 'false positive' end as error_type", f"{_FILLED} as your_category", "l_linestatus as evidence_note")
    return errors.summarised(rows)


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, trim(regexp_replace(lower(event_type || ' / Events'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM events GROUP BY event_type")
def named_days(spark, sf):
    per = table(spark, sf, "events").groupBy("event_type").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))
    return per.withColumn("slug", text.slug(F.concat("event_type", F.lit(" / Events"))))


@query()
def display_escape(spark, sf):
    """URLs with control, bidi and wide spaces put in, as they are safe to show; a test compares with escaping by hand."""
    odd = F.concat(F.col("url"), F.lit("‮ \t"), F.repeat(F.lit("x"), (F.col("page_id") % 3 * 300).cast("int")), F.lit("\U000e0001"))
    return table(spark, sf, "pages").select("page_id", text.escaped(odd).alias("shown"))


@query("SELECT l_linestatus, round(avg(l_tax), 6) AS mean_tax, count(*) AS n, CASE WHEN count(*) < 10 THEN 'too few' WHEN avg((l_tax > 0.04)::INT) > 0.5 THEN 'mostly above' ELSE 'mostly below' END AS verdict FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY l_linestatus")
def within_band_verdict(spark, sf):
    """Inside one band only: mean, number of rows and a verdict on their share; few rows get none."""
    rows = table(spark, sf, "lineitem").where("l_quantity between 10 and 20").groupBy("l_linestatus")
    verdict = F.expr("case when count(*) < 10 then 'too few' when avg(cast(l_tax > 0.04 as int)) > 0.5 then 'mostly above' else 'mostly below' end")
    return rows.agg(r6(F.avg("l_tax"), "mean_tax"), F.count("*").alias("n"), verdict.alias("verdict"))
