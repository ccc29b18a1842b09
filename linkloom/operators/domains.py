"""Registered domains by public-suffix rules.

A rule file lists suffixes under which names are registered: plain ones (co.uk),
wildcards (*.ck: one further label belongs to the suffix) and exceptions to these
(!www.ck). Every distinct host is taken apart into its few last suffixes, which
meet the rules by an equi-join; of the rules that match, an exception wins, else
the one of most labels. Hosts without a rule have their last label as suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources import text

#: A few rules of the public list, of all kinds, for use without a file. Any rule file can be given instead.
RULES = (
    "com", "net", "org", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "au", "com.au", "net.au", "org.au", "nz", "co.nz", "jp", "co.jp", "ne.jp", "or.jp", "*.kawasaki.jp", "!city.kawasaki.jp",
    "br", "com.br", "cn", "com.cn", "公司.cn", "mx", "com.mx", "tr", "com.tr", "in", "co.in", "kr", "co.kr", "za", "co.za", "sg", "com.sg", "hk", "com.hk", "tw", "com.tw", "*.ck", "!www.ck",
)
PRIVATE = ("===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS===")


def ascii_form(name: Column) -> Column:
    """Lower case, and Unicode labels in their xn-- form; names that have none stay."""
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), F.lower(name)).otherwise(F.coalesce(F.lower(F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), name)), F.lower(name)))


def parsed(lines: DataFrame, private: bool = False) -> DataFrame:
    """key (the rule without its mark, in ASCII form) and kind ('exact', 'wildcard', 'exception') of the rules in numbered lines (file, line, value).

    Comments begin with '//', a rule ends at white space, and repeated rules are one.
    Rules of the private section count only with `private`.
    """
    marks = [F.min(F.when(F.contains("value", F.lit(m)), F.col("line"))).alias(n) for m, n in zip(PRIVATE, ("begin", "end"), strict=True)]
    sections = lines.groupBy("file").agg(*marks)  # a row a file
    rule = F.lower(F.regexp_extract("value", r"^\s*([^\s]*)", 1))
    rows = lines.join(sections, "file").withColumn("rule", rule).where("rule not in ('', '*') and not startswith(rule, '//')")
    if not private:
        rows = rows.where("begin is null or line < begin or line > end")
    return of_rules(rows)


def of_rules(rows: DataFrame) -> DataFrame:
    """parsed() of a column `rule`."""
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("exact")
    key = ascii_form(F.regexp_replace("rule", r"^(!|\*[.]|[.])", ""))
    return rows.select(key.alias("key"), kind.alias("kind")).distinct()


def default_rules(spark: SparkSession) -> DataFrame:
    return of_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))


def read_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    return parsed(text.numbered_lines(spark, path), private)


def registered(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, public_suffix and registered_domain of every distinct host.

    A host that is itself a suffix has no registered domain and stands for itself,
    as do IP addresses (is_ip). Dots at the end and ideographic dots count as usual
    ones; the answer keeps the host's own spelling.
    """
    most = rules.agg(F.max(F.size(F.split("key", "[.]")))).first()[0] or 0
    own = hosts.where("host is not null").groupBy("host").agg(F.max("is_ip").alias("is_ip"))
    plain = F.regexp_replace(F.regexp_replace("host", "[。．｡]", "."), "[.]+$", "")
    own = own.withColumn("labels", F.split(plain, "[.]")).withColumn("n", F.size("labels")).withColumn("known", F.split(ascii_form(plain), "[.]"))
    at = F.sequence(F.greatest(F.lit(1), F.col("n") - most + 1), F.col("n"))
    ends = own.where("not is_ip").select("host", "n", F.explode(F.transform(at, lambda i: F.struct(F.array_join(F.slice("known", i, F.col("n")), ".").alias("key"), (F.col("n") - i + 1).alias("held")))).alias("e"))
    met = ends.select("host", "n", "e.*").join(rules, "key").where("kind <> 'wildcard' or held < n")
    held = F.expr("case kind when 'exact' then held when 'wildcard' then held + 1 else held - 1 end")
    best = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("wins"), held.alias("held"))).alias("best"))
    found = own.join(best.select("host", "best.held"), "host", "left").withColumn("held", F.coalesce("held", F.lit(1)))
    suffix = F.array_join(F.slice("labels", F.col("n") - F.col("held") + 1, F.col("held")), ".")
    domain = F.array_join(F.slice("labels", F.col("n") - F.col("held"), F.col("held") + 1), ".")
    return found.select("host", F.when(F.col("is_ip"), F.lit("")).otherwise(suffix).alias("public_suffix"), F.when(F.col("is_ip") | (F.col("held") >= F.col("n")), F.col("host")).otherwise(domain).alias("registered_domain"))


def with_registered_domain(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """`rows` (with the parts of their URLs) with registered_domain and public_suffix by `rules`; features of subdomains made afterwards follow them."""
    found = registered(rows.select("host", "is_ip"), rules)
    return rows.drop("registered_domain", "public_suffix").join(found, "host", "left").select(*(c for c in rows.columns if c not in ("registered_domain", "public_suffix")), "public_suffix", "registered_domain")
