"""Running totals and ranks over a global order, without a single-task window.

Values are first counted; then cut into ranges of about equal numbers of
distinct values. Each range has its own window, and a small table of range
totals (one row a range) gives what lies before it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.scratch import stored

RANGES = 64


def running(distinct: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """Adds `below_<sum>` to a table with one row for each `value`: the total over all smaller values."""
    cuts = sorted(set(distinct.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
    number = F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c <= {value}))") if cuts else F.lit(0)
    rows = distinct.withColumn("_range", number)
    totals = rows.groupBy("_range").agg(*(F.sum(s).alias(s) for s in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    totals = totals.select("_range", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"below_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    rows = rows.join(F.broadcast(totals), "_range")
    return rows.select(value, *sums, *((F.col(f"below_{s}") + F.col(f"_before_{s}")).alias(f"below_{s}") for s in sums))


def counted(rows: DataFrame, value: str, label: str) -> DataFrame:
    """(value, n, positives, below_n, below_positives) of each distinct value."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    return running(distinct, value, ["n", "positives"])


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` with the average rank (from 1) of a value among all rows; ties share theirs."""
    distinct = rows.groupBy(value).agg(F.count("*").alias("n"))
    ranked = running(distinct, value, ["n"]).select(value, (F.col("below_n") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranked, value)


def running_by(distinct: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """running() within each group of `by`, and `all_<sum>` of the group. For few groups, as those of a report: of these, cuts and range totals are broadcast."""
    rows = distinct.withColumn("_by", F.struct(F.lit(0).alias("_all"), *by))  # structs of null fields are equal
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cuts = rows.groupBy("_by").agg(F.array_distinct(F.percentile_approx(value, shares, 1000)).alias("_cuts"))
    rows = rows.join(F.broadcast(cuts), "_by").withColumn("_range", F.expr(f"size(filter(_cuts, c -> c <= {value}))")).drop("_cuts")
    group = Window.partitionBy("_by")
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_by", "_range").agg(*(F.sum(s).alias(s) for s in sums))
    totals = totals.select("_by", "_range", *(e for s in sums for e in (F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}"), F.sum(s).over(group).alias(f"all_{s}"))))
    inside = Window.partitionBy("_by", "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"below_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(F.broadcast(totals), ["_by", "_range"])
    return rows.select(*by, value, *sums, *(e for s in sums for e in ((F.col(f"below_{s}") + F.col(f"_before_{s}")).alias(f"below_{s}"), F.col(f"all_{s}"))))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group with linear interpolation, a column for each share. Values are counted, so no task holds a group; nulls are left out. Without `by`, an empty table gives one row of nulls."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    placed = running_by(counted, by, "_v", ["n"])

    def at(place):
        return F.max(F.when((F.col("below_n") <= place) & (place < F.col("below_n") + F.col("n")), F.col("_v")))

    places = {name: (F.col("all_n") - 1) * F.lit(float(q)) for name, q in shares.items()}
    found = placed.groupBy(*by).agg(*(e for name, x in places.items() for e in (at(F.floor(x)).alias(f"{name}_low"), at(F.ceil(x)).alias(f"{name}_high"), F.max(x - F.floor(x)).alias(f"{name}_rest"))))
    return found.select(*by, *((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_rest")).alias(name) for name in shares))


def with_quantiles(per: DataFrame, rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`per`, one row for each of a few groups of `rows`, with their quantiles; null groups are groups too."""
    found = quantiles(rows, by, value, shares).withColumnsRenamed({c: f"_q_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by), F.lit(True))
    return per.join(F.broadcast(found), same, "left").drop(*(f"_q_{c}" for c in by))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient over rows with both values; null if one of them is constant."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


#: A column of at most so many distinct values has its ranks sent to all tasks.
FEW = 10_000


def rank_correlations(rows: DataFrame, key: str, columns: list[str], few: int = FEW) -> DataFrame:
    """(a, b, n, spearman) of every pair of numeric `columns`, over rows that have both; null where one of them is constant.

    All columns are ranked in one pass, among all their values; so with nulls, ranks of
    a column are those among its own non-null values. `key` is unique. Ranks of columns
    with few distinct values are looked up in tasks, others are joined. Each task adds
    up the products of its rows' ranks, a number for each pair. An empty table gives no
    rows.
    """
    wide = rows.select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    long = wide.unpivot([key], columns, "column", "value").where("value is not null")
    counted = running_by(long.groupBy("column", "value").agg(F.count("*").alias("n")), ["column"], "value", ["n"])
    ranked = stored(counted.select("column", "value", (F.col("below_n") + (F.col("n") + 1) / 2 - (F.col("all_n") + 1) / 2).alias("rank")), "ranks")  # from the middle
    sizes = {r["column"]: r["n"] for r in ranked.groupBy("column").agg(F.count("*").alias("n")).collect()}
    large = [c for c in columns if sizes.get(c, 0) > few]
    tables: dict[str, list[tuple[float, float]]] = {c: [] for c in columns if c not in large}
    for r in ranked.where(~F.col("column").isin(large) if large else F.lit(True)).toLocalIterator():
        tables[r["column"]].append((r["value"], r["rank"]))
    looked_up = rows.sparkSession.sparkContext.broadcast({c: np.array(sorted(t)).reshape(-1, 2).T for c, t in tables.items()})
    if large:
        found = long.where(F.col("column").isin(large)).join(ranked, ["column", "value"]).groupBy(key).pivot("column", large).agg(F.first("rank"))
        wide = wide.drop(*large).join(found, key, "left")
    names = ("i", "j", "n", "x", "y", "xx", "yy", "xy")

    def run(batches):
        k = len(columns)
        n, x, xx, xy = (np.zeros((k, k)) for _ in range(4))
        seen = 0
        for b in batches:
            seen += b.num_rows
            r = np.full((b.num_rows, k), np.nan)
            for i, c in enumerate(columns):
                own = b.column(c).to_numpy(zero_copy_only=False).astype(float)
                if c in large:
                    r[:, i] = own
                elif looked_up.value[c].shape[1]:
                    values, places = looked_up.value[c]
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    r[:, i] = np.where(np.isnan(own), np.nan, places[at])
            there = (~np.isnan(r)).astype(float)
            r = np.nan_to_num(r)
            n += there.T @ there
            x += r.T @ there
            xx += (r * r).T @ there
            xy += r.T @ r
        i, j = np.triu_indices(k, 1)
        if seen:
            yield pa.record_batch([pa.array(v) for v in (i, j, n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j])], list(names))

    sums = wide.select(*columns).mapInArrow(run, "i bigint, j bigint, " + ", ".join(f"{c} double" for c in names[2:])).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names[2:]))
    left, right = (F.col(s + s) * F.col("n") - F.col(s) * F.col(s) for s in ("x", "y"))
    varies = (left > 1e-12 * F.col("xx") * F.col("n")) & (right > 1e-12 * F.col("yy") * F.col("n"))
    rho = F.when(varies, (F.col("xy") * F.col("n") - F.col("x") * F.col("y")) / F.sqrt(left * right))
    label = F.array(*map(F.lit, columns))
    return sums.select(label[F.col("i").cast("int")].alias("a"), label[F.col("j").cast("int")].alias("b"), F.col("n").cast("bigint").alias("n"), rho.alias("spearman"))


#: Rows of one sorted partition have numbers below this in the lower bits of monotonically_increasing_id.
_LOCAL = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`rows` with `name`, their place from 0 in the order of `order`, which has to tell all rows apart.

    Rows are range-partitioned and sorted, and numbered inside their partition; the
    places that lie before a partition come from a table of one row each. Written to
    the shared folder in between, so that all readers see the same partitions.
    """
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(_LOCAL))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(inside) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_at", "_start")


def numbered_within(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """numbered() from 0 in each group of `by` (not null), however many rows a group has."""
    placed = numbered(rows, [*by, *order], "_seat")
    first = placed.groupBy(*by).agg(F.min("_seat").alias("_first"))
    return placed.join(first, by).withColumn(name, F.col("_seat") - F.col("_first")).drop("_seat", "_first")
