"""Evaluation of binary scores: confusion, thresholds, calibration, ranks, intervals and tests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import ranks
from linkloom.operators.clean import hashed, least_hashed
from linkloom.sources.scratch import stored

Z = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn),
    }


def confusion(rows: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """Counts and rates, one row for each group of `by`."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    return counts.withColumns(rates(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def sweep(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Counts and rates at every distinct score and at 0.5; a row is positive from the threshold on.

    Prefix sums over counted scores, so no threshold is compared with every row.
    """
    half = rows.sparkSession.range(1).select(F.lit(0.5).alias(score), F.lit(0).alias("n"), F.lit(0).alias("positives"))
    distinct = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    distinct = distinct.unionByName(half).groupBy(score).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    total = rows.agg(F.count("*").alias("all_n"), F.sum(F.col(label).cast("bigint")).alias("all_positives"))
    table = ranks.running(distinct, score, ["n", "positives"]).crossJoin(F.broadcast(total))  # one row of totals
    tp = F.col("all_positives") - F.col("below_positives")
    fp = F.col("all_n") - F.col("below_n") - tp
    fn, tn = F.col("below_positives"), F.col("below_n") - F.col("below_positives")
    counts = table.select(F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"))
    return counts.withColumns(rates(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def choose_threshold(swept: DataFrame, least_recall: float = 0.9, most_fpr: float = 0.5) -> DataFrame:
    """The highest feasible threshold, else the one of best F1 (ties: higher); rates are rounded to 4 places before they are compared."""
    table = swept.select(F.round("threshold", 6).alias("threshold"), *(F.round(c, 4).alias(c) for c in ("f1", "recall", "precision", "fpr")))
    feasible = (F.col("recall") >= least_recall) & (F.col("fpr") <= most_fpr)
    whole = F.struct("threshold", "f1", "recall", "precision", "fpr")
    best = table.agg(F.max_by(whole, F.when(feasible, F.col("threshold"))).alias("feasible"), F.max_by(whole, F.struct("f1", "threshold")).alias("optimal"))
    chosen = F.coalesce("feasible", "optimal")
    return best.select(F.when(F.col("feasible").isNotNull(), "target met").otherwise("fallback: best F1").alias("rule"), *(chosen[c].alias(c) for c in ("threshold", "f1", "recall", "precision", "fpr")))


def calibration(rows: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of the score; 1 belongs to the last."""
    number = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).cast("int")
    return rows.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share_positive"))


def brier_ece(rows: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    brier = rows.agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))
    ece = calibration(rows, label, score, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share_positive"))) / F.sum("n")).alias("ece"))
    return brier.crossJoin(ece)  # one row each


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by counting pairs of distinct scores; null with one class only."""
    c = ranks.counted(rows.select(F.col(score).alias("value"), F.col(label).alias("label")), "value", "label")
    above = F.sum(F.col("positives") * (F.col("below_n") - F.col("below_positives") + (F.col("n") - F.col("positives")) / 2.0))
    pairs = F.sum("positives") * F.sum(F.col("n") - F.col("positives"))
    return c.agg(F.sum("n").alias("n"), F.try_divide(above, pairs.cast("double")).alias("auc"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows that have both values; null if one of them is constant."""
    both = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    ranked = ranks.average_ranks(ranks.average_ranks(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.count("*").alias("n"), ranks.correlation(F.col("rx"), F.col("ry")).alias("spearman"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of k of n, within 0 and 1; null for n = 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, d = k / n, 1 + Z * Z / n
    centre, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def with_rate(df: DataFrame, k: str, n: str, name: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumns({f"{name}_rate": F.try_divide(F.col(k).cast("double"), F.col(n)), f"{name}_ci_low": F.when(F.col(n) > 0, low), f"{name}_ci_high": F.when(F.col(n) > 0, high)})


def mcnemar(pairs: DataFrame, *by: str) -> DataFrame:
    """Exact two-sided test of (a_right, b_right) rows: discordant counts and p (1 without any)."""
    counts = pairs.groupBy(*by).agg(
        F.count_if(F.col("a_right") & ~F.col("b_right")).alias("a_right_b_wrong"), F.count_if(~F.col("a_right") & F.col("b_right")).alias("a_wrong_b_right")
    )
    return with_mcnemar_p(counts)


def with_mcnemar_p(counts: DataFrame) -> DataFrame:
    """Adds p_exact to rows of discordant counts, in time and space of the root of the counts."""
    table = counts.withColumns({"_n": F.col("a_right_b_wrong") + F.col("a_wrong_b_right"), "_k": F.least("a_right_b_wrong", "a_wrong_b_right")})
    # terms from k down, as shares of the first; the one 6 sqrt(n) further on is below exp(-72) of it
    shares = """aggregate(sequence(0L, least(_k, bigint(ceil(6 * sqrt(_n))) + 20)), named_struct('term', 1D, 'sum', 0D),
                (s, i) -> named_struct('term', s.term * ((_k - i) / (_n - _k + i + 1D)), 'sum', s.sum + s.term), s -> s.sum)"""
    # log of C(n, k) / 2^n by Stirling's series, with the large terms taken together
    d = "(2D * _k / _n - 1)"
    first = f"""if(_k = 0, -_n * ln(2D), {_stirling("_n")} - {_stirling("_k")} - {_stirling("(_n - _k)")} + 0.5 * ln(_n / (2 * pi() * _k * (_n - _k)))
                - _n / 2D * ((1 + {d}) * log1p({d}) + (1 - {d}) * log1p(-{d})))"""
    return table.withColumn("p_exact", F.expr(f"if(_n = 0, 1D, least(1D, 2 * exp({first}) * {shares}))")).drop("_n", "_k")


def _stirling(x: str) -> str:
    """SQL of ln x! less (x + 1/2) ln x - x + ln(2 pi) / 2, for x from 1."""
    small = f"ln(factorial(int(least({x}, 15L)))) - ({x} + 0.5D) * ln({x}) + {x} - 0.5D * ln(2 * pi())"
    y = f"double({x})"
    series = f"(1 / 12D - (1 / 360D - (1 / 1260D - 1 / 1680D / {y} / {y}) / {y} / {y}) / {y} / {y}) / {y}"
    return f"if({x} <= 15, {small}, {series})"


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p. The tests are the rows of a report, so one window holds them."""
    order = Window.orderBy(p, key)
    m = F.count("*").over(Window.partitionBy())
    stepped = tests.withColumn("_step", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return stepped.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


#: Slots of a resample that a task draws at once, slots whose units are summed together, and draws of these.
SLOTS, PART, BLOCK = 1 << 16, 1 << 14, 250


def _numbered(units: DataFrame, unit: str, seed: int) -> DataFrame:
    """Adds `slot`: units in hashed order, by ranges of the hash."""
    hashes = units.withColumn("_hash", hashed(seed, unit)).withColumn("_range", F.substring("_hash", 1, 2))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # at most 256 rows
    starts = hashes.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", unit)) - 1
    return hashes.withColumn("slot", inside).join(F.broadcast(starts), "_range").select(*units.columns, (F.col("slot") + F.col("_start")).alias("slot"))


def _stretches(units: DataFrame, draws: int, n: int) -> DataFrame:
    """(draw, first, end): the slots of all draws of n units, by stretches of SLOTS and dealt to tasks."""
    spark = units.sparkSession
    each = -(-n // SLOTS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), draws * n // (32 * SLOTS))
    return spark.range(0, draws * each, 1, parts).selectExpr(f"cast(id div {max(1, each)} as int) as draw", f"id % {max(1, each)} * {SLOTS} as first").withColumn("end", F.least(F.lit(n).cast("bigint"), F.col("first") + SLOTS))


def resampled(units: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """(draw, `unit`, times): how often each draw takes a unit; units are numbered in hashed order, and slots drawn by hash in all tasks."""
    n = units.count()
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw"), F.col("at"))), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    slots = _stretches(units, draws, n).select("draw", F.explode(F.sequence("first", F.col("end") - 1)).alias("at"))
    return slots.select("draw", drawn.alias("slot")).groupBy("draw", "slot").agg(F.count("*").alias("times")).join(_numbered(units, unit, seed), "slot").select("draw", unit, "times")


def resampled_sums(units: DataFrame, unit: str, cells: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, cells): the sums of cells over the units that each draw of resampled() takes.

    Sums add up, so draws never meet units row by row: a task draws stretches of slots
    and deals them, 2 bytes each, by ranges of PART slots; another holds the cells of one
    range and adds up BLOCK draws of it. What a task holds does not grow with the units.
    """
    n = units.count()

    def draw(batches):
        md5 = hashlib.md5
        for b in batches:
            for d, first, end in zip(*(b.column(c).to_pylist() for c in ("draw", "first", "end")), strict=True):
                start = f"{seed}|{d}|".encode()
                digests = b"".join([md5(start + b"%d" % at).digest() for at in range(first, end)])
                slots = np.sort(np.frombuffer(digests, ">u4")[::4].astype(np.int64) % n)
                part = slots // PART
                begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                packed = [x.tobytes() for x in np.split((slots % PART).astype(np.uint16), begins[1:])]
                yield pa.record_batch([pa.array(part[begins]), pa.array(np.full(len(begins), d // BLOCK)), pa.array(np.full(len(begins), d, np.int32)), pa.array(packed, pa.binary())], ["part", "block", "draw", "slots"])

    def added(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((PART, len(cells)))
        table[own["slot"].to_numpy() % PART] = own[cells].to_numpy(float)
        sums = np.zeros((len(asked), len(cells)))
        for k, slots in enumerate(asked["slots"]):
            sums[k] = np.bincount(np.frombuffer(slots, np.uint16), minlength=PART) @ table
        return pd.DataFrame({"draw": asked["draw"], **{c: sums[:, k].astype(np.int64) for k, c in enumerate(cells)}})

    asked = _stretches(units, draws, n).mapInArrow(draw, "part bigint, block bigint, draw int, slots binary")
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((draws - 1) // BLOCK).cast("bigint")))
    known = _numbered(units.select(unit, *cells), unit, seed).select("slot", *cells, F.expr(f"slot div {PART}").alias("part"), blocks.alias("block"))
    sums = known.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(added, "draw int, " + ", ".join(f"{c} bigint" for c in cells))
    return sums.groupBy("draw").agg(*(F.sum(c).alias(c) for c in cells))


def bootstrap_auc(rows: DataFrame, unit: str, label: str, score: str, draws: int, seed: int) -> DataFrame:
    """95 % interval of the area under the ROC curve over the resamples of bootstrap(); draws of one class do not count.

    Scores are counted by unit. A task has one range of scores and a hundred
    draws; what lies in lower ranges is added from totals of ranges.
    """
    weights = resampled(rows.select(unit).distinct(), unit, draws, seed)
    cells = rows.where(F.col(score).isNotNull()).groupBy(F.col(unit).alias("unit"), F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    cuts = sorted(set(cells.approxQuantile("score", [i / ranks.RANGES for i in range(1, ranks.RANGES)], 0.25 / ranks.RANGES)))
    cells = cells.withColumn("range", F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c <= score))") if cuts else F.lit(0))
    block = 100
    parts = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))))
    asked = weights.withColumnRenamed(unit, "unit").join(cells.select("unit", F.col("range").alias("part")).distinct(), "unit").withColumn("block", F.expr(f"int(draw div {block})"))

    def counted(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"draw": [], "range": [], "pairs": [], "p": [], "q": []})
        own = own.sort_values("score")
        units = pd.Index(own["unit"].unique())
        draw, at = np.unique(asked["draw"].to_numpy(), return_inverse=True)
        times = np.zeros((len(draw), len(units)))
        times[at, units.get_indexer(asked["unit"])] = asked["times"]
        of = units.get_indexer(own["unit"])
        first = np.flatnonzero(np.r_[True, np.diff(own["score"].to_numpy()) != 0])
        p, n = (np.add.reduceat(times[:, of] * own[c].to_numpy(), first, 1) for c in ("positives", "n"))
        q = n - p
        return pd.DataFrame({"draw": draw, "range": own["range"].iloc[0], "pairs": (p * (np.cumsum(q, 1) - q / 2)).sum(1), "p": p.sum(1), "q": q.sum(1)})

    sums = parts.groupBy("range", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(counted, "draw int, range int, pairs double, p double, q double")
    lower = F.coalesce(F.sum("q").over(Window.partitionBy("draw").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    found = sums.withColumn("pairs", F.col("pairs") + F.col("p") * lower).groupBy("draw").agg(F.try_divide(F.sum("pairs"), F.sum("p") * F.sum("q")).alias("value")).where("value is not null")
    return found.agg(F.lit("roc_auc").alias("metric"), F.count("*").alias("draws"), F.percentile("value", F.lit(0.025)).alias("ci95_low"), F.percentile("value", F.lit(0.975)).alias("ci95_high"))


def bootstrap(rows: DataFrame, unit: str, label: str, predicted: str, draws: int, seed: int) -> DataFrame:
    """95 % intervals of rates over `draws` resamples of units with replacement.

    A resample needs of a unit only its four counts. Slots are drawn by hash
    among numbered units and counted, so a unit drawn often is weighted, not copied.
    """
    y, p = F.col(label) == 1, F.col(predicted) == 1
    units = rows.groupBy(unit).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    sums = resampled_sums(stored(units, "units"), unit, ["tp", "fp", "tn", "fn"], draws, seed)
    found = sums.select("draw", *(e.alias(n) for n, e in rates(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))).items() if n in ("precision", "recall", "f1")))
    long = found.unpivot(["draw"], ["precision", "recall", "f1"], "metric", "value")
    return long.groupBy("metric").agg(F.count("*").alias("draws"), F.percentile("value", F.lit(0.025)).alias("ci95_low"), F.percentile("value", F.lit(0.975)).alias("ci95_high"))


#: Cells of rows_bootstrap: ranges of about equal scores, each of both classes and both predictions.
CELLS = 4096


def rows_bootstrap(rows: DataFrame, label: str, predicted: str, score: str, draws: int, seed: int, cells: int = CELLS) -> DataFrame:
    """Points and 95 % intervals of rates and of the area under the curve over resamples of single rows.

    How often a resample of n rows takes from each of some cells is one multinomial
    draw, whatever rows they hold; it is split down a tree of ranges of scores, half
    by half, by binomial draws. So a resample costs the number of cells, and rows are
    read once to count them. Rates are exact. For the area, pairs of one range count
    as they do among its own rows; with few distinct scores each is a range and the
    area is exact too, else it is off by less than 1 / `cells`.
    """
    some = rows.select(F.col(label).cast("int").alias("y"), F.col(predicted).cast("int").alias("p"), F.col(score).cast("double").alias("s")).where("y is not null and p is not null and s is not null")
    cuts = sorted(set(some.approxQuantile("s", [i / cells for i in range(1, cells)], 0.25 / cells)))
    edges = some.sparkSession.sparkContext.broadcast(np.array(cuts))

    def place(batches):
        for b in batches:
            yield pa.record_batch([b.column("y"), b.column("p"), b.column("s"), pa.array(np.searchsorted(edges.value, b.column("s").to_numpy(), "right").astype(np.int32))], ["y", "p", "s", "r"])

    placed = some.mapInArrow(place, "y int, p int, s double, r int")
    values = placed.groupBy("r", "s").agg(*(F.count_if((F.col("y") == y) & (F.col("p") == p)).alias(f"n{y}{p}") for y in (0, 1) for p in (0, 1)))
    lower = F.coalesce(F.sum(F.col("n00") + F.col("n01")).over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = (F.col("n10") + F.col("n11")) * (lower + (F.col("n00") + F.col("n01")) / 2)
    sums = values.withColumn("wins", wins).groupBy("r").agg(*(F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11", "wins"))).orderBy("r")
    found = sums.toPandas()  # a row a range, `cells` at most
    counts, won = found[["n00", "n01", "n10", "n11"]].to_numpy(np.int64), found["wins"].to_numpy(float)
    inside = won / np.maximum(1, (counts[:, 2] + counts[:, 3]) * (counts[:, 0] + counts[:, 1]))
    names = ("precision", "recall", "f1", "roc_auc")

    def rates_of(drawn: np.ndarray) -> list[float | None]:
        tn, fp, fn, tp = drawn.sum(0).tolist()
        ones, zeros = drawn[:, 2] + drawn[:, 3], drawn[:, 0] + drawn[:, 1]
        pairs = (ones * (np.cumsum(zeros) - zeros + inside * zeros)).sum()
        part = lambda a, b: a / b if b else 0.0
        return [part(tp, tp + fp), part(tp, tp + fn), part(2 * tp, 2 * tp + fp + fn), pairs / ((tp + fn) * (tn + fp)) if (tp + fn) * (tn + fp) else None]

    def halved(n: int, many: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """n rows dealt to cells of `many` rows: level by level, each node's to its two halves."""
        size = 1 << max(0, int(len(many) - 1).bit_length())
        levels = [np.pad(many, (0, size - len(many)))]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(1))
        drawn = np.array([n])
        for level in levels[-2::-1]:
            left, whole = level[::2], level.reshape(-1, 2).sum(1)
            first = rng.binomial(drawn, np.where(whole > 0, left / np.maximum(1, whole), 0.0))
            drawn = np.stack([first, drawn - first], 1).ravel()
        return drawn[: len(many)]

    def draw(batches):
        for b in batches:
            out = [rates_of(halved(int(counts.sum()), counts.ravel(), np.random.default_rng([seed, d])).reshape(-1, 4)) for d in b.column("id").to_pylist()]
            yield pa.record_batch([pa.array(v, pa.float64()) for v in zip(*out, strict=True)], list(names))

    spark = rows.sparkSession
    schema = ", ".join(f"{n} double" for n in names)
    point = spark.createDataFrame([tuple(map(lambda v: None if v is None else float(v), rates_of(counts)))] if len(counts) else [], schema).unpivot([], list(names), "metric", "point")
    drawn = spark.range(draws).mapInArrow(draw, schema) if len(counts) else spark.createDataFrame([], schema)
    long = drawn.unpivot([], list(names), "metric", "value").where("value is not null")
    found = long.groupBy("metric").agg(F.count("*").alias("draws"), F.percentile("value", F.lit(0.025)).alias("ci95_low"), F.percentile("value", F.lit(0.975)).alias("ci95_high"))
    return point.join(F.broadcast(found), "metric", "left")  # four rows


def bootstrap_differences(rows: DataFrame, unit: str, label: str, first: str, second: str, draws: int, seed: int) -> DataFrame:
    """Point and 95 % interval of the first prediction's rates less the second's: both are taken over the same resamples of units."""
    return paired_differences(rows, unit, label, [(first, second)], draws, seed).drop("difference")


def paired_differences(rows: DataFrame, unit: str, label: str, pairs: list[tuple[str, str]], draws: int, seed: int) -> DataFrame:
    """bootstrap_differences of several pairs of predictions (`difference`: "first - second"), all over one set of resamples."""
    y = F.col(label) == 1
    number = {p: k for k, p in enumerate(dict.fromkeys(p for pair in pairs for p in pair))}
    cells = {f"{c}_{k}": F.count_if((y if t else ~y) & (F.col(p) == v)) for p, k in number.items() for c, t, v in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))}
    units = stored(rows.groupBy(unit).agg(*(e.alias(n) for n, e in cells.items())), "units")
    names = ("f1", "recall", "precision", "fpr")

    def gaps(sums: DataFrame, value: str) -> DataFrame:
        of = {p: rates(*(F.col(f"{c}_{k}") for c in ("tp", "fp", "tn", "fn"))) for p, k in number.items()}
        return sums.select(F.inline(F.array(*(F.struct(F.lit(f"{a} - {b}").alias("difference"), F.lit(n).alias("metric"), (of[a][n] - of[b][n]).alias(value)) for a, b in pairs for n in names))))

    point = gaps(units.agg(*(F.sum(c).alias(c) for c in cells)), "point")
    long = gaps(resampled_sums(units, unit, list(cells), draws, seed), "value")
    found = long.groupBy("difference", "metric").agg(F.count("*").alias("draws"), F.percentile("value", F.lit(0.025)).alias("ci95_low"), F.percentile("value", F.lit(0.975)).alias("ci95_high"))
    return point.join(F.broadcast(found), ["difference", "metric"])  # four rows a pair


def quantile_bins(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """`bin` of each row: right-closed quantile ranges from 1, equal edges merged, the least value in the first."""
    found = ranks.quantiles(rows, [], value, {f"q{i}": i / bins for i in range(bins + 1)})
    edges = found.select(F.array_distinct(F.array(*(f"q{i}" for i in range(bins + 1)))).alias("edges"))  # one row
    number = F.expr(f"greatest(1, size(filter(edges, e -> e < {value})))")
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", number).drop("edges")


def matched(rows: DataFrame, value: str, label: str, key: str, seed: int, options: tuple[int, ...] = (10, 8, 5), least: int = 5) -> DataFrame:
    """As many rows of each class in every bin of `value`: the first number of bins that leaves `least` of each, else sparse bins go."""
    for bins in options:
        binned = quantile_bins(rows, value, bins)
        counts = binned.groupBy("bin").agg(F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones")).withColumn("keep", F.least("zeros", "ones"))
        if not counts.where(F.col("keep") < least).isEmpty() and bins != options[-1]:
            continue
        some = binned.join(F.broadcast(counts.where(F.col("keep") >= least).select("bin", "keep")), "bin")  # a row a bin
        return least_hashed(some, ["bin", label], "keep", seed, key).withColumn("bins", F.lit(bins))
    raise ValueError("no bin options")
