"""Leakage-free grouped splits: components of rows that share a domain or a template, and their assignment."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import ranks
from linkloom.operators.clean import hashed
from linkloom.sources.scratch import stored

#: Templates used so often connect rows; more often they are generic and only reported.
LEAST, MOST = 3, 30
TARGETS = {"test": 0.15, "val": 0.15}
#: Groups of one candidate in a task, about, as long as there are not more than RANGES ranges.
RANGE, RANGES = 1 << 14, 1024
#: Hashes of groups that a task takes, about; and ranges of one candidate that a round folds at most.
TRIES, WINDOW = 4_000_000, 8


def split_groups(rows: DataFrame, key: str, domain: str, template: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Adds `group_id`, the smallest key among rows linked by a domain or a template used `least` to `most` times.

    Labels of domains and templates take turns in passing the smallest key on,
    so no row-to-row links are made. Rounds go to the shared folder.
    """
    used = rows.groupBy(template).agg(F.count("*").alias("_uses")).where(F.col("_uses").between(least, most)).select(template, F.lit(True).alias("_merge"))
    rows = rows.join(used, template, "left").withColumn("_t", F.when(F.col("_merge"), F.col(template))).drop("_merge")
    links = stored(rows.groupBy(domain, "_t").agg(F.min(key).alias("least")), "links")
    label = stored(links.groupBy(domain).agg(F.min("least").alias("label")), "labels")
    while True:
        by_template = links.where("_t is not null").join(label, domain).groupBy("_t").agg(F.min("label").alias("through"))
        reached = links.join(by_template, "_t").groupBy(domain).agg(F.min("through").alias("through"))
        moved = stored(label.join(reached, domain, "left").select(domain, F.least("label", "through").alias("label"), (F.col("through") < F.col("label")).alias("moved")), "labels")
        label = moved.select(domain, "label")
        if moved.where("moved").isEmpty():
            break
    return rows.join(label.withColumnRenamed("label", "group_id"), domain).drop("_t")


def numbered_groups(grouped: DataFrame, order: str = "group_id") -> DataFrame:
    """(group_id, name) with names G00000, ... in the order of their first appearance, the least `order` of their rows."""
    first = grouped.groupBy("group_id").agg(F.min(order).alias("_first"))
    return ranks.numbered(first, ["_first", "group_id"], "_number").select("group_id", F.format_string("G%05d", "_number").alias("name"))


def _ordered(groups: DataFrame, candidates: list[int], seed: int, ranges: int) -> DataFrame:
    """Every group with every candidate, its hash there (`_order`) and the number of the range of hashes (`_range`); never written out."""
    numbers = groups.sparkSession.createDataFrame([(c,) for c in candidates], "candidate int")
    tries = groups.select("group_id", "zeros", "ones").crossJoin(F.broadcast(numbers)).withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed)), "candidate", "group_id")))
    return tries.withColumn("_range", F.expr(f"cast(cast(conv(substr(_order, 1, 8), 16, 10) as bigint) * {ranges} div 4294967296 as int)"))


def _dealt(groups: DataFrame, candidates: int, many: int) -> DataFrame:
    """The groups over so many tasks that one hashes about TRIES of them, all candidates taken together: files of a small table would be one task."""
    least = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("group_id", "zeros", "ones").repartition(max(least, -(-many * candidates // TRIES)))


def _hashes(seed: int, candidate: int, names: list[bytes], ranges: int) -> tuple[list[bytes], np.ndarray]:
    """The digests of `_ordered` for groups of these names, as bytes, and the numbers of their ranges."""
    start, md5 = f"{seed}|{candidate}|".encode(), hashlib.md5
    digests = [md5(start + n).digest() for n in names]
    return digests, ((np.frombuffer(b"".join(digests), ">u4")[::4].astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _range_sums(dealt: DataFrame, candidates: list[int], seed: int, ranges: int) -> np.ndarray:
    """Zeros, ones and the largest group of each range of hashes of each candidate: an array of len(candidates) x ranges x 3."""

    def run(batches):
        sums = np.zeros((len(candidates), ranges, 3), np.int64)
        for b in batches:
            names = [b"%d" % g for g in b.column("group_id").to_pylist()]
            zeros, ones = (b.column(c).to_numpy() for c in ("zeros", "ones"))
            for own, c in zip(sums, candidates, strict=True):
                if names:
                    _, at = _hashes(seed, c, names, ranges)
                    own[:, 0] += np.bincount(at, zeros, ranges).astype(np.int64)
                    own[:, 1] += np.bincount(at, ones, ranges).astype(np.int64)
                    np.maximum.at(own[:, 2], at, zeros + ones)
        for k, own in enumerate(sums):
            there = np.flatnonzero(own.any(1))
            if len(there):
                yield pa.record_batch([pa.array(np.full(len(there), k)), pa.array(there), *(pa.array(own[there, x]) for x in range(3))], ["k", "at", "zeros", "ones", "largest"])

    parts = dealt.mapInArrow(run, "k bigint, at bigint, zeros bigint, ones bigint, largest bigint")
    whole = parts.groupBy("k", "at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.max("largest").alias("largest"))
    out = np.zeros((len(candidates), ranges, 3), np.int64)
    for r in whole.toLocalIterator():  # len(candidates) x RANGES at most, held as 24 bytes each
        out[r["k"], r["at"]] = r["zeros"], r["ones"], r["largest"]
    return out


def _asked(dealt: DataFrame, asked: dict[int, tuple[int, int]], seed: int, ranges: int) -> DataFrame:
    """(candidate, _order, group_id, zeros, ones) of the groups in the asked ranges [first, end) of each candidate."""

    def run(batches):
        for b in batches:
            ids, zeros, ones = (b.column(c).to_numpy() for c in ("group_id", "zeros", "ones"))
            names = [b"%d" % g for g in ids.tolist()]
            for c, (first, end) in asked.items():
                digests, at = _hashes(seed, c, names, ranges) if names else ([], np.zeros(0, np.int64))
                there = np.flatnonzero((at >= first) & (at < end))
                if len(there):
                    order = [digests[i].hex() for i in there.tolist()]
                    yield pa.record_batch([pa.array(np.full(len(there), c, np.int32)), pa.array(order), *(pa.array(x[there]) for x in (ids, zeros, ones))], ["candidate", "_order", "group_id", "zeros", "ones"])

    return dealt.mapInArrow(run, "candidate int, _order string, group_id bigint, zeros bigint, ones bigint")


def _placed(own: pd.DataFrame, state: list[int], half: dict[str, float]) -> list[str]:
    """The split of each group of `own`, in hashed order; `state` (zeros, ones and largest group of each split) goes on."""
    out = []
    for zeros, ones in zip(own["zeros"].tolist(), own["ones"].tolist(), strict=True):
        for k, (s, target) in enumerate(half.items()):
            if state[3 * k] + zeros <= target and state[3 * k + 1] + ones <= target:
                state[3 * k] += zeros
                state[3 * k + 1] += ones
                state[3 * k + 2] = max(state[3 * k + 2], zeros + ones)
                out.append(s)
                break
        else:
            out.append("train")
    return out


def _folded(groups: DataFrame, candidates: list[int], seed: int, total: int, assign: bool, most: int) -> tuple[dict[int, list[int]], list[DataFrame]]:
    """What each candidate has in test and val at the end (_placed's state) and, with `assign`, the tables of splits by group.

    One pass adds up each range of hashes of each candidate. A range that fits into
    test as a whole goes there, one that fits into val while no class of groups fits
    into test goes to val, and once no class fits anywhere the rest is train; all this
    takes sums only. What is left are the few ranges in which test or val fills up:
    rounds fold the next one of every candidate, group by group, a task a candidate;
    of a candidate that needs more rounds, the next 2, 4 and then WINDOW at once.
    There are RANGES at most, so the number of jobs does not grow with the groups.
    """
    half = {s: share * total / 2 for s, share in TARGETS.items()}
    targets, names = list(half.values()), list(half)
    many = groups.count()
    ranges = max(1, min(RANGES, -(-many // most)))
    dealt = _dealt(groups, len(candidates), many)
    classes: list[tuple[int, int]] = []  # those than which no other is smaller: if any class fits, one of these does
    for zeros, ones in sorted((r["zeros"], r["ones"]) for r in groups.groupBy("zeros").agg(F.min("ones").alias("ones")).toLocalIterator()):
        if not classes or ones < classes[-1][1]:
            classes.append((zeros, ones))
    sums = dict(zip(candidates, _range_sums(dealt, candidates, seed, ranges).tolist(), strict=True))
    state = {c: [0] * (3 * len(half)) for c in candidates}
    at = dict.fromkeys(candidates, 0)
    window = dict.fromkeys(candidates, 1)
    whole: list[tuple[int, int, str]] = []
    tables = []

    def fits(now: list[int], k: int, zeros: int, ones: int) -> bool:
        return now[3 * k] + zeros <= targets[k] and now[3 * k + 1] + ones <= targets[k]

    def passed(c: int) -> bool:
        """Goes on as far as sums tell; whether there is a range to fold."""
        now = state[c]
        room: dict[tuple[int, int, int], bool] = {}
        while at[c] < ranges:
            for k in range(len(half)):
                key = (k, now[3 * k], now[3 * k + 1])
                if key not in room:
                    room[key] = any(fits(now, k, *x) for x in classes)
            free = [k for k in range(len(half)) if room[k, now[3 * k], now[3 * k + 1]]]
            zeros, ones, largest = sums[c][at[c]]
            if free and not fits(now, free[0], zeros, ones):
                return True
            if free:
                k = free[0]
                now[3 * k] += zeros
                now[3 * k + 1] += ones
                now[3 * k + 2] = max(now[3 * k + 2], largest)
            whole.append((c, at[c], names[free[0]] if free else "train"))
            at[c] += 1
        return False

    def folding(before: dict[int, list[int]]):
        def fold(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(["_order", "group_id"])
            now = list(before[int(own["candidate"].iloc[0])])
            splits = _placed(own, now, half)
            if not assign:
                own, splits = own.iloc[-1:], splits[-1:]
            return own.assign(split=splits, state=[*[None] * (len(own) - 1), now])[["candidate", "group_id", "zeros", "ones", "split", "state"]]

        return fold

    while waiting := [c for c in candidates if passed(c)]:
        before = {c: list(state[c]) for c in waiting}
        asked = {c: (at[c], min(ranges, at[c] + window[c])) for c in waiting}
        part = _asked(dealt, asked, seed, ranges).groupBy("candidate").applyInPandas(folding(before), "candidate int, group_id bigint, zeros bigint, ones bigint, split string, state array<bigint>")
        if assign:
            part = stored(part, "splits")
            tables.append(part.drop("state"))
        for r in part.where("state is not null").select("candidate", "state").collect():  # a row a candidate
            state[r["candidate"]] = list(r["state"])
        for c in waiting:
            at[c], window[c] = asked[c][1], min(WINDOW, 2 * window[c])
    if assign and whole:
        places = groups.sparkSession.createDataFrame(whole, "candidate int, _range int, split string")
        tables.append(_ordered(dealt, candidates, seed, ranges).join(F.broadcast(places), ["candidate", "_range"]).select("candidate", "group_id", "zeros", "ones", "split"))
    return state, tables


def greedy_candidates(groups: DataFrame, candidates: int | list[int], seed: int, total: int, most: int = RANGE) -> DataFrame:
    """(candidate, group_id, zeros, ones, split): for each candidate, groups in hashed order fill test, then val, each class up to its target."""
    numbers = list(range(candidates)) if isinstance(candidates, int) else candidates
    _, tables = _folded(groups, numbers, seed, total, True, most)
    if not tables:
        return groups.selectExpr("0 as candidate", "group_id", "zeros", "ones", "'train' as split").limit(0)
    return reduce(DataFrame.unionByName, tables)


def searched_candidates(groups: DataFrame, candidates: int, seed: int, most: int = RANGE) -> DataFrame:
    """The score of each candidate (see score_candidates), without writing out its splits."""
    whole = groups.agg(F.coalesce(F.sum("zeros"), F.lit(0)).alias("zeros"), F.coalesce(F.sum("ones"), F.lit(0)).alias("ones")).first()
    state, _ = _folded(groups, list(range(candidates)), seed, whole["zeros"] + whole["ones"], False, most)
    rows = []
    for c, now in state.items():
        parts = {s: now[3 * k : 3 * k + 3] for k, s in enumerate(TARGETS)}
        parts["train"] = [whole[x] - sum(p[k] for p in parts.values()) for k, x in enumerate(("zeros", "ones"))] + [0]  # the largest group of train does not count
        rows += [(c, s, zeros + ones, ones, largest) for s, (zeros, ones, largest) in parts.items() if zeros + ones]
    return score_splits(groups.sparkSession.createDataFrame(rows, "candidate int, split string, n bigint, ones bigint, largest bigint"))


def score_candidates(assigned: DataFrame, tolerance: float = 0.03, largest: float = 0.25) -> DataFrame:
    """The split objective of each candidate; lower is better."""
    size = F.col("zeros") + F.col("ones")
    return score_splits(assigned.groupBy("candidate", "split").agg(F.sum(size).alias("n"), F.sum("ones").alias("ones"), F.max(size).alias("largest")), tolerance, largest)


def score_splits(per: DataFrame, tolerance: float = 0.03, largest: float = 0.25) -> DataFrame:
    """The same from the rows, ones and largest group of each split of each candidate."""
    per = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("candidate")))
    target = F.when(F.col("split") == "train", 1 - sum(TARGETS.values())).otherwise(F.when(F.col("split") == "test", TARGETS["test"]).otherwise(TARGETS["val"]))
    positive = F.col("ones") / F.col("n")
    penalty = (
        F.when((F.col("ones") == 0) | (F.col("ones") == F.col("n")), 10.0).otherwise(0.0) + F.when(F.abs(F.col("share") - target) > tolerance, 10.0).otherwise(0.0)
        + F.when((F.col("split") != "train") & (F.col("largest") / F.col("n") > largest), 1.0).otherwise(0.0)
    )
    scored = per.withColumn("part", F.abs(F.col("share") - target) + F.abs(positive - 0.5) + penalty)
    return scored.groupBy("candidate").agg(F.sum("part").alias("score"), F.count("*").alias("splits")).withColumn("score", F.col("score") + (3 - F.col("splits")) * 21.0)


def best_candidate(scores: DataFrame) -> DataFrame:
    """The lowest score; ties (within rounding of sums) go to the lowest number."""
    return scores.withColumn("score", F.round("score", 12)).agg(F.min_by("candidate", F.struct("score", "candidate")).alias("candidate"), F.min("score").alias("score"))


def dealt_classes(classes: list[tuple[int, int, int]], folds: int) -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    """The folds that groups of each class (zeros, ones, number of groups) go to, one after another: a beginning, and a cycle that repeats.

    Groups whose zeros and ones differ most come first, and each goes to the fold that
    leaves the shares of both classes most even over the folds, the fold of fewest
    rows and then of lowest number if several do. Groups of one class are alike, so
    once the folds stand to each other as they did before, their turns repeat.
    """
    held = [[0, 0] for _ in range(folds)]
    totals = [sum(c[x] * c[2] for c in classes) for x in (0, 1)]
    out = {}
    for zeros, ones, many in sorted(classes, key=lambda c: (-abs(c[0] - c[1]), -c[0], -c[1])):
        own = (zeros, ones)
        seen: dict[tuple, int] = {}
        turns: list[int] = []
        begin = None
        for step in range(many):
            least = [min(h[x] for h in held) for x in (0, 1)]
            key = tuple(h[x] - least[x] for h in held for x in (0, 1))
            if key in seen:
                begin = seen[key]
                break
            seen[key] = step
            turns.append(_evenest(held, own, totals))
            for x in (0, 1):
                held[turns[-1]][x] += own[x]
        out[own] = (turns, []) if begin is None else (turns[:begin], turns[begin:])
        if begin is not None:
            cycle = turns[begin:]
            rounds, rest = divmod(many - len(turns), len(cycle))
            for k, fold in enumerate(cycle):
                for x in (0, 1):
                    held[fold][x] += own[x] * (rounds + (k < rest))
    return out


def _evenest(held: list[list[int]], own: tuple[int, int], totals: list[int]) -> int:
    k = len(held)
    sums = [sum(h[x] for h in held) + own[x] for x in (0, 1)]
    squares = [sum(h[x] * h[x] for h in held) for x in (0, 1)]

    def uneven(h: list[int]) -> float:
        spread = [k * (squares[x] + 2 * h[x] * own[x] + own[x] * own[x]) - sums[x] * sums[x] for x in (0, 1)]
        return round(sum(math.sqrt(s) / max(1, t) for s, t in zip(spread, totals, strict=True)), 12)

    return min(range(k), key=lambda f: (uneven(held[f]), sum(held[f]), f))


def stratified_folds(per_group: DataFrame, folds: int, seed: int) -> DataFrame:
    """Adds `fold` to groups (group_id, zeros, ones): whole groups are dealt so that folds hold even shares of both classes (dealt_classes).

    Only the number of groups of each (zeros, ones) is dealt on the driver; groups of
    one class take their turns in hashed order, by their number in it, which no single
    task counts.
    """
    counts = per_group.groupBy("zeros", "ones").agg(F.count("*").alias("n"))
    turns = dealt_classes([(r["zeros"], r["ones"], r["n"]) for r in counts.toLocalIterator()], folds)
    rows = [(z, o, first, cycle) for (z, o), (first, cycle) in turns.items()]
    table = per_group.sparkSession.createDataFrame(rows, "zeros bigint, ones bigint, first array<int>, cycle array<int>")
    placed = ranks.numbered_within(per_group.withColumn("_hash", hashed(seed, "group_id")), ["zeros", "ones"], ["_hash", "group_id"], "_place")
    joined = placed.join(F.broadcast(table) if len(rows) <= 10_000 else table, ["zeros", "ones"])
    fold = F.when(F.col("_place") < F.size("first"), F.get("first", F.col("_place").cast("int"))).otherwise(F.get("cycle", ((F.col("_place") - F.size("first")) % F.size("cycle")).cast("int")))
    return joined.select(*per_group.columns, fold.alias("fold"))
