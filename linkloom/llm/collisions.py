"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors of cosine `near` or more are at most d = sqrt(2 - 2 near) apart, and
so are their projections on any direction; on random orthonormal directions of
D dimensions they differ by about d / sqrt(D). Each vector asks every sorted
projection for the window around its own place; vectors that lie in enough of
its windows are compared in full. How many are enough is calibrated: the largest
number that a pair at distance d reaches with probability RECALL.

Labels of more vectors than a leaf are cut at medians, level by level, along the
projection that spreads the leaf most. A vector is owned by the side that it lies
on and, near a cut, visits the other, so that tasks hold bounded leaves whatever a
label holds. Tasks return counts of links and the links of a spanning forest, not
pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored
from linkloom.llm.components import components

#: Directions, and the share of pairs at the limit distance that the number of collisions has to let pass.
PROJECTIONS, RECALL = 16, 0.99999
#: Half a window in standard deviations of the difference of a pair at the limit: of counting, and of visits beyond a cut.
WINDOW, MARGIN = 2.0, 3.5
#: Vectors that a leaf owns at most, and visitors that a task compares with them.
LEAF, VISITORS = 2048, 8192
#: Cuts of a level up to this number (rows of under 100 bytes) are broadcast, more are joined by shuffle.
SMALL = 10_000
BLOCK = 256
LEVELS = 60


def directions(dim: int) -> np.ndarray:
    """dim x m orthonormal columns in random directions, the same in every task."""
    square = np.random.default_rng(dim).standard_normal((dim, dim))
    return np.linalg.qr(square)[0][:, : min(dim, PROJECTIONS)]


def half_window(distance: float, dim: int, deviations: float) -> float:
    """Projections of a pair at `distance` differ by at most this, up to `deviations`; never by more than the distance itself."""
    return min(distance, deviations * distance / math.sqrt(dim)) * (1 + 1e-12) + 1e-15


def needed(distance: float, dim: int) -> int:
    """The collisions, of all projections, that a pair at `distance` reaches with probability RECALL.

    Coordinates of a random unit vector have lighter tails than the normal
    distribution that is taken here, and squares of the differences in
    orthonormal directions add up to distance ** 2 at most.
    """
    m, half = min(dim, PROJECTIONS), half_window(distance, dim, WINDOW)
    if half >= distance:
        return m
    p = math.erf(half / distance * math.sqrt(dim / 2))
    tail = 0.0
    for missed in range(m + 1):
        tail += math.comb(m, missed) * (1 - p) ** missed * p ** (m - missed)
        if tail >= RECALL:
            return m - missed
    return 0


class Forest:
    """Joins the rows of a task by links and keeps one link of each join."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, first = np.unique(np.maximum(ra, rb), return_index=True)  # each root hangs below one smaller root
            self.root[high] = np.minimum(ra, rb)[first]
            self.kept.append(np.stack([a[first], b[first]], 1))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def links(self) -> np.ndarray:
        return np.concatenate(self.kept) if self.kept else np.zeros((0, 2), int)


def compared(own: np.ndarray, own_places: np.ndarray, asked: np.ndarray, asked_places: np.ndarray, near: float, same: bool):
    """Blocks (asked row, own row) of pairs with cosine `near` or more; `same`: both are one table, each pair once."""
    dim = own.shape[1]
    distance = math.sqrt(max(0.0, 2 - 2 * near))
    half, enough = half_window(distance, dim, WINDOW), needed(distance, dim)
    orders = np.argsort(own_places, 0, kind="stable")
    lists = np.take_along_axis(own_places, orders, 0)
    for at in range(0, len(asked), BLOCK):
        places = asked_places[at : at + BLOCK]
        counts = np.zeros((len(places), len(own)), np.int8)
        for k in range(places.shape[1]):
            begin, end = np.searchsorted(lists[:, k], places[:, k] - half, "left"), np.searchsorted(lists[:, k], places[:, k] + half, "right")
            order = orders[:, k]
            for row, s, e in zip(counts, begin, end, strict=True):
                row[order[s:e]] += 1
        a, b = np.nonzero(counts >= enough)
        if same:
            later = b > a + at
            a, b = a[later], b[later]
        block = asked[at : at + BLOCK]
        if 50 * len(a) > counts.size:
            cosine = (block @ own.T)[a, b]
        else:
            cosine = np.einsum("nd,nd->n", block[a], own[b])
        yield a[cosine >= near] + at, b[cosine >= near]


def with_places(units: DataFrame) -> DataFrame:
    """`places`: where the unit vectors lie on all projections."""

    def run(frames):
        for f in frames:
            places = pd.Series([None] * len(f), dtype=object)
            sizes = f["unit"].map(len).to_numpy()
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                found = np.stack(f["unit"].to_numpy()[rows]) @ directions(int(dim))
                for i, p in zip(rows, found, strict=True):
                    places[i] = p
            yield f.assign(places=places)

    return units.mapInPandas(run, units.withColumn("places", F.col("unit")).schema)


def dealt(nodes: DataFrame, distance: float, leaf: int) -> DataFrame:
    """(node, label, dim, leaf, own): the leaf that owns each node, and those that it visits.

    Of two nodes at most `distance` apart, one visits the leaf that owns the other,
    or one leaf owns both: surely with cuts of few dimensions, else but for pairs
    that lie across a cut and differ by over MARGIN deviations in its direction.
    """
    key = ["label", "dim", "leaf"]
    margin = F.least(F.lit(distance), MARGIN * distance / F.sqrt("dim")) * (1 + 1e-12) + 1e-15
    rows = nodes.select("node", "label", "dim", "places", F.lit(1).cast("bigint").alias("leaf"), F.lit(True).alias("own"))
    closed = []
    for _ in range(LEVELS):
        sizes = rows.where("own").groupBy(*key).agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > leaf).select(*key), "large")
        n_large = large.count()
        if not n_large:
            break
        few = F.broadcast(large) if n_large <= SMALL else large
        closed.append(rows.join(few, key, "left_anti").drop("places"))
        open_rows = rows.join(few, key)
        found = open_rows.where("own").groupBy(*key).agg(
            *(F.percentile_approx(F.get("places", F.lit(k)), [0.25, 0.5, 0.75], 1000).alias(f"q{k}") for k in range(PROJECTIONS)),
            *(F.max(F.get("places", F.lit(k))).alias(f"m{k}") for k in range(PROJECTIONS)),
        )
        axes = [F.struct((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]).alias("spread"), F.lit(k).alias("axis"), F.col(f"q{k}")[1].alias("at"), F.col(f"m{k}").alias("most")) for k in range(PROJECTIONS)]
        widest = F.array_max(F.filter(F.array(*axes), lambda a: a["at"] < a["most"]))  # none: the places of all are one, and hashes deal them out
        cuts = stored(found.select(*key, widest.alias("cut")), "cuts")
        joined = open_rows.join(F.broadcast(cuts) if n_large <= SMALL else cuts, key)
        even = F.pmod(F.xxhash64("node", "leaf"), F.lit(2)).cast("double")
        x = F.coalesce(F.get("places", F.col("cut.axis")), even) - F.coalesce(F.col("cut.at"), F.lit(0.5))
        m = F.when(F.col("cut").isNotNull(), margin).otherwise(2.0)

        def child(side: int, own: Column, here: Column) -> Column:
            return F.when(here, F.struct((F.col("leaf") * 2 + side).alias("leaf"), own.alias("own")))

        low, high = F.col("x") <= 0, F.col("x") > 0
        children = F.array(
            child(0, F.col("own"), F.when(F.col("own"), low).otherwise(F.col("x") <= F.col("m"))),
            child(1, F.col("own") & high, F.when(F.col("own"), high | (F.col("x") > -F.col("m"))).otherwise(F.col("x") > -F.col("m"))),
        )
        split = joined.withColumns({"x": x, "m": m}).withColumn("child", F.explode(F.array_compact(children)))
        rows = stored(split.select("node", "label", "dim", "places", "child.leaf", "child.own"), "dealt")
    out = rows.drop("places")
    for c in closed:
        out = out.unionByName(c)
    return out


def links_of(nodes: DataFrame, near: float, leaf: int, visitors: int) -> DataFrame:
    """(a, b) links of spanning forests, and (a, n_links) counts of the rows that nodes are linked with directly."""
    distance = math.sqrt(max(0.0, 2 - 2 * near))
    placed = dealt(nodes, distance, leaf)
    key = ["label", "dim", "leaf"]
    blocks = placed.where("not own").groupBy(*key).agg(F.ceil(F.count("*") / visitors).alias("blocks"))
    with_blocks = placed.join(blocks, key, "left").fillna(1, ["blocks"])
    to = F.when(F.col("own"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    tasks = with_blocks.withColumn("block", F.explode(to)).select("node", *key, "own", "block").join(nodes.select("node", "first", "n", "unit", "places"), "node")

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["own", "node"], ascending=[False, True])
        unit, places = np.stack(f["unit"].to_list()), np.stack(f["places"].to_list())
        own, many, first = int(f["own"].sum()), f["n"].to_numpy().astype(float), f["first"].to_numpy()
        counts, forest = np.zeros(len(f)), Forest(len(f))

        def take(a, b):
            np.add.at(counts, a, many[b])
            np.add.at(counts, b, many[a])
            forest.add(a, b)

        if k[3] == 0:
            for a, b in compared(unit[:own], places[:own], unit[:own], places[:own], near, True):
                take(a, b)
        if own:
            for a, b in compared(unit[:own], places[:own], unit[own:], places[own:], near, False):
                take(a + own, b)
        found = forest.links()
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.concatenate([first[found[:, 0]], f["node"].to_numpy()[some]]),
            "b": pd.array([*first[found[:, 1]], *[None] * len(some)], "Int64"),
            "n_links": pd.array([*[None] * len(found), *counts[some].astype(int)], "Int64"),
        })

    return tasks.groupBy("label", "dim", "leaf", "block").applyInPandas(run, "a bigint, b bigint, n_links bigint")


def near_vectors(vectors: DataFrame, near: float = 0.98, leaf: int = LEAF, visitors: int = VISITORS) -> DataFrame:
    """vec_id, label, n_links (other rows of the label that are linked directly) and component_id of every row.

    Rows of one label are linked if their cosine is `near` or more; component_id is
    the smallest vec_id that links lead to, the row's own included. Rows whose vector
    is null, empty, zero or holds null or non-finite components, and rows without
    label or id, are linked with nothing; their component is their own id. Vectors of
    different lengths are not compared. Equal vectors of a label are compared once and
    counted each, repeated rows too. Vectors with one smallest id (an id can have
    several vectors) are one in components. Other columns are left unread, and an
    empty table gives no rows.
    """
    finite = F.expr("size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vector, v -> v <> 0)")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.transform("vector", lambda v: v + F.lit(0.0))))
    some = rows.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    scaled = F.expr("transform(vector, v -> v / array_max(transform(vector, w -> abs(w))))")
    length = F.expr("sqrt(aggregate(scaled, 0D, (s, v) -> s + v * v))")
    units = some.withColumn("scaled", scaled).withColumn("length", length).withColumn("unit", F.expr("transform(scaled, v -> v / length)")).drop("scaled", "length")
    nodes = stored(with_places(units.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")})), "vectors")
    found = stored(links_of(nodes, near, leaf, visitors), "links")
    counts = found.where("n_links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("others"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("first"), "root")
    of_nodes = nodes.select("node", "label", "vector", "n", "first").join(counts, "node", "left").join(roots, "first", "left")
    values = of_nodes.selectExpr("label", "vector", "n - 1 + coalesce(others, 0) as n_links", "coalesce(root, first) as component_id")
    taken = rows.where("vector is not null").join(values, ["label", "vector"]).select("vec_id", "label", "n_links", "component_id")
    return taken.unionByName(rows.where("vector is null").select("vec_id", "label", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
