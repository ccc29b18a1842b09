import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import collisions


def brute(rows, near):
    """n_links and component of each row of usable vectors, by all pairs of a label."""
    ids, labels, x = (np.array(v) for v in zip(*rows, strict=True))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= near) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (new == root).all():
            break
        root = new
    return {int(i): (int(n), int(r)) for i, n, r in zip(ids, linked.sum(1), root, strict=True)}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = rng.integers(0, n // 2, n // 2)  # copies at all distances around the limit, in chains, and one large group
    x[n // 2 :] = x[near] + rng.normal(size=(n - n // 2, dim)) * rng.uniform(0, 0.25, (n - n // 2, 1)) / np.sqrt(dim)
    x[: n // 8] = x[0] + rng.normal(size=(n // 8, dim)) * 0.1 / np.sqrt(dim)
    x[n // 2 : n // 2 + 20] = x[n // 2]
    return [(int(i), int(rng.integers(0, 2)), v.tolist()) for i, v in enumerate(x)]


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collisions.near_vectors(df, **options).collect()}


def test_whole_labels(spark):
    rows = clustered(600, 32, 0)
    assert got(spark, rows) == brute(rows, 0.98)


def test_cut_labels_and_blocks_of_visitors(spark):
    rows = clustered(900, 24, 1)
    want = brute(rows, 0.98)
    assert max(n for n, _ in want.values()) > 40
    assert got(spark, rows, leaf=64, visitors=50) == want


def test_few_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))]
    assert got(spark, rows, leaf=50) == brute(rows, 0.98)


def test_vectors_that_no_projection_tells_apart(spark):
    """Different lengths of one direction: all unit vectors are equal, and hashes deal them out."""
    rows = [(i, 0, [2.0**i, 0.0]) for i in range(40)]
    assert got(spark, rows, leaf=8) == {i: (39, 0) for i in range(40)}


def test_odd_vectors(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, None), (2, 1, [0.0, 0.0]), (3, 1, [1.0, None]), (4, 1, [float("nan"), 1.0]), (5, 1, [float("inf"), 1.0]),
        (6, 1, [1e200, 1e190]), (7, 1, []), (8, 1, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0]), (9, None, [1.0, 0.0]), (10, 2, [1.0, 0.0]), (11, 1, [-0.0, 1.0]), (12, 1, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("n", F.lit("x")).withColumn("node", F.lit(None).cast("int"))
    found = [tuple(r) for r in collisions.near_vectors(df).select("vec_id", "n_links", "component_id").collect()]
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 7, 8, None, 9, 10)]
    assert sorted(found, key=str) == sorted([(0, 2, 0), (0, 2, 0), (6, 2, 0), (11, 1, 11), (12, 1, 11), *alone], key=str)
    assert collisions.near_vectors(df.limit(0)).count() == 0


def test_calibrated_count():
    rng = np.random.default_rng(3)
    for dim in (8, 64, 300):
        step = rng.normal(size=(200_000 // dim * 8, dim))
        step *= 0.2 / np.linalg.norm(step, axis=1)[:, None]
        hits = (np.abs(step @ collisions.directions(dim)) <= collisions.half_window(0.2, dim, collisions.WINDOW)).sum(1)
        assert (hits >= collisions.needed(0.2, dim)).mean() > 0.9999
