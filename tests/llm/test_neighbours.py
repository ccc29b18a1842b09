import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import neighbours


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != i][:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1500:1600] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(rows, F.col("vec_id") % 100 == 0, shard=700, block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(np.arange(3000), x.astype(float), range(0, 3000, 100), 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95 and got.keys() == want.keys()
    assert [i for i, _ in got[0]] == list(range(1500, 1510))  # ties go to smaller ids
    for q, own in got.items():
        assert all(abs(d - np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum())) < 1e-9 for i, d in own) and len(own) == 10


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, []), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.5]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("node", F.lit(None).cast("int"))
    got = neighbours.nearest(df, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 6, 1.0), (0, 2, 9, 1.0), (6, 1, 9, 0.0), (6, 2, 0, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_ties_go_to_smaller_ids(spark):
    """Integer grids, where many distances are equal; every vector lies inside the beam."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.stack(np.meshgrid(range(1, 6), range(1, 6), range(1, 5)), -1).reshape(-1, 3).astype(float)
        ids = rng.permutation(1000)[: len(x)]
        rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
        some = np.flatnonzero(ids % 7 == 0)
        got = {}
        for r in neighbours.nearest(rows, F.col("vec_id") % 7 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == {q: [i for i, _ in own] for q, own in brute(ids, x, some, 10).items()}


def test_recall_of_a_whole_shard():
    """Separate clusters, as many vectors as a shard of production holds, and its beam."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64)) * 2
    x = centres[rng.integers(0, 40, 4096)] + rng.normal(size=(4096, 64)) * 0.3
    graph, entries = neighbours.build_graph(x)
    q = x[:200]
    found, _ = neighbours.beam_search(x, graph, entries, q, neighbours.BEAM)
    want = np.argsort(((x[None] - q[:, None]) ** 2).sum(2), 1)[:, 1:11]
    hits = sum(len(set(f[1:11].tolist()) & set(w.tolist())) for f, w in zip(found, want, strict=True))
    assert hits / want.size >= 0.9
