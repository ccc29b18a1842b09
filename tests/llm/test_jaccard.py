import re

import numpy as np
import pytest

from linkloom.llm import jaccard
from linkloom.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"W{i}" for i in range(200)]
    bases = [list(rng.choice(words, rng.integers(3, 90))) for _ in range(12)]
    common = list(rng.choice(words, 30))
    docs = []
    for i in rng.permutation(260):
        own = list(bases[rng.integers(0, 12)])
        for _ in range(rng.integers(0, 5)):
            own[rng.integers(0, len(own))] = rng.choice(words)
        docs.append((int(i), " ".join(own + common * (rng.random() < 0.2))))
    got = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(docs)
    kept = jaccard.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(docs)})


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7), (200, 150), (150, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = sorted(((r["doc_id"] or 0, r["size"], r["component"]) for r in jaccard.similar_documents(odd).collect()), key=str)
    assert len(rows) == odd.count()
    assert [r for r in rows if r[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [r for r in rows if r[0] in (4, 5)] == [(4, 3, 4), (4, 3, 4), (5, 3, 4)]
    assert jaccard.similar_documents(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9]


@pytest.mark.parametrize("bits", [3, 64])
def test_sets_that_share_a_hash(spark, bits):
    """With three bits of the first hash nearly all sets share their names; the second hash tells them apart."""
    docs = [(i, f"w{i} " * 3 + f"one two three four five w{i % 7}") for i in range(40)] + [(i, f"the same text number {i % 3} of a few words") for i in range(100, 130)]
    got = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bits=bits)
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_split_lists_blocks_and_large_roots(spark, monkeypatch):
    """Small limits, so that lists are dealt to several tasks, joined by blocks, tried in two passes, and large components broadcast."""
    for name, value in (("LONG", 4), ("BLOCK", 3), ("EARLY", 2), ("LARGE", 3)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(150)]
    bases = [list(rng.choice(words, 40)) for _ in range(5)]
    docs = []
    for i in rng.permutation(120):
        own = list(bases[min(4, int(rng.integers(0, 9)))])
        for _ in range(rng.integers(0, 4)):
            own[rng.integers(0, len(own))] = rng.choice(words)
        docs.append((int(i), " ".join(own)))
    got = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    words = rng.choice([f"v{i}" for i in range(5000)], 120_000).tolist()
    docs = [(3, " ".join(words)), (1, " ".join(words[:110_000])), (2, " ".join(words[:60_000])), (7, "a few words of its own here")]
    got = {r["doc_id"]: r["component"] for r in jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 7: 7}
