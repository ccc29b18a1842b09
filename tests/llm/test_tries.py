import hashlib
import random
import zlib

from pyspark.sql import functions as F

from linkloom.llm import tries


def conversations(turns):
    out = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in out.items()}


def brute(convs):
    """The rows of all nodes, from whole prefixes."""
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def got(turns, **options):
    return sorted((tuple(r) for r in tries.prefix_trie(tries.rebuilt(tries.paths(turns)), **options).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def some_turns(seed, n=300):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(3 * n), n):
        same = rng.random() < 0.4  # a third are copies of one conversation, under a third have its first turns
        for k in range(6 if same else rng.randrange(0, 12)):
            turns.append((c, k, rng.choice("ua") if not same else "u", f"text {k}" if same or rng.random() < 0.7 else rng.choice(["é", "long " * 50, "", str(c)])))
    return turns


def test_tries_of_many_shards(spark):
    for seed in range(2):
        turns = some_turns(seed)
        rows = spark.createDataFrame(turns, SCHEMA).repartition(3)
        assert got(rows, shard_turns=60) == brute(rebuilt(conversations(turns)))


def test_ids_of_one_end_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 100)
    turns = [(c, 0, "u", "same") for c in range(0, 500, 5)]
    assert got(spark.createDataFrame(turns, SCHEMA), shard_turns=10) == brute(rebuilt(conversations(turns)))


def test_odd_turns(spark):
    turns = [
        (5, None, "u", "first"), (5, 0, None, None), (5, 1, "u", None), (5, 1, "", ""), (6, 0, "u", "b"), (6, 0, "u", "b"), (7, 3, "a:", "b"), (8, 3, "a", ":b"), (None, 0, "u", "lost"), (9, 0, "u", "x" * 300_000),
        (-3, 0, "u", "below"), (12, None, None, None), *((10, k, "u", "t") for k in range(2000)), *((11, k, "u", "t") for k in range(2000)),
    ]
    rows = spark.createDataFrame(turns, SCHEMA).withColumn("path", F.lit(1)).withColumn("shard", F.lit("x"))
    want = rebuilt_of_signed(conversations(turns))
    short = {c: p for c, p in want.items() if len(p) < 100}
    found = got(rows.where("conv_id is null or conv_id not in (10, 11)"), shard_turns=2)
    assert found == brute(rebuilt_of_signed(conversations([t for t in turns if t[0] not in (10, 11)])))
    assert short
    deep = got(rows.where("conv_id in (10, 11)"))
    assert len(deep) == 2001 and max(r[1] for r in deep) == 2000
    assert tries.prefix_trie(tries.rebuilt(tries.paths(rows.limit(0)))).count() == 0


def rebuilt_of_signed(convs):
    """As `rebuilt`, the remainder with the sign of the id."""
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out
