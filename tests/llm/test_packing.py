import collections
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def sequences(plan, counts, capacity):
    held, used = collections.defaultdict(list), collections.Counter()
    for length, first, last, sequence, each, offset in plan.rows:
        for rank in range(first, last):
            held[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
            used[length] += 1
    assert used == collections.Counter({k: n for k, n in counts.items() if n}) and len(held) == plan.sequences
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.data())
def test_any_lengths_are_placed(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 40), max_size=30))
    sequences(packing.plan_sequences(counts, capacity), counts, capacity)


def test_close_to_the_bound():
    rng = random.Random(4)
    for draw in (lambda: rng.randint(1, 2047), lambda: min(2048, int(rng.lognormvariate(6, 1.2)) + 1)):
        counts = collections.Counter(draw() for _ in range(100_000))
        assert sequences(packing.plan_sequences(counts, 2048), counts, 2048) <= 1.005 * -(-sum(k * n for k, n in counts.items()) // 2048) + 1


def test_lengths_are_rounded_to_few_sizes():
    rng = random.Random(5)
    counts = collections.Counter(rng.randint(342, 2047) for _ in range(20_000))
    sizes, many = packing.grouped(counts, packing.GROUPS)
    assert len(sizes) <= packing.GROUPS < len(counts) / 20 and many.sum() == 20_000 and many.max() < 2 * 20_000 / packing.GROUPS
    columns, times = packing.configurations(sizes, many, 2048)
    assert (sizes @ columns <= 2048).all() and np.allclose(columns @ times, many)
    bound = (sizes @ many) / 2048
    assert bound - 1e-6 <= times.sum() <= 1.05 * bound


def test_configurations_are_optimal():
    # thirds and halves: two sequences of 500 + 500, four of 333 * 3
    columns, times = packing.configurations(np.array([500, 333]), np.array([4, 12]), 1000)
    assert abs(times.sum() - 6) < 1e-6
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = np.sort(rng.choice(np.arange(4, 30), 4, replace=False))[::-1]
        worth = rng.random(4)
        best = packing.best_configuration(sizes, worth, 40)
        grid = np.stack(np.meshgrid(*[np.arange(11)] * 4), -1).reshape(-1, 4)
        assert best @ sizes <= 40 and best @ worth >= (grid[grid @ sizes <= 40] @ worth).max() - 1e-9


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000, " " * 1_000_000 + "b", "\n" * 1_000_000, "x" * 1_000_000, " <|endoftext|>" + "\t " * 500_000 + "<|endoftext|>", "ab " * 300_000])
def test_long_runs(text):
    with open(JSON, encoding="utf-8") as f:
        encoder = packing.Encoder(packing.Vocabulary(f.read()))
    assert encoder.encode(text).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_many_runs_of_blanks_take_no_quadratic_time():
    text = (" " * 1_999 + "x") * 200
    with open(JSON, encoding="utf-8") as f:
        encoder = packing.Encoder(packing.Vocabulary(f.read()))
    encoder.encode("warm " * 50 + " " * 40)
    began = time.process_time()
    ids = encoder.encode(text).tolist()
    assert time.process_time() - began < 3  # the compiled pattern takes three times that
    assert ids == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_cuts():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(2049, 2048) == [(0, 1), (1, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_documents_are_whole(request, table):
    docs = request.getfixturevalue(table)
    library = Tokenizer.from_file(JSON)
    rows = packing.pack_documents(docs, JSON, 64).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64
