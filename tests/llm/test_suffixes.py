import tracemalloc

import numpy as np
import pytest

from linkloom.llm import suffixes


def brute(docs, length):
    """(n_bytes, spans, kept) by row; docs: (id, text) in any order, ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                cover[p : p + length] = True
            seen.add(b[p : p + length])
        edges = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(int)))
        out[i] = len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~cover])
    return out


def found(df):
    return {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()}


def passages(n, seed, letters="abcd"):
    rng = np.random.default_rng(seed)
    pieces = ["".join(rng.choice(list(letters), rng.integers(20, 200))) for _ in range(12)]
    return [(int(i), "".join(rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choice(list(letters), rng.integers(0, 90))) for _ in range(rng.integers(0, 7)))) for i in rng.permutation(n)]


@pytest.mark.parametrize("letters", ["abcd", "a", "é😀b\x00"])
def test_equals_brute_force(spark, letters):
    docs = passages(60, len(letters), letters)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(suffixes.drop_repeats(rows)) == brute(docs, 100)
    got = {r["doc_id"]: r["kept"] for r in suffixes.drop_repeats(rows, as_text=True).collect()}
    assert got == {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in brute(docs, 100).items()}


def test_frequent_anchors_are_dealt_to_several_tasks(spark, monkeypatch):
    """A passage that most documents hold, between edges of their own or shared ones; copies of whole documents beside."""
    monkeypatch.setattr(suffixes, "LEAST", 6)
    rng = np.random.default_rng(8)
    line = "".join(rng.choice(list("abcdefgh"), 260))
    edges = ["".join(rng.choice(list("xyz"), 60)) for _ in range(9)]
    docs = [(int(i), str(rng.choice(edges)) * (rng.random() < 0.8) + line * (rng.random() < 0.8) + str(rng.choice(edges)) + line[: rng.integers(0, 200)]) for i in rng.permutation(150)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    texts = rows.withColumn("node", suffixes.F.xxhash64("text"))
    keys = suffixes.partition_keys(spark, 5)
    many = suffixes.frequent_anchors(suffixes.repeated_anchors(suffixes.posted_anchors(texts.select("node", "text"), keys, 100), keys))
    assert many and max(many.values()) > 2
    assert found(suffixes.drop_repeats(rows)) == brute(docs, 100)


def test_repeated_rows_with_passages(spark):
    """Rows of equal id and text are one document: the passage stays in both, and what later documents repeat goes."""
    rng = np.random.default_rng(9)
    own = ["".join(rng.choice(list("abcdefgh"), 120)) for _ in range(3)]
    line = "".join(rng.choice(list("abcdefgh"), 300))
    docs = [(5, own[0] + line), (9, own[1] + line), (11, own[2]), (11, own[2])]
    want = brute([*docs[:2], docs[2]], 100)
    got = suffixes.drop_repeats(spark.createDataFrame([docs[0], *docs], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in got) == sorted((i, want[i][2]) for i in (5, 5, 9, 11, 11))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8)) for _ in range(40)] + [b"a" * 50, b"a" * 50]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols = np.concatenate([np.r_[np.frombuffer(t, np.uint8).astype(np.int16) + 1, np.int16(0)] for t in texts])
    order = suffixes.suffix_array(symbols, ends)
    rests = [(t[k:], i) for i, t in enumerate(texts) for k in range(len(t) + 1)]
    place = [(i, k) for i, t in enumerate(texts) for k in range(len(t) + 1)]
    want = sorted(range(len(rests)), key=lambda x: rests[x])
    assert order.tolist() == want
    common = suffixes.common_prefixes(symbols, ends, order)
    for s in range(1, len(order)):
        (x, _), (y, _) = rests[order[s - 1]], rests[order[s]]
        n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert common[s] == n, (place[order[s]], n)


def test_shards_of_one_anchor_are_merged():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, rng.integers(20, 60)).astype(np.uint8)) for _ in range(200)]
    starts, anchor = (np.arange(200) << 32)[rng.permutation(200)], np.zeros(200, np.int64)
    one = suffixes.repeats(texts, starts, anchor, 8, 1 << 20)
    many = suffixes.repeats(texts, starts, anchor, 8, 300)
    assert all((a == b).all() for a, b in zip(one, many, strict=True)) and any(a.any() for a in one)


def test_anchors_cover_every_start():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    hashes, first, many = suffixes.anchors(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + many[:-1]).all() and first[-1] + many[-1] == 5000 - 99
    by = {}
    for h, s, n in zip(hashes, first, many, strict=True):
        for p in range(s, s + n):
            assert by.setdefault(data[p : p + 100].tobytes(), h) == h


def test_odd_rows(spark, odd, empty):
    got = suffixes.drop_repeats(odd)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept", "rest"] and len(rows) == odd.count()
    assert set(rows[0]["rest"].asDict()) == set(odd.columns) - {"doc_id", "text"}
    kept = {r["doc_id"]: len(r["kept"]) for r in rows}
    assert kept[7] == 1 and kept[8] == 5 and kept[4] == kept[5] == 33  # of a repeating text one period stays; short copies stay
    assert suffixes.drop_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 80), (1, "ab" * 80), (2, "ab" * 80), (None, "xyz" * 60)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in suffixes.drop_repeats(twice).collect()) == [(0, 3), (1, 2), (1, 2), (2, 0)]


def test_a_passage_in_half_of_all_documents_is_sent_once_a_task(spark, monkeypatch):
    """One content around one anchor: places after a task's earliest one need no comparison."""
    monkeypatch.setattr(suffixes, "LEAST", 6)
    rng = np.random.default_rng(21)
    line = "".join(rng.choice(list("abcdefgh"), 400))
    docs = [(i, (line if i % 2 else "") + "".join(rng.choice(list("uvwxyz"), 150))) for i in range(400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(4)
    assert found(suffixes.drop_repeats(rows)) == brute(docs, 100)
    texts = rows.withColumn("node", suffixes.F.xxhash64("text"))
    keys = suffixes.partition_keys(spark, 5)
    anchors = suffixes.repeated_anchors(suffixes.posted_anchors(texts.select("node", "text"), keys, 100), keys).where("runs is not null")
    asked = anchors.groupBy("node").agg(suffixes.F.collect_list("runs").alias("runs"))
    joined = suffixes.packed_texts(texts, "node", "doc_id").join(asked, "node").coalesce(2)
    sent = suffixes.surroundings(joined, keys, 100, {})
    places = sum(len(suffixes.unpack(suffixes.zstandard.ZstdDecompressor().decompress(r["payload"]), np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint8)[0]) for r in sent.where("payload is not null").collect())
    known = sum(len(r["spans"]) // 8 for r in sent.where("spans is not null").collect())
    assert known > 3 * places  # what is left holds edges of single documents


@pytest.mark.parametrize("width", [1, 2, 5, 8, 100])
def test_equal_strings_share_the_common_bytes_of_their_piece(width):
    rng = np.random.default_rng(31)
    line = rng.integers(0, 4, 150).astype(np.uint8)
    common = {}
    for _ in range(60):
        data = np.concatenate([rng.integers(0, 4, rng.integers(0, 90)), line[rng.integers(0, 30) : 150 - rng.integers(0, 30)], rng.integers(0, 4, rng.integers(0, 90))]).astype(np.uint8)
        for h, s, r in zip(*suffixes.anchors(data), strict=True):
            part, starts = data[s : s + r + 99].tobytes(), []
            for begin, end, core in suffixes.pieces(part, int(r), width):
                assert len(core) == 101 - width
                for k in range(begin, end - 99):
                    starts.append(k)
                    assert core in part[k : k + 100] and common.setdefault((h, part[k : k + 100]), core) == core
            assert sorted(starts) == list(range(r))
    assert len(common) < 60 * 100  # strings that several texts hold were met


def test_edges_of_a_frequent_passage_give_no_row_each(spark, monkeypatch):
    """What stands around a frequent anchor differs from text to text: its strings meet in one task, and only repeats are returned."""
    monkeypatch.setattr(suffixes, "LEAST", 6)
    rng = np.random.default_rng(33)
    line = "".join(rng.choice(list("abcdefgh"), 300))
    docs = [(i, "".join(rng.choice(list("uvwxyz"), 150)) + line + "".join(rng.choice(list("uvwxyz"), 150))) for i in range(200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    made = {}
    monkeypatch.setattr(suffixes, "stored", lambda df, label: made.setdefault(label, df.localCheckpoint()))
    assert found(suffixes.drop_repeats(rows)) == brute(docs, 100)
    assert 199 <= made["spans"].count() < 10 * len(docs)


def test_memory_of_a_shard():
    rng = np.random.default_rng(34)
    texts = [bytes(rng.integers(97, 123, 1000).astype(np.uint8)) for _ in range(1000)]
    starts, anchor = np.arange(1000) << 32, np.arange(1000)
    tracemalloc.start()
    flags = suffixes.repeats(texts, starts, anchor, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not any(f.any() for f in flags) and most < 50_000_000


@pytest.mark.parametrize("bits", [2, 64])
def test_texts_that_share_a_hash(spark, bits):
    """With two bits of the first hash nearly all texts share their names; the second hash tells them apart."""
    docs = [*passages(50, 4), (900, "copy " * 60), (901, "copy " * 60)]
    assert found(suffixes.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"), bits=bits)) == brute(docs, 100)


def test_very_long_texts(spark):
    rng = np.random.default_rng(5)
    own = "".join(rng.choice(list("abcdefghijklmnop"), 400_000))
    docs = [(1, own), (2, "x" * 60_000 + own[1000:300_000]), (3, own[200_000:] + "end"), (4, "short")]
    got = found(suffixes.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got[1][1] == [] and got[4] == (5, [], b"short")
    assert got[2][:2] == (359_000, [(1, 359_000)])
    assert got[3][:2] == (200_003, [(0, 200_000)])
