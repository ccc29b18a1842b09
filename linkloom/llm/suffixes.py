"""Exact substring dedup with suffix arrays.

A byte is removed if it lies in a string of `length` bytes that also starts
earlier (in a document of smaller id, or earlier in the same document).

Every string of `length` bytes holds an anchor: the GRAM-byte string of lowest
hash among those that start in its first bytes, the same one wherever the string
stands. Strings whose anchor stands at one place only cannot repeat; what
surrounds the other anchors goes, with all other places of the same anchor, to
one shard. A shard sorts its suffixes by Larsson-Sadakane refinement, takes the
common prefixes of neighbours by Kasai's method, and so finds the classes of
equal strings and the earliest start of each. Where the places of one anchor
fill several shards, these are merged by binary search in their sorted strings.

An anchor that stands in a large part of all documents would fill one task. A
task that meets an anchor twice knows that it repeats, and reports one place of
it only. The strings around the most frequent anchors go by their distance to the
anchor, a few distances together, and each such piece to the task that the bytes
common to its strings name: equal strings meet in one task, but places that only
hold the same anchor do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import packed_texts, partition_keys, slices, stored

LENGTH, GRAM = 100, 24
#: Symbols of a shard's suffix array, each of which takes some 100 bytes of memory while the array is made.
SHARD = 1 << 18
#: Anchors with over a 1 / HOT of all reported places, fewer than HOT, and with so many at least, are dealt to several tasks.
HOT, LEAST = 1_000, 2_000
#: Distances to a frequent anchor that go together: WIDE / parts, but NARROW at least, so that one byte on each side tells pieces of one task apart.
WIDE, NARROW = 16, 2
#: Contents around anchors whose earliest place a task remembers.
CONTENTS = 200_000
#: Bytes of text for a bucket.
BUCKET = 12_000_000
FIRST = 7  # symbols in a first sort key
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOW = np.uint64((1 << 24) - 1)  # the bits of a hash that give way to a place, so documents go by stretches


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place on; every step doubles the width."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    out, used = None, 0
    while True:
        if gram & width:
            part = h[used : used + len(data) - gram + 1]
            out = part * B if out is None else (out ^ (out >> np.uint64(29))) * A + part
            used += width
        width *= 2
        if width > gram:
            break
        left = h[: -(width // 2)]
        h = (left ^ (left >> np.uint64(31))) * A + h[width // 2 :]
    out ^= out >> np.uint64(32)
    out *= B
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, how many starts) of each run of strings with one anchor; the leftmost of equal hashes counts."""
    starts = len(data) - length + 1
    window = length - gram + 1
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for base in range(0, max(starts, 0), 1 << 23):
        h = gram_hashes(data[base : base + (1 << 23) + length - 1], gram)
        least, width = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: width - window], least[window - width :])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        out.append((h[(least[first] & LOW).astype(np.int64)], base + first, np.diff(np.r_[first, len(least)])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order. `symbols` holds texts one after another, each closed by a 0 at `ends`; equal rests go by text.

    Larsson-Sadakane: suffixes are sorted by their first symbols; then only
    groups that are still equal are sorted again, by the rank of what follows,
    which doubles the number of symbols that count.
    """
    n = len(symbols)
    text_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))
    rest = ends[text_of] - np.arange(n)  # symbols before the text's end
    key = np.zeros(n, np.int64)
    padded = np.r_[symbols.astype(np.int64), np.zeros(FIRST, np.int64)]
    for k in range(FIRST):
        key = (key << 9) | np.where(rest >= k, padded[k : k + n], 0)
    order = np.argsort(key)
    ranks = np.empty(n, np.int64)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    slots = np.arange(n)
    first = np.maximum.accumulate(np.where(new, slots, 0))
    ranks[order] = first
    open_slots = slots[~(new & np.r_[new[1:], True])]
    h = FIRST
    while len(open_slots):
        own = order[open_slots]
        group = ranks[own]
        over = rest[own] < h
        follow = np.where(over, text_of[own], len(ends) + ranks[np.minimum(own + h, n - 1)])
        by = np.lexsort((follow, group)) if n >= 1 << 24 else np.argsort(group * (n + len(ends) + 1) + follow)
        own, group, follow = own[by], group[by], follow[by]
        order[open_slots] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        first = np.maximum.accumulate(np.where(new, open_slots, 0))
        ranks[own] = first
        open_slots = open_slots[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that the suffix in each slot shares with the one before, by Kasai's method, all texts side by side.

    From one suffix to the next of the same text, at most one symbol is lost.
    """
    n = len(symbols)
    slot_of = np.empty(n, np.int64)
    slot_of[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    place = np.r_[0, ends[:-1] + 1]
    common = np.zeros(len(ends), np.int64)
    stop = ends
    while len(place):
        slot = slot_of[place]
        before = order[np.maximum(slot - 1, 0)]
        more = np.flatnonzero(slot > 0)
        common[slot == 0] = 0
        while len(more):
            x = symbols[place[more] + common[more]]
            more = more[(x == symbols[before[more] + common[more]]) & (x > 0)]
            common[more] += 1
        out[slot] = common
        place = place + 1
        keep = place < stop
        place, stop, common = place[keep], stop[keep], np.maximum(common[keep] - 1, 0)
    return out


def earliest(texts: list[bytes], starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string of `length` bytes in `texts`, in suffix order: (text, offset, class, earliest start in the class).

    starts: the place of each text's first byte, as one number in the order of documents.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int16)
    body = np.ones(len(symbols), bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    order = suffix_array(symbols, ends)
    common = common_prefixes(symbols, ends, order)
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)[order]
    whole = ends[text_of] - order >= length
    group = np.cumsum(common < length)[whole]
    text_of = text_of[whole]
    offset = order[whole] - (ends - sizes)[text_of]
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(starts[text_of] + offset, new) if len(new) else np.zeros(0, np.int64)
    number = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if len(group) else group
    return text_of, offset, number, least[number] if len(least) else least


def repeats(texts: list[bytes], starts: np.ndarray, anchor: np.ndarray, length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each text, whether the string at each of its starts also starts earlier. `anchor` says which texts can share strings."""
    by = np.argsort(anchor, kind="stable")
    sizes = np.array([len(texts[i]) + 1 for i in by])
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
    full = np.cumsum(sizes)
    begin = 0
    held: list[tuple[np.ndarray, tuple]] = []  # shards of one anchor that are not merged yet
    while begin < len(by):
        end = max(begin + 1, int(np.searchsorted(full, (full[begin - 1] if begin else 0) + shard, side="right")))
        last = anchor[by[end - 1]]
        if end < len(by) and anchor[by[end]] == last and anchor[by[begin]] != last:  # the next anchor starts a shard of its own
            end = begin + int(np.searchsorted(anchor[by[begin:end]], last, side="left"))
            last = anchor[by[end - 1]]
        own = by[begin:end]
        held.append((own, earliest([texts[i] for i in own], starts[own], length)))
        if end == len(by) or anchor[by[end]] != last:
            if len(held) > 1:
                held = merged(held, texts, length)
            for own, (text_of, offset, _, least) in held:
                again = starts[own][text_of] + offset != least
                place = np.lexsort((offset, text_of))
                cuts = np.flatnonzero(np.diff(text_of[place])) + 1
                for i, flags in zip(text_of[place][np.r_[0, cuts]] if len(place) else [], np.split(again[place], cuts), strict=False):
                    out[own[i]] = flags
            held = []
        begin = end
    return out


def merged(held: list, texts: list[bytes], length: int) -> list:
    """Shards with the earliest start over all of them: each shard's sorted strings are looked up in the others' by binary search."""
    known, least_of = np.zeros(0, f"S{length}"), np.zeros(0, np.int64)
    strings = []
    for own, (text_of, offset, number, least) in held:
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        # numpy's fixed strings drop zero bytes at their ends, so every byte is written as two
        some = np.array([texts[own[text_of[k]]][offset[k] : offset[k] + length].hex() for k in first], f"S{2 * length}")
        value = least[first]
        by = np.argsort(some, kind="stable")
        some, value = some[by], value[by]
        strings.append((some, by))
        at = np.searchsorted(known, some)
        there = np.zeros(len(some), bool)
        inside = at < len(known)
        there[inside] = known[at[inside]] == some[inside]
        least_of[at[there]] = np.minimum(least_of[at[there]], value[there])
        known, least_of = np.insert(known.astype(some.dtype), at[~there], some[~there]), np.insert(least_of, at[~there], value[~there])
    out = []
    for (own, (text_of, offset, number, _)), (some, by) in zip(held, strings, strict=True):
        over_all = np.empty(len(some), np.int64)
        over_all[by] = least_of[np.searchsorted(known, some)]
        out.append((own, (text_of, offset, number, over_all[number])))
    return out


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    at = 8 * len(kinds)
    out = []
    for kind, n in zip(kinds, np.frombuffer(data, np.int64, len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def in_groups(key: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1 if len(key) else []
    begin = 0
    for end in ends:
        yield begin, int(end)
        begin = int(end)


def run_rows(bucket: np.ndarray, node: np.ndarray, low: np.ndarray, first: np.ndarray, runs: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """(nodes, payloads): the runs of each node and bucket number; at most 5000 at a time."""
    order = np.lexsort((first, low, node, bucket))
    bucket, node, low, first, runs = (c[order] for c in (bucket, node, low, first, runs))
    edges = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])]) if len(node) else np.zeros(0, int)
    nodes, payloads = [], []
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(node)], strict=False):
        nodes.append(int(node[s]))
        payloads.append(pack(bucket[s : s + 1].astype(np.int32), low[s:e], first[s:e], runs[s:e]))
        if len(nodes) == 5000:
            yield nodes, payloads
            nodes, payloads = [], []
    if nodes:
        yield nodes, payloads


ANCHOR_COLUMNS = [("bucket", pa.int32()), ("payload", pa.binary()), ("node", pa.int64()), ("runs", pa.binary()), ("anchor", pa.int64()), ("places", pa.int64())]
ANCHOR_SCHEMA = "bucket int, payload binary, node bigint, runs binary, anchor bigint, places bigint"


def anchor_rows(**given: list) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return pa.record_batch([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in ANCHOR_COLUMNS], [k for k, _ in ANCHOR_COLUMNS])


def pieces(part: bytes, runs: int, width: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, bytes]]:
    """(first start, end, common bytes) of the strings in a run, `width` distances to the anchor at a time.

    Equal strings stand at equal distances to their anchor, and so in pieces with the same common bytes, whatever surrounds them.
    """
    h = gram_hashes(np.frombuffer(part, np.uint8), gram)[runs - 1 : length - gram + 1]
    at = runs - 1 + int(np.argmin(h & ~LOW))  # of all places in the run's every string, the leftmost of lowest hash
    for near in range((at - runs + 1) // width * width, at + 1, width):
        first, last = max(0, at - near - width + 1), min(runs - 1, at - near)
        yield first, last + length, part[at - near : at - near - width + 1 + length]


def posted_anchors(texts: DataFrame, keys: list[int], length: int) -> DataFrame:
    """Runs of anchors of each text (node), dealt by anchor: (bucket, payload).

    Anchors that a batch holds several times are known to repeat: their runs go
    straight on as (node, runs), the places of the frequent ones are counted
    (anchor, places), and one place alone is dealt.
    """

    def run(batches):
        seen: set[int] = set()
        count = np.uint64(len(keys))
        for b in slices(batches, 2048):
            node, many, hashes, first, runs = [], [], [], [], []
            for n, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                if n in seen:
                    continue
                seen.add(n)
                h, s, r = anchors(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), length)
                if len(h):
                    node.append(n)
                    many.append(len(h))
                    hashes.append(h)
                    first.append(s)
                    runs.append(r)
            if len(seen) > 1_000_000:
                seen.clear()
            if not node:
                continue
            own = np.repeat(np.arange(len(node)), many)
            node = np.array(node, np.int64)
            h, first, runs = np.concatenate(hashes), np.concatenate(first).astype(np.uint32), np.concatenate(runs).astype(np.uint8)
            bucket = ((h >> np.uint64(32)) % count).astype(np.int64)
            low = h.astype(np.uint32)
            name = bucket << 32 | low.astype(np.int64)
            order = np.argsort(name, kind="stable")
            name, bucket, own, low, first, runs = (c[order] for c in (name, bucket, own, low, first, runs))
            begins = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            times = np.diff(np.r_[begins, len(name)])
            several = np.repeat(times > 1, times)
            for nodes, payloads in run_rows(bucket[several], node[own[several]], low[several], first[several], runs[several]):
                yield anchor_rows(bucket=[keys[n % len(keys)] for n in nodes], node=nodes, runs=payloads)
            often = np.flatnonzero(times >= 8)
            if len(often):
                yield anchor_rows(bucket=[keys[i % len(keys)] for i in name[begins[often]].tolist()], anchor=name[begins[often]], places=times[often])
            dealt = ~several
            dealt[begins] = True
            bucket, own, low, first, runs = bucket[dealt], own[dealt], low[dealt], first[dealt], runs[dealt]
            at, payloads = [], []
            for s, e in in_groups(bucket):
                docs, times = np.unique(own[s:e], return_counts=True)
                by = np.argsort(own[s:e], kind="stable")
                at.append(keys[bucket[s]])
                payloads.append(pack(node[docs], times.astype(np.uint32), low[s:e][by], first[s:e][by], runs[s:e][by]))
            yield anchor_rows(bucket=at, payload=payloads)

    return texts.mapInArrow(run, ANCHOR_SCHEMA)


def repeated_anchors(posted: DataFrame, keys: list[int]) -> DataFrame:
    """(node, runs), the runs of each node whose anchor stands at several places: bucket number, low half of the anchor, first start, starts.

    Rows that are known already, and counts, pass. A place can come twice.
    """
    number = {k: i for i, k in enumerate(keys)}

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            known = b.filter(b.column("payload").is_null())
            if known.num_rows:
                yield known
            b = b.filter(b.column("payload").is_valid())
            for k, payload in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist(), strict=True):
                node, many, low, first, runs = unpack(payload, np.int64, np.uint32, np.uint32, np.uint32, np.uint8)
                held.setdefault(k, []).append((np.repeat(node, many), low, first, runs))
        for k in sorted(held):
            node, low, first, runs = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            order = np.lexsort((first, node, low))
            node, low, first, runs = node[order], low[order], first[order], runs[order]
            keep = np.r_[True, (low[1:] != low[:-1]) | (node[1:] != node[:-1]) | (first[1:] != first[:-1])]  # a text that several tasks met
            node, low, first, runs = node[keep], low[keep], first[keep], runs[keep]
            same = low[1:] == low[:-1]
            some = np.r_[False, same] | np.r_[same, False]
            for nodes, payloads in run_rows(np.full(int(some.sum()), number[k]), node[some], low[some], first[some], runs[some]):
                yield anchor_rows(node=nodes, runs=payloads)

    return posted.repartition(len(keys), "bucket").mapInArrow(run, ANCHOR_SCHEMA).select("node", "runs", "anchor", "places")


def frequent_anchors(found: DataFrame) -> dict[int, int]:
    """Anchor (bucket number and low half) -> into how many parts its surroundings are dealt; fewer than HOT."""
    total = found.agg(F.sum("places")).first()[0] or 0
    part = max(LEAST, total // HOT)
    counted = found.where("anchor is not null").groupBy("anchor").agg(F.sum("places").alias("n")).where(F.col("n") > part)
    return {r["anchor"]: -(-r["n"] // part) for r in counted.collect()}


def surroundings(joined: DataFrame, keys: list[int], length: int, frequent: dict[int, int]) -> DataFrame:
    """(bucket, payload): for each repeated anchor of a text, the bytes that its strings cover; those of frequent anchors in pieces, dealt by what their strings share.

    Of places that hold the same bytes around one anchor, a task sends on only those
    that are earlier than all that it has met: the others repeat them whatever else
    there is, so their spans are known: (bucket, node, spans), dealt by node.
    """
    parts_of = joined.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        stretch = zstandard.ZstdDecompressor()
        frequent = parts_of.value
        earliest: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}

        def is_new(part, home, name, place, known) -> bool:
            content = home, name, xxhash.xxh3_128_digest(part)
            first_place = earliest.get(content)
            if first_place is None or first_place > place:
                earliest[content] = place
                return True
            if first_place < place:
                known.setdefault(place[1], []).extend((place[2], place[2] + len(part)))
            return False

        for b in slices(batches, 1024):
            known: dict[int, list[int]] = {}
            bucket, node, doc, low, first, shared, parts = [], [], [], [], [], [], []
            for n, d, packed, all_runs in zip(*(b.column(c).to_pylist() for c in ("node", "doc_id", "packed", "runs")), strict=True):
                text = stretch.decompress(packed)
                met: set[tuple[int, int, int]] = set()
                for payload in all_runs:
                    home, lows, firsts, runs = unpack(payload, np.int32, np.uint32, np.uint32, np.uint8)
                    home = int(home[0])
                    for a, s, r in zip(lows.tolist(), firsts.tolist(), runs.tolist(), strict=True):
                        if (home, a, s) in met:
                            continue
                        met.add((home, a, s))
                        part = text[s : s + r + length - 1]
                        if not is_new(part, home, a, (d, n, s), known):
                            continue
                        many = frequent.get(home << 32 | a, 1)
                        own = [(home, a, s, part)]
                        if many > 1:
                            own = []
                            for begin, end, core in pieces(part, r, max(WIDE // many, NARROW), length):
                                name = xxhash.xxh3_64_intdigest(core)
                                piece = (home + (name >> 32) % many) % len(keys), name & 0xFFFFFFFF, s + begin, part[begin:end]
                                if is_new(piece[3], piece[0], piece[1], (d, n, piece[2]), known):
                                    own.append(piece)
                        for to, name, at, some in own:
                            parts.append(some)
                            bucket.append(to)
                            shared.append(many > 1)
                            low.append(name)
                            first.append(at)
                            node.append(n)
                            doc.append(d)
            if len(earliest) > CONTENTS:
                earliest.clear()  # more places are sent on, nothing else changes
            if known:
                yield sent(bucket=[keys[n % len(keys)] for n in known], node=list(known), spans=[np.array(x, np.uint32).tobytes() for x in known.values()])
            if not bucket:
                continue
            bucket = np.array(bucket)
            order = np.lexsort((np.array(low), bucket))
            at, payloads = [], []
            columns = [np.array(c, k)[order] for c, k in ((node, np.int64), (doc, np.int64), (low, np.uint32), (first, np.uint32), (shared, np.uint8))]
            sizes = np.array([len(p) for p in parts], np.uint32)[order]
            bucket = bucket[order]
            for s, e in in_groups(bucket):
                at.append(keys[bucket[s]])
                body = np.frombuffer(b"".join([parts[i] for i in order[s:e]]), np.uint8)
                payloads.append(squeeze.compress(pack(*(c[s:e] for c in columns), sizes[s:e], body)))
            yield sent(bucket=at, payload=payloads)

    def sent(**given: list) -> pa.RecordBatch:
        n = len(given["bucket"])
        columns = [("bucket", pa.int32()), ("payload", pa.binary()), ("node", pa.int64()), ("spans", pa.binary())]
        return pa.record_batch([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in columns], [k for k, _ in columns])

    return joined.mapInArrow(run, "bucket int, payload binary, node bigint, spans binary")


def repeated_strings(around: DataFrame, keys: list[int], length: int) -> DataFrame:
    """(node, spans): byte ranges of each node that repeat earlier bytes; a shard of suffixes at a time."""

    def rows(node: list, spans: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(node, pa.int64()), pa.array(spans, pa.binary())], ["node", "spans"])

    def run(batches):
        stretch = zstandard.ZstdDecompressor()
        held: dict[int, list] = {}
        for b in batches:
            known = b.filter(b.column("payload").is_null())
            if known.num_rows:
                yield rows(node=known.column("node").to_pylist(), spans=known.column("spans").to_pylist())
            b = b.filter(b.column("payload").is_valid())
            for k, payload in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist(), strict=True):
                held.setdefault(k, []).append(payload)
        for k in sorted(held):
            node, doc, low, first, number, texts = [], [], [], [], [], []
            index: dict[tuple[int, bytes], int] = {}
            for payload in held.pop(k):
                n, d, a, f, w, sizes, body = unpack(stretch.decompress(payload), np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint8)
                body = body.tobytes()
                ends = np.cumsum(sizes).tolist()
                begin = 0
                own = []
                a = a | w.astype(np.int64) << 32  # names of pieces are no anchors
                for anchor, end in zip(a.tolist(), ends, strict=True):
                    key = anchor, body[begin:end]
                    i = index.get(key)
                    if i is None:
                        i = index[key] = len(texts)
                        texts.append(key[1])
                    own.append(i)
                    begin = end
                number.append(np.array(own))
                for c, v in ((node, n), (doc, d), (low, a), (first, f)):
                    c.append(v)
            del index
            node, doc, low, first, number = (np.concatenate(c) for c in (node, doc, low, first, number))
            order = np.lexsort((first, node, doc))
            changed = (node[order][1:] != node[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            place = np.empty(len(node), np.int64)
            place[order] = (np.cumsum(np.r_[False, changed]) << 32) | first[order].astype(np.int64)
            by = np.lexsort((place, number))
            head = by[np.flatnonzero(np.r_[True, number[by][1:] != number[by][:-1]])]  # each text's earliest place
            flags = repeats(texts, place[head], low[head], length)
            is_head = place == place[head][number]  # rows of equal id and text stand at one place
            spans: list[tuple[int, int, int]] = []
            for n, f, i, own in zip(node.tolist(), first.tolist(), number.tolist(), is_head.tolist(), strict=True):
                if not own:
                    spans.append((n, f, f + len(texts[i])))
                elif flags[i].any():
                    edges = np.flatnonzero(np.diff(np.r_[False, flags[i], False].astype(np.int8)))
                    spans += [(n, f + s, f + e + length - 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            if not spans:
                continue
            found = np.array(spans, np.int64)
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            nodes, payloads = [], []
            for s, e in in_groups(found[:, 0]):
                nodes.append(int(found[s, 0]))
                payloads.append(found[s:e, 1:].astype(np.uint32).tobytes())
            for at in range(0, len(nodes), 5000):
                yield rows(node=nodes[at : at + 5000], spans=payloads[at : at + 5000])

    return around.repartition(len(keys), "bucket").mapInArrow(run, "node bigint, spans binary")


def united(spans: list[bytes]) -> np.ndarray:
    """Maximal runs (start, end) that the spans cover."""
    own = np.concatenate([np.frombuffer(s, np.uint32).reshape(-1, 2) for s in spans]).astype(np.int64)
    own = own[np.argsort(own[:, 0], kind="stable")]
    reach = np.maximum.accumulate(own[:, 1])
    new = np.r_[True, own[1:, 0] > reach[:-1]]
    return np.stack([own[new, 0], np.maximum.reduceat(own[:, 1], np.flatnonzero(new))], 1)


def with_names(texts: DataFrame, bits: int) -> DataFrame:
    """Adds `node`, a number for each different text: `bits` of its hash and, for texts that share these, a second hash mixed in."""
    hashed = texts.withColumns({"node": F.shiftright(F.xxhash64("text"), 64 - bits), "second": F.xxhash64(F.lit("second"), "text")})
    keeps = hashed.groupBy("node").agg(F.min("second").alias("keeps"), F.max("second").alias("other")).where("keeps <> other").select("node", "keeps")
    shared = stored(keeps, "names")  # n * n / 2 ** 65 of n texts: 68 for 5e10 texts
    if shared.isEmpty():
        return hashed.drop("second")
    mixed = F.when(F.col("keeps") != F.col("second"), F.col("node").bitwiseXOR(F.col("second"))).otherwise(F.col("node"))
    return hashed.join(shared, "node", "left").withColumn("node", mixed).drop("second", "keeps")


def drop_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of each maximal removed run), kept (binary) and `rest` of every row.

    `rest` is a struct of the other columns, whatever their names. With `as_text`,
    kept is a string: bytes of characters that were cut apart are left out.

    Texts are taken as UTF-8 bytes; a null text is empty. Strings never cross
    documents. Documents of equal text are judged together: of copies, all but
    the one of smallest id are removed whole if they have `length` bytes or
    more. A text of any length is judged whole. Rows with equal ids are ordered by a hash of their text; rows that are
    equal in both are one document and get equal results. Null ids come before
    others. An empty table gives no rows. Texts are told apart by 128 bits of hashes.
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    texts = with_names(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest")), bits)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = partition_keys(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET))
    found = stored(repeated_anchors(posted_anchors(texts.select("node", "text"), keys, length), keys), "anchors")
    frequent = frequent_anchors(found)

    ids = texts.select("node", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    heads = ids.groupBy("node").agg(F.min("id").alias("id"))
    asked = found.where("runs is not null").groupBy("node").agg(F.collect_list("runs").alias("runs")).join(heads, "node")
    packed = packed_texts(texts.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))), "node", "id")
    joined = packed.join(asked, ["node", "id"]).select("node", F.col("id").alias("doc_id"), "packed", "runs")
    spans = stored(repeated_strings(surroundings(joined, keys, length, frequent), keys, length), "spans")

    removed = heads.join(spans.groupBy("node").agg(F.collect_list("spans").alias("spans")), "node", "left")
    rows = packed_texts(texts.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "known": F.col("doc_id").isNotNull()}), "node", "id", "known", "rest")
    whole = rows.join(removed.withColumnRenamed("id", "head"), "node")

    def run(batches):
        stretch = zstandard.ZstdDecompressor()
        for b in slices(batches):
            sizes, runs, kept = [], [], []
            for i, head, packed, spans in zip(*(b.column(c).to_pylist() for c in ("id", "head", "packed", "spans")), strict=True):
                text = stretch.decompress(packed)
                sizes.append(len(text))
                if i != head and len(text) >= length:
                    runs.append([{"start": 0, "end": len(text)}])
                    kept.append(b"")
                elif spans and i == head:
                    cut = united(spans)
                    runs.append([{"start": s, "end": e} for s, e in cut.tolist()])
                    edges = [0, *cut.ravel().tolist(), len(text)]
                    kept.append(b"".join([text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)]))
                else:
                    runs.append([])
                    kept.append(text)
            doc_id = [i if k else None for i, k in zip(b.column("id").to_pylist(), b.column("known").to_pylist(), strict=True)]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(doc_id, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), b.column("rest")]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "spans", "kept", "rest"])

    schema = texts.selectExpr("cast(doc_id as bigint) as doc_id", "0L as n_bytes", "array(named_struct('start', 0L, 'end', 0L)) as spans", "'' as kept" if as_text else "binary('') as kept", "rest").schema
    return whole.mapInArrow(run, schema)
