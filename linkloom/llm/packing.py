"""Best-fit packing of documents into training sequences by linear grouping.

Tokenized documents become pieces of at most `capacity` tokens. Only the number
of pieces of each length (at most `capacity` numbers, whatever the data) comes
to the driver. There, the large lengths are split into a few groups of equal
cardinality and rounded up to the largest of their group. How often to use each
configuration of these few sizes is a linear program, solved by generating
configurations. A part of each is then filled with actual documents, the longest
that the rest of the configuration leaves room for; what is left is grouped
again, so that room gained over the rounded lengths is not lost. Small lengths
go by best fit, largest first, into the space that is left. The resulting plan
speaks of runs ("ranks 10 to 90 of length 700 lie in sequences 5 to 85 at offset
1300"), so its size depends on the lengths, not on the number of documents.
Executors rank the pieces within their length and look their places up.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.bpe import BYTE_PIECES, SPACE, ByteEncoder, Vocabulary, broadcast_file, loaded
from linkloom.llm.common import slices, stored

#: Lengths over capacity / LARGE_SHARE are large; so many groups of equal cardinality round them up.
LARGE_SHARE, GROUPS = 6, 40
#: Of what the linear program asks for, the part that is filled before lengths are grouped again.
FILLED = 0.5
#: Steps of the linear program at most; whatever it has reached by then is used.
STEPS = 1500


#: From so many blanks in a row on, a text is encoded by this package's own encoder.
BLANKS = 32


class Encoder:
    """Ids of whole texts: compiled code for most, this package's own encoder for texts with long runs of white space.

    The compiled pattern tries such runs place by place, in time that grows with the
    square of a run, and fails on very long ones.
    """

    def __init__(self, vocabulary: Vocabulary):
        ranks = {vocabulary.strings[i]: i for s, i in vocabulary.ids.items() if s not in vocabulary.specials}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=BYTE_PIECES, mergeable_ranks=ranks, special_tokens=vocabulary.specials)
        self.whole = ByteEncoder(vocabulary)
        self.blank = regex.compile(SPACE + f"{{{BLANKS}}}")

    def encode(self, text: str) -> np.ndarray:
        if self.blank.search(text):
            return np.frombuffer(self.whole.encode(text), "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all")


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than `capacity`."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    first = n_tokens % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n_tokens, capacity))]


def tokenized(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and `lane` (the row's number within its task) of each piece."""
    spec = broadcast_file(docs, path)
    end = np.array([end_id], "<u4")

    def run(batches):
        encoder = loaded(Encoder, spec)
        lane = 0
        for b in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "lane")}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encoder.encode(text or ""), end]).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    for k, v in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), lane), strict=True):
                        out[k].append(v)
                    lane += 1
            yield pa.record_batch([pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], list(out))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, lane bigint")


@dataclass
class Plan:
    """Runs of equal sequences: ranks [first, last) of a length lie `each` to a sequence, from `sequence` on, at `offset`."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.rows.append((length, at, at + count, sequence, each, offset))
        self.used[length] = at + count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count


def grouped(left: dict[int, int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounded lengths, largest first, and the cardinality of each: lengths in `groups` parts of equal cardinality (equal lengths stay together)."""
    lengths = np.array(sorted(left, reverse=True))
    many = np.array([left[n] for n in lengths.tolist()])
    before = np.cumsum(many) - many
    part = before * groups // many.sum() if len(lengths) > groups else np.arange(len(lengths))
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return lengths[first], np.add.reduceat(many, first)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of greatest worth; one more place is filled at a time."""
    some = np.flatnonzero(worth > 1e-12)
    out = np.zeros(len(sizes), np.int64)
    if not len(some):
        return out
    places = np.arange(capacity + 1)
    from_ = places[None, :] - sizes[some][:, None]
    value, steps = np.zeros(capacity + 1), []
    while len(steps) < capacity // sizes[some].min():
        further = np.where(from_ >= 0, value[np.maximum(from_, 0)] + worth[some][:, None], -1.0)
        choice = further.argmax(0)
        new = further[choice, places]
        better = new > value + 1e-12
        if not better.any():
            break
        steps.append(np.where(better, choice, -1))
        value = np.maximum(value, new)
    at = capacity
    for step in reversed(steps):
        if step[at] >= 0:
            out[some[step[at]]] += 1
            at -= sizes[some[step[at]]]
    return out


def configurations(sizes: np.ndarray, many: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A configuration in each column, and how often the linear program of fewest sequences uses it."""
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    times = inverse @ many
    for _ in range(STEPS):
        worth = inverse.sum(0)
        new = best_configuration(sizes, worth, capacity).astype(float)
        if worth @ new <= 1 + 1e-7:
            break
        along = inverse @ new
        ratio = np.where(along > 1e-9, times / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        times = np.maximum(times - ratio[out] * along, 0)
        times[out] = ratio[out]
        columns[:, out] = new
        inverse[out] /= along[out]
        rest = np.arange(len(sizes)) != out
        inverse[rest] -= along[rest, None] * inverse[out]
    return columns.astype(np.int64), times


def fullest(left: dict[int, int], capacity: int) -> list[int]:
    """The longest of the lengths `left` and those beside it that come nearest to `capacity`; reachable sums are bits of an integer."""
    lengths = sorted(left, reverse=True)
    space = capacity - lengths[0]
    mask = (1 << (space + 1)) - 1
    sums, seen = 1, []
    for n in lengths:
        for _ in range(min(left[n] - (n == lengths[0]), space // n)):
            seen.append((n, sums))
            sums |= sums << n & mask
            if sums >> space & 1:
                break
        if sums >> space & 1:
            break
    total = sums.bit_length() - 1
    chosen = [lengths[0]]
    for n, before in reversed(seen):
        if not before >> total & 1:
            chosen.append(n)
            total -= n
    return chosen


def substituted(slots: list[int], lengths: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """Actual lengths for the slots (rounded, largest first): each the longest left that the later slots leave room for; a slot can stay empty."""
    chosen: list[int] = []
    room, later = capacity, sum(slots)
    for slot in slots:
        later -= slot
        k = bisect.bisect_right(lengths, room - later) - 1
        while k >= 0 and left[lengths[k]] <= chosen.count(lengths[k]):
            k -= 1
        if k >= 0:
            chosen.append(lengths[k])
            room -= lengths[k]
    return chosen


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> Plan:
    """Places `counts[length]` pieces of each length."""
    plan = Plan(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many) by space left
    if counts.get(capacity):
        plan.place(capacity, counts[capacity], plan.open(counts[capacity]), 1, 0)
    left = {k: n for k, n in counts.items() if capacity // LARGE_SHARE < k < capacity and n}

    def fill(chosen: list[int], times: int) -> None:
        at, offset = plan.open(times), 0
        for length in chosen:
            plan.place(length, times, at, 1, offset)
            offset += length
            left[length] -= times
        for length in set(chosen):
            if not left[length]:
                del left[length]
        runs[capacity - offset].append((at, times))

    while sum(left.values()) > 6 * groups:
        sizes, many = grouped(left, groups)
        columns, wanted = configurations(sizes, many, capacity)
        wanted[wanted.argmax()] = max(wanted.max(), 1)
        for k in np.argsort(-(sizes @ columns), kind="stable").tolist():  # fullest first
            slots = np.repeat(sizes, columns[:, k]).tolist()
            times = max(int(wanted[k] * FILLED), int(wanted[k] >= 1))
            while times and left:
                chosen = substituted(slots, sorted(left), left, capacity)
                if not chosen:
                    break
                n = min(times, *(left[length] // chosen.count(length) for length in chosen))
                fill(chosen, n)
                times -= n
    while left:
        chosen = fullest(left, capacity)
        fill(chosen, min(left[length] // chosen.count(length) for length in chosen))
    spaces = [r for r in range(capacity + 1) if runs[r]]
    for length in sorted((k for k in counts if k <= capacity // LARGE_SHARE), reverse=True):
        n = counts[length]
        while n:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                each = capacity // length
                new = -(-n // each)
                runs[capacity].append((plan.open(new), new))
                spaces.append(capacity)
            space = spaces[k]
            at, many = runs[space].pop()
            each = min(space // length, n)
            fit = min(many, n // each)
            plan.place(length, fit * each, at, each, capacity - space)
            n -= fit * each
            for to, run in ((space - each * length, (at, fit)), (space, (at + fit, many - fit))):
                if run[1]:
                    if not runs[to]:
                        bisect.insort(spaces, to) if to not in spaces[max(0, (b := bisect.bisect_left(spaces, to))) : b + 1] else None
                    runs[to].append(run)
            if not runs[space] and (b := bisect.bisect_left(spaces, space)) < len(spaces) and spaces[b] == space:
                spaces.pop(b)
    return plan


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    A null or empty text is its end mark alone. Repeated rows are packed each;
    which of several pieces of one length goes where does not matter to the
    packing, so ties take any order. An empty table gives no rows. Other columns
    are left unread. A very long text is encoded whole and cut into pieces of
    `capacity` tokens.
    """
    spark = docs.sparkSession
    pieces = stored(tokenized(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(counts, capacity)
    order = sorted(plan.rows)
    table = spark.sparkContext.broadcast([np.array(c, np.int64) for c in zip(*order, strict=True)] if order else None)

    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "lane"), F.lit(blocks)))
    before = (
        dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "block", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inner = F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "lane"))
    ranked = dealt.withColumn("inner", inner).join(before, ["block", "length"]).withColumn("rank", F.col("before") + F.col("inner") - 1)

    def look_up(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length, first, _, sequence, each, offset = table.value
            own, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(length << 42 | first, own << 42 | rank, side="right") - 1
            at = rank - first[k]
            yield pa.record_batch(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[k] + at // each[k]), pa.array(offset[k] + at % each[k] * own)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look_up, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
