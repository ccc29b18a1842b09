"""Similarity join on word n-grams: a grouped prefix join.

A document is its set of n-word shingles. Two sets of Jaccard similarity t or
more share a shingle among the first |x| - ceil(t |x|) + 1 of each, in any common
order; here the order puts frequent shingles last. Documents with one set are
one node, and nodes with equal prefixes and size are one group. Groups, not
documents, are posted under their prefix shingles. Pairs of groups that meet in
posting lists are filtered by their sizes and by how many prefix shingles they
share; only those that remain are expanded to their nodes, and nodes are verified
on whole sets.

Only connected documents matter here, so posting lists need not be turned into
all their pairs. First every group meets the most central group of its lists; of
what is then still in different components, the pairs of groups between
components are filtered, expanded and verified, all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.bpe import Memory
from linkloom.llm.common import packed_texts, partition_keys, slices, stored
from linkloom.llm.components import components

#: Words of a shingle, and the similarity in hundredths.
WORDS, SIMILAR = 5, 75
#: Counters of document frequencies, in PARTS parts; shingles that share a counter count together. They only shape the
#: common order of shingles, never what is found, so a fixed number does for any data.
COUNTERS, PARTS = 1 << 20, 16
#: A posting list that may be longer than this is dealt to several tasks; of its pairs, blocks of so many groups are joined at a time.
LONG, BLOCK = 50_000, 2_000
#: About so many groups of a component are tried before its others.
EARLY = 64
#: Words whose hashes a task remembers: 200 bytes each, twice.
WORDS_KEPT = 50_000
#: Shingles that a task holds before it counts them: four copies of 8 bytes each while it does.
HELD = 1_500_000
#: Shingles for a partition of the postings.
PARTITION = 2_000_000
#: Roots with over a 1 / LARGE of all rows, fewer than LARGE, are broadcast.
LARGE = 1_000
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; words are lower-cased (A-Z) runs of anything but ASCII white space."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.memory = Memory(xxhash.xxh64_intdigest, WORDS_KEPT)

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.memory.__getitem__, words), np.uint64, n)
        w = min(n, self.words)
        out = np.full(n - w + 1, w, np.uint64)
        for k in range(w):
            out = (out ^ h[k : n - w + 1 + k]) * MIXERS[k % len(MIXERS)]
            out ^= out >> np.uint64(31)
        return np.unique(out)


def hashes_of(own: np.ndarray, bits: int) -> tuple[int, int]:
    """Two hashes of a set: `bits` of the first name it, the second tells sets of one name apart."""
    return (xxhash.xxh64_intdigest(own.tobytes()) >> (64 - bits)) - (1 << (bits - 1)), xxhash.xxh64_intdigest(own.tobytes(), seed=1) - (1 << 63)


def node_of(own: np.ndarray, shared: dict[int, int], bits: int) -> int:
    """The set's name. `shared`: names that several sets have, with the second hash of the one that keeps it."""
    name, second = hashes_of(own, bits)
    return name ^ second if shared.get(name, second) != second else name


def least_overlap(size: int, similar: int) -> int:
    """The least number of shingles that a set of `size` shares with a similar one."""
    return -(-similar * size // 100)


def nodes_and_counts(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """A row for each document (doc_id, node, second, size) and, with `part`, the task's document frequencies in one part of the counters (counts)."""

    def counted(all_of: list[np.ndarray]):
        squeeze = zstandard.ZstdCompressor(level=1)
        per = COUNTERS // PARTS
        counts = np.bincount((np.concatenate(all_of) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        packed = [squeeze.compress(counts[k * per : (k + 1) * per].tobytes()) for k in range(PARTS)]
        return pa.record_batch([pa.nulls(PARTS, pa.int64())] * 4 + [pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "node", "second", "size", "part", "counts"])

    def run(batches):
        shingler = Shingler(words)
        all_of: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        for b in slices(batches):
            nodes, seconds, sizes = [], [], []
            for text in b.column("text").to_pylist():
                own = shingler.shingles(text or "")
                name, second = hashes_of(own, bits)
                nodes.append(name)
                seconds.append(second)
                sizes.append(len(own))
                if second not in seen:
                    seen.add(second)
                    all_of.append(own)
                    held += len(own)
            n = len(nodes)
            yield pa.record_batch([b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "node", "second", "size", "part", "counts"])
            if held > HELD:
                yield counted(all_of)
                all_of.clear()
                seen.clear()
                held = 0
        if all_of:
            yield counted(all_of)

    return docs.mapInArrow(run, "doc_id bigint, node bigint, second bigint, size bigint, part int, counts binary")


def frequencies(found: DataFrame) -> np.ndarray:
    """The counters over all tasks: COUNTERS numbers, whatever the data. Tasks sum each part; one row of each comes to the driver."""
    per = COUNTERS // PARTS

    def summed(batches, numbers):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, own in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total = sums.setdefault(part, np.zeros(per, np.int64))
                total += numbers(own)
        for part, own in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "counts"])

    def partly(batches):
        stretch = zstandard.ZstdDecompressor()
        return summed(batches, lambda packed: np.frombuffer(stretch.decompress(packed), np.uint32))

    def wholly(batches):
        return summed(batches, lambda plain: np.frombuffer(plain, np.int64))

    some = found.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(8)).alias("salt"))
    # summed within salted parts first, so that no task takes all that the tasks of a large table report
    shares = some.repartition(PARTS * 8, "part", "salt").select("part", "counts").mapInArrow(partly, "part int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in shares.repartition(PARTS, "part").mapInArrow(wholly, "part int, counts binary").collect():  # 8 MB in all
        out[r["part"] * per : (r["part"] + 1) * per] += np.frombuffer(r["counts"], np.int64)
    return out


def postings(docs: DataFrame, words: int, similar: int, counts: np.ndarray, keys: list[int], shared: dict[int, int], bits: int) -> DataFrame:
    """(bucket, payload): groups under their prefix shingles; and, without payload, (bucket, node, size, group): members of groups."""
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        shingler = Shingler(words)
        many_of = table.value
        key = np.array(keys, np.int32)
        seen: set[int] = set()
        for b in slices(batches, 4096):
            members: list[tuple[int, int, int]] = []
            prefixes, groups, sizes = [], [], []
            for text in b.column("text").to_pylist():
                own = shingler.shingles(text or "")
                if not len(own):
                    continue
                node = node_of(own, shared, bits)
                if node in seen:
                    continue
                seen.add(node)
                weight = many_of[(own % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.argsort(weight, kind="stable")[: len(own) - least_overlap(len(own), similar) + 1]
                prefix, weight = own[first], weight[first]
                group = xxhash.xxh64_intdigest(prefix.tobytes(), seed=len(own)) - (1 << 63)
                members.append((node, len(own), group))
                if group not in seen:
                    seen.add(group)
                    prefixes.append((prefix, weight))
                    groups.append(group)
                    sizes.append(len(own))
            if len(seen) > 1_000_000:
                seen.clear()
            if not members:
                continue
            node, size, group = zip(*members, strict=True)
            yield batch([int(key[n % len(key)]) for n in node], node, size, group, None)
            if not groups:
                continue
            token = np.concatenate([p for p, _ in prefixes])
            weight = np.concatenate([w for _, w in prefixes])
            doc = np.repeat(np.arange(len(groups)), [len(p) for p, _ in prefixes])
            group_of = np.array(groups, np.int64)
            home = (token >> np.uint64(32)) % np.uint64(len(key))
            lists = np.maximum(1, weight // LONG).astype(np.uint64)
            salt = np.where(lists > 1, group_of[doc].view(np.uint64) % lists, np.uint64(0))
            bucket = ((home + salt) % np.uint64(len(key))).astype(np.int64)
            order = np.lexsort((doc, bucket))
            bucket, doc, low, home = bucket[order], doc[order], (token[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), home[order].astype(np.uint32)
            split = (lists[order] > 1).astype(np.uint8)
            ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
            begin = 0
            payloads, at = [], []
            for end in ends:
                own, many = np.unique(doc[begin:end], return_counts=True)
                payloads.append(b"".join([np.array([len(own), end - begin], np.int64).tobytes(), group_of[own].tobytes(), many.astype(np.uint32).tobytes(), low[begin:end].tobytes(), home[begin:end].tobytes() if split[begin:end].any() else b"", split[begin:end].tobytes() if split[begin:end].any() else b""]))
                at.append(int(key[bucket[begin]]))
                begin = end
            yield batch(at, None, None, None, payloads)

    def batch(bucket, node, size, group, payload):
        n = len(payload if payload is not None else node)
        columns = [(bucket, pa.int32()), (node, pa.int64()), (size, pa.int64()), (group, pa.int64()), (payload, pa.binary())]
        return pa.record_batch([pa.nulls(n, t) if v is None else pa.array(v, t) for v, t in columns], ["bucket", "node", "size", "group", "payload"])

    return docs.mapInArrow(run, "bucket int, node bigint, size bigint, group bigint, payload binary")


def unpacked(payload: bytes, home: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, group, dealt to several tasks?) of each posting; a list is its home bucket and the shingle's low half."""
    docs, tokens = np.frombuffer(payload, np.int64, 2)
    at = 16
    out = []
    for kind, n in ((np.int64, docs), (np.uint32, docs), (np.uint32, tokens)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    group, many, low = out
    if at < len(payload):
        homes = np.frombuffer(payload, np.uint32, tokens, at).astype(np.int64)
        split = np.frombuffer(payload, np.uint8, tokens, at + 4 * int(tokens)).astype(bool)
    else:
        homes, split = np.full(tokens, home, np.int64), np.zeros(tokens, bool)
    return (homes << 32) | low.astype(np.int64), np.repeat(group, many), split


def met_groups(posted: DataFrame, keys: list[int]) -> DataFrame:
    """Members as they are, and (list, weight, groups): the distinct sets of groups that share posting lists, with the number of lists.

    A list that was dealt to several tasks has a row of each.
    """
    number = {k: i for i, k in enumerate(keys)}
    columns = [("node", pa.int64()), ("size", pa.int64()), ("group", pa.int64()), ("list", pa.int64()), ("weight", pa.int64()), ("groups", pa.binary())]

    def rows(**given):
        n = len(next(iter(given.values())))
        return pa.record_batch([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in columns], [k for k, _ in columns])

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            plain = b.filter(b.column("payload").is_null())
            if plain.num_rows:
                yield rows(**{k: plain.column(k) for k in ("node", "size", "group")})
            for k, payload in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if payload is not None:
                    held.setdefault(k, []).append(unpacked(payload, number[k]))
        for k in sorted(held):
            lists, groups, split = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            order = np.lexsort((groups, lists))
            lists, groups, split = lists[order], groups[order], split[order]
            keep = np.r_[True, (lists[1:] != lists[:-1]) | (groups[1:] != groups[:-1])]
            lists, groups, split = lists[keep], groups[keep], split[keep]
            starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
            ends = np.r_[starts[1:], len(lists)]
            some = (ends - starts > 1) | split[starts]
            weights: dict[tuple[int, bytes], int] = {}
            for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                own = groups[s:e].tobytes()
                name = int(lists[s]) if split[s] else xxhash.xxh64_intdigest(own) - (1 << 63)
                weights[name, own] = weights.get((name, own), 0) + 1
            found = list(weights)
            for at in range(0, len(found), 2000):
                own = found[at : at + 2000]
                yield rows(list=[n for n, _ in own], weight=[weights[x] for x in own], groups=[g for _, g in own])

    return posted.repartition(len(keys), "bucket").mapInArrow(run, "node bigint, size bigint, group bigint, list bigint, weight bigint, groups binary")


def entries(met: DataFrame) -> DataFrame:
    """(list, group), a row for each group of each list."""

    def run(batches):
        for b in slices(batches, 256):
            groups = [np.frombuffer(g, np.int64) for g in b.column("groups").to_pylist()]
            if groups:
                yield pa.record_batch([pa.array(np.repeat(b.column("list").to_numpy(), [len(g) for g in groups])), pa.array(np.concatenate(groups))], ["list", "group"])

    return met.select("list", "groups").mapInArrow(run, "list bigint, group bigint")


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    own = sets.select("node", "shingles")
    joined = pairs.join(own.withColumnsRenamed({"node": "b", "shingles": "right"}), "b").join(own.withColumnsRenamed({"node": "a", "shingles": "left"}), "a")

    def run(batches):
        for b in slices(batches, 256):
            keep = []
            for x, y in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similar * (len(both) - common))
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def still_open(labelled: DataFrame) -> DataFrame:
    """The entries of lists whose groups are in several components (`now`)."""
    mixed = labelled.groupBy("list").agg(F.min("now").alias("least"), F.max("now").alias("most")).where("least <> most").select("list")
    return labelled.join(mixed, "list")


def with_root_values(rows: DataFrame, values: DataFrame, many: str) -> DataFrame:
    """`rows` joined with `values` on root. Roots that `many` rows have are broadcast, fewer than LARGE of them; the others are shuffled."""
    total = values.agg(F.sum(many)).first()[0] or 0
    large = F.col(many) > total / LARGE
    some = F.broadcast(values.where(large))
    return rows.join(some, "root").unionByName(rows.join(some.select("root"), "root", "left_anti").join(values.where(~large), "root"))


def similar_documents(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, bits: int = 64) -> DataFrame:
    """doc_id, size (of its shingle set) and component (smallest doc_id linked to it, directly or not) of every row.

    Two documents are linked if their sets' Jaccard similarity is `similar`
    hundredths or more. A text of fewer words than a shingle is one shingle; a
    null text or one without words has an empty set and is linked with nothing.
    Repeated rows are rows of their own and linked with one another. A row without
    id is linked only with rows of an equal set. An empty table gives no rows. Other columns are left unread.
    A text of any length is read whole, and its set is one row.

    Sets are told apart by 128 bits: `bits` of a first hash name them, and sets that
    share a name by a second one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = stored(nodes_and_counts(docs, words, bits), "nodes")
    own = found.where("part is null").select("doc_id", "node", "second", "size")
    met_names = own.groupBy("node").agg(F.min("second").alias("keeps"), F.max("second").alias("other")).where("keeps <> other").select("node", "keeps")
    shared = {r["node"]: r["keeps"] for r in met_names.collect()}  # n * n / 2 ** 65 of them: 68 for 5e10 texts
    if shared:
        names = spark.createDataFrame(list(shared.items()), "node bigint, keeps bigint")
        own = own.join(F.broadcast(names), "node", "left").withColumn("node", F.when(F.col("keeps") != F.col("second"), F.col("node").bitwiseXOR(F.col("second"))).otherwise(F.col("node")))
    own = own.select("doc_id", "node", "size")
    counts = frequencies(found)
    keys = partition_keys(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PARTITION))
    met = stored(met_groups(postings(docs, words, similar, counts, keys, shared, bits), keys), "met")
    members = met.where("node is not null").select("node", "size", "group").dropDuplicates(["node"])
    groups = stored(members.groupBy("group").agg(F.max("size").alias("size"), F.min("node").alias("head"), F.count("*").alias("n")), "groups")
    found_lists = met.where("groups is not null").groupBy("list", "groups").agg(F.sum("weight").alias("weight"))
    weights = found_lists.groupBy("list").agg(F.max("weight").alias("weight"))
    alone = groups.where("n > 1").selectExpr("group as list", "group", f"{1 << 40}L as weight")
    listed = entries(found_lists).distinct().join(weights, "list").unionByName(alone)
    lists = stored(listed.join(groups.select("group", "size"), "group").select("list", "weight", "group", "size"), "lists")

    heads = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    shared_ids = not own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def shingle(batches):
        shingler = Shingler(words)
        stretch = zstandard.ZstdDecompressor()
        for b in slices(batches):
            sets = [shingler.shingles(stretch.decompress(t).decode("utf-8", "replace")) for t in b.column("packed").to_pylist()]
            same = [node_of(x, shared, bits) == node for x, node in zip(sets, b.column("node").to_pylist(), strict=True)]  # rows can share an id
            yield pa.record_batch([b.column("node"), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"]).filter(pa.array(same, pa.bool_()))

    def whole_sets(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(heads, "node")
        out = packed_texts(docs, "doc_id").join(asked, "doc_id").select("node", "packed").mapInArrow(shingle, "node bigint, shingles binary")
        return stored(out.dropDuplicates(["node"]) if shared_ids else out, "sets")

    fits = f"{similar} * greatest(size, other) <= 100 * least(size, other)"
    # similar sets share so many prefix shingles: those that come before either set can have run out of its own
    overlap = f"ceil({similar} * (size + other) / {100 + similar}D - 1e-9)"
    need = f"(least({', '.join(f'{overlap} - ceil({similar} * {x} / 100D - 1e-9)' for x in ('size', 'other'))}) + 1)"
    enough = f"shared >= {need}"

    # of a list, the group that meets most others is the likely centre of near copies
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"))
    central = lists.join(sizes, "list").groupBy("group").agg(F.sum(F.col("weight").cast("double") * F.col("n")).alias("degree"))
    pivots = lists.join(central, "group").groupBy("list").agg(F.max(F.struct("degree", "group", "size")).alias("p")).selectExpr("list", "p.group as a", "p.size as other")
    met_first = lists.join(pivots, "list").where(f"a <> group and {fits}").groupBy("a", "group", "size", "other").agg(F.sum("weight").alias("shared")).where(enough)
    nearest = met_first.groupBy("group").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    # a group's nodes are verified against one node of the group that it meets, and against one of its own
    other_heads = nearest.join(groups.select(F.col("group").alias("a"), "head"), "a").select("group", "head").unionByName(groups.where("n > 1").select("group", "head"))
    first = stored(other_heads.join(members.select("group", "node"), "group").where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "first")
    links = stored(verified(first, whole_sets(first), similar), "verified")
    roots = components(links)

    # a unit is what a group has in one component. Pairs of units in different components are oriented to the larger one; of that, some are tried first
    placed = stored(members.join(roots, "node", "left").selectExpr("node", "size", "group", "coalesce(root, node) as root"), "placed")
    many = stored(placed.groupBy("root").agg(F.count("*").alias("many")), "many")
    units = with_root_values(placed.select("group", "root").distinct(), many, "many")
    units = units.withColumn("early", F.pmod(F.xxhash64("group"), F.ceil(F.col("many") / EARLY)) == 0).withColumn("now", F.col("root"))
    # `tail`: how many lists a unit has from this one on, longer lists last. Not all of the lists that two similar sets have to share
    # can come so late that either tail is below the need; so such places are left out, and two sets meet where one is left
    later = Window.partitionBy("group", "root").orderBy(F.desc("n"), F.desc("list")).rowsBetween(Window.unboundedPreceding, 0)
    open_lists = stored(still_open(lists.join(units, "group")).join(sizes, "list").withColumn("tail", F.sum("weight").over(later)), "open")
    for early in (True, False):
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("bigint")  # of a long list, a task joins a block with the whole
        left = open_lists.withColumn("block", F.pmod(F.xxhash64("group"), blocks))
        other = open_lists.where(F.col("early") == early).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        other = other.selectExpr("list", "block", "group as other_group", "size as other", "root as other_root", "many as other_many", "now as other_now", "tail as other_tail")
        between = left.join(other, ["list", "block"]).where(f"now <> other_now and (many < other_many or (many = other_many and root < other_root)) and {fits} and least(tail, other_tail) >= {need}")
        between = between.select("group", "root", "other_group", "other_root").distinct()
        left_nodes, right_nodes = placed.selectExpr("group", "root", "node as a"), placed.selectExpr("group as other_group", "root as other_root", "node as b")
        between = stored(between.join(left_nodes, ["group", "root"]).join(right_nodes, ["other_group", "other_root"]).select("a", "b"), "between")
        if not between.isEmpty():
            links = stored(links.unionByName(verified(between, whole_sets(between), similar)), "verified")
            roots = components(links)
        if early:
            now = placed.select("node", "group", "root").join(roots.withColumnRenamed("root", "now"), "node", "left").select("group", "root", F.coalesce("now", "node").alias("now")).distinct()
            open_lists = stored(still_open(open_lists.drop("now").join(now, ["group", "root"])), "open")

    rooted = own.join(roots, "node", "left").selectExpr("doc_id", "node", "size", "if(size = 0, null, coalesce(root, node)) as root")
    rooted = stored(rooted, "rooted")
    smallest = stored(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("rows")), "smallest")
    full = with_root_values(rooted.where("root is not null"), smallest, "rows").select("doc_id", "size", "component")
    return full.unionByName(rooted.where("root is null").select("doc_id", "size", F.col("doc_id").alias("component")))


def one_of_each(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The rows of `docs`, all columns, without those that are linked to a document of smaller id.

    Of rows with one id, one stays. Rows without id stay.
    """
    found = stored(similar_documents(docs, words, similar), "similar")
    known = docs.where("doc_id is not null")
    kept = known.join(found.where("doc_id = component").select("doc_id").distinct(), "doc_id", "left_semi")
    if not found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
