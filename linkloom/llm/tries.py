"""The prefix trie of conversations, finished in sorted shards around a skeleton.

A conversation is the path of its turns' 128-bit keys. Paths are range-partitioned
between splitters, themselves paths of conversations, so that each shard holds a
stretch of the sorted paths. A node can lie in two shards only if it is a prefix
of a splitter; the trie of these prefixes, the skeleton, is broadcast. Each shard
walks its sorted paths with a stack and finishes all other nodes alone. Of
skeleton nodes it returns partial sums, which are added up and folded from the
skeleton's deepest nodes to the root.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import slices, stored

#: Turns in a shard, about, and sampled paths for each splitter.
SHARD, SAMPLED = 400_000, 32
#: Bytes of ids in a partial row of a skeleton node.
CHUNK = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
PARTIAL = [*NODE, ("skeleton", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]
SQL_TYPES = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}


def ddl(columns: list) -> str:
    return ", ".join(f"{k} {SQL_TYPES[t]}" for k, t in columns)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (keys of its turns in order) and weights (bytes of their texts), a row for each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", key.alias("key"), F.octet_length(text).cast("bigint").alias("weight")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return sorted_turns.selectExpr("conv_id", "transform(turns, t -> t.key) as path", "transform(turns, t -> t.weight) as weights")


def rebuilt(convs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Each conversation after its first h turns, behind the first h of the first conversation of its family.

    h is crc32 of the id as text, modulo most + 1; the family of c is c - c % family.
    A first conversation that is absent gives no turns.
    """
    convs = stored(convs, "conversations")
    own = convs.withColumns({"base": F.expr(f"conv_id - conv_id % {family}"), "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")})
    base = convs.where(f"conv_id % {family} = 0").selectExpr("conv_id as base", f"slice(path, 1, {most}) as base_path", f"slice(weights, 1, {most}) as base_weights")
    joined = own.join(base, "base", "left")
    both = {c: F.expr(f"concat(coalesce(slice(base_{c}, 1, h), array()), slice({c}, h + 1, greatest(0, size({c}) - h)))") for c in ("path", "weights")}
    return joined.withColumns(both).select("conv_id", "path", "weights")


def splitters_of(convs: DataFrame, shards: int, n: int) -> list[tuple[list[bytes], int, list[int]]]:
    """shards - 1 conversations (path, id, weights) between about equal stretches; copies of one path are told apart by id.

    The driver sees about SAMPLED paths a shard to choose them from.
    """
    if shards < 2:
        return []
    some = convs.select("path", "conv_id", "weights").sample(min(1.0, SAMPLED * shards / n), seed=7)
    rows = sorted(([bytes(k) for k in r["path"]], r["conv_id"], r["weights"]) for r in some.toLocalIterator())
    cuts = [rows[len(rows) * k // shards] for k in range(1, shards)] if rows else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def skeleton_of(splitters: list) -> tuple[list[dict[bytes, int]], list[int], list[int]]:
    """The trie of the splitters' paths: of each node the children by key, the parent and the weight. Node 0 is the root; parents have smaller numbers."""
    children: list[dict[bytes, int]] = [{}]
    parents, weights = [-1], [0]
    for path, _, own in splitters:
        at = 0
        for key, weight in zip(path, own, strict=True):
            if key not in children[at]:
                children[at][key] = len(children)
                children.append({})
                parents.append(at)
                weights.append(weight)
            at = children[at][key]
    return children, parents, weights


class Node:
    __slots__ = ("below", "children", "conv", "ends", "key", "leaves", "n", "saved", "skeleton", "weight")

    def __init__(self, key: bytes, weight: int, skeleton: int):
        self.key, self.weight, self.skeleton = key, weight, skeleton
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None  # of a node of this shard alone: the running hash; of a skeleton node: ids
        self.below: list[list] = []


class Walk:
    """A stack over sorted paths; `rows` takes what is finished."""

    def __init__(self, children: list[dict[bytes, int]], shard: int):
        self.skeleton, self.shard, self.part = children, shard, 0
        self.rows: list[list] = []
        self.stack = [Node(b"", 0, 0)]

    def ids(self, node: Node) -> None:
        self.rows.append([None] * 8 + [node.skeleton, self.shard, self.part, ",".join(map(str, node.ends)).encode()])
        self.part += 1
        node.ends = None

    def pop(self) -> None:
        node = self.stack.pop()
        depth = len(self.stack)
        above = self.stack[-1] if self.stack else None
        if node.skeleton >= 0:
            if node.ends:
                self.ids(node)
            self.rows.append([node.conv, depth, None, node.n, node.children, node.leaves, node.saved, None, node.skeleton, None, None, None])
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.weight
            for row in node.below:
                row[2] = node.conv
            self.rows += node.below
            own = [node.conv, depth, None, node.n, node.children, node.leaves, node.saved, node.ends.hexdigest() if node.ends else NOTHING, None, None, None, None]
            if above.skeleton >= 0:  # the parent's id comes with the skeleton
                own[8] = above.skeleton
                self.rows.append(own)
            else:
                above.below.append(own)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
        if above is not None:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)

    def take(self, conv: int, path: list[bytes], weights: list[int]) -> None:
        stack = self.stack
        same = 0
        while same < len(path) and same + 1 < len(stack) and stack[same + 1].key == path[same]:
            same += 1
        while len(stack) > same + 1:
            self.pop()
        for k in range(same, len(path)):
            above = stack[-1].skeleton
            stack.append(Node(path[k], weights[k], self.skeleton[above].get(path[k], -1) if above >= 0 else -1))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        if top.skeleton >= 0:
            top.ends = top.ends or []
            top.ends.append(conv)
            if len(top.ends) * 20 > CHUNK:
                self.ids(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv).encode())
        else:
            top.ends.update(f",{conv}".encode())

    def finish(self) -> None:
        while self.stack:
            self.pop()


def walked(convs: DataFrame, splitters: list, children: list[dict[bytes, int]]) -> DataFrame:
    """Nodes of single shards, and partial rows of skeleton nodes."""
    spark = convs.sparkSession
    shared = spark.sparkContext.broadcast(([(path, conv) for path, conv, _ in splitters], children))

    def deal(batches):
        cuts = shared.value[0]
        for b in slices(batches):
            rows = zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)
            yield b.append_column("shard", pa.array([bisect.bisect_right(cuts, row) for row in rows], pa.int32()))

    def run(batches):
        walk = None
        for b in slices(batches):
            for shard, conv, path, weights in zip(*(b.column(c).to_pylist() for c in ("shard", "conv_id", "path", "weights")), strict=True):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        walk.finish()
                        yield from out(walk)
                    walk = Walk(shared.value[1], shard)
                walk.take(conv, path, weights)
            if walk is not None:
                yield from out(walk)
        if walk is not None:
            walk.finish()
            yield from out(walk)

    def out(walk):
        rows, walk.rows = walk.rows, []
        for at in range(0, len(rows), 4096):
            yield pa.record_batch([pa.array(v, t) for v, (_, t) in zip(zip(*rows[at : at + 4096], strict=True), PARTIAL, strict=True)], [k for k, _ in PARTIAL])

    sharded = convs.mapInArrow(deal, "conv_id bigint, path array<binary>, weights array<bigint>, shard int")
    sorted_rows = sharded.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return sorted_rows.mapInArrow(run, ddl(PARTIAL))


def ends_of(partial: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: the ids of each skeleton node in order, streamed through one hash."""

    def run(batches):
        at, running = None, None
        for b in batches:
            for skeleton, ids in zip(b.column("skeleton").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if skeleton != at:
                    if at is not None:
                        yield pa.record_batch([pa.array([at]), pa.array([running.hexdigest()])], ["skeleton", "ends_sha256"])
                    at, running = skeleton, hashlib.sha256(ids)
                else:
                    running.update(b"," + ids)
        if at is not None:
            yield pa.record_batch([pa.array([at]), pa.array([running.hexdigest()])], ["skeleton", "ends_sha256"])

    rows = partial.where("ids is not null").select("skeleton", "shard", "part", "ids")
    return rows.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "part").select("skeleton", "ids").mapInArrow(run, "skeleton bigint, ends_sha256 string")


def folded(sums: list, parents: list[int], weights: list[int]) -> list[tuple]:
    """(skeleton, parent's, conv_id, depth, n_convs, n_children, n_leaves, saved_tokens) of each skeleton node, from partial sums of what lies outside the skeleton."""
    by = {r["skeleton"]: r.asDict() for r in sums}
    out = []
    for k in range(len(parents) - 1, -1, -1):  # parents have smaller numbers
        own = by[k]
        own["n_leaves"] = own["n_leaves"] or 1
        own["saved_tokens"] += (own["n_convs"] - 1) * weights[k]
        if k:
            above = by[parents[k]]
            above["n_children"] += 1
            above["n_leaves"] += own["n_leaves"]
            above["saved_tokens"] += own["saved_tokens"]
        out.append((k, by[parents[k]]["conv_id"] if k else None, own["conv_id"], own["depth"], own["n_convs"], own["n_children"], own["n_leaves"], own["saved_tokens"]))
    return out


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, path, weights), the root included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes below or at it), saved_tokens (over its
    subtree, members but one times the bytes of the last text) and ends_sha256 (of
    the ids that end at it, ascending, joined by commas). A conversation without
    turns is a member of the root alone, copies are members each, and an empty table
    gives no rows. A conversation's keys are one row: 24 bytes a turn.

    The driver holds the splitters' paths and their skeleton's sums, so many as
    there are shards; ids and other nodes stay in tasks. The ids that end at one
    skeleton node pass one after another through one hash, in constant memory.
    """
    spark = convs.sparkSession
    convs = stored(convs, "paths")
    totals = convs.agg(F.count("*").alias("n"), F.sum(F.size("path") + 1).alias("turns")).first()
    if not totals["n"]:
        return spark.createDataFrame([], ddl(NODE))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals["turns"] // shard_turns))
    splitters = splitters_of(convs, min(wanted, totals["n"]), totals["n"])
    children, parents, weights = skeleton_of(splitters)
    found = stored(walked(convs, splitters, children), "trie")
    partial = found.where("skeleton is not null and shard is null and ends_sha256 is null")
    sums = partial.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    skeleton = folded(sums.collect(), parents, weights)
    columns = "skeleton bigint, parent_conv_id bigint, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    top = stored(spark.createDataFrame(skeleton, columns), "skeleton")
    names = [k for k, _ in NODE]
    of_skeleton = top.join(ends_of(found), "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*names)
    nodes = found.where("ends_sha256 is not null").select(*names, "skeleton")
    above = top.select("skeleton", F.col("conv_id").alias("above"))
    nodes = nodes.join(F.broadcast(above) if len(parents) <= 1_000_000 else above, "skeleton", "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*names)
    return nodes.unionByName(of_skeleton)

