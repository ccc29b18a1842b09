"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in shards, a few thousand neighbours in the input each. The
terms of the items are dealt to owners: stages of about equal postings, rarest
terms first. A bundle holds the items' sparse accumulators (document, score so
far) for one shard; it passes through the stages, each of which meets the shard's
postings of its own terms in a cogroup and adds their integer contributions. What
the terms of later stages can still add is bounded, so that a document is dropped,
or not taken up, once it cannot reach a shard's best k any more; the result is
exact. The best of the shards are ranked at the end.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import slices, stored

#: Stages, each owning a share of the terms.
STAGES = 4
#: Documents and postings of a shard at most (a document's own postings are kept together).
SHARD_DOCS, SHARD_POSTINGS = 8192, 1_000_000
#: Terms that all items of a pass may have, with repeats; further items take further passes.
PASS_TERMS = 1_000_000
#: Of a score.
SCALE, SATURATION, LENGTH_SHARE, FLOOR = 1_000_000_000, 12, 25, 75
#: ASCII letters, digits and all other letters make terms; the rest separates them.
SEPARATED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(SEPARATED).split()


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Items:
    """Items of a pass: their terms' numbers, with repeats counted."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        self.terms = [Counter(self.number.setdefault(t, len(self.number)) for t in terms(text)) for _, text in rows]

    def by_term(self) -> list[list[tuple[int, int]]]:
        """(item, repeats) of each term."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.number]
        for item, own in enumerate(self.terms):
            for t, many in own.items():
                out[t].append((item, many))
        return out


def indexed(docs: DataFrame, items: Items) -> DataFrame:
    """A row for each shard: docs (ids, lengths), postings (places, terms, frequencies), and its sums n_docs, n_terms."""
    number = docs.sparkSession.sparkContext.broadcast(items.number)
    columns = [("shard", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()), ("terms", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]

    def run(batches):
        known = number.value
        shard = TaskContext.get().partitionId() << 32
        ids, lengths, places, found, tf, n_docs, n_terms = [], [], [], [], [], 0, 0

        def out():
            values = [[shard], *([np.array(x, t).tobytes()] for x, t in ((ids, np.int64), (lengths, np.int64), (places, np.int32), (found, np.int32), (tf, np.int64))), [n_docs], [n_terms]]
            return pa.record_batch([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], [k for k, _ in columns])

        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                n_docs += 1
                n_terms += len(words)
                own = Counter(filter(lambda t: t is not None, map(known.get, words)))
                if own:
                    places += [len(ids)] * len(own)
                    found += own.keys()
                    tf += own.values()
                    ids.append(doc)
                    lengths.append(len(words))
                if len(ids) >= SHARD_DOCS or len(places) >= SHARD_POSTINGS:
                    yield out()
                    shard, ids, lengths, places, found, tf, n_docs, n_terms = shard + 1, [], [], [], [], [], 0, 0
        if n_docs:
            yield out()

    return docs.mapInArrow(run, "shard bigint, ids binary, lengths binary, places binary, terms binary, tf binary, n_docs bigint, n_terms bigint")


def term_totals(index: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each of the items' n terms, and the largest frequency in one: n numbers, whatever the documents."""

    def run(batches):
        df, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            for found, tf in zip(b.column("terms").to_pylist(), b.column("tf").to_pylist(), strict=True):
                found, tf = np.frombuffer(found, np.int32), np.frombuffer(tf, np.int64)
                df += np.bincount(found, minlength=n)
                np.maximum.at(most, found, tf)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some]), pa.array(most[some])], ["term", "df", "most"])

    df, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums = index.select("terms", "tf").mapInArrow(run, "term bigint, df bigint, most bigint").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    for r in sums.toLocalIterator():
        df[r["term"]], most[r["term"]] = r["df"], r["most"]
    return df, most


def owners(df: np.ndarray, stages: int) -> np.ndarray:
    """The stage that owns each term: rarest first, equal shares of the postings but smaller ones at first."""
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(1, df.sum())
    stage = np.empty(len(df), np.int64)
    limits = np.array([2.0 ** (k - stages + 1) for k in range(stages - 1)])
    stage[order] = np.searchsorted(limits, share - 1e-12, "left")
    return stage


def postings(index: DataFrame, stage_of: np.ndarray, stages: int, n_docs: int, n_terms: int) -> DataFrame:
    """(stage, shard, ids, term, place, part): what each stage owns of each shard, with the frequency's part of a score."""
    shared = index.sparkSession.sparkContext.broadcast(stage_of)

    def run(batches):
        for b in slices(batches, 1):
            for row in b.to_pylist():
                places, found = np.frombuffer(row["places"], np.int32), np.frombuffer(row["terms"], np.int32)
                lengths, tf = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["tf"], np.int64)
                m = FLOOR + LENGTH_SHARE * lengths * n_docs // n_terms
                part = SCALE * tf // (1000 * tf + SATURATION * m[places])
                stage = shared.value[found]
                order = np.lexsort((places, found, stage))
                for s in range(stages):
                    own = order[np.searchsorted(stage[order], s, "left") : np.searchsorted(stage[order], s, "right")]
                    if len(own) or s == 0:  # the first stage makes the bundles
                        values = [[s], [row["shard"]], [row["ids"] if s == 0 else None], [found[own].tobytes()], [places[own].tobytes()], [part[own].astype(np.int32).tobytes()]]
                        yield pa.record_batch([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["stage", "shard", "ids", "term", "place", "part"])

    return index.mapInArrow(run, "stage int, shard bigint, ids binary, term binary, place binary, part binary")


class Bundle:
    """The items' accumulators for a shard, one after another: how many each has, their places and scores."""

    def __init__(self, n_items: int, row=None):
        if row is None or row["many"] is None:
            self.of = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * n_items
        else:
            ends = np.cumsum(np.frombuffer(row["many"], np.int32))[:-1]
            self.of = list(zip(np.split(np.frombuffer(row["place"], np.int32), ends), np.split(np.frombuffer(row["score"], np.int64), ends), strict=True))

    def columns(self) -> dict[str, list]:
        place, score = zip(*self.of, strict=True)
        return {"many": [np.array([len(p) for p in place], np.int32).tobytes()], "place": [np.concatenate(place).astype(np.int32).tobytes()], "score": [np.concatenate(score).tobytes()]}


def advanced(bundle: Bundle, terms_of: np.ndarray, places: np.ndarray, parts: np.ndarray, by_item: list, rest: np.ndarray, n_docs: int, k: int) -> Bundle:
    """The bundle after a stage. rest: what later stages can add to a document of each item at most."""
    dense = np.zeros(n_docs, np.int64)
    there, starts = np.unique(terms_of, return_index=True)
    spans = {t: slice(s, e) for t, s, e in zip(there.tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms_of)], strict=False)}
    out = []
    for item, (place, score) in enumerate(bundle.of):
        dense[place] = score
        for term, factor in by_item[item]:
            if term in spans:
                own = spans[term]  # a document holds a term once
                dense[places[own]] += factor * parts[own]
        held = np.flatnonzero(dense)
        score = dense[held]
        dense[held] = 0
        if len(held) > k:
            best = np.partition(score, len(score) - k)[len(score) - k]
            keep = score + rest[item] >= best  # equal scores may win by their ids
            held, score = held[keep], score[keep]
        out.append((held.astype(np.int32), score))
    after = Bundle(0)
    after.of = out
    return after


def ranked_pass(docs: DataFrame, items: Items, k: int, stages: int) -> DataFrame:
    """item (its number), doc_id and score of the best k documents of each shard."""
    schema = "item int, doc_id bigint, score bigint"
    spark = docs.sparkSession
    if not items.number:
        return spark.createDataFrame([], schema)
    index = stored(indexed(docs, items), "index")
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    if not totals["docs"]:
        return spark.createDataFrame([], schema)
    df, most = term_totals(index, len(items.number))
    weights = weight(totals["docs"], df)
    stage_of = owners(df, stages)
    bound = weights * (SCALE * most // np.maximum(1, 1000 * most + SATURATION * FLOOR))
    factors = [[[] for _ in items.ids] for _ in range(stages)]
    rest = np.zeros((stages, len(items.ids)), np.int64)
    for term, own in enumerate(items.by_term()):
        for item, many in own:
            factors[stage_of[term]][item].append((term, int(weights[term]) * many))
            rest[: stage_of[term], item] += bound[term] * many
    shared = spark.sparkContext.broadcast((factors, rest))
    owned = stored(postings(index, stage_of, stages, totals["docs"], totals["terms"]), "postings")
    bundles = owned.where("stage = 0").select("shard", "ids", *(F.lit(None).cast("binary").alias(c) for c in ("many", "place", "score")))

    def meet(stage):
        def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            factors, rest = shared.value
            row = left.iloc[0]
            own = [np.concatenate([np.frombuffer(x, np.int32) for x in right[c]]) if len(right) else np.zeros(0, np.int32) for c in ("term", "place", "part")]
            after = advanced(Bundle(len(factors[stage]), row), own[0], own[1], own[2].astype(np.int64), factors[stage], rest[stage], len(row["ids"]) // 8, k)
            return pd.DataFrame({"shard": [row["shard"]], "ids": [row["ids"]], **after.columns()})

        return run

    for stage in range(stages):
        mine = owned.where(F.col("stage") == stage).select("shard", "term", "place", "part")
        bundles = bundles.groupBy("shard").cogroup(mine.groupBy("shard")).applyInPandas(meet(stage), "shard bigint, ids binary, many binary, place binary, score binary")

    n_items = len(items.ids)

    def best(batches):
        for b in slices(batches, 1):
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                for item, (place, score) in enumerate(Bundle(n_items, row).of):
                    order = np.lexsort((ids[place], -score))[:k]
                    yield pa.record_batch([pa.array(np.full(len(order), item, np.int32)), pa.array(ids[place[order]]), pa.array(score[order])], ["item", "doc_id", "score"])

    return bundles.mapInArrow(best, schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, stages: int = STAGES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, equal scores by doc_id.

    Documents without terms (null and empty texts among them) count for nothing, and
    rows without id are left out. Each row of documents is a document; repeated rows
    are ranked each. Repeated rows of items are one item; texts that share an id (or
    have none) are ranked each. Items without terms, or whose terms no document has,
    give no rows, and so do empty tables. Very long texts are read whole. Other
    columns are left unread.

    Terms of the items, at most PASS_TERMS of a pass, are broadcast.
    """
    asked = items.select("item_id", "text").where("text is not null").distinct()
    asked = stored(asked.withColumn("n", F.length("text")), "items")
    total = asked.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // (2 * PASS_TERMS)))  # a term takes two characters at least, its separator included
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    best = None
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        rows = [(r["item_id"], r["text"]) for r in own.toLocalIterator()]
        names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], "item int, item_id bigint")
        found = ranked_pass(docs, Items(rows), k, stages).join(F.broadcast(names), "item").withColumn("pass", F.lit(p))
        best = found if best is None else best.unionByName(found)
    order = F.row_number().over(Window.partitionBy("pass", "item").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
