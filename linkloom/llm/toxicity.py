"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5 letters, with
word ends marked) and of the word itself, all hashed into one table. A window of
WINDOW consecutive words is the mean of its words, a linear softmax tells its
class, and a document is as toxic as its worst window. Vectors and softmax
weights are trained jointly in numpy with Adam, so a misspelling that was never
seen still shares most of its n-grams with the words it stands for. Labels are
known of documents only: a first round takes random windows, later rounds take
each toxic document's worst window against the worst windows of clean ones.
As everything up to the softmax is linear, a fitted model scores a word by one
number, which tasks remember.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.bpe import Memory
from linkloom.llm.common import slices, stored
from linkloom.llm.training import labelled_sample

BUCKETS, DIMENSIONS, BATCH, RATE, FLOOR = 1 << 16, 8, 256, 0.02, 1e-4
#: Words of a window; rounds of choosing windows, and the least passes over them and steps in each.
WINDOW, ROUNDS, PASSES, STEPS = 12, 5, 4, 200
#: At most so many documents of each class are fitted.
PER_CLASS = 1500
#: Marks around words that carry no letters of their own.
EDGES = ".,;:!?\"'()[]{}<>*&%$#|/\\-_=+~`^@…«»“”‘’¿¡"


def buckets(run: str) -> list[int]:
    """Table rows of a run of non-spaces; a run without anything but marks has none."""
    word = run.strip(EDGES)
    if not word:
        return []
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in sorted(grams)]


def runs(text: str) -> list[str]:
    """The runs of non-spaces; one that is repeated at once counts once."""
    return [run for run, _ in groupby(text.lower().split())]


@dataclass
class Model:
    """Score of each table row (towards class 1) and the bias."""

    rows: np.ndarray
    bias: float

    def worst(self, words: np.ndarray) -> float:
        """The logit of the worst window, given each word's score; missing places of a short text count as zeros."""
        sums = np.concatenate([[0.0], np.cumsum(words)])
        most = (sums[WINDOW:] - sums[:-WINDOW]).max() if len(words) > WINDOW else sums[-1]
        return self.bias + float(most) / WINDOW


class Bagger:
    """Words as keys, a hash of the table rows that make them up; `rows` are those of each key met so far."""

    def __init__(self):
        self.rows: dict[int, bytes] = {}
        self.memory = Memory(self.key)

    def key(self, run: str) -> int | None:
        grams = buckets(run)
        if not grams:
            return None
        own = np.array(grams, np.int32).tobytes()
        key = xxhash.xxh64_intdigest(own) - (1 << 63)
        self.rows[key] = own
        return key

    def words(self, text: str | None) -> np.ndarray:
        return np.array([k for k in map(self.memory.__getitem__, runs(text or "")) if k is not None], np.int64)


def bagged(sample: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, label, words: their keys in order) and of words (key, rows), a task's words once each."""
    columns = [("doc_id", pa.int64()), ("label", pa.int64()), ("words", pa.binary()), ("key", pa.int64()), ("rows", pa.binary())]

    def batch(n: int, **given) -> pa.RecordBatch:
        return pa.record_batch([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in columns], [k for k, _ in columns])

    def run(batches):
        bagger = Bagger()
        for b in slices(batches):
            words = [bagger.words(t).tobytes() for t in b.column("text").to_pylist()]
            yield batch(b.num_rows, doc_id=b.column("doc_id").to_pylist(), label=b.column("label").to_pylist(), words=words)
        if bagger.rows:
            yield batch(len(bagger.rows), key=list(bagger.rows), rows=list(bagger.rows.values()))

    return sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label bigint, words binary, key bigint, rows binary")


class Sample:
    """Sampled documents as word numbers, in the order of their first appearance, and the table rows of each."""

    def __init__(self, docs: list[np.ndarray], rows: dict[int, bytes]):
        ends = np.cumsum([len(d) for d in docs])
        words = np.concatenate([*docs, np.zeros(0, np.int64)])
        keys, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        number = np.empty(len(keys), np.int32)
        number[order] = np.arange(len(keys))
        self.docs = np.split(number[inverse], ends[:-1]) if len(docs) else []
        own = [np.frombuffer(rows[k], np.int32) for k in keys[order].tolist()]
        self.flat = np.concatenate([*own, np.zeros(0, np.int32)])
        self.sizes = np.array([len(g) for g in own], np.int64)
        self.ends = np.cumsum(self.sizes)

    def word_scores(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.flat], self.ends - self.sizes) / self.sizes if len(self.sizes) else np.zeros(0)

    def windows(self, rng, y: np.ndarray, scores: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """Random windows if nothing is scored yet, else the worst ones (and, of clean documents, random ones too)."""
        out, label = [], []
        for words, toxic in zip(self.docs, y, strict=True):
            n = max(1, len(words) - WINDOW + 1)
            if not len(words):
                continue
            if scores is None:
                starts = rng.integers(0, n, min(n, 24 if toxic else 12))
            else:
                sums = np.concatenate([[0.0], np.cumsum(scores[words])])
                of = sums[np.minimum(np.arange(n) + WINDOW, len(words))] - sums[:n]
                worst = np.argsort(-of)[:: WINDOW // 2] if n > WINDOW else np.argsort(-of)[:1]
                starts = worst[:1] if toxic else np.concatenate([worst[:4], rng.integers(0, n, 4)])
            out += [words[s : s + WINDOW] for s in starts]
            label += [toxic] * len(starts)
        return out, np.array(label, np.int64)


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    bagger = Bagger()
    docs = [bagger.words(t) for t in texts]
    return fit_bags(docs, bagger.rows, labels, seed)


def fit_bags(docs: list[np.ndarray], rows_of: dict[int, bytes], labels: list[int], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    sample = Sample(docs, rows_of)
    if len({y for y, words in zip(labels, sample.docs, strict=True) if len(words)}) < 2:  # nothing to tell apart
        return Model(np.zeros(BUCKETS), 4.0 if labels and min(labels) == 1 else -4.0)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = rng.normal(0, 1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    step, scores = 0, None
    for _ in range(ROUNDS):
        windows, label = sample.windows(rng, y, scores)
        weight = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean())
        for _ in range(max(PASSES, -(-STEPS * BATCH // len(windows)))):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                words = np.concatenate([windows[i] for i in own])
                sizes = sample.sizes[words]
                doc = np.repeat(np.repeat(np.arange(len(own)), [len(windows[i]) for i in own]), sizes)
                begin = np.repeat(sample.ends[words] - sizes - np.cumsum(sizes) + sizes, sizes)
                rows = sample.flat[begin + np.arange(len(begin))]
                shares = np.repeat(1 / sizes / WINDOW, sizes)
                used, local = np.unique(rows, return_inverse=True)
                vectors = table[used]
                mean = np.stack([np.bincount(doc, shares * vectors[local, k], len(own)) for k in range(DIMENSIONS)], 1)
                logits = mean @ out + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), label[own]] -= 1
                p *= weight[own, None] / len(own)
                back = p @ out.T
                grad = np.stack([np.bincount(local, shares * back[doc, k], len(used)) for k in range(DIMENSIONS)], 1)
                step += 1
                for part, (param, g) in enumerate(((table, grad), (out, mean.T @ p), (bias, p.sum(0)))):
                    at_rows = used if part == 0 else slice(None)
                    m, v = (s[at_rows] for s in state[part])
                    m = 0.9 * m + 0.1 * g
                    v = 0.99 * v + 0.01 * g * g
                    state[part][0][at_rows], state[part][1][at_rows] = m, v
                    param[at_rows] -= RATE * m / (np.sqrt(v) + FLOOR)
        model = Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))
        scores = sample.word_scores(model.rows)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str, visible, per_class: int = PER_CLASS) -> Model:
    """Fits on at most 2 * per_class documents whose labels are `visible`; the driver gets their words' table rows, not their texts."""
    found = stored(bagged(labelled_sample(docs.select("doc_id", "text"), labels, label, visible, per_class)), "bags")
    words = found.where("key is not null").groupBy("key").agg(F.first("rows").alias("rows"))
    rows_of = {r["key"]: bytes(r["rows"]) for r in words.toLocalIterator()}
    sample = found.where("words is not null").select("doc_id", "label", "words").toPandas().sort_values("doc_id", kind="stable")
    return fit_bags([np.frombuffer(w, np.int64) for w in sample["words"]], rows_of, sample["label"].astype(int).tolist())


class Scorer:
    """Scores texts in a task."""

    def __init__(self, model: Model):
        self.model = model
        rows = model.rows.tolist()
        self.memory = Memory(lambda run: sum(rows[b] for b in own) / len(own) if (own := buckets(run)) else None)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = [self.model.worst(np.array([s for s in map(self.memory.__getitem__, runs(t or "")) if s is not None], float)) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -60, 60)))


def score_documents(docs: DataFrame, labels: DataFrame, label: str, visible, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of `docs`.

    The model is fitted on at most 2 * per_class documents whose labels are
    `visible`. A text that is null, empty or without words is scored by the bias
    alone. Without labels of both classes every score is low (only 0 or none
    seen) or high. Repeated rows are scored each; other columns are left unread. An
    empty table gives no rows; of a very long text every window counts.
    """
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, visible, per_class))

    def run(batches):
        scorer = Scorer(model.value)
        for b in slices(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(scorer.scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id bigint, score double")


def below(docs: DataFrame, labels: DataFrame, label: str, visible, threshold: float, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold`; they are scored as by score_documents. An empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, visible, per_class))

    def run(batches):
        scorer = Scorer(model.value)
        for b in slices(batches):
            yield b.filter(pa.array(scorer.scores(b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
