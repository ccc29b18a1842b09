"""Quality: a sparse rule ensemble over text statistics.

Shallow trees are grown in numpy on bootstrap samples of labelled documents.
Every path from a root to a node is a rule, a conjunction of comparisons of
statistics. A lasso logistic regression gives most rules no weight; the others
are compiled into one Spark column expression, so that scoring all documents is
a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.training import labelled_sample

#: At most so many documents of each class are fitted.
PER_CLASS = 4000
TREES, DEPTH, BINS, LEAST, FEATURES, LASSO, STEPS = 40, 3, 32, 5, 5, 2e-4, 600

#: Name -> Spark SQL over text (never null), words (array), n (words) and size (code points).
STATISTICS = {
    "log_size": "ln(1D + size)",
    "log_words": "ln(1D + n)",
    "upper_share": r"length(regexp_replace(text, '[^\\p{Lu}]+', '')) / (size + 1D)",
    "letter_share": r"length(regexp_replace(text, '[^\\p{L}]+', '')) / (size + 1D)",
    "digit_share": "length(translate(text, '0123456789', '')) / -(size + 1D) + size / (size + 1D)",
    "mark_share": "length(translate(text, '*&%$#!', '')) / -(size + 1D) + size / (size + 1D)",
    "bar_share": "length(translate(text, '|', '')) / -(size + 1D) + size / (size + 1D)",
    "stop_share": "length(translate(text, '.,;:?', '')) / -(size + 1D) + size / (size + 1D)",
    "line_share": "length(translate(text, '\n', '')) / -(size + 1D) + size / (size + 1D)",
    "word_length": "aggregate(words, 0L, (a, w) -> a + length(w)) / (n + 1D)",
    "repeat_share": "size(filter(sequence(1, n), i -> i > 1 and element_at(words, i) = element_at(words, i - 1))) / (n + 1D)",
    "distinct_share": "size(array_distinct(words)) / (n + 1D)",
}
NAMES = list(STATISTICS)

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), ...


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and the statistics of whole texts; a null text is empty."""
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.expr(r"filter(split(text, '\\s+'), w -> w <> '')"))
    base = base.withColumns({"n": F.size("words"), "size": F.length("text")})
    return base.select(*keep, *(F.expr(sql if name != "repeat_share" else f"if(n < 2, 0D, {sql})").cast("double").alias(name) for name, sql in STATISTICS.items()))


def grow(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rng, path: Rule = ()) -> list[Rule]:
    """The rules of a tree below `path`; x holds bin numbers, bin b is below edges[b]."""
    if len(path) == DEPTH or len(y) < 2 * LEAST or y.min() == y.max():
        return []
    best = None
    for f in rng.permutation(x.shape[1])[:FEATURES]:
        n = np.cumsum(np.bincount(x[:, f], minlength=BINS + 1))[:-1]
        s = np.cumsum(np.bincount(x[:, f], y, minlength=BINS + 1))[:-1]
        m, t = len(y) - n, y.sum() - s
        ok = (n >= LEAST) & (m >= LEAST)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + t**2 / np.maximum(m, 1), -1)
            b = int(gain.argmax())
            if b < len(edges[f]) and (best is None or gain[b] > best[0]):
                best = gain[b], int(f), b
    if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-9:
        return []
    _, f, b = best
    above = x[:, f] > b
    rules: list[Rule] = []
    for side in (False, True):
        rule = (*path, (f, side, float(edges[f][b])))
        rules += [rule, *grow(x[above == side], y[above == side], edges, rng, rule)]
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, at in rule:
        out &= (x[:, f] > at) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute penalty, by accelerated proximal steps; the bias is free."""
    a = np.concatenate([r, np.ones((len(r), 1))], 1)
    rate = 4 / np.linalg.eigvalsh(a.T @ a / len(a)).max()
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        new = z - rate * (a.T @ (p - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * LASSO, 0)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (old - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """The score, as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            condition = None
            for f, above, at in rule:
                one = F.col(NAMES[f]) > at if above else F.col(NAMES[f]) <= at
                condition = one if condition is None else condition & one
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return Ensemble([], 4.0 if not len(y) or y[0] == 1 else -4.0)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        own = rng.integers(0, len(y), len(y))
        rules |= dict.fromkeys(tuple(sorted(rule)) for rule in grow(binned[own], y[own], edges, rng))
    kept: dict[bytes, Rule] = {}
    for rule in rules:  # of rules that hold for the same rows, the shortest
        key = holds(rule, x).tobytes()
        if key not in kept or len(rule) < len(kept[key]):
            kept[key] = rule
    chosen = list(kept.values())
    if not chosen:
        return Ensemble([], float(np.log(y.mean() / (1 - y.mean()))))
    weights, bias = lasso(np.stack([holds(rule, x) for rule in chosen], 1).astype(float), y)
    return Ensemble([(rule, float(w)) for rule, w in zip(chosen, weights, strict=True) if abs(w) > 1e-3], bias)


def learn(docs: DataFrame, labels: DataFrame, label: str, visible, per_class: int = PER_CLASS) -> Ensemble:
    """Fits the ensemble on at most 2 * per_class documents whose labels are `visible`; only their statistics reach the driver."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, label, visible, per_class)
    rows = statistics(sample, "doc_id", "label").toPandas().sort_values("doc_id")
    return fit(rows[NAMES].to_numpy(float), rows["label"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, label: str, visible, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of `docs`.

    A null or empty text has the statistics of no words and is scored by them.
    Without labels of both classes every score is high (only 1 or none seen) or
    low. Repeated rows are scored each; other columns are left unread. An empty table
    gives no rows, and a very long text is measured whole, as any other.
    """
    ensemble = learn(docs, labels, label, visible, per_class)
    # a generator: a filter of scores would be pushed below the statistics, with a copy of them for each rule
    return statistics(docs, "doc_id").select("doc_id", F.explode(F.array(ensemble.column())).alias("score"))


def at_least(docs: DataFrame, labels: DataFrame, label: str, visible, threshold: float, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `docs`, all columns, whose score is `threshold` or more; they are scored as by score_documents. An empty table stays empty."""
    ensemble = learn(docs, labels, label, visible, per_class)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "text")
    # a filter would be pushed below the statistics, with a copy of them for each rule; a generator's output is not
    kept = statistics(whole, "whole").select(F.explode_outer(F.when(ensemble.column() >= threshold, F.array("whole"))).alias("whole"))
    return kept.where("whole is not null").select("whole.*")
