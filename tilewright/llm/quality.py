"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting visits the features in turn; a shallow tree over the bins of one
feature fits what the others leave, and its small step is added to that feature's lookup table. Then the pairs of features
whose coarse grid explains most of the rest get tables of their own in the same way. A score is the sum of the looked-up
entries, turned into a probability.

Features come from the text alone. The model is fitted on the driver on at most about ``MAX_LABELLED`` labelled rows (a
hash of the id chooses them; fewer are taken whole); every text is scored whole, in Arrow batches.

Defined cases: null text counts as empty; empty texts have features of zero and are scored like any other; labels of null
quality or id are left out, several labels of one id count as their mean; without labels, or with labels of one class only,
every score is the labels' mean (0.5 without any); repeated rows are scored alike; an empty table gives an empty table;
columns of the names ``score`` and ``predicted`` are replaced, others pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import extend, raw

MAX_LABELLED = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, RIDGE, LEAF_ROWS, LEAVES = 0.1, 1.0, 10, 4

FEATURES = (
    "words", "bytes_per_word", "distinct_words", "top_word", "repeats_before", "distinct_triples", "short_words",
    "upper", "lower", "beyond_ascii", "digits", "stops", "exclaims", "bars", "signs", "other_marks", "lines_per_word",
    "repeated_lines",
)

SIGNS = b"#*$%&<>{}[]\\~^_=+@"


def word_features(text: bytes) -> tuple[float, ...]:
    """Of the words and lines: count, shares of distinct words and triples, of the top word, of words equal to the last."""
    words = text.split()
    n = len(words)
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    if not n:
        return (0.0,) * 8
    triples = len(set(zip(words, islice(words, 1, None), islice(words, 2, None), strict=False)))
    return (
        np.log1p(n),
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        triples / max(1, n - 2),
        sum(len(w) <= 3 for w in words) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
    )


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    rows = np.array([word_features(t) for t in texts], np.float64).reshape(len(texts), 8)
    bytes_of = np.zeros((len(texts), 256), np.int64)
    for i, t in enumerate(texts):
        if t:
            bytes_of[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    blanks = bytes_of[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
    solid = np.maximum(1, bytes_of.sum(axis=1) - blanks)[:, None]

    def share(codes) -> np.ndarray:
        return (bytes_of[:, list(codes)].sum(axis=1, keepdims=True) / solid)[:, 0]

    known = {*range(48, 58), *range(65, 91), *range(97, 123), *b".,!|", *SIGNS}
    n = np.expm1(rows[:, 0])
    return np.column_stack(
        [
            rows[:, 0], np.where(n > 0, solid[:, 0] / np.maximum(1, n), 0), *rows[:, 1:6].T,
            share(range(65, 91)), share(range(97, 123)), share(range(128, 256)), share(range(48, 58)), share(b".,"),
            share(b"!"), share(b"|"), share(SIGNS), share(c for c in range(33, 127) if c not in known), *rows[:, 6:].T,
        ]
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Steps for ordered bins from sums of gradients, curvatures and rows: the best cut again and again, to ``leaves`` leaves."""
    spans = [(0, len(g))]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n)]

    def worth(a, b):
        return (sums[0][b] - sums[0][a]) ** 2 / (sums[1][b] - sums[1][a] + RIDGE)

    while len(spans) < leaves:
        best = None
        for i, (a, b) in enumerate(spans):
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            fits = (sums[2][cut] - sums[2][a] >= LEAF_ROWS) & (sums[2][b] - sums[2][cut] >= LEAF_ROWS)
            gain = np.where(fits, worth(a, cut) + worth(cut, b) - worth(a, b), 0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = gain[k], i, int(cut[k])
        if best is None:
            break
        _, i, cut = best
        a, b = spans.pop(i)
        spans += [(a, cut), (cut, b)]
    step = np.zeros(len(g))
    for a, b in spans:
        step[a:b] = (sums[0][b] - sums[0][a]) / (sums[1][b] - sums[1][a] + RIDGE)
    return step


def crossed_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps for a grid of bins, cut once each way into four leaves, and what the cuts gain."""
    def corner(x):
        s = np.cumsum(np.cumsum(x, axis=0), axis=1)
        low = s[:-1, :-1]
        return low, s[:-1, -1:] - low, s[-1:, :-1] - low, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low

    parts = list(zip(corner(g), corner(h), corner(n), strict=True))
    gain = sum(a**2 / (b + RIDGE) for a, b, _ in parts) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where(np.minimum.reduce([np.broadcast_to(c, gain.shape) for _, _, c in parts]) >= LEAF_ROWS, gain, 0)
    step = np.zeros_like(g)
    if not gain.size or gain.max() <= 0:
        return step, 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return step, float(gain[i, j])


@dataclass
class AdditiveModel:
    """Cuts and tables of single features and of pairs; scores are sums of entries."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(self.pair_cuts)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw_scores(x))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of nearly equal numbers of rows; fewer where values repeat."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost tables of single features in turn, choose pairs by what they explain of the rest, boost theirs."""
    width = x.shape[1]
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))))
    cuts = [quantile_cuts(x[:, f], BINS) for f in range(width)]
    pair_cuts = [quantile_cuts(x[:, f], PAIR_BINS) for f in range(width)]
    model = AdditiveModel(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [], pair_cuts, [])
    if not len(y) or mean in (0.0, 1.0):
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f in range(width):
            p, k = sigmoid(total), len(cuts[f]) + 1
            step = RATE * shallow_tree(np.bincount(bins[f], y - p, k), np.bincount(bins[f], p * (1 - p), k), np.bincount(bins[f], minlength=k))
            model.tables[f] += step
            total += step[bins[f]]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(pair_cuts)]

    def grid(a, b, weights=None):
        shape = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights, shape[0] * shape[1]).reshape(shape)

    p = sigmoid(total)
    worth = {(a, b): crossed_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b))[1] for a, b in combinations(range(width), 2)}
    model.pairs = sorted(sorted(worth, key=worth.get, reverse=True)[:PAIRS])
    model.pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = sigmoid(total)
            step = RATE * crossed_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(id_col: Column) -> Column:
    """Whether an id is kept from learning: crc32 of its text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    """The model of labelled rows that are not held out, at most about ``max_labelled`` of them."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__tw_id")).agg(F.avg(label_col).alias("y"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("__tw_id"), F.lit(1 << 40)) < int((1 << 40) * max_labelled / n))
    chosen = docs.select(F.col(f"`{id_col}`").alias("__tw_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "__tw_id")
    # a row for each id, so bounded by max_labelled whatever the tables hold
    rows = with_features(chosen, "text").groupBy("__tw_id").agg(F.min(F.struct("features", "y")).alias("x")).select("x.y", "x.features").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.array(rows.column("features").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the array ``features`` (in the order of FEATURES) instead of the text."""

    def compute() -> Callable:
        return lambda col: [list(features(raw(col)))]

    added = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])
    return extend(docs, text_col, added, compute, keep_text=False)


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``docs`` (its text only if asked) with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    tables = docs.sparkSession.sparkContext.broadcast(model)

    def compute() -> Callable:
        return lambda col: [tables.value.scores(features(raw(col)))]

    scored = extend(docs, text_col, T.StructType([T.StructField("score", T.DoubleType())]), compute, keep_text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, fit_quality(docs, labels), keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
