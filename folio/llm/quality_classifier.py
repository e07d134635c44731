"""Operator 10: a generalised additive model with pairwise interactions, boosted cyclically.

Each feature is cut into at most ``BINS`` quantile bins. Round after round, feature by feature, a
tree of three leaves is fitted to the gradients of the logistic loss and added, shrunk, to the
feature's lookup table. Then the pairs of features that explain most of what is left get tables of
their own from trees that cut both features once. A document's score is the logistic function of
the sum of its bins' entries: array look-ups and additions over whole columns.

The features are ratios of counts in the text; doc_id, lang, source and labels are not among them.
The fit runs on the driver on at most ``MAX_ROWS`` labelled rows, taken by the order of a hash of
doc_id: a few MB whatever the input's size.

Nulls: a null text is scored as the empty one, null labels are not used, several labels of a
document count as their rounded mean. Without labels, or with one class only, the score is the
smoothed share of label 1. Empty tables give no rows; other columns come along unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.text_stats import with_counts

MAX_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15
RIDGE = 2.0
LEAST_ROWS = 8

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct_words", "digits", "capitals", "stops", "line_length", "longest_line", "long_words", "distinct_windows")


def features() -> list[Column]:
    c = lambda name: F.col(f"_counts.{name}").cast("double")
    part = lambda a, b: a / F.greatest(b, F.lit(1.0))
    words, chars, lines = c("n_words"), c("word_chars"), c("n_lines")
    return [
        F.log1p(words), part(chars, words), part(c("n_symbols"), chars), part(c("n_dup_lines"), lines), part(c("n_repeat_words"), words),
        part(c("n_distinct_words"), words), part(c("n_digits"), chars), part(c("n_capitals"), chars), part(c("n_stops"), words), F.log1p(part(words, lines)),
        F.log1p(c("line_chars")), part(c("n_long_words"), words), part(c("n_distinct_windows"), words - 2),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    rows = with_counts(docs, more=True)
    return rows.select(*[c for c in rows.columns if c not in ("_counts", "_features")], F.array(*features()).alias("_features"))


@dataclass
class Additive:
    """Lookup tables: ``cuts[j]`` are the upper bin edges of feature j, ``pairs`` map (j, k) to a table."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (j, k), table in self.pairs.items():
            total += table[coarse[j], coarse[k]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best cut of a run of bins: gain and the first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= LEAST_ROWS) & (n.sum() - nl >= LEAST_ROWS), gain, -1.0)
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _three_leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The table of a tree with up to three leaves over one feature's bins."""
    edges = [0, len(g)]
    for _ in range(2):
        found = [(*_split(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(edges, edges[1:])]
        gain, at, a = max(found)
        if gain <= 0:
            break
        edges = sorted([*edges, a + at])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts each of two features once."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, table = 0.0, np.zeros(g.shape)
    if min(g.shape) < 2:
        return best, table
    parts = []
    for c in (gc, hc):
        ll = c[:-1, :-1]
        lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
        parts.append((ll, lr, rl, c[-1, -1] - ll - lr - rl))
    gain = sum(_gain(a, b) for a, b in zip(*parts)) - _gain(gc[-1, -1], hc[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(*parts)]
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), table


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits the model to rows of finite features and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    wide = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(wide)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(wide):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(bins[j], y - p, len(model.tables[j]))
            h = np.bincount(bins[j], p * (1 - p), len(model.tables[j]))
            step = RATE * _three_leaves(g, h, sizes[j])
            model.tables[j] += step
            total += step[bins[j]]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(wide)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    shape = [len(c) + 1 for c in model.pair_cuts]

    def grid(j, k, weights):
        return np.bincount(coarse[j] * shape[k] + coarse[k], weights, shape[j] * shape[k]).reshape(shape[j], shape[k])

    p = 1 / (1 + np.exp(-total))
    strength = {(j, k): _quadrants(grid(j, k, y - p), grid(j, k, p * (1 - p)))[0] for j, k in combinations(range(wide), 2)}
    chosen = sorted(strength, key=lambda pair: (-strength[pair], pair))[:PAIRS]
    model.pairs = {pair: np.zeros((shape[pair[0]], shape[pair[1]])) for pair in chosen if strength[pair] > 0}
    for _ in range(PAIR_ROUNDS):
        for (j, k), table in model.pairs.items():
            p = 1 / (1 + np.exp(-total))
            step = RATE * _quadrants(grid(j, k, y - p), grid(j, k, p * (1 - p)))[1]
            table += step
            total += step[coarse[j], coarse[k]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents whose labels must not be learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Additive:
    """Fits the model to the texts of at most ``max_rows`` labelled documents."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    taken = usable.groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    got = with_features(rows).select("_label", "_features", "doc_id").limit(2 * max_rows).toPandas()
    got = got.assign(order=got["_features"].map(tuple)).sort_values(["doc_id", "order"], ignore_index=True)
    x = np.array(got["_features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_additive(x, got["_label"].to_numpy(float))


def score(model: Additive) -> Column:
    """The score of a row of ``with_features``; only the features leave the JVM."""

    def of(batch: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(batch.to_numpy()).astype(float)) if len(batch) else np.empty(0))

    return F.pandas_udf(of, T.DoubleType())("_features")


def score_documents(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = with_features(docs.select("doc_id", "text")).select("doc_id", score(model).alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, model: Additive) -> DataFrame:
    """The documents with a score of at least 0.5, with their own columns."""
    rows = with_features(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text"))
    return rows.withColumn("_score", score(model)).filter("_score >= 0.5").select(*[f"_doc.`{c}`" for c in docs.columns])
