"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  Cyclic boosting visits the features in turn and adds a
small step of a shallow tree of that one feature, so that the trees of a feature sum up to one
lookup table; the pairs of features that explain most of what is left are boosted the same way
with trees of two cuts.  A score is the sum of a few table entries, found for all documents of a
batch at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, rows_where
from .samples import chosen, rates, remainder

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "mark_share", "space_share", "wide_share",
    "distinct_words", "top_word", "repeated_word", "marked_words", "bare_marks", "distinct_lines",
    "words_a_line", "stops_a_word", "shouted_words", "top_pair",
)
#: Bins of a feature, and of a feature within a pair.
BINS, PAIR_BINS = 64, 12

_KIND = np.zeros(256, np.int64)  # 0 lower case and rest, 1 upper case, 2 digit, 3 mark, 4 white space, 5 beyond ASCII
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 5
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def features(text: str | None) -> list[float]:
    """Numbers about the whole text, all finite; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) / raw.size
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    if not n:
        return [0.0] * 5 + [float(kinds[4])] + [0.0] * (len(FEATURES) - 6)
    count = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    marked = sum(not w[-1].isalnum() for w in words)
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, float(kinds[1]), float(kinds[2]), float(kinds[3]),
        float(kinds[4]), float(kinds[5]), len(count) / n, max(count.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, marked / n,
        sum(not any(map(str.isalnum, w)) for w in words) / n, len(set(lines)) / max(1, len(lines)),
        min(n / max(1, len(lines)), 1000.0), (text.count(". ") + text.count(".\n") + text.endswith(".")) / n,
        sum(len(w) > 1 and w.isupper() for w in words) / n, max(pairs.values(), default=0) / n]


@dataclass
class Model:
    edges: list[np.ndarray]  # inner bin edges of each feature
    pair_edges: list[np.ndarray]
    start: float
    single: list[np.ndarray]  # table of each feature
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, table in enumerate(self.single):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for p in self.pairs for j in p[:2]}
        for j, k, table in self.pairs:
            out += table[coarse[j], coarse[k]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Best steps of up to ``leaves`` stretches of bins, cut greedily where the gain is largest."""
    g, h = np.append(0.0, np.cumsum(grad)), np.append(0.0, np.cumsum(hess))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    cuts = [0, grad.size]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                better = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(better.argmax())
                best = max(best, (float(better[k]), int(m[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(grad.size)
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _two_cuts(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of both features into four quarters."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    a, b = np.arange(1, max(2, grad.shape[0]))[:, None], np.arange(1, max(2, grad.shape[1]))[None]
    quarters = []
    for x in (g, h):
        q11 = x[a, b]
        quarters.append([q11, x[a, -1] - q11, x[-1, b] - q11, x[-1, -1] - x[a, -1] - x[-1, b] + q11])
    value = sum(p * p / (q + ridge) for p, q in zip(*quarters))
    i, j = np.unravel_index(int(value.argmax()), value.shape)
    steps = [float(p[i, j] / (q[i, j] + ridge)) for p, q in zip(*quarters)]
    out = np.empty(grad.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = steps
    return float(value[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, pair_rounds: int = 60,
        pairs: int = 8, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> Model:
    """Cyclic boosting on the logistic loss: features first, then the pairs of largest gain."""
    total = weight.sum() or 1.0
    share = min(max(float((weight * y).sum() / total), 1e-4), 1 - 1e-4) if len(y) else 0.5
    edges = [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    coarse = [_edges(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Model(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(e.size + 1) for e in edges], [])
    if not len(x) or not 0 < share < 1 or len(set(y.tolist())) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    margin = np.full(len(x), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.single):
            if table.size > 1:
                grad, hess = slopes()
                step = rate * _shallow_tree(np.bincount(at[j], grad, table.size),
                                            np.bincount(at[j], hess, table.size), leaves, ridge)
                table += step
                margin += step[at[j]]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(j, k, values):
        shape = (coarse[j].size + 1, coarse[k].size + 1)
        return np.bincount(low[j] * shape[1] + low[k], values, shape[0] * shape[1]).reshape(shape)

    grad, hess = slopes()
    gains = [(_two_cuts(grid(j, k, grad), grid(j, k, hess), ridge)[0], j, k)
             for j, k in combinations([j for j in range(x.shape[1]) if coarse[j].size], 2)]
    model.pairs = [(j, k, np.zeros((coarse[j].size + 1, coarse[k].size + 1)))
                   for _, j, k in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for j, k, table in model.pairs:
            grad, hess = slopes()
            step = rate * _two_cuts(grid(j, k, grad), grid(j, k, hess), ridge)[1]
            table += step
            margin += step[low[j], low[k]]
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = 5000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", modulus: int = 3, kept_out: int = 1) -> Model:
    """Fitted on about ``bound`` documents of each label among those whose remainder is not
    ``kept_out``.  Null labels and labels other than 0 and 1 are left out; of several labels of one id
    the largest counts.  What reaches the driver is one row of features a sampled document."""
    rows = labelled(labels, label_col, id_col, modulus, kept_out)
    part = rates(rows, "y", bound)
    picked = rows.where(chosen("y", "_id", part))
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("text"))
    # the sample is bounded by ``bound``, so it may be sent to every task
    full = texts.join(F.broadcast(picked), "_id").select("y", "text")

    def work(batch):
        yield {"y": batch.column("y"), "x": [features(t) for t in batch.column("text").to_pylist()]}

    got = map_batches(full, "y int, x array<double>", work).toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy(float)
    return fit(x, y, np.array([1 / part[int(v)] for v in y]) / max([1.0, *(1 / p for p in part.values())]))


def labelled(labels: DataFrame, label_col: str, id_col: str, modulus: int, kept_out: int) -> DataFrame:
    """(_id, y): one 0/1 label of each id that may be learned from."""
    rows = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("y"))
    rows = rows.where("_id IS NOT NULL AND y IN (0, 1)").where(remainder("_id", modulus) != kept_out)
    return rows.groupBy("_id").agg(F.max("y").alias("y"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3,
          kept_out: int = 1) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``.

    A null or empty text is scored on features of zero; a null id counts as not held out.
    Repeated rows are kept; other columns are ignored, whatever their names.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        x = np.array([features(t) for t in batch.column("_text").to_pylist()])
        s = shared.value.score(x)
        yield {"_id": batch.column("_id"), "held_out": batch.column("held_out"), "score": pa.array(s),
               "predicted": pa.array((s >= 0.5).astype(np.int32))}

    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(remainder(docs[id_col], modulus) == kept_out, F.lit(False))
    slim = docs.select(docs[id_col].alias("_id"), out.alias("held_out"), docs[text_col].alias("_text"))
    done = map_batches(slim, f"_id {kind}, held_out boolean, score double, predicted int", work)
    return done.withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least 0.5, all their columns as they are.

    A null or empty text is scored on features of zero; null ids and repeated rows stay or go by
    their text; an empty table stays empty.  A model that nothing was learned from scores 0.5, so
    all documents stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts):
        x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return (shared.value.score(x) >= 0.5).tolist()
    return rows_where(docs, text_col, keep)
