"""Toxicity by maximum-scoring segments.

Every token has a log-odds between toxic and other documents, drawn towards the corpus by a
Dirichlet prior and by the odds that it tells nothing, less a drift that makes ordinary text fall;
a token never seen has the prior's value, 0.  A linear scan finds all maximal segments of a
document's running sum.  Segment scores follow an extreme-value law, fitted on
documents that are not toxic; segments that it calls rare are the toxic passages, and the rarest
one with their number gives the document's score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .quality_gam import labelled
from .samples import chosen, rates, remainder

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case without marks at their ends."""
    return [w.strip(_MARKS) for w in text.lower().encode().split()] if text else []


def hashes(found: list[bytes]) -> np.ndarray:
    """64-bit names of tokens: of n different tokens two agree with odds n^2 / 2^65."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), "<u8")


def maximal_segments(at: list[int] | np.ndarray, gains: list[float] | np.ndarray, drift: float,
                     ) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end, score) where tokens at places ``at`` gain
    ``gains`` and every other token loses ``drift``.  Each ends up on or off a stack once, and a segment
    knows the nearest earlier one that begins below it, so that no search meets one twice (linear)."""
    if not len(at):
        return []
    line = np.full(at[-1] + 1, -drift)
    line[at] = gains
    after = np.cumsum(line)
    before = np.append(0.0, after[:-1])
    up = np.flatnonzero(line > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, earlier one below
    for place, low, high in zip(up.tolist(), before[up].tolist(), after[up].tolist()):
        first, j = place, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, place + 1, low, high, j))
                break
            first, low, below = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = below
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def log_odds(n1: np.ndarray, n0: np.ndarray, prior: float) -> np.ndarray:
    """Of tokens that ``n1`` toxic and ``n0`` other documents hold: log-odds with pseudo-counts of ``prior``
    tokens like the corpus and half a token of each, dealt to both sides by their size (a token
    never seen has 0), times the odds that the token tells at all.  Those come from the counts: a
    token that tells nothing falls to the sides by their size, any other as by an even prior."""
    total = max(n1.sum(), 1.0), max(n0.sum(), 1.0)
    p1, p0 = total[0] / sum(total), total[1] / sum(total)
    pseudo, whole = (n1 + n0) * (prior / sum(total)) + 0.5, prior + 0.5 * (n1.size + 1)

    def logit(n: np.ndarray, every: float, share: float) -> np.ndarray:
        own = n + 2 * share * pseudo
        return np.log(own) - np.log(every + 2 * share * whole - own)

    pairs, back, often = np.unique(np.stack([n1, n0], 1), axis=0, return_inverse=True, return_counts=True)
    even = np.array([lgamma(a + p1) + lgamma(b + p0) - lgamma(a + b + 1) - lgamma(p1) - lgamma(p0) for a, b in pairs])
    against = np.exp(np.minimum(pairs @ np.log([p1, p0]) - even, 700))
    part = 0.01
    for _ in range(100):
        tells = part / (part + (1 - part) * against)
        part = min(0.99, max(1e-6, float(np.average(tells, weights=often)))) if often.size else part
    return (logit(n1, total[0], p1) - logit(n0, total[1], p0)) * tells[back.reshape(-1)]


@dataclass
class Model:
    names: np.ndarray  # sorted hashes of all tokens of the sample
    gain: np.ndarray  # their log-odds less the drift
    drift: float  # what any other token loses
    rate: float  # lambda of the extreme-value law
    size: float  # its K
    curve: np.ndarray  # weights of 1, surprise of the best segment, log of significant segments
    level: float = 0.01  # expected number of segments as good as a significant one

    def segments(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """(first token, end, score) of every maximal segment."""
        if not found or not self.names.size:
            return []
        h = hashes(found)
        place = np.minimum(np.searchsorted(self.names, h), self.names.size - 1)
        at = np.flatnonzero(self.names[place] == h)
        return maximal_segments(at, self.gain[place[at]], self.drift)

    def passages(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """(first token, end, surprise) of every segment; surprise is -log of the number of segments
        as good that a document of this length has by chance."""
        length = np.log(self.size * max(1, len(found)))
        return [(a, b, self.rate * s - length) for a, b, s in self.segments(found)]

    def evidence(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        found = self.passages(tokens(text))
        best = max((s for _, _, s in found), default=-20.0)
        rare = [p for p in found if p[2] >= -np.log(self.level)]
        chance = -np.expm1(-np.exp(-best)) if best > -5 else 1.0  # of a best segment at least so good
        return float(-np.log(max(chance, 1e-30))), len(rare), rare

    def score(self, surprise: np.ndarray, rare: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * np.minimum(surprise, 20) + self.curve[2] * np.log1p(rare)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, drawn towards zero."""
    a = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(a.size),
                               x.T @ (w * (y - p)) - 1e-2 * a)
        a += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return a


def train(docs: DataFrame, labels: DataFrame, bound: int = 10_000, prior: float = 500.0, drift: float = 0.05,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5,
          kept_out: int = 0) -> Model:
    """Learned from about ``bound`` documents of each label among those whose remainder is not
    ``kept_out``: two thirds give the log-odds, a third the extreme-value law and the final curve.  Two
    counts for each token of the first and one row for each document of the second reach the driver."""
    spark = docs.sparkSession
    rows = labelled(labels, label_col, id_col, modulus, kept_out)
    part = rates(rows, "y", bound)
    picked = rows.where(chosen("y", "_id", part))
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("text"))
    # the sample is bounded by ``bound``, so it may be sent to every task
    full = texts.join(F.broadcast(picked), "_id").withColumn("fit", F.expr("pmod(xxhash64(_id, 'fit'), 3) > 0"))

    def count(batch):
        # a document counts a token once: passages repeat their words
        total = Counter((t, y) for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist())
                        for t in set(tokens(text)) if t)
        yield {"h": pa.array(hashes([t for t, _ in total]).view(np.int64)), "y": pa.array([y for _, y in total], pa.int32()),
               "n": pa.array(list(total.values()), pa.int64())}

    counts = (map_batches(full.where("fit").select("y", "text"), "h long, y int, n long", count).groupBy("h")
              .agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("n1"), F.sum(F.expr("if(y = 0, n, 0)")).alias("n0"))).toArrow()
    names = counts.column("h").to_numpy().view(np.uint64)
    order = np.argsort(names)
    odds = log_odds(counts.column("n1").to_numpy().astype(float), counts.column("n0").to_numpy().astype(float), prior)
    model = Model(names[order], odds[order] - drift, drift, 1.0, 1.0, np.zeros(3))
    shared = spark.sparkContext.broadcast(model)

    def segments(batch):
        y, n, best = [], [], []
        for label, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            found = tokens(text)
            y.append(label)
            n.append(len(found))
            best.append([s for _, _, s in shared.value.segments(found)])
        yield {"y": pa.array(y, pa.int32()), "n": pa.array(n, pa.int64()), "s": pa.array(best, pa.list_(pa.float64()))}

    held = map_batches(full.where("NOT fit").select("y", "text"), "y int, n long, s array<double>", segments).toPandas()
    if not len(held):
        return model
    y, n = held["y"].to_numpy(int), np.maximum(held["n"].to_numpy(float), 1)
    # The law of ordinary documents: segments beyond a score s come at K n exp(-rate s), fitted on the tenth
    # with the largest scores (most segments are one token with next to no gain).
    usual = np.concatenate([np.asarray(s, float) for s, k in zip(held["s"], y) if k == 0] or [np.zeros(0)])
    floor = float(np.quantile(usual, 0.9)) if usual.size else 0.5
    beyond = usual[usual >= floor] - floor
    model.rate = float(np.clip((beyond.size + 1) / (beyond.sum() + 1), 0.5, 5.0))
    model.size = float((beyond.size + 0.5) / max(n[y == 0].sum(), 1.0) * np.exp(model.rate * floor))
    best = np.array([max(s) if len(s) else -np.inf for s in held["s"]])
    surprise = model.rate * best - np.log(model.size * n)
    chance = np.where(surprise > -5, -np.expm1(-np.exp(-np.maximum(surprise, -5))), 1.0)
    rare = np.array([sum(model.rate * v - np.log(model.size * m) >= -np.log(model.level) for v in s)
                     for s, m in zip(held["s"], n)])
    x = np.stack([np.ones(len(y)), np.minimum(-np.log(np.maximum(chance, 1e-30)), 20), np.log1p(rare)], 1)
    model.curve = _curve(x, y.astype(float), np.array([1 / part[int(k)] for k in y]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5,
          kept_out: int = 0) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1, higher: toxic likelier), ``predicted``,
    ``passages`` (array of first token, end and surprise of every significant passage).

    A null or empty text has no passage; a null id counts as not held out.  Repeated rows are
    kept; other columns are ignored, whatever their names.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        own = shared.value
        found = [own.evidence(t) for t in batch.column("_text").to_pylist()]
        s = own.score(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
        spans = [[{"first": a, "end": b, "surprise": float(v)} for a, b, v in f[2]] for f in found]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))
        yield {"_id": batch.column("_id"), "held_out": batch.column("held_out"), "score": pa.array(s),
               "predicted": pa.array((s >= 0.5).astype(np.int32)), "passages": pa.array(spans, kind)}

    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(remainder(docs[id_col], modulus) == kept_out, F.lit(False))
    slim = docs.select(docs[id_col].alias("_id"), out.alias("held_out"), docs[text_col].alias("_text"))
    schema = (f"_id {kind}, held_out boolean, score double, predicted int, "
              "passages array<struct<first: int, end: int, surprise: double>>")
    return map_batches(slim, schema, work).withColumnRenamed("_id", id_col)
