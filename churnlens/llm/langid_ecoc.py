"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1.  For each bit a binary classifier over byte n-grams
tells the languages with +1 from those with -1; a document's bit scores are compared with every
codeword under the logistic loss, each bit weighted by how well it did on rows that its n-gram
weights were not learned from.  The codeword of least loss wins.

A text is flagged as ambiguous in three cases, whose limits are read off pieces of known language
of many lengths, as short texts say less (:class:`Limits`): its lead over the next codeword is one
at which pieces of its length are often mistaken; its n-grams are rarer in the language found than
those of any piece of its length (another language, or none); or a good part of it, taken in
stretches, is clearly in another language (:func:`parts_apart`).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, rows_where
from .samples import chosen, rates, remainder

#: Lengths of the n-grams in bytes, and buckets of each length.
GRAMS, BUCKETS = (2, 3, 4), 1 << 14
#: Bytes whose n-grams are held at once.
BYTES_AT_ONCE = 1 << 18
#: Bytes of a part of a text that is judged by itself, and the share of such parts that may not be apart.
PART, APART = 512, 0.25
#: Characters of the pieces that limits are read off, beside whole texts; classes of lengths.
PIECES, CLASSES = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048), 24
#: Pieces of one length class that are too few to read limits off.
FEW = 30
#: Share of mistaken pieces that puts a lead in doubt.
MISTAKES = 0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32  # all but letters is a blank


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One row of +1 and -1 per language.  Up to six languages: every way to part them; beyond,
    the best of random codes by least distance, of 10 log2 n bits."""
    if languages <= 6:
        rest = [(1, *x) for x in product((1, -1), repeat=max(0, languages - 1)) if -1 in x]
        return np.array(rest or [(1,) * languages], np.int8).reshape(-1, languages).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        near = (code.astype(int) @ code.T.astype(int)) - 2 * bits * np.eye(languages, dtype=int)
        if (np.abs(code.sum(0)) < languages).all() and (best is None or near.max() < best[0]):
            best = near.max(), code
    return best[1]


def grams_of(raw: np.ndarray) -> list[np.ndarray]:
    """Bucket of each n-gram, by length; place k is the n-gram that starts at byte k."""
    wide = raw.astype(np.uint32)
    out, code = [], wide
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ wide[n - 1:]
        if n in GRAMS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(18)) + np.uint32(BUCKETS * len(out)))
    return out


def _stretches(texts: list[str | None]):
    """(index, bytes) of texts in pieces of bounded length that overlap by an n-gram less one."""
    for k, text in enumerate(texts):
        raw = _LOWER[np.frombuffer(f" {text or ''} ".encode(), np.uint8)]
        for a in range(0, max(1, raw.size - max(GRAMS) + 1), BYTES_AT_ONCE):
            yield k, raw[a:a + BYTES_AT_ONCE + max(GRAMS) - 1]


def part_sums(texts: list[str | None], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in parts of :data:`PART` bytes (the last one up to twice as long): the text of each part, the
    sums of ``columns`` over its n-grams, and their number."""
    owner, sums, counts = [], [], []
    for k, raw in _stretches(texts):
        start = np.arange(0, max(1, raw.size - PART + 1), PART)
        total, count = np.zeros((start.size, columns.shape[1])), np.zeros(start.size)
        for grams in grams_of(raw):
            if grams.size:
                at = start[start < grams.size]
                total[:at.size] += np.add.reduceat(columns[grams], at, axis=0)
                count[:at.size] += np.diff(np.append(at, grams.size))
        owner += [k] * start.size
        sums.append(total)
        counts.append(count)
    if not owner:
        return np.zeros(0, np.int64), np.zeros((0, columns.shape[1])), np.zeros(0)
    return np.array(owner), np.concatenate(sums), np.concatenate(counts)


def _whole(owner: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """Parts added up by text."""
    out = np.zeros((n, *parts.shape[1:]))
    np.add.at(out, owner, parts)
    return out


def bit_means(texts: list[str | None], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of ``columns`` over the n-grams of each text, and their number."""
    owner, sums, counts = part_sums(texts, columns)
    size = _whole(owner, counts, len(texts))
    return _whole(owner, sums, len(texts)) / np.maximum(size, 1)[:, None], size


def length_class(counts: np.ndarray) -> np.ndarray:
    """Of texts by their number of n-grams: powers of two, up to :data:`CLASSES` of them."""
    return np.clip(np.log2(np.maximum(counts, 1)).astype(int), 0, CLASSES - 1)


@dataclass
class Limits:
    """By length class: the lead below which more than :data:`MISTAKES` of the calibration pieces are
    mistaken, and the lowest mean log-share of n-grams, against that of the language found,
    that any of them has, with a margin."""
    lead: np.ndarray
    usual: np.ndarray

    @classmethod
    def read_off(cls, size: np.ndarray, lead: np.ndarray, right: np.ndarray, rarity: np.ndarray) -> Limits:
        kind = length_class(size)
        least, usual = np.full(CLASSES, np.inf), np.full(CLASSES, -np.inf)
        for k in range(CLASSES):
            if k:  # longer texts say more; a class of few pieces is judged as the next shorter one
                least[k], usual[k] = least[k - 1], usual[k - 1]
            at = np.flatnonzero(kind == k)
            if at.size >= FEW:
                order = at[np.argsort(lead[at], kind="stable")]
                window = max(FEW // 2, order.size // 50)
                # from the least lead up, windows of pieces until one is mostly right; pieces that
                # are mistaken with a large lead have a wrong label or hold two languages
                start = 0
                while start < order.size and np.mean(~right[order[start:start + window]]) > MISTAKES:
                    start += window
                found = lead[order[start]] if 0 < start < order.size else 0.0 if start == 0 else np.inf
                least[k] = min(least[k], found)
                low, middle = rarity[at].min(), np.median(rarity[at])
                usual[k] = low - 0.5 * (middle - low) - 0.05
        return cls(least, usual)

    def doubted(self, size: np.ndarray, lead: np.ndarray, rarity: np.ndarray) -> np.ndarray:
        kind = length_class(size)
        return (lead < self.lead[kind]) | (rarity < self.usual[kind])


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    table: np.ndarray  # n-gram bucket x bit
    slope: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    rare: np.ndarray  # n-gram bucket x language: log of the share
    typical: np.ndarray  # mean log-share of each language's own texts
    limits: Limits | None = None

    def columns(self) -> np.ndarray:
        return np.concatenate([self.table, self.rare], axis=1)

    def judged(self, means: np.ndarray) -> tuple[np.ndarray, ...]:
        """From means of :meth:`columns`: best language, its share, lead, rarity in it."""
        best, share, lead = self.decode(means[:, :self.table.shape[1]])
        return best, share, lead, means[np.arange(best.size), self.table.shape[1] + best] - self.typical[best]

    def decode(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of all codewords' likelihood, the lead in loss."""
        z = means * self.slope + self.shift
        loss = (self.weight[None, None] * np.logaddexp(0, -self.code[None] * z[:, None])).sum(2)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + np.inf
        return best, share[np.arange(best.size), best], second - loss.min(1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve with a weak pull to slope 0, by Newton steps."""
    scale = x.std() or 1.0
    a, design = np.zeros(2), np.stack([x / scale, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-3 * a
        hess = (design * (w * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a + step
        if np.abs(step).max() < 1e-6:
            break
    return a[0] / scale, a[1]


def train(docs: DataFrame, bound: int = 3000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang", modulus: int = 3, kept_out: int = 1) -> Model | None:
    """A model learned from about ``bound`` documents of each language among those whose remainder is
    not ``kept_out``: three quarters give the n-gram weights, one quarter the curves and weights
    of the bits.  Sizes on the driver follow the parameters and the number of languages."""
    narrow = docs.select(docs[id_col].alias("_id"), docs[label_col].cast("string").alias("lang"))
    usable = (remainder("_id", modulus) != kept_out) & F.col("lang").isNotNull()
    part = rates(narrow.where(usable), "lang", bound)
    if not part:
        return None
    languages = sorted(part)
    full = docs.select(docs[id_col].alias("_id"), docs[label_col].cast("string").alias("lang"),
                       docs[text_col].alias("text")).where(usable & F.col("text").isNotNull())
    full = full.where(chosen("lang", "_id", part)).withColumn("fit", F.expr("pmod(xxhash64(_id, 'fit'), 4) > 0"))
    row = {x: k for k, x in enumerate(languages)}

    def count(batch):
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for _, raw in _stretches([text]):
                own = total.setdefault(lang, np.zeros(BUCKETS * len(GRAMS), np.int64))
                own += np.bincount(np.concatenate(grams_of(raw)), minlength=own.size)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield {"lang": pa.array([row[lang]] * at.size, pa.int32()), "bucket": pa.array(at.astype(np.int32)),
                   "n": pa.array(own[at])}

    counts = map_batches(full.where("fit").select("lang", "text"), "lang int, bucket int, n long", count)
    seen = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    number = np.full((len(languages), BUCKETS * len(GRAMS)), 0.0)
    number[seen["lang"].to_numpy(int), seen["bucket"].to_numpy(int)] = seen["n"].to_numpy(float)
    share = (number + 0.5).reshape(len(languages), len(GRAMS), BUCKETS)
    share = (share / share.sum(2, keepdims=True)).reshape(len(languages), -1)
    code = codewords(len(languages))
    plus = (code > 0).astype(float)
    up = plus.T @ share / np.maximum(plus.sum(0), 1)[:, None]
    down = (1 - plus).T @ share / np.maximum((1 - plus).sum(0), 1)[:, None]
    table = (np.log(up) - np.log(np.where(down > 0, down, up))).T.astype(np.float32)
    bits, rare = code.shape[1], np.log(share).T.astype(np.float32)
    # the mean of a language's own n-grams, each counted as often as its share says
    typical = (share * rare.T).sum(1) / len(GRAMS)
    model = Model(languages, code, table, np.full(bits, 20.0), np.zeros(bits), np.ones(bits), rare, typical)

    shared = docs.sparkSession.sparkContext.broadcast(model.columns())

    def score(batch):
        langs, texts, whole = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            cut = [text, *(text[len(text) // 3:len(text) // 3 + n] for n in PIECES if n < len(text))]
            langs += [row[lang]] * len(cut)
            whole += [k == 0 for k in range(len(cut))]
            texts += cut
        means, size = bit_means(texts, shared.value)
        yield {"lang": pa.array(langs, pa.int32()), "size": pa.array(size), "whole": pa.array(whole, pa.bool_()),
               "means": means.tolist()}

    held = map_batches(full.where("NOT fit").select("lang", "text"), "lang int, size double, whole boolean, means array<double>",
                       score).toPandas()
    if len(held):
        every, langs, whole = np.stack(held["means"].to_numpy()), held["lang"].to_numpy(int), held["whole"].to_numpy(bool)
        # the curves are fitted to whole texts, the limits read off pieces too
        means, lang = every[whole][:, :bits], langs[whole]
        balance = (1 / np.bincount(lang, minlength=len(languages)).clip(1))[lang] * len(lang) / len(languages)
        for b in range(bits):
            y = (code[lang, b] > 0).astype(float)
            if 0 < y.sum() < y.size:
                model.slope[b], model.shift[b] = _logistic(means[:, b], y, balance)
                z = means[:, b] * model.slope[b] + model.shift[b]
                wrong = np.average((z > 0) != (y > 0), weights=balance).clip(1e-3, 0.5 - 1e-3)
                model.weight[b] = np.log((1 - wrong) / wrong)
        model.weight /= model.weight.mean()
        best, _, lead, rarity = model.judged(every)
        model.limits = Limits.read_off(held["size"].to_numpy(), lead, best == langs, rarity)
    return model


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predicted(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is ambiguous of each text."""
    known = [model is not None and _has_letter(t) for t in texts]
    langs, scores, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    at = [k for k, x in enumerate(known) if x]
    if at:
        owner, sums, counts = part_sums([texts[k] for k in at], model.columns())
        size = _whole(owner, counts, len(at))
        best, share, lead, rarity = model.judged(_whole(owner, sums, len(at)) / np.maximum(size, 1)[:, None])
        doubt = np.zeros(len(at), bool)
        if model.limits is not None:
            doubt = model.limits.doubted(size, lead, rarity) | parts_apart(model, owner, sums, counts, best)
        for k, b, s, d in zip(at, best.tolist(), share.tolist(), doubt.tolist()):
            langs[k], scores[k], unsure[k] = model.languages[b], min(1.0, s), d
    return langs, scores, unsure


def parts_apart(model: Model, owner: np.ndarray, sums: np.ndarray, counts: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Texts of which :data:`APART` of the parts or more are, without doubt of their own, in another
    language than the whole."""
    own, _, lead, rarity = model.judged(sums / np.maximum(counts, 1)[:, None])
    other = (own != best[owner]) & ~model.limits.doubted(counts, lead, rarity)
    parts, others = np.bincount(owner, minlength=best.size), np.bincount(owner, weights=other, minlength=best.size)
    return others >= APART * parts


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents of an unambiguous language, all their columns as they are.

    A null text, and one without letters, goes; null ids and repeated rows stay or go by their
    text; an empty table stays empty.  With nothing to learn from (no model) no language is in
    doubt: all documents that have a letter stay."""
    if model is None:
        return rows_where(docs, text_col, lambda texts: [_has_letter(t) for t in texts])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows_where(docs, text_col, lambda texts: [not x for x in predicted(texts, shared.value)[2]])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             modulus: int = 3, kept_out: int = 1) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` (see the
    module; also where there is no prediction).

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if there was nothing
    to learn from.  A null id counts as not held out.  Repeated rows are kept; other columns are
    ignored, whatever their names.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        lang, sure, unsure = predicted(batch.column("_text").to_pylist(), shared.value)
        yield {"_id": batch.column("_id"), "held_out": batch.column("held_out"), "lang_pred": lang,
               "score": sure, "ambiguous": unsure}

    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(remainder(docs[id_col], modulus) == kept_out, F.lit(False))
    slim = docs.select(docs[id_col].alias("_id"), out.alias("held_out"), docs[text_col].alias("_text"))
    schema = f"_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return map_batches(slim, schema, work).withColumnRenamed("_id", id_col)
