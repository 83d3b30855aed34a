"""Phrase collocations from an FM-index per shard over word ids.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and the pieces into
words.  A shard is a bounded run of words of one language; its pieces, parted by an id of their
own, make one cyclic sequence of word ids.  The shard keeps the Burrows-Wheeler transforms of that
sequence and of its reverse, sorted as deep as the longest phrase needs.  A phrase is a pair of
intervals, one in each transform; extending it by a word on the left reads the first, on the right
the second, and moves both intervals.

Phrases are counted by level over all shards: words, then pairs, then longer phrases.  A phrase
can only be frequent if the phrase without its first and the one without its last word are, so a
shard tries just those that extend frequent ones on both sides.  Between levels the shards send
sorted fingerprints with counts, packed by range of fingerprint; a task per range adds them up and
tells each shard which of its fingerprints reach the least count.  Fingerprints that collide add
up, so no phrase is lost; the last step counts the phrases themselves, packed in the same way.

Null texts count as empty, a null language as ``und``.  Ids and other columns are not read, so
repeated rows count each time.  An empty table, or one without frequent phrases, gives no rows.  A
shard holds one piece at least, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import slices, stored
from .shingles import mixed

#: Words of all languages that a task gathers before it makes shards of them.
SHARD = 2_500_000
#: Words of the corpus to each task that adds up fingerprints.
WORDS_A_RANGE = 6_000_000
#: The id of the seam between two pieces.
SEAM = 0
# A-Z to lower case, the signs that end a piece to a line feed, tab to space.
_CASE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in turn, with a line feed between pieces."""
    raw = (text or "").encode().translate(_CASE).replace(b"\n", b" \n ")
    return [w for w in raw.split(b" ") if w]


def runs(found: list[bytes]) -> Iterator[list[bytes]]:
    """The tokens of a text in runs of about :data:`SHARD`, cut between pieces."""
    start = 0
    while start < len(found):
        stop = min(start + SHARD, len(found))
        while stop < len(found) and found[stop - 1] != b"\n":
            stop += 1
        yield found[start:stop]
        start = stop


def _pack(values: np.ndarray) -> bytes:
    """Integers with like bytes side by side, compressed."""
    plain = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(plain.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    plain = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(plain.reshape(8, n).T).view("<u8").ravel()


class Phrases(NamedTuple):
    """Phrases of one length in a shard: their intervals in both transforms, their word ids, and
    the sum of the hashes of their words by place from the end."""
    at: np.ndarray
    back: np.ndarray
    size: np.ndarray
    words: np.ndarray
    hash: np.ndarray

    def where(self, kept: np.ndarray) -> Phrases:
        return Phrases(*(x[kept] for x in self))


def _sorted_rotations(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of ``ids``, sorted by their first ``depth`` ids at least."""
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank)
    while known < depth:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -known)
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(ids.size, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        known *= 2
    return order


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The id before each rotation, rotations in order."""
    return ids[_sorted_rotations(ids, depth) - 1]


class Index:
    """A bidirectional FM-index over word ids: ``front`` is the transform of the sequence, ``rear``
    that of its reverse."""

    def __init__(self, front: np.ndarray, rear: np.ndarray, n_ids: int):
        self.front, self.rear, self.n_ids = front, rear, n_ids
        self.front_step, self.rear_step = self._steps(front), self._steps(rear)

    @staticmethod
    def _steps(transformed: np.ndarray) -> np.ndarray:
        """For each row the row of the rotation that begins one id earlier."""
        out = np.empty(transformed.size, np.int64)
        out[np.argsort(transformed, kind="stable")] = np.arange(transformed.size)
        return out

    def single(self, hashes: np.ndarray) -> Phrases:
        """All words."""
        size = np.bincount(self.front, minlength=self.n_ids)
        at = np.cumsum(size) - size
        ids = np.arange(self.n_ids)
        return Phrases(at, at, size, ids[:, None].astype(np.int32), hashes).where(ids != SEAM)

    def _extended(self, at, other, size, symbols, step):
        """Each interval's extensions by one id: owner, id, both starts, size."""
        before = np.cumsum(size) - size
        rows = np.repeat(at - before, size) + np.arange(int(size.sum()))
        key = np.repeat(np.arange(at.size), size) * self.n_ids + symbols[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.zeros(0, np.int64)
        owner, symbol = np.divmod(key[start], self.n_ids)
        # ids that come earlier lie before it in the other transform
        moved = other[owner] + start - before[owner]
        kept = symbol != SEAM
        return [x[kept] for x in (owner, symbol, step[rows[order[start]]], moved, np.diff(np.append(start, key.size)))]

    def left(self, p: Phrases):
        """Extensions to the left: owner, id, at, back, size."""
        return self._extended(p.at, p.back, p.size, self.front, self.front_step)

    def right(self, p: Phrases):
        """Extensions to the right: owner, id, back, at, size."""
        return self._extended(p.back, p.at, p.size, self.rear, self.rear_step)

    def longer(self, p: Phrases, hashes: np.ndarray) -> Phrases:
        """The phrases that extend one of ``p`` to the left and one of ``p`` to the right."""
        owner, symbol, at, back, size = self.left(p)
        kept = np.isin(at, self.right(p)[3])  # an interval's start names its phrase
        owner, symbol, at, back, size = (x[kept] for x in (owner, symbol, at, back, size))
        place = hashes[symbol] * _PLACES[p.words.shape[1]]
        return Phrases(at, back, size, np.column_stack([symbol.astype(np.int32), p.words[owner]]), p.hash[owner] + place)


#: Odd multipliers by place from the end of a phrase.
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def fingerprints(phrases: Phrases, lang: bytes) -> np.ndarray:
    """48 bits that tell phrases apart, whatever the shard."""
    own = np.uint64(xxhash.xxh3_64_intdigest(lang)) + np.uint64(phrases.words.shape[1])
    return mixed(phrases.hash + own) >> np.uint64(16)


_SHARD_ARROW = pa.schema([
    ("lang", pa.string()), ("vocabulary", pa.binary()), ("n_ids", pa.int32()), ("n", pa.int64()), ("n_words", pa.int64()),
    ("counts", pa.binary()), ("front", pa.binary()), ("rear", pa.binary())])


def _shards(docs: DataFrame, lang_col: str, text_col: str, depth: int) -> DataFrame:
    """One row per shard: lang, its words joined, how often each occurs, both transforms."""
    def made(gathered) -> Iterator[pa.RecordBatch]:
        for lang, (known, ids) in gathered.items():
            if len(known) == 1:
                continue  # seams alone
            ids = np.array([SEAM, *ids], np.int32)
            size = np.bincount(ids, minlength=len(known))
            yield pa.RecordBatch.from_pydict({
                "lang": [lang], "vocabulary": [b" ".join(list(known)[1:])], "n_ids": [len(known)], "n": [ids.size],
                "n_words": [int(size[1:].sum())], "counts": [_pack(size)],
                "front": [_pack(transform(ids, depth))], "rear": [_pack(transform(ids[::-1], depth))]}, _SHARD_ARROW)

    def run(batches):
        gathered, n = {}, 0
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    for found in runs(tokens(text)):
                        known, ids = gathered.setdefault(lang, ({b"\n": SEAM}, []))
                        ids += [known.setdefault(w, len(known)) for w in found]
                        ids.append(SEAM)
                        n += len(found)
                        if n >= SHARD:
                            yield from made(gathered)
                            gathered, n = {}, 0
        yield from made(gathered)

    narrow = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = narrow.where("text IS NOT NULL").mapInArrow(
        run, "lang string, vocabulary binary, n_ids int, n long, n_words long, counts binary, front binary, rear binary")
    return found.withColumn("shard", F.monotonically_increasing_id())


_SENT = "part long, shard long, n int, prints binary, counts binary"


def _range(prints: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges each fingerprint lies in."""
    return ((prints >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sent(shard: int, prints: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Fingerprints with counts, packed by range."""
    prints, place = np.unique(prints, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=prints.size).astype(np.int64)
    part = _range(prints, parts)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if prints.size else np.zeros(0, np.int64)
    ends = np.append(cut[1:], prints.size)
    rows = {"part": [int(part[a]) for a in cut], "shard": [shard] * cut.size, "n": (ends - cut).tolist() if cut.size else [],
            "prints": [_pack(np.diff(prints[a:b], prepend=np.uint64(0))) for a, b in zip(cut, ends)],
            "counts": [_pack(total[a:b]) for a, b in zip(cut, ends)]}
    return pa.RecordBatch.from_pydict(rows, _SENT_ARROW)


_SENT_ARROW = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("prints", pa.binary()),
                         ("counts", pa.binary())])


def _received(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(_unpack(p, n), dtype=np.uint64), _unpack(c, n).astype(np.int64))
            for n, p, c in zip(*(table.column(x).to_pylist() for x in ("n", "prints", "counts")))]


def _reaching(sent: DataFrame, least: int) -> DataFrame:
    """Of the fingerprints that each shard sent those whose sum over all shards reaches ``least``."""
    def add(table: pa.Table) -> pa.Table:
        parts = _received(table)
        prints, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=prints.size)
        kept = prints[total >= least]
        out = {"shard": [], "n": [], "prints": []}
        for shard, (own, _) in zip(table.column("shard").to_pylist(), parts):
            own = own[np.isin(own, kept, assume_unique=True)]
            if own.size:
                out["shard"].append(shard)
                out["n"].append(own.size)
                out["prints"].append(_pack(np.diff(own, prepend=np.uint64(0))))
        return pa.table(out, pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("prints", pa.binary())]))
    return sent.groupBy("part").applyInArrow(add, "shard long, n int, prints binary")


class _Shard:
    """A shard's index with what is known to be frequent (``alive``)."""

    def __init__(self, row: dict, alive: pa.Table):
        self.lang, self.words = row["lang"].encode(), [b"", *row["vocabulary"].split(b" ")]
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, row["n_ids"])
        self.index = Index(_unpack(row["front"], row["n"]).astype(np.int32), _unpack(row["rear"], row["n"]).astype(np.int32),
                           row["n_ids"])
        self.alive = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [
            np.cumsum(_unpack(p, n), dtype=np.uint64)
            for n, p in zip(alive.column("n").to_pylist(), alive.column("prints").to_pylist())]))

    def levels(self, counted: int, upto: int) -> Iterator[Phrases]:
        """The phrases of each length in turn.  The first ``counted`` lengths hold the frequent
        ones alone, the others what can still be frequent in the light of this shard."""
        found = self.index.single(self.hashes * _PLACES[0])
        for length in range(1, upto + 1):
            if length > 1:
                found = self.index.longer(found, self.hashes)
            if length <= counted:
                found = found.where(np.isin(fingerprints(found, self.lang), self.alive))
            yield found


def _in_shards(shards: DataFrame, alive: DataFrame, work, schema: str) -> DataFrame:
    """``work`` (shard number, :class:`_Shard`) on each shard that something is alive in."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        row = left.to_pylist()[0]
        return work(row["shard"], _Shard(row, right))
    empty = shards.sparkSession.createDataFrame([], schema).toArrow()
    slim = shards.select("shard", "lang", "vocabulary", "n_ids", "n", "front", "rear")
    return slim.groupBy("shard").cogroup(alive.groupBy("shard")).applyInArrow(run, schema)


def _first_level(shards: DataFrame, parts: int) -> DataFrame:
    """Every shard's words, as fingerprints with counts."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = row["vocabulary"].split(b" ")
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                size = _unpack(row["counts"], row["n_ids"])[1:].astype(np.int64)
                single = Phrases(size, size, size, np.zeros((size.size, 1), np.int32), hashes * _PLACES[0])
                yield _sent(row["shard"], fingerprints(single, row["lang"].encode()), size, parts)
    return shards.select("shard", "lang", "vocabulary", "n_ids", "counts").mapInArrow(run, _SENT)


def frequent_phrases(docs: DataFrame, least: int = 100, most_words: int = 5, text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase array<string>, n): every phrase of up to ``most_words`` words with at least
    ``least`` occurrences in its language, overlaps included; and (lang, n_words)."""
    if not 2 <= most_words <= len(_PLACES):
        raise ValueError(f"most_words must lie between 2 and {len(_PLACES)}")
    shards = stored(_shards(docs, lang_col, text_col, most_words + 1))
    sizes = shards.groupBy("lang").agg(F.sum("n_words").alias("n_words"))
    parts = 1 + (shards.agg(F.sum("n_words")).first()[0] or 0) // WORDS_A_RANGE
    alive = stored(_reaching(_first_level(shards, parts), least))

    def candidates(counted: int, upto: int):
        def work(number: int, own: _Shard) -> pa.Table:
            found = list(own.levels(counted, upto))[counted:]
            prints = np.concatenate([fingerprints(p, own.lang) for p in found])
            return pa.Table.from_batches([_sent(number, prints, np.concatenate([p.size for p in found]), parts)])
        return work

    # pairs are many, so their counts are taken before longer phrases are tried at all
    for counted, upto in [(1, 2), (2, most_words)][:most_words - 1]:
        sent = _in_shards(shards, alive, candidates(counted, upto), _SENT)
        alive = stored(alive.union(_reaching(sent, least)))

    def written(number: int, own: _Shard) -> pa.Table:
        rows = {name: [] for name in ("part", "lang", "n", "phrases", "counts")}
        for found in own.levels(most_words, most_words):
            prints = fingerprints(found, own.lang)
            order = np.argsort(prints)
            part = _range(prints[order], parts)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if part.size else part[:0]
            for a, b in zip(cut, [*cut[1:], part.size]):
                ids = found.words[order[a:b]].tolist()
                phrases = b"\n".join([b" ".join(map(own.words.__getitem__, row)) for row in ids])
                rows["part"].append(int(part[a]))
                rows["n"].append(int(b - a))
                rows["phrases"].append(zlib.compress(phrases, 1))
                rows["counts"].append(_pack(found.size[order[a:b]]))
        rows["lang"] = [own.lang.decode()] * len(rows["n"])
        return pa.table(rows, _WRITTEN_ARROW)

    found = _in_shards(shards, alive, written, "part long, lang string, n int, phrases binary, counts binary")
    found = found.groupBy("part").applyInArrow(lambda table: _added(table, least), "lang string, phrase string, n long")
    return found.select("lang", F.split("phrase", " ").alias("phrase"), "n"), sizes


_WRITTEN_ARROW = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("phrases", pa.binary()),
                            ("counts", pa.binary())])


def _added(table: pa.Table, least: int) -> pa.Table:
    """The phrases of one range, their counts added over all shards."""
    langs, phrases, counts = [], [], []
    for row in table.select(["lang", "n", "phrases", "counts"]).to_pylist():
        phrases += zlib.decompress(row["phrases"]).split(b"\n")
        counts.append(_unpack(row["counts"], row["n"]).astype(np.int64))
        langs.append(pa.DictionaryArray.from_arrays(pa.array(np.zeros(row["n"], np.int32)), pa.array([row["lang"]])).cast(pa.string()))
    every = pa.table({"lang": pa.chunked_array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                      "n": pa.array(np.concatenate(counts))})
    added = every.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    added = added.filter(pc.greater_equal(added.column("n_sum"), least))
    return added.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of two and more words of each language by how much oftener they occur
    than their parts would meet by chance: lang, rank, phrase, a, l, r, n, score.

    A phrase is scored at the cut where 1000 a n / (l r), rounded down, is least (the first such
    cut); phrases that a longer one contains with the same count are left out."""
    found, sizes = frequent_phrases(docs, least, most_words, text_col, lang_col)
    found = stored(found)
    long = found.where(F.size("phrase") > 1).withColumnRenamed("n", "a")
    # a one word longer phrase with the same count lies between a phrase and any longer such one
    covered = long.where(F.size("phrase") > 2).select("lang", "a", F.explode(F.array(
        F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)"))).alias("phrase"))
    kept = long.join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size(phrase) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("slice(phrase, 1, k)").alias("first"),
                       F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("rest"))
    first = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(
        sizes.select("lang", F.col("n_words").alias("n")), "lang")
    score = F.expr("CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0)) "
                   "div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    least_cut = scored.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r", "n").alias("s"))
    out = least_cut.groupBy("lang", "phrase", "a").agg(F.min("s").alias("s")).select(
        "lang", F.array_join("phrase", " ").alias("phrase"), "a", "s.l", "s.r", "s.n", "s.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 100, most_words: int = 5, top: int = 2000) -> str:
    """The same rows as DuckDB SQL over the table ``documents``, counting every phrase."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = " UNION ALL ".join(
        f"SELECT lang, w[i:i + {d - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {d} + 2)) AS i FROM words "
        f"WHERE len(w) >= {d})" for d in range(1, most_words + 1))
    return f"""
    WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    words AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM cut),
    sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    found AS (SELECT lang, p, count(*) AS n FROM ({runs}) GROUP BY lang, p HAVING count(*) >= {least}),
    long AS (SELECT lang, p, n AS a FROM found WHERE len(p) > 1),
    covered AS (SELECT lang, p[:len(p) - 1] AS p, a FROM long UNION SELECT lang, p[2:] AS p, a FROM long),
    kept AS (SELECT * FROM long ANTI JOIN covered USING (lang, p, a)),
    cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
    scored AS (SELECT c.lang, c.p, c.a, k, f.n AS l, g.n AS r, s.n AS n,
                      (1000::HUGEINT * c.a::HUGEINT * s.n::HUGEINT) // (f.n::HUGEINT * g.n::HUGEINT) AS score
               FROM cuts c JOIN found f ON f.lang = c.lang AND f.p = c.p[:k]
               JOIN found g ON g.lang = c.lang AND g.p = c.p[k + 1:] JOIN sizes s ON s.lang = c.lang),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
               FROM best WHERE i = 1)
    SELECT lang, rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked WHERE rank <= {top}"""
