"""Splitting texts for byte-level BPE.

A text is cut where white space follows anything else.  No match of the pattern crosses such
a place and no alternative looks behind, so the matches of a text are those of its pieces in
turn.  Most pieces are one word; each distinct piece is matched once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import regex

# The code points with the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"
_SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_WHITE}]", chr(c)))
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")

# Fixed value: the byte-level pattern.  Its letters are one match whatever follows, and no match goes
# on after white space that follows anything else, which is what cutting texts into pieces needs.
CUT_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)

#: Pieces of one text handled at once, so that a very long text needs no more memory than this.
PIECES_AT_ONCE = 1 << 18
#: Distinct pieces a worker remembers; beyond it, it forgets them all and goes on.
REMEMBERED = 600_000


def checked(pattern: str) -> str:
    """``pattern``, if texts may be cut into pieces before it is applied; others would give wrong
    tokens at the cuts and are refused."""
    if pattern not in CUT_PATTERNS:
        raise ValueError(f"texts cannot be cut for the pattern {pattern!r}")
    return pattern


def pieces(text: str) -> Iterator[list[str]]:
    """The pieces of ``text`` in order, in lists of bounded length."""
    if len(text) <= PIECES_AT_ONCE:
        yield _PIECE.findall(text)
        return
    found = (m.group() for m in _PIECE.finditer(text))
    while part := list(islice(found, PIECES_AT_ONCE)):
        yield part


def match_pieces(distinct: Iterable[str], pattern: regex.Pattern) -> tuple[list[str], list[str], np.ndarray]:
    """The pieces in a new order, the matches of all of them in turn, and for each piece the
    index of its first match (one more at the end).

    Letters after at most one blank are one match.  Other pieces that begin with white space
    and end without are matched as one string, as no match crosses a seam between two of them;
    the rest (first and last pieces of texts) one by one."""
    words, seams, apart = [], [], []
    for piece in distinct:
        if (piece[1:] if piece[0] == " " else piece).isalpha():
            words.append(piece)
        elif piece[0] in _SPACES and piece[-1] not in _SPACES:
            seams.append(piece)
        else:
            apart.append(piece)
    tokens = list(words)
    found = pattern.findall("".join(seams))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    starts = np.append(0, np.cumsum(np.fromiter(map(len, seams), np.int64, len(seams))))[:-1]
    first = [np.arange(len(words)), len(words) + np.searchsorted(ends, starts, side="right")]
    tokens += found
    rest = []
    for piece in apart:
        rest.append(len(tokens))
        tokens += pattern.findall(piece)
    return words + seams + apart, tokens, np.concatenate([*first, rest, [len(tokens)]]).astype(np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that belong to ``rows``, one after another."""
    size = sizes[rows].astype(np.int64)
    shift = np.repeat(starts[rows] - (np.cumsum(size) - size), size)
    return values[shift + np.arange(shift.size)]


class Remembered:
    """Piece -> row of a ragged table of values, filled by ``solve`` for all unknown pieces of a
    block at once.  ``solve`` takes pieces and gives them in its order, with the values of all
    in turn and the number of values of each."""

    def __init__(self, solve: Callable[[set[str]], tuple[list[str], np.ndarray, np.ndarray]]):
        self._solve = solve
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.values, self.sizes, self.starts = [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.int64)]

    def learn(self, seen: set[str]) -> None:
        if len(self.row) + len(seen) > REMEMBERED:
            self.forget()
        new = seen.difference(self.row)
        if new:
            ordered, values, sizes = self._solve(new)
            self.row.update(zip(ordered, range(len(self.row), len(self.row) + len(ordered))))
            self.starts = np.append(self.starts, self.values.size + np.cumsum(sizes) - sizes)
            self.values, self.sizes = np.append(self.values, values), np.append(self.sizes, sizes)

    def rows(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, found), np.int64, len(found))

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The values of the given rows one after another."""
        return ragged(self.values, self.starts, self.sizes, rows)


#: Characters handled at once: bounds a worker's lists of pieces whatever the texts' lengths.
BLOCK_CHARS = 1 << 21


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most BLOCK_CHARS characters, or one longer text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > BLOCK_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def looked_up(texts: list[str], known: Remembered) -> Iterator[tuple[int, np.ndarray]]:
    """Of the texts of one block: index and rows in ``known`` of its pieces in turn; a long text
    comes in several parts."""
    if len(texts) == 1:
        for part in pieces(texts[0]):
            known.learn(set(part))
            yield 0, known.rows(part)
        return
    found = [_PIECE.findall(t) for t in texts]
    known.learn(set().union(*found))
    for k, part in enumerate(found):
        yield k, known.rows(part)
