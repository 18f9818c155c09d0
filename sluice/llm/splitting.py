"""Words of a tokenizer's pattern, found for many texts at once from classes of characters.

``PATTERN`` cuts a text into contractions, runs of letters, of digits and of other characters, each
with the single space before it, and runs of white space, whose last character stands alone where
something follows. Where words begin follows from the classes of neighbouring characters, so numpy
finds all beginnings of a run of texts together, and words stay places in one array of bytes. Any
other pattern is matched by ``regex``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes: others, letters, digits, white space, and what stands between two texts.
OTHER, LETTER, DIGIT, SPACE, EDGE = range(5)
#: Characters that are split together; longer texts are cut where a space stands between two letters.
RUN_CHARS = 1 << 18
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_BASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    """Words as places in bytes of UTF-8; those of text i are [cuts[i], cuts[i + 1])."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    cuts: np.ndarray

    def strings(self) -> list[list[str]]:
        data = self.flat.tobytes()
        words = [data[a : a + n].decode() for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]
        return [words[a:b] for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)]


class Hashes:
    """64-bit hashes of words, from one running sum over the bytes. Equal words have equal hashes; whoever relies on the converse has to compare."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if len(flat) >= len(self.powers):
            n = 1 << (len(flat) + 1).bit_length()
            self.powers, self.inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.powers[: len(flat)], dtype=np.uint64)])
        found = (sums[starts + sizes] - sums[starts]) * self.inverse[starts]
        return found ^ (found >> np.uint64(29))


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these starts and sizes, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat.take(at)


def same(one: np.ndarray, starts: np.ndarray, two: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of equal sizes, none empty, of two arrays: whether they are equal."""
    if not len(sizes):
        return np.zeros(0, bool)
    differ = gathered(one, starts, sizes) != gathered(two, others, sizes)
    return ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    for kind, part in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(part, every):
            table[points[found.start() : found.end()]] = kind
    return table


def beginnings(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin among code points with these classes; an EDGE is a word of its own."""
    begins = np.empty(len(points), bool)
    begins[:1] = True
    np.not_equal(classes[1:], classes[:-1], out=begins[1:])
    begins[classes == EDGE] = True
    # The last white space before something else stands alone, or goes to it if it is a space.
    last = np.flatnonzero((classes[:-1] == SPACE) & (classes[1:] < SPACE))
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    quotes = np.flatnonzero((points == 0x27) & begins)
    if len(quotes):
        after = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = after[quotes + 1], after[quotes + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quotes[single | double] + 1] = False
        for at in (quotes[single] + 2, quotes[double] + 3):
            begins[at[at < len(points)]] = True
    return begins


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``RUN_CHARS`` characters that are split as the whole is."""
    at = 0
    while len(text) - at > RUN_CHARS:
        found = _SAFE.search(text, at + RUN_CHARS)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def runs(texts: list[str]) -> Iterator[tuple[list[str], bool]]:
    """Texts to be split together, in order; or one long text in pieces, which is then said."""
    run: list[str] = []
    chars = 0
    for text in texts:
        if run and chars + len(text) > RUN_CHARS:
            yield run, False
            run, chars = [], 0
        if len(text) > RUN_CHARS:
            yield list(pieces(text)), True
        else:
            run.append(text)
            chars += len(text)
    if run:
        yield run, False


def splitter(pattern: str) -> Callable[[list[str]], Words]:
    """A function from texts to their words. Made once by a worker: it holds a table of 1.1 MB."""
    if pattern != PATTERN:
        find = regex.compile(pattern).findall

        def each(texts: list[str]) -> Words:
            found = [[w.encode() for w in find(t)] for t in texts]
            sizes = np.array([len(w) for ws in found for w in ws], np.int64)
            flat = np.frombuffer(b"".join(w for ws in found for w in ws), np.uint8)
            return Words(flat, np.cumsum(sizes) - sizes, sizes, np.cumsum([0, *map(len, found)]))

        return each
    table = _classes()

    def together(texts: list[str]) -> Words:
        joined = "\n".join(texts)
        flat = np.frombuffer(joined.encode(), np.uint8)
        if not len(flat):
            none = np.zeros(0, np.int64)
            return Words(flat, none, none, np.zeros(len(texts) + 1, np.int64))
        points = flat if len(flat) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        classes = table.take(points)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[ends[:-1]] = EDGE
        starts = np.flatnonzero(beginnings(points, classes))
        cuts = np.searchsorted(starts, ends)
        word = classes[starts] != EDGE
        stops = np.append(starts[1:], len(points))
        if points is not flat:
            places = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
            starts, stops = places[starts], places[stops]
        # Behind each text but the last stands its edge, which is no word of any text.
        return Words(flat, starts[word], (stops - starts)[word], np.concatenate([[0], cuts - np.arange(len(cuts))]))

    return together
