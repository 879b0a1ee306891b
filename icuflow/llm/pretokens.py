"""Pieces into which a byte-level BPE tokenizer splits a text before it merges, found for many texts at once.

The pieces are those of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Which character begins a piece depends on its neighbours alone, so it is decided for all
characters of a piece of text in one go.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from icuflow.llm.text import range_hashes

CHARS = 1 << 19
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The characters with the property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that the pattern splits off.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[_WHITE] = SPACE
    return table


@dataclass
class Pieces:
    """Pieces of the texts ``first`` to ``first + len(offsets) - 2`` of a batch.

    numbers: for each piece the number of its spelling in ``spellings``. offsets: for each
    text the number of its first piece, and the total at the end. starts: first characters.
    last: False where the last text goes on in the next object.
    """

    first: int
    numbers: np.ndarray
    spellings: list[str]
    offsets: np.ndarray
    starts: np.ndarray
    last: bool = True


def begins(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; a text begins at each place of ``rows``."""
    kind = classes()[codes]
    n = len(kind)
    white = kind == SPACE
    first = np.zeros(n + 1, bool)
    first[rows] = True
    ends = first[1:].copy()  # the text ends after this place
    ends[n - 1 :] = True
    first = first[:n]
    before_white, same, before_blank = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    before_white[1:] = white[:-1]
    same[1:] = kind[1:] == kind[:-1]
    before_blank[1:] = codes[:-1] == 0x20
    next_black = np.zeros(n, bool)
    next_black[:-1] = ~white[1:]
    next_black &= ~ends
    out = np.where(white, ~before_white | next_black, np.where(before_white, ~before_blank, ~same)) | first
    marks = np.flatnonzero((codes == 0x27) & out)
    stop = np.append(rows, n)
    stop = stop[np.searchsorted(stop, marks, "right")] if len(marks) else marks
    for ending in _ENDINGS:
        if not len(marks):
            break
        size = len(ending) + 1
        fits = marks + size <= stop
        for j, c in enumerate(ending, 1):
            fits &= codes[np.minimum(marks + j, n - 1)] == ord(c)
        at = marks[fits]
        out[at + 1] = False
        inner = at + size
        inner = inner[inner < stop[fits]]
        out[inner] = True
        marks, stop = marks[~fits], stop[~fits]
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str], first: int, last: bool) -> Pieces:
    joined = "".join(texts)
    rows = np.cumsum([0, *map(len, texts)])
    codes = codes_of(joined)
    if not len(codes):
        return Pieces(first, np.empty(0, np.int64), [], np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), last)
    starts = np.flatnonzero(begins(codes, rows[:-1][rows[:-1] < len(codes)]))
    ends = np.append(starts[1:], len(codes))
    values = (codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * np.uint64(0x9FB21C651E98DF25)
    hashes = range_hashes(values ^ (values >> np.uint64(32)), starts, ends)
    _, at, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    spellings = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return Pieces(first, numbers, spellings, np.searchsorted(starts, rows), starts, last)


def safe_cut(text: str, at: int) -> int:
    """The first place from ``at`` on where every context begins a piece: a blank between two black characters."""
    kind = classes()
    while (at := text.find(" ", at)) > 0:
        if at + 1 < len(text) and kind[ord(text[at - 1])] != SPACE and kind[ord(text[at + 1])] != SPACE:
            return at
        at += 1
    return len(text)


def split_special(texts, special: dict[str, int]) -> tuple[list[int], list[str | int]]:
    """Texts cut at the strings of added tokens: row numbers, and parts that are a text or a token id."""
    rows: list[int] = []
    parts: list[str | int] = []
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    for row, text in enumerate(texts):
        text = (text.as_py() if isinstance(text, pa.Scalar) else text) or ""
        at = 0
        for m in cut.finditer(text) if cut and any(x in text for x in special) else ():
            rows += [row, row]
            parts += [text[at : m.start()], special[m.group()]]
            at = m.end()
        rows.append(row)
        parts.append(text[at:])
    return rows, parts


def pieces(texts: Iterable) -> Iterator[Pieces]:
    """The pieces of all texts. Long texts come in parts that end at safe places."""
    group: list[str] = []
    size, first, n = 0, 0, 0
    for text in texts:
        if group and size + len(text) > CHARS:
            yield _pieces(group, first, True)
            group, size, first = [], 0, n
        if len(text) > CHARS:
            begin = 0
            while begin < len(text):
                end = safe_cut(text, begin + CHARS) if begin + CHARS < len(text) else len(text)
                yield _pieces([text[begin:end]], n, end == len(text))
                begin = end
            first = n + 1
        else:
            group.append(text)
            size += len(text)
        n += 1
    if group:
        yield _pieces(group, first, True)
