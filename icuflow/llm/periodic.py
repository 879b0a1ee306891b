"""Stretches of words that repeat with a period, found by minimizers at several scales and by direct lag scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from icuflow.llm.text import SPACED, Words, add_columns, mix, powers, words

LAGS = 32  # shorter periods are scanned directly
LEAST = 12
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Runs:
    """The maximal runs of one sequence of 64-bit values: (start, end, smallest period), periods in growing order."""

    def __init__(self, values: np.ndarray, least: int):
        self.values, self.least = values, least
        n = len(values)
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.total[1:])
        self.start, self.end, self.period = (np.empty(0, np.int64) for _ in range(3))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Equal for equal content."""
        return (self.total[at + size] - self.total[at]) * self.down[at]

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Takes the stretches that are long enough. One that is known already has a shorter period, which divides this one."""
        good = end - start >= np.maximum(self.least, 2 * period)
        order = np.lexsort((period[good], end[good], start[good]))
        start, end, period = start[good][order], end[good][order], period[good][order]
        key = start * (len(self.values) + 1) + end
        new = (np.diff(key, prepend=-1) != 0) & ~np.isin(key, self.start * (len(self.values) + 1) + self.end)
        self.start, self.end, self.period = (np.append(a, b[new]) for a, b in ((self.start, start), (self.end, end), (self.period, period)))

    def scan(self, period: int) -> None:
        """All runs of one period: words ``period`` apart are compared everywhere."""
        same = np.zeros(len(self.values) - period + 2, np.int8)
        same[1:-1] = self.values[period:] == self.values[:-period]
        turns = np.flatnonzero(np.diff(same))
        self.add(turns[::2], turns[1::2] + period, np.full(len(turns) // 2, period))

    def extend(self, at: np.ndarray, period: np.ndarray) -> None:
        """The runs around seeds: how far to the left and right values ``period`` apart stay equal, by halving steps."""
        n = len(self.values)
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 1 << max(n.bit_length() - 1, 0)
        while step:
            more = right + step
            fits = np.flatnonzero(at + period + more <= n)
            a, size = at[fits], more[fits]
            fits = fits[self.hashes(a, size) == self.hashes(a + period[fits], size)]
            right[fits] += step
            more = left + step
            fits = np.flatnonzero(at - more >= 0)
            a, size = at[fits] - more[fits], more[fits]
            fits = fits[self.hashes(a, size) == self.hashes(a + period[fits], size)]
            left[fits] += step
            step >>= 1
        self.add(at - left, at + period + right, period)

    def scale(self, reach: int) -> None:
        """All runs with periods from ``reach`` to below twice ``reach``; those of shorter periods are known.

        Blocks of reach / 2 words are hashed, and each window of ``reach`` words selects its smallest block, the first of
        equals. What a window selects depends on its words alone, so inside a run the window one period on selects the
        same block. Blocks with a period of reach / 4 or less take no part: those that do stand at least
        reach / 4 apart if equal, so a selected block meets at most eight others in reach.
        """
        size, n = reach // 2, len(self.values)
        m = n - size + 1
        if m < 1:
            return
        full = mix(self.hashes(np.arange(m), size))
        known = (self.period <= size // 2) & (self.end - self.start >= size)
        marks = np.zeros(m + 1, np.int64)
        np.add.at(marks, self.start[known], 1)
        np.add.at(marks, self.end[known] - size + 1, -1)
        bits = np.uint64(n.bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        key = np.where(np.cumsum(marks[:-1]) > 0, _TOP, (full & ~low) | np.arange(m, dtype=np.uint64))
        best = _window_min(key, reach - size + 1)
        chosen = np.zeros(m, bool)
        chosen[(best[best != _TOP] & low).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        at = at[np.argsort(full[at], kind="stable")]
        seeds, lags, k = [], [], 1
        while k < len(at):
            lag = at[k:] - at[:-k]
            near = (full[at[k:]] == full[at[:-k]]) & (lag < 2 * reach)
            if not near.any():
                break
            near &= lag >= reach
            seeds.append(at[:-k][near])
            lags.append(lag[near])
            k += 1
        for seed, lag in self._neighbours(reach):
            seeds.append(seed)
            lags.append(lag)
        if seeds:
            self.extend(np.concatenate(seeds), np.concatenate(lags))

    def _neighbours(self, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Seeds for runs whose first period is itself a run of a much shorter period: two such runs then follow each other closely."""
        long = np.flatnonzero((self.period <= reach // 4) & (self.end - self.start >= reach))
        long = long[np.lexsort((self.start[long], self.period[long]))]
        a, b = long[:-1], long[1:]
        gap = self.end[a] - self.start[b]
        touch = (self.period[a] == self.period[b]) & (gap >= 0) & (gap < self.period[a])
        for x, y in zip(a[touch].tolist(), b[touch].tolist(), strict=True):
            p, first = int(self.period[x]), int(self.start[y])
            turn = int(self.start[x]) + np.arange(p)
            same = np.flatnonzero(self.hashes(turn, p) == self.hashes(np.array([first]), p))
            if len(same):
                lag = reach + (first - int(turn[same[0]]) - reach) % p
                lag = np.arange(lag, 2 * reach, p)
                yield np.maximum(int(self.start[x]), first - lag), lag


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window, from minima that run forward and backward within blocks of the window's width."""
    n = len(key)
    if n <= width:
        return key[:0] if n < width else key.min(keepdims=True)
    blocks = np.full((-(-n // width), width), _TOP)
    blocks.reshape(-1)[:n] = key
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_runs(values: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, smallest period of every maximal run of at least ``least`` values and two periods.

    longest: no run is longer than this.
    """
    found = _Runs(values, least)
    for period in range(1, min(LAGS, longest // 2 + 1, len(values))):
        found.scan(period)
    reach = LAGS
    while 2 * reach <= longest:
        found.scale(reach)
        reach *= 2
    return found.start, found.end - found.start, found.period


def _runs_of(part: Words, least: int) -> tuple[np.ndarray, ...]:
    """text, start, length, period of the runs of some texts, in order.

    Texts of similar length are laid in one row with values between them that occur once.
    """
    sizes = np.diff(part.offsets)
    grade = np.array([max(int(s), 63).bit_length() for s in sizes])
    out = []
    for g in np.unique(grade[sizes >= least]).tolist():
        texts = np.flatnonzero((grade == g) & (sizes >= least))
        first = np.cumsum(sizes[texts] + 1) - sizes[texts] - 1
        values = mix(np.arange(int(first[-1] + sizes[texts[-1]] + 1), dtype=np.uint64) ^ np.uint64(0xA5A5A5A5DEADBEEF))
        place = np.repeat(first - part.offsets[texts], sizes[texts]) + (at := np.concatenate([np.arange(part.offsets[t], part.offsets[t + 1]) for t in texts.tolist()]))
        values[place] = part.hashes[at]
        start, length, period = find_runs(values, int(sizes[texts].max()), least)
        owner = np.searchsorted(first, start, "right") - 1
        out.append((texts[owner], start - first[owner], length, period))
    text, start, length, period = (np.concatenate([np.empty(0, np.int64), *[o[i] for o in out]]) for i in range(4))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _collapsed(part: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words of each text joined by one space, and the size of each text."""
    marks = np.zeros(len(part.hashes) + 1, np.int64)
    np.add.at(marks, part.offsets[text] + start + period, 1)
    np.add.at(marks, part.offsets[text] + start + length, -1)
    keep = np.cumsum(marks[:-1]) == 0
    kept = np.flatnonzero(keep)
    owner = np.searchsorted(part.offsets, kept, "right") - 1
    size = part.ends[kept] - part.starts[kept] + 1  # with the space before it
    to = np.cumsum(size) - size
    source = np.repeat(part.starts[kept] - 1 - to, size) + np.arange(int(size.sum()))
    out = part.data[np.maximum(source, 0)]
    out[to] = 0x20
    lead = np.diff(owner, prepend=-1) > 0  # no space before a text's first word
    out = np.delete(out, to[lead])
    each = np.bincount(owner, size, len(part.offsets) - 1).astype(np.int64)
    each[owner[lead]] -= 1
    return out, each


def periodic_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """Each row with n_words, runs and collapsed.

    Words end at white space [\\x20\\x09-\\x0D] and are compared as they are. A run is a stretch with a smallest period
    q, of ``least`` words and two periods or more, that no neighbouring word extends. runs: struct start (word number), length, period, in order of start and
    period. collapsed: the words without those that a run holds behind its first q words, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are judged one by one,
    so repeated rows get equal results. A text of any length is handled whole, in memory in proportion to its size. Other
    columns stay as they are; where one has the name of a new one, the new one gets underscores.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        counts, offsets, fields, sizes, pieces = [], [], [], [], []
        for part in words(texts, SPACED, lower=False):
            text, *found = _runs_of(part, least)
            fields.append(found)
            counts.append(np.diff(part.offsets))
            offsets.append(np.bincount(text, minlength=len(part.offsets) - 1))
            out, each = _collapsed(part, text, *found)
            pieces.append(out)
            sizes.append(each)
        if not counts:
            return [pa.array([], pa.int64()), pa.array([], KIND), pa.array([], pa.string())]
        ends = lambda n: np.append(0, np.cumsum(np.concatenate(n)))
        columns = [pa.array(np.concatenate([f[i] for f in fields])) for i in range(3)]
        runs = pa.ListArray.from_arrays(pa.array(ends(offsets).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(KIND.value_type)))
        places = pa.py_buffer(ends(sizes).astype(np.int32 if (short := sum(map(len, pieces)) < 1 << 31) else np.int64))
        data = [None, places, pa.py_buffer(np.concatenate(pieces))]
        text = (pa.StringArray if short else pa.LargeStringArray).from_buffers(len(texts), places, data[2])
        return [pa.array(np.concatenate(counts)), runs, text]

    return add_columns(docs, text_col, run, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


KIND = pa.list_(pa.struct([pa.field(n, pa.int64()) for n in ("start", "length", "period")]))
