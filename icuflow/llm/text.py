"""Words of whole texts as arrays: found and hashed for many texts at once with numpy.

Texts come as Arrow strings. They are handled in pieces of about ``PIECE`` bytes; a
longer text is cut between words, so memory beyond the text itself stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE = 1 << 20
_R = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: 1 - r keeps all but one bit
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes of the ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words that end at white space [\x20\x09-\x0D].
SPACED = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: Bytes of words of ASCII letters, digits and all characters beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _VALUES[_LOWER]


def text_values(data: np.ndarray) -> np.ndarray:
    """The 64-bit values of bytes, A-Z lowered, that make up the hashes of words."""
    return _LOWER_VALUES[data]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for n places at least."""
    if len(_POW[0]) < n:
        n = max(n, PIECE + 1)
        _POW[:] = [_powers(_R, n), _powers(pow(_R, -1, 1 << 64), n)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of a sequence of 64-bit values, equal for equal content."""
    up, down = powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 places where its texts begin; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind, n = (np.int64, 8) if wide else (np.int32, 4)
    _, places, data = texts.buffers()
    if places is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, kind, len(texts) + 1, texts.offset * n).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + len(offsets) - 2`` of a batch.

    hashes, starts, ends: per word; places are bytes from the beginning of ``data``.
    offsets: for each text the number of its first word, and the total at the end.
    text_starts: the first byte of each text.
    """

    first: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    text_starts: np.ndarray


def _find(data: np.ndarray, begin: int, end: int, rows: np.ndarray, inside: np.ndarray, lower: bool):
    """Hashes and places of the words in data[begin:end]; a text begins at each place of rows."""
    piece = data[begin:end]
    flags = inside[piece]
    starts, ends = flags.copy(), flags.copy()
    starts[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    cuts = rows[(rows > begin) & (rows < end)] - begin
    starts[cuts] = flags[cuts]
    ends[cuts - 1] = flags[cuts - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return range_hashes((_LOWER_VALUES if lower else _VALUES)[piece], a, b), a + begin, b + begin


def _cuts(data: np.ndarray, begin: int, end: int, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of one long text, cut between words; a word longer than a piece stays whole."""
    while end - begin > PIECE:
        at, size = begin + PIECE, 4096
        while at < end:
            gaps = np.flatnonzero(~inside[data[at : min(at + size, end)]])
            if len(gaps):
                at += int(gaps[0])
                break
            at += size
        at = min(at, end)
        yield begin, at
        begin = at
    if end > begin:
        yield begin, end


def words(texts: pa.Array, inside: np.ndarray = SPACED, lower: bool = True) -> Iterator[Words]:
    """The words of all texts of a batch: maximal runs of the bytes in ``inside``, A-Z lowered for the hash."""
    data, at = buffers(texts)
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        last = min(last, n)
        if at[last] - at[row] > PIECE:
            parts = [_find(data, a, b, at[row:row], inside, lower) for a, b in _cuts(data, int(at[row]), int(at[last]), inside)]
            found = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            found = _find(data, int(at[row]), int(at[last]), at[row : last + 1], inside, lower)
        yield Words(row, *found, np.searchsorted(found[1], at[row : last + 1]), data, at[row:last])
        row = last


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; a shorter text is one run, no words give none."""
    n = len(hashes)
    k = min(k, n)
    if not k:
        return np.empty(0, np.uint64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(_R) + hashes[j : n - k + 1 + j]
    return mix(total + np.uint64(k))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have, one for each wished name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(df: DataFrame, text_col: str, fn: Callable, schema: str) -> DataFrame:
    """Each row with further columns that ``fn`` makes from the batch's texts.

    fn(texts) returns one Arrow array or list per field of ``schema``; fields whose name the
    frame has already get underscores behind it. No shuffle, batches are handled one by one.
    """
    fields = T.StructType.fromDDL(schema).fields
    names = fresh(df, *[f.name for f in fields])
    out = T.StructType(list(df.schema.fields) + [T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            made = fn(batch.column(place))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=[*batch.schema.names, *names])

    return df.mapInArrow(run, out)
