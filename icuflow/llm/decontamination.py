"""Benchmark passages in documents, found by Wu-Manber search over words."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.text import ALNUM, add_columns, fresh, range_hashes, words

LANE = 512  # windows that one lane of the search covers


def _spelling(data: bytes) -> bytes:
    """The words of a piece of UTF-8 text, A-Z lowered, joined by spaces."""
    flags = ALNUM[np.frombuffer(data, np.uint8)]
    lowered = np.frombuffer(data.lower(), np.uint8)
    return b" ".join(np.where(flags, lowered, np.uint8(0x20)).tobytes().split())


@dataclass
class Group:
    """Patterns of one length in words, with the tables that search them.

    shift: by hash of a block of words, how far the window may move on; 0 where the block ends
    a pattern. buckets: by the same hash, the patterns that end with the block.
    """

    length: int
    spellings: list[bytes]
    items: list[list[int]]
    shift: np.ndarray
    buckets: dict[int, dict[int, int]]


@dataclass
class Patterns:
    names: list[str]
    groups: list[Group] = field(default_factory=list)


def _block(hashes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends with the word at each place."""
    out = hashes[ends]
    return out if size == 1 else out * np.uint64(0x9E3779B97F4A7C15) + hashes[ends - 1]


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return (block * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def compile_patterns(items: list[tuple[str, str]], window: int) -> Patterns:
    """Shift tables and suffix buckets of all windows of the items, by window length."""
    out = Patterns([i for i, _ in items])
    found: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
    for part in words(pa.array([t for _, t in items], pa.string()), ALNUM):
        for j in range(len(part.offsets) - 1):
            a, b = part.offsets[j], part.offsets[j + 1]
            size = int(min(window, b - a))
            for s in range(a, b - size + 1) if size else ():
                spelling = _spelling(part.data[part.starts[s] : part.ends[s + size - 1]].tobytes())
                _, owners = found.setdefault(size, {}).setdefault(spelling, (part.hashes[s : s + size], []))
                if part.first + j not in owners:
                    owners.append(part.first + j)
    for size, patterns in found.items():
        matrix = np.stack([h for h, _ in patterns.values()])
        whole = range_hashes(matrix.ravel(), np.arange(len(matrix)) * size, np.arange(1, len(matrix) + 1) * size)
        block = min(2, size)
        bits = max(10, int(np.ceil(np.log2(8 * matrix.size + 1))))
        shift = np.full(1 << bits, size - block + 1, np.int64)
        for end in range(block - 1, size):
            flat = np.arange(len(matrix)) * size + end
            np.minimum.at(shift, _slot(_block(matrix.ravel(), flat, block), bits), size - 1 - end)
        buckets: dict[int, dict[int, int]] = {}
        ends = np.arange(1, len(matrix) + 1) * size - 1
        for i, (slot, h) in enumerate(zip(_slot(_block(matrix.ravel(), ends, block), bits).tolist(), whole.tolist(), strict=True)):
            buckets.setdefault(slot, {})[h] = i
        out.groups.append(Group(size, list(patterns), [o for _, o in patterns.values()], shift, buckets))
    return out


def search(hashes: np.ndarray, offsets: np.ndarray, group: Group) -> list[tuple[int, int]]:
    """Places where a pattern of the group may begin, and the pattern's number.

    All lanes move together: each looks up the block at the end of its window, moves on by the
    shift, and notes the place where the shift is 0. Noted windows meet the suffix bucket's
    patterns by the hash of all their words. Windows lie within one text.
    """
    m, n = group.length, len(hashes)
    block, bits = min(2, m), int(np.log2(len(group.shift)))
    at = np.arange(m - 1, n, LANE)
    stop = np.minimum(at + LANE, n)
    noted = []
    while len(at):
        step = group.shift[_slot(_block(hashes, at, block), bits)]
        noted.append(at[step == 0])
        at = at + np.maximum(step, 1)
        go = at < stop
        at, stop = at[go], stop[go]
    ends = np.sort(np.concatenate(noted)) if noted else np.empty(0, np.int64)
    starts = ends - m + 1
    text = np.searchsorted(offsets, ends, "right") - 1
    starts = starts[starts >= offsets[text]]
    if not len(starts):
        return []
    slots = _slot(_block(hashes, starts + m - 1, block), bits).tolist()
    whole = range_hashes(hashes, starts, starts + m).tolist()
    found = ((s, group.buckets[slot].get(h)) for s, slot, h in zip(starts.tolist(), slots, whole, strict=True))
    return [(s, number) for s, number in found if number is not None]


def scan(texts: pa.Array, patterns: Patterns) -> tuple[list, list, list]:
    """For each text: number of words, hit spans as (first, last + 1) word, items found."""
    n_words, spans, items = [], [], []
    for part in words(texts, ALNUM):
        n = len(part.offsets) - 1
        edge = np.zeros(len(part.hashes) + 1, np.int64)
        found: dict[int, set[int]] = {}
        for group in patterns.groups:
            for s, number in search(part.hashes, part.offsets, group):
                piece = part.data[part.starts[s] : part.ends[s + group.length - 1]].tobytes()
                if _spelling(piece) == group.spellings[number]:
                    edge[s] += 1
                    edge[s + group.length] -= 1
                    found.setdefault(int(np.searchsorted(part.offsets, s, "right")) - 1, set()).update(group.items[number])
        hit = np.cumsum(edge) > 0
        for j in range(n):
            a, b = int(part.offsets[j]), int(part.offsets[j + 1])
            n_words.append(b - a)
            if j in found:
                flips = np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0))
                spans.append([(int(x), int(y)) for x, y in flips.reshape(-1, 2)])
            else:
                spans.append([])
            items.append([patterns.names[i] for i in found.get(j, ())])
    return n_words, spans, items


_FIELDS = "n_words bigint, spans array<array<int>>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size, each read and broadcast by itself."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(n, 1)))
    return [[tuple(r) for r in rows.filter(part == i).distinct().collect()] for i in range(n)]


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", benchmark_text: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> tuple[DataFrame, tuple[str, str, str]]:
    """All columns of ``docs`` with n_words, spans (hit words) and items, and the three names given to them.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Words are runs
    of ASCII letters, digits and characters beyond ASCII, A-Z lowered. Null and empty texts have no
    words and no hits; items without words, text or id are never found; repeated items count once;
    an empty benchmark finds nothing. The benchmark is searched in blocks of about ``block_bytes``,
    one after the other on the same rows, so what is broadcast at once is bounded. No shuffle.
    """
    names: list[str] = []
    kept = list(docs.columns)
    for block in _blocks(benchmark, item_col, benchmark_text, block_bytes) or [[]]:
        shared = docs.sparkSession.sparkContext.broadcast(compile_patterns(block, window))
        docs = add_columns(docs, text_col, lambda texts, shared=shared: scan(texts, shared.value), _FIELDS)
        names += docs.columns[len(kept) + len(names) :]
    counts, spans, items = names[0::3], names[1::3], names[2::3]
    if len(counts) == 1:
        return docs, (counts[0], spans[0], items[0])
    out = fresh(docs.select(*kept), "n_words", "spans", "items")
    whole = [F.col(f"`{c}`") for c in kept]
    all_spans, all_items = (F.array_distinct(F.concat(*[F.col(f"`{x}`") for x in c])) for c in (spans, items))
    return docs.select(*whole, F.col(counts[0]).alias(out[0]), all_spans.alias(out[1]), all_items.alias(out[2])), tuple(out)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, items; see ``mark``. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, _ = mark(rows, benchmark, "text", **options)
    return found.drop("text")


def n_hit(spans) -> F.Column:
    """How many words lie in the union of spans, which may overlap where blocks were joined."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(s, x):
        low = F.greatest(s["end"], x[0])
        return F.struct((s["n"] + F.greatest(x[1] - low, F.lit(0))).cast("long").alias("n"), F.greatest(s["end"], x[1]).alias("end"))

    return F.aggregate(F.array_sort(spans), empty, add, lambda s: s["n"])
