"""Spelling variants: words one edit apart, found by dynamic programming over sorted word lists."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.cut import cut

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # UTF-8 of [a-zÀ-ÿ]


def typed(run: bytes, seed: int, every: int) -> str:
    """A lower-cased run as its document has it: one code point less where ``every`` divides its hash."""
    h = zlib.crc32(run, seed)
    word = run.decode()
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least: int = 7, every: int = 31, held: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n for the words of all texts with ``least`` code points or more; a null text has none, a null id is the empty string.

    A task adds up at most ``held`` words before it hands them on, so frequent words cross the shuffle a few times per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{'' if i.as_py() is None else i.as_py()}:".encode())
                data = bytes(text.as_buffer()).lower()
                for raw, n in Counter(m.group() for m in _RUN.finditer(data)).items():
                    if len(raw) >= least:
                        word = typed(raw, seed, every)
                        if len(word) >= least:
                            total[word] += n
                if len(total) >= held:
                    yield flush()
        yield flush()

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _prefixed(words: list[bytes], prefix: bytes) -> tuple[int, int]:
    """The range of a sorted list whose words begin with the prefix."""
    stem = prefix.rstrip(b"\xff")
    end = bisect_left(words, stem[:-1] + bytes([stem[-1] + 1])) if stem else len(words)
    return bisect_left(words, prefix), end


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters in a row, where each word begins, and its length."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(size) - size, size


def _lcps(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The common prefix of each word with the one before; 0 for the first."""
    out = np.zeros(len(size), np.int64)
    live, j = np.arange(1, len(size)), 0
    while len(live):
        live = live[(size[live] > j) & (size[live - 1] > j)]
        live = live[flat[start[live] + j] == flat[start[live - 1] + j]]
        j += 1
        out[live] = j
    return out


def _step(row: np.ndarray, letter: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The next row of the banded edit matrices of many words at once; the band is one cell either side of the diagonal.

    row: cells of query letters j - 1, j and j + 1 against j list letters. letter: list letter j.
    around: query letters j - 1, j and j + 1; 0, which no word has, beyond its ends.
    """
    unlike = around != letter
    out = row + unlike
    out[0] = np.minimum(out[0], row[1] + 1)
    out[1] = np.minimum(np.minimum(out[1], row[2] + 1), out[0] + 1)
    out[2] = np.minimum(out[2], out[1] + 1)
    return np.minimum(out, 2)


def one_edit(words: list[bytes], asked: list[bytes], shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers with an edit distance of exactly one that have at least ``shared`` first letters in common.

    ``words`` is a sorted list. Ranges of it with a common prefix are scanned letter by letter for all queries at
    once: adjacent LCPs tell where a range falls apart, its parts go on from the row of their common prefix, and
    a part whose prefix is more than one edit away is skipped whole.
    """
    flat, start, size = _flat(words)
    qflat, qstart, qsize = _flat(asked)
    lcp = _lcps(flat, start, size)
    depth = np.array(shared, np.int64)
    low, high = np.array([_prefixed(words, q[:h]) for q, h in zip(asked, shared, strict=True)], np.int64).reshape(-1, 2).T
    hits = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    waiting = np.flatnonzero(high > low)
    query = lo = hi = np.empty(0, np.int64)
    row = np.empty((3, 0), np.int64)
    j = int(depth[waiting].min()) if len(waiting) else 0
    while len(query) or len(waiting):
        new = waiting[depth[waiting] == j]
        waiting = waiting[depth[waiting] != j]
        query, lo, hi = np.append(query, new), np.append(lo, low[new]), np.append(hi, high[new])
        row = np.concatenate([row, np.tile(np.array([[1], [0], [1]]), len(new))], axis=1)
        # Words that end here come first in their range; only the first can, since words are distinct.
        ends = size[lo] == j
        off = qsize[query] - j + 1
        there = np.flatnonzero(ends & (off >= 0) & (off <= 2))
        there = there[row[off[there], there] == 1]
        hits.append((query[there], lo[there]))
        lo = lo + ends
        parts, breaks = [], np.append(np.flatnonzero(lcp <= j), len(words))
        keep = np.flatnonzero(lo < hi)
        query, lo, hi, row = query[keep], lo[keep], hi[keep], row[:, keep]
        letters = j + np.arange(-1, 2)[:, None]
        inside = (letters >= 0) & (letters < qsize[query])
        around = np.where(inside, qflat[np.where(inside, qstart[query] + letters, 0)], 0)
        while len(query):
            end = np.minimum(breaks[np.searchsorted(breaks, lo, "right")], hi)
            made = _step(row, flat[start[lo] + j], around)
            live = np.flatnonzero(made.min(axis=0) <= 1)
            parts.append((query[live], lo[live], end[live], made[:, live]))
            keep = np.flatnonzero(end < hi)
            query, lo, hi, row, around = query[keep], end[keep], hi[keep], row[:, keep], around[:, keep]
        if parts:
            query, lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(3))
            row = np.concatenate([p[3] for p in parts], axis=1)
        j += 1
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _alive(query: bytes, prefix: bytes) -> bool:
    """Whether words with this prefix can be within one edit of the query."""
    row = np.array([[2], [0], [1]])
    for j, c in enumerate(prefix):
        around = np.array([[query[i] if 0 <= i < len(query) else 0] for i in (j - 1, j, j + 1)])
        row = _step(row, np.array([c]), around)
        if row.min() > 1:
            return False
    return True


def _common(a: bytes, b: bytes) -> bytes:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def _near_by_block(words: DataFrame, backward: bool, block: int) -> DataFrame:
    """word, n_near, best: from one sorted list, the nearby words of every word.

    Forward, those that share the first half of its letters; backward, on reversed words, those that share
    the other half and not the first. Together they are all words at one edit, each once. The list is cut into ranges of about
    ``block`` words. A word visits the ranges that hold its shared half, unless the common prefix of a range's
    words is more than one edit away; of a range only the first and last word go through the driver.
    """
    spark = words.sparkSession
    n_blocks = max(1, -(-words.count() // block))
    listed = words.select((F.reverse("word") if backward else F.col("word")).alias("word"), "n")
    listed = listed.repartitionByRange(n_blocks, "word").sortWithinPartitions("word")
    listed = cut(listed.withColumn("place", F.spark_partition_id()), "sorted-words")
    ends = listed.groupBy("place").agg(F.min("word").alias("first"), F.max("word").alias("last")).orderBy("first").collect()
    edges = [(r["place"], r["first"].encode("latin-1"), r["last"].encode("latin-1")) for r in ends]

    def half(word: bytes) -> int:
        return len(word) - len(word) // 2 if backward else len(word) // 2

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, heads = [e[1] for e in edges], [e[2] for e in edges], [_common(e[1], e[2]) for e in edges]
        for batch in batches:
            places, out = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                raw = word.encode("latin-1")
                prefix = raw[: half(raw)]
                for e in range(bisect_left(lasts, prefix), _prefixed(firsts, prefix)[1]):
                    if edges[e][1] <= raw <= edges[e][2]:
                        continue  # in its own range it is in the list
                    if len(heads[e]) <= len(prefix) or _alive(raw, heads[e]):
                        places.append(edges[e][0])
                        out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64())), pa.array(places, pa.int32())], names=["word", "place"])

    guests = listed.select("word").mapInArrow(visit, "word string, place int")
    both = listed.select("place", "word", "n").unionByName(guests.select("place", "word", F.lit(None).cast("long").alias("n")))
    both = both.repartition(n_blocks, "place").sortWithinPartitions("place", F.col("n").isNull(), "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts, asked = None, [], [], []
        for batch in batches:
            for place, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = word.encode("latin-1")
                if place != now or len(asked) >= 2 * block:
                    yield _found(held, counts, asked, half, backward)
                    asked = []
                    if place != now:
                        now, held, counts = place, [], []
                if n is not None:
                    held.append(raw)
                    counts.append(n)
                asked.append(raw)
        yield _found(held, counts, asked, half, backward)

    return both.mapInArrow(search, "word string, n_near long, best_n long, best string")


def _found(words: list[bytes], counts: list[int], asked: list[bytes], half, backward: bool) -> pa.RecordBatch:
    """For each query with nearby words in the list: their number, the largest count, and the smallest word that has it."""
    query, hit = one_edit(words, asked, [half(q) for q in asked])
    turned = [w[::-1] for w in words] if backward else words
    if backward:
        mine = [q[::-1] for q in asked]
        fresh = [not turned[v].startswith(mine[q][: len(mine[q]) // 2]) for q, v in zip(query.tolist(), hit.tolist(), strict=True)]
        query, hit = query[fresh], hit[fresh]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=turned.__getitem__)] = np.arange(len(words))
    n = np.array(counts, np.int64)
    order = np.lexsort((rank[hit], -n[hit], query))
    query, hit = query[order], hit[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    number = np.diff(np.append(first, len(query)))
    names = [asked[q][::-1] if backward else asked[q] for q in query[first].tolist()]
    columns = [
        pa.array([w.decode("latin-1") for w in names], pa.string()),
        pa.array(number, pa.int64()),
        pa.array(n[hit[first]], pa.int64()),
        pa.array([turned[v].decode("latin-1") for v in hit[first].tolist()], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def nearby(words: DataFrame, block: int = 20_000) -> DataFrame:
    """word, n, n_near, form, form_n candidates: every word with the number of words at one edit and the most frequent of them."""
    found = _near_by_block(words, False, block).unionByName(_near_by_block(words, True, block))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    joined = words.join(found, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.best").alias("best"), (-F.col("best.less")).alias("best_n"))


def variants(docs: DataFrame, least: int = 7, support: int = 2, times: int = 10, every: int = 31, block: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the lower-cased (A-Z only) runs of letters of all texts, one code point less where ``every`` divides the
    crc32 of ``<doc_id>:<run>``, with ``least`` code points and ``support`` occurrences or more. Two are near at
    one inserted, deleted or replaced code point. form is the near word of largest n (ties: smallest), if that is at least
    ``times`` (above 1) the word's n. root is the end of the chain of forms, the word itself without one.

    Null and empty texts have no words; a null id counts as the empty string; repeated rows count again. Of a
    text of any length only its distinct runs are held. An empty table gives no rows. Other columns are not read.
    """
    words = cut(word_counts(docs, least, every, id_col=id_col, text_col=text_col).filter(F.col("n") >= support), "words")
    near = nearby(words, block)
    chosen = F.col("best_n") >= F.col("n") * times
    near = cut(near.select("word", "n", "n_near", F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "near")
    # n grows at least ``times``-fold along a chain, so a few doublings reach every end.
    links = cut(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return near.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
