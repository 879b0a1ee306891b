"""Exact Jaccard self-join on word n-grams by T-occurrence search over inverted lists."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.cut import cut
from icuflow.llm.components import components
from icuflow.llm.session import settings
from icuflow.llm.text import SPACED, mix, shingles, words

_BITS = 22
ROUNDS = 2
PART_BYTES = 8 << 20
#: What a Python worker holds at once: rows of whole texts, and bytes.
_BATCHES = {"maxRecordsPerBatch": 1000, "maxBytesPerBatch": 8 << 20}


@dataclass(frozen=True)
class Rule:
    """Sets of ``words`` words link when den * intersection >= num * union.

    short: classes in a short inverted list, at most. least_slack: long lists that a document may have, at
    least, before its short lists no longer suffice. Results do not depend on either.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    short: int = 32
    least_slack: int = 48

    def overlap(self, n: int) -> int:
        """The least overlap of a set of n shingles with any partner; the size of its smallest partner too."""
        return -(-n * self.num // self.den)

    def slack(self, n: int) -> int:
        """How many tokens of its prefix a set of n shingles at least shares with the prefix of any partner.

        Of p = n - overlap + 1 tokens one is shared, and one more of each token beyond; rounding can cost one.
        """
        p = n - self.overlap(n) + 1
        return min(n - p, max(self.least_slack, -(-p // 2)))

    def prefix(self, n: int) -> int:
        """Tokens by which a set of n shingles is indexed."""
        return n - self.overlap(n) + 1 + self.slack(n)

    def slack_sql(self) -> str:
        p = f"(n - (n * {self.num} + {self.den - 1}) div {self.den} + 1)"
        return f"least(n - {p}, greatest({self.least_slack}, ({p} + 1) div 2))"

    def sizes_fit(self, m: str) -> str:
        return f"{self.den} * least(n, {m}) >= {self.num} * greatest(n, {m})"


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    for part in words(texts, SPACED):
        for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
            yield np.unique(shingles(part.hashes[a:b], k))


def fingerprint(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    spread = mix(tokens)
    return (np.sum(spread).tobytes() + np.sum(mix(spread ^ np.uint64(0x5851F42D4C957F2D))).tobytes()) if len(tokens) else b""


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Stored rows fp, n, ids, prefix: one per distinct set of a batch, with the ids of the rows that have it."""
    kind = docs.schema["id"].dataType.simpleString()
    ids = pa.list_(pa.binary() if kind == "binary" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, tuple[int, list, np.ndarray]] = {}
            for i, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), rule.words), strict=True):
                fp, n = fingerprint(tokens), len(tokens)
                if fp not in found:
                    found[fp] = n, [], tokens[: rule.prefix(n) if n else 0].view(np.int64).copy()
                found[fp][1].append(i)
            columns = [list(found), [x[0] for x in found.values()], [x[1] for x in found.values()], [x[2] for x in found.values()]]
            kinds = [pa.binary(), pa.int64(), ids, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["fp", "n", "ids", "prefix"])

    return cut(docs.mapInArrow(run, f"fp binary, n long, ids array<{kind}>, prefix array<bigint>"), "sets")


class _Lists:
    """Inverted lists from posts (token, key, n) in token order; at most ``rule.short`` posts of one token are held at a time."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.held = np.empty((3, 0), np.int64)
        self.long: int | None = None  # the token of a long list that may go on

    def add(self, rows: np.ndarray, end: bool) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([self.held, rows], axis=1)
        if self.long is not None:
            more = int(np.searchsorted(rows[0], self.long, "right"))
            yield self._batch(*rows[:, :more], [None] * more)
            rows = rows[:, more:]
        if not rows.shape[1]:
            self.held = rows
            return
        starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0][0] - 1))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        self.long, self.held = None, rows[:, :0]
        if not end and sizes[-1] <= self.rule.short:
            self.held, starts, sizes = rows[:, starts[-1] :], starts[:-1], sizes[:-1]
        elif sizes[-1] > self.rule.short:
            self.long = int(rows[0][-1])
        token, key, n = rows
        for s, m in zip(starts[sizes > self.rule.short].tolist(), sizes[sizes > self.rule.short].tolist(), strict=True):
            yield self._batch(token[s : s + m], key[s : s + m], n[s : s + m], [None] * m)
        short = (sizes > 1) & (sizes <= self.rule.short)
        at, partners = [], []
        for s, m in zip(starts[short].tolist(), sizes[short].tolist(), strict=True):
            for i in range(s + 1, s + m):
                low = s + int(np.searchsorted(n[s:i], self.rule.overlap(int(n[i]))))
                if low < i:
                    at.append(i)
                    partners.append(np.sort(key[low:i]))
        yield self._batch(token[at], key[at], n[at], partners)

    @staticmethod
    def _batch(token, key, n, partners) -> pa.RecordBatch:
        columns = [pa.array(token, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(partners, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["token", "key", "n", "partners"])


def _index(classes: DataFrame, rule: Rule) -> DataFrame:
    """Stored inverted lists: rows token, key, n, partners.

    Of a short list (2 to ``rule.short`` classes), each class gets the classes before it, by size and key, that are
    large enough to be its partners. Of a long list each class gets a row with null partners. Lists of
    one class are left out.
    """
    posts = classes.select(F.explode("prefix").alias("token"), "key", "n").repartition("token").sortWithinPartitions("token", "n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(rule)
        for batch in batches:
            yield from lists.add(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]), False)
        yield from lists.add(np.empty((3, 0), np.int64), True)

    return cut(posts.mapInArrow(run, "token long, key long, n long, partners array<bigint>"), "lists")


def merge_lists(lists: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
    """(partner, lists that hold it) for the partners in at least ``least`` of the sorted lists, by a heap."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        partner, count = heap[0][0], 0
        while heap and heap[0][0] == partner:
            _, i, at = heap[0]
            count += 1
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        if count >= least:
            yield int(partner), count


def _search(lists: DataFrame, n_long: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs key, partner, shared from the short lists of each class.

    Partners share ``slack`` tokens of their prefixes at least; tokens whose lists are long are skipped
    here, so the rest must be met in the short lists, which a heap merges.
    """
    short = lists.filter("partners IS NOT NULL").join(n_long, "key", "left").select("key", "n", F.coalesce("n_long", F.lit(0)).alias("n_long"), "partners")
    grouped = short.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def merged():
            key, n, n_long = now
            least = rule.slack(n) - n_long
            return [(key, p, c) for p, c in merge_lists(held, max(1, least))]

        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[:3] != now:
                    if held:
                        out += merged()
                    now, held = row[:3], []
                held.append(row[3])
            yield _pairs(out)
        if held:
            yield _pairs(merged())

    return grouped.mapInArrow(run, "key long, partner long, shared long")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "partner", "shared"])


class _Texts:
    """Picks the documents that stand for some classes, before anything is shuffled.

    All that is broadcast is a table of 4 million bits by the hash of the documents' ids; documents that
    share a bit come along and are told apart by the fingerprint of their set.
    """

    def __init__(self, classes: DataFrame, keys: DataFrame, docs: DataFrame):
        place = F.pmod(F.xxhash64("rep"), F.lit(1 << _BITS))
        self.needed = cut(classes.select("key", "fp", "rep").join(keys.select("key").distinct(), "key"), "needed")
        bits = np.zeros(1 << _BITS, bool)
        bits[self.needed.select(place.alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)] = True
        self.bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
        self.rows = docs.select("text", F.pmod(F.xxhash64("id"), F.lit(1 << _BITS)).alias("place"))

    def map(self, fn, schema: str) -> DataFrame:
        """fn(texts) gives the rows of each batch of picked documents."""
        shared = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                yield fn(batch.filter(pa.array(bits[batch.column(1).to_numpy(zero_copy_only=False)])).column(0))

        return self.rows.mapInArrow(run, schema)


def _pack(text: pa.Scalar) -> bytes:
    return zlib.compress((text.as_py() or "").encode(), 1)


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The stored pairs (a, b) that link. Compressed texts travel; sets are made again where two meet, and the
    tokens of one are looked up in the other by binary search."""
    picked = _Texts(classes, pairs.select("key").unionByName(pairs.select(F.col("partner").alias("key"))), docs)

    def pack(texts: pa.Array) -> pa.RecordBatch:
        found = [fingerprint(x) for x in shingle_sets(texts, rule.words)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([_pack(t) for t in texts], pa.binary())], names=["fp", "packed"])

    packed = picked.map(pack, "fp binary, packed binary").join(picked.needed.select("key", "fp"), "fp")
    packed = cut(packed.groupBy("key").agg(F.first("packed").alias("packed")), "texts")
    left = packed.select("key", F.col("packed").alias("left"))
    right = packed.select(F.col("key").alias("partner"), F.col("packed").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                sides = [pa.array([zlib.decompress(v.as_py()).decode() for v in some.column(i)], pa.string()) for i in (2, 3)]
                for x, y in zip(*(shingle_sets(s, rule.words) for s in sides), strict=True):
                    keep.append(linked(x, y, rule))
            found = batch.select(["key", "partner"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=["a", "b"])

    joined = pairs.select("key", "partner").join(left, "key").join(right, "partner").select("key", "partner", "left", "right")
    return cut(joined.mapInArrow(compare, "a long, b long"), "links")


class Forest:
    """Which nodes are connected so far."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, node: int) -> int:
        while (up := self.above.get(node, node)) != node:
            self.above[node] = self.above.get(up, up)
            node = up
        return node

    def join(self, a: int, b: int) -> bool:
        """Connects two nodes; whether they were not connected before."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    """Whether two sets, as ordered tokens, are similar enough."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.count_nonzero(y[at] == x))
    return rule.den * common >= rule.num * (len(x) + len(y) - common)


def _against_all(keys: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule, block_bytes: int = 4 << 20) -> DataFrame:
    """The stored links (a, b) of some query classes with the components of all members (key, root).

    Sets of a block of queries are broadcast; each task counts the tokens that its members share with all of
    them. What leaves a task of about ``PART_BYTES`` of sets is a forest that connects the components it found linked,
    fewer rows than it has queries and members, however many links there are. The sets of all members are stored.
    """

    def tokens(texts: pa.Array) -> pa.RecordBatch:
        found = list(shingle_sets(texts, rule.words))
        return pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.binary()) for f in (fingerprint, np.ndarray.tobytes)], names=["fp", "tokens"])

    picked = _Texts(classes, members, docs)
    found = picked.map(tokens, "fp binary, tokens binary").join(picked.needed.select("key", "fp"), "fp").dropDuplicates(["fp"])
    everyone = cut(found.select("key", "tokens").join(members, "key"), "members")
    queries = everyone.join(keys, "key", "left_semi")
    n = -(-(queries.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // block_bytes)
    parts = -(-(everyone.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // PART_BYTES)
    everyone = everyone.coalesce(max(1, parts))
    out = []
    for i in range(n):
        block = queries.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i).select("key", "root", "tokens").collect()
        sets = [np.frombuffer(r["tokens"], np.uint64) for r in block]
        flat = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        shared = docs.sparkSession.sparkContext.broadcast((flat[order], owner, sizes, *(np.array([r[c] for r in block], np.int64) for c in ("key", "root"))))

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, owner, sizes, names, parts = shared.value
            forest = Forest()
            for batch in batches:
                met: set[tuple[int, int]] = set()
                for x, key, root in zip(batch.column("tokens"), batch.column("key").to_pylist(), batch.column("root").to_pylist(), strict=True):
                    x = np.frombuffer(x.as_buffer(), np.uint64)
                    low = np.searchsorted(flat, x, "left")
                    each = np.searchsorted(flat, x, "right") - low
                    same = owner[np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())]
                    common = np.bincount(same, minlength=len(sizes))
                    hit = (common > 0) & (names != key) & (rule.den * common >= rule.num * (len(x) + sizes - common))
                    met.update((q, root) for q in np.unique(parts[hit]).tolist())
                pairs = [p for p in sorted(met) if forest.join(*p)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        out.append(cut(everyone.mapInArrow(meet, "a long, b long"), "links"))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], "a long, b long")


def similar(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set is its distinct runs of ``rule.words`` words (white space ends a word, A-Z lowered); fewer
    words are one run. Two documents link when den * intersection >= num * union. component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have no set, link with nothing and keep
    their own id. Documents with equal sets are one class, so copies are never paired. Rows without id count in
    their class and get its component. Rows that repeat a doc_id stand for themselves. An empty table
    gives no rows. Other columns are not read. The id may be a number or binary, which is ordered by its bytes.

    1. Each class is indexed under its first tokens in hash order (``Rule.prefix``).
    2. Short lists are merged by a heap; long ones are skipped as long as partners must also meet in a short
       one (DivideSkip). Of its candidates each class first checks the one it shares most with.
    3. Classes with too many long lists take part in these too. In ``ROUNDS`` rounds each checks one pivot, the
       one that it shares most long lists with and is not connected with; groups of near copies grow together.
    4. Candidates of step 2 that are still in different components are all checked. Where a long list still
       holds several components, the classes outside its largest are compared with all classes of step 3.
       In a large group whose members differ by about as much as the rule allows these are most of its classes.
    """
    kind = "binary" if docs.schema[id_col].dataType.simpleString() == "binary" else "long"
    with settings(docs.sparkSession, **_BATCHES):
        return _similar(docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text")), rule)


def _similar(docs: DataFrame, rule: Rule) -> DataFrame:
    sets = _sets(docs, rule)
    grouped = sets.filter("n > 0").groupBy("fp").agg(F.min(F.array_min("ids")).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = cut(grouped.withColumn("key", F.monotonically_increasing_id()), "classes")
    lists = _index(classes, rule)

    n_long = lists.filter("partners IS NULL").groupBy("key", "n").agg(F.count(F.lit(1)).alias("n_long"))
    dense = n_long.filter(f"n_long >= {rule.slack_sql()}").select("key")
    candidates = cut(_search(lists, n_long.select("key", "n_long"), rule), "candidates")
    meeting = cut(lists.filter("partners IS NULL").select("token", "key", "n").join(dense, "key"), "meeting")

    def place(df: DataFrame, column: str) -> DataFrame:
        named = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
        return df.join(named, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))

    def pivots(seed: int) -> DataFrame:
        met = place(meeting, "key")
        first = met.groupBy("token").agg(F.min_by(F.struct("n", "key", "key_root"), F.xxhash64("key", F.lit(seed))).alias("first"))
        pairs = met.join(first, "token").filter(f"key_root <> first.key_root AND {rule.sizes_fit('first.n')}")
        return pairs.groupBy("key", F.col("first.key").alias("partner")).agg(F.count(F.lit(1)).alias("shared"))

    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    links, tried = [], []
    for seed in range(ROUNDS):
        proposed = pivots(seed) if seed else candidates.unionByName(pivots(seed))
        best = proposed.groupBy("key").agg(F.max_by("partner", F.struct("shared", -F.col("partner"))).alias("partner"))
        tried.append(cut(best, "best"))
        if tried[-1].isEmpty():
            break
        links.append(_verify(tried[-1], classes, docs, rule))
        roots = cut(components(reduce(DataFrame.unionByName, links)), "roots")

    rest = place(place(candidates.select("key", "partner"), "key"), "partner").filter("key_root <> partner_root").select("key", "partner")
    rest = cut(rest.join(tried[0], ["key", "partner"], "left_anti"), "rest")
    if not rest.isEmpty():
        links.append(_verify(rest, classes, docs, rule))
    parts = place(meeting, "key").groupBy("token", "key_root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("token").agg(F.max_by("key_root", F.struct("n", "key_root")).alias("largest"), F.count(F.lit(1)).alias("parts"))
    outside = place(meeting, "key").join(largest.filter("parts > 1"), "token").filter("key_root <> largest").select("key").distinct()
    outside = cut(outside, "outside")
    if not outside.isEmpty():
        members = place(meeting.select("key").distinct(), "key").withColumnRenamed("key_root", "root")
        links.append(_against_all(outside, members, classes, docs, rule))
    if links:
        roots = cut(components(reduce(DataFrame.unionByName, links)), "roots")

    keyed = place(classes.select("key", "fp", "rep"), "key")
    lowest = keyed.groupBy("key_root").agg(F.min("rep").alias("component_id"))
    named = keyed.join(lowest, "key_root").select("fp", "component_id")
    rows = sets.select("fp", "n", F.explode("ids").alias("doc_id")).join(named, "fp", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
