"""Exact duplicates by an extendible-hash index that owner tasks build on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.cut import cut
from icuflow.llm.session import settings

#: Bytes of whole texts that a Python worker gets at once; it holds their normalised copies beside them.
BATCH_BYTES = 8 << 20
_WHITE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalise(text: bytes) -> bytes:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    text = text.translate(_WHITE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def hash_key(digest: bytes) -> int:
    """The 64 bits by which the index places a text: the beginning of its SHA-256."""
    return int.from_bytes(digest[:8], "big")


class Directory:
    """Directory of an extendible-hash table over the leading bits of a key.

    It begins as one bucket. A bucket above ``bucket_bytes`` splits by its next bit; when its
    local depth is the global one, the directory doubles first. Buckets at ``max_depth`` do not
    split further; their owner reads them as a sorted stream, so their size costs no memory.
    """

    def __init__(self, cells: np.ndarray, sizes: np.ndarray, bucket_bytes: int, max_depth: int):
        self.max_depth, self.depth = max_depth, 0
        self.entries = np.zeros(1, np.int64)
        self.local = [0]
        total = np.zeros((1 << max_depth) + 1, np.int64)
        np.add.at(total, cells + 1, sizes)
        total = np.cumsum(total)
        todo = [(0, 0)]  # bucket, first entry's leading bits at the bucket's own depth
        while todo:
            bucket, lead = todo.pop()
            depth = self.local[bucket]
            width = 1 << (max_depth - depth)
            if depth == max_depth or total[(lead + 1) * width] - total[lead * width] <= bucket_bytes:
                continue
            if depth == self.depth:
                self.entries, self.depth = np.repeat(self.entries, 2), self.depth + 1
            twin = len(self.local)
            self.local[bucket] = depth + 1
            self.local.append(depth + 1)
            span = 1 << (self.depth - depth - 1)
            self.entries[(2 * lead + 1) * span : (2 * lead + 2) * span] = twin
            todo += [(bucket, 2 * lead), (twin, 2 * lead + 1)]

    def bucket(self, key: int) -> int:
        """The bucket of a 64-bit key."""
        return int(self.entries[key >> (64 - self.depth)]) if self.depth else 0


def _distinct(batch: pa.RecordBatch) -> dict[bytes, list]:
    """The normalised texts of a batch, each with the ids of the rows that have it."""
    out: dict[bytes, list] = {}
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        out.setdefault(normalise(text.as_py() or b""), []).append(i)
    return out


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 8 << 20,
    max_depth: int = 16,
    key: Callable[[bytes], int] = hash_key,
) -> DataFrame:
    """The index as a stored table: bucket, key, slot, sha256, ids.

    A slot is the place of a text in the chain of the texts with its key. Pass one counts bytes by
    the first ``max_depth`` bits (at most 65,536 counts reach the driver) and makes the directory.
    In pass two each task joins the copies within its batches, the rows go to the owner of their
    bucket, sorted by key, and the owner walks the chain of each key and compares bytes. A group of
    copies costs its owner one row per batch, whatever its size. ``ids`` holds the rows of one batch.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shift = 64 - max_depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, int] = {}
        for batch in batches:
            for text in _distinct(batch):
                cell = key(hashlib.sha256(text).digest()) >> shift
                sizes[cell] = sizes.get(cell, 0) + len(text) + 64
        yield pa.RecordBatch.from_arrays([pa.array(sizes.keys(), pa.int32()), pa.array(sizes.values(), pa.int64())], names=["cell", "size"])

    with settings(docs.sparkSession, maxBytesPerBatch=BATCH_BYTES):
        cells = rows.mapInArrow(count, "cell int, size long").groupBy("cell").agg(F.sum("size").alias("size")).toPandas()
    directory = Directory(cells["cell"].to_numpy(np.int64), cells["size"].to_numpy(np.int64), bucket_bytes, max_depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _distinct(batch)
            digests = [hashlib.sha256(text).digest() for text in found]
            keys = [key(d) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([directory.bucket(k) for k in keys], pa.int32()),
                    pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(found.keys(), pa.binary()),
                    pa.array(found.values(), pa.list_(pa.int64())),
                ],
                names=["bucket", "key", "sha256", "text", "ids"],
            )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for batch in batches:
            slots = []
            for at, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if at != now:
                    now, chain = at, []
                slot = next((i for i, known in enumerate(chain) if known == text), len(chain))
                if slot == len(chain):
                    chain.append(text)
                slots.append(slot)
            columns = [batch.column("bucket"), batch.column("key"), pa.array(slots, pa.int32()), batch.column("sha256"), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "slot", "sha256", "ids"])

    placed = rows.mapInArrow(place, "bucket int, key long, sha256 binary, text binary, ids array<bigint>")
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "key")
    with settings(docs.sparkSession, maxBytesPerBatch=BATCH_BYTES):
        return cut(owned.mapInArrow(own, "bucket int, key long, slot int, sha256 binary, ids array<bigint>"), "dedup-index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (binary).

    Texts are equal when they are identical after ``normalise``; null counts as empty. Of equal texts
    the smallest doc_id stays. Rows without a doc_id count in their group and stay only if no row of it
    has one (keep_id is null then). Repeated rows of one doc_id and text share the verdict; ``unique``
    leaves one of them. An empty table gives no rows. Other columns are not read. ``index``: see build_index.
    """
    table = build_index(docs, id_col, text_col, **index)
    members = table.select("key", "slot", "sha256", F.explode("ids").alias("doc_id"))
    totals = members.groupBy("key", "slot").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return members.join(totals, ["key", "slot"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows of one doc_id and text, one."""
    kept = exact_groups(docs, id_col, text_col, **index).filter("kept")
    kept = kept.select(F.col("doc_id").alias("_keep"), F.lower(F.hex("text_sha256")).alias("_sha")).distinct()
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_text"), row)
    same = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_sha"))
    left = packed.join(kept, same, "left_semi").dropDuplicates(["_id", "_text"])
    return left.select("row.*")
