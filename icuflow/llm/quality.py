"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.functions.cut import cut
from icuflow.llm.text import SPACED, add_columns, byte_class, mix, words

WORD_BITS, SHAPE_BITS = 15, 12
SIZE = 2 * ((1 << WORD_BITS) + (1 << SHAPE_BITS))
PSEUDO = 50.0  # observations of "as common in the target as in the raw text" that each bucket begins with

_UPPER, _DIGIT = byte_class((0x41, 0x5A)), byte_class((0x30, 0x39))
_MARK = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_LOWER = ~(_UPPER | _DIGIT | _MARK)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept away from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _per_word(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)])
    return np.minimum(total[ends] - total[starts], most)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buckets, text of each bucket) for hashed n-grams of all words of all texts.

    Four kinds: words, pairs of words, shapes and pairs of shapes. A shape says how many capitals, other
    letters, digits and marks a word has, what mark ends it, and whether it repeats the word before.
    """
    for part in words(texts, SPACED, lower=False):
        h, n = part.hashes, len(part.hashes)
        if not n:
            yield part.first, np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        base, stop = int(part.starts[0]), int(part.ends[-1])
        data, starts, ends = part.data[base:stop], part.starts - base, part.ends - base
        text = np.searchsorted(part.offsets, np.arange(n), "right") - 1
        follows = np.zeros(n, bool)
        follows[1:] = text[1:] == text[:-1]
        before = np.concatenate([h[:1], h[:-1]])
        same = follows & (h == before)
        shape = _per_word(_UPPER[data], starts, ends, 2)
        for table, most in ((_LOWER, 1), (_DIGIT, 2), (_MARK, 3)):
            shape = shape * (most + 1) + _per_word(table[data], starts, ends, most)
        final = data[ends - 1]
        shape = mix((shape * 512 + np.where(_MARK[final], final, 0) * 2 + same).astype(np.uint64))
        shape_before = np.where(follows, np.concatenate([shape[:1], shape[:-1]]), np.uint64(0))
        pair = mix(h * np.uint64(3) + np.where(follows, before, np.uint64(0)))
        w, s = np.uint64((1 << WORD_BITS) - 1), np.uint64((1 << SHAPE_BITS) - 1)
        buckets = [h & w, (pair & w) + (w + np.uint64(1)), (shape & s) + np.uint64(2 << WORD_BITS)]
        buckets.append((mix(shape * np.uint64(3) + shape_before) & s) + np.uint64((2 << WORD_BITS) + (1 << SHAPE_BITS)))
        yield part.first, np.concatenate(buckets).astype(np.int64), np.tile(text, 4)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_target: int) -> tuple[np.ndarray, float]:
    """Log ratio of target to raw for each bucket, and the target's share of the labelled documents.

    The raw counts cover every document. The target model is fitted on at most ``max_target`` documents
    labelled 1, chosen by a hash of their id, so their ids can be broadcast. Held-out documents and null
    labels teach nothing. Without labelled documents all ratios are 0 and the share is 1.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    share = known.agg(F.avg("label")).first()[0]
    target = known.filter("label = 1").select("id").distinct().orderBy(F.xxhash64("id", F.lit(17)), "id").limit(max_target)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(target.withColumn("target", F.lit(True))), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            chosen = np.array(batch.column(1).to_pylist(), bool)
            for first, buckets, text in features(batch.column(0)):
                total[0] += np.bincount(buckets, minlength=SIZE)
                total[1] += np.bincount(buckets[chosen[first + text]], minlength=SIZE)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    counts = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, wanted = np.zeros(SIZE), np.zeros(SIZE)
    raw[counts["bucket"]], wanted[counts["bucket"]] = counts["raw"], counts["target"]
    if not wanted.sum():
        return np.zeros(SIZE), 1.0
    return np.log((wanted + PSEUDO) / (raw * (wanted.sum() / raw.sum()) + PSEUDO)), float(share)


def top_k(rows: DataFrame, key: str, k: int, bins: int = 1024) -> float:
    """The k-th largest key, exactly: counts in ever narrower ranges, never more than ``bins`` of them here."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        inside = rows.filter(F.col(key).between(low, high))
        width = (high - low) / bins
        if not width or low + width == low:
            return low
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        above = 0
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                k -= above
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_target: int = 20_000,
    seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, log_weight, key, selected.

    log_weight is the log ratio of the hashed n-gram models of target and raw text, summed over the whole
    text. With the target's share s of labelled documents, a document is target-like with probability
    min(1, s * weight); k is the sum of these. The k documents with the largest key, log_weight plus Gumbel
    noise made from the id, are selected: a sample without replacement in proportion to the weights.
    Null texts and texts without words tell nothing: log_weight is null and they are never selected.
    Repeated rows of one id share noise and verdict, so ties at the limit are selected together; rows
    without id have noise 0. Documents without a label are scored like others. An empty table gives no
    rows; without labels every text with words is selected. A text of any length is read whole.
    """
    score, share = _scorer(docs, fit(docs, labels, id_col, text_col, label_col, max_target))
    scored = _stored_scores(docs, score, id_col, text_col, seed)
    limit = _limit(scored, share)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "log_weight", "key", F.coalesce(F.col("key") >= limit, F.lit(False)).alias("selected"))


def chosen(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_target: int = 20_000,
    seed: int = 1,
) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, with all their columns.

    A row is judged by its own id and text, so rows without id or with the id of another text do not share
    its verdict. Texts are scored once for the limit and once to filter; nothing is joined or shuffled. Null
    texts and texts without words go. A text of any length is read whole. An empty table gives no rows.
    """
    score, share = _scorer(docs, fit(docs, labels, id_col, text_col, label_col, max_target))
    limit = _limit(_stored_scores(docs, score, id_col, text_col, seed), share)
    scored = add_columns(docs, text_col, score, "log_weight double")
    key = F.col(scored.columns[-1]) + _noise(F.col(f"`{id_col}`"), seed)
    return scored.filter(key >= limit).select(*[F.col(f"`{c}`") for c in docs.columns])


def _scorer(docs: DataFrame, model: tuple[np.ndarray, float]) -> tuple[Callable, float]:
    """What ``add_columns`` calls for the log weights of texts, and the target's share."""
    ratio, share = model
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(texts: pa.Array) -> list:
        out = np.zeros(len(texts))
        seen = np.zeros(len(texts), np.int64)
        for first, buckets, text in features(texts):
            if len(text):
                sums = np.bincount(text, shared.value[buckets])
                out[first : first + len(sums)] += sums
                seen[first : first + len(sums)] += np.bincount(text)
        return [pa.array(out, mask=seen == 0)]

    return score, share


def _noise(id_col: Column, seed: int) -> Column:
    uniform = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(id_col.isNull(), F.lit(0.0)).otherwise(-F.log(-F.log(uniform)))


def _stored_scores(docs: DataFrame, score: Callable, id_col: str, text_col: str, seed: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = add_columns(rows, "text", score, "log_weight double")
    return cut(scored.select("doc_id", "log_weight", (F.col("log_weight") + _noise(F.col("doc_id"), seed)).alias("key")), "quality")


def _limit(scored: DataFrame, share: float) -> float:
    """The smallest key that is selected."""
    weighed = scored.filter("key IS NOT NULL")
    accepted = F.sum(F.least(F.lit(1.0), F.exp(F.least(F.col("log_weight"), F.lit(50.0))) * share))
    k = round(weighed.agg(accepted).first()[0] or 0)
    return top_k(weighed, "key", k) if k else float("inf")
