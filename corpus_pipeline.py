"""A training corpus from raw documents: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage works on all rows that the one before kept; what it returns is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.functions.cut import cut
from icuflow.llm import bpe, decontamination, exact_dedup, jaccard_join, quality
from icuflow.llm.queries import table, tokenizer_path
from icuflow.llm.session import lean_workers, prepare
from icuflow.llm.text import fresh


def _prepare(spark: SparkSession) -> None:
    prepare(spark)
    lean_workers(spark)


def _row_key() -> Column:
    """A row's id and text as bytes, ordered by id; rows without id come last.

    Rows that lack an id or share one are still told apart by the SHA-256 of their text.
    """
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    place = F.coalesce(F.concat(F.lit("00"), number), F.lit("01"))
    return F.unhex(F.concat(place, F.sha2(F.coalesce("text", F.lit("")), 256)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality sample selects. Texts without words go."""
    _prepare(spark)
    return quality.chosen(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id; of repeated rows, one."""
    _prepare(spark)
    return exact_dedup.unique(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (similarity 0.8 or more), the one with the smallest doc_id.

    A document without id stays only if none of its group has one; among those, and among different texts
    under one id, the smallest SHA-256 decides. Documents without words are in no group and stay.
    """
    _prepare(spark)
    (key,) = fresh(docs, "_row")
    keyed = docs.withColumn(key, _row_key())
    found = jaccard_join.similar(keyed, jaccard_join.Rule(5, 80, 100), key)
    kept = found.filter("component_id = doc_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    _prepare(spark)
    marked, (_, spans, _) = decontamination.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size(F.col(f"`{spans}`")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers), and whether decoding gives the text again."""
    _prepare(spark)
    path = tokenizer_path()
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    return coded.select("doc_id", "n_tokens", "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding and decoding", token_stage),
]

#: Classifier and encoder have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, one after the other; each result is written and read again."""
    _prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
