"""From raw documents to training sequences: five stages, each one operator of ``tremorlake.llm``.

A stage takes ``(spark, docs, sf_dir)`` and works on all documents that its
predecessor kept; its result is written as Parquet and read again.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import decontam, langid, line_dedup, packing, simhash
from tremorlake.llm.common import documents, id_fold, written


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; ``n_chars`` follows the text."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are NULL, hold no letter or no language's n-grams go.

    Learns from three quarters of the ids; if nothing could be learned, all texts with letters stay.
    """
    model = langid.learn(docs.filter(id_fold(4) != 2))
    names = [f"__stage_{i}" for i in range(len(docs.columns))]  # no column of the stage is named like a new one
    judged = langid.identify(docs.toDF(*names), model, names, known=True, text=names[docs.columns.index("text")])
    return judged.filter("known").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first that holds them."""
    return _as_before(line_dedup.line_dedup(docs, min_chars=10), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten benchmark words or whole short items are cut; documents that are mostly benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_before(decontam.decontaminate(docs, items, window=10, max_coverage=0.5), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their token ids."""
    return packing.pack(docs, packing.tokenizer_path(), capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: SimHash, tokenising and the language filters are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
