"""Shared helpers of the training-data operators: written intermediates, skew-safe lookups, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.session import scratch_dir


def find_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a local master in any working folder).

    On a cluster the package is shipped as usual (``--py-files`` or an installed wheel); the entry is then unused.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    find_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_fold(buckets: int) -> Column:
    """crc32 of the doc_id as text, modulo ``buckets``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(buckets))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (cuts the lineage)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows: what is made of a piece's texts is small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_skewed(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int,
                  share: int = 1000) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` that is unique on ``keys``, safe against hot keys.

    ``weight`` is the table's number of ``rows`` per key.  Keys that hold at
    least 1/``share`` of all ``total`` rows (so at most ``share`` of them:
    the bound of the broadcast) join map-side; the rest joins by a shuffle in
    which no key is large, also where the written table is small enough for
    Spark to broadcast: its rows take several times their place on disk.
    """
    floor = max(1, -(-total // share))
    hot = F.broadcast(table.filter(F.col(weight) >= floor))
    cold = table.filter(F.col(weight) < floor)
    return (rows.join(hot, keys)
            .unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold.hint("merge"), keys)))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``links(a, b)`` -> ``(node, comp)``, comp = smallest node of it.

    Minimum labels travel along the links and jump over labels of labels, so
    a chain of n nodes settles in about log n rounds.  Every round is a
    written table; only a count of changed labels reaches the driver.  Nodes
    without a link are not returned.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                   "cc-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("comp")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"),
                                               F.least("comp", "m").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        labels = written(low.join(up, "mid", "left")
                         .select("node", F.coalesce(F.least("mid", "top"), "mid").alias("comp"), "old"), "cc-labels")
        if labels.filter("comp <> old").limit(1).count() == 0:
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
    raise RuntimeError("components did not settle")
