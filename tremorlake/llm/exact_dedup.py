"""Exact dedup: a persistent digest index, bucketed and sorted by SHA-256, extended by sort-merge anti-joins.

DataFrame functions only.  The index is a Spark table ``(digest binary,
keep_id long)``, bucketed and sorted by ``digest``: new data is reduced to its
distinct digests, anti-joined with the index (the index side needs no
exchange) and what is left is appended.  Digests that are already there keep
their first entry.

Defined results: a NULL text counts as empty; a NULL doc_id is kept only when
its whole group has NULL ids; rows repeating a (doc_id, text) count in
``group_size`` and share one decision, because a document is its doc_id;
other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import lookup_skewed, shuffle_width, table_name, written
from tremorlake.session import scratch_dir


#: Folder of an index, followed by its number of buckets; the 1 is the format.
FOLDER = "digests-1-buckets-"


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of every whole text, not normalised."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"))


def stored_buckets(spark: SparkSession, path: str) -> list[int]:
    """Bucket counts of the index folders below ``path`` (one, or none before the first use)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    names = [st.getPath().getName() for st in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix(FOLDER)) for n in names if n.startswith(FOLDER))


class DigestIndex:
    """Table of known digests at ``path``; reopening the path continues with what was appended before.

    The files lie in a folder whose name holds the format and the number of
    buckets, so an index is read with the buckets it was written with, whatever the
    session's settings.  ``buckets`` counts for a new index only; another
    number than the stored one, or two stored ones, is an error.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or scratch_dir(spark, "digest-index")).rstrip("/")
        stored = stored_buckets(spark, self.path)
        if len(stored) > 1 or stored and buckets not in (None, stored[0]):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored[0] if stored else buckets or shuffle_width(spark)
        self.table = table_name("digest_index")
        location = f"{self.path}/{FOLDER}{self.buckets}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> None:
        """Append the batch's digests the index lacks; of equal ones in the batch the largest doc_id is entered."""
        # written first: the join would else be moved below the grouping, and meet every copy of a text
        distinct = written(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digest-batch")
        fresh = distinct.join(self.read().hint("merge"), "digest", "left_anti")
        (fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)`` for every row; the largest doc_id of equal texts stays.

    The table is offered to the index in ``batches`` slices of doc_id, highest
    first, so the first entry of a digest is the one that stays.  With an
    index that already holds digests of earlier data, those entries win.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = written(digests(docs), "digests")
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    step = (high - low) / batches
    cuts = [high + 1, *(high - round(step * k) for k in range(1, batches)), None]
    for upper, lower in zip(cuts, cuts[1:]):
        part = F.col("doc_id") < upper
        if lower is None:
            part = part | F.col("doc_id").isNull()
        else:
            part = part & (F.col("doc_id") >= lower)
        index.add(rows.filter(part))
    groups = (rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
              .join(index.read().hint("merge"), "digest"))
    found = lookup_skewed(rows, groups, ["digest"], "group_size", total)
    return found.select("doc_id", "digest", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without the rows whose text an entry with another doc_id stands for (all columns kept)."""
    keep = exact_dedup(docs, index).filter("kept").select(F.col("doc_id").alias("__llm_id")).distinct()
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__llm_id")), "left_semi")
