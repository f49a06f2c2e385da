"""Observation store: typed projection, replace, append and upsert by snapshots, full scan.

Layout under the store's folder::

    data/batch=<name>/obs_date=<day>/*.parquet     rows, one batch a write
    snapshots/<number>.json                        what a version consists of

A snapshot lists the batches of a version, the days of a batch that later
writes replaced, and the next surrogate id.  Batch and day are partition
columns, so a scan reads only the listed folders, replaced days are pruned
from the plan, and a date predicate prunes the rest.

A writer reads the latest snapshot, writes its batch, and commits by creating
the next snapshot's file, which fails if another writer was first
(``StoreConflict``: nothing of the loser's stays, and it may try again).  The
creation is a rename without overwriting: atomic on HDFS; a local file system
checks for the file first.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake import constants as K
from tremorlake.session import scratch_dir

STRING_FIELDS, DOUBLE_FIELDS = K.STORE_STRING_FIELDS, K.STORE_DOUBLE_FIELDS
FIELDS = ["timestamp", *STRING_FIELDS, *DOUBLE_FIELDS]
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("created_at", T.TimestampNTZType()),
     T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(c, T.StringType()) for c in STRING_FIELDS],
     *[T.StructField(c, T.DoubleType()) for c in DOUBLE_FIELDS],
     T.StructField("batch", T.StringType()), T.StructField("obs_date", T.DateType())])


class StoreConflict(RuntimeError):
    """Another writer committed the version this one was to become."""


@dataclass
class Snapshot:
    """One version: batch name -> days replaced since; ``next_id`` is the smallest id never given in it."""

    number: int = 0
    batches: dict[str, list[str]] = field(default_factory=dict)
    next_id: int = 1


def parse_timestamp(c) -> F.Column:
    """Timestamp from text (NULL when unparsable) or passed through when already a timestamp."""
    return F.try_to_timestamp(c.cast("string"), F.lit(TIMESTAMP_FORMAT)).cast("timestamp_ntz")


def coerce(df: DataFrame) -> DataFrame:
    """Store schema: timestamp, 4 strings, 14 doubles; absent string -> '', absent number -> 0.0.

    Present-but-NULL values stay NULL.
    """
    cols = set(df.columns)
    ts_type = df.schema["timestamp"].dataType.simpleString() if "timestamp" in cols else None
    if ts_type is None:
        ts = F.lit(None).cast("timestamp_ntz")
    elif ts_type == "string":
        ts = parse_timestamp(F.col("timestamp"))
    else:
        ts = F.col("timestamp").cast("timestamp_ntz")
    out = [ts.alias("timestamp")]
    out += [(F.col(c).cast("string") if c in cols else F.lit("")).alias(c) for c in STRING_FIELDS]
    out += [(F.col(c).cast("double") if c in cols else F.lit(0.0)).alias(c) for c in DOUBLE_FIELDS]
    return df.select(*out)


# --- snapshots --------------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    _, folder, fs = _hadoop(spark, f"{path}/snapshots")
    if not fs.exists(folder):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _snapshot(spark: SparkSession, path: str, number: int) -> Snapshot:
    jvm, file, fs = _hadoop(spark, f"{path}/snapshots/{number:012d}.json")
    stream = fs.open(file)
    try:
        return Snapshot(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> Snapshot:
    """The newest snapshot (number 0 and no batches where nothing was stored yet)."""
    numbers = _numbers(spark, path)
    return _snapshot(spark, path, numbers[-1]) if numbers else Snapshot()


def _commit(spark: SparkSession, path: str, new: Snapshot) -> None:
    """Make ``new`` the latest version, unless its number is taken."""
    jvm, draft, fs = _hadoop(spark, f"{path}/snapshots/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new.__dict__).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots/{new.number:012d}.json")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(draft, final, options)
    except Py4JJavaError as failed:
        fs.delete(draft, False)
        if "FileAlreadyExists" in failed.java_exception.getClass().getName():
            raise StoreConflict(f"version {new.number} of {path} was committed by another writer") from None
        raise


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the snapshots before the last ``keep`` and the batches that only they list; the names of these.

    Readers of a version survive ``keep`` - 1 later writes.  Batches that no
    snapshot ever listed (a writer at work, or one that died) are left alone.
    """
    numbers = _numbers(spark, path)
    old, kept = numbers[:-keep], numbers[-keep:]
    needed = {b for n in kept for b in _snapshot(spark, path, n).batches}
    gone = sorted({b for n in old for b in _snapshot(spark, path, n).batches} - needed)
    for name in [f"data/batch={b}" for b in gone] + [f"snapshots/{n:012d}.json" for n in old]:
        _, jpath, fs = _hadoop(spark, f"{path}/{name}")
        fs.delete(jpath, True)
    return gone


# --- writes -----------------------------------------------------------------

def _staged(df: DataFrame, name: str) -> DataFrame:
    """Rows written once by day, with their task and their place in it.

    The rebalance gives a day few files and splits a large one (or the rows without a day).
    """
    mark = F.monotonically_increasing_id()
    path = scratch_dir(df.sparkSession, name)
    df.withColumn("obs_date", F.to_date("timestamp")).hint("rebalance", "obs_date") \
        .withColumn("__task", F.shiftright(mark, 33).cast("int")) \
        .withColumn("__place", mark.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(staged: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Dense ids from ``first`` on: a task's rows follow those of the tasks before it.  Also the next free id.

    Counts per writing task reach the driver and are broadcast: one row a task.
    """
    counts = staged.groupBy("__task").agg(F.count(F.lit(1)).alias("n")).orderBy("__task").collect()
    starts, at = [], first
    for r in counts:
        starts.append((r["__task"], at))
        at += r["n"]
    begin = staged.sparkSession.createDataFrame(starts, "__task int, __start long")
    ids = staged.join(F.broadcast(begin), "__task").withColumn("id", F.col("__start") + F.col("__place"))
    return ids.drop("__task", "__place", "__start"), at


def _write_batch(rows: DataFrame, path: str) -> str:
    batch = uuid.uuid4().hex[:12]
    rows.select("id", "created_at", *FIELDS, "obs_date").write.partitionBy("obs_date").parquet(
        f"{path}/data/batch={batch}")
    return batch


def _publish(spark: SparkSession, path: str, batch: str, new: Snapshot, keep: int) -> None:
    """Commit ``new``, or remove the batch that was written for it."""
    try:
        _commit(spark, path, new)
    except StoreConflict:
        _, jpath, fs = _hadoop(spark, f"{path}/data/batch={batch}")
        fs.delete(jpath, True)
        raise
    expire(spark, path, keep)


def _now() -> F.Column:
    return F.current_timestamp().cast("timestamp_ntz")


def write_observations(df: DataFrame, path: str, keep: int = 2) -> int:
    """Full replace of the store with ``df`` (typed), returning the number of rows written; ids from 1 on, gapless.

    Readers see the old or the new version; the last ``keep`` versions stay on disk.
    """
    spark = df.sparkSession
    base = latest(spark, path)
    rows, end = _numbered(_staged(coerce(df), "store-stage"), 1)
    batch = _write_batch(rows.withColumn("created_at", _now()), path)
    _publish(spark, path, batch, Snapshot(base.number + 1, {batch: []}, end), keep)
    return end - 1


def append_observations(df: DataFrame, path: str, keep: int = 2, base: Snapshot | None = None) -> int:
    """Add ``df`` (typed) to the store, returning the number of rows added; ids go on after the last one given.

    ``base`` is the version the writer started from (the latest when omitted).
    """
    spark = df.sparkSession
    base = base or latest(spark, path)
    rows, end = _numbered(_staged(coerce(df), "store-stage"), base.next_id)
    batch = _write_batch(rows.withColumn("created_at", _now()), path)
    _publish(spark, path, batch, Snapshot(base.number + 1, {**base.batches, batch: []}, end), keep)
    return end - base.next_id


def upsert_observations(df: DataFrame, path: str, keys: tuple[str, ...] = ("timestamp", "blast_id"), keep: int = 2,
                        base: Snapshot | None = None) -> tuple[int, int]:
    """Replace the stored rows that have a key of ``df`` and add the rest; the numbers of (replaced, added) rows.

    ``keys`` must hold ``timestamp``, so that only the days that occur in
    ``df`` are written anew (their list reaches the driver: one value a day).
    A replaced row keeps id and created_at; if several stored rows share a
    key, all take the new values.  Of several rows of ``df`` with one key the
    greatest stays, compared column by column.  Rows with a NULL in the key
    match nothing and are added.
    """
    if "timestamp" not in keys or not set(keys) <= set(FIELDS):
        raise ValueError(f"keys must be columns of the store and hold timestamp: {keys}")
    spark = df.sparkSession
    base = base or latest(spark, path)
    rest = [c for c in FIELDS if c not in keys]
    typed = coerce(df)
    whole = F.lit(True)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    one = (typed.where(whole).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("new"), F.lit(True).alias("__in")))
    keyless = typed.where(~whole)
    days = [r[0] for r in one.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]
    stored = _read(spark, path, base).where(F.col("obs_date").isin(days) if days else F.lit(False))
    old = stored.select("id", "created_at", *keys, F.struct(*rest).alias("old"))
    both = old.join(one, list(keys), "full_outer").select(
        "id", "created_at", *keys, F.coalesce("new", "old").alias("row"),
        (F.col("id").isNotNull() & F.coalesce("__in", F.lit(False))).alias("__replaced"))
    merged = scratch_dir(spark, "store-merge")
    both.select("id", "created_at", *keys, *[F.col("row")[c].alias(c) for c in rest], "__replaced").write.parquet(merged)
    merged = spark.read.parquet(merged)
    replaced = merged.where("__replaced").count()
    added = merged.where("id IS NULL").select(*FIELDS).unionByName(keyless)
    numbered, end = _numbered(_staged(added, "store-stage"), base.next_id)
    kept = merged.where("id IS NOT NULL").withColumn("obs_date", F.to_date("timestamp")).hint("rebalance", "obs_date")
    every = kept.select("id", "created_at", *FIELDS, "obs_date").unionByName(
        numbered.withColumn("created_at", _now()).select("id", "created_at", *FIELDS, "obs_date"))
    batch = _write_batch(every, path)
    names = [d.isoformat() for d in days]
    batches = {b: sorted({*gone, *names}) for b, gone in base.batches.items()}
    _publish(spark, path, batch, Snapshot(base.number + 1, {**batches, batch: []}, end), keep)
    return replaced, end - base.next_id


# --- reads ------------------------------------------------------------------

def _read(spark: SparkSession, path: str, version: Snapshot) -> DataFrame:
    if not version.batches:
        return spark.createDataFrame([], SCHEMA).drop("batch")
    folders = [f"{path}/data/batch={b}" for b in version.batches]
    rows = spark.read.schema(SCHEMA).option("basePath", f"{path}/data").parquet(*folders)
    for b, days in version.batches.items():
        if days:  # partition columns only: these folders are not read
            gone = (F.col("batch") == b) & F.coalesce(F.col("obs_date").isin([F.lit(d).cast("date") for d in days]),
                                                      F.lit(False))
            rows = rows.where(~gone)
    return rows.drop("batch")


def read_observations(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Full scan of the latest (or a kept earlier) version; add filters and Spark prunes partitions."""
    return _read(spark, path, latest(spark, path) if version is None else _snapshot(spark, path, version))
