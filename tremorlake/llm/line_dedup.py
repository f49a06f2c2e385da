"""Line dedup: levelled sorted runs of line hashes; a batch merge-anti-joins the runs and adds its own.

DataFrame functions only.  A line's key (white space stripped at both ends,
A-Z lower-cased) is held as 96 hash bits.  A run is a table ``(h1, h2,
owner)``, bucketed and sorted by the hash; runs hold disjoint keys.  When a
level has ``fanout`` runs they are merged into one run of the next level.

Batches come in rising doc_id, so the run that first holds a key holds its
smallest doc_id; a line is dropped where the owner of its key is another
document.

Defined results: NULL or empty text is one empty line; lines whose key has
fewer than ``min_chars`` code points always stay; several rows of one doc_id
are one document for ownership; a document whose lines all go has an empty
text; rows with a NULL doc_id own nothing and lose no line; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import lookup_skewed, shuffle_width, table_name, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, row_tag, pos, h1, h2)`` of every line long enough to be judged; row_tag tells texts of an id apart."""
    return (docs.filter("doc_id IS NOT NULL")
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("row_tag"),
                    F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
            .select("doc_id", "row_tag", "pos", line_key(F.col("line")).alias("key"))
            .filter(F.char_length("key") >= min_chars)
            .select("doc_id", "row_tag", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")))


class RunStore:
    """Runs of line hashes by level."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, rows: DataFrame, prefix: str) -> str:
        name = table_name(prefix)
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def add(self, lines: DataFrame) -> tuple[DataFrame, int]:
        """Add a batch: ``(h1, h2, owner, n)`` of its keys that have something to drop, and its number of lines.

        The batch's keys are written sorted; those that no run holds become a
        new run, and a full level is compacted.
        """
        batch = self._write(lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")),
                            "line_batch")
        keys = self.spark.table(batch)
        total = keys.agg(F.sum("n")).first()[0] or 0
        fresh = keys
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
        known = [keys.select(*KEY, "n").join(run.hint("merge"), KEY).select(*KEY, "owner", "n") for run in self.runs()]
        own = fresh.filter("n > 1").select(*KEY, F.col("first").alias("owner"), "n")
        repeated = written(reduce(DataFrame.unionByName, known, own), "line-repeats")
        self._put(0, self._write(fresh.select(*KEY, F.col("first").alias("owner")), "line_run"))
        self.spark.sql(f"DROP TABLE {batch}")
        return repeated, total

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = reduce(DataFrame.unionByName, [self.spark.table(t) for t in old])
            new = self._write(merged.repartition(self.buckets, *KEY), "line_run")
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            self._put(level + 1, new)


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``(doc_id, row_tag, dropped)``: sorted 0-based positions of the lines a text loses (none: no row)."""
    lines = written(line_hashes(docs, min_chars), "lines")
    low, high = lines.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    store = RunStore(docs.sparkSession, fanout)
    cuts = sorted({low + round((high - low) * k / batches) for k in range(batches)}) + [high + 1]
    lost = []
    for lower, upper in zip(cuts, cuts[1:]):
        part = lines.filter((F.col("doc_id") >= lower) & (F.col("doc_id") < upper))
        repeated, total = store.add(part)
        lost.append(lookup_skewed(part, repeated, KEY, "n", total).filter("doc_id <> owner")
                    .select("doc_id", "row_tag", "pos"))
    return (reduce(DataFrame.unionByName, lost).groupBy("doc_id", "row_tag")
            .agg(F.sort_array(F.collect_set("pos")).alias("dropped")))


def without(lines: Column, dropped: Column) -> Column:
    """The array ``lines`` without the (sorted, 0-based) positions ``dropped``, by slices between them."""
    starts = F.concat(F.array(F.lit(-1)), dropped)
    ends = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def line_dedup(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with every column, ``text`` without the repeated lines, plus ``n_lines`` and ``n_dropped``.

    Added columns take the place of input columns of the same names.
    """
    lost = (dropped_lines(docs, min_chars, batches, fanout)
            .select(F.col("doc_id").alias("__llm_id"), F.col("row_tag").alias("__llm_tag"),
                    F.col("dropped").alias("__llm_dropped")))
    joined = docs.join(lost, (F.col("doc_id").cast("long") == F.col("__llm_id"))
                       & (F.hash("text") == F.col("__llm_tag")), "left")
    lines, gone = split_lines(F.col("text")), F.col("__llm_dropped")
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(without(lines, gone), "\n"))
    return (joined.withColumns({"n_lines": F.size(lines).cast("long"),
                                "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
                                "text": text})
            .drop("__llm_id", "__llm_tag", "__llm_dropped"))
