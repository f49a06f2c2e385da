"""Sharding by histogram sort: shards of near-equal bytes, one exchange.

Rows are ordered by a 64-bit hash of their text, so equal texts share a key
and stay together.  Candidate boundaries (probes) are refined against exact
byte counts below them, summed over all partitions, until every splitter is
within tolerance of its target; then each row goes to its shard and slot in
one exchange.  Texts that alone hold more than the tolerance in bytes or rows
(a bounded list) are dealt to shards first, largest to the emptiest, and the
splitters of the rest aim at what is left of each shard's share.

A text whose copies fit no shard's share is cut unless ``whole_texts``: its
rows are ordered by a hash of text and doc_id among all others, so the same
exact counts deal them out.  With ``whole_texts`` it stays in one shard, which
is then larger than the others.

Defined results: a NULL text has no bytes and goes with the empty text;
repeated rows are counted each; rows are told apart by doc_id only for the
order inside a shard and in large texts (there rows of one doc_id that are
many by themselves also by their place in the table); other columns are never
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import written

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"),
                       F.monotonically_increasing_id().alias("row"))


def _below(rows: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes of the rows whose key is below each (sorted) probe: one pass, one row per gap to the driver."""
    marks = F.array(*[F.lit(p) for p in probes])
    gap = F.size(F.filter(marks, lambda p: p <= F.col("key")))
    got = dict(rows.groupBy(gap.alias("gap")).agg(F.sum("size")).collect())
    out, run = [], 0
    for i in range(len(probes)):
        run += got.get(i, 0)
        out.append(run)
    return out


def splitters(rows: DataFrame, targets: list[float], total: int, tolerance: int, probes: int = 16) -> list[int]:
    """Keys whose exact bytes below are within ``tolerance`` of the targets (or as near as whole keys allow)."""
    known = {LOW: 0, HIGH + 1: total}
    while True:
        marks = sorted(known)
        ask = set()
        for t in targets:
            if min(abs(known[m] - t) for m in marks) <= tolerance:
                continue
            at = max(i for i, m in enumerate(marks) if known[m] <= t)
            low, high = marks[at], marks[min(at + 1, len(marks) - 1)]
            if high - low <= 1:
                continue
            # expect the bytes evenly spread over the gap, and probe around the place that follows
            share = (t - known[low]) / max(1, known[high] - known[low])
            mid = low + int((high - low) * min(max(share, 0.0), 1.0))
            reach = max(1, (high - low) >> 4)
            near = {mid + (reach * k >> 3) for k in range(-probes // 2, probes // 2 + 1)}
            even = {low + (high - low) * k // probes for k in range(1, probes)}
            ask |= {p for p in near | even if low < p < high}
        ask -= known.keys()
        if not ask:
            break
        order = sorted(ask)
        known.update(zip(order, _below(rows, order)))
    marks = sorted(known)
    return [min(marks, key=lambda m, t=t: (abs(known[m] - t), m)) for t in targets]


class ShardPlan:
    """Which shard a key goes to: the large keys one by one, the others and the cut ones by splitters."""

    def __init__(self, rows: DataFrame, shards: int, tolerance: float, whole_texts: bool = True):
        self.spark = rows.sparkSession
        total, self.count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
        total = total or 0
        share = total / shards
        slack = max(1, int(share * tolerance))
        # large from half a percent of a share of bytes or rows on: at most 400 * shards keys
        large = ((F.col("n") > max(slack, share * 0.005)) | (F.col("m") > max(1, self.count / shards * 0.005)))
        held = F.sum("size").alias("n"), F.count(F.lit(1)).alias("m")
        load, dealt = [0] * shards, {}
        for k, n, m in rows.groupBy("key").agg(*held).filter(large).orderBy(F.desc("n"), "key").collect():
            to = min(range(shards), key=lambda s: (load[s], s))
            if whole_texts or m == 1 or load[to] + n <= self._level(load, total - sum(load)):
                dealt[k] = to
                load[to] += n
            else:
                dealt[k] = None
        self.large = self.spark.createDataFrame(list(dealt.items()), "large_key long, large_shard int")
        many = (rows.join(F.broadcast(self.large), F.col("key") == F.col("large_key"), "left_semi")
                .groupBy("key", "doc_id").agg(*held).filter(large & (F.col("m") > 1)).select("key", "doc_id"))
        self.many = self.spark.createDataFrame(many.collect() if dealt else [], "many_key long, many_id long")
        light = total - sum(load)
        level = self._level(load, light)
        needs = [max(0.0, level - x) for x in load]
        ends = [sum(needs[:i + 1]) for i in range(shards - 1)]
        loose = self._with_large(rows).filter("large_shard IS NULL").select(F.col("at").alias("key"), "size")
        self.cuts = splitters(loose, ends, light, slack)

    @staticmethod
    def _level(load: list[int], light: int) -> float:
        """Where the emptier shards end up when the ``light`` bytes raise them to one level."""
        base, room, level = sorted(load), light, 0.0
        for i, low in enumerate(base):
            level = low + room / (i + 1)
            if i + 1 == len(base) or level <= base[i + 1]:
                break
            room -= (base[i + 1] - low) * (i + 1)
        return level

    def _with_large(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus ``large_shard``, ``part`` (a hash within a large key, else NULL) and ``at`` (the order)."""
        many = F.broadcast(self.many)
        out = (rows.join(F.broadcast(self.large), F.col("key") == F.col("large_key"), "left")
               .join(many, (F.col("large_key") == F.col("many_key")) & F.col("doc_id").eqNullSafe(F.col("many_id")),
                     "left"))
        part = F.when(F.col("many_key").isNotNull(), F.xxhash64("key", "doc_id", "row")).otherwise(
            F.xxhash64("key", "doc_id"))
        return (out.withColumn("part", F.when(F.col("large_key").isNotNull(), part))
                .withColumn("at", F.when(F.col("large_shard").isNull(), F.coalesce("part", "key"))
                            .otherwise(F.col("key")))
                .drop("large_key", "many_key", "many_id"))

    def place(self, rows: DataFrame, rows_per_bin: int) -> DataFrame:
        """``rows`` (with key, doc_id, row) plus ``shard`` and ``bin``: ranges of ``at``, and parts of a large key."""
        by_cut = F.lit(0)
        for c in self.cuts:
            if c <= HIGH:
                by_cut = by_cut + (F.col("at") >= F.lit(c)).cast("int")
        bits = max(6, (self.count // rows_per_bin).bit_length())
        by_key = F.shiftrightunsigned(F.col("at").bitwiseXOR(F.lit(LOW)), 64 - bits)
        by_part = F.pmod(F.col("part"), F.lit(1 << bits)) + (1 << bits)
        return (self._with_large(rows).withColumn("shard", F.coalesce("large_shard", by_cut))
                .withColumn("bin", F.when(F.col("large_shard").isNull(), by_key).otherwise(by_part))
                .drop("large_shard", "part", "at"))


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, rows_per_bin: int = 50_000,
          whole_texts: bool = True) -> DataFrame:
    """``(doc_id, size, text_crc32, key, shard, slot)``: shards of near-equal bytes, slots gapless from 0.

    ``tolerance``: the error allowed per splitter, as a part of a shard's
    share.  A shard's rows are numbered by bins of about ``rows_per_bin``
    rows, whose counts give each bin's first slot.  ``whole_texts``: copies share
    a shard even if they alone are more than its share.
    """
    rows = written(keyed(docs), "shard-keys")
    placed = ShardPlan(rows, shards, tolerance, whole_texts).place(rows, rows_per_bin)
    firsts = (placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n"))
              .drop("n"))
    place = Window.partitionBy("shard", "bin").orderBy("key", "doc_id", "size")
    return (placed.withColumn("rank", F.row_number().over(place)).join(firsts, ["shard", "bin"])
            .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("rank") - 1).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001,
                 rows_per_bin: int = 50_000, whole_texts: bool = True) -> None:
    """Write ``docs`` (all columns) into one folder per shard, dealt by one exchange and sorted in each file."""
    plan = ShardPlan(written(keyed(docs), "shard-keys"), shards, tolerance, whole_texts)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(raw).alias("key"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    placed = plan.place(whole, rows_per_bin).repartition("shard", "bin").sortWithinPartitions("shard", "bin", "key")
    placed.select("doc.*", F.col("shard").alias("shard_folder")).write.partitionBy("shard_folder").parquet(path)
