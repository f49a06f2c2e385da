"""Exact quantiles (linear interpolation) that scale past one task's memory.

Spark's exact ``percentile`` aggregate keeps a value->count map of the whole
column in one final task; ``percentile_approx`` is not exact.  Here each
wanted order statistic is found by histogram refinement:

1. one wide aggregate of the table gives n, min, max per column;
2. while the candidate interval of a wanted rank holds more than
   ``max_window_rows`` rows, one aggregate counts rows per equal-width bin of
   the interval (``bins`` groups per distinct interval, so the collected
   histogram has a fixed size bound; ranks with the same interval share one)
   and the interval shrinks to the bin holding the rank;
3. the final interval (<= ``max_window_rows`` rows, 20k by default) is ranked with a window
   partitioned by the wanted rank, lazily, inside the returned plan.

Binning is monotone in the value, so rows of earlier bins are all smaller:
the rank inside the chosen bin is the wanted rank minus the rows before it.
A bin whose min equals its max settles the value at once (hot values).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class _Target:
    tid: int
    column: str
    rank: int  # 0-based order statistic
    lo: float
    hi: float
    below: int  # rows of the column smaller than lo
    inside: int  # rows of the column in [lo, hi]
    value: float | None = None


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, v) pairs of the given numeric columns; NULL, NaN and infinite values dropped."""
    if not cols:
        raise ValueError("no columns")
    wide = df.select(*[finite_value(c).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "v")
    return long.where(F.col("v").isNotNull())


def clean_value(c: str) -> Column:
    """The column as double with NaN turned into NULL (the values the quantiles rank)."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def finite_value(c: str) -> Column:
    """``clean_value`` with infinities turned into NULL, too."""
    x = clean_value(c)
    return F.when(F.abs(x) < F.lit(math.inf), x)


def stat_aggs(cols: list[str]) -> list[Column]:
    """Aggregates per column: count, minimum and maximum of the finite values, counts of both infinities.

    Callers add them to an aggregate they run anyway.
    """
    aggs = []
    for i, c in enumerate(cols):
        x, whole = finite_value(c), clean_value(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.count(F.when(whole == -math.inf, 1)).alias(f"ng{i}"),
                 F.count(F.when(whole == math.inf, 1)).alias(f"pg{i}")]
    return aggs


def stats_from_row(row, cols: list[str]) -> dict[str, dict]:
    return {c: {k: row[f"{k}{i}"] for k in ("n", "mn", "mx", "ng", "pg")} for i, c in enumerate(cols)}


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """n, min, max of each column (NULL and NaN skipped) from one wide aggregate of the table."""
    return stats_from_row(df.agg(*stat_aggs(cols)).first(), cols)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], bins: int = 4096,
                    max_window_rows: int = 20_000, stats: dict[str, dict] | None = None) -> DataFrame:
    """DataFrame(column, p, value) with numpy/pandas 'linear' quantiles of each column.

    Columns with no non-NULL value give a NULL quantile.  Infinite values rank
    first and last and are settled by their counts alone.  ``stats`` (from
    ``stats_from_row`` over ``stat_aggs``) saves the first pass when the caller
    already aggregates the table.
    """
    spark = df.sparkSession
    long = long_values(df, cols)
    stats = column_stats(df, cols) if stats is None else stats

    targets: list[_Target] = []
    wanted: list[tuple[str, float, int | None, int | None, float]] = []  # column, p, tid_lo, tid_hi, frac
    by_key: dict[tuple[str, int], int] = {}
    for c in cols:
        s = stats.get(c)
        for p in probs:
            total = 0 if s is None else s["n"] + s["ng"] + s["pg"]
            if not total:
                wanted.append((c, p, None, None, 0.0))
                continue
            h = (total - 1) * p
            ids = []
            for r in (int(math.floor(h)), int(math.ceil(h))):
                key = (c, r)
                if key not in by_key:
                    by_key[key] = len(targets)
                    if r < s["ng"] or r >= s["ng"] + s["n"]:
                        value = -math.inf if r < s["ng"] else math.inf
                        t = _Target(len(targets), c, r, value, value, 0, 0, value)
                    else:
                        t = _Target(len(targets), c, r - s["ng"], float(s["mn"]), float(s["mx"]), 0, int(s["n"]))
                        if t.lo == t.hi:
                            t.value = t.lo
                    targets.append(t)
                ids.append(by_key[key])
            wanted.append((c, p, ids[0], ids[1], h - math.floor(h)))

    tschema = T.StructType([T.StructField("tid", T.IntegerType()), T.StructField("column", T.StringType()),
                            T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])

    while True:
        open_t = [t for t in targets if t.value is None and t.inside > max_window_rows]
        if not open_t:
            break
        # targets with the same interval (all targets of a column on the first pass) share a histogram
        intervals: dict[tuple, int] = {}
        for t in open_t:
            intervals.setdefault((t.column, t.lo, t.hi), len(intervals))
        tdf = spark.createDataFrame([(i, c, lo, hi) for (c, lo, hi), i in intervals.items()], tschema)
        # halves: the width of an interval of finite doubles need not be one
        width = F.col("hi") / 2 - F.col("lo") / 2
        share = (F.col("v") / 2 - F.col("lo") / 2) / width
        binned = (long.join(F.broadcast(tdf), "column")
                  .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                  .select("tid", "v", F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
                          .alias("bin")))
        hist: dict[int, list] = {}
        for r in binned.groupBy("tid", "bin").agg(F.count("*").alias("n"), F.min("v").alias("mn"),
                                                  F.max("v").alias("mx")).collect():
            hist.setdefault(r["tid"], []).append((r["bin"], r["n"], r["mn"], r["mx"]))
        for t in open_t:
            need = t.rank - t.below
            seen = 0
            for b, n, mn, mx in sorted(hist.get(intervals[(t.column, t.lo, t.hi)], [])):
                if seen + n > need:
                    if n == t.inside and (mn, mx) == (t.lo, t.hi):
                        raise RuntimeError(f"the interval of {t.column} does not shrink")
                    t.below += seen
                    t.lo, t.hi, t.inside = float(mn), float(mx), int(n)
                    if t.lo == t.hi:
                        t.value = t.lo
                    break
                seen += n

    # rank the remaining small intervals inside the plan
    rest = [t for t in targets if t.value is None]
    pieces = []
    if rest:
        rschema = T.StructType(tschema.fields + [T.StructField("pos", T.LongType())])
        rdf = spark.createDataFrame([(t.tid, t.column, t.lo, t.hi, t.rank - t.below + 1) for t in rest], rschema)
        w = Window.partitionBy("tid").orderBy("v")
        ranked = (long.join(F.broadcast(rdf), "column")
                  .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                  .withColumn("rn", F.row_number().over(w))
                  .where(F.col("rn") == F.col("pos"))
                  .select("tid", F.col("v").alias("value")))
        pieces.append(ranked)
    settled = [(t.tid, t.value) for t in targets if t.value is not None]
    vschema = T.StructType([T.StructField("tid", T.IntegerType()), T.StructField("value", T.DoubleType())])
    if settled or not pieces:
        pieces.append(spark.createDataFrame(settled, vschema))
    values = pieces[0]
    for p in pieces[1:]:
        values = values.unionByName(p)

    # one row per (wanted quantile, role): role 0 = lower rank, 1 = upper rank
    wschema = T.StructType([T.StructField("column", T.StringType()), T.StructField("p", T.DoubleType()),
                            T.StructField("frac", T.DoubleType()), T.StructField("role", T.IntegerType()),
                            T.StructField("tid", T.IntegerType())])
    rows = []
    for c, p, a, b, fr in wanted:
        rows.append((c, float(p), float(fr), 0, a))
        rows.append((c, float(p), float(fr), 1, b))
    wdf = spark.createDataFrame(rows, wschema)
    v_lo = F.max(F.when(F.col("role") == 0, F.col("value"))).alias("v_lo")
    v_hi = F.max(F.when(F.col("role") == 1, F.col("value"))).alias("v_hi")
    return (wdf.join(F.broadcast(values), "tid", "left")
            .groupBy("column", "p", "frac").agg(v_lo, v_hi)
            .select("column", "p", F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).when(F.col("frac") == 0, F.col("v_lo"))
                    .otherwise(F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("value")))
