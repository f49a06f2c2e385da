"""Waveform features over grouped long rows (continuous buffers per node and window).

The crossing counters need neighbours in sample order; a window over a whole
group would put a hot group into one task, so the order is cut into
contiguous chunks, whose summaries hold the order-free sums (mean, variance,
extremes, energy) as well:

* level 1: ``lag`` inside (group, chunk), plus each chunk's first and last sample;
* level 2: ``lag`` of the chunk's last sample over the chunk summaries (one row
  per chunk) gives the pairs that straddle chunk borders.

Inner pairs + border pairs are exactly the adjacent pairs of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as K


def zero_change(a: Column, b: Column) -> Column:
    return F.when((a != 0) != (b != 0), F.lit(1)).otherwise(F.lit(0))


def sign_change(a: Column, b: Column) -> Column:
    return F.when(F.signum(a) != F.signum(b), F.lit(1)).otherwise(F.lit(0))


def window_features(df: DataFrame, group: list[str], order: list[str], value: str, chunk: Column) -> DataFrame:
    """One row per group with the 11 waveform metrics of ``value`` in ``order``.

    ``chunk`` must be non-decreasing along ``order`` within a group (e.g. a
    sub-window of the timestamp, or position div 1024).  One scan: the chunk
    summaries hold the order-free sums as well as the crossings.
    """
    x = F.col("_x")
    pos = F.struct(*[F.col(c) for c in order])
    w1 = Window.partitionBy(*group, "_chunk").orderBy(*order)
    d = df.select(*group, F.col(value).alias("_x"), *order, chunk.alias("_chunk")).withColumn("_prev", F.lag(x).over(w1))
    crossed = lambda differ: F.sum(F.when(F.col("_prev").isNotNull(), differ(F.col("_prev"), x)))
    inner = d.groupBy(*group, "_chunk").agg(
        F.count(x).alias("_n"), F.sum(x).alias("_s"), F.var_pop(x).alias("_var"), F.sum(x * x).alias("_q"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), crossed(zero_change).alias("_zc"), crossed(sign_change).alias("_sc"),
        F.min_by(x, pos).alias("_first"), F.max_by(x, pos).alias("_last"))
    w2 = Window.partitionBy(*group).orderBy("_chunk")
    joined = inner.withColumn("_pl", F.lag("_last").over(w2)).withColumn(
        "_all", F.sum("_s").over(Window.partitionBy(*group)) / F.sum("_n").over(Window.partitionBy(*group)))
    border = lambda differ: F.sum(F.when(F.col("_pl").isNotNull(), differ(F.col("_pl"), F.col("_first"))))
    total = lambda c: F.coalesce(c, F.lit(0))
    # variance: inside the chunks and between their means
    spread = F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_s") / F.col("_n") - F.col("_all"), 2))) / F.sum("_n")
    out = joined.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.max("_all").alias("mean"), F.sqrt(spread).alias("std"), F.min("_lo").alias("min"),
        F.max("_hi").alias("max"), F.sum("_q").alias("signal_energy"),
        (total(F.sum("_zc")) + total(border(zero_change))).alias("_zcn"),
        (total(F.sum("_sc")) + total(border(sign_change))).alias("_scn"))
    steps = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    peak, rms = F.greatest(F.abs("min"), F.abs("max")), F.sqrt(F.col("signal_energy") / F.col("n"))
    return out.select(
        *group, "n", "mean", "std", "min", "max", peak.alias("peak_amplitude"),
        (F.col("max") - F.col("min")).alias("peak_to_peak"), rms.alias("rms"), "signal_energy",
        (peak / (rms + F.lit(K.CREST_EPS))).alias("crest_factor"), (F.col("_zcn") / steps).alias("zero_crossing_rate"),
        (F.col("_scn") / steps).alias("sign_change_rate"))
