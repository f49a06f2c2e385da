"""Seeded, deterministic sampling: stratified ranks, split, folds, group split, noise augmentation.

Randomness comes from md5 of (key, seed[, round, channel]) instead of
``rand()``/``randn()``: a recomputed partition after a lost executor yields
the same split and the same noise, whatever the partitioning.

Exact per-stratum ranks without a window over a whole stratum (a label can
hold a third of all rows): the md5 order key is cut into 2^20 bins by its
first five hex digits.  A histogram of (stratum, bin) gives each bin's rank
offset; rows are ranked only inside their (stratum, bin), which spreads the
window over millions of small partitions; offset + local rank is the exact
global rank within the stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions import physics as P

BIN_HEX_DIGITS = 5  # 2^20 bins
SPLIT_HEX_DIGITS = 3  # 4096 bins, of which a split ranks one per stratum


def order_key(*parts) -> Column:
    """md5 hex of 'part1|part2|...' (all parts as text, a NULL part as the empty text)."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit("|"))
        cols.append(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)))
    return F.md5(F.concat(*cols))


def unit_uniform(h: Column, start: int = 1) -> Column:
    """Uniform in (0, 1) from 8 hex digits of an md5 (from position ``start``): (x + 1) / (2^32 + 1)."""
    x = F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")
    return (x + F.lit(1)).cast("double") / F.lit(4294967297.0)


def gaussian(h: Column) -> Column:
    """Standard normal by Box-Muller from one md5: uniforms from hex digits 1-8 and 9-16.

    One hash per value (not one per uniform) halves the hashing and keeps the
    generated code of a many-channel projection small enough to be compiled.
    """
    u1, u2 = unit_uniform(h, 1), unit_uniform(h, 9)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def stratified_rank(df: DataFrame, stratum: str, key: str | list[str], seed: int = K.SEED) -> DataFrame:
    """Add ``_rank`` (1-based rank in the stratum by md5(key|seed), then key) and ``_n`` (stratum size).

    NULL labels are a stratum of their own and NULL keys rank like any other: no row is lost.
    """
    keys = [key] if isinstance(key, str) else list(key)
    h = order_key(*[F.col(k) for k in keys], seed)
    d = df.withColumn("_h", h).withColumn("_bin", F.conv(F.substring("_h", 1, BIN_HEX_DIGITS), 16, 10).cast("int"))
    hist = d.groupBy(F.col(stratum).alias("_s"), F.col("_bin").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    per_stratum = Window.partitionBy("_s")
    offsets = hist.select(
        "_s", "_b",
        (F.sum("_c").over(per_stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.sum("_c").over(per_stratum).alias("_n"))
    local = Window.partitionBy(stratum, "_bin").orderBy("_h", *keys)
    ranked = d.withColumn("_local", F.row_number().over(local))
    out = ranked.join(offsets, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    rank = (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local")).alias("_rank")
    return out.select(*[F.col(c) for c in df.columns], rank, "_n")  # input column order kept


def stratified_split(df: DataFrame, stratum: str, key: str | list[str], test_fraction: float = K.TEST_FRACTION,
                     seed: int = K.SEED) -> DataFrame:
    """Add boolean ``is_test``: the first round(fraction * n) rows of each stratum in md5 order.

    Same rows as ``stratified_rank`` <= cut, but only the bin that holds a stratum's cut is ranked: a row of
    any other bin is decided where it stands, so the table itself is not shuffled.  The broadcast has one
    row per stratum.
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("_h", order_key(*[F.col(k) for k in keys], seed)) \
        .withColumn("_bin", F.conv(F.substring("_h", 1, SPLIT_HEX_DIGITS), 16, 10).cast("int"))
    hist = d.groupBy(F.col(stratum).alias("_s"), F.col("_bin").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    per_stratum = Window.partitionBy("_s")
    bins = hist.select("_s", "_b", "_c", F.sum("_c").over(per_stratum.orderBy("_b")).alias("_through"),
                       F.round(F.sum("_c").over(per_stratum) * F.lit(test_fraction)).alias("_cut"))
    beyond = F.col("_through") > F.col("_cut")  # the first such bin is the edge; without one all rows are test rows
    cuts = bins.groupBy("_s").agg(
        F.coalesce(F.min(F.when(beyond, F.col("_b"))), F.lit(16 ** SPLIT_HEX_DIGITS)).alias("_edge"),
        F.max(F.when(beyond, F.col("_cut") - F.col("_through") + F.col("_c"))).alias("_left"))
    placed = d.join(F.broadcast(cuts), F.col(stratum).eqNullSafe(F.col("_s")))
    cols = [F.col(c) for c in df.columns]
    clear = placed.where(F.col("_bin") != F.col("_edge")).select(*cols, (F.col("_bin") < F.col("_edge")).alias("is_test"))
    local = Window.partitionBy(stratum).orderBy("_h", *keys)
    edge = placed.where(F.col("_bin") == F.col("_edge"))
    return clear.unionByName(edge.select(*cols, (F.row_number().over(local) <= F.col("_left")).alias("is_test")))


def stratified_folds(df: DataFrame, stratum: str, key: str | list[str], n_folds: int = K.N_FOLDS,
                     seed: int = K.SEED) -> DataFrame:
    """Add ``fold`` in [0, n_folds): round-robin over each stratum's md5 order (stratified k-fold)."""
    r = stratified_rank(df, stratum, key, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % n_folds).cast("int")).drop("_rank", "_n")


def split_then_augment(df: DataFrame, stratum: str, key: str, factor: int = K.AUGMENT_FACTOR,
                       test_fraction: float = K.TEST_FRACTION, seed: int = K.SEED) -> DataFrame:
    """Group-aware split without a join: decide on the source rows, then augment; every noisy copy
    inherits its source's ``is_test`` (no shuffle of the expanded data)."""
    return augment(stratified_split(df, stratum, key, test_fraction, seed), key, factor, seed)


def group_split(df: DataFrame, group: str, stratum: str, first_round: Column, test_fraction: float = K.TEST_FRACTION,
                seed: int = K.SEED) -> DataFrame:
    """Split whole groups of an already-augmented frame so no group spans both sides.

    Groups are stratified by the stratum of their ``first_round`` row; the
    group decision joins back to every member (a shuffle join on the group).
    When the copies are still to be made, ``split_then_augment`` needs no join.
    """
    heads = df.where(first_round).select(group, stratum)
    decided = (stratified_split(heads, stratum, group, test_fraction, seed)
               .select(F.col(group).alias("_group"), "is_test"))
    return df.join(decided, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def augment(df: DataFrame, key: str, factor: int = K.AUGMENT_FACTOR, seed: int = K.SEED) -> DataFrame:
    """Original rows (aug_round 0) plus ``factor`` noisy copies per row (aug_round 1..factor).

    Noise: per-channel Gaussian sigma (fixed table), deterministic per
    (key, round, channel); then clamp of the non-negative channels and the
    PPV threshold relabel when the frame has a risk label.  Copies come from
    ``explode(sequence)``: a narrow, shuffle-free expansion.
    """
    cols = df.columns
    base = df.withColumn("aug_round", F.lit(0))
    rep = df.withColumn("aug_round", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    # three projections (noise, clamp, relabel): Spark does not collapse projections when that would
    # duplicate an expensive expression, so each md5-based noise value is computed once per row
    noisy = {}
    for c, sigma in K.NOISE_SIGMA.items():
        if c in cols and sigma > 0:
            noisy[c] = F.col(c) + F.lit(sigma) * gaussian(order_key(F.col(key), F.col("aug_round"), c, seed))
    rep = rep.withColumns(noisy)
    rep = rep.withColumns({c: P.clamp_floor(F.col(c)) for c in K.CLAMP_COLUMNS if c in cols})
    relabel = "ppv_mms" in cols and "risk_label" in cols
    if relabel:
        rep = rep.withColumns({"risk_label": P.risk_from_ppv("ppv_mms"), "vibration_level": P.level_from_ppv("ppv_mms")})
    if relabel and "vibration_level" not in cols:
        base = base.withColumn("vibration_level", F.lit(None).cast("string"))
    return base.unionByName(rep)
