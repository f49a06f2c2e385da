"""Rows of one side that nearly occur on the other: noisy copies across a train/test split.

Exact duplicates miss copies with added noise.  Here two rows are near if
their Euclidean distance over the columns, each divided by its standard
deviation, is at most ``radius``.  Rows are hashed to a grid of cells twice
the radius wide over a few columns; a row's neighbours lie in its own cell or,
per column, in the one beside the nearer edge, so a row asks 2^columns cells
and no near pair is missed.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.moments import moments
from tremorlake.operators.quantiles import column_stats, finite_value
from tremorlake.session import materialize

#: grid columns at most: a row asks 2^MAX_GRID cells
MAX_GRID = 6
#: rows a cell should hold on average
CELL_ROWS = 16


def _grid(vectors: DataFrame, cells: dict[str, Column]) -> list[str]:
    """Columns with the most occupied cells, as many as make cells of ``CELL_ROWS`` rows (were they independent)."""
    if not cells:
        return []
    got = vectors.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(k) for k, c in cells.items()]).first()
    chosen, made = [], 1
    for c in sorted(cells, key=lambda c: (-got[c], c)):
        if made * CELL_ROWS >= got["n"] or len(chosen) == MAX_GRID or got[c] < 2:
            break
        chosen.append(c)
        made *= got[c]
    return chosen


def near_overlap(df: DataFrame, cols: list[str], side: str, key: str, radius: float = 0.1) -> DataFrame:
    """Per row whose ``side`` is true: ``key``, ``n_near`` (rows of the other side within ``radius``), ``nearest``.

    ``nearest`` is the least such distance, NULL if none.  Equal rows of a
    side are one vector with a count before they meet the other side, so a hot
    row costs one vector.  A row with a missing or infinite value takes no
    part (``n_near`` 0); a constant column adds nothing to a distance; rows
    whose ``side`` is NULL are on neither side and count for no deviation.  Pairs are added up where they
    are found; only vectors of cells that meet are compared.
    """
    if radius <= 0:
        raise ValueError(f"the radius must be positive: {radius}")
    names = [f"x{i}" for i in range(len(cols))]
    values = [finite_value(c).alias(n) for n, c in zip(names, cols)]
    rows = df.select(F.col(key).alias("key"), F.col(side).alias("side"), *values).where("side IS NOT NULL")
    stats = column_stats(rows, names)
    found = moments(rows, names, stats)
    scale = {n: found[n]["std"] for n in names if found[n]["std"]}
    whole = rows.dropna(subset=names)
    vectors = materialize(whole.groupBy("side", *names).agg(F.count(F.lit(1)).alias("k")), "near-vectors")

    # the place of a value on the grid, in cells; the cells beside it are those of the nearer edges
    place = {n: (F.col(n) - F.lit(float(stats[n]["mn"]))) / F.lit(2 * radius * scale[n]) for n in scale}
    grid = _grid(vectors, {n: F.floor(p) for n, p in place.items()})
    home = F.xxhash64(F.lit(0), *[F.floor(place[n]) for n in grid])
    beside = [F.floor(place[n]) + F.when(place[n] - F.floor(place[n]) < 0.5, -1).otherwise(1) for n in grid]
    asked = F.array(*[F.xxhash64(F.lit(0), *[b if out else F.floor(place[n]) for n, b, out in zip(grid, beside, outs)])
                      for outs in itertools.product((False, True), repeat=len(grid))])
    other = vectors.where("NOT side").select(home.alias("cell"), F.col("k"), *[F.col(n).alias(f"o_{n}") for n in names])
    mine = vectors.where("side").select(F.explode(F.array_distinct(asked)).alias("cell"), *names)
    square = F.lit(0.0)
    for n in scale:
        gap = (F.col(n) - F.col(f"o_{n}")) / F.lit(scale[n])
        square = square + gap * gap
    hits = (mine.join(other, "cell").withColumn("d2", square).where(F.col("d2") <= radius * radius)
            .groupBy(*names).agg(F.sum("k").alias("n_near"), F.sqrt(F.min("d2")).alias("nearest")))
    out = rows.where("side").join(hits, names, "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "nearest")
