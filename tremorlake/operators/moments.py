"""Mean, standard deviation and skew from sums that do not depend on the order of the rows.

A value is scaled by a power of two (exactly) until the column lies in
[-1, 1] and cut into three integers of 22 bits below that; integers are added
exactly, so any partitioning, retry or file order gives the same bits.  What is
below 66 bits of the column's largest value is lost for every row alike.  The
integer sums hold 2^41 rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tremorlake.operators.quantiles import finite_value

BITS, PARTS = 22, 3
#: Bounds of the squares and cubes of scaled values.
SQUARE, CUBE = 16.0, 64.0
#: Sums from here on are divided before they are rounded to a double.
HUGE = Fraction(2) ** 1023


def exponent(limit: float) -> int:
    """Least e with limit < 2^e (not below -900: smaller columns sum up to 0)."""
    return max(math.frexp(limit)[1], -900)


def cut(values: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` (scaled below 2^BITS) cut into whole parts ``name_0``, ``name_1``, ...; one projection a part."""
    for part in range(PARTS):
        values = values.withColumns({f"{n}_{part}": F.rint(n) for n in names})
        values = values.withColumns({n: (F.col(n) - F.col(f"{n}_{part}")) * F.lit(2.0 ** BITS) for n in names})
    return values


def exact_sum(row: Row, limit: float, name: str) -> Fraction:
    scale = Fraction(2) ** (exponent(limit) - BITS)
    return sum((Fraction(row[f"{name}_{p}"]) / 2 ** (BITS * p) for p in range(PARTS)), Fraction(0)) * scale


def moments(df: DataFrame, cols: list[str], stats: dict[str, dict]) -> dict[str, dict]:
    """Per column: ``n``, ``mean``, ``std`` (sample), ``skew`` (G1); one grouping of the table's values.

    The mean is the sum, rounded to a double once, divided by n.

    ``stats`` as from ``column_stats``.  NULL and NaN are missing.  A constant
    column has std and skew 0.  A column with infinities has an infinite mean
    (NaN with both signs), and NaN as std and skew.  std needs two values, skew three.
    """
    out, entries, frames = {}, [], {}
    for i, c in enumerate(cols):
        s = stats[c]
        n = s["n"] + s["ng"] + s["pg"]
        if s["ng"] or s["pg"]:
            mean = math.nan if s["ng"] and s["pg"] else math.inf if s["pg"] else -math.inf
            std = skew = math.nan
        elif n and s["mn"] < s["mx"]:
            x, centre = finite_value(c), s["mn"] / 2 + s["mx"] / 2
            reach, size = max(s["mx"] - centre, centre - s["mn"]), max(abs(s["mn"]), abs(s["mx"]))
            shrink = min(exponent(reach), 1022)  # the scaled distance from the centre is below 4
            scale = F.lit(2.0 ** -shrink)
            frames[i] = (c, centre, shrink, size)
            entries.append(F.struct(F.lit(i).alias("i"), (x * F.lit(2.0 ** (BITS - exponent(size)))).alias("x"),
                                    (x * scale - F.lit(centre) * scale).alias("w")))
            mean = std = skew = None
        else:
            mean, std, skew = (s["mn"], 0.0, 0.0) if n else (None, None, None)
        out[c] = {"n": n, "mean": mean, "std": std if n > 1 else None, "skew": skew if n > 2 else None}
    if not entries:
        return out
    # long form: one short loop for any number of columns, combined map-side
    power = lambda k, limit: F.lit(2.0 ** (BITS - exponent(limit))) * math.prod([F.col("w")] * k, start=F.lit(1.0))
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(F.col("x").isNotNull())
    parts = cut(long.select("i", "x", power(2, SQUARE).alias("q"), power(3, CUBE).alias("t")), ["x", "q", "t"])
    names = [f"{v}_{p}" for v in "xqt" for p in range(PARTS)]
    sums = parts.groupBy("i").agg(*[F.sum(F.col(n).cast("long")).alias(n) for n in names])
    for row in sums.collect():  # one row per column
        c, centre, shrink, size = frames[row["i"]]
        n = out[c]["n"]
        total, square = exact_sum(row, size, "x"), exact_sum(row, SQUARE, "q")
        mean = total / n
        m = (mean - Fraction(centre)) / Fraction(2) ** shrink
        second, third = square - n * m * m, exact_sum(row, CUBE, "t") - 3 * m * square + 2 * n * m ** 3
        out[c]["mean"] = float(total) / n if abs(total) < HUGE else float(mean)
        out[c]["std"] = math.sqrt(max(second / (n - 1), 0)) * 2.0 ** shrink
        if n > 2:
            g = math.sqrt(n) * float(third) / float(second) ** 1.5 if second > 0 else 0.0
            out[c]["skew"] = g * math.sqrt(n * (n - 1)) / (n - 2)
    return out
