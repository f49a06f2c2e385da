"""Daily sketches and top-k of very distinct columns against exact counts."""

import numpy as np
from pyspark.sql import functions as F

from tremorlake.operators import sketches
from tremorlake.session import scratch_dir


def _rows(spark, n=40_000):
    return spark.range(n, numPartitions=6).select(
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("day"),
        F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(9000))).alias("k"),
        F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.sqrt(F.col("id").cast("double"))).alias("x"),
        F.lit(None).cast("double").alias("gone"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"))


def test_days_unite_to_the_whole(spark):
    df = _rows(spark)
    path = scratch_dir(spark, "sketches")
    sketches.save_sketches(sketches.sketch_by_day(df, F.col("day")), path)
    size = sketches.read_sketches(spark, path).count()
    # a day that comes again replaces itself, the others stay
    sketches.save_sketches(sketches.sketch_by_day(df.where("day = DATE'2026-01-03'"), F.col("day")), path)
    stored = sketches.read_sketches(spark, path)
    assert stored.count() == size == 9 * 5
    days = {r["column"]: r for r in sketches.united(stored).collect()}
    whole = {r["column"]: r for r in sketches.united(sketches.sketch_by_day(df, F.lit("all"))).collect()}
    pdf = df.toPandas()
    for c in ("k", "x", "gone", "t", "day"):
        d, w = days[c], whole[c]
        assert (d["rows"], d["missing"], d["least"], d["most"]) == (w["rows"], w["missing"], w["least"], w["most"])
        assert d["uniques"] == w["uniques"]  # the same registers, whatever the days
        assert abs(d["uniques"] - pdf[c].nunique()) <= 0.032 * pdf[c].nunique()  # four standard errors
        assert d["missing"] == pdf[c].isna().sum()
    x = np.sort(pdf["x"].dropna().to_numpy())
    for p, v in zip((0.25, 0.5, 0.75), days["x"]["quantiles"]):
        assert abs(np.searchsorted(x, v) / len(x) - p) < 0.01
    assert days["gone"]["quantiles"] is None and days["gone"]["uniques"] == 0 and days["t"]["quantiles"] is None
    some = sketches.united(stored.where("day <= DATE'2026-01-02'")).where("column = 'x'").first()
    assert some["rows"] == (pdf["day"].astype(str) <= "2026-01-02").sum()


def test_empty_table_has_no_sketches(spark):
    df = _rows(spark).limit(0)
    assert sketches.united(sketches.sketch_by_day(df, F.col("day"))).count() == 0
    assert sketches.top_values(df, ["t"]).count() == 0 and sketches.top_values(df, []).count() == 0


def _brute(df, cols, k):
    out = set()
    for c in cols:
        counts = [(r[c], r["count"]) for r in df.groupBy(c).count().collect()]
        counts.sort(key=lambda v: (-v[1], v[0] is None, "" if v[0] is None else str(v[0])))
        out |= {(c, None if v is None else str(v), n, i + 1) for i, (v, n) in enumerate(counts[:k])}
    return out


def test_top_values_are_exact(spark):
    # hot: a few values over many single ones (settled by the sketch); flat: ties everywhere (counted in full)
    df = spark.range(30_000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot"), F.col("id") % 4)).when(F.col("id") % 11 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("id"), F.col("id"))).alias("hot"),
        (F.col("id") % 15_000).cast("string").alias("flat"), F.lit("one").alias("one"),
        F.lit(None).cast("string").alias("none"))
    cols = df.columns
    for tracked in (64, 10_000):
        got = {tuple(r) for r in sketches.top_values(df, cols, k=5, tracked=tracked).collect()}
        assert got == _brute(df, cols, 5), tracked
