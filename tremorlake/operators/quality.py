"""Data-quality checks: IQR / z-score outliers, range rules, label balance, leakage, correlation, overlap.

Per-column statistics are tiny (one row per column) and computed once; they
enter the row-level expressions as literals, so flagging a row needs no join
at all and the flag projection stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions import physics as P
from tremorlake.operators.clean import numeric_columns
from tremorlake.operators.quantiles import clean_value, exact_quantiles, finite_value, stat_aggs, stats_from_row

LABEL_CANDIDATES = ["risk_label", "vibration_level", "Vibration_Level"]
PPV_CANDIDATES = ["ppv_mms", "PPV(mm/s)"]


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def quartile_bounds(df: DataFrame, cols: list[str] | None = None, k: float = K.IQR_K,
                    stats: dict | None = None) -> DataFrame:
    """Per column: q25, q75 (exact, linear), iqr, lower and upper fences."""
    cols = numeric_columns(df) if cols is None else cols
    q = exact_quantiles(df, cols, [0.25, 0.75], stats=stats)
    w = (q.groupBy("column")
         .agg(F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q25"),
              F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q75")))
    iqr = F.col("q75") - F.col("q25")
    return w.select("column", "q25", "q75", iqr.alias("iqr"),
                    (F.col("q25") - F.lit(k) * iqr).alias("lower"), (F.col("q75") + F.lit(k) * iqr).alias("upper"))


def _bounds(df: DataFrame, cols: list[str], stats: dict | None = None) -> dict[str, tuple[float, float]]:
    return {r["column"]: (r["lower"], r["upper"]) for r in quartile_bounds(df, cols, stats=stats).collect()}


def _outside(c: str, lo, hi) -> Column:
    x = clean_value(c)
    if lo is None or hi is None:
        return F.lit(False)
    return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


def iqr_flags(df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Row-level IQR outlier flags (strict < lower, > upper); rows are never removed."""
    cols = numeric_columns(df, exclude=keep or []) if cols is None else cols
    b = _bounds(df, cols)
    flags = {f"{c}_outlier": _outside(c, *b.get(c, (None, None))) for c in cols}
    n = None
    for e in flags.values():
        n = e.cast("int") if n is None else n + e.cast("int")
    return df.withColumns(flags).withColumn("n_outlier_columns", n)


def outlier_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: IQR outliers and |z| > 3 outliers (z with sample std + 1e-10), side by side."""
    cols = numeric_columns(df) if cols is None else cols
    # one pass for mean, std and the quantile search's n / min / max
    st = df.agg(*[F.avg(clean_value(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                *[F.stddev_samp(clean_value(c)).alias(f"s{i}") for i, c in enumerate(cols)], *stat_aggs(cols)).first()
    b = _bounds(df, cols, stats=stats_from_row(st, cols))
    aggs = []
    for i, c in enumerate(cols):
        mean, std = st[f"a{i}"], st[f"s{i}"]
        aggs.append(F.sum(_outside(c, *b.get(c, (None, None))).cast("long")).alias(f"i{i}"))
        if mean is None or std is None:
            z = F.lit(False)
        else:
            z = P.zscore_abs(clean_value(c), F.lit(mean), F.lit(std))
            z = F.coalesce(F.when(~F.isnan(z), z > F.lit(K.ZSCORE_LIMIT)), F.lit(False))
        aggs.append(F.sum(z.cast("long")).alias(f"z{i}"))
    wide = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"i{i}").alias("iqr_outliers"),
                               F.col(f"z{i}").alias("zscore_outliers")) for i, c in enumerate(cols)])
    return wide.select(F.explode(items).alias("c")).select("c.*")


def range_checks(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Per rule whose column is present: low, high and the count of values outside [low, high] (none: no rows)."""
    rules = K.RANGE_RULES if rules is None else rules
    present = [(c, lo, hi) for c, (lo, hi) in rules.items() if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, out_of_range long")
    wide = df.agg(*[F.sum(F.coalesce((clean_value(c) < lo) | (clean_value(c) > hi), F.lit(False)).cast("long")).alias(f"r{i}")
                    for i, (c, lo, hi) in enumerate(present)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"),
                               F.col(f"r{i}").alias("out_of_range")) for i, (c, lo, hi) in enumerate(present)])
    return wide.select(F.explode(items).alias("c")).select("c.*")


def label_distribution(df: DataFrame, label: str | None = None) -> DataFrame:
    """Per label: n, pct of rows, and the max/min class imbalance ratio (inf when a class is empty)."""
    label = label or first_present(df, LABEL_CANDIDATES)
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("_all"), F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    ratio = F.when(F.col("_lo") > 0, F.col("_hi") / F.col("_lo")).otherwise(F.lit(float("inf")))
    return counts.join(F.broadcast(one)).select(  # one row of totals
        "label", "n", (F.col("n") * F.lit(100.0) / F.col("_all")).alias("pct"), ratio.cast("double").alias("imbalance_ratio"))


def normalized_label(c: Column) -> Column:
    """Level names mapped to risk names; risk names and anything else kept."""
    expr = None
    for k, v in K.LEVEL_TO_RISK.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(c)


def ppv_by_label(df: DataFrame, label: str | None = None, ppv: str | None = None) -> DataFrame:
    """Per normalised label: PPV min, max, mean (NULL labels skipped)."""
    label = label or first_present(df, LABEL_CANDIDATES)
    ppv = ppv or first_present(df, PPV_CANDIDATES)
    lab = normalized_label(F.col(label))
    return (df.where(F.col(label).isNotNull())
            .groupBy(lab.alias("label"))
            .agg(F.min(ppv).alias("ppv_min"), F.max(ppv).alias("ppv_max"), F.avg(ppv).alias("ppv_mean"),
                 F.count(F.lit(1)).alias("n")))


def leak_intervals(ranges: DataFrame) -> DataFrame:
    """Exact leakage probe: are the per-label PPV ranges disjoint intervals?

    ``ranges`` has one row per label; a label's next range is the least one above it in (minimum, label) order.
    """
    later = ranges.select(F.col("ppv_min").alias("_min"), F.col("label").alias("_label"))
    above = F.struct("_min", "_label") > F.struct("ppv_min", "label")
    nxt = (ranges.join(F.broadcast(later), above, "left").groupBy("label", "ppv_min", "ppv_max")
           .agg(F.min("_min").alias("next_min")))
    out = nxt.withColumn("disjoint_with_next", F.coalesce(F.col("next_min") > F.col("ppv_max"), F.lit(True)))
    whole = out.agg(F.bool_and("disjoint_with_next").alias("threshold_partition"))
    return out.join(F.broadcast(whole))


def corr_pairs(df: DataFrame, cols: list[str] | None = None, limit: float = 0.90) -> DataFrame:
    """Pearson r for all column pairs i < j (pairwise-complete, like pandas); keep |r| > limit (0: all of them).

    Two scans: one for every column's range and mean, one that adds up the
    Gram matrix of a vector per row: 1, the centred and scaled values (0 where
    missing) and, if any column has missing or infinite values, the squares and
    those columns' masks.  Count, sums, squares and products over the rows that
    have both values of a pair are entries of it; a task holds one matrix and
    no row is expanded.  A column that is constant, or varies by less than a
    millionth of its size over the rows of a pair, has no correlation and gives
    no row; nor does a column with infinities.
    """
    cols = numeric_columns(df) if cols is None else cols
    empty = df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    if len(cols) < 2:
        return empty
    whole = df.agg(F.count(F.lit(1)).alias("rows"), *stat_aggs(cols),
                   *[F.avg(finite_value(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    stats = stats_from_row(whole, cols)
    varied = [c for c in cols if stats[c]["n"] and stats[c]["mn"] < stats[c]["mx"] and not stats[c]["ng"] + stats[c]["pg"]]
    if len(varied) < 2:
        return empty
    centre = {c: whole[f"a{i}"] for i, c in enumerate(cols)}
    gaps = [c for c in varied if stats[c]["n"] < whole["rows"]]
    gram = _gram(df, [_unit(c, stats[c], centre[c]) for c in varied], [finite_value(c).isNotNull() for c in gaps])
    k, mask = len(varied), {c: 1 + 2 * len(varied) + i for i, c in enumerate(gaps)}

    def both(i: int, j: int) -> tuple[float, float, float]:
        """Number, sum and sum of squares of column i over the rows that have column j."""
        m = mask.get(varied[j], 0)
        square = gram[1 + k + i, m] if gaps else gram[1 + i, 1 + i]
        return gram[mask.get(varied[i], 0), m], gram[1 + i, m], square

    rows: list[tuple[str, str, float]] = []
    for i in range(k):
        for j in range(i + 1, k):
            (n, x, xx), (_, y, yy) = both(i, j), both(j, i)
            vx, vy = n * xx - x * x, n * yy - y * y
            if vx > 1e-12 * n * xx and vy > 1e-12 * n * yy:
                r = (n * gram[1 + i, 1 + j] - x * y) / (math.sqrt(vx) * math.sqrt(vy))
                rows.append((varied[i], varied[j], float(min(1.0, max(-1.0, r)))))
    return df.sparkSession.createDataFrame([x for x in rows if abs(x[2]) > limit], empty.schema)


def _unit(c: str, stats: dict, centre: float) -> Column:
    """The value less the mean, scaled to at most 1; 0 where it is missing."""
    reach = max(stats["mx"] - centre, centre - stats["mn"])
    return F.coalesce((finite_value(c) - F.lit(centre)) / F.lit(reach), F.lit(0.0))


def _gram(df: DataFrame, values: list[Column], masks: list[Column]):
    """Sum over the rows of v'v, v = (1, values, and with masks: their squares, masks)."""
    units = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], *[m.cast("double").alias(f"m{i}") for i, m in
                                                                          enumerate(masks)])
    x, m = [F.col(f"x{i}") for i in range(len(values))], [F.col(f"m{i}") for i in range(len(masks))]
    entries = [F.lit(1.0), *x, *([v * v for v in x] + m if masks else [])]
    vectors = MLUtils.convertVectorColumnsFromML(units.select(array_to_vector(F.array(*entries)).alias("v")), "v")
    return RowMatrix(vectors, 0, len(entries)).computeGramianMatrix().toArray()


def sql_ident(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


def train_test_overlap(df: DataFrame, cols: list[str], side: str = "is_test") -> DataFrame:
    """Number of distinct ``cols`` rows that occur on both sides: one group per row, combined map-side.

    Rows of several columns are told apart by 128 hash bits of their values and of which are NULL, so a shuffled
    row has two numbers however wide ``cols`` is.
    """
    values = [F.col(c) for c in cols]
    group = values if len(cols) == 1 else [
        F.xxhash64(F.lit(i), *[c.isNull() for c in values], *values).alias(f"_h{i}") for i in (0, 1)]
    seen = df.groupBy(*group).agg(F.bool_or(F.col(side)).alias("_test"), F.bool_or(~F.col(side)).alias("_train"))
    return seen.agg(F.count(F.when(F.col("_test") & F.col("_train"), 1)).alias("shared_rows"))


def energy_probe(df: DataFrame, ppv: str = "ppv_mms") -> DataFrame:
    """Whether ``kinetic_energy_proxy`` is 0.5 PPV^2 in every row; a missing value on either side is a difference."""
    same = F.coalesce(P.allclose("kinetic_energy_proxy", P.kinetic_energy(ppv)), F.lit(False))
    return df.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("energy_is_ppv"))


def report(df: DataFrame, cols: list[str] | None = None, train: DataFrame | None = None,
           test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Data-quality report as DataFrames: missing values, duplicates, outliers, range rules, labels,
    distributions, correlation, leakage (ranges and their disjointness, a tree on PPV alone, kinetic energy
    that is 0.5 PPV^2) and train/test overlap."""
    from tremorlake.operators import model, profile

    cols = numeric_columns(df, exclude=["id", "created_at"]) if cols is None else cols
    out = {
        "columns": profile.column_profile(df),
        "duplicates": profile.duplicate_counts(df),
        "outliers": outlier_counts(df, cols),
        "ranges": range_checks(df),
        "distribution": profile.numeric_summary(df, cols),
        "correlation": corr_pairs(df, cols),
    }
    label = first_present(df, LABEL_CANDIDATES)
    if label:
        out["labels"] = label_distribution(df, label)
        if first_present(df, PPV_CANDIDATES):
            ranges = ppv_by_label(df, label)
            out["ppv_by_label"] = ranges
            out["leak_intervals"] = leak_intervals(ranges)
    ppv = first_present(df, PPV_CANDIDATES)
    if label and ppv:
        both = df.where(F.col(sql_ident(label)).isNotNull() & clean_value(ppv).isNotNull())
        if not both.isEmpty():
            out["leak_tree"] = model.ppv_leak_probe(both, sql_ident(label), sql_ident(ppv))
    if ppv and "kinetic_energy_proxy" in df.columns:
        out["energy_probe"] = energy_probe(df, sql_ident(ppv))
    if train is not None and test is not None:
        both = (test.select(*cols).withColumn("__is_test", F.lit(True))
                .unionByName(train.select(*cols).withColumn("__is_test", F.lit(False))))
        out["train_test_overlap"] = train_test_overlap(both, cols, "__is_test")
    return out
