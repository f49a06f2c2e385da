"""Dataset profiling: shape, per-column profile, duplicates, describe, value counts, domain categories.

Each report is a small DataFrame built from one or two wide aggregates over
the table (partial aggregation on the map side), never one scan per column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake import constants as K
from tremorlake.operators.clean import numeric_columns, text_columns
from tremorlake.operators.moments import moments
from tremorlake.operators.quantiles import column_stats, exact_quantiles


def categorize_name(name: str) -> str | None:
    """First keyword group whose keyword occurs in the lower-cased name (None if no group)."""
    low = name.lower()
    for group, words in K.DOMAIN_GROUPS:
        if any(w in low for w in words):
            return group
    return None


def categorize_column(c: Column) -> Column:
    """``categorize_name`` as a Column expression, for names held in a DataFrame."""
    low = F.lower(c)
    expr = None
    for group, words in K.DOMAIN_GROUPS:
        cond = None
        for w in words:
            hit = F.instr(low, w) > 0
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    return expr


def _value_key(f: T.StructField) -> Column:
    """The value for counting: NaN as missing, -0.0 and 0.0 as one value; (two hashes, is missing)."""
    c = F.col(sql_name(f.name))
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(F.isnan(c), F.lit(None)).when(c == 0, F.lit(0.0)).otherwise(c)
    elif not isinstance(f.dataType, T.AtomicType):
        c = F.to_json(F.struct(c.alias("v"), c.isNull().alias("null")))
        return F.struct(F.xxhash64(c).alias("h1"), F.hash(c).alias("h2"), F.col(sql_name(f.name)).isNull().alias("gone"))
    return F.struct(F.xxhash64(c).alias("h1"), F.hash(c).alias("h2"), c.isNull().alias("gone"))


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: ordinal, name, dtype, missing, missing_pct, uniques, category.

    One pass: every value becomes (column, 96 hash bits), counted map-side and
    shuffled as fixed-width keys; missing values, rows and distinct values are
    sums over these groups.  ``exact=False`` uses HyperLogLog++ for tables
    whose columns are mostly distinct.
    """
    fields = df.schema.fields
    if exact:
        entries = F.array(*[F.struct(F.lit(i).alias("ordinal"), _value_key(f).alias("k")) for i, f in enumerate(fields)])
        values = (df.select(F.explode(entries).alias("e")).select("e.ordinal", "e.k.*")
                  .groupBy("ordinal", "h1", "h2", "gone").agg(F.count(F.lit(1)).alias("n")))
        counted = values.groupBy("ordinal").agg(
            F.sum("n").alias("rows"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("missing"),
            F.count(F.when(~F.col("gone"), 1)).alias("uniques"))
    else:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(fields):
            k = _value_key(f)
            aggs += [F.count(F.when(k["gone"], 1)).alias(f"m{i}"),
                     F.approx_count_distinct(F.when(~k["gone"], k["h1"])).alias(f"u{i}")]
        counted = df.agg(*aggs).select("rows", F.explode(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.col(f"m{i}").alias("missing"), F.col(f"u{i}").alias("uniques"))
            for i in range(len(fields))])).alias("c")).select("rows", "c.*")
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "ordinal int, column string, dtype string")
    zero = F.lit(0).cast("long")
    long = names.join(F.broadcast(counted), "ordinal", "left").withColumns(  # one row per column on both sides
        {c: F.coalesce(c, zero) for c in ("rows", "missing", "uniques")})
    pct = F.when(F.col("rows") > 0, F.col("missing") * F.lit(100.0) / F.col("rows"))
    return long.select("ordinal", "column", "dtype", "missing", pct.alias("missing_pct"), "uniques",
                       categorize_column(F.col("column")).alias("category"), "rows",
                       F.lit(len(fields)).alias("n_columns"))


def domain_categories(profile: DataFrame) -> DataFrame:
    """Column names and missing values by domain category (unmatched names dropped), names sorted."""
    return (profile.where(F.col("category").isNotNull())
            .groupBy("category")
            .agg(F.array_join(F.sort_array(F.collect_list("column")), ", ").alias("columns"),
                 F.count("*").alias("n_columns"), F.sum("missing").alias("missing")))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """(metric, value): rows, exact duplicate rows, duplicates on numeric columns only.

    One scan: the full rows are grouped (combined map-side, so a hot row costs
    one group), and the numeric groups are made of those groups.
    """
    num = numeric_columns(df)
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k"))
    groups = full.groupBy(*num).agg(F.sum("_k").alias("_k"), F.count(F.lit(1)).alias("_full")) if num else \
        full.withColumn("_full", F.lit(1))
    zero = F.lit(0).cast("long")
    one = groups.agg(F.coalesce(F.sum("_k"), zero).alias("rows"),
                     F.coalesce(F.sum("_k") - F.sum("_full"), zero).alias("duplicate_rows"),
                     F.coalesce(F.sum("_k") - F.count(F.lit(1)), zero).alias("numeric_duplicate_rows"))
    names = ["rows", "duplicate_rows", *(["numeric_duplicate_rows"] if num else [])]
    return one.select(*[F.col(n).cast("long") for n in names]).unpivot([], names, "metric", "value")


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: n, mean, std (sample), min, median (exact), max, skew (bias-corrected G1).

    NaN counts as missing; the skew of a constant column is 0.  Sums are exact, so the result does not
    depend on the order of the rows.
    """
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, mean double, std double, min double, median double, max double, skew double")
    stats = column_stats(df, cols)  # also seeds the median search
    found = moments(df, cols, stats)
    least = lambda s: -math.inf if s["ng"] else s["mn"] if s["n"] else math.inf if s["pg"] else None
    most = lambda s: math.inf if s["pg"] else s["mx"] if s["n"] else -math.inf if s["ng"] else None
    long = df.sparkSession.createDataFrame(  # one row per column
        [(c, found[c]["n"], found[c]["mean"], found[c]["std"], least(stats[c]), most(stats[c]), found[c]["skew"])
         for c in cols],
        "column string, n bigint, mean double, std double, min double, max double, skew double")
    med = exact_quantiles(df, cols, [0.5], stats=stats) \
        .select("column", F.col("value").alias("median"))
    return (long.join(F.broadcast(med), "column", "left")
            .select("column", "n", "mean", "std", "min", "median", "max", "skew"))


def value_counts(df: DataFrame, cols: list[str] | None = None, top: int = 5, full_up_to: int = 10) -> DataFrame:
    """Per text column: value, n, pct (NULL counted as a value); top-``top`` when uniques > ``full_up_to``.

    Ranking is a window on per-(column, value) counts filtered to the first
    ranks, which Spark plans as a partial WindowGroupLimit before the shuffle,
    so a column with many distinct values never lands whole in one task.
    Ties rank by value ascending, NULL last.
    """
    cols = text_columns(df) if cols is None else cols
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    uniq = counts.groupBy("column").agg(F.count("value").alias("uniques"), F.sum("n").alias("rows"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(max(top, full_up_to + 1)))
    out = (ranked.join(F.broadcast(uniq), "column", "left")
           .where((F.col("uniques") <= full_up_to) | (F.col("rank") <= top)))
    return out.select("column", "value", "n", (F.col("n") * F.lit(100.0) / F.col("rows")).alias("pct"), "rank",
                      "uniques")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, key: str, n: int = 5, seed: int | None = None) -> DataFrame:
    """First ``n`` rows in key order, or in a seeded hash permutation of the key (TakeOrderedAndProject)."""
    if seed is None:
        return df.orderBy(key).limit(n)
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("_perm", h).orderBy("_perm", key).limit(n).drop("_perm")



def categorize_columns(names: list[str]) -> dict[str, list[str]]:
    """Domain groups -> the names that fall in them (first matching group wins; unmatched dropped)."""
    out: dict[str, list[str]] = {g: [] for g, _ in K.DOMAIN_GROUPS}
    for n in names:
        g = categorize_name(n)
        if g is not None:
            out[g].append(n)
    return out


def profile_table(df: DataFrame, key: str | None = None) -> dict[str, DataFrame]:
    """Inspection report of a table as DataFrames: shape, head(5), column profile, duplicates,
    numeric summary, value counts and the domain mapping of the column names."""
    prof = column_profile(df)
    num = numeric_columns(df, exclude=[key] if key else [])
    txt = text_columns(df, exclude=[key] if key else [])
    rep = {
        "shape": shape(df),
        "preview": preview(df, key) if key else df.limit(5),
        "columns": prof,
        "duplicates": duplicate_counts(df),
        "domains": domain_categories(prof),
    }
    if num:
        rep["numeric"] = numeric_summary(df, num)
    if txt:
        rep["value_counts"] = value_counts(df, txt)
    return rep
