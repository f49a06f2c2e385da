"""The generic operators on the other driver tables: lineitem (numeric profiling, quantiles,
outliers, correlation), orders (profile, value counts, stratified split), supplier (clamp)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import physics as P
from tremorlake.operators import profile, quality, sampling
from tremorlake.plans.q_quality import _category_sql
from tremorlake.plans.registry import finish, register
from tremorlake.sources import tables

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORD_TXT = ["o_orderstatus", "o_orderpriority"]


def r6(e: str) -> str:
    return f"round({e}, 6) + 0e0"


@register("lineitem_summary", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {r6(f'fsum({c})/count({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
    f"{r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'max({c})')} AS max, "
    f"{r6(f'skewness({c})')} AS skew FROM lineitem" for c in LI_NUM))
def lineitem_summary(spark, sf_dir):
    """describe() of lineitem's numeric columns: exact medians by histogram refinement, G1 skew."""
    return finish(profile.numeric_summary(tables.table(spark, sf_dir, "lineitem"), LI_NUM))


def _bounds_sql(table: str, cols: list[str]) -> str:
    return ",\n".join(
        f"b_{c} AS (SELECT quantile_cont({c}, 0.25) - 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
        f"quantile_cont({c}, 0.75) + 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi, "
        f"avg({c}) AS mu, stddev_samp({c}) AS sd FROM {table})" for c in cols)


@register("lineitem_outliers", "WITH " + _bounds_sql("lineitem", LI_NUM) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", "
    f"(SELECT count(*) FROM lineitem, b_{c} WHERE {c} < lo OR {c} > hi) AS iqr_outliers, "
    f"(SELECT count(*) FROM lineitem, b_{c} WHERE abs(({c} - mu)/(sd + 1e-10)) > 3e0) AS zscore_outliers"
    for c in LI_NUM))
def lineitem_outliers(spark, sf_dir):
    """IQR and |z| > 3 outlier counts over lineitem's numeric columns."""
    return quality.outlier_counts(tables.table(spark, sf_dir, "lineitem"), LI_NUM)


@register("lineitem_corr", "WITH pairs AS (" + "\n UNION ALL\n".join(
    f" SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]) + f""")
SELECT column_a, column_b, {r6('r')} AS r FROM pairs """)
def lineitem_corr(spark, sf_dir):
    """Pearson r of all lineitem numeric pairs."""
    return finish(quality.corr_pairs(tables.table(spark, sf_dir, "lineitem"), LI_NUM, limit=-1.0))


@register("orders_value_counts", """
WITH counts AS (""" + "\n UNION ALL\n".join(
    f" SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ORD_TXT) + """),
u AS (SELECT "column", count(value) AS uniques, CAST(sum(n) AS BIGINT) AS rows FROM counts GROUP BY "column"),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM counts)
SELECT r."column", value, n, """ + r6("n*100e0/rows") + """ AS pct, rank, uniques
FROM r JOIN u ON r."column" = u."column" WHERE uniques <= 10 OR rank <= 5""")
def orders_value_counts(spark, sf_dir):
    """Value counts of the order status and priority columns."""
    out = profile.value_counts(tables.table(spark, sf_dir, "orders"), ORD_TXT)
    return finish(out.withColumn("rank", F.col("rank").cast("long")))


ORD_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("orders_profile", "WITH prof AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing, "
    f"count(DISTINCT {c}) AS uniques, count(*) AS rows FROM orders" for i, (c, t) in enumerate(ORD_COLS)) + f""")
SELECT ordinal, "column", dtype, missing, {r6('missing*100e0/rows')} AS missing_pct, uniques,
       {_category_sql('"column"')} AS category, rows,
       {len(ORD_COLS)} AS n_columns
FROM prof""")
def orders_profile(spark, sf_dir):
    """Column profile of orders (missing, distinct counts, categories) in one aggregate."""
    return finish(profile.column_profile(tables.table(spark, sf_dir, "orders")))


@register("orders_split", """
WITH k AS (SELECT o_orderkey, o_orderpriority, md5(concat(cast(o_orderkey AS VARCHAR), '|42')) AS h FROM orders)
SELECT o_orderkey, o_orderpriority,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey)
         <= round(count(*) OVER (PARTITION BY o_orderpriority)*0.2e0) AS is_test
FROM k""")
def orders_split(spark, sf_dir):
    """Stratified 80/20 split of orders by priority (five strata)."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(o, "o_orderpriority", "o_orderkey")


@register("supplier_clamp", f"""
SELECT s_suppkey, {r6('s_acctbal')} AS s_acctbal, {r6('greatest(s_acctbal, 0.001e0)')} AS clamped,
       s_acctbal < 0e0 AS was_negative
FROM supplier""")
def supplier_clamp(spark, sf_dir):
    """Non-negative clamp (floor 0.001) of supplier balances, which go below zero."""
    s = tables.table(spark, sf_dir, "supplier")
    return finish(s.select("s_suppkey", "s_acctbal", P.clamp_floor("s_acctbal").alias("clamped"),
                           (F.col("s_acctbal") < 0).alias("was_negative")))
