"""Cleaning: canonical names, deduplication, imputation, labels, packet validation.

Order matters and follows the reference flow: rename -> dedup -> impute
(median for numeric, mode for text) -> label, so a NULL level is mode-filled
before it is mapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake import constants as K
from tremorlake.functions import physics as P
from tremorlake.operators.quantiles import exact_quantiles, stat_aggs, stats_from_row
from tremorlake.session import materialize

COMPACT_REQUIRED = ["vibration", "tilt", "temperature", "moisture", "displacement"]


def normalize_name(name: str) -> str:
    """Fallback header normaliser for one name (plan-time, on ``df.columns``)."""
    s = name.strip().lower()
    for a, b in K.HEADER_REPLACEMENTS:
        s = s.replace(a, b)
    return s


def normalize_name_column(c: Column) -> Column:
    """The same normaliser as a Column expression (one ``translate`` does all single-char swaps)."""
    stripped = F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    mapped = [(a, b) for a, b in K.HEADER_REPLACEMENTS if b]
    deleted = [a for a, b in K.HEADER_REPLACEMENTS if not b]  # no counterpart in ``translate`` = delete
    src = "".join(a for a, _ in mapped) + "".join(deleted)
    return F.translate(F.lower(stripped), src, "".join(b for _, b in mapped))


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename known header spellings; normalise the others."""
    mapping = {c: K.CANONICAL_NAMES.get(c, normalize_name(c)) for c in df.columns}
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a != b})


def label_column(df: DataFrame) -> Column:
    """risk_label from vibration_level (unmapped -> WARNING), or NORMAL if the frame has no level."""
    if "vibration_level" in df.columns:
        return P.risk_from_level("vibration_level")
    return F.lit(K.NORMAL)


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_label", label_column(df))


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def dedup(df: DataFrame) -> DataFrame:
    """Full-row duplicate removal (NULL equals NULL); partial aggregation collapses hot copies map-side."""
    return df.dropDuplicates()


def medians(df: DataFrame, cols: list[str], stats: dict | None = None) -> dict[str, float | None]:
    """Exact medians of ``cols`` (bounded result: one value per column)."""
    if not cols:
        return {}
    rows = exact_quantiles(df, cols, [0.5], stats=stats).collect()
    return {r["column"]: r["value"] for r in rows}


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-NULL value per column, ties to the smallest value.

    Distributed: counts per (column, value) are pre-aggregated map-side, then
    one ``min_by`` per column picks the winner; no value map is held whole.
    """
    if not cols:
        return {}
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in best.collect()}


def present(df: DataFrame, c: str) -> Column:
    """The column with NaN as NULL."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(c), F.lit(None).cast(kind))
    return F.col(c)


def columns_with_nulls(df: DataFrame, cols: list[str]) -> list[str]:
    if not cols:
        return []
    row = df.agg(*[F.count(F.when(present(df, c).isNull(), 1)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def null_scan(df: DataFrame, num: list[str], txt: list[str]) -> tuple[list[str], list[str], dict]:
    """One aggregate: numeric and text columns that hold NULLs, plus n / min / max of the numeric ones
    (the seeds of the median search)."""
    aggs = [F.count(F.when(present(df, c).isNull(), 1)).alias(f"z{i}") for i, c in enumerate(num + txt)]
    row = df.agg(*aggs, *stat_aggs(num)).first()
    nulls = [c for i, c in enumerate(num + txt) if row[f"z{i}"]]
    return [c for c in num if c in nulls], [c for c in txt if c in nulls], stats_from_row(row, num)


def impute_median(df: DataFrame, cols: list[str] | None = None, todo: list[str] | None = None,
                  stats: dict | None = None) -> DataFrame:
    """Fill NULLs of numeric columns that have any with the column median (``todo``/``stats`` from
    ``null_scan`` skip its scans)."""
    cols = numeric_columns(df) if cols is None else cols
    todo = columns_with_nulls(df, cols) if todo is None else todo
    med = medians(df, todo, stats={c: stats[c] for c in todo} if stats is not None else None)
    return df.withColumns({c: F.coalesce(present(df, c), F.lit(med[c]).cast(df.schema[c].dataType))
                           for c in todo if med.get(c) is not None})


def impute_mode(df: DataFrame, cols: list[str] | None = None, todo: list[str] | None = None) -> DataFrame:
    """Fill NULLs of text columns that have any with the column mode."""
    cols = text_columns(df) if cols is None else cols
    todo = columns_with_nulls(df, cols) if todo is None else todo
    mode = modes(df, todo)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(mode[c])) for c in todo if mode.get(c) is not None})


def preprocess(raw: DataFrame, keys: tuple = ("event_id",)) -> DataFrame:
    """Rename -> dedup -> median/mode imputation -> risk label.

    ``keys`` are identifier columns kept but not imputed.  The deduplicated
    frame is written once to the shared checkpoint folder, so the imputation
    statistics and the final projection read one stable input instead of
    re-running the dedup shuffle per statistic.  One aggregate finds the
    columns with NULLs and seeds the median search.
    """
    df = materialize(dedup(canonical_names(raw)), "dedup")
    num, txt = numeric_columns(df, exclude=keys), text_columns(df, exclude=keys)
    num_todo, txt_todo, stats = null_scan(df, num, txt)
    df = impute_median(df, num, todo=num_todo, stats=stats)
    df = impute_mode(df, txt, todo=txt_todo)
    return with_label(df)


def validate_compact(df: DataFrame) -> DataFrame:
    """Flag compact packets: all five required readings present -> valid, else quarantine."""
    missing = None
    for c in COMPACT_REQUIRED:
        m = F.col(c).isNull().cast("int")
        missing = m if missing is None else missing + m
    return df.withColumn("n_missing", missing).withColumn("is_valid", F.col("n_missing") == 0)


def rule_alerts(df: DataFrame, threshold: float = K.RULE_ALERT_MAGNITUDE) -> DataFrame:
    """Model-independent alert: resultant acceleration above the threshold."""
    return df.where(F.col("vibration_magnitude_ms2") > F.lit(threshold))


def echo_metadata(df: DataFrame) -> DataFrame:
    """node_id / timestamp: NULL or the text 'None' -> NULL; a missing timestamp becomes now (UTC, ISO)."""
    out = df
    if "node_id" in df.columns:
        out = out.withColumn("node_id", P.none_literal_to_null("node_id"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ts = P.none_literal_to_null("timestamp") if "timestamp" in df.columns else F.lit(None).cast("string")
    return out.withColumn("timestamp", F.coalesce(ts, now))
