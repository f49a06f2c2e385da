"""Queries: cleaning, store, profiling and quality reports (U1, A1-A16, P11-P15, L7, S3-S5)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake import constants as K
from tremorlake.functions import physics as P
from tremorlake.operators import clean, features, profile, quality
from tremorlake.plans import sql as S
from tremorlake.plans.registry import finish, register
from tremorlake.session import materialize, scratch_dir
from tremorlake.sources import store, tables

TXT = ["timestamp", "blast_id", "soil_type", "vibration_level"]
# the raw table's headers: of the spellings that mean one channel, the first
_FIRST = {name: header for header, name in reversed(K.CANONICAL_NAMES.items())}
RAW_COLS = ["event_id", *[h for h in K.CANONICAL_NAMES if _FIRST[K.CANONICAL_NAMES[h]] == h]]
ORDER = ["event_id", *[K.CANONICAL_NAMES[h] for h in RAW_COLS[1:]]]
NUM = [c for c in ORDER[1:] if c not in TXT]
RAW_TYPES = ["bigint", "string", "string"] + ["double"] * 4 + ["string"] + ["double"] * 10 + ["string"]


def r6(e: str) -> str:
    return f"round({e}, 6) + 0e0"


def q(c: str) -> str:
    return '"' + c + '"'


def renamed(spark, sf_dir):
    return clean.canonical_names(tables.raw_blast_table(spark, sf_dir))


# --- cleaning -------------------------------------------------------------

DEDUP = S.RENAMED + """,
d AS (SELECT DISTINCT * FROM renamed)"""

MEDIANS = DEDUP + """,
med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUM) + " FROM d)"

MODES = ",\n".join(
    f"mode_{c} AS (SELECT {q(c)} AS v FROM d WHERE {q(c)} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    for c in TXT)

CLEAN = MEDIANS + ",\n" + MODES + """,
cleaned AS (
  SELECT d.event_id, """ + ", ".join(
    f"coalesce(d.{q(c)}, (SELECT v FROM mode_{c})) AS {q(c)}" for c in TXT) + ", " + ", ".join(
    f"coalesce(d.{c}, med.{c}) AS {c}" for c in NUM) + """
  FROM d, med),
labelled AS (
  SELECT *, CASE vibration_level WHEN 'Low' THEN 'NORMAL' WHEN 'Medium' THEN 'WARNING'
                 WHEN 'High' THEN 'CRITICAL' ELSE 'WARNING' END AS risk_label
  FROM cleaned)"""


@register("dedup_rows", f"""
WITH {DEDUP}
SELECT event_id, {", ".join(q(c) for c in TXT)}, {", ".join(f"{r6(c)} AS {c}" for c in NUM)} FROM d""")
def dedup_rows(spark, sf_dir):
    return finish(clean.dedup(renamed(spark, sf_dir)))


@register("impute_median", f"""
WITH {MEDIANS}
SELECT d.event_id, {", ".join(f"{r6(f'coalesce(d.{c}, med.{c})')} AS {c}" for c in NUM)} FROM d, med""")
def impute_median(spark, sf_dir):
    d = materialize(clean.dedup(renamed(spark, sf_dir)), "dedup")
    out = clean.impute_median(d, clean.numeric_columns(d, exclude=["event_id"]))
    return finish(out.select("event_id", *NUM))


@register("impute_mode", f"""
WITH {DEDUP},
{MODES}
SELECT event_id, {", ".join(f"coalesce({q(c)}, (SELECT v FROM mode_{c})) AS {q(c)}" for c in TXT)} FROM d""")
def impute_mode(spark, sf_dir):
    d = materialize(clean.dedup(renamed(spark, sf_dir)), "dedup")
    out = clean.impute_mode(d, clean.text_columns(d))
    return out.select("event_id", *TXT)


@register("clean_table", f"""
WITH {CLEAN}
SELECT event_id, {", ".join(q(c) for c in TXT)}, {", ".join(f"{r6(c)} AS {c}" for c in NUM)}, risk_label
FROM labelled""")
def clean_table(spark, sf_dir):
    """Rename -> dedup -> median / mode imputation -> risk label (the whole preprocessing flow)."""
    return finish(clean.preprocess(tables.raw_blast_table(spark, sf_dir)))


STORE_SELECT = ("try_strptime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') AS \"timestamp\", "
                + ", ".join(store.STRING_FIELDS) + ", "
                + ", ".join(f"{r6(c)} AS {c}" for c in store.DOUBLE_FIELDS))


@register("store_coerce", f"""
WITH {CLEAN}
SELECT {STORE_SELECT} FROM labelled""")
def store_coerce(spark, sf_dir):
    return finish(store.coerce(clean.preprocess(tables.raw_blast_table(spark, sf_dir))))


@register("store_defaults", f"""
WITH {S.FEATURED}
SELECT ts AS "timestamp", '' AS blast_id, '' AS soil_type, '' AS vibration_level, risk_label,
       {", ".join(f"{r6(c)} AS {c}" if c in K.RAW_CHANNELS else f"0e0 AS {c}" for c in store.DOUBLE_FIELDS)}
FROM featured""")
def store_defaults(spark, sf_dir):
    """Store projection of raw-9 packets: absent blast metadata -> '' and 0.0."""
    t = tables.telemetry(spark, sf_dir).withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    return finish(store.coerce(t.withColumnRenamed("ts", "timestamp")))


@register("store_roundtrip", f"""
WITH {CLEAN}
SELECT {STORE_SELECT}, true AS id_unique FROM labelled""")
def store_roundtrip(spark, sf_dir):
    """Full-replace write of the cleaned table to the store, then a full scan back."""
    path = scratch_dir(spark, "store")
    n = store.write_observations(clean.preprocess(tables.raw_blast_table(spark, sf_dir)), path)
    back = store.read_observations(spark, path)
    ids = back.agg(F.count_distinct("id").alias("k")).first()["k"]
    cols = ["timestamp"] + store.STRING_FIELDS + store.DOUBLE_FIELDS
    return finish(back.select(*cols, F.lit(ids == n).alias("id_unique")))


@register("store_upsert", f"""
SELECT event_id, {r6("CASE WHEN event_id % 2 = 0 THEN value/25e0 + 1e0 ELSE value/25e0 END")} AS ppv_mms, true AS ids_dense
FROM events WHERE event_id % 2 = 0 OR event_id % 3 < 2""")
def store_upsert(spark, sf_dir):
    """Three writes to one store: a replace, an append, and an upsert that changes some rows and adds others."""
    path = scratch_dir(spark, "store")
    t = tables.telemetry(spark, sf_dir).select("event_id", F.col("ts").alias("timestamp"), "ppv_mms",
                                               F.col("event_id").cast("string").alias("blast_id"))
    store.write_observations(t.where("event_id % 3 = 0"), path)
    store.append_observations(t.where("event_id % 3 = 1"), path)
    store.upsert_observations(t.where("event_id % 2 = 0").withColumn("ppv_mms", F.col("ppv_mms") + 1), path)
    back = store.read_observations(spark, path)
    ids = back.agg(F.count_distinct("id").alias("k"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    dense = ids["a"] == 1 and ids["b"] == ids["k"] == back.count()
    return finish(back.select(F.col("blast_id").cast("long").alias("event_id"), "ppv_mms", F.lit(dense).alias("ids_dense")))


# --- profiling ------------------------------------------------------------

def _category_sql(e: str) -> str:
    parts = []
    for group, words in K.DOMAIN_GROUPS:
        cond = " OR ".join(f"contains(lower({e}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{group}'")
    return "CASE " + " ".join(parts) + " END"


PROFILE_SQL = S.RAW + """,
prof AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, "
    f"count(*) - count({q(c)}) AS missing, count(DISTINCT {q(c)}) AS uniques, count(*) AS rows FROM raw"
    for i, (c, t) in enumerate(zip(RAW_COLS, RAW_TYPES))) + """),
profile AS (
  SELECT ordinal, "column", dtype, missing, """ + r6("missing*100e0/rows") + """ AS missing_pct, uniques,
         """ + _category_sql('"column"') + f""" AS category, rows, {len(RAW_COLS)} AS n_columns
  FROM prof)"""


@register("column_profile", f"WITH {PROFILE_SQL}\nSELECT * FROM profile")
def column_profile(spark, sf_dir):
    """Shape + per-column dtype, missing, missing %, distinct count and domain category of the raw table."""
    return finish(profile.column_profile(tables.raw_blast_table(spark, sf_dir)))


@register("domain_categories", f"""WITH {PROFILE_SQL}
SELECT category, string_agg("column", ', ' ORDER BY "column") AS columns, count(*) AS n_columns,
       CAST(sum(missing) AS BIGINT) AS missing
FROM profile WHERE category IS NOT NULL GROUP BY category""")
def domain_categories(spark, sf_dir):
    return profile.domain_categories(profile.column_profile(tables.raw_blast_table(spark, sf_dir), exact=False))


RAW_NUM = [c for c, t in zip(RAW_COLS, RAW_TYPES) if t == "double"]
RAW_NOID = [c for c in RAW_COLS if c != "event_id"]


@register("duplicate_counts", f"""
WITH {S.RAW},
r AS (SELECT {", ".join(q(c) for c in RAW_NOID)} FROM raw)
SELECT 'rows' AS metric, count(*) AS value FROM r
UNION ALL
SELECT 'duplicate_rows' AS metric, (SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS value
UNION ALL
SELECT 'numeric_duplicate_rows' AS metric,
       (SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(q(c) for c in RAW_NUM)} FROM r))
         AS value""")
def duplicate_counts(spark, sf_dir):
    """Exact duplicates and numeric-only duplicates of the raw table (without its row id)."""
    return profile.duplicate_counts(tables.raw_blast_table(spark, sf_dir).drop("event_id"))


@register("numeric_summary", f"""
WITH {S.RENAMED}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {r6(f'fsum({c})/count({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
    f"{r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'max({c})')} AS max, "
    f"{r6(f'skewness({c})')} AS skew FROM renamed" for c in NUM))
def numeric_summary(spark, sf_dir):
    """describe(): mean, sample std, min, exact median, max and bias-corrected skew per numeric column."""
    return finish(profile.numeric_summary(renamed(spark, sf_dir), NUM))


@register("quartile_bounds", f"""
WITH {S.RENAMED},
qs AS (""" + "\n UNION ALL\n".join(
    f" SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM renamed"
    for c in NUM) + f""")
SELECT "column", {r6('q25')} AS q25, {r6('q75')} AS q75, {r6('q75 - q25')} AS iqr,
       {r6('q25 - 1.5e0*(q75 - q25)')} AS lower, {r6('q75 + 1.5e0*(q75 - q25)')} AS upper FROM qs""")
def quartile_bounds(spark, sf_dir):
    return finish(quality.quartile_bounds(renamed(spark, sf_dir), NUM))


def _bounds_cte(cols):
    return ",\n".join(
        f"b_{c} AS (SELECT quantile_cont({c}, 0.25) - 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
        f"quantile_cont({c}, 0.75) + 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi, "
        f"avg({c}) AS mu, stddev_samp({c}) AS sd FROM renamed)" for c in cols)


@register("outlier_counts", f"""
WITH {S.RENAMED},
{_bounds_cte(NUM)}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", "
    f"(SELECT count(*) FROM renamed, b_{c} WHERE {c} < lo OR {c} > hi) AS iqr_outliers, "
    f"(SELECT count(*) FROM renamed, b_{c} WHERE abs(({c} - mu)/(sd + 1e-10)) > 3e0) AS zscore_outliers"
    for c in NUM))
def outlier_counts(spark, sf_dir):
    """IQR-fence and |z| > 3 outlier counts per numeric column, side by side (rows are kept)."""
    return quality.outlier_counts(renamed(spark, sf_dir), NUM)


FLAG_COLS = ["temperature_c", "ppv_mms", "psd_value", "acc_x_ms2"]


@register("iqr_flags", f"""
WITH {S.RENAMED},
{_bounds_cte(FLAG_COLS)}
SELECT event_id, {", ".join(f"coalesce({c} < b_{c}.lo OR {c} > b_{c}.hi, false) AS {c}_outlier" for c in FLAG_COLS)},
       {" + ".join(f"CAST(coalesce({c} < b_{c}.lo OR {c} > b_{c}.hi, false) AS INTEGER)" for c in FLAG_COLS)}
         AS n_outlier_columns
FROM renamed, {", ".join(f"b_{c}" for c in FLAG_COLS)}""")
def iqr_flags(spark, sf_dir):
    """Row-level IQR flags for four channels (bounds enter the projection as literals, no join)."""
    out = quality.iqr_flags(renamed(spark, sf_dir), FLAG_COLS)
    return out.select("event_id", *[f"{c}_outlier" for c in FLAG_COLS], "n_outlier_columns")


@register("value_counts_top5", f"""
WITH {S.RENAMED},
counts AS (""" + "\n UNION ALL\n".join(
    f" SELECT '{c}' AS \"column\", {q(c)} AS value, count(*) AS n FROM renamed GROUP BY {q(c)}" for c in TXT) + """),
u AS (SELECT "column", count(value) AS uniques, CAST(sum(n) AS BIGINT) AS rows FROM counts GROUP BY "column"),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM counts)
SELECT r."column", value, n, """ + r6("n*100e0/rows") + """ AS pct, rank, uniques
FROM r JOIN u ON r."column" = u."column" WHERE uniques <= 10 OR rank <= 5""")
def value_counts_top5(spark, sf_dir):
    """Value counts with NULLs per text column; top 5 when a column has more than 10 values."""
    out = profile.value_counts(renamed(spark, sf_dir), TXT)
    return finish(out.withColumn("rank", F.col("rank").cast("long")))


@register("label_distribution", f"""
WITH {CLEAN},
c AS (SELECT risk_label AS label, count(*) AS n FROM labelled GROUP BY risk_label)
SELECT label, n, {r6('n*100e0/sum(n) OVER ()')} AS pct,
       {r6('CASE WHEN min(n) OVER () > 0 THEN max(n) OVER ()*1e0/min(n) OVER () ELSE NULL END')} AS imbalance_ratio
FROM c""")
def label_distribution(spark, sf_dir):
    return finish(quality.label_distribution(clean.preprocess(tables.raw_blast_table(spark, sf_dir))))


PPV_RANGES = S.RENAMED + """,
ranges AS (
  SELECT CASE vibration_level WHEN 'Low' THEN 'NORMAL' WHEN 'Medium' THEN 'WARNING' WHEN 'High' THEN 'CRITICAL'
              ELSE vibration_level END AS label,
         min(ppv_mms) AS ppv_min, max(ppv_mms) AS ppv_max, avg(ppv_mms) AS ppv_mean, count(*) AS n
  FROM renamed WHERE vibration_level IS NOT NULL GROUP BY 1)"""


@register("ppv_by_label", f"""
WITH {PPV_RANGES}
SELECT label, {r6('ppv_min')} AS ppv_min, {r6('ppv_max')} AS ppv_max, {r6('ppv_mean')} AS ppv_mean, n FROM ranges""")
def ppv_by_label(spark, sf_dir):
    return finish(quality.ppv_by_label(renamed(spark, sf_dir)))


@register("leak_intervals", f"""
WITH {PPV_RANGES},
o AS (SELECT label, ppv_min, ppv_max, lead(ppv_min) OVER (ORDER BY ppv_min, label) AS next_min FROM ranges),
f AS (SELECT *, coalesce(next_min > ppv_max, true) AS disjoint_with_next FROM o)
SELECT label, {r6('ppv_min')} AS ppv_min, {r6('ppv_max')} AS ppv_max, {r6('next_min')} AS next_min,
       disjoint_with_next, min(CAST(disjoint_with_next AS INTEGER)) OVER () = 1 AS threshold_partition
FROM f""")
def leak_intervals(spark, sf_dir):
    """Exact leakage probe: per-label PPV ranges as disjoint intervals (a threshold partition)."""
    return finish(quality.leak_intervals(quality.ppv_by_label(renamed(spark, sf_dir))))


@register("range_checks", f"""
WITH {S.RENAMED}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {float(lo)!r}e0 AS low, {float(hi)!r}e0 AS high, "
    f"count(*) FILTER (WHERE {c} < {float(lo)!r}e0 OR {c} > {float(hi)!r}e0) AS out_of_range FROM renamed"
    for c, (lo, hi) in K.RANGE_RULES.items()).replace("1000000.0e0", "1e6"))
def range_checks(spark, sf_dir):
    """Physical range rules: count of values outside [low, high] per channel, all in one aggregate."""
    return finish(quality.range_checks(renamed(spark, sf_dir)))


@register("corr_pairs", f"""
WITH {S.RENAMED},
pairs AS (""" + "\n UNION ALL\n".join(
    f" SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM renamed"
    for i, a in enumerate(NUM) for b in NUM[i + 1:]) + f""")
SELECT column_a, column_b, {r6('r')} AS r FROM pairs WHERE abs(r) > 0.9e0""")
def corr_pairs(spark, sf_dir):
    """Highly correlated channel pairs (|r| > 0.90): one scan for ranges and means, one for the Gram matrix."""
    return finish(quality.corr_pairs(renamed(spark, sf_dir), NUM))


# --- files ----------------------------------------------------------------

@register("csv_roundtrip", f"""
WITH {CLEAN},
k AS (SELECT *, md5(concat(cast(event_id AS VARCHAR), '|42')) AS h FROM labelled),
s AS (SELECT *, row_number() OVER (PARTITION BY risk_label ORDER BY h, event_id)
                <= round(count(*) OVER (PARTITION BY risk_label)*0.2e0) AS is_test FROM k)
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, event_id,
       {", ".join(q(c) for c in TXT)}, {", ".join(f"{r6(c)} AS {c}" for c in NUM)}, risk_label
FROM s
UNION ALL
SELECT 'hardware' AS part, NULL, NULL, NULL, NULL, NULL,
       {", ".join(f"{r6(c)}" if c in K.RAW_CHANNELS else "NULL" for c in NUM)}, risk_label
FROM s""")
def csv_roundtrip(spark, sf_dir):
    """Export processed train/test (CSV) and the hardware projection (JSON), discover the files by
    extension, read them back with an explicit schema, and union by column name."""
    from pyspark.sql import types as T

    from tremorlake.operators import sampling
    from tremorlake.sources import files

    cleaned = clean.preprocess(tables.raw_blast_table(spark, sf_dir))
    split = sampling.stratified_split(cleaned, "risk_label", "event_id")
    base = scratch_dir(spark, "files")
    files.export(split.where(~F.col("is_test")).drop("is_test"), f"{base}/train", "csv")
    files.export(split.where(F.col("is_test")).drop("is_test"), f"{base}/test", "csv")
    files.export(features.hardware_projection(cleaned), f"{base}/hardware", "json")
    schema = T.StructType([T.StructField("event_id", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in ["timestamp", "blast_id"]]
                          + [T.StructField(c, T.DoubleType()) for c in ORDER[3:7]]
                          + [T.StructField("soil_type", T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in ORDER[8:18]]
                          + [T.StructField("vibration_level", T.StringType()),
                             T.StructField("risk_label", T.StringType())])
    parts = []
    for part in ["train", "test", "hardware"]:
        d = files.read_tables(spark, f"{base}/{part}", schema)
        parts.append(d.withColumn("part", F.lit(part)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return finish(out.select("part", "event_id", *TXT, *NUM, "risk_label"))


# --- dirty packets: NaN, infinities, NULL labels, a constant column --------

DIRTY_NUM = ["ppv_mms", "seismometer_ms2", "geophone_mms", "gain"]


@register("summary_dirty", f"""WITH {S.DIRTY}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
    f"{r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'max({c})')} AS max, "
    + (f"0e0 AS skew FROM dirty" if c == "gain" else f"{r6(f'skewness({c})')} AS skew FROM dirty")
    for c in DIRTY_NUM if c != "seismometer_ms2"))
def summary_dirty(spark, sf_dir):
    """describe() with NaN as missing and a constant column (skew 0)."""
    d = tables.dirty_packets(spark, sf_dir)
    return finish(profile.numeric_summary(d, [c for c in DIRTY_NUM if c != "seismometer_ms2"]))


@register("quantiles_dirty", f"""WITH {S.DIRTY}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {p!r}e0 AS p, {r6(f'quantile_disc({c}, {p!r})') if c != 'seismometer_ms2' else f'quantile_disc({c}, {p!r})'}"
    " AS value FROM dirty WHERE event_id >= 0" for c in ("ppv_mms", "gain") for p in (0.0, 1.0)) + """
UNION ALL SELECT 'seismometer_ms2', 0e0, CAST('-inf' AS DOUBLE)
UNION ALL SELECT 'seismometer_ms2', 1e0, CAST('inf' AS DOUBLE)""")
def quantiles_dirty(spark, sf_dir):
    """Smallest and largest values with NaN skipped and infinities ranked first and last."""
    from tremorlake.operators.quantiles import exact_quantiles

    d = tables.dirty_packets(spark, sf_dir)
    return finish(exact_quantiles(d, ["ppv_mms", "gain", "seismometer_ms2"], [0.0, 1.0], max_window_rows=100))


def _dirty_bounds(c: str) -> str:
    return (f"b_{c} AS (SELECT quantile_cont({c}, 0.25) - 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
            f"quantile_cont({c}, 0.75) + 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM dirty)")


DIRTY_FINITE = [c for c in DIRTY_NUM if c != "seismometer_ms2"]


@register("outliers_dirty", f"""WITH {S.DIRTY},
{", ".join(_dirty_bounds(c) for c in DIRTY_FINITE)}, {_dirty_bounds("seismometer_ms2")}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM dirty, b_{c} WHERE {c} < lo OR {c} > hi) AS iqr_outliers, "
    f"(SELECT count(*) FROM dirty, (SELECT avg({c}) AS mu, stddev_samp({c}) AS sd FROM dirty) "
    f"WHERE abs(({c} - mu)/(sd + 1e-10)) > 3e0) AS zscore_outliers" for c in DIRTY_FINITE) + """
UNION ALL
SELECT 'seismometer_ms2', (SELECT count(*) FROM dirty, b_seismometer_ms2 WHERE seismometer_ms2 < lo OR seismometer_ms2 > hi),
       0""")
def outliers_dirty(spark, sf_dir):
    """Outliers with NaN never flagged and infinities outside the IQR fences (their z-scores are undefined)."""
    return quality.outlier_counts(tables.dirty_packets(spark, sf_dir), DIRTY_NUM)


@register("corr_dirty", f"""WITH {S.DIRTY},
f AS (SELECT ppv_mms, finite_seismometer AS seismometer_ms2, geophone_mms, temperature_c FROM dirty),
pairs AS (SELECT 'ppv_mms' AS column_a, 'geophone_mms' AS column_b, corr(ppv_mms, geophone_mms) AS r FROM f
UNION ALL SELECT 'ppv_mms', 'temperature_c', corr(ppv_mms, temperature_c) FROM f
UNION ALL SELECT 'geophone_mms', 'temperature_c', corr(geophone_mms, temperature_c) FROM f)
SELECT column_a, column_b, {r6('r')} AS r FROM pairs""")
def corr_dirty(spark, sf_dir):
    """All pairs with NaN rows skipped pairwise; the constant column and the one with infinities have none."""
    cols = ["ppv_mms", "seismometer_ms2", "geophone_mms", "temperature_c", "gain"]
    return finish(quality.corr_pairs(tables.dirty_packets(spark, sf_dir), cols, limit=-1.0))


@register("ranges_dirty", f"""WITH {S.DIRTY}
SELECT 'ppv_mms' AS "column", 0e0 AS low, 1e0 AS high, count(*) FILTER (WHERE ppv_mms > 1e0) AS out_of_range FROM dirty""")
def ranges_dirty(spark, sf_dir):
    return finish(quality.range_checks(tables.dirty_packets(spark, sf_dir), {"ppv_mms": (0.0, 1.0)}))


@register("csv_mixed_headers", f"""WITH {S.TELEMETRY}
SELECT event_id, node_id, CASE WHEN event_id % 29 <> 0 THEN {r6('ppv_mms')} END AS ppv_mms FROM telemetry
WHERE event_id IS NOT NULL""")
def csv_mixed_headers(spark, sf_dir):
    """CSV files of one folder with different column orders and extension cases, read by column name."""
    from tremorlake.sources import files

    t = tables.telemetry(spark, sf_dir)
    t = t.withColumn("ppv_mms", F.when(F.col("event_id") % 29 == 0, F.lit("NaN")).otherwise(F.col("ppv_mms").cast("string")))
    base = scratch_dir(spark, "mixed")
    files.export(t.where("event_id % 2 = 0").select("event_id", "node_id", "ppv_mms"), f"{base}/a", "csv")
    files.export(t.where("event_id % 2 = 1").select("ppv_mms", "event_id", "node_id"), f"{base}/b", "csv")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/all"))
    for part, ext in (("a", "csv"), ("b", "CSV")):
        for i, f in enumerate(files.find_data_files(spark, f"{base}/{part}")):
            fs.rename(path(f), path(f"{base}/all/{part}{i}.{ext}"))
    return finish(files.read_tables(spark, f"{base}/all").select(
        F.col("event_id").cast("long").alias("event_id"), "node_id", "ppv_mms"))


CELLS_SQL = S.TELEMETRY + """,
lines AS (
  SELECT event_id, node_id, temperature_c, ppv_mms,
         event_id % 23 = 0 AS bad_ppv, event_id % 31 = 0 AS bad_temperature, event_id % 41 = 0 AS bad_cells,
         event_id % 29 = 0 AS no_ppv
  FROM telemetry)"""


def _malformed_lines(spark, sf_dir) -> str:
    """Telemetry as Latin-1 CSV with broken cells: text for a number, a decimal comma, short and long lines."""
    t = tables.telemetry(spark, sf_dir)
    eid = F.col("event_id")
    ppv = (F.when(eid % 23 == 0, F.lit("sensor?")).when(eid % 29 == 0, F.lit("NaN"))
           .otherwise(F.col("ppv_mms").cast("string")))
    temperature = F.when(eid % 31 == 0, F.lit('"20,5"')).otherwise(F.col("temperature_c").cast("string"))
    text = F.concat_ws(",", eid.cast("string"), "node_id", temperature, ppv)
    text = F.when(eid % 82 == 0, F.concat(text, F.lit(",9"))).when(eid % 41 == 0, F.concat_ws(",", eid, "node_id")).otherwise(text)
    path = scratch_dir(spark, "malformed")
    # a single column without quoting: its name is the header line, its values are the lines
    t.select(text.alias("event_id,node_id,Temperature(°C),ppv_mms")).write \
        .options(header="true", sep="\u0001", quote="", encoding="ISO-8859-1").csv(path)
    return path


def _checked_lines(spark, sf_dir):
    from tremorlake.sources import files

    path = _malformed_lines(spark, sf_dir)
    schema = "event_id long, node_id string, `Temperature(°C)` double, ppv_mms double"
    return files.read_csv_checked(spark, files.find_data_files(spark, path), T.StructType.fromDDL(schema),
                                  encoding="ISO-8859-1")


@register("csv_checked_rows", f"""WITH {CELLS_SQL}
SELECT event_id, node_id, {r6('temperature_c')} AS temperature_c, CASE WHEN NOT no_ppv THEN {r6('ppv_mms')} END AS ppv_mms
FROM lines WHERE NOT bad_ppv AND NOT bad_temperature AND NOT bad_cells""")
def csv_checked_rows(spark, sf_dir):
    """The lines of a Latin-1 CSV that parse cell by cell; a missing reading stays NULL."""
    rows = _checked_lines(spark, sf_dir).rows
    return finish(rows.withColumnRenamed("Temperature(°C)", "temperature_c"))


@register("csv_rejected_lines", f"""WITH {CELLS_SQL}
SELECT event_id,
       concat_ws(',', CASE WHEN bad_cells THEN 'number of cells' END,
                 CASE WHEN bad_temperature AND (NOT bad_cells OR event_id % 82 = 0) THEN 'Temperature(°C)=20,5' END,
                 CASE WHEN bad_ppv AND (NOT bad_cells OR event_id % 82 = 0) THEN 'ppv_mms=sensor?' END) AS reasons
FROM lines WHERE bad_ppv OR bad_temperature OR bad_cells""")
def csv_rejected_lines(spark, sf_dir):
    """The lines that do not parse, each with all its reasons (column and text, or the number of cells)."""
    bad = _checked_lines(spark, sf_dir).rejected
    told = F.transform("reasons", lambda r: F.when(r["column"].isNull(), r["problem"])
                       .otherwise(F.concat_ws("=", r["column"], r["text"])))
    return bad.select(F.split_part("line", F.lit(","), F.lit(1)).cast("long").alias("event_id"),
                      F.array_join(told, ",").alias("reasons"))


SKETCHED = ["event_id", "node_id", "event_type", "ppv_mms", "temperature_c", "psd_value"]
SKETCHED_NUM = [c for c in SKETCHED if c not in ("node_id", "event_type")]


@register("profile_by_day", f"WITH {S.TELEMETRY}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
    + (f"{r6(f'CAST(min({c}) AS DOUBLE)')} AS least, {r6(f'CAST(max({c}) AS DOUBLE)')} AS most, "
       if c in SKETCHED_NUM else "CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most, ")
    + "true AS uniques_near, true AS median_near FROM telemetry WHERE day(ts) <= 15" for c in SKETCHED))
def profile_by_day(spark, sf_dir):
    """Profile of the first halves of all months from stored daily sketches; one day is written twice.

    ``uniques_near``: within 4 % of the exact count; ``median_near``: its rank within 2 % of the middle.
    """
    from tremorlake.operators import sketches

    t = tables.telemetry(spark, sf_dir).withColumn("day", F.to_date("ts"))
    path = scratch_dir(spark, "sketches")
    daily = sketches.sketch_by_day(t.select("day", *SKETCHED), F.col("day"))
    sketches.save_sketches(daily, path)
    last = t.agg(F.max("day")).first()[0]  # a day that comes again replaces itself
    sketches.save_sketches(sketches.sketch_by_day(t.where(F.col("day") == F.lit(last)).select("day", *SKETCHED), F.col("day")), path)
    some = materialize(sketches.united(sketches.read_sketches(spark, path).where("dayofmonth(day) <= 15")), "united")
    half = t.where("dayofmonth(day) <= 15").select(*SKETCHED)
    exact = profile.column_profile(half).select("column", F.col("uniques").alias("exact"))
    medians = {r["column"]: r["quantiles"][1] for r in some.collect() if r["quantiles"]}  # one row a column
    ranks = half.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.avg((F.col(c) < F.lit(medians.get(c))).cast("double")).alias("below"),
                 F.avg((F.col(c) <= F.lit(medians.get(c))).cast("double")).alias("upto")).alias(c) for c in SKETCHED_NUM])
    near = ranks.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), ((F.col(c)["below"] <= 0.52) & (F.col(c)["upto"] >= 0.48)).alias("near"))
        for c in SKETCHED_NUM])).alias("r")).select("r.*")
    out = some.where(F.col("column") != "day").join(F.broadcast(exact), "column").join(F.broadcast(near), "column", "left")
    return finish(out.select("column", "rows", "missing", "least", "most",
                             (F.abs(F.col("uniques") - F.col("exact")) <= 0.04 * F.col("exact")).alias("uniques_near"),
                             F.coalesce("near", F.lit(True)).alias("median_near")))


TOP_COLS = ["node_id", "event_type", "event_id", "stamp"]


@register("top_values", f"""WITH {S.COMPACT},
t AS (SELECT node_id, CAST(event_id % 7 AS VARCHAR) AS event_type, CAST(event_id AS VARCHAR) AS event_id,
             "timestamp" AS stamp FROM compact),
counts AS (""" + "\n UNION ALL\n".join(
    f" SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM t GROUP BY {c}" for c in TOP_COLS) + """)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM counts)
WHERE rank <= 5""")
def top_values(spark, sf_dir):
    """Five most frequent values of columns with few, many and only distinct values; NULL counts as a value."""
    from tremorlake.operators import sketches

    p = tables.compact_packets(spark, sf_dir).select(
        "node_id", (F.col("event_id") % 7).cast("string").alias("event_type"), F.col("event_id").cast("string"),
        F.col("timestamp").alias("stamp"))
    return sketches.top_values(p, TOP_COLS).withColumn("rank", F.col("rank").cast("long"))
