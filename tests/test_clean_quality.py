"""Cleaning, store, exact quantiles, profiling and quality checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import clean, profile, quality
from tremorlake.operators.quantiles import exact_quantiles
from tremorlake.session import scratch_dir
from tremorlake.sources import store


def test_header_normaliser():
    assert clean.normalize_name(" Wind Speed (m/s) ") == "wind_speed__m_s"
    assert clean.normalize_name("Temp(°C)") == "temp_c"
    assert clean.normalize_name("Area(m²)") == "area_m2"


def test_normaliser_column_matches_python(spark):
    names = [" Wind Speed (m/s) ", "Temp(°C)", "Area(m²)", "PPV(mm/s)", "X"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(clean.normalize_name_column(F.col("n"))).collect()]
    assert got == [clean.normalize_name(n) for n in names]


def test_canonical_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "Low")], "`PPV(mm/s)` double, `Odd Col(x)` double, Vibration_Level string")
    assert clean.canonical_names(df).columns == ["ppv_mms", "odd_col_x", "vibration_level"]


def test_mode_ties_smallest_and_median(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("b", 3.0), ("a", 2.0), (None, 10.0)], "s string, x double")
    assert clean.modes(df, ["s"]) == {"s": "a"}  # a and b tie -> smallest
    out = clean.impute_median(clean.impute_mode(df)).orderBy("x").collect()
    assert sorted(r["x"] for r in out) == [1.0, 2.0, 2.5, 3.0, 10.0]
    assert [r["s"] for r in out].count(None) == 0


def test_labels(spark):
    df = spark.createDataFrame([("Low",), ("Medium",), ("High",), ("Unknown",), (None,)], "vibration_level string")
    assert [r[0] for r in clean.with_label(df).select("risk_label").collect()] == [
        "NORMAL", "WARNING", "CRITICAL", "WARNING", "WARNING"]
    assert clean.with_label(spark.range(1)).first()["risk_label"] == "NORMAL"


@pytest.mark.parametrize("bins,window", [(4096, 250_000), (4, 7)])
def test_exact_quantiles_match_numpy(spark, bins, window):
    rng = np.random.default_rng(3)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.34, 7.0, rng.exponential(size=3000))  # a third of rows one hot value
    c = np.where(rng.random(3000) < 0.1, np.nan, rng.integers(0, 5, 3000).astype(float))
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["column"], r["p"]): r["value"]
           for r in exact_quantiles(df, ["a", "b", "c"], probs, bins=bins, max_window_rows=window).collect()}
    for col in "abc":
        for p in probs:
            assert got[(col, p)] == pytest.approx(pdf[col].quantile(p), rel=1e-12, abs=1e-12), (col, p)


def test_store_round_trip(spark):
    # X3 fixture: one observation, blast parameters absent -> 0.0, label kept
    row = dict(timestamp="2026-01-01T00:00:00", blast_id="B1", soil_type="Clay", temperature_c=25.0,
               seismometer_ms2=0.5, geophone_mms=1.0, acc_x_ms2=0.1, acc_y_ms2=0.1, acc_z_ms2=0.1, psd_value=0.2,
               ppv_mms=1.0, frequency_hz=20.0, vibration_level="Low", risk_label="NORMAL")
    path = scratch_dir(spark, "test-store")
    assert store.write_observations(spark.createDataFrame([row]), path) == 1
    back = store.read_observations(spark, path).first()
    assert back["risk_label"] == "NORMAL" and back["charge_weight_kg"] == 0.0 and back["wind_speed_ms"] == 0.0
    assert back["timestamp"].year == 2026 and back["id"] is not None and back["created_at"] is not None
    bad = store.coerce(spark.createDataFrame([("not-a-time",)], "timestamp string")).first()
    assert bad["timestamp"] is None and bad["blast_id"] == "" and bad["ppv_mms"] == 0.0


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "x int, s string")
    prof = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert prof["s"]["missing"] == 1 and prof["s"]["uniques"] == 2 and prof["x"]["uniques"] == 3
    assert prof["x"]["rows"] == 4 and prof["x"]["n_columns"] == 2
    d = {r["metric"]: r["value"] for r in profile.duplicate_counts(df).collect()}
    assert d == {"rows": 4, "duplicate_rows": 1, "numeric_duplicate_rows": 1}


def test_categories():
    assert profile.categorize_name("Vibration_Level") == "Target / Risk / Labels"
    assert profile.categorize_name("Acc_X(m/s²)") == "Vibration / Acceleration"
    assert profile.categorize_name("PPV(mm/s)") == "PPV (Peak Particle Velocity)"
    assert profile.categorize_name("Geology") == "Soil / Geological Parameters"
    assert profile.categorize_name("event_id") is None


def test_value_counts_top5(spark):
    vals = [f"v{i:02d}" for i in range(12) for _ in range(i + 1)] + [None] * 3
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    rows = profile.value_counts(df, ["s"]).orderBy("rank").collect()
    assert [r["value"] for r in rows] == ["v11", "v10", "v09", "v08", "v07"]
    assert rows[0]["uniques"] == 12


def test_outliers_and_ranges(spark):
    x = [float(i) for i in range(20)] + [100.0]
    df = spark.createDataFrame([(v, v - 60.0) for v in x], "x double, acc_x_ms2 double")
    oc = {r["column"]: r for r in quality.outlier_counts(df, ["x"]).collect()}
    s = pd.Series(x)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert oc["x"]["iqr_outliers"] == int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
    z = ((s - s.mean()) / (s.std() + 1e-10)).abs()
    assert oc["x"]["zscore_outliers"] == int((z > 3).sum())
    rc = {r["column"]: r["out_of_range"] for r in quality.range_checks(df).collect()}
    assert rc == {"acc_x_ms2": 10}


def test_correlation_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(scale=0.01, size=200), "c": rng.normal(size=200)})
    pdf.loc[5, "b"] = np.nan
    out = {(r["column_a"], r["column_b"]): r["r"] for r in quality.corr_pairs(spark.createDataFrame(pdf).replace(
        float("nan"), None), ["a", "b", "c"], limit=-1.0).collect()}
    ref = pdf.corr()
    for (x, y), r in out.items():
        assert r == pytest.approx(ref.loc[x, y], abs=1e-12)


def test_reports_and_metadata_echo(spark):
    from tremorlake.sources import tables

    from paths import SF001

    raw = clean.canonical_names(tables.raw_blast_table(spark, SF001))
    rep = profile.profile_table(raw, key="event_id")
    assert set(rep) == {"shape", "preview", "columns", "duplicates", "domains", "numeric", "value_counts"}
    assert rep["preview"].count() == 5 and rep["shape"].first()["rows"] == raw.count()
    q = quality.report(raw.drop("event_id"))
    assert {"outliers", "ranges", "labels", "leak_intervals"} <= set(q)
    assert q["ranges"].where("column = 'temperature_c'").first()["out_of_range"] > 0
    assert profile.categorize_columns(["Blast_ID", "risk", "zzz"])["Blast / Mining Operations"] == ["Blast_ID"]
    df = spark.createDataFrame([("None", None), ("N1", "2026-01-01T00:00:00"), (None, "None")], "node_id string, timestamp string")
    rows = clean.echo_metadata(df).collect()
    assert rows[0]["node_id"] is None and rows[0]["timestamp"].endswith("Z")
    assert rows[1]["timestamp"] == "2026-01-01T00:00:00" and rows[2]["node_id"] is None


def test_profile_distinct_counts_match_count_distinct(spark):
    """Distinct counts: -0.0 = 0.0, NaN and NULL missing, float, timestamp and array columns."""
    df = spark.createDataFrame(
        [(0.0, 1.5, "a", [1, 2]), (-0.0, 1.5, "a", [1, 2]), (float("nan"), None, None, [2, 1]),
         (float("nan"), 2.5, "b", None), (None, -0.0, "", [1]), (3.0, 0.0, "a", [1])],
        "d double, f float, s string, arr array<int>").withColumn("t", F.current_timestamp())
    got = {r["column"]: r["uniques"] for r in profile.column_profile(df).collect()}
    want = df.agg(*[F.count_distinct(F.nanvl(c, F.lit(None)) if c in "df" else F.col(c)).alias(c)
                    for c in df.columns]).first().asDict()
    assert got == want
    assert got["d"] == 2 and got["f"] == 3 and got["s"] == 3 and got["arr"] == 3
    missing = {r["column"]: r["missing"] for r in profile.column_profile(df).collect()}
    assert missing == {"d": 3, "f": 1, "s": 1, "arr": 1, "t": 0}
    about = {r["column"]: r["missing"] for r in profile.column_profile(df, exact=False).collect()}
    assert about == missing


def test_quantiles_of_infinite_and_huge_values_end(spark):
    """Infinities rank first and last; intervals wider than the largest double still shrink."""
    rng = np.random.default_rng(5)
    vals = rng.normal(size=400).tolist() + [float("inf")] * 7 + [float("-inf")] * 3 + [1.7e308, -1.7e308, float("nan")]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.004, 0.25, 0.5, 1.0], bins=4,
                                                       max_window_rows=10).collect()}
    keep = np.sort([v for v in vals if v == v])
    assert got[0.0] == -np.inf and got[1.0] == np.inf and got[0.004] == -np.inf
    for p in (0.25, 0.5):
        assert got[p] == pytest.approx(np.quantile(keep, p))


def test_reports_skip_nan_and_constant_columns(spark):
    rows = [(float(i % 10), float("nan") if i == 3 else float(i % 10) * 2, 1.0) for i in range(100)] + [(500.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    out = {r["column"]: r for r in quality.outlier_counts(df).collect()}
    assert out["a"]["iqr_outliers"] == 1 and out["b"]["iqr_outliers"] == 0 and out["b"]["zscore_outliers"] == 0
    pairs = {(r["column_a"], r["column_b"]): r["r"] for r in quality.corr_pairs(df, limit=-1.0).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "k"])
    assert set(pairs) == {("a", "b")} and pairs[("a", "b")] == pytest.approx(pdf["a"].corr(pdf["b"]))
    s = {r["column"]: r for r in profile.numeric_summary(df).collect()}
    assert s["k"]["skew"] == 0 and s["b"]["n"] == 100 and s["b"]["skew"] == pytest.approx(pdf["b"].skew())
    filled = clean.impute_median(df).collect()
    assert filled[3]["b"] == pytest.approx(pdf["b"].median())
    from tremorlake.operators.model import standardize

    assert {r["k"] for r in standardize(df, ["a", "k"]).collect()} == {0.0}


def test_csv_files_are_read_by_name(spark, tmp_path):
    from tremorlake.sources import files

    (tmp_path / "one.csv").write_text("a,b\n1,2.5\n2,NaN\n")
    (tmp_path / "two.CSV").write_text("b,a\n7.5,3\n")
    (tmp_path / "three.csv").write_bytes("a,temp(°C)\n4,20\n".encode("latin-1"))
    df = files.read_tables(spark, str(tmp_path), encoding="ISO-8859-1")
    got = {r["a"]: (r["b"], r["temp(°C)"]) for r in df.collect()}
    assert got == {1: (2.5, None), 2: (None, None), 3: (7.5, None), 4: (None, 20)}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    typed = files.read_tables(spark, str(tmp_path), schema, encoding="ISO-8859-1")
    assert {r["a"]: r["b"] for r in typed.collect()} == {1: "2.5", 2: "NaN", 3: "7.5", 4: None}


def test_store_replaces_as_a_whole(spark, tmp_path):
    from tremorlake.sources import store

    path = str(tmp_path / "store")
    rows = [(f"2026-01-0{1 + i % 3}T00:00:00", float(i)) for i in range(60)] + [("bad", 1.0)]
    df = spark.createDataFrame(rows, "timestamp string, ppv_mms double").repartition(8)
    assert store.write_observations(df, path) == 61 and store.write_observations(df.limit(10), path) == 10
    back = store.read_observations(spark, path)
    assert back.count() == 10 and back.select("id").distinct().count() == 10
    import glob

    first = max((d for d in glob.glob(f"{path}/data/batch=*")), key=lambda d: len(glob.glob(f"{d}/*/*.parquet")))
    assert all(len(glob.glob(f"{d}/*.parquet")) <= 2 for d in glob.glob(f"{first}/obs_date=*"))


def _observations(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, blast_id string, ppv_mms double").repartition(5)


def test_store_appends_with_dense_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_observations(spark, path).count() == 0
    day = lambda n: f"2026-01-{1 + n % 5:02d}T00:00:{n % 60:02d}"
    assert store.append_observations(_observations(spark, [(day(i), f"b{i}", float(i)) for i in range(300)]), path) == 300
    assert store.append_observations(_observations(spark, [("bad", None, 1.0)] * 40), path) == 40
    assert store.append_observations(_observations(spark, []), path) == 0
    back = store.read_observations(spark, path)
    assert sorted(r["id"] for r in back.collect()) == list(range(1, 341))
    assert back.where("obs_date IS NULL").count() == 40
    assert back.where("obs_date = DATE'2026-01-02'").count() == 60
    plan = back.where("obs_date = DATE'2026-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_date" in plan


def test_store_upsert_replaces_by_key(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [("2026-01-01T00:00:00", "a", 1.0), ("2026-01-01T00:00:00", "b", 2.0), ("2026-01-02T00:00:00", "a", 3.0),
             ("2026-01-01T00:00:00", None, 4.0), ("bad", "a", 5.0)]
    store.write_observations(_observations(spark, first), path)
    ids = {(r["obs_date"], r["blast_id"]): r["id"] for r in store.read_observations(spark, path).collect()}
    news = [("2026-01-01T00:00:00", "a", 10.0), ("2026-01-01T00:00:00", "a", 11.0), ("2026-01-03T00:00:00", "c", 6.0),
            ("2026-01-01T00:00:00", None, 7.0), ("worse", "a", 8.0)]
    assert store.upsert_observations(_observations(spark, news), path) == (1, 3)
    rows = store.read_observations(spark, path).collect()
    assert sorted((str(r["obs_date"]), r["blast_id"] or "", r["ppv_mms"]) for r in rows) == sorted([
        ("2026-01-01", "a", 11.0), ("2026-01-01", "b", 2.0), ("2026-01-02", "a", 3.0), ("2026-01-01", "", 4.0),
        ("2026-01-01", "", 7.0), ("None", "a", 5.0), ("None", "a", 8.0), ("2026-01-03", "c", 6.0)])
    assert sorted(r["id"] for r in rows) == list(range(1, 9))
    assert {ids[k] for k in ids} == {r["id"] for r in rows if r["ppv_mms"] in (11.0, 2.0, 3.0, 4.0, 5.0)}
    # the same rows again change nothing but those without a key
    assert store.upsert_observations(_observations(spark, news[:3]), path) == (2, 0)
    assert store.read_observations(spark, path).count() == 8
    with pytest.raises(ValueError):
        store.upsert_observations(_observations(spark, news), path, keys=("blast_id",))


def test_store_of_two_writers_one_fails_cleanly(spark, tmp_path):
    import glob

    path = str(tmp_path / "store")
    store.write_observations(_observations(spark, [("2026-01-01T00:00:00", "a", 1.0)]), path)
    seen = store.latest(spark, path)
    more = _observations(spark, [("2026-01-01T00:00:00", "b", 2.0)])
    assert store.append_observations(more, path, base=seen) == 1
    before = sorted(glob.glob(f"{path}/**", recursive=True))
    for lose in (store.append_observations, store.upsert_observations):
        with pytest.raises(store.StoreConflict):
            lose(more, path, base=seen)
    assert sorted(glob.glob(f"{path}/**", recursive=True)) == before  # nothing of the losers stays
    assert {(r["id"], r["blast_id"]) for r in store.read_observations(spark, path).collect()} == {(1, "a"), (2, "b")}
    # earlier versions can be read until they expire, then their folders go
    assert store.read_observations(spark, path, seen.number).count() == 1
    for i in range(3):
        store.write_observations(more, path)
    assert len(glob.glob(f"{path}/data/batch=*")) == 2 and len(glob.glob(f"{path}/snapshots/*.json")) == 2
    assert store.read_observations(spark, path).count() == 1


def test_quantile_seeds_from_report_aggregates(spark):
    """Seeding the search with n / min / max from a caller's aggregate gives the unseeded result
    (NaN and NULL skipped, a hot value holding a third of the rows, several histogram passes)."""
    from tremorlake.operators.quantiles import stat_aggs, stats_from_row

    rng = np.random.default_rng(7)
    a = rng.normal(size=3000)
    a[::3] = 0.25  # hot value
    b = rng.exponential(size=3000)
    b[::50] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("a") > 1.5, None).otherwise(F.col("b")))
    probs = [0.1, 0.25, 0.5, 0.75]
    stats = stats_from_row(df.agg(*stat_aggs(["a", "b"])).first(), ["a", "b"])
    kw = dict(bins=8, max_window_rows=50)
    seeded = sorted(exact_quantiles(df, ["a", "b"], probs, stats=stats, **kw).collect())
    plain = sorted(exact_quantiles(df, ["a", "b"], probs, **kw).collect())
    assert seeded == plain
    vals = df.toPandas()
    for r in seeded:
        col = vals[r["column"]].dropna().to_numpy()
        assert r["value"] == pytest.approx(np.quantile(col, r["p"]), abs=1e-12)


def test_report_counts_rows_on_both_sides(spark):
    train = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, None), (5.0, 6.0)], "ppv_mms double, vdv double")
    test = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 7.0)], "ppv_mms double, vdv double")
    rep = quality.report(train.unionByName(test), train=train, test=test)
    assert rep["train_test_overlap"].first()["shared_rows"] == 2
    assert "leak_tree" not in rep and "energy_probe" not in rep


def test_report_has_both_leak_probes(spark):
    df = spark.range(400).select(
        (F.col("id") % 60 / 10).alias("PPV(mm/s)"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 60 < 20, F.lit("Low"))
        .when(F.col("id") % 60 < 40, F.lit("Medium")).otherwise(F.lit("High")).alias("Vibration_Level")) \
        .withColumn("kinetic_energy_proxy", F.pow("PPV(mm/s)", F.lit(2)) / 2)
    rep = quality.report(df, ["PPV(mm/s)"])
    assert rep["leak_tree"].first()["leak_detected"] and rep["energy_probe"].first()["energy_is_ppv"]
    noisy = df.withColumn("PPV(mm/s)", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(997)) / 100)
    rep = quality.report(noisy, ["PPV(mm/s)"])
    assert not rep["leak_tree"].first()["leak_detected"] and not rep["energy_probe"].first()["energy_is_ppv"]
    gap = df.withColumn("kinetic_energy_proxy", F.when(F.col("PPV(mm/s)") > 0.1, F.col("kinetic_energy_proxy")))
    assert not quality.report(gap, ["PPV(mm/s)"])["energy_probe"].first()["energy_is_ppv"]
    unlabelled = df.withColumn("Vibration_Level", F.lit(None).cast("string"))
    assert "leak_tree" not in quality.report(unlabelled, ["PPV(mm/s)"])


def test_moments_do_not_depend_on_the_order(spark):
    import math
    from fractions import Fraction

    from tremorlake.operators.moments import moments
    from tremorlake.operators.quantiles import column_stats

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"tax": rng.integers(0, 9, 4000) / 100, "offset": 1e6 + rng.normal(0, 0.1, 4000),
                        "wide": rng.normal(0, 1, 4000) * 10.0 ** rng.integers(-8, 9, 4000),
                        "huge": rng.choice([-1.7e308, 1.7e308, 0.3], 4000), "still": 4.25})
    df, cols = spark.createDataFrame(pdf), list(pdf.columns)
    stats = column_stats(df, cols)
    found = [moments(df.repartition(n, "wide").sortWithinPartitions(F.xxhash64("wide", F.lit(n))), cols, stats)
             for n in (1, 3, 4, 8)]
    assert all(repr(f) == repr(found[0]) for f in found)
    for c in ("tax", "offset", "wide"):
        assert found[0][c]["mean"] == math.fsum(pdf[c]) / len(pdf)
    assert found[0]["huge"]["mean"] == pytest.approx(float(sum(map(Fraction, pdf["huge"].tolist())) / len(pdf)))
    for c in ("tax", "offset", "wide"):
        assert found[0][c]["std"] == pytest.approx(pdf[c].std(), rel=1e-9)
        assert found[0][c]["skew"] == pytest.approx(pdf[c].skew(), rel=1e-6, abs=1e-9)
    assert found[0]["still"] == {"n": 4000, "mean": 4.25, "std": 0.0, "skew": 0.0}


def test_moments_of_few_and_infinite_values(spark):
    from tremorlake.operators.profile import numeric_summary

    df = spark.createDataFrame([(1.0, None, float("inf"), 5.0), (2.0, None, 1.0, None)],
                               "two double, none double, inf double, one double")
    got = {r["column"]: r for r in numeric_summary(df).collect()}
    assert (got["two"]["mean"], got["two"]["skew"]) == (1.5, None) and got["two"]["std"] == pytest.approx(0.5 ** 0.5)
    assert [got["none"][k] for k in ("n", "mean", "std", "min", "median", "max", "skew")] == [0] + [None] * 6
    assert (got["one"]["n"], got["one"]["mean"], got["one"]["std"]) == (1, 5.0, None)
    assert (got["inf"]["mean"], got["inf"]["max"], got["inf"]["min"]) == (float("inf"), float("inf"), 1.0)


def test_filters_reach_the_scan(spark):
    from paths import SF001
    from tremorlake.sources import tables

    plan = tables.table(spark, SF001, "lineitem").filter("l_quantity > 49")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan


def test_correlation_with_gaps_matches_pandas(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(0, 1, (500, 4)), columns=list("abcd"))
    pdf["b"] = pdf["a"] * 0.9 + pdf["b"] * 0.1 + 1e6
    pdf.loc[rng.random(500) < 0.3, "b"] = None
    pdf.loc[rng.random(500) < 0.5, "c"] = None
    pdf["e"] = np.where(pdf["c"].isna(), rng.normal(0, 1, 500), 7.0)  # constant wherever c is present
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)],
                               "a double, b double, c double, d double, e double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in quality.corr_pairs(df, limit=-1.0).collect()}
    ref = pdf.corr()
    assert ("c", "e") not in got and len(got) == 9
    assert all(r == pytest.approx(ref.loc[a, b], abs=1e-9) for (a, b), r in got.items())


def test_csv_cells_never_turn_to_null_unseen(spark, tmp_path):
    from pyspark.sql import types as T

    from tremorlake.sources import files

    schema = T.StructType.fromDDL("a long, b double, t timestamp, s string, absent double")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b,t,s\n1,2.5,2026-01-01 00:00:00,x\n2,NA,,n/a\n\n"
                                       b"x,1d,never,y\n3,2\n4,1,,\"p,q\",9\n")
    (tmp_path / "other.csv").write_text("s,extra,a\nz,7,5\nz,bad,5.5\n")
    got = files.read_csv_checked(spark, files.find_data_files(spark, str(tmp_path)), schema)
    rows = {r["a"]: (r["b"], r["t"] is not None, r["s"], r["absent"]) for r in got.rows.collect()}
    assert rows == {1: (2.5, True, "x", None), 2: (None, False, None, None), 5: (None, False, "z", None)}
    bad = {(r["file"].rsplit("/", 1)[1], tuple((x["column"], x["text"]) for x in r["reasons"])): r["line"]
           for r in got.rejected.collect()}
    assert bad == {("bom.csv", (("a", "x"), ("b", "1d"), ("t", "never"))): "x,1d,never,y",
                   ("bom.csv", ((None, None),)): bad[("bom.csv", ((None, None),))],
                   ("other.csv", (("a", "5.5"),)): "z,bad,5.5"}
    assert got.rejected.count() == 4 and got.rejected.select("line").where("line LIKE '4,%9' OR line = '3,2'").count() == 2
    # what a query asks for does not change which lines pass
    assert got.rows.select("s").count() == 3
    none = files.read_csv_checked(spark, [], schema)
    assert none.rows.columns == schema.names and none.rows.count() == 0 and none.rejected.count() == 0
