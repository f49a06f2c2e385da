"""Model scoring contract, golden batch, streaming = batch, driver contract and oracle spot checks."""

import pytest
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators import clean, features, model
from tremorlake.plans import q_model
from tremorlake.session import scratch_dir
from tremorlake.streaming import packets

from paths import SF001, SF01

# FIXED VALUES: the six hardware test packets (node, 9 raw channels) and their expected labels
GOLDEN = [
    ("ESP32_NODE_01", 0.03, 0.04, 0.05, 24.2, 0.95, 20.5, 0.18, 1.20, 0.85, "NORMAL"),
    ("ESP32_NODE_01", 0.04, 0.03, 0.05, 24.5, 1.45, 22.0, 0.22, 1.40, 0.92, "NORMAL"),
    ("ESP32_NODE_02", 0.06, 0.05, 0.07, 26.8, 2.75, 28.5, 0.31, 1.85, 1.45, "WARNING"),
    ("ESP32_NODE_02", 0.07, 0.06, 0.08, 27.4, 3.40, 31.2, 0.35, 2.10, 1.60, "WARNING"),
    ("ESP32_NODE_03", 0.08, 0.09, 0.09, 31.5, 4.35, 42.0, 0.42, 2.65, 2.10, "CRITICAL"),
    ("ESP32_NODE_03", 0.09, 0.09, 0.09, 33.0, 4.85, 46.5, 0.48, 2.85, 2.35, "CRITICAL"),
]
RAW9 = "node_id string, " + ", ".join(f"{c} double" for c in K.RAW_CHANNELS) + ", expected string"


@pytest.fixture(scope="module")
def forest(spark):
    return q_model.forest(spark, SF01)


def test_scoring_contract(spark, forest):
    df = spark.createDataFrame([("ESP32_NODE_01", .04, .03, .05, 24.5, 1.45, 22.0, .22, 1.40, .92, "")], RAW9)
    r = model.predict(forest, df, K.FOREST_NAME, keep=["node_id"]).first()
    assert r["risk_level"] in K.CLASSES and 0 <= r["confidence"] <= 1
    assert sum(r["probabilities"].values()) == pytest.approx(1.0, abs=0.05)
    assert r["node_id"] == "ESP32_NODE_01" and r["model_used"] == K.FOREST_NAME
    compact = spark.createDataFrame([(1.2, 4.0, 35.0, 85.0, 10.0, "ESP32_TEST_GATEWAY")],
                                    "vibration double, tilt double, temperature double, moisture double, "
                                    "displacement double, node_id string")
    c = model.predict(forest, compact, K.FOREST_NAME, keep=["node_id"]).first()
    assert c["risk_level"] in K.CLASSES and c["node_id"] == "ESP32_TEST_GATEWAY"


def test_golden_batch_labels(spark, forest):
    df = spark.createDataFrame(GOLDEN, RAW9).withColumn("i", F.monotonically_increasing_id())
    out = model.predict(forest, df, K.FOREST_NAME, keep=["i", "expected"]).orderBy("i").collect()
    assert [r["risk_level"] for r in out] == [r["expected"] for r in out]


def test_model_save_load(spark, forest):
    path = scratch_dir(spark, "test-model")
    model.save(forest, path, K.FOREST_NAME, {"f1": 1.0}, spark)
    loaded, meta = model.load(spark, path)
    assert meta["feature_names"] == K.FEATURES and meta["classes"] == ["CRITICAL", "NORMAL", "WARNING"]
    df = spark.createDataFrame(GOLDEN, RAW9)
    a = model.predict(forest, df, "x").select("risk_level", "confidence").collect()
    b = model.predict(loaded, df, "x").select("risk_level", "confidence").collect()
    assert a == b
    with pytest.raises(Exception):
        model.load(spark, path + "-missing")


def test_stream_equals_batch(spark):
    from tremorlake.plans.q_stream import _compact_with_time

    src_df = _compact_with_time(spark, SF001)
    base = scratch_dir(spark, "test-stream")
    src = packets.write_packet_files(src_df, f"{base}/in")
    q = packets.rule_alert_stream(packets.read_packets(spark, src, packets.COMPACT_SCHEMA, files_per_trigger=1),
                                  f"{base}/out", f"{base}/ckpt", threshold=2.0)
    packets.run(q)
    streamed = sorted(r[0] for r in spark.read.parquet(f"{base}/out").select("event_id").collect())
    batch = sorted(r[0] for r in clean.rule_alerts(features.derive(src_df), 2.0).select("event_id").collect())
    assert streamed == batch and len(batch) > 0


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["node_id", "risk_label", "n_packets", "mean_magnitude", "max_ppv", "total_energy"]
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["risk_by_node", "clean_table", "numeric_summary", "strat_split",
                                  "augment_noise", "waveform_grouped", "classification_report"])
def test_oracle_spot_checks(spark, name):
    import duckdb

    import __spark_entry__ as E
    from tremorlake.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)

    def canon(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(repr(r[i]) for i in order) for r in rows)

    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(dcols, res.fetchall())


def test_split_then_augment_equals_group_split(spark):
    from tremorlake.operators import sampling
    from tremorlake.plans.q_sampling import labelled

    t = labelled(spark, SF001)
    a = sampling.split_then_augment(t, "risk_label", "event_id").select("event_id", "aug_round", "is_test")
    b = sampling.group_split(sampling.augment(t, "event_id"), "event_id", "risk_label", F.col("aug_round") == 0) \
        .select("event_id", "aug_round", "is_test")
    assert a.count() == b.count() == t.count() * 10
    assert a.exceptAll(b).count() == 0
    assert a.groupBy("event_id").agg(F.countDistinct("is_test").alias("k")).where("k > 1").count() == 0


def test_train_flow_smoke(spark):
    from tremorlake.plans.train_flow import train_and_select
    from tremorlake.sources import tables

    out = scratch_dir(spark, "test-flow")
    res = train_and_select(spark, tables.raw_blast_table(spark, SF001), out, boosted_rounds=2, trees=8)
    assert res["best_model"] in (K.FOREST_NAME, K.BOOSTED_NAME)
    rows = res["comparison"].collect()
    assert len(rows) == 2 and all(0 <= r[c] <= 1 for r in rows for c in ("accuracy", "cv_accuracy", "cv_f1", "cv_critical_recall"))
    loaded, meta = model.load(spark, out)
    assert meta["model_name"] == res["best_model"]


def test_training_rows_without_label_are_refused(spark):
    df = spark.createDataFrame([("NORMAL",), (None,)], "risk_label string")
    with pytest.raises(ValueError):
        model.with_class_weights(df)


def test_forest_does_not_depend_on_partitions(spark):
    from tremorlake.functions import physics as P
    from tremorlake.sources import tables

    t = tables.telemetry(spark, SF001).withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    seen = [model.feature_importance(model.fit_forest(model.training_matrix(t.repartition(n)), num_trees=5))
            for n in (1, 3, 8)]
    for other in seen[1:]:
        assert [n for n, _ in other] == [n for n, _ in seen[0]]
        assert [v for _, v in other] == pytest.approx([v for _, v in seen[0]])


def test_query_building_without_statistics_runs_no_job(spark):
    """Plans are declared, not run: the split and the augmentation start no job before an action."""
    from tremorlake.plans import catalog

    sc = spark.sparkContext
    for name in ("group_split", "strat_folds", "augment_noise", "derive_compact5"):
        sc.setJobGroup(f"build-{name}", name)
        catalog.queries()[name](spark, SF001)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        assert len(jobs) <= 1, (name, jobs)  # at most the reading of a Parquet footer
    sc.setJobGroup("default", "")


def test_json_lines_are_parsed_or_quarantined_with_a_reason(spark):
    from tremorlake.streaming import packets

    whole = '"vibration":0.5,"tilt":1,"temperature":"27.5","moisture":2e1,"displacement":-0.25'
    cases = {
        '{%s,"node_id":"N1","event_id":7,"other":[1]}' % whole: None,
        '{%s}' % whole: None,
        '{%s' % whole: "malformed",
        "": "malformed",
        "[1,2]": "malformed",
        "12": "malformed",
        "{}": "missing: vibration,tilt,temperature,moisture,displacement",
        '{%s}' % whole.replace("0.5", "null"): "missing: vibration",
        '{%s}' % whole.replace("0.5", "true"): "mistyped: vibration",
        '{%s}' % whole.replace("0.5", '"NaN"'): "mistyped: vibration",
        '{%s}' % whole.replace("0.5", '"1d"'): "mistyped: vibration",
        '{%s}' % whole.replace("0.5", "1e999"): "mistyped: vibration",
        '{%s,"event_id":"x","ts":"soon"}' % whole.replace('"tilt":1,', ""): "mistyped: event_id,ts; missing: tilt",
    }
    got = {r["line"]: r for r in packets.parse_json(spark.createDataFrame([(c,) for c in cases], "value string")).collect()}
    assert {c: r["reason"] for c, r in got.items()} == cases
    first = got[next(iter(cases))]
    assert (first["event_id"], first["node_id"], first["vibration"], first["temperature"], first["displacement"]) == \
        (7, "N1", 0.5, 27.5, -0.25)
    assert packets.parse_json(spark.createDataFrame([], "value string")).count() == 0


def test_stream_window_std_with_a_large_offset(spark, tmp_path):
    import datetime as dt

    import numpy as np
    from tremorlake.streaming import packets

    rng, start = np.random.default_rng(3), dt.datetime(2026, 1, 1)
    x = (1e6 + rng.normal(0, 0.01, 900)).tolist()
    rows = [(i, "n", start + dt.timedelta(seconds=2 * i), v) for i, v in enumerate(x)]
    rows += [(1000, "gap", start, None), (1001, "gap", start + dt.timedelta(seconds=30), 2.5),
             (1002, "late", start + dt.timedelta(hours=3), 0.0)]
    df = spark.createDataFrame(rows, "event_id long, node_id string, ts timestamp, x double").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    packets.run(packets.window_stream(stream, "x", f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = {r["node_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["n"]["n"] == 900 and got["n"]["std"] == pytest.approx(np.std(x), rel=1e-6)
    assert (got["gap"]["n"], got["gap"]["mean"], got["gap"]["std"]) == (1, 2.5, 0.0)


def test_folds_of_a_large_table_are_fitted_one_after_the_other(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model, "in_parallel", lambda fn, items, max_workers=5: seen.append(max_workers) or [None] * 5)
    monkeypatch.setattr(model, "_prob_array", lambda m, d: (d.withColumn("prob_array", F.array(F.lit(1.0))), ["NORMAL"]))
    df = spark.range(100).select(F.lit("NORMAL").alias("risk_label"), F.lit(1.0).alias("weight"), F.lit(0).alias("fold"))
    for rows_at_once in (1000, 250, 10):
        model.fold_predictions(df, "fold", None, rows_at_once=rows_at_once)
    assert seen == [5, 2, 1]


def test_classes_of_a_large_table_are_boosted_one_after_the_other(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model, "in_parallel", lambda fn, items, max_workers=5: seen.append(max_workers) or [])
    df = spark.range(100).select(F.lit("NORMAL").alias("risk_label"), F.lit(1.0).alias("weight"),
                                 *[F.col("id").cast("double").alias(c) for c in K.FEATURES])
    for rows_at_once in (300, 250, 10):
        model.fit_boosted(df, rows_at_once=rows_at_once)
    assert seen == [3, 2, 1]


def test_parallel_fits_have_their_own_job_properties(spark):
    import threading

    sc, met = spark.sparkContext, threading.Barrier(2, timeout=30)
    sc.setLocalProperty("tremorlake.test", "caller")

    def job(i):
        got = sc.getLocalProperty("tremorlake.test")
        met.wait()
        sc.setLocalProperty("tremorlake.test", str(i))
        met.wait()
        return got, sc.getLocalProperty("tremorlake.test")

    assert model.in_parallel(job, [0, 1]) == [("caller", "0"), ("caller", "1")]
    assert sc.getLocalProperty("tremorlake.test") == "caller"
    sc.setLocalProperty("tremorlake.test", None)


def test_node_ids_change_no_tree(spark):
    from tremorlake.plans.q_model import _train

    train = _train(spark, SF001)
    a, b = (model.fit_forest(train, num_trees=5, max_depth=6, max_cached_ids=n).stages[-1] for n in (10**9, 0))
    assert a.getOrDefault("cacheNodeIds") and not b.getOrDefault("cacheNodeIds")
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    boosted = model.fit_boosted(train, max_iter=2)
    assert not any(m.getOrDefault("cacheNodeIds") for _, m in boosted.members)
