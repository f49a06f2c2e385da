"""Split / folds / augmentation properties and metric formulas against brute force."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators import evaluate, sampling
from tremorlake.plans import q_evaluate
from tremorlake.sources import tables

from paths import SF01


def _labelled(spark):
    from tremorlake.plans.q_sampling import labelled
    return labelled(spark, SF01)


def test_stratified_rank_equals_window_rank(spark):
    # a hot stratum: ~90% of rows in one label
    df = spark.range(5000).withColumn("s", F.when(F.col("id") % 10 == 0, "b").otherwise("a"))
    got = sampling.stratified_rank(df, "s", "id").select("id", "_rank", "_n")
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit("|42")))
    w = Window.partitionBy("s").orderBy(h, "id")
    ref = df.select("id", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("s")).alias("n"))
    bad = got.join(ref, "id").where((F.col("_rank") != F.col("r")) | (F.col("_n") != F.col("n"))).count()
    assert bad == 0


def test_split_is_a_stratified_partition(spark):
    t = _labelled(spark)
    s = sampling.stratified_split(t, "risk_label", "event_id")
    assert s.count() == t.count() and s.select("event_id").distinct().count() == t.count()
    counts = {(r["risk_label"], r["is_test"]): r["count"] for r in s.groupBy("risk_label", "is_test").count().collect()}
    for lab in K.CLASSES:
        n = counts.get((lab, True), 0) + counts.get((lab, False), 0)
        assert counts.get((lab, True), 0) == int(n * 0.2 + 0.5)


def test_folds_cover_and_balance(spark):
    f = sampling.stratified_folds(_labelled(spark), "risk_label", "event_id")
    per = {(r["risk_label"], r["fold"]): r["count"] for r in f.groupBy("risk_label", "fold").count().collect()}
    for lab in K.CLASSES:
        sizes = [per.get((lab, k), 0) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert f.select("event_id").distinct().count() == f.count()


def test_augmentation_count_determinism_and_clamp(spark):
    t = _labelled(spark).limit(200)
    a = sampling.augment(t, "event_id")
    assert a.count() == 200 * 10
    a1 = a.orderBy("event_id", "aug_round").collect()
    a2 = sampling.augment(t.repartition(3), "event_id").orderBy("event_id", "aug_round").collect()
    assert a1 == a2  # same noise whatever the partitioning
    noisy = a.where("aug_round > 0")
    assert noisy.where(F.least(*[F.col(c) for c in K.CLAMP_COLUMNS]) < 0.001).count() == 0
    bad = noisy.where(F.col("risk_label") != F.when(F.col("ppv_mms") < 2, "NORMAL")
                      .when(F.col("ppv_mms") < 4, "WARNING").otherwise("CRITICAL")).count()
    assert bad == 0


def test_noise_is_standard_normal(spark):
    d = spark.range(20000).select(sampling.gaussian(sampling.order_key(F.col("id"), 1)).alias("g")) \
        .agg(F.avg("g").alias("m"), F.stddev("g").alias("s")).first()
    assert abs(d["m"]) < 0.03 and abs(d["s"] - 1) < 0.03


def test_uniform_matches_python_md5(spark):
    h = sampling.order_key(F.lit(7), "x")
    r = spark.range(1).select(sampling.unit_uniform(h).alias("u1"), sampling.unit_uniform(h, 9).alias("u2")).first()
    x = hashlib.md5(b"7|x").hexdigest()
    assert r["u1"] == (int(x[:8], 16) + 1) / 4294967297.0
    assert r["u2"] == (int(x[8:16], 16) + 1) / 4294967297.0


def test_metrics_match_brute_force(spark):
    p = q_evaluate.predictions(spark, SF01).select("label", "prediction").collect()
    labels = sorted({r[0] for r in p} | {r[1] for r in p})
    prec, rec, f1 = [], [], []
    for c in labels:
        tp = sum(1 for r in p if r[0] == c and r[1] == c)
        pp = sum(1 for r in p if r[1] == c)
        sp = sum(1 for r in p if r[0] == c)
        pr, rc = (tp / pp if pp else 0.0), (tp / sp if sp else 0.0)
        prec.append(pr), rec.append(rc), f1.append(2 * pr * rc / (pr + rc) if pr + rc else 0.0)
    s = evaluate.summary(evaluate.confusion_long(q_evaluate.predictions(spark, SF01))).first()
    assert s["accuracy"] == pytest.approx(sum(1 for r in p if r[0] == r[1]) / len(p))
    assert s["precision"] == pytest.approx(sum(prec) / len(prec))
    assert s["recall"] == pytest.approx(sum(rec) / len(rec))
    assert s["f1"] == pytest.approx(sum(f1) / len(f1))
    assert s["critical_recall"] == pytest.approx(rec[labels.index("CRITICAL")])


def test_select_best_prefers_safety_then_first(spark):
    rows = [("a", 0, 1.0, 0.9, 0.95), ("b", 1, 1.0, 0.9, 0.95), ("c", 2, 0.99, 1.0, 1.0)]
    cmp = spark.createDataFrame(rows, "model string, priority int, critical_recall double, f1 double, accuracy double")
    assert evaluate.select_best(cmp).first()["best_model"] == "a"


def test_argmax_ties_go_to_first_class(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.45, 0.45), (0.2, 0.3, 0.5)], "c double, n double, w double")
    lab, _ = evaluate.argmax_label([F.col("c"), F.col("n"), F.col("w")])
    assert [r[0] for r in df.select(lab).collect()] == ["CRITICAL", "NORMAL", "WARNING"]


def test_percent_text(spark):
    df = spark.createDataFrame([(0.9607,), (0.98749,), (1.0,)], "c double")
    assert [r[0] for r in df.select(evaluate.percent_text(F.col("c"))).collect()] == ["96.1%", "98.7%", "100.0%"]


def test_null_strata_and_keys_are_split_like_any_other(spark):
    from pyspark.sql import functions as F

    df = spark.range(100).select(F.when(F.col("id") % 5 != 0, F.col("id")).alias("k"), F.col("id").alias("row"),
                                 F.when(F.col("id") % 4 != 0, F.lit("a")).alias("label"))
    out = sampling.stratified_split(df, "label", ["k", "row"]).collect()
    assert len(out) == 100 and sum(r["is_test"] for r in out) == 20
    assert sum(r["is_test"] for r in out if r["label"] is None) == 5
    folds = sampling.stratified_folds(df, "label", ["k", "row"]).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20] * 5
    groups = sampling.group_split(df.withColumn("aug_round", F.lit(0)), "k", "label", F.col("aug_round") == 0)
    assert groups.filter("is_test IS NULL").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_ranks_only_the_bin_of_the_cut(spark):
    df = spark.range(20000).withColumn("s", F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 7 > 0, "a")) \
        .withColumn("wide", F.col("id").cast("double"))
    for fraction in (0.0, 0.2, 0.731, 1.0):
        got = sampling.stratified_split(df, "s", "id", fraction)
        ref = sampling.stratified_rank(df, "s", "id").withColumn(
            "is_test", F.col("_rank") <= F.round(F.col("_n") * fraction)).drop("_rank", "_n")
        assert got.columns == ref.columns and got.exceptAll(ref).count() == ref.exceptAll(got).count() == 0
    # rows with equal keys: as many test rows as without
    twice = sampling.stratified_split(df.select((F.col("id") % 50).alias("id"), "s"), "s", "id")
    assert {(r["s"], r["t"] == round(0.2 * r["n"])) for r in twice.groupBy("s").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()} == {("a", True), ("b", True), (None, True)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(sampling.stratified_split(df, "s", "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_overlap_shuffles_hashes_not_values(spark):
    from tremorlake.operators import quality

    rows = [(1.0, None, True), (1.0, None, False), (None, 1.0, True), (0.0, 2.0, True), (-0.0, 2.0, False),
            (float("nan"), 3.0, True), (float("nan"), 3.0, False), (4.0, 4.0, True), (4.0, 4.0, True), (5.0, 4.0, False)]
    df = spark.createDataFrame(rows, "c0 double, c1 double, is_test boolean")
    out = quality.train_test_overlap(df, ["c0", "c1"])
    assert out.first()["shared_rows"] == 3
    exchanges = [line for line in _plan(out).splitlines() if "hashpartitioning" in line]
    assert exchanges and not any("c0#" in line or "c1#" in line for line in exchanges)
