"""Queries with trained models (rows-only checks): L1-L6, R3, A23, S8-S10.

Training data: raw-9 telemetry with PPV-threshold labels, stratified 80/20
split.  Fitted models are cached per (session, data folder) for the
lifetime of the driver process, so the model queries share one fit.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake import constants as K
from tremorlake.functions import physics as P
from tremorlake.operators import evaluate, features, model, quality, sampling
from tremorlake.plans import sql as S
from tremorlake.plans import train_flow as flow
from tremorlake.plans.q_sampling import SPLIT
from tremorlake.plans.registry import register
from tremorlake.session import materialize, scratch_dir
from tremorlake.sources import tables

_FITS: dict = {}


def split_table(spark, sf_dir):
    """Labelled telemetry with ``is_test``."""
    t = tables.telemetry(spark, sf_dir).withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    return sampling.stratified_split(t, "risk_label", "event_id")


def split_frames(spark, sf_dir):
    s = split_table(spark, sf_dir)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def _session(spark) -> str:
    return spark.sparkContext.applicationId


def _train(spark, sf_dir):
    key = ("train", _session(spark), sf_dir)
    if key not in _FITS:
        tr, _ = split_frames(spark, sf_dir)
        _FITS[key] = model.training_matrix(tr, keep=["event_id"])
    return _FITS[key]


def forest(spark, sf_dir):
    key = ("forest", _session(spark), sf_dir)
    if key not in _FITS:
        _FITS[key] = model.fit_forest(_train(spark, sf_dir))
    return _FITS[key]


def boosted(spark, sf_dir):
    key = ("boosted", _session(spark), sf_dir)
    if key not in _FITS:
        _FITS[key] = model.fit_boosted(_train(spark, sf_dir))
    return _FITS[key]


def _scored(spark, sf_dir, m, name):
    """Scores of every packet, with the part of the split it is in."""
    return model.predict(m, split_table(spark, sf_dir), name, keep=["event_id", "node_id", "risk_label", "is_test"])


def _contract(scored):
    """Per packet: is its label one of the classes, do the probabilities sum to 1, is the confidence the largest?"""
    probs = [F.col(f"prob_{c}") for c in K.CLASSES]
    return scored.select(
        "event_id", "is_test", F.col("risk_level").isin(*K.CLASSES).alias("label_known"),
        (F.abs(sum(probs[1:], probs[0]) - 1) <= 1e-3).alias("sums_to_one"),
        (F.col("confidence") == F.greatest(*probs)).alias("confidence_is_largest"),
        (F.col("node_id").isNotNull()).alias("node_echoed"))


CONTRACT_SQL = f"""WITH {SPLIT}
SELECT event_id, is_test, true AS label_known, true AS sums_to_one, true AS confidence_is_largest, true AS node_echoed
FROM split"""


@register("forest_contract", CONTRACT_SQL)
def forest_contract(spark, sf_dir):
    """The forest scores every packet within the scoring contract."""
    return _contract(_scored(spark, sf_dir, forest(spark, sf_dir), K.FOREST_NAME))


@register("boosted_contract", CONTRACT_SQL)
def boosted_contract(spark, sf_dir):
    """The boosted trees score every packet within the scoring contract."""
    return _contract(_scored(spark, sf_dir, boosted(spark, sf_dir), K.BOOSTED_NAME))


@register("model_save_load", f"""WITH {SPLIT}
SELECT event_id, true AS forest_equal, true AS boosted_equal FROM split""")
def model_save_load(spark, sf_dir):
    """Both kinds of model give every packet the same scores after saving and loading."""
    out = None
    for name, m, col in ((K.FOREST_NAME, forest(spark, sf_dir), "forest_equal"),
                         (K.BOOSTED_NAME, boosted(spark, sf_dir), "boosted_equal")):
        path = scratch_dir(spark, "model")
        model.save(m, path, name, {}, spark)
        loaded, _ = model.load(spark, path)
        cols = ["risk_level", *[f"prob_{c}" for c in K.CLASSES]]
        a, b = (_scored(spark, sf_dir, x, name).select("event_id", F.struct(*cols).alias(s))
                for x, s in ((m, "a"), (loaded, "b")))
        same = a.join(b, "event_id").select("event_id", (F.col("a") == F.col("b")).alias(col))
        out = same if out is None else out.join(same, "event_id")
    return out


@register("train_flow", f"""SELECT 'Random Forest' AS model, true AS has_test_metrics, true AS has_cv_metrics
UNION ALL SELECT 'Gradient Boosting', true, true""")
def train_flow(spark, sf_dir):
    """Clean, split, fit both, cross-validate, compare, select, save (20 trees and 5 rounds: the flow, not the fit)."""
    res = flow.train_and_select(spark, tables.raw_blast_table(spark, sf_dir), scratch_dir(spark, "flow"),
                                boosted_rounds=5, trees=20)
    unit = lambda c: F.col(c).between(0.0, 1.0)
    return res["comparison"].select(
        "model", (unit("accuracy") & unit("f1") & unit("critical_recall")).alias("has_test_metrics"),
        (unit("cv_accuracy") & unit("cv_f1") & unit("cv_critical_recall")).alias("has_cv_metrics"))


@register("forest_scores")
def forest_scores(spark, sf_dir):
    """Random forest (150 trees, depth 12, balanced weights) scores of every packet."""
    return _scored(spark, sf_dir, forest(spark, sf_dir), K.FOREST_NAME).drop("probabilities")


@register("boosted_scores")
def boosted_scores(spark, sf_dir):
    """One-vs-rest gradient-boosted trees (120 rounds, lr 0.08, depth 6), normalised probabilities."""
    return _scored(spark, sf_dir, boosted(spark, sf_dir), K.BOOSTED_NAME).drop("probabilities")


@register("test_metrics")
def test_metrics(spark, sf_dir):
    """Held-out metrics of both models side by side (accuracy, macro P/R/F1, CRITICAL recall)."""
    out = {}
    for name, m in [(K.FOREST_NAME, forest(spark, sf_dir)), (K.BOOSTED_NAME, boosted(spark, sf_dir))]:
        p = _scored(spark, sf_dir, m, name).where("is_test")
        out[name] = evaluate.summary(evaluate.confusion_long(p, label="risk_label", prediction="risk_level"))
    return evaluate.compare(out)


@register("oof_metrics")
def oof_metrics(spark, sf_dir):
    """Stratified 5-fold out-of-fold forest predictions on the training part; metrics on the pooled rows."""
    tr = _train(spark, sf_dir)
    folds = materialize(sampling.stratified_folds(tr, "risk_label", "event_id"), "folds")
    pred = model.fold_predictions(folds, "fold", lambda d: model.fit_forest(d))
    s = evaluate.summary(evaluate.confusion_long(pred, label="risk_label", prediction="prediction"))
    return s.select(F.lit(K.FOREST_NAME).alias("model"), *[F.col(c).alias(f"cv_{c}") for c in s.columns])


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Top-10 features by impurity importance of the forest."""
    top = model.feature_importance(forest(spark, sf_dir))
    schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("feature", T.StringType()),
                           T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(top)], schema)


#: channels of the binding that rise with PPV, and what is derived from them
PPV_LIKE = ["ppv_mms", "psd_value", "geophone_mms", "seismometer_ms2", "kinetic_energy_proxy", "spectral_power_product"]


@register("model_bounds", "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, '{k}' AS measure, true AS met" for m in (K.FOREST_NAME, K.BOOSTED_NAME)
    for k in ("accuracy >= 0.97", "macro f1 >= 0.95", "critical recall >= 0.97"))
    + f"\nUNION ALL SELECT '{K.FOREST_NAME}', 'importance of PPV-like features >= 0.8', true"
    + f"\nUNION ALL SELECT '{K.FOREST_NAME}', 'importances fall and sum to at most 1', true")
def model_bounds(spark, sf_dir):
    """Values of the full-size fits (150 trees, 120 rounds) on the test packets against stated bounds.

    The label is a PPV threshold, so a sound learner is nearly always right and its importance lies with PPV.
    """
    rows = []
    for name, m in ((K.FOREST_NAME, forest(spark, sf_dir)), (K.BOOSTED_NAME, boosted(spark, sf_dir))):
        test = _scored(spark, sf_dir, m, name).where("is_test")
        s = evaluate.summary(evaluate.confusion_long(test, label="risk_label", prediction="risk_level")).first()
        rows += [(name, "accuracy >= 0.97", s["accuracy"] >= 0.97), (name, "macro f1 >= 0.95", s["f1"] >= 0.95),
                 (name, "critical recall >= 0.97", s["critical_recall"] >= 0.97)]
    top = model.feature_importance(forest(spark, sf_dir))
    shares = [float(v) for _, v in top]
    rows += [(K.FOREST_NAME, "importance of PPV-like features >= 0.8", sum(float(v) for f, v in top if f in PPV_LIKE) >= 0.8),
             (K.FOREST_NAME, "importances fall and sum to at most 1",
              shares == sorted(shares, reverse=True) and sum(shares) <= 1 + 1e-9)]
    return spark.createDataFrame([(a, b, bool(c)) for a, b, c in rows], "model string, measure string, met boolean")


@register("ppv_tree_leak")
def ppv_tree_leak(spark, sf_dir):
    """Depth-2 decision tree on PPV alone; accuracy > 0.98 flags target leakage."""
    t = tables.telemetry(spark, sf_dir).withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    return model.ppv_leak_probe(t)


@register("report_probes", f"""WITH {S.FEATURED},
energy AS (SELECT bool_and(abs(kinetic_energy_proxy - 0.5e0*ppv_mms*ppv_mms) <= 1e-8 + 1e-3*abs(0.5e0*ppv_mms*ppv_mms))
             AS same FROM featured)
SELECT 'packets' AS "table", 'leak_tree' AS probe, true AS found
UNION ALL SELECT 'packets', 'energy_probe', same FROM energy
UNION ALL SELECT 'packets', 'train_test_overlap', false
UNION ALL SELECT 'unrelated', 'leak_tree', false
UNION ALL SELECT 'unrelated', 'energy_probe', false
UNION ALL SELECT 'unrelated', 'train_test_overlap', true""")
def report_probes(spark, sf_dir):
    """The quality report's leakage probes on packets, and on packets whose PPV has nothing to do with the label."""
    t = features.derive(tables.telemetry(spark, sf_dir)).withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    t = t.select("event_id", "risk_label", "ppv_mms", "kinetic_energy_proxy", "temperature_c")
    other = t.withColumn("ppv_mms", F.pmod(F.xxhash64("event_id"), F.lit(1 << 20)) / F.lit(1e5))
    found = {"leak_tree": F.col("leak_detected"), "energy_probe": F.col("energy_is_ppv"),
             "train_test_overlap": F.col("shared_rows") > 0}
    out = None
    for name, d, train in (("packets", t, "event_id % 5 > 0"), ("unrelated", other, "event_id % 10 < 9")):
        d = materialize(d, "probed")
        rep = quality.report(d, ["event_id", "ppv_mms", "temperature_c"], d.where(train), d.where("event_id % 5 = 0"))
        for probe, is_found in found.items():
            one = rep[probe].select(F.lit(name).alias("table"), F.lit(probe).alias("probe"), is_found.alias("found"))
            out = one if out is None else out.unionByName(one)
    return out


@register("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Compare both models, pick the safety-first winner, save it, load it back, score the test
    packets with the loaded model and write / re-read the predictions."""
    m = {K.FOREST_NAME: forest(spark, sf_dir), K.BOOSTED_NAME: boosted(spark, sf_dir)}
    summaries = {n: evaluate.summary(evaluate.confusion_long(_scored(spark, sf_dir, mm, n).where("is_test"), label="risk_label",
                                                            prediction="risk_level")) for n, mm in m.items()}
    best = evaluate.select_best(evaluate.compare(summaries)).first()
    name = best["best_model"]
    path = scratch_dir(spark, "model")
    model.save(m[name], path, name, {k: best[k] for k in ["critical_recall", "f1", "accuracy"]}, spark)
    loaded, meta = model.load(spark, path)
    scored = _scored(spark, sf_dir, loaded, meta["model_name"])
    out = scratch_dir(spark, "predictions")
    scored.drop("probabilities").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
