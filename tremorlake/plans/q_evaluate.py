"""Queries: metrics, report, comparison, selection, argmax, encoders (A17-A24, T4, T5, M11, F1-F4).

The metric queries score deterministic stand-in predictions (the PPV label
of a shifted PPV), so Spark and the SQL oracle see the same predictions; the
trained-model path is covered by the rows-only model queries.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions import physics as P
from tremorlake.operators import clean, evaluate
from tremorlake.plans import sql as S
from tremorlake.plans.registry import finish, register
from tremorlake.sources import tables


def r6(e: str) -> str:
    return f"round({e}, 6) + 0e0"


def _label_sql(e: str) -> str:
    return f"CASE WHEN {e} < 2e0 THEN 'NORMAL' WHEN {e} < 4e0 THEN 'WARNING' ELSE 'CRITICAL' END"


PRED = S.FEATURED + f""",
pred AS (
  SELECT event_id, node_id, event_type, ppv_mms, risk_label AS label,
         {_label_sql('ppv_mms + ((event_id % 5) - 2)*0.2e0')} AS prediction,
         {_label_sql('ppv_mms + ((event_id % 7) - 3)*0.5e0')} AS prediction_b
  FROM featured)"""


def predictions(spark, sf_dir):
    t = tables.telemetry(spark, sf_dir)
    eid, ppv = F.col("event_id"), F.col("ppv_mms")
    return t.select("event_id", "node_id", "event_type", "ppv_mms", P.risk_from_ppv(ppv).alias("label"),
                    P.risk_from_ppv(ppv + (eid % 5 - 2) * F.lit(0.2)).alias("prediction"),
                    P.risk_from_ppv(ppv + (eid % 7 - 3) * F.lit(0.5)).alias("prediction_b"))


def _per_class_sql(pcol: str, tag: str) -> str:
    return f""",
cm_{tag} AS (SELECT label, {pcol} AS prediction, count(*) AS n FROM pred GROUP BY 1, 2),
bl_{tag} AS (SELECT label AS class, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
             FROM cm_{tag} GROUP BY 1),
bp_{tag} AS (SELECT prediction AS class, sum(n) AS predicted FROM cm_{tag} GROUP BY 1),
pc_{tag} AS (SELECT coalesce(bl_{tag}.class, bp_{tag}.class) AS class, coalesce(support, 0) AS support,
                    coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
             FROM bl_{tag} FULL OUTER JOIN bp_{tag} ON bl_{tag}.class = bp_{tag}.class),
pm_{tag} AS (SELECT *, CASE WHEN predicted > 0 THEN tp*1e0/predicted ELSE 0e0 END AS precision,
                    CASE WHEN support > 0 THEN tp*1e0/support ELSE 0e0 END AS recall FROM pc_{tag}),
pf_{tag} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0*precision*recall/(precision + recall)
                            ELSE 0e0 END AS f1 FROM pm_{tag}),
sm_{tag} AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(tp)*1e0/sum(support) AS accuracy, avg(precision) AS precision,
                    avg(recall) AS recall, avg(f1) AS f1,
                    coalesce(max(CASE WHEN class = 'CRITICAL' THEN recall END), 0e0) AS critical_recall
             FROM pf_{tag})"""


METRICS = PRED + _per_class_sql("prediction", "a") + _per_class_sql("prediction_b", "b")
SUMMARY_COLS = ["accuracy", "precision", "recall", "f1", "critical_recall"]


@register("confusion_matrix", f"""WITH {PRED}
SELECT label, {", ".join(f"count(*) FILTER (WHERE prediction = '{c}') AS {c}" for c in K.CLASSES)}
FROM pred GROUP BY label""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(evaluate.confusion_long(predictions(spark, sf_dir)))


@register("macro_metrics", f"""WITH {METRICS}
SELECT n, {", ".join(f"{r6(c)} AS {c}" for c in SUMMARY_COLS)} FROM sm_a""")
def macro_metrics(spark, sf_dir):
    """Accuracy, macro precision / recall / F1 (zero_division=0) and CRITICAL recall."""
    return finish(evaluate.summary(evaluate.confusion_long(predictions(spark, sf_dir))))


@register("critical_recall", f"""WITH {PRED}
SELECT count(*) FILTER (WHERE label = 'CRITICAL' AND prediction = 'CRITICAL') AS tp,
       count(*) FILTER (WHERE label = 'CRITICAL') AS support,
       {r6("coalesce(count(*) FILTER (WHERE label = 'CRITICAL' AND prediction = 'CRITICAL')*1e0"
           "/nullif(count(*) FILTER (WHERE label = 'CRITICAL'), 0), 0e0)")} AS critical_recall
FROM pred""")
def critical_recall(spark, sf_dir):
    """One-vs-rest recall of the CRITICAL class from the two boolean masks."""
    p = predictions(spark, sf_dir)
    y, yhat = F.col("label") == K.CRITICAL, F.col("prediction") == K.CRITICAL
    out = p.agg(F.sum((y & yhat).cast("long")).alias("tp"), F.sum(y.cast("long")).alias("support"))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    return finish(out.withColumn("critical_recall", rec))


@register("classification_report", f"""WITH {METRICS}
SELECT class AS "row", {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM pf_a
UNION ALL
SELECT 'macro avg', {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM pf_a
UNION ALL
SELECT 'weighted avg', {r6('sum(precision*support)/sum(support)')}, {r6('sum(recall*support)/sum(support)')},
       {r6('sum(f1*support)/sum(support)')}, CAST(sum(support) AS BIGINT) FROM pf_a""")
def classification_report(spark, sf_dir):
    return finish(evaluate.classification_report(evaluate.confusion_long(predictions(spark, sf_dir))))


COMPARISON = METRICS + f""",
cmp AS (SELECT 'model_a' AS model, 0 AS priority, * FROM sm_a UNION ALL SELECT 'model_b', 1, * FROM sm_b)"""


@register("model_comparison", f"""WITH {COMPARISON}
SELECT model, priority, n, {", ".join(f"{r6(c)} AS {c}" for c in SUMMARY_COLS)} FROM cmp""")
def model_comparison(spark, sf_dir):
    """Side-by-side metrics of two models, one row each."""
    p = predictions(spark, sf_dir)
    a = evaluate.summary(evaluate.confusion_long(p))
    b = evaluate.summary(evaluate.confusion_long(p, prediction="prediction_b"))
    return finish(evaluate.compare({"model_a": a, "model_b": b}))


@register("select_best", f"""WITH {COMPARISON}
SELECT model AS best_model, {r6('critical_recall')} AS critical_recall, {r6('f1')} AS f1,
       {r6('accuracy')} AS accuracy
FROM cmp ORDER BY critical_recall DESC, f1 DESC, accuracy DESC, priority LIMIT 1""")
def select_best(spark, sf_dir):
    """Safety-first model choice: CRITICAL recall, then macro F1, then accuracy; ties to the first."""
    p = predictions(spark, sf_dir)
    a = evaluate.summary(evaluate.confusion_long(p))
    b = evaluate.summary(evaluate.confusion_long(p, prediction="prediction_b"))
    return finish(evaluate.select_best(evaluate.compare({"model_a": a, "model_b": b})))


PROBS = S.FEATURED + """,
sc AS (SELECT event_id, node_id, event_type, 1e0/(1e0 + abs(ppv_mms - 5e0)) AS s_c, 1e0/(1e0 + abs(ppv_mms - 1e0)) AS s_n,
              1e0/(1e0 + abs(ppv_mms - 3e0)) AS s_w FROM featured),
pr AS (SELECT event_id, node_id, event_type, s_c/(s_c + s_n + s_w) AS p_c, s_n/(s_c + s_n + s_w) AS p_n,
              s_w/(s_c + s_n + s_w) AS p_w FROM sc),
am AS (SELECT *, CASE WHEN p_c >= p_n AND p_c >= p_w THEN 'CRITICAL' WHEN p_n >= p_w THEN 'NORMAL' ELSE 'WARNING' END
                   AS risk_level, greatest(p_c, p_n, p_w) AS conf FROM pr)"""


def probabilities(spark, sf_dir):
    t = tables.telemetry(spark, sf_dir)
    ppv = F.col("ppv_mms")
    s = {c: F.lit(1.0) / (F.lit(1.0) + F.abs(ppv - F.lit(v))) for c, v in [("c", 5.0), ("n", 1.0), ("w", 3.0)]}
    tot = s["c"] + s["n"] + s["w"]
    return t.select("event_id", "node_id", "event_type", (s["c"] / tot).alias("p_c"), (s["n"] / tot).alias("p_n"),
                    (s["w"] / tot).alias("p_w"))


@register("argmax_class", f"""WITH {PROBS}
SELECT event_id, risk_level, round(conf, 4) + 0e0 AS confidence,
       round(p_n, 4) + 0e0 AS prob_NORMAL, round(p_w, 4) + 0e0 AS prob_WARNING, round(p_c, 4) + 0e0 AS prob_CRITICAL
FROM am""")
def argmax_class(spark, sf_dir):
    """Probabilities -> label (ties to the alphabetically first class), confidence, 4-decimal rounding."""
    p = probabilities(spark, sf_dir)
    label, conf = evaluate.argmax_label([F.col("p_c"), F.col("p_n"), F.col("p_w")])
    return p.select("event_id", label.alias("risk_level"), (F.round(conf, 4) + F.lit(0.0)).alias("confidence"),
                    (F.round("p_n", 4) + F.lit(0.0)).alias("prob_NORMAL"),
                    (F.round("p_w", 4) + F.lit(0.0)).alias("prob_WARNING"),
                    (F.round("p_c", 4) + F.lit(0.0)).alias("prob_CRITICAL"))


@register("prediction_listing", f"""WITH {PROBS}
SELECT coalesce(node_id, 'NODE_' || cast(event_id AS VARCHAR)) AS node,
       substring('TEST ' || upper(event_type) || ': telemetry observation of ' || node_id, 1, 34) AS scenario,
       risk_level,
       cast(floor(floor(conf*1000e0 + 0.5e0)/10e0) AS BIGINT)::VARCHAR || '.' ||
       cast(CAST(floor(conf*1000e0 + 0.5e0) AS BIGINT) % 10 AS VARCHAR) || '%' AS confidence
FROM am""")
def prediction_listing(spark, sf_dir):
    """Console-style listing per packet: node, scenario cut to 34 chars, risk, confidence as '98.4%'."""
    p = probabilities(spark, sf_dir)
    label, conf = evaluate.argmax_label([F.col("p_c"), F.col("p_n"), F.col("p_w")])
    scen = F.concat(F.lit("TEST "), F.upper("event_type"), F.lit(": telemetry observation of "), F.col("node_id"))
    return p.select(F.coalesce(F.col("node_id"), F.concat(F.lit("NODE_"), F.col("event_id").cast("string"))).alias("node"),
                    F.substring(scen, 1, 34).alias("scenario"), label.alias("risk_level"),
                    evaluate.percent_text(conf).alias("confidence"))


@register("label_index", f"""WITH {S.FEATURED}
SELECT event_id, risk_label, CAST(dense_rank() OVER (ORDER BY risk_label) - 1 AS DOUBLE) AS label_index
FROM featured""")
def label_index(spark, sf_dir):
    """Alphabetical label encoding with Spark ML (CRITICAL=0, NORMAL=1, WARNING=2)."""
    t = tables.telemetry(spark, sf_dir).select("event_id", P.risk_from_ppv("ppv_mms").alias("risk_label"))
    model = StringIndexer(inputCol="risk_label", outputCol="label_index", stringOrderType="alphabetAsc").fit(t)
    return model.transform(t)


@register("class_weights", f"""WITH {S.FEATURED},
c AS (SELECT risk_label, count(*) AS n FROM featured GROUP BY 1)
SELECT risk_label, n, {r6('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM c""")
def class_weights(spark, sf_dir):
    """Balanced class weights n / (k * n_c)."""
    t = tables.telemetry(spark, sf_dir).select(P.risk_from_ppv("ppv_mms").alias("risk_label"))
    return finish(evaluate.class_weights(t))


STD_COLS = ["ppv_mms", "temperature_c", "frequency_hz"]


@register("standardize", f"""WITH {S.TELEMETRY},
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STD_COLS)} FROM telemetry)
SELECT event_id, {", ".join(f"{r6(f'({c} - m_{c})/s_{c}')} AS {c}" for c in STD_COLS)} FROM telemetry, st""")
def standardize(spark, sf_dir):
    """Standard scaling with the population std (scikit-learn parity); stats enter as literals."""
    from tremorlake.operators import model
    t = tables.telemetry(spark, sf_dir)
    return finish(model.standardize(t, STD_COLS).select("event_id", *STD_COLS))


SOILS = tables.SOIL_TYPES


@register("one_hot", f"""WITH {S.RENAMED}
SELECT event_id, soil_type, {", ".join(f"CASE WHEN soil_type = '{s}' THEN 1e0 ELSE 0e0 END AS soil_{s}" for s in SOILS)}
FROM renamed""")
def one_hot(spark, sf_dir):
    """One-hot of a text column with Spark ML; unseen / NULL categories -> all zeros."""
    r = clean.canonical_names(tables.raw_blast_table(spark, sf_dir)).select("event_id", "soil_type")
    idx = StringIndexer(inputCol="soil_type", outputCol="_i", stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(r)
    cats = idx.labels
    enc = OneHotEncoder(inputCol="_i", outputCol="_v", dropLast=False).fit(idx.transform(r))
    arr = vector_to_array(F.col("_v"))
    out = enc.transform(idx.transform(r))
    return out.select("event_id", "soil_type", *[arr[i].alias(f"soil_{c}") for i, c in enumerate(cats)])
