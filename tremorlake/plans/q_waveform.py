"""Queries: waveform-buffer features, array form and grouped form (W1-W12, ST6 batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.waveform import FEATURE_NAMES, waveform_features
from tremorlake.operators import waveform
from tremorlake.plans import sql as S
from tremorlake.plans.registry import finish, register
from tremorlake.sources import tables


def r6(e: str) -> str:
    return f"round({e}, 6) + 0e0"


def _metrics(group: str, x: str = "x", px: str = "px") -> str:
    zc = f"sum(CASE WHEN {px} IS NOT NULL AND (({px} <> 0) <> ({x} <> 0)) THEN 1 ELSE 0 END)"
    sc = f"sum(CASE WHEN {px} IS NOT NULL AND sign({px}) <> sign({x}) THEN 1 ELSE 0 END)"
    steps = "greatest(count(*) - 1, 1)"
    return ", ".join([
        f"{r6(f'avg({x})')} AS mean", f"{r6(f'stddev_pop({x})')} AS std", f"{r6(f'min({x})')} AS min",
        f"{r6(f'max({x})')} AS max", f"{r6(f'max(abs({x}))')} AS peak_amplitude",
        f"{r6(f'max({x}) - min({x})')} AS peak_to_peak", f"{r6(f'sqrt(avg({x}*{x}))')} AS rms",
        f"{r6(f'sum({x}*{x})')} AS signal_energy",
        f"{r6(f'max(abs({x}))/(sqrt(avg({x}*{x})) + 1e-8)')} AS crest_factor",
        f"{r6(f'{zc}/{steps}')} AS zero_crossing_rate", f"{r6(f'{sc}/{steps}')} AS sign_change_rate"])


WAVE_SQL = f"""WITH {S.WAVES},
lagged AS (SELECT vec_id, label, i, x, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS px FROM samples)
SELECT vec_id, label, {_metrics('vec_id')} FROM lagged GROUP BY vec_id, label"""


@register("waveform_array", WAVE_SQL)
def waveform_array(spark, sf_dir):
    """11 waveform metrics per buffer with higher-order array functions (no UDF, no shuffle)."""
    w = tables.waveform_buffers(spark, sf_dir)
    out = w.select("vec_id", "label", waveform_features("samples").alias("f"))
    return finish(out.select("vec_id", "label", *[F.col(f"f.{n}").alias(n) for n in FEATURE_NAMES]))


@register("waveform_grouped", WAVE_SQL)
def waveform_grouped(spark, sf_dir):
    """The same metrics from long rows: aggregates + two-level lag (chunks of 16 samples)."""
    s = tables.waveform_samples(spark, sf_dir)
    out = waveform.window_features(s, ["vec_id", "label"], ["i"], "x", F.floor((F.col("i") - 1) / 16))
    return finish(out.select("vec_id", "label", *FEATURE_NAMES))


@register("waveform_hourly", f"""WITH {S.TELEMETRY},
s AS (SELECT node_id, strftime(ts, '%Y-%m-%d %H:00') AS hour, ts, event_id,
             floor((ppv_mms - 2e0)*10e0) AS x FROM telemetry),
lagged AS (SELECT *, lag(x) OVER (PARTITION BY node_id, hour ORDER BY ts, event_id) AS px FROM s)
SELECT node_id, hour, count(*) AS n, {_metrics('node_id')} FROM lagged GROUP BY node_id, hour""")
def waveform_hourly(spark, sf_dir):
    """Per node and hour: waveform metrics of the PPV deviation signal (10-minute chunks for the lag)."""
    t = tables.telemetry(spark, sf_dir)
    s = t.select("node_id", F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"), "ts", "event_id",
                 F.floor((F.col("ppv_mms") - F.lit(2.0)) * F.lit(10.0)).cast("double").alias("x"))
    out = waveform.window_features(s, ["node_id", "hour"], ["ts", "event_id"], "x", F.floor(F.minute("ts") / 10))
    return finish(out.select("node_id", "hour", "n", *FEATURE_NAMES))


@register("waveform_gaps", f"""WITH raw_samples AS (
  SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS e FROM embeddings
  WHERE vec_id % 10 > 1),
samples AS (SELECT vec_id, i, cast(e AS DOUBLE)*3e0 AS x FROM raw_samples),
lagged AS (SELECT vec_id, i, x, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS px FROM samples),
found AS (SELECT vec_id, {_metrics('vec_id')} FROM lagged GROUP BY vec_id)
SELECT e.vec_id, {", ".join(FEATURE_NAMES)} FROM embeddings e LEFT JOIN found f ON e.vec_id = f.vec_id""")
def waveform_gaps(spark, sf_dir):
    """Fractional samples; every tenth buffer is empty, the one after it NULL: both keep their row, without metrics."""
    emb = tables.table(spark, sf_dir, "embeddings")
    samples = F.transform("embedding", lambda x: x.cast("double") * F.lit(3.0))
    buffers = emb.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<double>"))
                         .when(F.col("vec_id") % 10 > 1, samples).alias("samples"))
    out = buffers.select("vec_id", waveform_features("samples").alias("f"))
    return finish(out.select("vec_id", *[F.col(f"f.{n}").alias(n) for n in FEATURE_NAMES]))
