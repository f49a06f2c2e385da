"""Streaming queries (ST1-ST7): packets derived from ``events`` land in a folder under the shared
checkpoint directory, an ``availableNow`` stream drains it, and the query returns the sink table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.waveform import FEATURE_NAMES
from tremorlake.plans import sql as S
from tremorlake.plans.q_features import _COMPACT_CTE
from tremorlake.plans.q_waveform import _metrics
from tremorlake.plans.registry import finish, register
from tremorlake.session import scratch_dir
from tremorlake.sources import tables
from tremorlake.streaming import packets


def _compact_with_time(spark, sf_dir):
    return tables.compact_packets(spark, sf_dir).select(*[f.name for f in packets.COMPACT_SCHEMA.fields])


def _raw9_with_time(spark, sf_dir):
    t = tables.telemetry(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return t.select(*[f.name for f in packets.RAW9_SCHEMA.fields])


@register("stream_scores", f"""WITH {S.COMPACT},
v AS (SELECT event_id, vibration IS NOT NULL AND tilt IS NOT NULL AND temperature IS NOT NULL AND moisture IS NOT NULL
        AND displacement IS NOT NULL AS ok, CASE WHEN node_id = 'None' THEN NULL ELSE node_id END AS node_id FROM compact)
SELECT CASE WHEN ok THEN 'scores' ELSE 'quarantine' END AS sink, event_id, CASE WHEN ok THEN node_id END AS node_id,
       ok AS in_domain, ok AS alert_follows FROM v""")
def stream_scores(spark, sf_dir):
    """ST1-ST4: compact packets stream -> valid/quarantine -> features -> forest score -> CRITICAL alerts."""
    from tremorlake.plans.q_model import forest

    fitted = forest(spark, sf_dir)
    base = scratch_dir(spark, "stream-scores")
    src = packets.write_packet_files(_compact_with_time(spark, sf_dir), f"{base}/in")
    q = packets.score_stream(packets.read_packets(spark, src, packets.COMPACT_SCHEMA, files_per_trigger=2),
                             fitted, K.FOREST_NAME, f"{base}/out", f"{base}/ckpt")
    packets.run(q)
    scores, alerts, held = (spark.read.parquet(f"{base}/out/{s}") for s in ("scores", "alerts", "quarantine"))
    raised = scores.join(alerts.select("event_id", F.lit(True).alias("alert")), "event_id", "left").select(
        F.lit("scores").alias("sink"), "event_id", "node_id", F.col("risk_level").isin(*K.CLASSES).alias("in_domain"),
        (F.col("alert").isNotNull() == (F.col("risk_level") == K.CRITICAL)).alias("alert_follows"))
    return raised.unionByName(held.select(
        F.lit("quarantine").alias("sink"), "event_id", F.lit(None).cast("string").alias("node_id"),
        F.lit(False).alias("in_domain"), F.lit(False).alias("alert_follows")))


@register("stream_json", f"""WITH {S.COMPACT},
f AS (SELECT *, event_id % 53 = 2 OR event_id % 37 = 5 AS broken, event_id % 41 = 3 AS word FROM compact),
g AS (SELECT *, CASE WHEN word THEN 'mistyped: vibration' END AS wrong,
        CASE WHEN tilt IS NULL AND moisture IS NULL THEN 'missing: tilt,moisture' WHEN tilt IS NULL THEN 'missing: tilt'
             WHEN moisture IS NULL THEN 'missing: moisture' END AS absent FROM f),
h AS (SELECT *, CASE WHEN broken THEN 'malformed' ELSE nullif(concat_ws('; ', wrong, absent), '') END AS reason FROM g)
SELECT event_id, CASE WHEN reason IS NULL THEN 'packets' ELSE 'quarantine' END AS sink, reason,
       CASE WHEN NOT broken THEN node_id END AS node_id,
       CASE WHEN NOT broken AND NOT word THEN round(vibration, 6) + 0e0 END AS vibration,
       CASE WHEN NOT broken THEN round(tilt, 6) + 0e0 END AS tilt FROM h""")
def stream_json(spark, sf_dir):
    """ST1 on JSON lines: cut lines (every 37th id) and lines of other text (every 53rd) are malformed, a reading
    in words (every 41st) is mistyped, absent readings are missing; the quarantine names the reason."""
    eid = F.col("event_id")
    text = F.to_json(F.struct(*[f.name for f in packets.COMPACT_SCHEMA.fields]))
    text = F.when(eid % 41 == 3, F.regexp_replace(text, r'"vibration":[^,}]+', '"vibration":"high"')).otherwise(text)
    text = F.when(eid % 53 == 2, F.concat(F.lit("packet event_id="), eid.cast("string"))) \
        .when(eid % 37 == 5, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    base = scratch_dir(spark, "stream-json")
    _compact_with_time(spark, sf_dir).select(text.alias("value")).write.text(f"{base}/in")
    packets.run(packets.ingest_json(packets.read_json_lines(spark, f"{base}/in", files_per_trigger=1000),
                                    f"{base}/out", f"{base}/ckpt"))
    valid, held = (packets.ingested(spark, f"{base}/out", s) for s in ("packets", "quarantine"))
    known = F.coalesce("event_id", F.regexp_extract("line", r"event_id\W+([0-9]+)", 1).cast("long")).alias("event_id")
    return finish(valid.select("event_id", F.lit("packets").alias("sink"), F.lit(None).cast("string").alias("reason"),
                               "node_id", "vibration", "tilt")
                  .unionByName(held.select(known, F.lit("quarantine").alias("sink"), "reason", "node_id", "vibration",
                                           "tilt")))


@register("stream_rule_alerts", _COMPACT_CTE + """
SELECT event_id, round(vibration_magnitude_ms2, 6) + 0e0 AS vibration_magnitude_ms2
FROM der WHERE vibration_magnitude_ms2 > 2e0""")
def stream_rule_alerts(spark, sf_dir):
    """ST5: resultant acceleration above 2.0 m/s^2 on the compact packet stream (no model)."""
    base = scratch_dir(spark, "stream-rule")
    src = packets.write_packet_files(_compact_with_time(spark, sf_dir), f"{base}/in")
    q = packets.rule_alert_stream(packets.read_packets(spark, src, packets.COMPACT_SCHEMA, files_per_trigger=1000),
                                  f"{base}/out", f"{base}/ckpt")
    packets.run(q)
    return finish(spark.read.parquet(f"{base}/out").select("event_id", "vibration_magnitude_ms2"))


@register("stream_windows", f"""WITH {S.TELEMETRY},
s AS (SELECT node_id, time_bucket(INTERVAL '1 hour', ts) AS ws, ts, event_id,
             floor((ppv_mms - 2e0)*10e0) AS x FROM telemetry),
lagged AS (SELECT *, lag(x) OVER (PARTITION BY node_id, ws ORDER BY ts, event_id) AS px FROM s)
SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, node_id, count(*) AS n, {_metrics('node_id')}
FROM lagged GROUP BY node_id, ws
HAVING ws + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM telemetry)""")
def stream_windows(spark, sf_dir):
    """ST6: hourly per-node waveform features of the PPV deviation signal: the windows that the watermark
    (latest time less ten minutes) has closed."""
    base = scratch_dir(spark, "stream-windows")
    t = _raw9_with_time(spark, sf_dir)
    src = packets.write_packet_files(t, f"{base}/in")
    stream = packets.read_packets(spark, src, packets.RAW9_SCHEMA, files_per_trigger=1000) \
        .withColumn("x", F.floor((F.col("ppv_mms") - F.lit(2.0)) * F.lit(10.0)).cast("double"))
    q = packets.window_stream(stream, "x", f"{base}/out", f"{base}/ckpt")
    packets.run(q)
    out = spark.read.parquet(f"{base}/out")
    return finish(out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "node_id", "n",
                             *FEATURE_NAMES))


@register("stream_dedup", f"""WITH {S.TELEMETRY}
SELECT DISTINCT event_id, node_id, {"round(ppv_mms, 6) + 0e0"} AS ppv_mms FROM telemetry""")
def stream_dedup(spark, sf_dir):
    """ST7: repeated packets (every 101st id sent twice) dropped within the watermark."""
    t = _raw9_with_time(spark, sf_dir)
    dup = t.unionByName(t.where(F.col("event_id") % 101 == 0))
    base = scratch_dir(spark, "stream-dedup")
    src = packets.write_packet_files(dup, f"{base}/in")
    q = packets.dedup_stream(packets.read_packets(spark, src, packets.RAW9_SCHEMA, files_per_trigger=1000),
                             f"{base}/out", f"{base}/ckpt")
    packets.run(q)
    return finish(spark.read.parquet(f"{base}/out").select("event_id", "node_id", "ppv_mms"))
