"""Queries: packet features, labels, projections (M1-M11, P2-P10, ST5 batch form)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions import physics as P
from tremorlake.operators import clean, features
from tremorlake.plans import sql as S
from tremorlake.plans.registry import finish, register
from tremorlake.sources import tables

DEG = repr(math.pi / 180.0)

DERIVED_SQL = ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in K.DERIVED_FEATURES)


@register("risk_by_node", f"""
WITH {S.FEATURED}
SELECT node_id, risk_label, count(*) AS n_packets,
       round(avg(vibration_magnitude_ms2), 6) + 0e0 AS mean_magnitude,
       round(max(ppv_mms), 6) + 0e0 AS max_ppv,
       round(sum(kinetic_energy_proxy), 6) + 0e0 AS total_energy
FROM featured GROUP BY node_id, risk_label""")
def risk_by_node(spark, sf_dir):
    """Flagship: per node and risk class, packet count, mean resultant acceleration, peak PPV, energy."""
    t = features.derive(tables.telemetry(spark, sf_dir))
    t = t.withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    out = t.groupBy("node_id", "risk_label").agg(
        F.count("*").alias("n_packets"),
        F.avg("vibration_magnitude_ms2").alias("mean_magnitude"),
        F.max("ppv_mms").alias("max_ppv"),
        F.sum("kinetic_energy_proxy").alias("total_energy"),
    )
    return finish(out)


@register("derive_raw9", f"""
WITH {S.FEATURED}
SELECT event_id, {DERIVED_SQL} FROM featured""")
def derive_raw9(spark, sf_dir):
    t = features.derive(tables.telemetry(spark, sf_dir))
    return finish(t.select("event_id", *K.DERIVED_FEATURES))


_COMPACT_CTE = f"""
WITH {S.COMPACT},
acc AS (
  SELECT *, tilt*{DEG}e0 AS theta FROM compact),
syn AS (
  SELECT event_id, temperature AS temperature_c, tilt AS tilt_x_deg, 0e0 AS tilt_y_deg,
         displacement AS displacement_mm,
         CASE WHEN theta IS NULL OR vibration IS NULL THEN NULL
              ELSE greatest(abs(vibration*sin(theta)), vibration/sqrt(3e0)) END AS acc_x_ms2,
         vibration/sqrt(3e0) AS acc_y_ms2,
         abs(vibration*cos(theta)) AS acc_z_ms2,
         vibration*28e0 AS ppv_mms,
         vibration*28e0*0.6e0 AS geophone_mms,
         vibration AS seismometer_ms2,
         28e0 AS frequency_hz,
         0.01e0*(vibration*vibration) AS psd_value
  FROM acc),
der AS (
  SELECT *,
         sqrt(acc_x_ms2*acc_x_ms2 + acc_y_ms2*acc_y_ms2 + acc_z_ms2*acc_z_ms2) AS vibration_magnitude_ms2,
         sqrt(acc_x_ms2*acc_x_ms2 + acc_y_ms2*acc_y_ms2) AS vibration_horizontal_ms2,
         0.5e0*ppv_mms*ppv_mms AS kinetic_energy_proxy,
         abs(seismometer_ms2)/greatest(abs(geophone_mms), 1e-4) AS accel_to_velocity_ratio,
         psd_value*frequency_hz AS spectral_power_product
  FROM syn)"""

_COMPACT_DERIVED = _COMPACT_CTE + f"""
SELECT event_id, tilt_y_deg,
       {", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in ["tilt_x_deg", "displacement_mm"] + K.FEATURES)}
FROM der"""


@register("derive_compact5", _COMPACT_DERIVED)
def derive_compact5(spark, sf_dir):
    d = features.derive(tables.compact_packets(spark, sf_dir))
    cols = ["event_id", "tilt_y_deg", "tilt_x_deg", "displacement_mm"] + K.FEATURES
    return finish(d.select(*cols))


@register("model_matrix14", f"""
WITH {S.RENAMED}
SELECT event_id, {", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in [
    "acc_x_ms2", "acc_y_ms2", "acc_z_ms2", "temperature_c", "ppv_mms"])},
       0e0 AS frequency_hz, 0e0 AS psd_value,
       round(geophone_mms, 6) + 0e0 AS geophone_mms, round(seismometer_ms2, 6) + 0e0 AS seismometer_ms2,
       round(sqrt(acc_x_ms2*acc_x_ms2 + acc_y_ms2*acc_y_ms2 + acc_z_ms2*acc_z_ms2), 6) + 0e0 AS vibration_magnitude_ms2,
       round(sqrt(acc_x_ms2*acc_x_ms2 + acc_y_ms2*acc_y_ms2), 6) + 0e0 AS vibration_horizontal_ms2,
       round(0.5e0*ppv_mms*ppv_mms, 6) + 0e0 AS kinetic_energy_proxy,
       round(abs(seismometer_ms2)/greatest(abs(geophone_mms), 1e-4), 6) + 0e0 AS accel_to_velocity_ratio,
       0e0 AS spectral_power_product,
       CASE vibration_level WHEN 'Low' THEN 'NORMAL' WHEN 'Medium' THEN 'WARNING' WHEN 'High' THEN 'CRITICAL'
            ELSE 'WARNING' END AS risk_label
FROM renamed""")
def model_matrix14(spark, sf_dir):
    """Ordered 14-feature matrix of a frame without PSD/frequency: absent -> 0.0, label from the level."""
    raw = clean.canonical_names(tables.raw_blast_table(spark, sf_dir)).drop("psd_value", "frequency_hz")
    return finish(features.model_matrix(raw, keep=["event_id"]))


@register("map_labels", f"""
WITH {S.RENAMED}
SELECT event_id, vibration_level,
       CASE vibration_level WHEN 'Low' THEN 'NORMAL' WHEN 'Medium' THEN 'WARNING' WHEN 'High' THEN 'CRITICAL'
            ELSE 'WARNING' END AS risk_label
FROM renamed""")
def map_labels(spark, sf_dir):
    raw = clean.canonical_names(tables.raw_blast_table(spark, sf_dir))
    return raw.select("event_id", "vibration_level", clean.label_column(raw).alias("risk_label"))


@register("label_resolution", f"""
WITH {S.FEATURED}
SELECT 'risk_label' AS source, risk_label, count(*) AS n FROM featured GROUP BY risk_label
UNION ALL
SELECT 'vibration_level' AS source, risk_label, count(*) AS n FROM featured GROUP BY risk_label
UNION ALL
SELECT 'none' AS source, 'NORMAL' AS risk_label, count(*) AS n FROM featured""")
def label_resolution(spark, sf_dir):
    """Training label precedence on three frames: risk_label, else mapped level, else NORMAL."""
    t = tables.telemetry(spark, sf_dir)
    with_risk = t.withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    with_level = t.withColumn("vibration_level", P.level_from_ppv("ppv_mms"))
    neither = t
    parts = []
    for name, frame in [("risk_label", with_risk), ("vibration_level", with_level), ("none", neither)]:
        m = features.model_matrix(frame, with_label=True)
        parts.append(m.groupBy("risk_label").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("source"), "risk_label", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("normalize_headers", """
WITH h AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || ' (m/s²)' WHEN 1 THEN chr(9) || p_type || ' (°C) '
                  WHEN 2 THEN upper(p_type) || '/(kg)' ELSE p_type END AS header FROM part)
SELECT p_partkey, header,
       translate(lower(trim(header, ' ' || chr(9) || chr(10) || chr(13))), ' (/²)°', '___2') AS normalized
FROM h""")
def normalize_headers(spark, sf_dir):
    """Fallback header normaliser as a column function: part types with units, blanks and symbols as headers."""
    kind, t = F.col("p_partkey") % 4, F.col("p_type")
    header = (F.when(kind == 0, F.concat(t, F.lit(" (m/s²)"))).when(kind == 1, F.concat(F.lit("\t"), t, F.lit(" (°C) ")))
              .when(kind == 2, F.concat(F.upper(t), F.lit("/(kg)"))).otherwise(t))
    p = tables.table(spark, sf_dir, "part").select("p_partkey", header.alias("header"))
    return p.select("p_partkey", "header", clean.normalize_name_column(F.col("header")).alias("normalized"))


@register("canonical_rename", f"""
WITH {S.RENAMED}
SELECT event_id, "timestamp", blast_id, soil_type, vibration_level,
       {", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in [
           "charge_weight_kg", "burden_m", "spacing_m", "delay_ms", "temperature_c", "wind_speed_ms",
           "seismometer_ms2", "geophone_mms", "acc_x_ms2", "acc_y_ms2", "acc_z_ms2", "psd_value", "ppv_mms",
           "frequency_hz"])}
FROM renamed""")
def canonical_rename(spark, sf_dir):
    return finish(clean.canonical_names(tables.raw_blast_table(spark, sf_dir)))


_HW = ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in K.RAW_CHANNELS)


@register("hardware_projection", f"""
WITH {S.FEATURED}
SELECT event_id, {_HW}, risk_label FROM featured""")
def hardware_projection(spark, sf_dir):
    t = tables.telemetry(spark, sf_dir).withColumn("risk_label", P.risk_from_ppv("ppv_mms"))
    with_blast = t.withColumn("blast_id", F.lit("B")).withColumn("burden_m", F.lit(1.0))
    return finish(features.hardware_projection(with_blast, keep=["event_id"]))


@register("validate_packets", f"""
WITH {S.COMPACT}
SELECT event_id,
       (vibration IS NOT NULL AND tilt IS NOT NULL AND temperature IS NOT NULL AND moisture IS NOT NULL
        AND displacement IS NOT NULL) AS is_valid,
       (CASE WHEN vibration IS NULL THEN 1 ELSE 0 END + CASE WHEN tilt IS NULL THEN 1 ELSE 0 END
        + CASE WHEN temperature IS NULL THEN 1 ELSE 0 END + CASE WHEN moisture IS NULL THEN 1 ELSE 0 END
        + CASE WHEN displacement IS NULL THEN 1 ELSE 0 END) AS n_missing
FROM compact""")
def validate_packets(spark, sf_dir):
    c = tables.compact_packets(spark, sf_dir)
    return clean.validate_compact(c).select("event_id", "is_valid", "n_missing")


@register("metadata_echo", f"""
WITH {S.COMPACT}
SELECT event_id,
       CASE WHEN node_id = 'None' THEN NULL ELSE node_id END AS node_id,
       coalesce(CASE WHEN "timestamp" = 'None' THEN NULL ELSE "timestamp" END, 'now') AS "timestamp"
FROM compact""")
def metadata_echo(spark, sf_dir):
    """Node and time as the scorer echoes them; the time of scoring, which a missing time becomes, reads 'now'."""
    c = tables.compact_packets(spark, sf_dir)
    back = clean.echo_metadata(c).select("event_id", "node_id", "timestamp")
    scored_now = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))) < 86400
    return back.withColumn("timestamp", F.when(F.coalesce(scored_now, F.lit(False)), F.lit("now"))
                           .otherwise(F.col("timestamp")))


@register("rule_alerts", f"""
WITH {S.FEATURED}
SELECT event_id, node_id, round(vibration_magnitude_ms2, 6) + 0e0 AS vibration_magnitude_ms2
FROM featured WHERE vibration_magnitude_ms2 > 0.15e0""")
def rule_alerts(spark, sf_dir):
    """Resultant-acceleration rule alert, model independent (threshold 0.15 m/s^2 for this binding)."""
    t = features.derive(tables.telemetry(spark, sf_dir))
    return finish(clean.rule_alerts(t, threshold=0.15).select("event_id", "node_id", "vibration_magnitude_ms2"))


@register("ke_allclose", f"""
WITH {S.FEATURED}
SELECT bool_and(abs(kinetic_energy_proxy - 0.5e0*ppv_mms*ppv_mms) <= 1e-8 + 1e-3*abs(0.5e0*ppv_mms*ppv_mms))
         AS ke_matches,
       bool_and(abs(kinetic_energy_proxy - ppv_mms) <= 1e-8 + 1e-3*abs(ppv_mms)) AS ke_equals_ppv
FROM featured""")
def ke_allclose(spark, sf_dir):
    """All-rows closeness probe: kinetic energy is exactly 0.5*ppv^2 (a leak marker)."""
    t = features.derive(tables.telemetry(spark, sf_dir))
    return t.agg(
        F.bool_and(P.allclose("kinetic_energy_proxy", P.kinetic_energy("ppv_mms"))).alias("ke_matches"),
        F.bool_and(P.allclose("kinetic_energy_proxy", "ppv_mms")).alias("ke_equals_ppv"),
    )


@register("clamp_channels", f"""
WITH {S.TELEMETRY}
SELECT event_id, {", ".join(f"round(greatest({c} - 0.5e0, 0.001e0), 6) + 0e0 AS {c}" for c in K.CLAMP_COLUMNS)}
FROM telemetry""")
def clamp_channels(spark, sf_dir):
    """Clamp of the non-negative channels to >= 0.001 (on channels shifted down by 0.5)."""
    t = tables.telemetry(spark, sf_dir)
    return finish(t.select("event_id", *[P.clamp_floor(F.col(c) - F.lit(0.5)).alias(c) for c in K.CLAMP_COLUMNS]))
