"""SQL text of the table bindings, for the DuckDB oracle.

Each constant is a CTE body that computes exactly what the matching function
in ``tremorlake.sources.tables`` computes, in the same operation order.
Literals are written as ``e0`` doubles so neither engine infers DECIMAL.
"""

TELEMETRY = """telemetry AS (
  SELECT event_id, ts, concat('NODE_', cast(user_id AS VARCHAR)) AS node_id, event_type,
         value/25e0 AS ppv_mms,
         20e0 + cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)*0.2e0 AS temperature_c,
         0.02e0 + (event_id % 7)*0.013e0 AS acc_x_ms2,
         0.02e0 + (event_id % 11)*0.009e0 AS acc_y_ms2,
         0.03e0 + (event_id % 13)*0.006e0 AS acc_z_ms2,
         15e0 + (event_id % 50)*0.7e0 AS frequency_hz,
         value/250e0 AS psd_value,
         value/25e0*0.6e0 AS geophone_mms,
         value/50e0 AS seismometer_ms2
  FROM events)"""

# raw-9 packets with the five derived features and the PPV threshold label
FEATURED = TELEMETRY + """,
featured AS (
  SELECT *,
         sqrt(acc_x_ms2*acc_x_ms2 + acc_y_ms2*acc_y_ms2 + acc_z_ms2*acc_z_ms2) AS vibration_magnitude_ms2,
         sqrt(acc_x_ms2*acc_x_ms2 + acc_y_ms2*acc_y_ms2) AS vibration_horizontal_ms2,
         0.5e0*ppv_mms*ppv_mms AS kinetic_energy_proxy,
         abs(seismometer_ms2)/greatest(abs(geophone_mms), 1e-4) AS accel_to_velocity_ratio,
         psd_value*frequency_hz AS spectral_power_product,
         CASE WHEN ppv_mms < 2e0 THEN 'NORMAL' WHEN ppv_mms < 4e0 THEN 'WARNING' ELSE 'CRITICAL' END AS risk_label
  FROM telemetry)"""

COMPACT = """compact AS (
  SELECT event_id,
         CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'None'
              ELSE concat('NODE_', cast(user_id AS VARCHAR)) END AS node_id,
         CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 73 = 0 THEN 'None'
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS "timestamp",
         value/100e0 AS vibration,
         CASE WHEN event_id % 47 = 0 THEN NULL ELSE cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS tilt,
         20e0 + (event_id % 30)*0.5e0 AS temperature,
         CASE WHEN event_id % 43 = 0 THEN NULL ELSE cast(event_id % 100 AS DOUBLE) END AS moisture,
         value/50e0 AS displacement
  FROM events)"""

RAW = """raw_base AS (
  SELECT event_id,
         CASE WHEN event_id % 53 = 0 THEN 'not-a-time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS "Timestamp",
         concat('BLAST_', cast(event_id % 37 AS VARCHAR)) AS "Blast_ID",
         50e0 + (event_id % 17)*5e0 AS "Charge_Weight(kg)",
         2e0 + (event_id % 5)*0.5e0 AS "Burden(m)",
         3e0 + (event_id % 4)*0.5e0 AS "Spacing(m)",
         (event_id % 6)*17e0 AS "Delay(ms)",
         CASE WHEN event_id % 61 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'Clay' WHEN user_id % 4 = 1 THEN 'Gravel'
              WHEN user_id % 4 = 2 THEN 'Rock' WHEN user_id % 4 = 3 THEN 'Sand' END AS "Soil_Type",
         CASE WHEN event_id % 83 = 0 THEN 200e0
              ELSE 20e0 + cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)*0.2e0 END AS "Temperature(°C)",
         (event_id % 9)*0.7e0 AS "Wind_Speed(m/s)",
         value/50e0 AS "Seismometer(m/s²)",
         value/25e0*0.6e0 AS "Geophone(mm/s)",
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE 0.02e0 + (event_id % 7)*0.013e0 END AS "Acc_X(m/s²)",
         0.02e0 + (event_id % 11)*0.009e0 AS "Acc_Y(m/s²)",
         0.03e0 + (event_id % 13)*0.006e0 AS "Acc_Z(m/s²)",
         value/250e0 AS "PSD_Value",
         value/25e0 AS "PPV(mm/s)",
         15e0 + (event_id % 50)*0.7e0 AS "Frequency(Hz)",
         CASE WHEN event_id % 89 = 0 THEN 'Unknown' WHEN event_id % 71 = 0 THEN NULL
              WHEN value < 50e0 THEN 'Low' WHEN value < 100e0 THEN 'Medium' ELSE 'High' END AS "Vibration_Level"
  FROM events),
raw AS (SELECT * FROM raw_base UNION ALL SELECT * FROM raw_base WHERE event_id % 101 = 0)"""

# canonical names of the raw table (rename only)
RENAMED = RAW + """,
renamed AS (
  SELECT event_id, "Timestamp" AS "timestamp", "Blast_ID" AS blast_id, "Charge_Weight(kg)" AS charge_weight_kg,
         "Burden(m)" AS burden_m, "Spacing(m)" AS spacing_m, "Delay(ms)" AS delay_ms, "Soil_Type" AS soil_type,
         "Temperature(°C)" AS temperature_c, "Wind_Speed(m/s)" AS wind_speed_ms,
         "Seismometer(m/s²)" AS seismometer_ms2, "Geophone(mm/s)" AS geophone_mms,
         "Acc_X(m/s²)" AS acc_x_ms2, "Acc_Y(m/s²)" AS acc_y_ms2, "Acc_Z(m/s²)" AS acc_z_ms2,
         "PSD_Value" AS psd_value, "PPV(mm/s)" AS ppv_mms, "Frequency(Hz)" AS frequency_hz,
         "Vibration_Level" AS vibration_level
  FROM raw)"""

WAVES = """raw_samples AS (
  SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS e FROM embeddings),
samples AS (
  SELECT vec_id, label, i, round(cast(e AS DOUBLE)*10e0, 0) AS x FROM raw_samples)"""

# the dirty packets as the reports see them: NaN is missing; infinities in their own columns
DIRTY = TELEMETRY + """,
dirty AS (
  SELECT event_id, CASE WHEN event_id % 37 <> 0 THEN event_id END AS packet,
         CASE WHEN event_id % 19 = 0 THEN NULL WHEN ppv_mms < 2e0 THEN 'NORMAL' WHEN ppv_mms < 4e0 THEN 'WARNING'
              ELSE 'CRITICAL' END AS risk_label,
         CASE WHEN event_id % 29 <> 0 THEN ppv_mms END AS ppv_mms,
         CASE WHEN event_id % 211 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 223 = 0 THEN CAST('-inf' AS DOUBLE)
              ELSE seismometer_ms2 END AS seismometer_ms2,
         CASE WHEN event_id % 211 <> 0 AND event_id % 223 <> 0 THEN seismometer_ms2 END AS finite_seismometer,
         geophone_mms, temperature_c, 1e0 AS gain
  FROM telemetry)"""
