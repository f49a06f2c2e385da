"""Column functions: physics features and waveform metrics (hand values of the reference tests)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import physics as P
from tremorlake.functions.waveform import FEATURE_NAMES, waveform_features
from tremorlake.operators import features, waveform


def test_raw9_derived_values(spark):
    # X2 fixture: (ax, ay, az, ppv, seismo, geo, psd, freq, temp)
    row = dict(acc_x_ms2=3.0, acc_y_ms2=4.0, acc_z_ms2=0.0, ppv_mms=10.0, seismometer_ms2=2.0, geophone_mms=1.0,
               psd_value=0.5, frequency_hz=20.0, temperature_c=28.0)
    df = spark.createDataFrame([row])
    r = features.derive(df).first()
    assert r["vibration_magnitude_ms2"] == pytest.approx(5.0, abs=1e-2)
    assert r["vibration_horizontal_ms2"] == pytest.approx(5.0, abs=1e-2)
    assert r["kinetic_energy_proxy"] == pytest.approx(50.0, abs=1e-2)
    assert r["accel_to_velocity_ratio"] == pytest.approx(2.0, abs=1e-2)
    assert r["spectral_power_product"] == pytest.approx(10.0, abs=1e-2)


def test_wave_ratio_floor_and_null(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, None), (-3.0, -2.0)], "s double, g double")
    out = [r[0] for r in df.select(P.wave_ratio("s", "g")).collect()]
    assert out[0] == pytest.approx(2.0 / 1e-4)
    assert out[1] is None  # NULL propagates like a missing value
    assert out[2] == pytest.approx(1.5)


def test_compact_packet_synthesis(spark):
    # X5 fixture: vibration 1.2, tilt 4.0, temperature 35, moisture 85, displacement 10
    df = spark.createDataFrame([(1.2, 4.0, 35.0, 85.0, 10.0, "ESP32_TEST_GATEWAY")],
                               "vibration double, tilt double, temperature double, moisture double, "
                               "displacement double, node_id string")
    r = features.derive(df).first()
    th = math.radians(4.0)
    ax = max(abs(1.2 * math.sin(th)), 1.2 / math.sqrt(3))
    ay, az = 1.2 / math.sqrt(3), abs(1.2 * math.cos(th))
    assert r["acc_x_ms2"] == pytest.approx(ax)
    assert r["acc_y_ms2"] == pytest.approx(ay)
    assert r["acc_z_ms2"] == pytest.approx(az)
    assert r["vibration_magnitude_ms2"] == pytest.approx(math.sqrt(ax * ax + ay * ay + az * az))
    assert r["ppv_mms"] == pytest.approx(33.6)
    assert r["geophone_mms"] == pytest.approx(33.6 * 0.6)
    assert r["psd_value"] == pytest.approx(0.01 * 1.44)
    assert r["frequency_hz"] == 28.0
    assert r["temperature_c"] == 35.0 and r["tilt_x_deg"] == 4.0 and r["tilt_y_deg"] == 0.0
    assert r["displacement_mm"] == 10.0 and r["moisture"] == 85.0


def test_partial_acc_replaced_entirely(spark):
    # one accelerometer channel present: all three are synthesised from vibration
    df = spark.createDataFrame([(1.0, 0.0, 9.0)], "vibration double, tilt double, acc_x_ms2 double")
    r = features.derive(df).first()
    assert r["acc_x_ms2"] == pytest.approx(1 / math.sqrt(3))


def test_model_matrix_absent_features_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "ppv_mms double, temperature_c double")
    r = features.model_matrix(df).first()
    assert r["kinetic_energy_proxy"] == 0.5 and r["psd_value"] == 0.0 and r["spectral_power_product"] == 0.0
    assert r["vibration_magnitude_ms2"] == 0.0 and r["risk_label"] == "NORMAL"


def _np_features(x):
    x = np.asarray(x, dtype=float)
    rms = float(np.sqrt(np.mean(x ** 2)))
    peak = float(np.max(np.abs(x)))
    return {"mean": float(np.mean(x)), "std": float(np.std(x)), "min": float(x.min()), "max": float(x.max()),
            "peak_amplitude": peak, "peak_to_peak": float(x.max() - x.min()), "rms": rms,
            "signal_energy": float(np.sum(x ** 2)), "crest_factor": peak / (rms + 1e-8),
            "zero_crossing_rate": int(np.sum(np.diff(np.sign(x) != 0))) / max(1, len(x) - 1),
            "sign_change_rate": int(np.sum(np.diff(np.sign(x)) != 0)) / max(1, len(x) - 1)}


def test_sine_buffer(spark):
    t = np.linspace(0, 1, 100)
    sig = (2 * np.sin(2 * np.pi * 5 * t)).tolist()
    df = spark.createDataFrame([(1, sig)], "id int, samples array<double>")
    f = df.select(waveform_features("samples").alias("f")).first()["f"].asDict()
    assert f["peak_amplitude"] == pytest.approx(2.0, abs=0.05)
    assert f["rms"] == pytest.approx(1.4142, abs=0.05)
    assert f["peak_to_peak"] == pytest.approx(4.0, abs=0.1)
    ref = _np_features(sig)
    for k in FEATURE_NAMES:
        assert f[k] == pytest.approx(ref[k], rel=1e-9, abs=1e-12), k


def test_crossing_counters_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 0.0, 0.0, 2.0]), (2, []), (3, [5.0])], "id int, samples array<double>")
    rows = {r["id"]: r["f"] for r in df.select("id", waveform_features("samples").alias("f")).collect()}
    assert rows[1]["zero_crossing_rate"] == pytest.approx(2 / 4)  # zero <-> non-zero transitions
    assert rows[1]["sign_change_rate"] == pytest.approx(3 / 4)
    assert rows[2] is None  # empty buffer -> no features
    assert rows[3]["zero_crossing_rate"] == 0.0


def test_grouped_form_equals_array_form(spark):
    rng = np.random.default_rng(7)
    bufs = {g: np.round(rng.normal(size=int(rng.integers(1, 70))), 1).tolist() for g in range(12)}
    long = spark.createDataFrame([(g, i, float(x)) for g, b in bufs.items() for i, x in enumerate(b)],
                                 "g int, i int, x double")
    out = waveform.window_features(long, ["g"], ["i"], "x", F.floor(F.col("i") / 8)).collect()
    assert len(out) == len(bufs)
    for r in out:
        ref = _np_features(bufs[r["g"]])
        for k in FEATURE_NAMES:
            assert r[k] == pytest.approx(ref[k], rel=1e-9, abs=1e-9), (r["g"], k)
