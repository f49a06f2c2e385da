"""Fixed values of the sensor data model.

Everything in this module is a FIXED VALUE that must equal the behaviour being
matched (feature order, header spellings, label names, thresholds, noise
levels, physical ranges, keyword groups).  They are stated plainly, in natural
order, and only here; the rest of the package imports them.
"""

from __future__ import annotations

# --- FIXED VALUES: hardware channels, derived features, model matrix order ---
RAW_CHANNELS = [
    "acc_x_ms2",
    "acc_y_ms2",
    "acc_z_ms2",
    "temperature_c",
    "ppv_mms",
    "frequency_hz",
    "psd_value",
    "geophone_mms",
    "seismometer_ms2",
]
DERIVED_FEATURES = [
    "vibration_magnitude_ms2",
    "vibration_horizontal_ms2",
    "kinetic_energy_proxy",
    "accel_to_velocity_ratio",
    "spectral_power_product",
]
FEATURES = RAW_CHANNELS + DERIVED_FEATURES

# --- FIXED VALUES: raw header spellings -> canonical snake_case names ---
CANONICAL_NAMES = {
    "Timestamp": "timestamp",
    "Blast_ID": "blast_id",
    "Charge_Weight(kg)": "charge_weight_kg",
    "Burden(m)": "burden_m",
    "Spacing(m)": "spacing_m",
    "Delay(ms)": "delay_ms",
    "Soil_Type": "soil_type",
    "Temperature(°C)": "temperature_c",
    "Temperature(C)": "temperature_c",
    "Wind_Speed(m/s)": "wind_speed_ms",
    "Seismometer(m/s²)": "seismometer_ms2",
    "Seismometer(m/s)": "seismometer_ms2",
    "Geophone(mm/s)": "geophone_mms",
    "Acc_X(m/s²)": "acc_x_ms2",
    "Acc_X(m/s)": "acc_x_ms2",
    "Acc_Y(m/s²)": "acc_y_ms2",
    "Acc_Y(m/s)": "acc_y_ms2",
    "Acc_Z(m/s²)": "acc_z_ms2",
    "Acc_Z(m/s)": "acc_z_ms2",
    "PSD_Value": "psd_value",
    "PPV(mm/s)": "ppv_mms",
    "Frequency(Hz)": "frequency_hz",
    "Vibration_Level": "vibration_level",
}

# --- FIXED VALUES: fallback header normaliser, applied in this order ---
HEADER_REPLACEMENTS = [(" ", "_"), ("(", "_"), (")", ""), ("/", "_"), ("°", ""), ("²", "2")]

# --- FIXED VALUES: label domain ---
NORMAL, WARNING, CRITICAL = "NORMAL", "WARNING", "CRITICAL"
LEVEL_TO_RISK = {"Low": NORMAL, "Medium": WARNING, "High": CRITICAL}
RISK_TO_LEVEL = {NORMAL: "Low", WARNING: "Medium", CRITICAL: "High"}
UNMAPPED_RISK = WARNING
CLASSES = [CRITICAL, NORMAL, WARNING]  # alphabetical: index 0, 1, 2

# --- FIXED VALUES: PPV thresholds (mm/s): < 2 NORMAL, < 4 WARNING, else CRITICAL ---
PPV_WARNING_AT = 2.0
PPV_CRITICAL_AT = 4.0

# --- FIXED VALUES: physics constants ---
WAVE_RATIO_FLOOR = 1e-4  # floor of |geophone| in the wave ratio
COMPACT_PPV_PER_VIBRATION = 28.0  # ppv (mm/s) ~= 28 * vibration (m/s^2)
COMPACT_GEOPHONE_PER_PPV = 0.6
COMPACT_FREQUENCY_HZ = 28.0
COMPACT_PSD_PER_VIBRATION_SQ = 0.01
CREST_EPS = 1e-8
ZSCORE_EPS = 1e-10
ZSCORE_LIMIT = 3.0
IQR_K = 1.5
RULE_ALERT_MAGNITUDE = 2.0  # resultant acceleration alert (m/s^2)

# --- FIXED VALUES: augmentation noise (Gaussian sigma per channel) ---
NOISE_SIGMA = {
    "acc_x_ms2": 0.004,
    "acc_y_ms2": 0.004,
    "acc_z_ms2": 0.004,
    "temperature_c": 0.5,
    "ppv_mms": 0.05,
    "frequency_hz": 0.5,
    "psd_value": 0.005,
    "geophone_mms": 0.05,
    "seismometer_ms2": 0.02,
    "wind_speed_ms": 0.3,
    "charge_weight_kg": 0.0,
    "burden_m": 0.0,
    "spacing_m": 0.0,
    "delay_ms": 0.0,
}
CLAMP_COLUMNS = ["ppv_mms", "frequency_hz", "psd_value", "geophone_mms", "acc_x_ms2", "acc_y_ms2", "acc_z_ms2"]
CLAMP_FLOOR = 0.001
AUGMENT_FACTOR = 9
SEED = 42

# --- FIXED VALUES: physical range rules (low, high) ---
RANGE_RULES = {
    "acc_x_ms2": (-50.0, 50.0),
    "acc_y_ms2": (-50.0, 50.0),
    "acc_z_ms2": (-50.0, 50.0),
    "ppv_mms": (0.0, 1000.0),
    "frequency_hz": (0.0, 500.0),
    "psd_value": (0.0, 1e6),
    "geophone_mms": (0.0, 1000.0),
    "seismometer_ms2": (-50.0, 50.0),
    "temperature_c": (-40.0, 80.0),
}

# --- FIXED VALUES: domain keyword groups, first match wins, in this order ---
DOMAIN_GROUPS = [
    ("Target / Risk / Labels",
     ["risk", "level", "label", "category", "target", "class", "damage", "warning", "severity", "status"]),
    ("Vibration / Acceleration", ["vibrat", "acc", "seismo", "geophone", "displacement", "tilt"]),
    ("Frequency / Dynamic Shock", ["freq", "hz", "dominant", "psd"]),
    ("PPV (Peak Particle Velocity)", ["ppv", "peak_particle", "velocity"]),
    ("Temperature / Environmental", ["temp", "humidity", "wind", "rain", "weather", "moisture", "pressure"]),
    ("Soil / Geological Parameters", ["soil", "rock", "geo", "strata", "density"]),
    ("Blast / Mining Operations", ["blast", "charge", "distance", "hole", "depth", "burden", "spacing", "delay"]),
]

# --- FIXED VALUES: learner settings ---
FOREST_PARAMS = dict(numTrees=150, maxDepth=12, minInstancesPerNode=2, seed=SEED)
BOOSTED_PARAMS = dict(maxIter=120, stepSize=0.08, maxDepth=6, subsamplingRate=0.85, seed=SEED)
BOOSTED_FEATURE_FRACTION = "0.85"
LEAK_TREE_DEPTH = 2
LEAK_ACCURACY = 0.98
TEST_FRACTION = 0.2
N_FOLDS = 5
FOREST_NAME = "Random Forest"
BOOSTED_NAME = "Gradient Boosting"

# --- FIXED VALUES: columns of the observation store ---
STORE_STRING_FIELDS = ["blast_id", "soil_type", "vibration_level", "risk_label"]
STORE_DOUBLE_FIELDS = ["charge_weight_kg", "burden_m", "spacing_m", "delay_ms", "temperature_c", "wind_speed_ms",
                       "seismometer_ms2", "geophone_mms", "acc_x_ms2", "acc_y_ms2", "acc_z_ms2", "psd_value",
                       "ppv_mms", "frequency_hz"]
