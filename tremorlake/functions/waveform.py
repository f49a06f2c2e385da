"""Waveform-buffer features on an ``array<double>`` column, with higher-order functions.

No UDF: ``aggregate``/``transform``/``zip_with`` run inside the JVM and keep
the projection in whole-stage codegen.  An empty buffer gives a NULL struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorlake import constants as K

FEATURE_NAMES = ["mean", "std", "min", "max", "peak_amplitude", "peak_to_peak", "rms",
                 "signal_energy", "crest_factor", "zero_crossing_rate", "sign_change_rate"]


def _sum(arr: Column, fn=None) -> Column:
    zero = F.lit(0.0).cast("double")
    if fn is None:
        return F.aggregate(arr, zero, lambda acc, x: acc + x)
    return F.aggregate(arr, zero, lambda acc, x: acc + fn(x))


def _pairs(arr: Column, changed) -> Column:
    """Count adjacent pairs (a, b) where ``changed(a, b)`` holds."""
    n = F.size(arr)
    head = F.slice(arr, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(arr, F.lit(2), F.greatest(n - 1, F.lit(0)))
    flags = F.zip_with(head, tail, lambda a, b: F.when(changed(a, b), F.lit(1)).otherwise(F.lit(0)))
    return F.aggregate(flags, F.lit(0), lambda acc, x: acc + x)


def waveform_features(samples) -> Column:
    """Struct of the 11 waveform metrics for each buffer (NULL for an empty buffer)."""
    w = F.col(samples) if isinstance(samples, str) else samples
    n = F.size(w).cast("double")
    mean = _sum(w) / n
    std = F.sqrt(_sum(w, lambda x: (x - mean) * (x - mean)) / n)
    mn, mx = F.array_min(w), F.array_max(w)
    peak = F.array_max(F.transform(w, lambda x: F.abs(x)))
    energy = _sum(w, lambda x: x * x)
    rms = F.sqrt(energy / n)
    steps = F.greatest(n - 1, F.lit(1.0))
    zcr = _pairs(w, lambda a, b: (a != 0) != (b != 0)) / steps
    scr = _pairs(w, lambda a, b: F.signum(a) != F.signum(b)) / steps
    feats = F.struct(
        mean.alias("mean"), std.alias("std"), mn.alias("min"), mx.alias("max"),
        peak.alias("peak_amplitude"), (mx - mn).alias("peak_to_peak"), rms.alias("rms"),
        energy.alias("signal_energy"), (peak / (rms + F.lit(K.CREST_EPS))).alias("crest_factor"),
        zcr.alias("zero_crossing_rate"), scr.alias("sign_change_rate"),
    )
    return F.when(F.size(w) > 0, feats)

