"""Physics feature expressions (plain Columns, whole-stage codegen friendly).

Every function takes and returns ``pyspark.sql.Column`` values, so the same
expressions serve batch DataFrames, streaming DataFrames and SQL views.
NULL behaves like a missing pandas value: it propagates through the math
(``greatest`` would otherwise skip it, so it is guarded).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorlake import constants as K

SQRT3 = math.sqrt(3.0)
DEG_TO_RAD = math.pi / 180.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe_greatest(*cols: Column) -> Column:
    """``greatest`` that returns NULL if any input is NULL (numpy ``maximum`` semantics)."""
    any_null = None
    for c in cols:
        any_null = c.isNull() if any_null is None else (any_null | c.isNull())
    return F.when(any_null, F.lit(None).cast("double")).otherwise(F.greatest(*cols))


def magnitude3(ax, ay, az) -> Column:
    """Resultant acceleration sqrt(ax^2 + ay^2 + az^2)."""
    ax, ay, az = col(ax), col(ay), col(az)
    return F.sqrt(ax * ax + ay * ay + az * az)


def magnitude2(ax, ay) -> Column:
    """Horizontal shear acceleration sqrt(ax^2 + ay^2)."""
    ax, ay = col(ax), col(ay)
    return F.sqrt(ax * ax + ay * ay)


def kinetic_energy(ppv) -> Column:
    """Kinetic energy proxy 0.5 * ppv^2."""
    ppv = col(ppv)
    return F.lit(0.5) * ppv * ppv


def wave_ratio(seismo, geo) -> Column:
    """|seismometer| / max(|geophone|, 1e-4)."""
    seismo, geo = col(seismo), col(geo)
    return F.abs(seismo) / null_safe_greatest(F.abs(geo), F.lit(K.WAVE_RATIO_FLOOR))


def spectral_power(psd, freq) -> Column:
    return col(psd) * col(freq)


def risk_from_ppv(ppv) -> Column:
    """PPV threshold label: < 2 NORMAL, < 4 WARNING, else CRITICAL."""
    ppv = col(ppv)
    return (F.when(ppv < K.PPV_WARNING_AT, F.lit(K.NORMAL))
            .when(ppv < K.PPV_CRITICAL_AT, F.lit(K.WARNING))
            .otherwise(F.lit(K.CRITICAL)))


def level_from_ppv(ppv) -> Column:
    ppv = col(ppv)
    return (F.when(ppv < K.PPV_WARNING_AT, F.lit("Low"))
            .when(ppv < K.PPV_CRITICAL_AT, F.lit("Medium"))
            .otherwise(F.lit("High")))


def risk_from_level(level) -> Column:
    """Low/Medium/High -> NORMAL/WARNING/CRITICAL; anything else (NULL too) -> WARNING."""
    level = col(level)
    expr = None
    for k, v in K.LEVEL_TO_RISK.items():
        expr = F.when(level == k, F.lit(v)) if expr is None else expr.when(level == k, F.lit(v))
    return expr.otherwise(F.lit(K.UNMAPPED_RISK))


def radians(deg) -> Column:
    return col(deg) * F.lit(DEG_TO_RAD)


def compact_acc(vibration, tilt_deg) -> tuple[Column, Column, Column]:
    """Synthesised (ax, ay, az) from a compact packet's vibration and tilt."""
    v, theta = col(vibration), radians(tilt_deg)
    ax = null_safe_greatest(F.abs(v * F.sin(theta)), v / F.lit(SQRT3))
    ay = v / F.lit(SQRT3)
    az = F.abs(v * F.cos(theta))
    return ax, ay, az


def clamp_floor(c, floor: float = K.CLAMP_FLOOR) -> Column:
    return null_safe_greatest(col(c), F.lit(floor))


def zscore_abs(x, mean, std) -> Column:
    return F.abs((col(x) - col(mean)) / (col(std) + F.lit(K.ZSCORE_EPS)))


def allclose(a, b, rtol: float = 1e-3, atol: float = 1e-8) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def none_literal_to_null(c) -> Column:
    """NULL or the literal text 'None' -> NULL (metadata echo)."""
    c = col(c).cast("string")
    return F.when(c == "None", F.lit(None).cast("string")).otherwise(c)
