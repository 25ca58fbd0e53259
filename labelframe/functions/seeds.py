"""Values derived from SHA-256 of names: seeds, units, styles, picks, smooth fields. No generator state, so any order gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest settings that keep a glyph readable (fixed values).
LIMITS = {
    "baseline_amplitude_px": 6.0,
    "baseline_min_wavelength_px": 300.0,
    "size_drift_ratio": 0.08,
    "rotation_degrees": 4.0,
    "elastic_grid_size": 4,
    "elastic_displacement_ratio": 0.04,
    "bleed_dilation_px": 1,
    "bleed_blur_radius_px": 0.8,
    "bleed_strength": 0.32,
    "fading_strength": 0.16,
    "spacing_offset_ratio": 0.06,
}
#: Default settings (fixed values).
DEFAULTS = {
    "baseline_amplitude_px": 4.5,
    "baseline_wavelength_px": 420.0,
    "size_drift_ratio": 0.055,
    "rotation_degrees": 2.5,
    "elastic_grid_size": 4,
    "elastic_displacement_ratio": 0.025,
    "bleed_dilation_px": 1,
    "bleed_blur_radius_px": 0.55,
    "bleed_strength": 0.22,
    "fading_strength": 0.10,
    "spacing_offset_ratio": 0.045,
}


def named_digest(*parts: Column | str | int | float) -> Column:
    """SHA-256 (hex) of typed, length-prefixed parts; columns are typed by their Spark type given as (column, "str" or "int")."""
    said = []
    for part in parts:
        column, kind = part if isinstance(part, tuple) else (F.lit(part), type(part).__name__)
        text = column.cast("string")
        said += [F.lit(f"{kind}:"), F.length(text).cast("string"), F.lit(":"), text, F.lit("|")]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def seed(digest: Column) -> Column:
    """The digest's first eight bytes as an unsigned number, decimal(20, 0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def unit(digest: Column) -> Column:
    """The seed's top 53 bits by 2^53: a double from 0 up to 1."""
    top = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") * 2 + F.shiftright(F.conv(F.substring(digest, 14, 1), 16, 10).cast("int"), 3)
    return top / F.lit(float(1 << 53))


def signed(digest: Column) -> Column:
    return 2.0 * unit(digest) - 1.0


def pick(digest: Column, n: Column) -> Column:
    """Seed modulo n."""
    return F.pmod(seed(digest), n.cast("decimal(20,0)")).cast("int")


def labelled_digest(**parts: Column) -> Column:
    """SHA-256 (hex) of ``name:length:value`` of each part, joined by bars."""
    said = [F.concat(F.lit(f"{k}:"), F.length(v).cast("string"), F.lit(":"), v) for k, v in parts.items()]
    return F.sha2(F.concat_ws("|", *said).cast("binary"), 256)


def style_id(pair_id: Column) -> Column:
    return F.concat(F.lit("style-"), F.substring(F.sha2(pair_id.cast("binary"), 256), 1, 8))


def pseudo_writer(pair_id: Column) -> Column:
    return F.concat(F.lit("pw-"), F.substring(F.sha2(F.concat(F.lit("pseudo-writer:"), pair_id).cast("binary"), 256), 1, 16))


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The uniform Catmull-Rom curve between p1 and p2."""
    square = t * t
    return 0.5 * (2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * square + (3.0 * p1 - p0 - 3.0 * p2 + p3) * square * t)


def smooth_field(identity: Column, key: Column, row: Column, x: Column, name: str, amplitude: Column, wavelength: Column) -> Column:
    """A smooth value within plus or minus ``amplitude``: a curve through named control values, one each wavelength."""
    knot = F.floor(x / wavelength)
    control = lambda k: signed(named_digest((identity, "str"), (key, "str"), (F.format_string("row:%d:control:%d", row, knot + k), "str"), name))
    value = amplitude * catmull_rom(control(-1), control(0), control(1), control(2), x / wavelength - knot)
    return F.when(amplitude == 0, 0.0).otherwise(F.greatest(-amplitude, F.least(amplitude, value)))


def writer_scaled(identity: Column, name: str, configured: float, low: float = 0.68) -> Column:
    """A writer's own strength, from ``low`` to 1 of the configured one."""
    share = unit(named_digest((identity, "str"), "profile", name, "writer-strength"))
    return F.lit(0.0) if configured == 0 else configured * (low + (1.0 - low) * share)


#: Least and largest value of each setting.
BOUNDS = {name: (0.0, LIMITS.get(name, math.inf)) for name in DEFAULTS} | {"elastic_grid_size": (LIMITS["elastic_grid_size"],) * 2, "baseline_wavelength_px": (LIMITS["baseline_min_wavelength_px"], math.inf)}


def validate_settings(settings: dict | None) -> dict | None:
    """Defaults with ``settings``; None if they are off. Names without bounds, and values that are no finite numbers within them, raise."""
    if settings is None or settings.get("enabled") is False:
        return None
    given = {k: v for k, v in settings.items() if k != "enabled"}
    wrong = sorted(str(k) for k in given if k not in BOUNDS)
    wrong += [f"{k}={v!r} (from {BOUNDS[k][0]} to {BOUNDS[k][1]})" for k, v in given.items() if k in BOUNDS and (type(v) not in (int, float) or not math.isfinite(v) or not BOUNDS[k][0] <= v <= BOUNDS[k][1])]
    if wrong:
        raise ValueError(f"bad settings: {', '.join(wrong)}")
    return DEFAULTS | given


def placement(settings: dict, identity: Column, key: Column, char_id: Column, row: Column, x: Column, pitch: Column, grid: bool = True) -> Column:
    """(baseline_offset_px, spacing_offset_px, size_scale, rotation_degrees) of a character, by its writer's profile."""
    p = {name: writer_scaled(identity, name, float(settings[name])) for name in ("baseline_amplitude_px", "size_drift_ratio", "rotation_degrees", "spacing_offset_ratio")}
    wave = settings["baseline_wavelength_px"] * (1.0 + 0.18 * unit(named_digest((identity, "str"), "profile", "baseline_wavelength_px", "writer-strength")))
    own = lambda what: signed(named_digest((identity, "str"), (key, "str"), (char_id, "int"), what))
    drift = smooth_field(identity, key, row, x, "size-drift-spline", F.lit(1.0), F.greatest(F.lit(LIMITS["baseline_min_wavelength_px"]), wave * 1.2))
    size = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.9 * drift + 0.1 * own("size-drift-local")))
    return F.struct(
        smooth_field(identity, key, row, x, "baseline-spline", p["baseline_amplitude_px"], wave).alias("baseline_offset_px"),
        (pitch * p["spacing_offset_ratio"] * own("spacing-offset") if grid else F.lit(0.0)).alias("spacing_offset_px"),
        (1.0 + p["size_drift_ratio"] * size).alias("size_scale"),
        (p["rotation_degrees"] * own("rotation")).alias("rotation_degrees"),
    )
