"""Column expressions on positions, speeds and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KT_TO_MS = 0.514444
GRAVITY = 9.80665

# Ordered boxes (name, west, east, south, north); the first that holds a point names it.
COASTS = (
    ("Taiwan", 119, 122.5, 21.5, 25.5), ("Philippines", 117, 127, 5, 19), ("Vietnam", 102, 110, 8, 23), ("Korea", 124, 130, 33, 39),
    ("Japan", 128, 146, 30, 46), ("China_E", 118, 123, 26, 35), ("China_S", 105, 120, 18, 26),
)


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def lon_difference(a: Column, b: Column) -> Column:
    """b - a, in [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def unit_vector(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def chord_to_km(chord: Column, radius: float = EARTH_KM) -> Column:
    return 2 * radius * F.asin(F.least(F.greatest(chord / 2, F.lit(0.0)), F.lit(1.0)))


def cell_area_km2(lat: Column, dlat: float, dlon: float, radius: float = EARTH_KM) -> Column:
    return radius**2 * F.radians(F.lit(dlat)) * F.radians(F.lit(dlon)) * F.cos(F.radians(lat))


def classify_boxes(lat: Column, lon: Column, boxes: Sequence[tuple] = COASTS, default: str = "Other") -> Column:
    """Name of the first closed box that holds the point."""
    out = F.lit(default)
    for name, west, east, south, north in reversed(boxes):
        out = F.when(lon.between(west, east) & lat.between(south, north), name).otherwise(out)
    return out


def phase(index: Column, threshold: float = 0.5) -> Column:
    """Warm, cold or neutral phase; the thresholds belong to the phases."""
    return F.when(index >= threshold, "El_Nino").when(index <= -threshold, "La_Nina").otherwise("Neutral")


def tropical_stage(wind: Column, nature: Column, threshold: float, stage: str = "TS") -> Column:
    return (wind >= threshold) & (nature.isNull() | (nature == stage))


def flag_at(flags: Column, position: int, accepted: Sequence[str]) -> Column:
    """Whether the character at a zero-based position is accepted; false where the text is too short."""
    return F.coalesce(F.substring(flags, position + 1, 1).isin(*accepted), F.lit(False))


def geopotential_height(value: Column, units: str) -> Column:
    """Metres from geopotential; heights pass; other units are an error."""
    if units in ("m**2 s**-2", "m2 s-2", "m^2/s^2"):
        return value / GRAVITY
    if units in ("m", "gpm"):
        return value
    raise ValueError(f"ambiguous geopotential units: {units!r}")
