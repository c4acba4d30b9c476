"""Scalar formulas over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spherical polar stereographic grid of the radar product: radius in m, scale, central longitude in degrees.
RADIUS, SCALE, CENTRE = 6_370_040.0, 0.9330127019, 10.0


def log_amount(v: Column) -> Column:
    """log(1 + max(v, 0)); NULL stays NULL (H1)."""
    return F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0))))


def from_log(p: Column) -> Column:
    """max(exp(p) - 1, 0) (H2)."""
    return F.when(p.isNotNull(), F.greatest(F.expm1(p), F.lit(0.0)))


def non_negative(v: Column) -> Column:
    """max(v, 0), NULL stays NULL."""
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))


def clip(v: Column, low: int | Column, high: int | Column) -> Column:
    """H6."""
    return F.least(F.greatest(v, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def epoch_seconds(name: str) -> Column:
    """Seconds since 1970 of a timestamp column read as wall-clock UTC, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({name} AS TIMESTAMP_NTZ))")


def day_of(epoch: Column) -> Column:
    """The UTC date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))


def month_stem(epoch: Column) -> Column:
    """YYYY_MM of epoch seconds."""
    return F.date_format(day_of(epoch), "yyyy_MM")


def iso_utc(epoch: Column, suffix: str = "+00:00") -> Column:
    """ISO time of epoch seconds with ``+00:00`` or ``Z``."""
    rest = F.pmod(epoch, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.date_format(day_of(epoch), "yyyy-MM-dd"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit(suffix))


def wrap_longitude(d: Column) -> Column:
    """A difference of longitudes in [-180, 180) (H9)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def geometric_edges(low: float, high: float, n: int) -> list[float]:
    """``n`` points from low to high in equal ratios."""
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def stereographic_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point of the polar stereographic grid."""
    rho = F.hypot(x, y)
    lat = 90.0 - 2.0 * F.degrees(F.atan(rho / F.lit(2.0 * RADIUS * SCALE)))
    return F.lit(CENTRE) + F.degrees(F.atan2(x, -y)), lat


def stereographic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The point of the polar stereographic grid for degrees of longitude and latitude (the inverse of H11)."""
    rho = F.lit(2.0 * RADIUS * SCALE) * F.tan(F.radians((90.0 - lat) / 2.0))
    turned = F.radians(lon - F.lit(CENTRE))
    return rho * F.sin(turned), -rho * F.cos(turned)


def bilinear_weights(fy: Column, fx: Column) -> list[Column]:
    """Weights of the corners 00, 01, 10, 11 (H7)."""
    return [(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx]


def interpolate(v: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear between two knots, constant outside them (H8)."""
    inside = y0 + (v - x0) * F.try_divide(y1 - y0, x1 - x0)
    return F.when(v <= x0, y0).when(v >= x1, y1).otherwise(inside)


#: Fixed value: how members of daily files are named.
DAILY_MEMBER = r"(?:^|/)YW_2017\.002_(20\d{2})(\d{2})(\d{2})\.nc$"


def member_date(name: Column) -> Column:
    """The date in an archive member's name, NULL if it isn't one of the daily files."""
    parts = [F.regexp_extract(name, DAILY_MEMBER, k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts)) if hasattr(F, "try_to_date") else F.to_date(F.concat_ws("-", *parts)))


def metre_wkt(wkt: Column) -> Column:
    """A coordinate system's text with a metre that is one metre."""
    return F.regexp_replace(wkt, r'LENGTHUNIT\["metre",\s*1000(\.0+)?\]', 'LENGTHUNIT["metre",1]')


def unit_name(units: Column) -> Column:
    """Units in lower case without ``^`` and outer space."""
    return F.lower(F.trim(F.replace(units, F.lit("^"), F.lit(""))))


def file_safe(label: Column) -> Column:
    """A label as part of a file name."""
    return F.regexp_replace(label, r"[^A-Za-z0-9._-]+", "_")


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of an exact Euclidean disk."""
    if radius < 0:
        raise ValueError("a radius can't be negative")
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def half_widths(radius: int) -> dict[int, int]:
    """For each row offset of a disk the half width of its chord."""
    if radius < 0:
        raise ValueError("a radius can't be negative")
    return {dy: math.isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)}
