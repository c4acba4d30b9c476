"""The four registries of intensity bins and the thresholds (J1). They differ at their edges and are kept apart (Z-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Bin = tuple[str, Callable[[Column], Column]]

#: Event thresholds (>=) and exceedance thresholds (>), in mm/h.
EVENT_THRESHOLDS = (0.1, 1.0, 5.0)
HEAVY_THRESHOLDS = (1.0, 5.0, 10.0, 20.0, 50.0)
PATCH_THRESHOLDS = (1.0, 5.0, 10.0)

REGISTRIES: dict[str, list[Bin]] = {
    "validation": [
        ("<0.1", lambda v: v < 0.1),
        ("0.1-1", lambda v: (v >= 0.1) & (v < 1)),
        (">=1", lambda v: v >= 1),
    ],
    "diagnostics": [
        ("0", lambda v: v == 0),
        ("0-0.1", lambda v: (v > 0) & (v < 0.1)),
        ("0.1-1", lambda v: (v >= 0.1) & (v < 1)),
        ("1-5", lambda v: (v >= 1) & (v < 5)),
        (">=5", lambda v: v >= 5),
    ],
    "gap": [
        ("<0.1", lambda v: v < 0.1),
        ("0.1-1", lambda v: (v >= 0.1) & (v < 1)),
        ("1-5", lambda v: (v >= 1) & (v < 5)),
        ("5-10", lambda v: (v >= 5) & (v <= 10)),
        (">10", lambda v: v > 10),
    ],
    "heavy": [
        ("<0.1", lambda v: v < 0.1),
        ("0.1-1", lambda v: (v >= 0.1) & (v < 1)),
        ("1-5", lambda v: (v >= 1) & (v < 5)),
        ("5-10", lambda v: (v >= 5) & (v < 10)),
        ("10-20", lambda v: (v >= 10) & (v <= 20)),
        (">20", lambda v: v > 20),
    ],
}


def bin_of(registry: str, value: str) -> Column:
    """The label of a value's bin; NULL for a missing value, and where no bin holds it."""
    out = F.lit(None).cast("string")
    for label, holds in reversed(REGISTRIES[registry]):
        out = F.when(holds(F.col(value)), F.lit(label)).otherwise(out)
    return out


def event(value: str, threshold: float) -> Column:
    """``value >= threshold``."""
    return F.col(value) >= F.lit(threshold)


def exceeds(value: str, threshold: float, kind: str = "double") -> Column:
    """``value > threshold``; on float columns the threshold is a float too (B12, Z-3)."""
    return F.col(value) > F.lit(threshold).cast(kind)
