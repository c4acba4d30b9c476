"""Normalisation of raw fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which sources have their variables.
ALIASES = {"time": ["valid_time", "time"], "precipitation": ["tp", "total_precipitation", "RR", "precipitation"], "latitude": ["latitude", "lat"], "longitude": ["longitude", "lon"]}
FACTORS = {1000.0: ("m", "metre", "metres", "meter", "meters"), 1.0: ("mm", "kg m-2", "kg m**-2")}
FILL = 999.0


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rename the first name that is there of each list (B1); a name of which none is there is an error."""
    found = {}
    for name, options in aliases.items():
        own = next((o for o in options if o in df.columns), None)
        if own is None:
            raise ValueError(f"none of {options} is a column")
        found[own] = name
    return df.select(*(F.col(c).alias(found.get(c, c)) for c in df.columns))


def to_millimetres(value: Column, units: Column) -> Column:
    """Amounts in mm; another unit than those known raises (B2)."""
    name = F.lower(F.trim(F.replace(units, F.lit("^"), F.lit(""))))
    out = F.raise_error(F.concat(F.lit("unknown units: "), F.coalesce(units, F.lit("NULL")))).cast("double")
    for factor, names in FACTORS.items():
        out = F.when(name.isin(*names), value * F.lit(factor)).otherwise(out)
    return out


def fill_to_null(value: Column, fill: float = FILL) -> Column:
    """NULL for the fill value and for NaN."""
    return F.when((value != F.lit(fill)) & ~F.isnan(value), value)


def ascending(df: DataFrame, index: str, n: int) -> DataFrame:
    """Turn an axis round by its index alone."""
    return df.withColumn(index, F.lit(n - 1) - F.col(index))


def in_box(lat: str, lon: str, south: float, north: float, west: float, east: float) -> Column:
    """Inside a box, edges included; a missing coordinate is outside."""
    return F.coalesce(F.col(lat).between(south, north) & F.col(lon).between(west, east), F.lit(False))


def bounding_crop(cells: DataFrame, inside: Column, y: str = "y", x: str = "x") -> DataFrame:
    """Cells of the smallest rectangle of rows and columns that holds all cells inside (B6). One row is broadcast."""
    box = cells.filter(inside).agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"))
    return cells.join(F.broadcast(box), F.col(y).between(F.col("y0"), F.col("y1")) & F.col(x).between(F.col("x0"), F.col("x1"))).drop("y0", "y1", "x0", "x1")


def within_overlap(df: DataFrame, overlap: DataFrame) -> DataFrame:
    """Rows of cells in the overlap."""
    return df.join(overlap.filter("overlap").select("y", "x"), ["y", "x"], "left_semi")


def enough_coverage(value: Column, fraction: Column, least: float = 0.8) -> Column:
    """NULL where too little of a coarse cell was seen."""
    return F.when(fraction >= F.lit(least), value)


def thinned(df: DataFrame, step: int, y: str = "y", x: str = "x") -> DataFrame:
    """Every ``step``-th row and column."""
    return df.filter((F.col(y) % step == 0) & (F.col(x) % step == 0))
