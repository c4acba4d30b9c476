"""Executable expectations (L1-L14): each is one row ``(contract, expected, found, ok)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verify import exact_quantiles


def expect(df: DataFrame, name: str, found: Column, expected: Column | float) -> DataFrame:
    """An aggregate of ``df`` against a number; a missing aggregate counts as not met."""
    want = expected if isinstance(expected, Column) else F.lit(float(expected))
    own = df.agg(found.cast("double").alias("found"), want.cast("double").alias("expected"))
    return own.select(F.lit(name).alias("contract"), "expected", "found", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)).alias("ok"))


def complete_timeline(times: DataFrame, time: str, step: int, part: str = "L3") -> list[DataFrame]:
    """Times are unique, not empty, and as many as their ends and step ask for (L3)."""
    spread = (F.max(time) - F.min(time)) / F.lit(step) + 1
    return [
        expect(times, f"{part} unique times", F.count(time) - F.count_distinct(time), 0),
        expect(times, f"{part} all steps there", F.count_distinct(time), spread),
        expect(times, f"{part} times lie on the step", F.count_if(F.pmod(F.col(time), F.lit(step)) != 0), 0),
    ]


def no_negatives(df: DataFrame, value: str) -> DataFrame:
    """L8."""
    return expect(df, f"L8 no negative {value}", F.count_if(F.col(value) < -1e-7), 0)


def equal_grids(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Cells that one grid lacks or whose coordinates differ (L4)."""
    left = a.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    both = left.withColumn("_a", F.lit(1)).join(b.select(*keys, *values).withColumn("_b", F.lit(1)), keys, "full")
    differs = F.col("_a").isNull() | F.col("_b").isNull()
    for v in values:
        differs = differs | (F.abs(F.col(v) - F.col(f"_{v}")) > tolerance)
    return expect(both, "L4 equal grids", F.count_if(F.coalesce(differs, F.lit(True))), 0)


def with_units(df: DataFrame, **units: str) -> DataFrame:
    """``df`` with units as metadata of its columns, which Parquet keeps (L2)."""
    return df.select(*(F.col(c).alias(c, metadata={**df.schema[c].metadata, "units": units[c]}) if c in units else F.col(c) for c in df.columns))


def declared(df: DataFrame, dimensions: list[str], units: dict[str, str], shapes: DataFrame | None = None) -> DataFrame:
    """A row for each column that a cube must have (L2): ``(contract, expected, found, ok)``. Dimensions come first and in order; other columns have the units that their metadata tell.

    What is asked and found are texts: a place among the columns, or units (``none`` where there are none, ``lacking`` for a column that isn't there).
    """
    rows = []
    for k, c in enumerate(dimensions):
        found = str(df.columns.index(c)) if c in df.columns else "lacking"
        rows.append((f"L2 dimension {c}", str(k), found, found == str(k)))
    for c, want in units.items():
        found = df.schema[c].metadata.get("units", "none") if c in df.columns else "lacking"
        rows.append((f"L2 units of {c}", want, found, found == want))
    return df.sparkSession.createDataFrame(rows, "contract string, expected string, found string, ok boolean")


def require_declared(df: DataFrame, dimensions: list[str], units: dict[str, str]) -> DataFrame:
    """``df``; fails if a column, its place or its unit isn't as ``declared``."""
    wrong = [f"{r['contract']}: {r['found']} instead of {r['expected']}" for r in declared(df, dimensions, units).collect() if not r["ok"]]  # a row a column
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def grid_orientation(cells: DataFrame, box: tuple[float, float, float, float]) -> list[DataFrame]:
    """The contracts of a geolocated grid ``(y, x, py, px, lat, lon, overlap)`` (L4): projected axes are one number a row and a column and increase, latitudes mostly increase with y and longitudes
    with x (the median step is above 0), and the overlap lies in ``box`` (south, north, west, east)."""
    out = []
    for a, p in (("y", "py"), ("x", "px")):
        axis = cells.groupBy(a).agg(F.min(p).alias("low"), F.max(p).alias("high"))  # a row or column each, so one window is short
        steps = axis.select((F.col("low") - F.lag("high").over(Window.orderBy(a))).alias("d"), (F.col("high") - F.col("low")).alias("spread"))
        out.append(expect(steps, f"L4 {p} increases", F.count_if((F.col("d") <= 0) | (F.col("spread") > 1e-8)), 0))
    for a, across, p, way in (("y", "x", "lat", "north"), ("x", "y", "lon", "east")):
        before = F.lag(F.struct(a, p)).over(Window.partitionBy(across).orderBy(a))
        steps = cells.withColumn("_b", before).filter(F.col(f"_b.{a}") == F.col(a) - 1).select((F.col(p) - F.col(f"_b.{p}")).alias("d"))
        # the median is above 0 if and only if more than half of the steps are, or half are and the two in the middle sum to more than 0
        middle = exact_quantiles(steps, "d", (0.5,)).select(F.col("q")[0].alias("m"))
        out.append(expect(middle, f"L4 {way} is up", F.max((F.col("m") > 0).cast("int")), 1))
    south, north, west, east = box
    outside = ~(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    out.append(expect(cells.filter("overlap"), "L4 overlap in the box", F.count_if(outside), 0))
    return out


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """L2."""
    lacking = [n for n in names if n not in df.columns]
    return df.sparkSession.createDataFrame([("L2 required columns", 0.0, float(len(lacking)), not lacking)], "contract string, expected double, found double, ok boolean")


def monthly_files(audit: DataFrame, months: int = 24) -> DataFrame:
    """As many months as asked for have exactly one file (L1). ``audit`` is that of ``month_audit``."""
    return expect(audit, "L1 monthly files", F.count_if("ok"), months)


def archive_complete(seen: DataFrame, expected: DataFrame, day: str) -> list[DataFrame]:
    """No day is missing, unexpected or there twice."""
    return [
        expect(expected.join(seen, day, "left_anti"), "L11 missing days", F.count("*"), 0),
        expect(seen.join(expected, day, "left_anti"), "L11 unexpected days", F.count("*"), 0),
        expect(seen, "L11 repeated days", F.count(day) - F.count_distinct(day), 0),
    ]


def preflight(df: DataFrame, firsts: DataFrame, value: str, time: str) -> DataFrame:
    """For each of ``firsts(month, time)`` the cells of that time that have the value, and whether there are any."""
    own = df.join(firsts.select(time), time, "left_semi").groupBy(time).agg(F.count(value).alias("cells"))
    return firsts.join(own, time, "left").select("month", time, F.coalesce("cells", F.lit(0)).alias("cells"), (F.coalesce("cells", F.lit(0)) > 0).alias("ok"))


def report(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def enforce(contracts: DataFrame) -> DataFrame:
    """The report; its evaluation fails with the names of contracts that are not met."""
    failed = F.concat(F.lit("contract not met: "), F.col("contract"))
    return contracts.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(F.raise_error(failed).cast("boolean")))


def fraction_in_range(name: str, value: float) -> None:
    """L14."""
    if not 0 < value <= 1:
        raise ValueError(f"{name} must be in (0, 1]")


def positive(name: str, value: int) -> None:
    """L14."""
    if value < 1:
        raise ValueError(f"{name} must be at least 1")
