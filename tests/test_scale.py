"""What plans must look like at scale, and results that only larger or odd inputs show."""

import datetime
import glob
import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from raingrid.functions import scalar
from raingrid.operators import contracts, extremes, predict, regrid, sampling, splits, states, support, verify, windows
from raingrid.sources import archive, reports, tables
from raingrid.sources.shared import new_path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    df.collect()  # the plan that ran
    return df._jdf.queryExecution().executedPlan().toString()


# --- regridding


def test_nothing_is_extrapolated_beyond_the_axes(spark):
    coarse = spark.createDataFrame([(0, i, j, float(j)) for i in range(4) for j in range(4)], "t long, i int, j int, v double")
    fine = spark.createDataFrame([(0, k, 1.5, lon) for k, lon in enumerate((-0.01, 0.0, 1.25, 3.0, 3.01, 4.5))], "y int, x int, lat double, lon double")
    mapping = regrid.bilinear_map(fine, (0.0, 1.0, 4), (0.0, 1.0, 4), F.lit(True))
    assert {r["x"]: r["v"] for r in regrid.regrid_bilinear(coarse, mapping, 4).collect()} == {1: 0.0, 2: 1.25, 3: 3.0}
    assert {r["x"]: r["overlap"] for r in mapping.collect()} == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_a_regrid_is_written_by_as_many_tasks_as_are_asked_for(spark):
    coarse = spark.range(40).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).select("t", (F.col("k") / 4).cast("int").alias("i"), (F.col("k") % 4).cast("int").alias("j"), F.rand(1).alias("v"))
    fine = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x")).withColumns({"lat": F.col("y") / 7.0, "lon": F.col("x") / 7.0})
    mapping = regrid.bilinear_map(fine, (0.0, 1.0, 4), (0.0, 1.0, 4), F.lit(True))
    own = regrid._corners(coarse, mapping, 4, "t", "v", tasks=13)
    used = own.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == 13


def test_a_field_with_a_gap_is_as_fast_as_a_whole_one(spark):
    n, width = 2000, 50
    rows = [(t, k // width, k % width, float(k)) for t in range(20) for k in range(n) if k != 777 + t]
    got = {r["t"]: r["_f"] for r in regrid.dense_fields(spark.createDataFrame(rows, "t long, i int, j int, v double"), width, "t", "v").collect()}
    for t in range(20):
        assert got[t] == [None if k == 777 + t else float(k) for k in range(n)]


def test_weights_of_coarse_cells_are_their_own_areas(spark):
    x0, y0, step, n = -20_000.0, -4_300_000.0, 10_000.0, 30
    cells = [(i, j, 49.0 + i * 0.25, 49.25 + i * 0.25, 8.8 + j * 0.4, 9.2 + j * 0.4) for i in range(18) for j in range(16)]
    got = regrid.clipped_overlap(spark.createDataFrame(cells, "i int, j int, south double, north double, west double, east double"), x0, y0, step, n, n).collect()
    total = np.zeros((n, n))
    per = {}
    for r in got:
        total[r["y"], r["x"]] += r["w"]
        per.setdefault((r["y"], r["x"]), {})[r["i"], r["j"]] = r["w"]
    inside = total > 1 - 1e-6
    assert inside.sum() > 400 and np.abs(total[inside] - 1).max() < 1e-6 and total.max() < 1 + 1e-6
    # against dense points of some fine cells, told by the edges' sides
    points = spark.createDataFrame([(lon, lat) for _, _, a, b, c, d in cells for lon, lat in ((c, a), (d, a), (d, b), (c, b))], "lon double, lat double")
    flat = [((r[0] - x0) / step, (r[1] - y0) / step) for r in points.select(*scalar.stereographic(F.col("lon"), F.col("lat"))).collect()]
    at = (np.arange(60) + 0.5) / 60
    for y, x in ((5, 5), (12, 20), (20, 3)):
        gx, gy = np.meshgrid(x + at, y + at)
        for k, (i, j, *_) in enumerate(cells):
            own = flat[4 * k : 4 * k + 4]
            sides = [(qx - px) * (gy - py) - (qy - py) * (gx - px) for (px, py), (qx, qy) in zip(own, own[1:] + own[:1], strict=True)]
            share = (np.all([v >= 0 for v in sides], axis=0) | np.all([v <= 0 for v in sides], axis=0)).mean()
            assert share == pytest.approx(per.get((y, x), {}).get((i, j), 0.0), abs=0.02)


# --- quantiles


def exact(values, levels):
    return [float(np.quantile(np.array(values, np.float64), q)) for q in levels]


@pytest.mark.parametrize("few,digits", [(65_536, 4_096), (3, 4), (1, 2)])
def test_quantiles_of_many_groups_by_rounds(spark, monkeypatch, few, digits):
    monkeypatch.setattr(verify, "FEW", few)
    monkeypatch.setattr(verify, "DIGITS", digits)
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1) for _ in range(900)], "b": [1.0 + k * 1e-13 for k in range(300)], "c": [2.5] * 40, None: [1e-300, 0.0, -1e300, 1e300, 5e-324], "d": [7.0], "e": [rng.choice([0.1, 0.2, 0.3]) for _ in range(200)]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("only missing", None)]
    levels = (0.0, 0.5, 0.9, 0.999, 1.0)
    got = {r["g"]: r["q"] for r in verify.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", levels, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g] == pytest.approx(exact(own, levels), rel=1e-12, abs=1e-300), g


def test_distinct_values_of_one_bucket_in_bounded_memory(spark):
    # two million doubles between 1 and 1.01 lie in one or two of the first ranges
    df = spark.range(2_000_000).select((1 + F.col("id") * 5e-9).alias("v"))
    q = verify.exact_quantiles(df, "v", (0.25, 0.5, 0.99)).first()["q"]
    assert q == pytest.approx([1 + 5e-9 * 1_999_999 * p for p in (0.25, 0.5, 0.99)], abs=1e-12)


def test_quantiles_ask_for_no_buffer_of_a_group(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("epoch"), (F.col("id") / 7).alias("truth"), (F.col("id") / 9).alias("est"))
    plan = plan_of(verify.validation_stats(df, F.lit(True), "validation", "truth", "est", "epoch"))
    assert "percentile" not in plan.lower()


# --- samples and patches


def test_a_sample_leaves_cells_behind_before_it_shuffles(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("t"), F.floor(F.col("id") / 100).alias("y"), (F.col("id") % 100).alias("x"))
    own = sampling.pixel_sample(df, 3, fixed=50)
    plan = plan_of(own)
    assert own.count() == 150
    below = plan[plan.index("Exchange hashpartitioning(t") :] if "Exchange hashpartitioning(t" in plan else plan
    assert "Filter" in below and "BroadcastHashJoin" in below


def test_patches_of_many_epochs_against_every_cell(spark):
    rng = random.Random(2)
    patches = [(e, t, rng.randrange(0, 40), rng.randrange(0, 40)) for e in range(9) for t in range(6)]
    cells = [(t, y, x, rng.choice([0.5, 3.0, 7.0, 20.0]) * (rng.random() < 0.02)) for t in range(6) for y in range(45) for x in range(45) if rng.random() < 0.7]
    values = spark.createDataFrame([c for c in cells if c[3]], "t long, y int, x int, v double")
    own = extremes.patch_exceedance(spark.createDataFrame(patches, "epoch int, t long, patch_y int, patch_x int"), values, 5)
    got = {r["epoch"]: r for r in own.collect()}
    for e in [*range(9), "all"]:
        most = [max([v for u, y, x, v in cells if u == t and py <= y < py + 5 and px <= x < px + 5], default=0) for k, t, py, px in patches if e in ("all", k)]
        for limit in (1, 5, 10):
            assert got[str(e)][f"max_gt_{limit}"] == sum(m > limit for m in most)
    # what is shuffled is maxima and lists of patches, no cell
    plan = plan_of(own)
    assert "SortMergeJoin [t" not in plan


# --- cubes by time and by month


def test_cubes_by_time_meet_without_a_shuffle(spark):
    cube = spark.range(4000).select((F.col("id") % 40 * 3600).alias("time_epoch"), F.floor(F.col("id") / 40).cast("int").alias("y"), F.lit(0).alias("x"), F.rand(3).alias("v"))
    path = new_path(spark, "cubes")
    one = tables.write_by_time(cube, "scale_one", f"{path}/one", buckets=6)
    two = tables.write_by_time(cube.select("time_epoch", "y", "x", (F.col("v") * 2).alias("w")), "scale_two", f"{path}/two", buckets=6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = tables.join_by_time(one, two, ["y", "x"])
        both = own.groupBy("time_epoch").agg(F.count("*").alias("n"), F.max(F.abs(F.col("w") - 2 * F.col("v"))).alias("d"))
        plan = plan_of(both)
        rows = both.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE scale_one")
        spark.sql("DROP TABLE scale_two")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert len(rows) == 40 and {(r["n"], r["d"]) for r in rows} == {(100, 0.0)}


def test_a_split_reads_its_own_months(spark):
    month = 31 * 86400
    cube = spark.range(1200).select((F.col("id") % 12 * month + F.floor(F.col("id") / 12) * 3600).alias("time_epoch"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("v"))
    path, manifest = new_path(spark, "cube"), new_path(spark, "manifest")
    tables.write_months(cube, path)
    reports.write_manifest(splits.chronological_splits(cube.select("time_epoch"), "time_epoch"), manifest)
    test = reports.read_manifest(spark, manifest, "test")
    kept = {r["m"] for r in test.select(scalar.month_stem(F.col("time_epoch")).alias("m")).collect()}
    assert len(kept) < 12
    for file in glob.glob(f"{path.removeprefix('file:')}/month=*/*.parquet"):
        if file.split("month=")[1][:7] not in kept:
            with open(file, "wb") as other:  # a scan that opened it would fail
                other.write(b"no table")
    own = splits.in_split_of_cube(spark.read.schema("time_epoch long, y int, x int, v double, month string").parquet(path), test, "test")
    assert "dynamicpruning" in plan_of(own)
    assert {r["time_epoch"] for r in own.collect()} == {r["time_epoch"] for r in test.collect()}


# --- masks


def test_packed_masks_are_numpy_s(spark):
    rng = np.random.default_rng(1)
    height, width = 5, 7
    masks = {t: rng.random((height, width)) < 0.4 for t in (3600, 7200, -5)}
    rows = [(t, y, x, bool(m[y, x])) for t, m in masks.items() for y in range(height) for x in range(width) if m[y, x] or (x + y) % 3]
    got = {r["t"]: r["mask_digest"] for r in support.packed_mask_digests(spark.createDataFrame(rows, "t long, y int, x int, on boolean"), "t", F.col("on"), height, width).collect()}
    for t, m in masks.items():
        record = np.asarray([t], "<i8").tobytes() + np.asarray(m.shape, "<i8").tobytes() + np.packbits(m.reshape(-1)).tobytes()
        assert got[t] == hashlib.sha256(record).hexdigest()


def test_a_metre_of_any_decimals(spark):
    df = spark.createDataFrame([(f'X["y",LENGTHUNIT["metre",{n}]]',) for n in ("1000", "1000.0", "1000.00", "1000.5", "10000")], "w string")
    assert [r[0][22:] for r in df.select(scalar.metre_wkt(F.col("w"))).collect()] == ["e\",1]]", "e\",1]]", "e\",1]]", "e\",1000.5]]", "e\",10000]]"]


# --- files


def test_a_radar_slab_takes_bounded_memory(tmp_path):
    """A day's first hours of the radar grid, 1100 x 900, by a stand-in for the library, in a process of its own: rows go out a time at once."""
    code = """
import datetime, resource, sys
from types import SimpleNamespace
import numpy as np
from raingrid.sources import netcdf
class Variable:
    units, shape = "mm", (24, 1100, 900)
    def __getitem__(self, at):
        n = len(range(24)[at])
        return np.ma.masked_less(np.random.default_rng(0).random((n, 1100, 900), np.float32), 0.1)
class Dataset(dict):
    def __init__(self, path): super().__init__(v=Variable(), time=SimpleNamespace(units="h", __getitem__=None))
    def __enter__(self): return self
    def __exit__(self, *_): pass
class Axis:
    units = "hours"
    def __getitem__(self, at): return np.arange(24)[at]
Dataset.__getitem__ = lambda self, k: Axis() if k == "time" else Variable()
sys.modules["netCDF4"] = SimpleNamespace(Dataset=Dataset, num2date=lambda h, u, **_: [datetime.datetime.fromtimestamp(int(k) * 3600, datetime.timezone.utc) for k in h])
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = missing = 0
for batch in netcdf.record_batches("v")("x.nc"):
    rows += len(batch)
    missing += batch.column("v").null_count
print(rows, missing, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT, timeout=120)
    rows, missing, mb = map(int, out.stdout.split())
    assert rows == 24 * 1100 * 900 and 0.05 < missing / rows < 0.15 and mb < 300


def test_members_that_are_no_whole_day_fail_by_name(spark):
    day = 17897 * 86400
    rows = [("a", 0, "YW_20190101.nc", datetime.date(2019, 1, 1), day + 300 * k, c) for k in range(288) for c in range(2)]
    schema = "archive string, place int, member string, day date, t long, c int"
    got = archive.require_days(spark.createDataFrame(rows, schema), cells=2).collect()
    assert [(r["steps"], r["first"]) for r in got] == [(288, day)]
    later = [(*r[:4], r[4] + 300, r[5]) for r in rows]
    for wrong in (rows[:-2], rows[1:], later, [(*r[:3], None, *r[4:]) for r in rows], [(*r[:4], r[4] + (r[4] == day + 600) * 60, r[5]) for r in rows]):
        with pytest.raises(Exception, match="not a whole day: YW_20190101.nc"):
            archive.require_days(spark.createDataFrame(wrong, schema), cells=2).collect()


# --- contracts and tiles


def test_a_wrong_unit_or_order_fails_by_name(spark):
    df = contracts.with_units(spark.createDataFrame([(0, 1, 2, 3.0)], "time long, y int, x int, v double"), v="mm")
    path = new_path(spark, "units")
    df.write.parquet(path)
    read = spark.read.parquet(path)
    assert contracts.require_declared(read, ["time", "y", "x"], {"v": "mm"}).count() == 1
    for dims, units, said in ((["time", "x", "y"], {}, "L2 dimension x: 2 instead of 1"), ([], {"v": "m"}, "L2 units of v: mm instead of m"), ([], {"w": "m"}, "lacking")):
        with pytest.raises(ValueError, match=said):
            contracts.require_declared(read, dims, units)


def test_tiles_of_a_large_field_are_arrays_in_the_task(spark):
    cells = spark.range(300 * 300).select(F.lit(5).cast("long").alias("t"), F.floor(F.col("id") / 300).alias("y"), (F.col("id") % 300).alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") % 11 * 1.0).alias("v"))

    def make():
        return lambda f: np.pad(f, 1)[2:, 1:-1] - 3  # the cell below, less 3

    got = predict.infer_tiled(cells, make, "v", core=64, halo=2, height=300, width=300)
    assert "MapInArrow" in plan_of(got) and dict(got.dtypes) == {"t": "bigint", "y": "int", "x": "int", "prediction": "double"}
    value = lambda y, x: 0.0 if y > 299 or (y * 300 + x) % 7 == 0 else (y * 300 + x) % 11 * 1.0
    rows = got.collect()
    assert len(rows) == 90_000 and all(r["prediction"] == max(value(r["y"] + 1, r["x"]) - 3, 0) for r in rows)


# --- as-of merge and states that merge


def test_axis_merge_is_the_lookup(spark):
    rng = np.random.default_rng(4)
    points = sorted(set(np.round(rng.gamma(2.0, 30.0, 300), 2).tolist()))
    axis = spark.createDataFrame([(k, p) for k, p in enumerate(points)], "k int, at double")
    values = [None, float("nan"), float("-inf"), -5.0, 1e9, *points[:5], points[-1], points[-2], *([points[70]] * 900), *np.round(rng.uniform(-1, 300, 1500), 2).tolist()]
    df = spark.createDataFrame(list(enumerate(values)), "place_id int, v double").repartition(5)
    key = lambda rows: sorted((r["place_id"], r["place"], str(r["beyond"])) for r in rows)
    want = key(regrid.axis_lookup(df, "v", axis, "k", "at").collect())
    for tasks in (1, 7, 64):
        assert key(regrid.axis_merge(df, "v", axis, "k", "at", tasks).select("place_id", "place", "beyond").collect()) == want
    assert regrid.axis_merge(df.limit(0), "v", axis, "k", "at").count() == 0
    assert {r["place"] for r in regrid.axis_merge(df, "v", axis.limit(1), "k", "at").collect()} == {None}


def test_axis_merge_of_many_points_has_no_nested_loop(spark):
    axis = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 1.5 + F.col("id") % 3 * 0.25).alias("at"))
    # a third of all rows has one value
    df = spark.range(1_000_000).select("id", F.when(F.col("id") % 3 == 0, 777.0).otherwise((F.col("id") * 7919 % 149_990).cast("double")).alias("v"))
    own = regrid.axis_merge(df, "v", axis, "k", "at", 8)
    wrong = own.withColumn("p", F.col("place") * 1.5 + F.col("place") % 3 * 0.25).withColumn("q", (F.col("place") + 1) * 1.5 + (F.col("place") + 1) % 3 * 0.25)
    got = wrong.agg(F.count("*").alias("n"), F.count_if((F.col("v") < F.col("p")) | (F.col("v") >= F.col("q"))).alias("wrong")).first()
    assert (got["n"], got["wrong"]) == (1_000_000, 0)
    assert "NestedLoop" not in plan_of(wrong.agg(F.count("*"))) and "Cartesian" not in plan_of(wrong.agg(F.count("*")))


def test_axis_merge_deals_a_long_axis_over_tasks(spark, monkeypatch):
    plans = []
    write = regrid.written
    monkeypatch.setattr(regrid, "written", lambda df, name: plans.append(plan_of(df)) or write(df, name))
    monkeypatch.setattr(regrid, "ROWS_A_TASK", 250, raising=False)
    monkeypatch.setattr(regrid, "CHUNK_POINTS", 64, raising=False)
    axis = spark.range(1_000).select((F.col("id") * 2).alias("k"), (F.col("id") * 1.5 + F.col("id") % 3 * 0.25).alias("at"))
    df = spark.range(1_537).select("id", (F.col("id") * 7919 % 1_537 - 20).cast("double").alias("v"))
    got = regrid.axis_merge(df, "v", axis, "k", "at")
    key = lambda rows: sorted((r["id"], r["place"], r["beyond"]) for r in rows)
    assert key(got.collect()) == key(regrid.axis_lookup(df, "v", axis, "k", "at").collect())
    # no window has the whole axis, no aggregate sorts the rows, and tasks grow with the rows (4 are set)
    assert all(spec.startswith("_chunk") for p in plans for spec in re.findall(r"(?:lead|row_number)\(.*?windowspecdefinition\((\w+)", p))
    assert "SortAggregate" not in plan_of(got)
    assert any(int(n) >= 11 for n in re.findall(r"rangepartitioning\(_key.*?, (\d+)\)", plans[-1]))


def test_states_add_new_months_without_reading_old_ones(spark, tmp_path):
    import shutil

    rng = np.random.default_rng(2)
    first = 1_546_300_800
    rows = [(first + 3600 * int(h), int(c), float(np.float32(rng.gamma(0.5))), None if rng.random() < 0.1 else float(rng.gamma(0.5)), float(rng.gamma(0.5))) for h in range(0, 24 * 90, 5) for c in range(4)]
    df = spark.createDataFrame(rows, "t long, c int, truth double, a double, b double")
    support = F.col("a").isNotNull() & (F.col("c") < 3)
    cube, kept = f"{tmp_path}/cube", f"{tmp_path}/states"
    update = lambda: states.update_states(spark.read.schema("t long, c int, truth double, a double, b double, month string").parquet(cube), kept, support, "truth", ["a", "b"], "t", (0.1, 1.0))
    tables.write_months(df.filter(F.col("t") < first + 59 * 86400), cube, "t")
    assert update().select("month").distinct().count() == 2
    tables.write_months(df, cube, "t")
    for old in glob.glob(f"{cube}/month=2019_01/*.parquet"):
        with open(old, "wb") as out:  # a file that can't be read
            out.write(b"broken")
    own = update()
    assert own.count() == 3 * 2 * 3
    assert update().count() == own.count()  # nothing new
    point = {r["method"]: r for r in states.point_scores(own).collect()}
    for m in ("a", "b"):
        want = verify.point_metrics(df, support, "truth", m, time="t").first()
        assert (point[m]["n"], point[m]["valid_hours"]) == (want["n"], want["valid_hours"])
        assert [point[m][k] for k in ("mae", "rmse", "bias")] == pytest.approx([want[k] for k in ("mae", "rmse", "bias")], rel=1e-12)
    key = lambda rows: sorted((r["method"], r["threshold"], r["hits"], r["false_alarms"], r["misses"], r["csi"], r["fss"]) for r in rows)
    assert key(states.event_scores(own).collect()) == key(verify.event_scores(df, support, "truth", ["a", "b"], (0.1, 1.0)).collect())
    by_month = {r["month"]: r["n"] for r in states.point_scores(own, ["month"]).filter("method = 'a'").collect()}
    assert sum(by_month.values()) == point["a"]["n"] and set(by_month) == {"2019_01", "2019_02", "2019_03"}
    # a month that was made again
    shutil.rmtree(f"{kept}/month=2019_03")
    assert update().count() == 18


# --- windows


def dense_regrid(coarse, lat, lon):
    """The bilinear field at fractional places of a coarse field, missing where a corner is."""
    i, j = np.minimum(np.floor(lat).astype(int), coarse.shape[0] - 2), np.minimum(np.floor(lon).astype(int), coarse.shape[1] - 2)
    a, b = (lat - i)[:, None], (lon - j)[None, :]
    at = lambda k, m: coarse[np.ix_(i + k, j + m)]
    return (1 - a) * (1 - b) * at(0, 0) + (1 - a) * b * at(0, 1) + a * (1 - b) * at(1, 0) + a * b * at(1, 1)


def test_windows_of_a_coarse_field_are_those_of_the_regridded_one(spark):
    rng, height, width = np.random.default_rng(8), 70, 50
    fields = rng.gamma(0.5, 4.0, (3, 6, 5))
    fields[rng.random(fields.shape) < 0.06] = np.nan
    lat, lon = np.linspace(0, 5, height), np.linspace(0, 4, width)
    fine = spark.createDataFrame([(y, x, float(lat[y]), float(lon[x])) for y in range(height) for x in range(width)], "y int, x int, lat double, lon double")
    mapping = regrid.bilinear_map(fine, (0.0, 1.0, 6), (0.0, 1.0, 5), (F.col("y") > 1) | (F.col("x") > 3))
    want = np.stack([dense_regrid(f, lat, lon) for f in fields])
    want[:, :2, :4] = np.nan
    coarse = spark.createDataFrame([(t, i, j, None if np.isnan(v) else float(v)) for (t, i, j), v in np.ndenumerate(fields)], "t int, i int, j int, v double")
    cells = regrid.regrid_bilinear(coarse, mapping, 5)

    def check(own, side):
        rows = own.collect()
        for r in rows:
            part = want[r["t"], r["y0"] : min(r["y1"], height), r["x0"] : min(r["x1"], width)]
            value, seen = np.zeros((side, side)), np.zeros((side, side))
            value[: part.shape[0], : part.shape[1]], seen[: part.shape[0], : part.shape[1]] = np.nan_to_num(np.log1p(part)), ~np.isnan(part)
            np.testing.assert_allclose(np.array(r["input"]).reshape(side, side), value, rtol=1e-6, atol=1e-7)
            np.testing.assert_array_equal(np.array(r["available"]).reshape(side, side), seen)
        return len(rows)

    # the same patch in two epochs, one partly beyond the grid, one wholly outside, one of a time without a field
    patches = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 30, 31), (0, 2, 60, 45), (0, 2, 90, 90)], "epoch int, t int, patch_y int, patch_x int")
    keys = ["epoch", "t", "patch_y", "patch_x"]
    own = windows.patch_windows(patches, 16)
    assert check(windows.coarse_inputs(own, coarse, mapping, keys, 16, 5), 16) == 5
    assert check(windows.fine_inputs(own, cells, keys, 16), 16) == 5
    nothing = windows.coarse_inputs(windows.patch_windows(patches.limit(1).withColumn("t", F.lit(99)), 4), coarse, mapping, keys, 4, 5).first()
    assert (nothing["input"], nothing["available"]) == ([0.0] * 16, [0] * 16)
    tiles = spark.createDataFrame([(t, top, left) for t in range(3) for top in (0, 32, 64) for left in (0, 32)], "t int, top int, left int")
    own = windows.context_windows(tiles, 32, 9, height, width)
    assert check(windows.coarse_inputs(own, coarse, mapping, ["t", "top", "left"], 50, 5), 50) == 18
    assert check(windows.fine_inputs(own, cells, ["t", "top", "left"], 50), 50) == 18
    assert {(r["top"], r["left"], r["core_y"], r["core_x"], r["core_h"], r["core_w"]) for r in own.collect()} >= {(0, 0, 0, 0, 32, 32), (64, 32, 9, 9, 6, 18)}
    assert windows.coarse_inputs(own.limit(0), coarse, mapping, ["t", "top", "left"], 50, 5).count() == 0
