"""Small literal cases, properties against NumPy, and contracts that must fail."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from raingrid.functions import bins, missing, scalar
from raingrid.operators import contracts, extremes, ingest, predict, quantmap, regrid, sampling, spatial, splits, support, timealign, verify

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def cells(spark, *fields, names="target"):
    """Fields of one time as rows; NaN is NULL."""
    rows = []
    h, w = np.shape(fields[0])
    for y in range(h):
        for x in range(w):
            rows.append((0, y, x, *(None if f[y][x] is None or f[y][x] != f[y][x] else float(f[y][x]) for f in fields)))
    own = ", ".join(f"{n} double" for n in names.split())
    return spark.createDataFrame(rows, f"t int, y int, x int, {own}")


def to_grid(rows, value, h, w):
    out = np.full((h, w), np.nan)
    for r in rows:
        if r[value] is not None:
            out[r["y"], r["x"]] = r[value]
    return out


N = None


def test_common_support(spark):
    df = cells(spark, [[1, N, 1], [1, 1, 1]], [[1, 1, 1], [1, N, 1]], [[1, 1, 0], [1, 1, 1]], [[1, 1, 1], [1, 1, 0]], names="target coarse a o")
    df = df.withColumns({"a": F.col("a") == 1, "o": F.col("o") == 1})
    got = {(r["y"], r["x"]) for r in df.filter(support.input_support("target", "coarse", "a", "o")).collect()}
    assert got == {(0, 0), (1, 0)}


def test_missing_value_on_support_raises(spark):
    df = cells(spark, [[1, 0], [1, 1]], [[1, N], [2, N]], names="s p").withColumn("s", F.col("s") == 1)
    with pytest.raises(PySparkException, match="1 non-finite values on common support"):
        support.require_finite(df, "p", F.col("s")).collect()
    off = cells(spark, [[1, 0], [0, 0]], [[1, N], [N, N]], names="s p").withColumn("s", F.col("s") == 1)
    assert support.require_finite(off, "p", F.col("s")).count() == 4


def test_disks():
    assert [len(scalar.disk_offsets(r)) for r in (1, 2, 5, 10, 25)] == [5, 13, 81, 317, 1961]
    with pytest.raises(ValueError, match="negative"):
        scalar.disk_offsets(-1)


def test_regrid_mask_is_that_of_the_values(spark):
    coarse = spark.createDataFrame([(0, i, j, v) for i, row in enumerate([[N, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]) for j, v in enumerate(row)], "t int, i int, j int, v double")
    rows = []
    for y in range(2):
        for x in range(2):
            for k in range(4):
                rows.append((y, x, True, k, [[0, 0], [1, 1]][y][x] + k // 2, [[0, 1], [0, 1]][y][x] + k % 2, None if (y, x, k) == (0, 1, 3) else 1.0))
    mapping = spark.createDataFrame(rows, "y int, x int, overlap boolean, corner int, i int, j int, w double")
    values = {(r["y"], r["x"]): r["v"] is not None for r in regrid.regrid_bilinear(coarse, mapping).collect()}
    mask = {(r["y"], r["x"]): r["valid"] for r in regrid.bilinear_mask(coarse, mapping).collect()}
    assert values == mask == {(0, 0): False, (0, 1): False, (1, 0): True, (1, 1): True}


def test_disk_counts_of_one_event(spark):
    field = np.zeros((7, 7))
    field[3, 3] = 1
    df = cells(spark, field, names="v").withColumns({"e": (F.col("v") >= 1).cast("int"), "s": F.lit(1)})
    row = spatial.disk_sums(df, ["e", "s"], 1).filter("y = 3 and x = 3").first()
    assert (row["disk_e"], row["disk_s"]) == (1, 5)
    corner = spatial.disk_sums(df, ["s"], 1).filter("y = 0 and x = 0").first()
    assert corner["disk_s"] == 3


@FEW
@given(st.integers(0, 10_000), st.integers(1, 3))
def test_disk_sums_are_the_plain_ones(spark, seed, radius):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 3, (6, 8)).astype(float)
    rows = spatial.disk_sums(cells(spark, f, names="v"), ["v"], radius).collect()
    pad = np.pad(f, radius)
    want = sum(pad[radius + dy : radius + dy + 6, radius + dx : radius + dx + 8] for dy, dx in scalar.disk_offsets(radius))
    assert (to_grid(rows, "disk_v", 6, 8) == want).all()


@FEW
@given(st.integers(0, 10_000), st.sampled_from([2, 3, 5]))
def test_block_means_are_the_plain_ones(spark, seed, b):
    rng = np.random.default_rng(seed)
    f = np.where(rng.random((7, 11)) < 0.3, np.nan, rng.random((7, 11)))
    got = {(r["block_y"], r["block_x"]): (r["v"], r["cells"]) for r in spatial.block_means(cells(spark, f, names="v"), F.col("v").isNotNull(), ["v"], b, 7, 11).collect()}
    y0, x0 = (7 - 7 // b * b) // 2, (11 - 11 // b * b) // 2
    want = {}
    for y in range(7 // b):
        for x in range(11 // b):
            own = f[y0 + y * b : y0 + y * b + b, x0 + x * b : x0 + x * b + b]
            n = int((~np.isnan(own)).sum())
            if n >= np.ceil(0.5 * b * b):
                want[y, x] = (np.nanmean(own), n)
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-6 for k in want)


@FEW
@given(st.integers(0, 10_000))
def test_quantile_map_is_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.gamma(1, 2, 300), 1), rng.gamma(2, 2, 300)
    train = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "s double, d double")
    knots = quantmap.fit_quantile_map(train, "s", "d", 33)
    ps = np.arange(33) / 32
    src, dst = np.quantile(a, ps), np.quantile(b, ps)
    u = np.unique(src)
    mean = np.maximum.accumulate([dst[src == v].mean() for v in u])
    values = np.concatenate((rng.uniform(-1, a.max() + 1, 40), u))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = quantmap.apply_quantile_map(df, "v", knots).collect()
    assert np.allclose([r["mapped"] for r in got[:-1]], np.maximum(np.interp(values, u, mean), 0)) and got[-1]["mapped"] is None


@FEW
@given(st.integers(0, 10_000))
def test_histogram_is_the_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    edges = np.array([extremes.LOW * (extremes.HIGH / extremes.LOW) ** (k / 120) for k in range(121)] + [np.inf])
    v = np.concatenate((10 ** rng.uniform(-4, 3, 300), [0.0, 0.0, -1.0], edges[1:-1] * (1 + 1e-9)))
    long = spark.createDataFrame([("a", float(x)) for x in v] + [("a", None)], "m string, v double")
    got = {r["bin"]: r["n"] for r in extremes.log_histogram(long, "v", "m").collect()}
    assert [got[k] for k in range(121)] == np.histogram(v, edges)[0].tolist()
    assert got[-2] == 2 and got[-1] == int(((v > 0) & (v < extremes.LOW)).sum())


def test_scores_are_the_plain_ones(spark):
    rng = np.random.default_rng(1)
    o, f = np.round(rng.gamma(0.5, 3, (20, 20)), 1), np.round(rng.gamma(0.5, 3, (20, 20)), 1)
    o[0, :5] = np.nan
    f[5, :5] = np.nan
    df = cells(spark, o, f, names="o f")
    on = support.common_support("o", "f")
    ok = ~np.isnan(o) & ~np.isnan(f)
    row = verify.point_metrics(df, on, "o", "f", time="t").first()
    e = (f - o)[ok]
    assert row["n"] == ok.sum() and np.allclose([row["mae"], row["rmse"], row["bias"]], [abs(e).mean(), np.sqrt((e**2).mean()), e.mean()])
    for r in verify.event_scores(df, on, "o", ["f"]).collect():
        a, b = o[ok] >= r["threshold"], f[ok] >= r["threshold"]
        assert np.allclose([r["csi"], r["fss"]], [(a & b).sum() / (a | b).sum(), 1 - (a != b).sum() / (a.sum() + b.sum())])
    d = verify.distribution(df, on, "o").first()
    assert np.allclose([d["mean"], d["std"], d["p99_9"], d["wet_fraction"]], [o[ok].mean(), o[ok].std(), np.quantile(o[ok], 0.999), (o[ok] > 0).mean()])


def test_empty_support_gives_no_scores(spark):
    df = cells(spark, [[N, N]], [[1, 1]], names="o f")
    row = verify.point_metrics(df, support.common_support("o", "f"), "o", "f").first()
    assert row["n"] == 0 and row["mae"] is None
    strata = verify.strata(df, support.common_support("o", "f"), "gap", "o", ["f"]).collect()
    assert len(strata) == 5 and all(r["n"] == 0 and r["mae"] is None for r in strata)


def test_bins_differ_at_their_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.1, 1.0, 5.0, 10.0, 20.0, 20.5, None)], "v double")
    got = {name: [r[0] for r in df.select(bins.bin_of(name, "v")).collect()] for name in bins.REGISTRIES}
    assert got["diagnostics"] == [None, "0", "0.1-1", "1-5", ">=5", ">=5", ">=5", ">=5", None]
    assert got["gap"] == ["<0.1", "<0.1", "0.1-1", "1-5", "5-10", "5-10", ">10", ">10", None]
    assert got["heavy"] == ["<0.1", "<0.1", "0.1-1", "1-5", "5-10", "10-20", "10-20", ">20", None]
    assert got["validation"] == ["<0.1", "<0.1", "0.1-1", ">=1", ">=1", ">=1", ">=1", ">=1", None]


def test_a_float_tenth_does_not_exceed_a_tenth(spark):
    df = spark.createDataFrame([(0.1,)], "v float")
    assert df.select(bins.exceeds("v", 0.1, "float")).first()[0] is False


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double").select(missing.finite("v").alias("v"))
    assert [r[0] for r in df.collect()] == [None, None, 1.0, None]


def test_a_missing_step_loses_the_hour(spark):
    steps = [(300 * k, 1.0 if k != 14 else None) for k in range(24)] + [(7200 + 300 * k, 1.0) for k in range(11)]
    got = {r["hour_end"]: r["amount"] for r in timealign.strict_hourly_sum(spark.createDataFrame(steps, "t long, v double"), [], "t", "v", 12).collect()}
    assert got == {3600: 12.0, 7200: None, 10800: None}


def test_units(spark):
    df = spark.createDataFrame([(1.0, "m"), (1.0, " MM"), (1.0, "kg m^-2")], "v double, u string")
    assert [r[0] for r in df.select(ingest.to_millimetres(F.col("v"), F.col("u"))).collect()] == [1000.0, 1.0, 1.0]
    with pytest.raises(PySparkException, match="unknown units"):
        spark.createDataFrame([(1.0, "inch")], "v double, u string").select(ingest.to_millimetres(F.col("v"), F.col("u"))).collect()
    with pytest.raises(ValueError, match="none of"):
        ingest.resolve_aliases(df)


def test_projection_of_the_pole_and_back(spark):
    lon, lat = scalar.stereographic_inverse(F.col("x"), F.col("y"))
    r = spark.createDataFrame([(0.0, 0.0), (0.0, -4_000_000.0)], "x double, y double").select(lon, lat).collect()
    assert r[0][1] == 90.0 and r[1][0] == 10.0 and 50 < r[1][1] < 56


def test_typical_hours_and_ties(spark):
    stats = spark.createDataFrame([(1, 5, 0.0, 0.0), (2, 9, 0.0, 0.0), (3, 9, 0.0, 0.0), (4, 9, 1.0, 0.1), (5, 9, 2.0, 0.1), (6, 9, 2.0, 0.2)], "t long, cells long, max double, wet_fraction double")
    got = {r["t"]: r["labels"] for r in sampling.typical_hours(stats).collect()}
    assert got[2] == "dry" and got[5].endswith("peak")


def test_patches_by_sums_and_by_prefix_sums(spark):
    rng = np.random.default_rng(3)
    df = cells(spark, rng.integers(0, 2, (9, 9)).astype(float), names="v")
    key = lambda d: {(r["patch_y"], r["patch_x"]): r["value"] for r in d.collect()}
    assert key(spatial.patch_sums(df, F.col("v"), 4, 3, 9, 9)) == key(spatial.prefix_patch_sums(df, "v", 4, 3, 9, 9))
    assert spatial.patch_starts(1021, 128, 32)[-1] == 893 and spatial.patch_starts(3, 5, 1) == []


def test_tiles_round_trip_and_inference(spark):
    rng = np.random.default_rng(5)
    f = rng.random((10, 13)).astype(np.float32).astype(float)
    df = cells(spark, f, names="v")
    back = predict.from_tiles(predict.to_tiles(df, "v", 4), "v").collect()
    assert (to_grid(back, "v", 10, 13) == f).all()
    out = predict.infer_tiled(df, lambda: lambda field: field * 2, "v", core=4, halo=2, height=10, width=13).collect()
    assert len(out) == 130 and np.allclose(to_grid(out, "prediction", 10, 13), 2 * f)


def test_contracts_fail_where_they_should(spark):
    times = spark.createDataFrame([(0,), (300,), (900,)], "t long")
    rows = {r["contract"]: r["ok"] for r in contracts.report(contracts.complete_timeline(times, "t", 300)).collect()}
    assert rows == {"L3 unique times": True, "L3 all steps there": False, "L3 times lie on the step": True}
    with pytest.raises(PySparkException, match="contract not met: L3 all steps there"):
        contracts.enforce(contracts.report(contracts.complete_timeline(times, "t", 300))).collect()
    with pytest.raises(ValueError):
        contracts.fraction_in_range("coverage", 0.0)
    with pytest.raises(ValueError):
        contracts.positive("samples", 0)


def test_splits_share_no_day(spark):
    times = spark.range(0, 86400 * 20, 3600).toDF("t")
    own = splits.chronological_splits(times)
    assert splits.overlap_of_splits(own).count() == 0
    assert {r["split"]: r["days"] for r in splits.split_summary(own).collect()} == {"train": 14, "validation": 3, "test": 3}


def test_digests(spark):
    import hashlib
    import struct

    times = spark.createDataFrame([(7200,), (3600,)], "t long")
    assert support.timestamp_digest(times, "t") == hashlib.sha256(struct.pack("<qq", 3600, 7200)).hexdigest()
    a, b = cells(spark, [[1, N], [1, 1]], names="v"), cells(spark, [[5, N], [2, 3]], names="v")
    same = [support.mask_digests(d, "t", F.col("v").isNotNull()).first()["mask_digest"] for d in (a, b)]
    other = support.mask_digests(cells(spark, [[1, 1], [1, 1]], names="v"), "t", F.col("v").isNotNull()).first()["mask_digest"]
    assert same[0] == same[1] != other


def test_knots_of_negative_targets_are_raised_before_the_maximum(spark):
    """With targets -4, 2 at sources 0, 1: the middle maps between 0 and 2, not between -4 and 2."""
    train = spark.createDataFrame([(0.0, -4.0), (1.0, 2.0)], "s double, d double")
    knots = quantmap.fit_quantile_map(train, "s", "d", 2)
    assert sorted((r["src"], r["dst"]) for r in knots.collect()) == [(0.0, 0.0), (1.0, 2.0)]
    got = quantmap.apply_quantile_map(spark.createDataFrame([(0.5,), (None,)], "v double"), "v", knots).collect()
    assert {r["v"]: r["mapped"] for r in got} == {0.5: 1.0, None: None}


def test_more_knots_than_are_looked_up_raise(spark):
    knots = spark.range(9).selectExpr("double(id) AS src", "double(id) AS dst")
    df = spark.createDataFrame([(4.5,)], "v double")
    assert quantmap.apply_quantile_map(df, "v", knots, most=15).first()["mapped"] == 4.5
    with pytest.raises(Exception, match="9 knots, at most 7"):
        quantmap.apply_quantile_map(df, "v", knots, most=7).collect()


def test_a_time_in_two_splits_raises(spark):
    own = spark.createDataFrame([(1, "train"), (2, "train"), (2, "test")], "t long, split string")
    with pytest.raises(Exception, match="in several splits: 2"):
        splits.classify(spark.createDataFrame([(2,)], "t long"), own).collect()
    assert [r["split"] for r in splits.classify(spark.createDataFrame([(1,), (3,)], "t long"), own.filter("t = 1")).orderBy("t").collect()] == ["train", "unclassified"]


def test_partial_splits_are_refused(spark):
    own = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "t long, split string")
    cover = splits.split_coverage(spark.createDataFrame([(1,), (3,), (9,)], "t long"), own)
    assert {tuple(r) for r in cover.collect()} == {("train", 2, 1, 1, 0), ("test", 1, 1, 0, 0), ("unclassified", 0, 1, 0, 1)}
    assert splits.require_coverage(cover, "test").first()["found"] == 1
    with pytest.raises(Exception, match="partial split train: missing 1"):
        splits.require_coverage(cover, "train").collect()


def test_fields_with_other_times_raise(spark):
    a = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 0, 2.0)], "t long, y int, x int, a double")
    b = spark.createDataFrame([(1, 0, 0, 3.0)], "t long, y int, x int, b double")
    with pytest.raises(Exception, match="time axes differ: 1 and 0"):
        timealign.read_fields(a, b, ["y", "x"]).collect()
    assert [(r["a"], r["b"]) for r in timealign.read_fields(a.filter("t = 1"), b, ["y", "x"]).collect()] == [(1.0, 3.0)]


def test_scores_of_one_pass_raise_where_a_method_lacks_a_value(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 1.5), (1, 3.0, None, 1.0)], "t long, truth double, a double, b double")
    (row,) = verify.overall_metrics(df, F.lit(True), "truth", ["b"], "t").collect()
    assert (row["n"], row["mae"], row["bias"], row["valid_hours"]) == (2, 1.25, -0.75, 1)
    with pytest.raises(Exception, match="1 non-finite values of a on common support"):
        verify.overall_metrics(df, F.lit(True), "truth", ["a", "b"], "t").collect()


def test_no_dry_hour_is_said_so(spark):
    stats = spark.createDataFrame([(1, 5, 2.0, 0.5), (2, 5, 3.0, 0.25)], "t long, cells long, max double, wet_fraction double")
    got = {r["t"]: r["labels"] for r in sampling.typical_hours(stats).collect()}
    assert got[2].split("+")[0] == "driest_available" and "dry" not in got[1].split("+")


def test_steps_back_show_in_the_order_of_a_file(spark):
    df = spark.createDataFrame([("f", 0, 0), ("f", 1, 600), ("f", 2, 300), ("f", 3, 600)], "part string, place int, t long")
    assert {(r["t"], r["gap"]) for r in timealign.cadence_gaps(df, "t", 300, ["part"], "place").collect()} == {(600, 600), (300, -300)}


def test_early_stopping(spark):
    losses = [3.0, 2.0, 2.0, None, 1.0, 1.5, float("nan")]
    got = verify.early_stopping(spark.createDataFrame(list(enumerate(losses)), "e int, loss double"), "e", "loss", 2).orderBy("e").collect()
    assert [r["improved"] for r in got] == [True, True, False, False, True, False, False]
    assert [r["epochs_since"] for r in got] == [0, 0, 1, 2, 0, 1, 2] and [r["stop"] for r in got] == [False, False, False, True, False, False, True]


def test_digests_of_times_in_spark_are_those_of_the_driver(spark):
    df = spark.createDataFrame([(1,), (1500000000,), (-3,), (1,)], "t long")
    assert df.agg(support.time_digest("t").alias("d")).first()["d"] == support.timestamp_digest(df, "t")


def test_lookup_on_an_axis_of_unequal_steps(spark):
    axis = [0.0, 0.5, 1.5, 3.0, 3.25]
    values = [-1.0, 0.0, 0.25, 0.5, 2.9, 3.0, 3.2, 3.25, 9.0]
    got = regrid.axis_lookup(spark.createDataFrame([(v,) for v in values], "v double"), "v", spark.createDataFrame(list(enumerate(axis)), "k int, at double"), "k", "at").collect()
    at = np.clip(np.searchsorted(axis, values, side="right") - 1, 0, len(axis) - 2)
    assert {r["v"]: r["place"] for r in got} == dict(zip(values, at.tolist(), strict=True))
    for r in got:
        assert abs(r["beyond"] - (r["v"] - axis[r["place"]]) / (axis[r["place"] + 1] - axis[r["place"]])) < 1e-12


def test_samples_are_the_first_by_hash(spark):
    """The share of hashes that is sorted holds all that are wanted."""
    import hashlib

    cells = [(t, k // 40, k % 40) for t, n in ((1, 1), (2, 60), (3, 1500)) for k in range(n)]
    got = sampling.pixel_sample(spark.createDataFrame(cells, "t long, y int, x int"), 5, most=40, least=8, share=100).collect()
    for t, n in ((1, 1), (2, 60), (3, 1500)):
        want = sorted((hashlib.md5(f"5:{t}:{y}:{x}".encode()).hexdigest(), y, x) for u, y, x in cells if u == t)[: min(n, 40, max(8, n // 100))]
        assert {(r["y"], r["x"]) for r in got if r["t"] == t} == {(y, x) for _, y, x in want}


@pytest.mark.parametrize("core", [4, 5, 16])
def test_disks_by_tiles_are_disks_by_chords(spark, core):
    rng = np.random.default_rng(core)
    fields = [np.where(rng.random((11, 13)) < 0.85, rng.random((11, 13)) * 2, np.nan) for _ in range(2)]
    df = cells(spark, *fields, names="a b").withColumn("on", F.col("a").isNotNull() & F.col("b").isNotNull())
    tiled = {r["radius_cells"]: r for r in spatial.disk_scores_of(df, F.col("on"), "a", "b", 1.0, (0, 1, 3, 4), 11, 13, core=core).collect()}
    for r in (0, 1, 3, 4):
        want = spatial.disk_scores(df, "on", "a", "b", 1.0, r, 11, 13).first().asDict()
        assert all(abs(tiled[r][k] - v) < 1e-9 for k, v in want.items())


def test_exact_quantiles_are_those_of_a_sort(spark):
    rng, levels = np.random.default_rng(4), (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
    groups = {"many": rng.gamma(0.3, 5, 3000), "ties": rng.integers(-2, 3, 500).astype(float), "one": np.array([3.5]), "wide": rng.normal(0, 1, 400) * 10.0 ** rng.integers(-8, 9, 400), "hot": np.array([0.0] * 900 + [7.0, 7.5])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["q"] for r in verify.exact_quantiles(df, "v", levels, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(v, levels), rtol=1e-12, atol=1e-15)
    assert verify.exact_quantiles(df.filter("k = 'one'"), "v", levels).first()["q"] == [3.5] * 6
    assert verify.value_stats(df.filter("v is null"), "v").first()["median"] is None
    same = [verify.distribution(df, F.lit(True), "v", ["k"], small=s).orderBy("k").collect() for s in (False, True)]
    for a, b in zip(*same, strict=True):
        # sums of floats are in any order, so a mean may differ in its last digit
        assert [x for x in a[:8] if not isinstance(x, float)] == [x for x in b[:8] if not isinstance(x, float)]
        assert [x for x in a[:8] if isinstance(x, float)] == pytest.approx([x for x in b[:8] if isinstance(x, float)], rel=1e-12)
        assert [round(x, 9) for x in a[8:] if x is not None] == [round(x, 9) for x in b[8:] if x is not None]


def test_overlaps_of_projected_cells(spark):
    cells = spark.createDataFrame([(0, 0, 50.0, 50.3, 9.9, 10.4), (1, 0, 10.0, 11.0, 9.9, 10.4)], "i int, j int, south double, north double, west double, east double")
    got = regrid.projected_overlap(cells, -50_000.0, -4_400_000.0, 1000.0, 200, 200).groupBy("i").agg(F.sum("w").alias("w"), F.max("w").alias("most")).collect()
    lon, lat = np.meshgrid(np.radians(np.array([9.9, 10.4]) - 10), [50.0, 50.3])
    rho = 2 * scalar.RADIUS * scalar.SCALE * np.tan(np.radians((90 - lat) / 2)) / 1000
    area = np.ptp(rho * np.sin(lon)) * np.ptp(rho * np.cos(lon))
    assert [r["i"] for r in got] == [0] and abs(got[0]["w"] - area) < 1e-6 and abs(got[0]["most"] - 1) < 1e-9
    there = spark.range(5).select((F.col("id") + 7.5).alias("lon"), (F.col("id") + 47.5).alias("lat"))
    x, y = scalar.stereographic(F.col("lon"), F.col("lat"))
    lon, lat = scalar.stereographic_inverse(F.col("x"), F.col("y"))
    for r in there.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
